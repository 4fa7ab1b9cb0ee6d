"""Relations of the engine, the enumerations in them, and the grammar of symbol ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANGES = "diff_id string, file_ord int, line_ord int, old_path string, new_path string, kind string, old_line int, new_line int, content string"
SYMBOLS = "id string, name string, kind string, file string, start_line int, end_line int, language string"
REFS = "ref_id long, name string, kind string, file string, line int, qualifier string, is_method boolean"
IMPORTS = "file string, entry_type string, key string, target string"
EDGES = "src string, dst string, kind string, file string, line int, certainty string, provenance string"
DFG_NODES = "id string, name string, file string, line int, ord long"
DFG_EDGES = "src string, dst string, kind string"
FN_FLOW = "function_id string, input_ord int, input_id string, impacted_id string"

#: Kind of a symbol and its code in an id.
KINDS = {"function": "fn", "method": "method", "struct": "struct", "enum": "enum", "trait": "trait", "module": "mod"}
CERTAINTY = ("dynamic_fallback", "inferred", "confirmed")
PROVENANCE = ("symbolic_propagation", "local_dfg", "call_graph")
REF_KIND = ("data", "call", "control")
LANGUAGES = ("rust", "ruby", "python", "javascript", "typescript", "tsx", "go", "java")
EXTENSIONS = {"rs": "rust", "rb": "ruby", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java"}


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in an ordered enumeration; null for others."""
    out = None
    for i, name in enumerate(order):
        out = F.when(value == name, i) if out is None else out.when(value == name, i)
    return out


def unrank(value: Column, order: tuple[str, ...]) -> Column:
    """The value at a place of an ordered enumeration; null for none."""
    out = None
    for i, name in enumerate(order):
        out = F.when(value == i, name) if out is None else out.when(value == i, name)
    return out


def certainty_rank(value: Column) -> Column:
    return rank(value, CERTAINTY)


def symbol_id(language: Column, file: Column, kind: Column, name: Column, line: Column) -> Column:
    """``lang:file:kindcode:name:line``."""
    code = rank_to(kind, KINDS)
    return F.concat_ws(":", language, file, code, name, line.cast("string"))


def rank_to(value: Column, names: dict[str, str]) -> Column:
    out = None
    for a, b in names.items():
        out = F.when(value == a, b) if out is None else out.when(value == a, b)
    return out


def parse_id(value: Column) -> Column:
    """A struct of an id's five parts; null where it hasn't five or its kind or line isn't valid.

    The file may hold colons: the language is the first part, the others are counted from the end.
    """
    parts = F.split(value, ":")
    n = F.size(parts)
    known = {**{v: k for k, v in KINDS.items()}, "function": "function", "module": "module"}
    kind = rank_to(F.get(parts, n - 3), known)
    line = F.get(parts, n - 1).try_cast("int")
    made = F.struct(
        F.get(parts, F.lit(0)).alias("language"),
        F.array_join(F.slice(parts, 2, F.greatest(n - 4, F.lit(0))), ":").alias("file"),
        kind.alias("kind"),
        F.get(parts, n - 2).alias("name"),
        line.alias("line"),
    )
    return F.when((n >= 5) & kind.isNotNull() & line.isNotNull(), made)


@dataclass(frozen=True)
class ImpactOptions:
    """What an impact query follows and reports."""

    direction: str = "callers"
    max_depth: int = 100
    with_edges: bool = False
    ignore_dirs: tuple[str, ...] = field(default_factory=tuple)
    min_confidence: str | None = None
    exclude_dynamic_fallback: bool = False

    def __post_init__(self) -> None:
        if self.direction not in ("callers", "callees", "both"):
            raise ValueError(f"direction {self.direction!r}")
        if self.max_depth < 0:
            raise ValueError("max_depth is negative")
        if self.min_confidence is not None and self.min_confidence not in CERTAINTY:
            raise ValueError(f"min_confidence {self.min_confidence!r}")


def profile(name: str | None, min_confidence: str | None = None, exclude: bool = False) -> tuple[str | None, bool]:
    """Confidence options of an operational profile; what is given explicitly wins."""
    known = {None: (None, False), "balanced": ("inferred", False), "precision-first": ("confirmed", True)}
    if name not in known:
        raise ValueError(f"profile {name!r}")
    least, drop = known[name]
    return min_confidence or least, exclude or drop
