"""Scalar functions on paths, module paths and names, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE = r"\.(rs|rb|js|ts|tsx|py|go|java)$"
#: A file that stands for its folder, with a slash before it.
ENTRY = r"(^|.*)/(mod\.rs|lib\.rs|main\.rs|index\.js|index\.ts|index\.tsx|__init__\.py)$"
#: What may follow a module path in a file name.
ENDINGS = (".rs", ".rb", ".js", ".ts", ".tsx", ".py", ".go", ".java", "/index.js", "/index.ts", "/index.tsx", "/__init__.py", "/mod.rs")


def clean(path: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def strip_side(path: Column) -> Column:
    """Without a diff's ``a/`` or ``b/``."""
    return F.regexp_replace(path, r"^[ab]/", "")


def parent(path: Column) -> Column:
    """The folder of a path, empty for none."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def module_path(path: Column) -> Column:
    """The module path (``::``) of a file; an entry file stands for its folder."""
    p = F.regexp_replace(path, r"^\./", "")
    entry = p.rlike(ENTRY)
    bare = F.when(entry, parent(p)).otherwise(F.regexp_replace(p, SOURCE, ""))
    return F.replace(bare, F.lit("/"), F.lit("::"))


def module_label(path: Column) -> Column:
    """The group that a file counts for: its folder (``(root)`` for an entry file without one), else its own name."""
    p = clean(path)
    base = F.element_at(F.split(p, "/"), -1)
    folder = parent(p)
    entry = base.rlike(r"^(mod\.rs|lib\.rs|main\.rs|index\.(js|ts|tsx)|__init__\.py)$")
    return F.when(folder != "", folder).when(entry, F.lit("(root)")).otherwise(base)


def file_matches(file: Column, module: Column) -> Column:
    """Whether a file is the module's: its name ends with the module path and a known ending."""
    base = F.replace(module, F.lit("::"), F.lit("/"))
    name = F.regexp_replace(file, r"^\./", "")
    ends = reduce(lambda a, b: a | b, (F.endswith(name, F.concat(base, F.lit(e))) for e in ENDINGS))
    return F.coalesce((module != "") & ends, F.lit(False))


def module_ends(file: Column) -> Column:
    """Every text, with slashes, that ``file_matches`` takes for the file's module: for equi joins with module paths."""
    name = F.regexp_replace(file, r"^\./", "")
    stems = F.array(*(F.when(F.endswith(name, F.lit(e)), F.substring(name, F.lit(1), F.length(name) - len(e))) for e in ENDINGS))
    found = F.filter(stems, lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.length(x))))))


def module_keys(file: Column) -> Column:
    """Every module path, segment by segment from the right, that a file matches: for equi joins with module paths."""
    name = F.regexp_replace(file, r"^\./", "")
    index = name.rlike(r"/(index\.(js|ts|tsx)|__init__\.py|mod\.rs)$")
    bare = F.when(name.rlike(SOURCE), F.regexp_replace(name, SOURCE, ""))

    def tails(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))

    none = F.array().cast("array<string>")
    own = F.when(bare.isNotNull(), tails(bare)).otherwise(none)
    folder = F.when(index, tails(parent(name))).otherwise(none)
    return F.array_distinct(F.concat(own, folder))


def expand_relative(current: Column, path: Column) -> Column:
    """A path that begins with crate, self or super, from the module that it stands in.

    ``crate::`` is dropped; ``self::`` is the module; a run of ``super::`` pops one
    segment. Other paths are taken to lie under the module as well.
    """
    rest = F.regexp_replace(path, r"^(self::)+", "")
    up = rest.startswith("super::")
    rest = F.regexp_replace(rest, r"^(super::)+", "")
    base = F.filter(F.split(current, "::"), lambda x: x != "")
    base = F.when(up & (F.size(base) > 0), F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0)))).otherwise(base)
    joined = F.array_join(F.concat(base, F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))), "::")
    return F.when(path.startswith("crate::"), F.regexp_replace(path, r"^(crate::)+", "")).otherwise(joined)


def normalise(path: Column) -> Column:
    """A path without ``.``, empty and, where they cancel, ``..`` segments."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: (x != ".") & (x != ""))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(done, F.array(F.lit(".."))), F.greatest(F.size(done), F.lit(1))) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, none, step), "/")


def resolve_specifier(file: Column, spec: Column) -> Column:
    """The module path (``::``) of an import specifier, relative to the file's folder where it starts with a dot."""
    full = F.when(spec.startswith("."), normalise(F.concat_ws("/", parent(file), spec))).otherwise(spec)
    return F.replace(F.regexp_replace(full, r"\.(js|ts|tsx|jsx|mjs|cjs)$", ""), F.lit("/"), F.lit("::"))


def ignored(path: Column, dirs: tuple[str, ...] | list[str]) -> Column:
    """Whether a path is one of the folders or lies in one. Empty names are no folders."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    out = F.lit(False)
    for d in dirs:
        if not d:
            continue
        d = d.replace("\\", "/").removeprefix("./").removesuffix("/")
        out = out | (p == d) | p.startswith(d + "/")
    return F.coalesce(out, F.lit(False))


def hint(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds any of the words."""
    return F.lower(text).rlike("|".join(words))


def snake_case(name: Column) -> Column:
    """``FooBar`` as ``foo_bar``, with ``::`` as ``/``."""
    s = F.replace(name, F.lit("::"), F.lit("/"))
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2"))


def escape_dot(text: Column) -> Column:
    """Text for a quoted DOT string."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
