"""The registry of result schemas: profiles by name, listed, read and resolved from options."""

from __future__ import annotations

from pyspark.sql import types as T

from .model import CHANGES, EDGES, SYMBOLS

SPACE = "ripplespark:schema:v1"


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_RISK = "level string, direct_hits long, transitive_hits long, impacted_files long, impacted_symbols long"
_SUMMARY = f"by_depth array<struct<depth:int,symbol_count:long,file_count:long>>, affected_modules array<struct<module:string,symbol_count:long,file_count:long>>, risk struct<{', '.join(x.replace(' ', ':', 1) for x in _RISK.split(', ')).replace(', ', ',')}>"
_ARRAY = lambda ddl: f"array<{_struct(ddl).simpleString()}>"


def _impact(detail: str, flow: str) -> T.StructType:
    parts = [f"changed_symbols {_ARRAY(SYMBOLS)}", f"impacted_symbols {_ARRAY(SYMBOLS + ', depth int')}", "impacted_files array<string>"]
    if detail == "with_edges":
        parts.append(f"edges {_ARRAY(EDGES)}")
    summary = _struct(_SUMMARY).simpleString()
    if flow != "call_graph":
        summary = summary[:-1] + ",slice_selection:array<struct<path:string,tier:int,reason:string,via:string>>>"
    return _struct(", ".join([*parts, f"summary {summary}"]))


def profiles() -> dict[str, T.StructType]:
    """All profiles: diff, changed, id, and impact by grouping, detail and data flow."""
    out = {"diff": _struct(CHANGES), "changed": _struct(f"changed_files array<string>, changed_symbols {_ARRAY(SYMBOLS)}"), "id": _struct(f"id string, symbol {_struct(SYMBOLS).simpleString()}")}
    for group in ("default", "per_seed"):
        for detail in ("summary_only", "with_edges"):
            for flow in ("call_graph", "pdg", "propagation"):
                one = _impact(detail, flow)
                if group == "per_seed":
                    one = _struct(f"seed_id string, direction string, output {one.simpleString()}")
                out[f"impact/{group}/{detail}/{flow}"] = one
    return out


def names() -> list[str]:
    return sorted(profiles())


def get(name: str) -> dict:
    """A profile's schema document; KeyError for an unknown name."""
    return {"id": f"{SPACE}:{name}", "schema": profiles()[name].jsonValue()}


def resolve(command: str, per_seed: bool = False, with_edges: bool = False, with_pdg: bool = False, with_propagation: bool = False, form: str = "json", raw: bool = False) -> str:
    """The profile of a command's result; propagation goes before dependence graphs. ValueError where a result has no schema."""
    if form != "json" or raw:
        raise ValueError("only JSON results have a schema")
    if command in ("diff", "changed", "id"):
        return command
    if command != "impact":
        raise ValueError(f"command {command!r}")
    return "/".join(("impact", "per_seed" if per_seed else "default", "with_edges" if with_edges else "summary_only", "propagation" if with_propagation else "pdg" if with_pdg else "call_graph"))
