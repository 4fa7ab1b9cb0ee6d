"""Reports: JSON, YAML, DOT and HTML. Only here do results come to the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .functions.paths import escape_dot  # noqa: F401  (column form of the same escapes)

FORMATS = {"diff": ("json", "yaml"), "changed": ("json", "yaml"), "id": ("json", "yaml", "raw"), "impact": ("json", "yaml", "dot", "html"), "per_seed": ("json", "yaml")}
FILL = {"changed": "#fee", "impacted": "#eef", "context": "#eee"}


def check_format(what: str, form: str) -> None:
    """ValueError if a result can't be written in a format."""
    if form not in FORMATS[what]:
        raise ValueError(f"{what} can't be written as {form}")


def rows(df: DataFrame, order: list[str] | None = None) -> list[dict]:
    """Rows as dictionaries without nulls, sorted."""

    def plain(x):
        if hasattr(x, "asDict"):
            return {k: plain(v) for k, v in x.asDict().items() if v is not None}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return [plain(r) for r in (df.orderBy(*order) if order else df).collect()]


def to_json(value: object) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def to_yaml(value: object, depth: int = 0) -> str:
    """YAML of plain values; strings are quoted as JSON where they need it."""
    pad = "  " * depth
    if isinstance(value, dict):
        if not value:
            return "{}"
        out = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            out.append(f"{pad}{k}:" + ("\n" + to_yaml(v, depth + 1) if nested else " " + to_yaml(v)))
        return "\n".join(out)
    if isinstance(value, list):
        if not value:
            return "[]"
        return "\n".join(f"{pad}- " + to_yaml(v, depth + 1).lstrip() if isinstance(v, (dict, list)) and v else f"{pad}- {to_yaml(v)}" for v in value)
    if isinstance(value, str) and value and value.replace("_", "").replace("/", "").replace(".", "").replace("-", "").isalnum() and not value[0].isdigit() and value not in ("true", "false", "null", "yes", "no"):
        return value
    return json.dumps(value, ensure_ascii=False)


def _quote(text: object) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(symbols: Iterable[dict], edges: Iterable[dict], path_edges: Iterable[tuple[str, str]] = (), title: str = "impact") -> str:
    """A DOT graph. ``symbols``: id, name, role; edges on a highlighted path are red, control edges dashed."""
    red, known, out = set(path_edges), set(), [f"digraph {title} {{", "  rankdir=LR;"]
    for s in symbols:
        known.add(s["id"])
        out.append(f"  {_quote(s['id'])} [label={_quote(s.get('name', s['id']))}, style=filled, fillcolor={_quote(FILL[s.get('role', 'context')])}];")
    for e in edges:
        for end in (e["src"], e["dst"]):
            if end not in known:
                known.add(end)
                out.append(f"  {_quote(end)} [label={_quote(end)}, style=filled, fillcolor={_quote(FILL['context'])}];")
        marks = [f"label={_quote(e.get('kind', ''))}"]
        if e.get("kind") == "control":
            marks.append("style=dashed")
        if (e["src"], e["dst"]) in red:
            marks.append('color="red"')
        out.append(f"  {_quote(e['src'])} -> {_quote(e['dst'])} [{', '.join(marks)}];")
    return "\n".join([*out, "}"])


def html(report: dict) -> str:
    """A page with the report's data, lists and edge table; a filter box hides rows that don't match."""
    from html import escape

    data = json.dumps(report, ensure_ascii=False).replace("</", "<\\/")

    def table(name: str, columns: list[str]) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in report.get(name, []))
        return f"<h2>{escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    parts = [table("changed_symbols", ["id", "name", "kind", "file"]), table("impacted_symbols", ["id", "name", "kind", "file", "depth"]), table("edges", ["src", "dst", "kind", "certainty", "provenance"])]
    script = "const q=document.getElementById('q');q.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.includes(q.value));"
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Impact</title></head><body><input id=\"q\" placeholder=\"filter\">{''.join(parts)}<script type=\"application/json\" id=\"data\">{data}</script><script>{script}</script></body></html>"
