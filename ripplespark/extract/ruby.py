"""Analyzer of Ruby by lines: declarations and their ends, calls, dynamic sends, requires."""

from __future__ import annotations

import re

from . import Found, Import, Ref, Symbol
from .text import Lines, folder, join, mask

_OPEN = re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|unless|case|begin|while)\b")
_END = re.compile(r"^[ \t]*end\b|;\s*end\b")
_DECL = re.compile(r"^[ \t]*(?:(?:private|protected|public)\s+)?(def|class|module)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)")
_ONE_LINE = re.compile(r"\bend\s*$")
_DEFINE = re.compile(r"\bdefine_method\s*\(?\s*[:\"']([A-Za-z_]\w*[?!]?)")
_ALIAS = re.compile(r"\balias_method\s*\(?\s*[:\"'](\w+[?!]?)[\"']?\s*,\s*[:\"'](\w+[?!]?)")
_SEND = re.compile(r"\b(?:public_send|send|__send__)\s*\(?\s*([^,)\n]+)")
_CALL = re.compile(r"(?:([A-Za-z_@][\w:@.]*)\s*&?\.\s*)?([a-z_]\w*[?!]?)\s*\(")
_DOT = re.compile(r"([A-Za-z_@][\w:@]*)\s*&?\.\s*([a-z_]\w*[?!]?)(?!\s*[\w(=])")
_BARE = re.compile(r"^[ \t]*([a-z_]\w*[?!]?)(?=\s*$|\s+[:\"'\w@])")
_ASSIGN = re.compile(r"^[ \t]*([a-z_]\w*)\s*=\s*(.+?)\s*$")
_REQUIRE = re.compile(r"^[ \t]*require(_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]", re.M)
_NOT = frozenset("if unless while until for case when def class module end do then else elsif begin rescue ensure return yield and or not in super self nil true false puts require require_relative attr_reader attr_writer attr_accessor private public protected include extend loop raise lambda proc send public_send __send__ define_method alias_method".split())


def _target(value: str, known: dict[str, str], depth: int = 8) -> list[str]:
    """Names that a send's argument may be: a symbol or string, through assignments, ``to_sym`` and alternatives."""
    value = re.sub(r"\.(to_sym|to_s)\b", "", value.strip())
    if "||" in value:
        return [t for part in value.split("||") for t in _target(part, known, depth)]
    if m := re.fullmatch(r":?[\"']?([A-Za-z_]\w*[?!]?)[\"']?", value):
        if value[:1] in ":\"'":
            return [m[1]]
        if depth and m[1] in known:
            return _target(known[m[1]], known, depth - 1)
    return []


def ruby(path: str, text: str) -> Found:
    masked = mask("ruby", text)
    rows, raw = masked.split("\n"), text.split("\n")
    symbols, open_ = [], []
    refs: list[Ref] = []
    known: dict[str, str] = {}
    for i, row in enumerate(rows):
        line = i + 1
        d = _DECL.match(row)
        if d:
            kind = {"def": "method", "class": "struct", "module": "module"}[d[1]]
            one = _ONE_LINE.search(row) or re.match(r"^[ \t]*def\s+\S+(?:\([^)]*\))?\s*=\s*\S", row)
            symbols.append(Symbol(d[2].split("::")[-1], kind, line, line if one else len(rows)))
            if not one:
                open_.append(len(symbols) - 1)
        elif _OPEN.search(row) and not _ONE_LINE.search(row.strip() if row.strip() != "end" else ""):
            open_.append(-1)
        if _END.search(row) and not d and open_:
            k = open_.pop()
            if k >= 0:
                symbols[k] = symbols[k]._replace(end_line=line)
        for m in _DEFINE.finditer(raw[i]):
            symbols.append(Symbol(m[1], "method", line, line))
        if m := _ASSIGN.match(raw[i]):
            known[m[1]] = m[2]
        code = row[d.end() :] if d else row
        sent = False
        for m in _SEND.finditer(raw[i]):
            if masked.split("\n")[i][m.start() : m.start() + 4].strip():
                for t in _target(m[1], known):
                    refs.append(Ref(t, line, None, True))
                    sent = True
        if m := _ALIAS.search(raw[i]):
            refs.append(Ref(m[2], line, None, True))
        taken = set()
        for m in _CALL.finditer(code):
            taken.add(m.start(2))
            if m[2] not in _NOT and not (d and not m[1] and m.start() == 0):
                refs.append(Ref(m[2], line, None, True))
        for m in _DOT.finditer(code):
            if m.start(2) not in taken and not (sent and m[2] in ("send", "public_send")) and m[2] not in _NOT:
                refs.append(Ref(m[2], line, None, True))
        if not d and (m := _BARE.match(code)) and m[1] not in _NOT:
            refs.append(Ref(m[1], line, None, True))
    imports = []
    for m in _REQUIRE.finditer(text):
        module = (join(folder(path), m[2]) if m[1] else m[2]).removesuffix(".rb").replace("/", "::")
        imports.append(Import("glob", module, module))
    return Found(symbols, list(dict.fromkeys(refs)), imports)


ANALYZERS = {"ruby": ruby}
