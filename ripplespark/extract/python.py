"""Analyzer of Python: the standard library's parser, or line rules where a file doesn't parse."""

from __future__ import annotations

import ast
import re
import warnings

from . import Found, Import, Ref, Symbol
from .text import folder, join, mask

_DECL = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", re.M)
_CALL = re.compile(r"((?:\w+\s*\.\s*)*)(\w+)\s*\(")
_NOT = frozenset("if elif while for return def class print lambda and or not in is assert del except with yield await raise import from".split())
_FROM = re.compile(r"^[ \t]*from\s+(\.*[\w.]*)\s+import\s+(.+)$", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(.+)$", re.M)


def _indent(line: str) -> int:
    return len(line[: len(line) - len(line.lstrip())].expandtabs(4))


def _ends(lines: list[str]) -> list[int]:
    """For each line, the last line before a dedent to its own depth; blank and comment lines don't end a block."""
    out, open_ = [len(lines)] * len(lines), []
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        depth = _indent(line)
        while open_ and depth <= open_[-1][0] and not (bare[0] in ")]}" and depth == open_[-1][0]):
            out[open_.pop()[1]] = i
        open_.append((depth, i))
    return out


def _module(path: str, module: str, level: int) -> str:
    if not level:
        return module.replace(".", "::")
    base = folder(path)
    for _ in range(level - 1):
        base = folder(base)
    return join(base, module.replace(".", "/")).replace("/", "::")


def _text(node: ast.AST) -> str:
    return re.sub(r"\s", "", ast.unparse(node))


def _constant(node: ast.AST, known: dict[str, str], depth: int = 4) -> str | None:
    """A string that a node surely or (an f-string) begins with."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.Name) and depth:
        return known.get(node.id)
    if isinstance(node, ast.JoinedStr) and node.values:
        parts = []
        for v in node.values:
            if isinstance(v, ast.Constant):
                parts.append(str(v.value))
            elif isinstance(v, ast.FormattedValue) and isinstance(v.value, ast.Name) and v.value.id in known:
                parts.append(known[v.value.id])
            else:
                break
        return "".join(parts).rstrip(".") or None
    return None


def python(path: str, text: str) -> Found:
    lines = text.split("\n")
    masked = mask("python", text)
    ends = _ends(masked.split("\n"))
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    symbols, classes = [], []
    line_of = {a: i + 1 for i, a in enumerate(starts)}
    for m in _DECL.finditer(masked):
        line = line_of[m.start()]
        end = ends[line - 1]
        if m[2] == "class":
            classes.append((line, end))
            symbols.append(Symbol(m[3], "struct", line, end))
        else:
            inside = any(a < line <= b for a, b in classes)
            symbols.append(Symbol(m[3], "method" if inside else "function", line, end))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _by_lines(path, text, masked, symbols)
    imports: list[Import] = []
    assigned: dict[str, str] = {}
    nodes = sorted((n for n in ast.walk(tree) if hasattr(n, "lineno")), key=lambda n: (n.lineno, n.col_offset))
    for n in nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                target = a.name.replace(".", "::")
                imports.append(Import("alias", a.asname or a.name.split(".")[0], target if a.asname else target.split("::")[0]))
                imports.append(Import("glob", target, target))
        elif isinstance(n, ast.ImportFrom):
            module = _module(path, n.module or "", n.level)
            for a in n.names:
                if a.name == "*":
                    imports.append(Import("glob", module, module))
                else:
                    imports.append(Import("alias", a.asname or a.name, f"{module}::{a.name}" if module else a.name))
        elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            name, value = n.targets[0].id, n.value
            if (s := _constant(value, assigned)) is not None:
                assigned[name] = s
            elif isinstance(value, ast.Call) and _text(value.func) in ("importlib.import_module", "import_module", "__import__") and value.args:
                if (s := _constant(value.args[0], assigned)) is not None:
                    target = _module(path, s.lstrip("."), len(s) - len(s.lstrip(".")))
                    imports += [Import("alias", name, target), Import("glob", target, target)]
    aliases = {i.key for i in imports if i.entry_type == "alias"}
    refs: dict[Ref, None] = {}

    def add(func: ast.AST, line: int) -> None:
        if isinstance(func, ast.Name):
            refs[Ref(func.id, line, None, False)] = None
        elif isinstance(func, ast.Attribute):
            q = _text(func.value)
            refs[Ref(func.attr, line, q, re.split(r"[.(\[]", q)[0] not in aliases)] = None

    assigned = {}
    for n in nodes:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            if (s := _constant(n.value, assigned)) is not None:
                assigned[n.targets[0].id] = s
        if isinstance(n, ast.Call):
            add(n.func, n.lineno)
            if isinstance(n.func, ast.Name) and n.func.id in ("getattr", "setattr") and len(n.args) >= 2:
                if (s := _constant(n.args[1], assigned)) is not None and s.isidentifier():
                    q = _text(n.args[0])
                    refs[Ref(s, n.lineno, q, q.split(".")[0] not in aliases)] = None
                if n.func.id == "setattr" and len(n.args) == 3 and isinstance(n.args[2], (ast.Name, ast.Attribute)):
                    add(n.args[2], n.lineno)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for d in n.decorator_list:
                if not isinstance(d, ast.Call):
                    add(d, n.lineno)
    return Found(symbols, list(refs), imports)


def _by_lines(path: str, text: str, masked: str, symbols: list[Symbol]) -> Found:
    imports: list[Import] = []
    for m in _FROM.finditer(masked):
        level = len(m[1]) - len(m[1].lstrip("."))
        module = _module(path, m[1].lstrip("."), level)
        for part in m[2].strip("() ").split(","):
            names = part.split()
            if names == ["*"]:
                imports.append(Import("glob", module, module))
            elif names:
                imports.append(Import("alias", names[-1], f"{module}::{names[0]}"))
    for m in _IMPORT.finditer(masked):
        for part in m[1].split(","):
            names = part.split()
            if names:
                target = names[0].replace(".", "::")
                imports += [Import("alias", names[-1].split(".")[0], target), Import("glob", target, target)]
    aliases = {i.key for i in imports if i.entry_type == "alias"}
    refs: dict[Ref, None] = {}
    for i, line in enumerate(masked.split("\n")):
        for m in _CALL.finditer(line):
            if m[2] in _NOT or re.search(r"\b(def|class)\s+$", line[: m.start()]):
                continue
            q = re.sub(r"\s", "", m[1]).removesuffix(".") or None
            refs[Ref(m[2], i + 1, q, q is not None and q.split(".")[0] not in aliases)] = None
    return Found(symbols, list(refs), imports)


ANALYZERS = {"python": python}
