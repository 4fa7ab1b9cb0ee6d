"""Analyzers of languages with braces: Rust, Go, Java, JavaScript, TypeScript and TSX."""

from __future__ import annotations

import re

from . import Found, Import, Ref, Symbol
from .text import Lines, close, folder, join, mask, module_of

NAME = r"[A-Za-z_$][\w$]*"


def _body(masked: str, at: int) -> int:
    """The end of a declaration from ``at``: its block's closing brace, or a semicolon that comes first."""
    brace, semicolon = masked.find("{", at), masked.find(";", at)
    if brace < 0 or 0 <= semicolon < brace:
        return semicolon if semicolon >= 0 else len(masked) - 1
    return close(masked, brace)


def _inside(offset: int, spans: list[tuple[int, int]]) -> bool:
    return any(a < offset < b for a, b in spans)


# Rust

_RUST_DECL = re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+|extern\s+(?:\"[^\"]*\"\s+|\s*))*(fn|struct|enum|trait)\s+([A-Za-z_]\w*)", re.M)
_RUST_IMPL = re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b[^;{]*\{", re.M)
_RUST_CALL = re.compile(r"((?:[A-Za-z_]\w*\s*::\s*)*)([A-Za-z_]\w*)\s*(?:::\s*<[^;(){}]*>\s*)?\(")
_RUST_MACRO = re.compile(r"[A-Za-z_]\w*!\s*[(\[{]")
_RUST_NOT = frozenset("if while for match loop return fn in as let else move impl where unsafe pub use mod struct enum trait type const static ref mut dyn box break continue".split())
_RUST_USE = re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;\n]+);", re.M)
_RUST_MOD = re.compile(r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+(\w+)\s*;", re.M)


def _use_paths(text: str) -> list[tuple[str, str | None]]:
    """Paths of a use tree with their alias; a star is a path that ends with ``*``."""
    text = text.strip()
    if "{" not in text:
        m = re.fullmatch(r"(.*?)\s+as\s+(\w+)", text)
        return [(m[1].strip(), m[2])] if m else [(text, None)] if text else []
    at = text.index("{")
    head, inner, out, depth, last = text[:at].strip(), text[at + 1 : close(text, at)], [], 0, 0
    for i, c in enumerate(inner + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            out += _use_paths(inner[last:i])
            last = i + 1
    return [((head + p).removesuffix("::self") if p != "self" else head.removesuffix("::"), a) for p, a in out]


def rust(path: str, text: str) -> Found:
    masked = mask("rust", text)
    lines = Lines(text)
    impls = [(m.start(), close(masked, m.end() - 1)) for m in _RUST_IMPL.finditer(masked)]
    symbols = []
    for m in _RUST_DECL.finditer(masked):
        inner = "method" if _inside(m.start(1), impls) else "function"
        kind = inner if m[1] == "fn" else m[1]
        symbols.append(Symbol(m[2], kind, lines.at(m.start() + len(m[0]) - len(m[0].lstrip())), lines.at(_body(masked, m.end()))))
    calls = masked
    for m in _RUST_MACRO.finditer(masked):  # a macro's tokens are no calls
        pair = {"(": "()", "[": "[]", "{": "{}"}[m[0][-1]]
        end = close(masked, m.end() - 1, pair)
        calls = calls[: m.start()] + re.sub(r"[^\n]", " ", calls[m.start() : end + 1]) + calls[end + 1 :]
    refs = []
    for m in _RUST_CALL.finditer(calls):
        before = calls[: m.start()].rstrip()
        if m[2] in _RUST_NOT or re.search(r"\bfn$", before):
            continue
        qualifier = re.sub(r"\s", "", m[1]).removesuffix("::") or None
        method = before.endswith(".") and not before.endswith("..")
        refs.append(Ref(m[2], lines.at(m.start(2)), None if method else qualifier, method))
    imports = []
    for m in _RUST_USE.finditer(masked):
        for p, alias in _use_paths(m[1]):
            if p.endswith("::*"):
                imports.append(Import("glob", p[:-3], p[:-3]))
            else:
                imports.append(Import("alias", alias or p.split("::")[-1], p))
    here = module_of(path)
    imports += [Import("alias", m[1], f"{here}::{m[1]}" if here else m[1]) for m in _RUST_MOD.finditer(masked)]
    return Found(symbols, refs, imports)


# Go

_GO_FUNC = re.compile(r"^func\s+(\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(", re.M)
_GO_TYPE = re.compile(r"^type\s+([A-Za-z_]\w*)(?:\[[^\]]*\])?\s+(struct|interface)\b", re.M)
_GO_CALL = re.compile(r"((?:[A-Za-z_]\w*\s*\.\s*)*)([A-Za-z_]\w*)\s*(?:\[[\w\s,.*]*\])?\(")
_GO_NOT = frozenset("import if for switch select return func go defer range else case make new len cap append copy delete close panic recover print println complex real imag var type map chan struct interface".split())
_GO_IMPORT = re.compile(r'^\s*import\s+(?:\((.*?)\)|([^\n]*))', re.M | re.S)
_GO_SPEC = re.compile(r'([\w.]+)?\s*"([^"]+)"')


def go(path: str, text: str) -> Found:
    masked = mask("go", text)
    lines = Lines(text)
    symbols = [Symbol(m[2], "method" if m[1] else "function", lines.at(m.start()), lines.at(_body(masked, m.end()))) for m in _GO_FUNC.finditer(masked)]
    symbols += [Symbol(m[1], "struct" if m[2] == "struct" else "trait", lines.at(m.start()), lines.at(_body(masked, m.end()))) for m in _GO_TYPE.finditer(masked)]
    imports = []
    for m in _GO_IMPORT.finditer(text):
        for alias, spec in _GO_SPEC.findall(m[1] or m[2] or ""):
            target = spec.replace("/", "::")
            if alias == ".":
                imports.append(Import("glob", target, target))
            elif alias != "_":
                imports.append(Import("alias", alias or spec.split("/")[-1], target))
    known = {i.key for i in imports if i.entry_type == "alias"}
    refs, seen = [], set()
    for m in _GO_CALL.finditer(masked):
        line = lines.at(m.start(2))
        start = lines.starts[line - 1]
        if masked.startswith("func ", start) and "{" not in masked[start : m.start()]:
            continue
        qualifier = re.sub(r"\s", "", m[1]).removesuffix(".") or None
        if qualifier is None and (m[2] in _GO_NOT or masked[: m.start()].rstrip().endswith(".")):
            continue
        ref = Ref(m[2], line, qualifier, qualifier is not None and not ("." not in qualifier and qualifier in known))
        if ref not in seen:
            seen.add(ref)
            refs.append(ref)
    return Found(symbols, refs, imports)


# Java

_JAVA_TYPE = re.compile(r"^[ \t]*(?:(?:public|protected|private|abstract|static|final|sealed|non-sealed|strictfp)\s+)*(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)", re.M)
_JAVA_METHOD = re.compile(
    r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*((?:(?:public|protected|private|abstract|static|final|synchronized|native|default|strictfp)\s+)*)(?:<[^>{};]*>\s*)?([\w$.<>\[\],? ]+?\s+)?([A-Za-z_$][\w$]*)\s*\([^(){};]*\)\s*(?:throws\s+[\w$.,\s]+)?\{",
    re.M,
)
_JAVA_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*\s*(?:\(\s*\)\s*)?\.\s*)*)([A-Za-z_$][\w$]*)\s*\(")
_JAVA_REF = re.compile(r"([A-Za-z_$][\w$.]*)\s*::\s*([A-Za-z_$][\w$]*)")
_JAVA_NOT = frozenset("if for while switch catch return new throw try do else synchronized assert instanceof super this case finally".split())
_JAVA_IMPORT = re.compile(r"^[ \t]*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", re.M)


def java(path: str, text: str) -> Found:
    masked = mask("java", text)
    lines = Lines(text)
    symbols, types, seen = [], [], set()

    def add(s: Symbol) -> None:
        if (s.name, s.kind, s.start_line) not in seen:
            seen.add((s.name, s.kind, s.start_line))
            symbols.append(s)

    for m in _JAVA_TYPE.finditer(masked):
        brace = masked.find("{", m.end())
        end = close(masked, brace) if brace >= 0 else len(masked)
        types.append((m[2], brace, end))
        add(Symbol(m[2], {"class": "struct", "record": "struct", "interface": "trait", "enum": "enum"}[m[1]], lines.at(m.start(1)), lines.at(end)))
    names = {t[0] for t in types}
    declared: dict[str, list[int]] = {}
    spots = set()
    for m in _JAVA_METHOD.finditer(masked):
        kind = (m[2] or "").strip()
        if m[3] in _JAVA_NOT or kind in ("new", "return", "else", "throw") or not kind and m[3] not in names:
            continue
        spots.add(m.start(3))
        declared.setdefault(m[3], []).append(m.start(3))
        add(Symbol(m[3], "method", lines.at(m.start(3)), lines.at(close(masked, m.end() - 1))))
    imports = []
    for m in _JAVA_IMPORT.finditer(masked):
        target = m[2].replace(".", "::")
        imports.append(Import("glob", target, target) if m[3] else Import("alias", m[2].split(".")[-1], target))
    known = {i.key for i in imports if i.entry_type == "alias"}
    refs: list[Ref] = []

    def ref(r: Ref) -> None:
        if r not in refs[-40:]:
            refs.append(r)

    for m in _JAVA_CALL.finditer(masked):
        if m.start(2) in spots:
            continue
        line = lines.at(m.start(2))
        qualifier = re.sub(r"\s|\(\)", "", m[1]).removesuffix(".") or None
        if qualifier:
            first = qualifier.split(".")[0]
            ref(Ref(m[2], line, qualifier, first in ("this", "super") or first not in known and not first[:1].isupper()))
            continue
        before = masked[: m.start(2)].rstrip()
        if m[2] in _JAVA_NOT or before.endswith(".") or m[2] in names or re.search(r"\bnew$|@$", before):
            continue
        ref(Ref(m[2], line, None, False))
        around = [t for t in types if t[1] < m.start(2) < t[2]]
        if around:  # a bare call of a method of the nearest class
            _, a, b = min(around, key=lambda t: t[2] - t[1])
            if any(a < at < b for at in declared.get(m[2], [])):
                ref(Ref(m[2], line, "this", True))
    for m in _JAVA_REF.finditer(masked):
        first = m[1].split(".")[0]
        ref(Ref(m[2], lines.at(m.start(2)), m[1], first in ("this", "super") or first not in known and not first[:1].isupper()))
    return Found(symbols, refs, imports)


# JavaScript, TypeScript, TSX

_JS_FUNCTION = re.compile(rf"\b(?:async\s+)?function\s*\*?\s*({NAME})\s*(?:<[^>(]*>)?\(")
_JS_CLASS = re.compile(rf"\b(?:abstract\s+)?class\s+({NAME})[^{{;]*\{{")
_JS_ARROW = re.compile(rf"\b(?:const|let|var)\s+({NAME})\s*(?::[^=;]+?)?=\s*(?:async\s+)?(?:function\b|(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{{]+?)?=>|{NAME}\s*=>)")
_JS_EXPORTS = re.compile(rf"\b(?:module\.)?exports\.({NAME})\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|{NAME}\s*=>)")
_JS_DEFAULT = re.compile(r"\bmodule\.exports\s*=\s*(?:async\s+)?(function\b|\{)")
_JS_ENTRY = re.compile(rf"(?:^|[{{,])\s*({NAME})\s*(?::\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|{NAME}\s*=>)|\([^()]*\)\s*\{{)", re.M)
_JS_MEMBER = re.compile(
    rf"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|get|set)\s+)*\*?\s*#?({NAME})\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{", re.M
)
_JS_FIELD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*#?({NAME})\s*(?::[^=;]+?)?=\s*(?:async\s+)?(?:\([^()]*\)\s*(?::[^=;{{]+?)?=>|{NAME}\s*=>|function\b)", re.M)
_TS_INTERFACE = re.compile(rf"\binterface\s+({NAME})[^{{;]*\{{")
_TS_ENUM = re.compile(rf"\b(?:const\s+)?enum\s+({NAME})\s*\{{")
_TS_SIGNATURE = re.compile(rf"^[ \t]*({NAME})\??\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*:[^;{{}}]+;?", re.M)
_JS_CALL = re.compile(rf"((?:{NAME}(?:\s*\(\s*\))?\s*\??\.\s*)*)({NAME})\s*(?:\?\.)?(?:<[\w\s,\[\]|]*>)?\(")
_JS_NOT = frozenset("async if for while switch catch return function typeof new await delete void do else case throw in of instanceof import super constructor yield with".split())
_SPEC = r"""['"]([^'"\n]+)['"]"""
_JS_IMPORT = re.compile(rf"^[ \t]*import\s+(?:type\s+)?([^'\";]*?)\s*from\s*{_SPEC}", re.M)
_JS_REQUIRE = re.compile(rf"\b(?:const|let|var)\s+({NAME}|\{{[^}}]*\}})\s*=\s*require\(\s*{_SPEC}\s*\)(?:\.({NAME}))?")
_JS_REEXPORT = re.compile(rf"^[ \t]*export\s+(?:type\s+)?(\*(?:\s+as\s+({NAME}))?|\{{[^}}]*\}})\s*from\s*{_SPEC}", re.M)


def _js_module(path: str, spec: str) -> str:
    full = join(folder(path), spec) if spec.startswith(".") else spec
    return re.sub(r"\.(js|ts|tsx|jsx|mjs|cjs)$", "", full).replace("/", "::")


def _pairs(text: str, word: str) -> list[tuple[str, str]]:
    """(outer name, inner name) of a brace list; ``word`` is between inner and outer."""
    out = []
    for part in text.strip("{} \n\t").split(","):
        names = [x.strip() for x in re.split(rf"\s*{word}\s*", part.strip().removeprefix("type ").split("=")[0]) if x.strip()]
        if names:
            out.append((names[-1], names[0]))
    return out


def script(language: str):
    typed = language != "javascript"

    def run(path: str, text: str) -> Found:
        masked = mask(language, text)
        lines = Lines(text)
        symbols: dict[tuple, Symbol] = {}

        def add(name: str, kind: str, at: int, end: int) -> None:
            s = Symbol(name, kind, lines.at(at), lines.at(end))
            symbols.setdefault((name, s.start_line), s)

        spots: set[int] = set()

        def value_end(at: int) -> int:
            """The end of a function or arrow value: its block, or its statement."""
            arrow = masked.find("=>", at)
            brace = masked.find("{", at)
            if arrow >= 0 and (brace < 0 or arrow < brace):
                rest = re.match(r"\s*", masked[arrow + 2 :])[0]
                if masked[arrow + 2 + len(rest) : arrow + 3 + len(rest)] != "{":
                    stop = re.search(r";|\n\s*\n|\n(?=\S)|\Z", masked[arrow:])
                    return arrow + stop.start()
            return close(masked, brace) if brace >= 0 else len(masked) - 1

        classes = []
        for m in _JS_CLASS.finditer(masked):
            end = close(masked, m.end() - 1)
            classes.append((m.end() - 1, end))
            add(m[1], "struct", m.start(), end)
        if typed:
            for m in _TS_INTERFACE.finditer(masked):
                end = close(masked, m.end() - 1)
                add(m[1], "trait", m.start(), end)
                for s in _TS_SIGNATURE.finditer(masked, m.end(), end):
                    spots.add(s.start(1))
                    add(s[1], "method", s.start(1), s.end() - 1)
            for m in _TS_ENUM.finditer(masked):
                add(m[1], "enum", m.start(), close(masked, m.end() - 1))
        for m in _JS_FUNCTION.finditer(masked):
            spots.add(m.start(1))
            after = close(masked, m.end() - 1, "()")
            add(m[1], "function", m.start(), _body(masked, after))
        for a, b in classes:
            for rule in (_JS_MEMBER, _JS_FIELD):
                for m in rule.finditer(masked, a + 1, b):
                    if m[1] in _JS_NOT and m[1] != "constructor" or masked[a : m.start(1)].count("{") - masked[a : m.start(1)].count("}") != 1:
                        continue
                    spots.add(m.start(1))
                    add(m[1], "method", m.start(1), close(masked, m.end() - 1) if rule is _JS_MEMBER else value_end(m.start(1)))
        for rule in (_JS_ARROW, _JS_EXPORTS):
            for m in rule.finditer(masked):
                add(m[1], "function", m.start(), value_end(m.start(1)))
        for m in _JS_DEFAULT.finditer(masked):
            end = close(masked, masked.find("{", m.start(1)))
            if m[1] == "function":
                add("default", "function", m.start(), end)
            else:
                for s in _JS_ENTRY.finditer(masked, m.end() - 1, end):
                    spots.add(s.start(1))
                    add(s[1], "function", s.start(1), end)
        refs = []
        for m in _JS_CALL.finditer(masked):
            if m.start(2) in spots:
                continue
            qualifier = re.sub(r"\s|\(\)|\?", "", m[1]).removesuffix(".") or None
            before = masked[: m.start()].rstrip()
            if qualifier is None and (m[2] in _JS_NOT and m[2] != "constructor" or m[2] == "require" or re.search(r"\bfunction\s*\*?$|\bnew$", before)):
                continue
            chained = qualifier is None and before.endswith(".")
            refs.append(Ref(m[2], lines.at(m.start(2)), qualifier, qualifier is not None or chained))
        imports: list[Import] = []

        def globs(module: str) -> None:
            imports.append(Import("glob", module, module))
            imports.append(Import("glob", f"{module}/index", f"{module}::index"))

        for m in _JS_IMPORT.finditer(text):
            module, what = _js_module(path, m[2]), m[1]
            globs(module)
            if s := re.search(rf"\*\s+as\s+({NAME})", what):
                imports.append(Import("alias", s[1], module))
            if s := re.match(rf"({NAME})", what.strip()):
                imports.append(Import("alias", s[1], f"{module}::default"))
            if s := re.search(r"\{([^}]*)\}", what):
                imports += [Import("alias", a, f"{module}::{b}") for a, b in _pairs(s[1], r"\bas\b")]
        for m in _JS_REQUIRE.finditer(text):
            module = _js_module(path, m[2])
            globs(module)
            if m[1].startswith("{"):
                imports += [Import("alias", a, f"{module}::{b}") for a, b in _pairs(m[1], ":")]
            else:
                imports.append(Import("alias", m[1], f"{module}::{m[3]}" if m[3] else module))
        for m in _JS_REEXPORT.finditer(text):
            module = _js_module(path, m[3])
            if m[1].startswith("*") and not m[2]:
                imports.append(Import("export_glob", module, module))
            elif m[2]:
                imports.append(Import("export", m[2], module))
            else:
                imports += [Import("export", a, f"{module}::{b}") for a, b in _pairs(m[1], r"\bas\b")]
        return Found(list(symbols.values()), refs, imports)

    return run


ANALYZERS = {"rust": rust, "go": go, "java": java, "javascript": script("javascript"), "typescript": script("typescript"), "tsx": script("tsx")}
