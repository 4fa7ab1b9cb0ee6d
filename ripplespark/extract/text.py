"""Masking of comments and strings, lines of offsets, and paths of modules."""

from __future__ import annotations

import bisect
import re

_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?"
_BLOCK, _LINE = r"/\*.*?(?:\*/|\Z)", r"//[^\n]*"
MASKS = {
    "rust": rf'{_BLOCK}|{_LINE}|r(#*)".*?(?:"\1|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\[^\n]{{1,8}}?|[^\'\\\n])\'',
    "go": rf"{_BLOCK}|{_LINE}|`[^`]*(?:`|\Z)|{_DOUBLE}|{_SINGLE}",
    "java": rf'{_BLOCK}|{_LINE}|""".*?(?:"""|\Z)|{_DOUBLE}|{_SINGLE}',
    "javascript": rf"{_BLOCK}|{_LINE}|`(?:\\.|[^`\\])*(?:`|\Z)|{_DOUBLE}|{_SINGLE}",
    "python": rf'#[^\n]*|(?:"""|\'\'\').*?(?:"""|\'\'\'|\Z)|{_DOUBLE}|{_SINGLE}',
    "ruby": rf"^=begin.*?(?:^=end[^\n]*|\Z)|#(?!\{{)[^\n]*|{_DOUBLE}|{_SINGLE}",
}
MASKS["typescript"] = MASKS["tsx"] = MASKS["javascript"]
_MASKS = {k: re.compile(v, re.S | re.M) for k, v in MASKS.items()}
_NOT_BREAK = re.compile(r"[^\n]")


def mask(language: str, text: str) -> str:
    """``text`` with comments and strings as spaces; every other character keeps its place."""
    return _MASKS[language].sub(lambda m: _NOT_BREAK.sub(" ", m[0]), text)


class Lines:
    """Line numbers (from 1) of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.count = len(self.starts)

    def at(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def close(text: str, start: int, pair: str = "{}") -> int:
    """The offset of the bracket that closes the first opening one from ``start``; the end of the text if none does."""
    depth = 0
    for m in re.finditer(f"[{re.escape(pair)}]", text[start:]):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return start + m.start()
    return len(text)


def folder(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


def join(base: str, spec: str) -> str:
    """``spec`` from ``base``, without ``.`` and, where they cancel, ``..``."""
    out: list[str] = []
    for part in f"{base}/{spec}".replace("\\", "/").split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(part)
    return "/".join(out)


def module_of(path: str) -> str:
    """The module path of a file; an entry file stands for its folder."""
    p = path.removeprefix("./")
    if re.search(r"/(mod\.rs|lib\.rs|main\.rs|index\.(js|ts|tsx)|__init__\.py)$", p):
        p = folder(p)
    else:
        p = re.sub(r"\.(rs|rb|js|ts|tsx|py|go|java)$", "", p)
    return p.replace("/", "::")
