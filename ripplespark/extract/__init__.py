"""Symbols, references and imports of source files, by language.

An analyzer is a function of (path, text) to three lists of tuples. Analyzers are
kept in a registry, so others can be added; see :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple


class Symbol(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


class Ref(NamedTuple):
    name: str
    line: int
    qualifier: str | None
    is_method: bool


class Import(NamedTuple):
    entry_type: str
    key: str
    target: str


class Found(NamedTuple):
    symbols: list[Symbol]
    refs: list[Ref]
    imports: list[Import]


Analyzer = Callable[[str, str], Found]
_analyzers: dict[str, Analyzer] = {}


def register(language: str, analyzer: Analyzer) -> None:
    """Use ``analyzer`` for a language from now on (in this process)."""
    _analyzers[language] = analyzer


def analyze(language: str, path: str, text: str) -> Found:
    """What the language's analyzer finds; nothing for an unknown language."""
    if not _analyzers:
        from . import curly, python, ruby

        for module in (curly, python, ruby):
            for name, f in module.ANALYZERS.items():
                _analyzers.setdefault(name, f)
    f = _analyzers.get(language)
    return f(path, text) if f else Found([], [], [])
