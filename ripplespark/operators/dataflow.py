"""Local data flow of Rust and Ruby, dependence graphs, function summaries and propagation.

Tokens are lexed on the executors; definitions, uses, reaching definitions,
closures and bindings are joins and windows over their tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..extract.text import Lines, close, mask
from .graph import closure

TOKENS = "file string, ord long, kind string, name string, line int, until int"
_WORD = re.compile(r"[A-Za-z_]\w*[?!]?")
_RUST_RESERVED = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Some None Result Ok Err Box".split())
_RUBY_RESERVED = frozenset("alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield puts require require_relative send public_send".split())
_RUST_FN = re.compile(r"\bfn\s+\w+\s*(?:<[^>]*>)?\s*\(")
_RUST_LET = re.compile(r"\blet\s+(?:mut\s+)?([A-Za-z_]\w*)\b[^=;\n]*=(?!=)\s*([^;\n]*)")
_RUST_SET = re.compile(r"^[ \t]*([A-Za-z_]\w*)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=|>)\s*([^;\n]*)", re.M)
_RUST_CONTROL = re.compile(r"\b(if|match|loop|for|while)\b")
_RUBY_DEF = re.compile(r"^[ \t]*def\s+(?:self\.)?\w+[?!=]?\s*(?:\(([^)]*)\)|([^\n;=]*))", re.M)
_RUBY_SET = re.compile(r"^[ \t]*([a-z_]\w*)\s*(?:\|\||&&|[-+*/])?=(?!=|~|>)\s*([^\n]*)", re.M)
_RUBY_OPEN = re.compile(r"^[ \t]*(if|unless|while|until|for|case)\b|=\s*(if|unless|case)\b")
_RUBY_BLOCK = re.compile(r"^[ \t]*(?:def|class|module|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
_ALONE = re.compile(r"([A-Za-z_]\w*)\s*[;\n]?\s*$")


def tokens(path: str, language: str, text: str) -> list[tuple]:
    """Tokens of a file: definitions (``param``, ``def``), ``use``, ``alias`` (name = defined name, with the other as a use), ``ctrl`` ranges.

    Rows: (file, ord, kind, name, line, until); ``ord`` is the byte offset, ``until`` the last line of a control range
    or, for an alias, the line of its definition.
    """
    masked = mask(language, text)
    lines = Lines(text)
    rust = language == "rust"
    out: list[tuple] = []
    hidden: list[tuple[int, int]] = []
    defined: set[tuple[str, int]] = set()

    def add(kind: str, name: str, at: int, until: int = 0) -> None:
        out.append((path, at, kind, name, lines.at(at), until))

    if rust:
        for m in _RUST_FN.finditer(masked):
            end = close(masked, m.end() - 1, "()")
            for p in re.finditer(r"(?:mut\s+)?([A-Za-z_]\w*)\s*:", masked[m.end() : end]):
                add("param", p[1], m.end() + p.start(1))
            brace = re.compile(r"[{;]").search(masked, end)
            hidden.append((m.start(), brace.start() if brace else len(masked)))
        sets = [*_RUST_LET.finditer(masked), *_RUST_SET.finditer(masked)]
    else:
        for m in _RUBY_DEF.finditer(masked):
            group = 1 if m[1] is not None else 2
            for p in _WORD.finditer(m[group] or ""):
                if re.match(r"[a-z_]\w*$", p[0]):
                    add("param", p[0], m.start(group) + p.start())
            hidden.append((m.start(), m.end()))
        sets = list(_RUBY_SET.finditer(masked))
    for m in sets:
        if m[1] in (_RUST_RESERVED if rust else _RUBY_RESERVED) or any(a <= m.start(1) < b for a, b in hidden):
            continue
        if (m[1], lines.at(m.start(1))) in defined:
            continue
        defined.add((m[1], lines.at(m.start(1))))
        add("def", m[1], m.start(1))
        if (alone := _ALONE.match(m[2])) and alone[1] not in (_RUST_RESERVED if rust else _RUBY_RESERVED):
            out.append((path, m.start(2), "alias", alone[1], lines.at(m.start(2)), lines.at(m.start(1))))
            out.append((path, m.start(1), "alias_of", m[1], lines.at(m.start(1)), lines.at(m.start(2))))
    reserved = _RUST_RESERVED if rust else _RUBY_RESERVED
    for m in _WORD.finditer(masked):
        line = lines.at(m.start())
        if m[0] in reserved or any(a <= m.start() < b for a, b in hidden) or (m[0], line) in defined:
            continue
        after = masked[m.end() : m.end() + 2]
        if after.lstrip().startswith("!") and rust or after.startswith("::"):
            continue
        add("use", m[0], m.start())
    if rust:
        for m in _RUST_CONTROL.finditer(masked):
            brace = masked.find("{", m.end())
            if brace >= 0:
                add("ctrl", m[1], m.start(), lines.at(close(masked, brace)))
    else:
        open_: list[tuple[int, bool]] = []
        at = 0
        for row in masked.split("\n"):
            one = re.search(r"\bend\s*$", row) and row.strip() != "end"
            if (m := _RUBY_OPEN.search(row)) and not one:
                open_.append((at + (m.start(1) if m[1] else m.start(2)), True))
            elif _RUBY_BLOCK.search(row) and not one:
                open_.append((at, False))
            if re.match(r"^[ \t]*end\b", row) and open_:
                start, control = open_.pop()
                if control:
                    add("ctrl", "if", start, lines.at(at))
            at += len(row) + 1
    return out


def token_table(files: DataFrame) -> DataFrame:
    """Tokens of the Rust and Ruby files of ``files`` (path, content, language)."""
    names = [c.split()[0] for c in TOKENS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [t for path, text, lang in zip(pdf["path"], pdf["content"], pdf["language"]) for t in tokens(path, lang, text or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("language").isin("rust", "ruby")).select("path", "content", "language").mapInPandas(run, TOKENS)


def _id(kind: str):
    return F.concat_ws(":", "file", F.lit(kind), "name", F.col("line").cast("string"))


def nodes(found: DataFrame) -> DataFrame:
    """Nodes of tokens: id, name, file, line, ord (the first offset)."""
    kind = F.when(F.col("kind") == "use", "use").otherwise("def")
    named = found.where(F.col("kind").isin("param", "def", "use")).select(F.concat_ws(":", "file", kind, "name", F.col("line").cast("string")).alias("id"), "name", "file", "line", "ord")
    ctrl = found.where("kind = 'ctrl'").select(F.concat_ws(":", "file", F.lit("ctrl"), F.col("line").cast("string"), F.col("until").cast("string")).alias("id"), F.lit("ctrl").alias("name"), "file", "line", "ord")
    return named.unionByName(ctrl).groupBy("id", "name", "file", "line").agg(F.min("ord").alias("ord"))


def reaching(found: DataFrame) -> DataFrame:
    """Definitions that reach each use: ``use_id``, ``def_id``.

    The latest definition before the use's line; and of each control range that
    ended before the use and holds that definition, all definitions in it and, if
    it has one only, also the last before it. A Rust use without an earlier
    definition takes a parameter of its own line.
    """
    uses = found.where("kind IN ('use', 'alias')").select("file", "name", "line").distinct()
    defs = found.where("kind IN ('def', 'param')").select("file", "name", F.col("line").alias("d")).distinct()
    pairs = uses.join(defs, ["file", "name"])
    before = pairs.where("d < line").withColumn("latest", F.max("d").over(Window.partitionBy("file", "name", "line")))
    latest = before.where("d = latest").select("file", "name", "line", "d")
    ctrl = found.where("kind = 'ctrl'").select("file", F.col("line").alias("a"), F.col("until").alias("b")).distinct()
    inside = latest.withColumnRenamed("d", "latest").join(ctrl, "file").where("b < line AND latest BETWEEN a AND b")
    branch = inside.join(defs, ["file", "name"]).where("d <= b")
    in_range = branch.where("d >= a").select("file", "name", "line", "a", "b", "d")
    n = in_range.groupBy("file", "name", "line", "a", "b").agg(F.count_distinct("d").alias("n"))
    prior = branch.where("d < a").groupBy("file", "name", "line", "a", "b").agg(F.max("d").alias("d")).join(n.where("n <= 1"), ["file", "name", "line", "a", "b"])
    own = pairs.join(found.where("kind = 'param'").select("file", "name", F.col("line").alias("d")).distinct(), ["file", "name", "d"], "left_semi").where("d = line")
    own = own.join(before.select("file", "name", "line").distinct(), ["file", "name", "line"], "left_anti").where(F.col("file").endswith(".rs")).select("file", "name", "line", "d")
    every = latest.unionByName(in_range.select("file", "name", "line", "d")).unionByName(prior.select("file", "name", "line", "d")).unionByName(own).distinct()
    return every.select(_id("use").alias("use_id"), F.concat_ws(":", "file", F.lit("def"), "name", F.col("d").cast("string")).alias("def_id"), "file", "name", "line", F.col("d").alias("def_line"))


def edges(found: DataFrame) -> DataFrame:
    """Data edges from reaching definitions to uses, from a definition to its aliases, and control edges into ranges."""
    reach = reaching(found)
    real = found.where("kind = 'use'").select("file", "name", "line").distinct()
    data = reach.join(real, ["file", "name", "line"], "left_semi").select(F.col("def_id").alias("src"), F.col("use_id").alias("dst"), F.lit("data").alias("kind"))
    other = found.where("kind = 'alias'").select("file", "name", "line", F.col("until").alias("l2"))
    target = found.where("kind = 'alias_of'").select("file", F.col("name").alias("n2"), F.col("line").alias("l2"))
    aliased = other.join(target, ["file", "l2"]).join(reach.select("file", "name", "line", "def_id"), ["file", "name", "line"])
    alias = aliased.select(F.col("def_id").alias("src"), F.concat_ws(":", "file", F.lit("def"), "n2", F.col("l2").cast("string")).alias("dst"), F.lit("data").alias("kind"))
    ctrl = found.where("kind = 'ctrl'").select("file", F.col("line").alias("a"), F.col("until").alias("b")).distinct()
    n = nodes(found).where("name <> 'ctrl'").select("id", "file", "line")
    control = n.join(ctrl, "file").where("line BETWEEN a AND b").select(F.concat_ws(":", "file", F.lit("ctrl"), F.col("a").cast("string"), F.col("b").cast("string")).alias("src"), F.col("id").alias("dst"), F.lit("control").alias("kind"))
    return data.unionByName(alias).unionByName(control).where("src <> dst").distinct()


def pdg(flow: DataFrame, calls: DataFrame) -> DataFrame:
    """Data flow and every call edge as a data edge."""
    return flow.select("src", "dst", "kind").unionByName(calls.select("src", "dst", F.lit("data").alias("kind"))).distinct()


def summaries(symbols: DataFrame, node: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs of functions (``function_id``, ``input_ord``, ``input_id``) and what each flows to (``impacted_id``).

    Inputs are the definitions of the function's first line or, without any, its
    definitions that no node of the function flows to.
    """
    f = symbols.where("kind IN ('function', 'method')").select(F.col("id").alias("function_id"), F.col("file").alias("f"), "start_line", "end_line")
    inside = node.join(f, (F.col("file") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("function_id", "id", "line", "ord", "start_line")
    ends = inside.select("function_id", "id")
    within = (
        flow.where("kind = 'data'")
        .join(ends.withColumnRenamed("id", "src"), "src")
        .join(ends.select(F.col("function_id").alias("g"), F.col("id").alias("dst")), "dst")
        .where("function_id = g")
        .select("function_id", "src", "dst")
    )
    defs = inside.where(F.col("id").contains(":def:"))
    first = defs.where("line = start_line")
    rest = defs.join(first.select("function_id").distinct(), "function_id", "left_anti").join(within.select("function_id", F.col("dst").alias("id")), ["function_id", "id"], "left_anti")
    both = first.unionByName(rest)
    inputs = both.select("function_id", (F.row_number().over(Window.partitionBy("function_id").orderBy("line", "ord", "id")) - 1).cast("int").alias("input_ord"), F.col("id").alias("input_id"))
    flows = closure(within, inputs.select("function_id", "input_id", F.col("input_id").alias("node")), ["function_id", "input_id"])
    return inputs, inputs.join(flows, ["function_id", "input_id"]).select("function_id", "input_ord", "input_id", F.col("node").alias("impacted_id"))


NEAR = (0, 1, -1, 2, -2, 3, -3)


def call_sites(calls: DataFrame, node: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uses and definitions around each call edge: ``src``, ``dst``, ``file``, ``line``, ``id``, ``nth``.

    Uses are taken from the call's line, then from lines nearer first, until the
    callee's inputs are covered; definitions from the call's line, else from up to two lines around.
    """
    want = inputs.groupBy(F.col("function_id").alias("dst")).agg(F.count("*").alias("want"))
    site = calls.where("kind = 'call'").select("src", "dst", "file", "line").distinct().join(want, "dst", "left").withColumn("want", F.coalesce("want", F.lit(1)))
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(d).alias("delta")) for i, d in enumerate(NEAR))))
    probe = site.withColumn("x", offsets).select("*", "x.o", "x.delta").withColumn("l", F.col("line") + F.col("delta"))
    n = node.select("id", F.col("file").alias("nf"), F.col("line").alias("nl"), "ord")
    hit = probe.join(n, (F.col("file") == F.col("nf")) & (F.col("l") == F.col("nl")))
    key = ["src", "dst", "file", "line"]
    uses = hit.where(F.col("id").contains(":use:"))
    before = F.coalesce(F.count("*").over(Window.partitionBy(*key).orderBy("o").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    callee = F.regexp_extract(F.col("dst"), r":([^:]+):\d+$", 1)
    uses = uses.where(F.regexp_extract(F.col("id"), r":use:(.+):\d+$", 1) != callee).withColumn("b", before).where("b < want")
    uses = uses.withColumn("nth", (F.row_number().over(Window.partitionBy(*key).orderBy("o", "ord", "id")) - 1).cast("int"))
    defs = hit.where(F.col("id").contains(":def:") & (F.abs("delta") <= 2))
    own = F.max(F.col("delta") == 0).over(Window.partitionBy(*key))
    defs = defs.withColumn("own", own).where(~F.col("own") | (F.col("delta") == 0))
    defs = defs.withColumn("nth", (F.row_number().over(Window.partitionBy(*key).orderBy("o", "ord", "id")) - 1).cast("int"))
    return uses.select(*key, "id", "nth"), defs.select(*key, "id", "nth")


def propagate(calls: DataFrame, node: DataFrame, inputs: DataFrame, flows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges through calls: use to callee, callee to definition, and use to definition where the argument's input flows to the callee's end.

    Arguments bind by position if there are as many uses as inputs; a single input
    binds a single use.
    """
    uses, defs = call_sites(calls, node, inputs)
    key = ["src", "dst", "file", "line"]
    into = uses.select(F.col("id").alias("a"), F.col("dst").alias("b"))
    out = defs.select(F.col("dst").alias("a"), F.col("id").alias("b"))
    n_uses, n_inputs = uses.groupBy(*key).agg(F.count("*").alias("nu")), inputs.groupBy(F.col("function_id").alias("dst")).agg(F.count("*").alias("ni"))
    bound = uses.join(n_uses, key).join(n_inputs, "dst").where("nu = ni OR (ni = 1 AND nu = 1)")
    bound = bound.join(inputs.withColumnsRenamed({"function_id": "dst", "input_ord": "nth"}), ["dst", "nth"])
    tail = symbols.select(F.col("id").alias("dst"), F.col("end_line").alias("last"))
    ends = flows.withColumnsRenamed({"function_id": "dst"}).join(node.select(F.col("id").alias("impacted_id"), F.col("line").alias("at")), "impacted_id").join(tail, "dst").where("at >= last - 2").select("dst", "input_id").distinct()
    through = bound.join(ends, ["dst", "input_id"], "left_semi").select(*key, F.col("id").alias("a")).join(defs.select(*key, F.col("id").alias("b")), key).select("a", "b")
    every = into.unionByName(out).unionByName(through).where("a <> b").distinct()
    return every.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("data").alias("kind"))


def bridges(symbols: DataFrame, node: DataFrame) -> DataFrame:
    """A symbol to every node in its lines."""
    s = symbols.select(F.col("id").alias("src"), F.col("file").alias("sf"), "start_line", "end_line")
    return node.join(s, (F.col("file") == F.col("sf")) & F.col("line").between(F.col("start_line"), F.col("end_line"))).select("src", F.col("id").alias("dst"), F.lit("data").alias("kind")).distinct()


def tail_evidence(symbols: DataFrame, flows: DataFrame, node: DataFrame, params: DataFrame) -> DataFrame:
    """How many signature parameters flow to the last two lines of a function, to how many nodes, and their sum up to 255."""
    end = symbols.select(F.col("id").alias("function_id"), "end_line", "start_line")
    at = node.select(F.col("id").alias("impacted_id"), "line")
    p = params.where("kind = 'param'").select(_id("def").alias("input_id")).distinct()
    hit = flows.join(p, "input_id", "left_semi").join(end, "function_id").join(at, "impacted_id").where("line >= end_line - 1 AND line > start_line")
    out = hit.groupBy("function_id").agg(F.count_distinct("input_id").alias("param_flows"), F.count_distinct("impacted_id").alias("tail_nodes"))
    return out.withColumn("semantic_support_rank", F.least(F.col("param_flows") + F.col("tail_nodes"), F.lit(255)).cast("int"))
