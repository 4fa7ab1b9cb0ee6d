"""References to edges: import aliases, qualifiers, re-export chains, scored candidates, module fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import expand_relative, file_matches, module_ends, module_keys, module_path, parent
from ..work import cut, spread
from .changed import enclosing

HOPS = 10


def _head(path: Column) -> Column:
    return F.when(path.contains("::"), F.regexp_replace(path, r"::[^:]*$", "")).otherwise(F.lit(""))


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "::"), -1)


def apply_imports(refs: DataFrame, imports: DataFrame) -> DataFrame:
    """Refs with ``target_name``, normalised ``qualifier`` and ``prefix``.

    An unqualified name that its file imports is replaced by the imported path's
    last part, and the rest is the prefix; a qualifier's first part is replaced by
    what the file imports under it, then relative parts are expanded.
    """
    alias = imports.where("entry_type = 'alias'").groupBy("file", "key").agg(F.min("target").alias("target"))
    here = module_path(F.col("file"))
    dotted = F.replace(F.col("qualifier"), F.lit("."), F.lit("::"))
    rows = refs.withColumn("_q", dotted).withColumn("_key", F.when(F.col("qualifier").isNull(), F.col("name")).otherwise(F.element_at(F.split("_q", "::"), 1)))
    a = alias.select("file", F.col("key").alias("_key"), F.col("target").alias("_to"))
    rows = rows.join(a, ["file", "_key"], "left")
    rest = F.regexp_replace("_q", r"^.*?(::|$)", "")
    mapped = F.when(F.col("_to").isNull(), F.col("_q")).otherwise(F.concat("_to", F.when(rest != "", F.concat(F.lit("::"), rest)).otherwise(F.lit(""))))
    prior = _head(F.col("_to"))
    relative = prior.rlike(r"(self|super|crate)::")
    plain = F.col("qualifier").isNull()
    return rows.select(
        *[c for c in refs.columns if c != "qualifier"],
        F.when(~plain, expand_relative(here, mapped)).alias("qualifier"),
        F.when(plain & F.col("_to").isNotNull(), F.when(relative, expand_relative(here, prior)).otherwise(prior)).alias("prefix"),
        F.when(plain & F.col("_to").isNotNull(), _last(F.col("_to"))).otherwise(F.col("name")).alias("target_name"),
    )


def follow_exports(prefixes: DataFrame, imports: DataFrame, hops: int = HOPS) -> DataFrame:
    """Where names lead through re-exports: ``prefix``, ``name`` to ``real_prefix``, ``real_name`` and the globs met.

    ``prefixes``: distinct ``prefix`` and ``name``. A hop goes to the aggregator
    file of the prefix (an index file first, then by path) and its export of the
    name; at most ``hops``, and no prefix twice. Names that don't move any more
    leave the loop.
    """
    files = imports.select("file").distinct().select("file", F.explode(module_keys(F.col("file"))).alias("prefix"))
    first = F.struct(F.when(F.col("file").rlike(r"/index\.(js|ts|tsx)$"), 0).otherwise(1), "file")
    hub = files.groupBy("prefix").agg(F.min_by("file", first).alias("hub"))
    exports = imports.where("entry_type = 'export'").groupBy("file", "key").agg(F.min("target").alias("to"))
    globs = imports.where("entry_type = 'export_glob'").groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("g"))
    none = F.array().cast("array<string>")
    hub, exports, globs = cut(hub), cut(exports), cut(globs)
    cur = cut(prefixes.select(F.col("prefix").alias("p0"), F.col("name").alias("n0"), "prefix", "name", none.alias("seen"), none.alias("globs")))
    done = None
    for _ in range(hops):
        at = cur.where(~F.array_contains("seen", F.col("prefix"))).join(hub, "prefix", "left")
        at = at.join(exports.withColumnsRenamed({"file": "hub", "key": "name"}), ["hub", "name"], "left").join(globs.withColumnRenamed("file", "hub"), "hub", "left")
        stop = cur.where(F.array_contains("seen", F.col("prefix")))
        at = at.withColumn("globs", F.array_distinct(F.concat("globs", F.coalesce("g", none)))).withColumn("seen", F.concat("seen", F.array("prefix")))
        ended = at.where("to IS NULL").select(*cur.columns).unionByName(stop)
        done = ended if done is None else done.unionByName(ended)
        cur = cut(at.where("to IS NOT NULL").withColumn("prefix", _head(F.col("to"))).withColumn("name", _last(F.col("to"))).select(*cur.columns))
        if cur.isEmpty():
            break
    else:
        done = done.unionByName(cur)
    return done.select(F.col("p0").alias("prefix"), F.col("n0").alias("name"), F.col("prefix").alias("real_prefix"), F.col("name").alias("real_name"), "globs")


def _kind_score(kind: Column, language: Column, is_method: Column) -> Column:
    method = F.when(kind == "method", 25).when((kind == "function") & language.isin("ruby", "python"), 20).otherwise(0)
    return F.when(is_method, method).otherwise(F.when(kind == "function", 5).otherwise(0))


def score(file: Column, qualifier: Column, prefixes: Column, cand_file: Column, cand_kind: Column, cand_language: Column, is_method: Column) -> Column:
    """How well a candidate fits a reference; ``prefixes``: imported prefix and globs, of which the best counts."""
    at = F.when(cand_file == file, 30).otherwise(0) + F.when(parent(cand_file) == parent(file), 10).otherwise(0)
    q = F.when(qualifier.isNotNull() & file_matches(cand_file, qualifier), 20).otherwise(0)
    p = F.when(F.exists(prefixes, lambda x: file_matches(cand_file, x)), 15).otherwise(0)
    return at + q + p + _kind_score(cand_kind, cand_language, is_method)


def matching(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``file`` and ``module`` wherever ``file_matches`` holds, by an equi join on the ends of the files' names."""
    ends = files.select("file").distinct().select("file", F.explode(module_ends(F.col("file"))).alias("end"))
    named = modules.where("module <> ''").distinct().withColumn("end", F.replace("module", F.lit("::"), F.lit("/")))
    return ends.join(named, "end").select("file", "module")


#: Keys with at most so many candidates are compared pair by pair.
FEW = 8


def best(refs: DataFrame, cand: DataFrame, few: int = FEW) -> DataFrame:
    """The best candidate of each reference: ``ref_id``, ``dst``, ``score``; of equal scores the earlier line, then the greater id.

    ``refs``: ``ref_id``, ``key``, ``file``, ``qualifier``, ``only`` (candidates
    must match the qualifier), ``prefixes``, ``is_method``. ``cand``: ``key`` and
    ``c_id``, ``c_file``, ``c_kind``, ``c_language``, ``c_line``. A reference may
    have several rows with different keys. A key with many candidates isn't paired
    with all of them: a score is a sum over where a candidate lies and what it is,
    so the best of each place are found once, and a reference looks up its places.
    """
    many = cut(cand.groupBy("key").count().where(F.col("count") > few).select("key"), "many")
    fit = score(F.col("file"), F.col("qualifier"), F.col("prefixes"), F.col("c_file"), F.col("c_kind"), F.col("c_language"), F.col("is_method"))
    allowed = ~F.col("only") | file_matches(F.col("c_file"), F.col("qualifier"))
    crowded = not many.isEmpty()
    rare = cand.join(many, "key", "left_anti") if crowded else cand
    found = refs.join(rare, "key").where(allowed).select("ref_id", F.struct(fit.alias("score"), (-F.col("c_line")).alias("at"), F.col("c_id").alias("id")).alias("b"))
    if crowded:
        found = found.unionByName(_looked_up(refs.join(many, "key", "left_semi"), cand.join(many, "key", "left_semi")))
    return spread(found, "ref_id").groupBy("ref_id").agg(F.max("b").alias("b")).select("ref_id", F.col("b.id").alias("dst"), F.col("b.score").alias("score"))


def _looked_up(refs: DataFrame, cand: DataFrame) -> DataFrame:
    """``ref_id`` and its best candidate ``b`` by place: own file, own folder or anywhere, each with and without the qualifier's and a prefix's files.

    A place gives its candidates what all in it have at least, and one of the places
    gives each candidate its whole score, so the greatest over the places is exact.
    Alike references look up once.
    """
    method = F.coalesce(F.col("is_method"), F.lit(False))
    shape = F.struct("key", "file", "qualifier", F.coalesce("only", F.lit(False)).alias("only"), "prefixes", method.alias("is_method"))
    shaped = cut(refs.select("ref_id", shape.alias("shape")), "shaped")
    none = F.array(F.lit(""))
    asked = shaped.select("shape").distinct()
    q = F.when(F.col("shape.only"), F.array("shape.qualifier")).otherwise(F.array_distinct(F.concat(none, F.array(F.coalesce("shape.qualifier", F.lit(""))))))
    p = F.array_distinct(F.concat(none, F.filter("shape.prefixes", lambda x: x.isNotNull())))
    asked = asked.withColumn("q", F.explode(q)).withColumn("p", F.explode(p))
    files = cand.select(F.col("c_file").alias("file")).distinct()
    used = asked.select("q", "p").distinct()
    tags = matching(files, used.select(F.explode(F.array("q", "p")).alias("module")))
    tags = tags.groupBy("file").agg(F.collect_set("module").alias("m"))
    tags = tags.withColumn("q", F.explode(F.concat(none, "m"))).withColumn("p", F.explode(F.concat(none, "m"))).join(used, ["q", "p"], "left_semi").where("q <> '' OR p <> ''")

    def least(kind: Column) -> Column:
        return F.struct(kind.alias("score"), (-F.col("c_line")).alias("at"), F.col("c_id").alias("id"))

    both = F.explode(F.array(*(F.struct(F.lit(x).alias("is_method"), least(_kind_score(F.col("c_kind"), F.col("c_language"), F.lit(x))).alias("b")) for x in (False, True))))
    each = cand.select("key", F.col("c_file").alias("file"), both.alias("x")).groupBy("key", "file", "x.is_method").agg(F.max("x.b").alias("b"))
    each = cut(each, "each")
    placed = each.select("*", F.lit("").alias("q"), F.lit("").alias("p")).unionByName(each.join(tags.select("file", "q", "p"), "file"))

    def places(file: Column) -> Column:
        named = (("any", F.lit(""), 0), ("folder", parent(file), 10), ("file", file, 40))
        return F.array(*(F.struct(F.lit(place).alias("place"), at.alias("at"), F.lit(more).alias("more")) for place, at, more in named))

    on = ["key", "is_method", "q", "p", "place", "at"]
    table = placed.select("*", F.explode(places(F.col("file"))).alias("x")).groupBy("key", "is_method", "q", "p", "x.place", "x.at").agg(F.max("b").alias("b"))
    asked = asked.select("shape", "shape.key", "shape.is_method", "q", "p", F.explode(places(F.col("shape.file"))).alias("x")).select("*", "x.*").drop("x")
    more = F.col("more") + F.when(F.col("q") != "", 20).otherwise(0) + F.when(F.col("p") != "", 15).otherwise(0)
    got = asked.join(table, on).select("shape", F.struct((F.col("b.score") + more).alias("score"), F.col("b.at").alias("at"), F.col("b.id").alias("id")).alias("b"))
    return shaped.join(spread(got, "shape").groupBy("shape").agg(F.max("b").alias("b")), "shape").select("ref_id", "b")


def resolve(refs: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges (inferred, call_graph) of ``refs``; references outside any symbol, and those with no candidate, give none."""
    named = apply_imports(refs, imports)
    moves = follow_exports(named.where("prefix IS NOT NULL").select("prefix", F.col("target_name").alias("name")).distinct(), imports)
    named = named.join(moves.withColumnRenamed("name", "target_name"), ["prefix", "target_name"], "left")
    none = F.array().cast("array<string>")
    globs = imports.where("entry_type = 'glob'").groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("g"))
    named = cut(
        named.join(globs, "file", "left").select(
            "ref_id",
            "file",
            "line",
            "kind",
            "qualifier",
            "is_method",
            F.coalesce("real_name", "target_name").alias("target"),
            F.coalesce("real_prefix", "prefix").alias("prefix"),
            F.filter(F.array_distinct(F.concat(F.array(F.coalesce("real_prefix", "prefix")), F.coalesce("g", none), F.coalesce("globs", none))), lambda x: x.isNotNull() & (x != "")).alias("prefixes"),
        ),
        "named",
    )
    cand = symbols.where("kind IN ('function', 'method')").select(F.col("id").alias("c_id"), F.col("name").alias("c_name"), F.col("file").alias("c_file"), F.col("kind").alias("c_kind"), F.col("language").alias("c_language"), F.col("start_line").alias("c_line"))
    # candidates of another kind still count for "does any same-name symbol match the qualifier"
    quoted = named.select("target", F.col("qualifier").alias("module")).where("module IS NOT NULL").distinct()
    at = matching(symbols.select("file"), quoted.select("module"))
    met = symbols.select(F.col("name").alias("target"), "file").join(at, "file").join(quoted, ["target", "module"], "left_semi").distinct()
    met = met.select("target", F.col("module").alias("qualifier")).distinct().withColumn("only", F.lit(True))
    asked = named.join(met, ["target", "qualifier"], "left").withColumn("only", F.coalesce("only", F.lit(False)))
    direct = cut(best(asked.withColumnRenamed("target", "key"), cand.withColumn("key", F.col("c_name"))), "direct")
    left = named.join(direct, "ref_id", "left_anti")
    hints = left.withColumn("key", F.explode(F.array_distinct(F.filter(F.concat(F.array("qualifier"), "prefixes"), lambda x: x.isNotNull() & (x != ""))))).withColumn("only", F.lit(False))
    hints = cut(hints, "hints")
    found = direct
    if not hints.isEmpty():
        found = found.unionByName(best(hints, cand.withColumn("key", F.explode(module_keys(F.col("c_file"))))))
    src = enclosing(refs.select("ref_id", "file", "line"), symbols, "ref_id").select("ref_id", F.col("symbol_id").alias("src"))
    out = refs.join(found, "ref_id").join(src, "ref_id")
    return out.select("src", "dst", "kind", "file", "line", F.lit("inferred").alias("certainty"), F.lit("call_graph").alias("provenance"))
