"""Planning which files get local data flow: direct boundaries, their second hop, and admission."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import module_keys
from ..work import cut, spread
from .graph import adjacency


def boundaries(edges: DataFrame, seeds: DataFrame, by: list[str], direction: str) -> DataFrame:
    """Direct neighbours of each seed: ``by``, ``root``, ``via`` and the call's place."""
    adj = adjacency(edges, direction, "file", "line")
    return seeds.join(adj, seeds["node"] == adj["cur"]).where("next <> node").select(*by, F.col("node").alias("root"), F.col("next").alias("via"), F.col("file").alias("call_file"), F.col("line").alias("call_line"))


def completions(edges: DataFrame, seeds: DataFrame, symbols: DataFrame, by: list[str], direction: str) -> DataFrame:
    """Second hops on the same side, without the root, the boundary, and files that a boundary is in."""
    near = boundaries(edges, seeds, by, direction).select(*by, "root", "via").distinct()
    adj = spread(adjacency(edges, direction), "cur", "next").distinct()
    far = near.join(adj, near["via"] == adj["cur"]).where("next <> root AND next <> via").select(*by, "via", F.col("next").alias("id")).distinct()
    direct = near.join(symbols.select(F.col("id").alias("via"), "file"), "via").select(*by, "file").distinct()
    return far.join(symbols, "id").join(direct, [*by, "file"], "left_anti")


# Evidence, lanes and admission

BRIDGE = ("wrap", "wrapper", "adapter", "service")
RETURN = ("leaf", "source", "core", "callee", "target", "final", "inner")
ALIAS = ("alias", "value", "result", "make", "out")
NOISE = ("helper", "noise", "alt", "debug", "tmp")
LANES = {"return": 0, "alias": 1, "require_relative": 2, "companion": 3}
BRIDGES = {"return": "wrapper_return", "alias": "boundary_alias_continuation", "require_relative": "require_relative_chain"}
TIER2_FILES = TIER3_FILES = 2
PER_FAMILY = PER_SIDE = 1


def _hint(name: str, path: str, words: tuple[str, ...]):
    return F.lower(F.concat_ws(" ", name, path)).rlike("|".join(words))


def _evidence(*pairs) -> Column:
    """The sorted names of the evidence that holds."""
    return F.array_sort(F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)), lambda x: x.isNotNull()))


def score(cand: DataFrame) -> DataFrame:
    """Lane, bridge kind, evidence and score fields of candidates.

    ``cand``: ``id``, ``name``, ``file`` of the completion; ``via``, ``via_name``,
    ``via_file`` of the boundary; ``call_line``, ``last_line`` of its side;
    ``param_flows``, ``tail_nodes`` (null without evidence).
    """
    bridge, noise = _hint("via_name", "via_file", BRIDGE), _hint("name", "file", NOISE)
    ret, alias = _hint("name", "file", RETURN), _hint("name", "file", ALIAS)
    last = F.col("call_line") == F.col("last_line")
    flow = F.coalesce(F.col("param_flows") > 0, F.lit(False)) & ~noise
    ret_flow, alias_flow = flow & ~ret & ~alias, flow & alias
    ruby = F.col("file").endswith(".rb") | F.col("via_file").endswith(".rb")
    lane0 = F.when(ruby & alias & ~noise & (flow | ret), "alias").when(ret | ret_flow | (bridge & ~alias & ~noise & last), "return").otherwise("alias")
    in_return = lane0 == "return"
    primary0 = F.when(
        in_return,
        _evidence(("return_flow", ret | ret_flow | (~alias & ~noise)), ("param_to_return_flow", ret_flow), ("assigned_result", bridge | last)),
    ).otherwise(_evidence(("alias_chain", alias), ("param_to_return_flow", alias_flow), ("assigned_result", bridge | ~noise)))
    weak = ruby & ~F.array_contains(primary0, "alias_chain") & ~F.array_contains(primary0, "return_flow")
    lane = F.when(weak, "require_relative").otherwise(lane0)
    primary = F.when(weak, F.array(F.lit("require_relative_edge"))).otherwise(primary0)
    secondary = _evidence(("callsite_position_hint", last), ("name_path_hint", bridge | ret | alias | noise))
    negative = _evidence(("noisy_return_hint", ret & noise))
    support = F.when(ret_flow | alias_flow, F.least(F.coalesce("param_flows", F.lit(0)) + F.coalesce("tail_nodes", F.lit(0)), F.lit(255))).otherwise(F.lit(0)).cast("int")
    out = cand.withColumns({"lane": lane, "primary_evidence": primary, "secondary_evidence": secondary, "negative_evidence": negative, "semantic_support_rank": support})
    out = out.withColumns(
        {
            "bridge_kind": F.coalesce(*(F.when(F.col("lane") == k, v) for k, v in BRIDGES.items())),
            "source_rank": F.when(F.col("lane") == "require_relative", 1).otherwise(0),
            "lane_rank": F.coalesce(*(F.when(F.col("lane") == k, v) for k, v in LANES.items())),
            "primary_evidence_count": F.size("primary_evidence"),
            "secondary_evidence_count": F.size("secondary_evidence"),
            "negative_evidence_count": F.size("negative_evidence"),
            "call_position_rank": F.col("call_line"),
            "lexical_tiebreak": F.col("id"),
        }
    )
    ready = F.array_contains("primary_evidence", "alias_chain") | F.array_contains("primary_evidence", "return_flow") | (F.col("semantic_support_rank") > 0)
    lexical = ~ready & F.forall("primary_evidence", lambda x: x.isin("assigned_result", "require_relative_edge")) & (F.size("secondary_evidence") > 0)
    noisy = F.lower("file").rlike("|".join(NOISE)) | (F.size("negative_evidence") > 0)
    return out.withColumns({"ready": ready, "lexical": lexical, "noisy": noisy})


def suppress(cand: DataFrame, side: list[str]) -> DataFrame:
    """Where a side has a ready candidate, its noisy lexical and its weak require candidates are marked as pruned."""
    some = F.max("ready").over(Window.partitionBy(*side))
    weak = (F.col("lexical") & F.col("noisy")) | ((F.col("lane") == "require_relative") & ~F.col("ready"))
    return cand.withColumn("prune_reason", F.when(some & weak, F.lit("suppressed_before_admit")))


def representatives(cand: DataFrame, seed: str = "seed_id", tier: int = 2) -> DataFrame:
    """Family, bucket and the keys by which duplicates and budgets are told."""
    required = F.array_contains("primary_evidence", "require_relative_edge")
    nested = F.lit(tier == 3) & (F.col("lane") == "alias") & (F.col("semantic_support_rank") > 0)
    family = F.when(nested, "nested").when(F.col("lane") == "return", "return").when(F.col("lane") == "require_relative", "mixed").when((F.col("lane") == "alias") & required, "mixed").otherwise("alias_result")
    anchor = F.col("via") if tier == 3 else F.col("id")
    out = cand.withColumn("family", family).withColumn("anchor", anchor).withColumn("closure_key", F.coalesce("id", "file"))
    out = out.withColumn("duplicate_key", F.concat_ws("|", seed, "via", "family", "closure_key", "anchor"))
    return out.withColumn("budget_key", F.concat_ws("|", seed, "via", "family", "closure_key"))


SCORE = ("source_rank", "lane_rank", "primary_evidence_count", "negative_evidence_count", "semantic_support_rank", "secondary_evidence_count", "call_position_rank", "lexical_tiebreak")
UP = (True, True, False, True, False, False, False, True)


def _preempts(a: dict, b: dict) -> bool:
    """An alias closer with evidence goes before a return candidate that has none but names and positions."""
    has = set(a["primary_evidence"])
    alias = a["lane"] == "alias" and "alias_chain" in has
    stitch = alias and "param_to_return_flow" in has and a["semantic_support_rank"] > 0
    hinted = alias and a["file"].endswith(".rb") and "assigned_result" in has and not a["noisy"]
    plain = b["lane"] == "return" and "param_to_return_flow" not in b["primary_evidence"] and b["semantic_support_rank"] == 0 and not b["noisy"]
    return (stitch or hinted) and plain


def compare(a: dict, b: dict) -> int:
    """Candidates' order; the pre-emption rule makes it intransitive in general, so it is applied pair by pair."""
    if _preempts(a, b):
        return -1
    if _preempts(b, a):
        return 1
    for name, up in zip(SCORE, UP):
        if a[name] != b[name]:
            return -1 if (a[name] < b[name]) == up else 1
    x, y = (a["via_file"], a["via"], a["file"], a["id"]), (b["via_file"], b["via"], b["file"], b["id"])
    return -1 if x < y else int(x > y)


ADMITTED = "id string, via string, file string, lane string, bridge_kind string, family string, tier int, admitted boolean, prune_reason string"


def admit(cand: DataFrame, seed: str = "seed_id", tier: int = 2, files: int = TIER2_FILES) -> DataFrame:
    """Which candidates of each seed are taken, and why the others aren't.

    Candidates of a seed number tens: each boundary side keeps its best, then
    duplicates, files and families are held to their budgets in order.
    """
    columns = ADMITTED.split(", ")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.to_dict("records"), key=functools.cmp_to_key(compare))
        taken_paths: list[str] = []
        by_path: set[tuple] = set()
        sides: dict[str, int] = {}
        keys: set[str] = set()
        families: dict[str, int] = {}
        supported: set[tuple] = set()
        out = []
        for r in rows:
            why = r["prune_reason"]
            lane = (r["via"], r["lane"])
            if r["file"].endswith(".rs"):
                if r["semantic_support_rank"] > 0:
                    supported.add(lane)
                elif lane in supported:  # a sibling with data-flow support goes before it
                    why = why or "suppressed_before_admit"
            if not why:
                if (r["via"], r["file"]) in by_path:
                    why = "weaker_same_path_duplicate"
                elif r["duplicate_key"] in keys:
                    why = "weaker_same_family_sibling"
                elif sides.get(r["via"], 0) >= PER_SIDE:
                    why = "ranked_out"
                elif r["file"] not in taken_paths and len(taken_paths) >= files:
                    why = "bridge_budget_exhausted"
                elif r["file"] not in taken_paths and families.get(r["family"], 0) >= PER_FAMILY:
                    why = "family_budget_exhausted"
            by_path.add((r["via"], r["file"]))
            keys.add(r["duplicate_key"])
            if not why:
                sides[r["via"]] = sides.get(r["via"], 0) + 1
                if r["file"] not in taken_paths:
                    taken_paths.append(r["file"])
                    families[r["family"]] = families.get(r["family"], 0) + 1
            out.append((r[seed], r["id"], r["via"], r["file"], r["lane"], r["bridge_kind"], r["family"], tier, not why, why or None))
        return pd.DataFrame(out, columns=[seed, *(c.split()[0] for c in columns)])

    return cand.groupBy(seed).applyInPandas(plan, f"{seed} string, {ADMITTED}")


def plan_slice(edges: DataFrame, seeds: DataFrame, symbols: DataFrame, direction: str = "callers", evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files that get local data flow (``seed_id``, ``path``, ``tier``, ``reason``, ``via``, scopes) and pruned candidates.

    Tier 0 is the seeds' own files, tier 1 direct boundaries, tier 2 their second hop, tier 3 one hop on
    from an admitted one, in Rust and Ruby and along the same kind of bridge.
    """
    at = symbols.select("id", "name", "file")
    root = seeds.join(at, seeds["node"] == at["id"]).select("seed_id", F.col("file").alias("path"), F.lit(0).alias("tier"), F.lit("seed_file").alias("reason"), F.lit(None).cast("string").alias("via"))
    near = boundaries(edges, seeds, ["seed_id"], direction)
    near = near.join(at.withColumnsRenamed({"id": "via", "name": "via_name", "file": "via_file"}), "via")
    own = root.select("seed_id", F.col("path").alias("via_file"))
    direct = near.join(own, ["seed_id", "via_file"], "left_anti").select("seed_id", F.col("via_file").alias("path"), F.lit(1).alias("tier"), F.lit(f"direct_{direction.removesuffix('s')}").alias("reason"), "via").distinct()

    def hop(front: DataFrame, tier: int, limit: int) -> DataFrame:
        adj = adjacency(edges, direction, "line").withColumnRenamed("line", "call_line")
        far = front.join(adj, front["via"] == adj["cur"]).where("next <> root AND next <> via").select("seed_id", "via", "via_name", "via_file", F.col("next").alias("id"), "call_line", *(["want"] if "want" in front.columns else []))
        far = far.join(at, "id").groupBy(*[c for c in far.columns if c != "call_line"], "name", "file").agg(F.max("call_line").alias("call_line"))
        known = direct.select("seed_id", F.col("path").alias("file")).unionByName(root.select("seed_id", F.col("path").alias("file"))).distinct()
        far = far.join(known, ["seed_id", "file"], "left_anti").withColumn("last_line", F.max("call_line").over(Window.partitionBy("seed_id", "via")))
        if evidence is not None:
            far = far.join(evidence.select(F.col("function_id").alias("id"), "param_flows", "tail_nodes"), "id", "left")
        else:
            far = far.withColumns({"param_flows": F.lit(None).cast("long"), "tail_nodes": F.lit(None).cast("long")})
        scored = score(far)
        if "want" in scored.columns:
            scored = scored.where("bridge_kind = want").drop("want")
        return cut(admit(representatives(suppress(scored, ["seed_id", "via"]), tier=tier), tier=tier, files=limit))

    two = hop(near.select("seed_id", "root", "via", "via_name", "via_file").distinct(), 2, TIER2_FILES)
    anchors = two.where("admitted").where(F.col("file").rlike(r"\.(rs|rb)$")).join(seeds.select("seed_id", F.col("node").alias("root")), "seed_id")
    anchors = anchors.join(at.withColumnsRenamed({"id": "i", "name": "via_name", "file": "via_file"}), F.col("id") == F.col("i"))
    three = hop(anchors.select("seed_id", "root", F.col("id").alias("via"), "via_name", "via_file", F.col("bridge_kind").alias("want")).distinct(), 3, TIER3_FILES)
    both = two.unionByName(three)
    picked = both.where("admitted").select("seed_id", F.col("file").alias("path"), "tier", F.when(F.col("tier") == 2, "bridge_completion_file").otherwise("bridge_continuation_file").alias("reason"), "via")
    chosen = root.unionByName(direct).unionByName(picked)
    chosen = chosen.withColumns({"cache_update": F.lit(True), "local_dfg": F.col("path").rlike(r"\.(rs|rb)$"), "explanation": F.lit(True)})
    return chosen, both.where("NOT admitted").select("seed_id", F.col("file").alias("path"), "tier", "id", "via", "lane", "bridge_kind", "family", "prune_reason")


def ruby_fallback(near: DataFrame, imports: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates that a Ruby boundary file requires and calls by name though no edge leads there.

    ``near``: ``seed_id``, ``via``, ``via_file``. A required file's method counts if the boundary file has a reference
    of exactly that name (inferred), such as a literal ``send``. Rows: seed_id, via, id, file, certainty.
    """
    required = imports.where("entry_type = 'glob'").where(F.col("file").endswith(".rb")).select(F.col("file").alias("via_file"), F.col("target").alias("module"))
    named = refs.where(F.col("file").endswith(".rb")).select(F.col("file").alias("via_file"), "name").distinct()
    methods = symbols.where("language = 'ruby' AND kind = 'method'").select("id", "name", "file", F.explode(module_keys(F.col("file"))).alias("module"))
    found = near.where(F.col("via_file").endswith(".rb")).select("seed_id", "via", "via_file").distinct().join(required, "via_file").join(named, "via_file").join(methods, ["module", "name"])
    return found.where("file <> via_file").select("seed_id", "via", "id", "file", F.lit("inferred").alias("certainty")).distinct()
