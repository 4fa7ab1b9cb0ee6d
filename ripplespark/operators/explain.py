"""Explanations: slice context of witnesses, and why a file was chosen over another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_better


def slice_context(witnesses: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected files on each witness path, in the order in which the path meets them, with the hops that do.

    ``witnesses``: ``seed_id``, ``symbol_id``, ``path``; ``selected``: ``seed_id``, ``path`` (file), ``tier``, ``reason``.
    Node files are read from symbol ids (second to last-but-three parts).
    """

    def file_of(node: Column) -> Column:
        parts = F.split(node, ":")
        return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 4, F.lit(0))), ":"))

    hops = witnesses.select("seed_id", "symbol_id", F.posexplode("path").alias("hop", "h"))
    met = hops.select("seed_id", "symbol_id", "hop", F.posexplode(F.array(file_of(F.col("h.src")), F.col("h.file"), file_of(F.col("h.dst")))).alias("place", "file")).where("file IS NOT NULL")
    known = selected.select("seed_id", F.col("path").alias("file"), "tier", "reason").distinct()
    both = met.join(known, ["seed_id", "file"])
    out = both.groupBy("seed_id", "symbol_id", "file").agg(F.min(F.struct("hop", "place")).alias("first"), F.array_sort(F.collect_set("hop")).alias("hops"), F.array_sort(F.collect_set(F.struct("tier", "reason"))).alias("reasons"))
    return out.groupBy("seed_id", "symbol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "file", "hops", "reasons"))), lambda x: F.struct(x["file"].alias("path"), x["hops"].alias("hops"), x["reasons"].alias("reasons"))).alias("slice_context"))


def selected_vs_pruned(selected: DataFrame, pruned: DataFrame) -> DataFrame:
    """Pairs of a chosen and a pruned candidate of one seed and boundary, with the score field that decided.

    Both have ``seed_id``, ``via``, ``path``, ``primary_evidence`` and a ``scoring`` struct; pruned ones a ``prune_reason``.
    """
    a = selected.select("seed_id", "via", F.col("path").alias("selected_path"), F.col("scoring").alias("w"), F.col("primary_evidence").alias("we"))
    b = pruned.select("seed_id", "via", F.col("path").alias("pruned_path"), F.col("scoring").alias("l"), F.col("primary_evidence").alias("le"), "prune_reason")
    both = a.join(b, ["seed_id", "via"])
    field = first_better("w", "l")
    won = F.array_except("we", "le")
    text = F.concat(F.col("selected_path"), F.lit(" was chosen over "), F.col("pruned_path"), F.lit(" ("), F.coalesce("better_by", "prune_reason"), F.when(F.size("winning_evidence") > 0, F.concat(F.lit("; with "), F.array_join("winning_evidence", ", "))).otherwise(F.lit("")), F.lit(")"))
    return both.withColumn("better_by", field).withColumn("winning_evidence", won).withColumn("summary", text).drop("w", "l", "we", "le")


STEPS = {"wrapper_return": "summary_return_bridge", "boundary_alias_continuation": "alias_result_stitch", "require_relative_chain": "require_relative_load"}


def bridge_chain(selected: DataFrame) -> DataFrame:
    """The steps by which a seed reaches its chosen files: a call-site binding first if there is a direct boundary, then one step a bridge.

    ``selected``: ``seed_id``, ``path``, ``tier``, ``reason``, ``via``, ``bridge_kind`` (null for tiers 0 and 1).
    """
    kind = F.coalesce(*(F.when(F.col("bridge_kind") == k, v) for k, v in STEPS.items()))
    step = F.when((F.col("tier") == 3) & (F.col("bridge_kind") == "wrapper_return"), "nested_summary_bridge").otherwise(kind)
    step = F.when(F.col("tier") == 1, "callsite_input_binding").otherwise(step)
    rows = selected.withColumn("step", step).where("step IS NOT NULL")
    role = F.when(F.col("step") == "require_relative_load", "supporting").otherwise("winning")
    rows = rows.withColumn("role", role)
    one = F.struct("tier", "step", "role", "via", "path")
    out = rows.groupBy("seed_id").agg(F.array_sort(F.collect_set(one)).alias("steps"))
    has = lambda s: F.exists("steps", lambda x: x["step"] == s)
    family = (
        F.when(has("require_relative_load") & (has("alias_result_stitch") | has("summary_return_bridge")), "mixed")
        .when(has("alias_result_stitch"), "alias_result")
        .when(has("require_relative_load"), "require_relative")
        .when(has("nested_summary_bridge"), "nested_summary")
        .when(has("summary_return_bridge"), "return")
    )
    return out.withColumn("family", family)
