"""Mixing sources to target weights: whole copies, then Pareto order sampling.

Native Spark: column expressions and aggregates only. A source's target over its size says how often
each of its documents is copied for certain; what is then still missing is a fixed-size sample drawn
with unequal probabilities. A document's inclusion probability is in proportion to its size, so that
the sample's expected words are those missing; documents that would come out above one are taken
for certain, and the others share what is left. They are ranked by their random odds divided by
their inclusion odds and taken in that order as long as they fit into the words still wanted. The
last place goes to the document, from the cut on, whose size comes nearest to what is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import col, cut_lineage, others, with_facts
from tidegauge.operators.ordering import row_index

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
RANK_BITS = 48
STEP_BITS = 12  # each refinement of the cut looks at this many more bits of the rank
GROUP_ROWS = 4096  # rows with equal ranks that one window may number


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Weights repeat over the sources by code point, null last. All sizes are shared by weight; a
    target stops at ``most`` times its source's size and the excess is shared again by weight
    among the others, until no target is above its stop.
    """
    ranked = row_index(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], name="_rank").drop("_null")
    cycle = F.array(*[F.lit(w) for w in weights])
    known = cut_lineage(
        ranked.withColumn("_w", F.get(cycle, (F.col("_rank") % len(weights)).cast("int")).cast("bigint"))
    )
    total = known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    top = (F.col("source_size") * most).cast("decimal(20,0)")
    big = lambda n: F.lit(str(n)).cast("decimal(18,0)")
    left, weight = total, known.agg(F.sum("_w")).first()[0] or 1
    while True:  # a source once above stays above, as the share of a weight only grows
        above = top * big(weight) < big(left) * F.col("_w").cast("decimal(18,0)")
        capped, free = known.where(above), known.where(~above)
        held = capped.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
        rest = free.agg(F.sum("_w")).first()[0] or 0
        if (total - most * held, rest) == (left, weight) or not rest:
            break
        left, weight = total - most * held, rest
    share = (big(left) * F.col("_w").cast("decimal(18,0)")).cast("double") / F.lit(float(weight))
    return known.select("source", "source_size", F.when(above, top.cast("double")).otherwise(share).alias("target"))


def pareto_rank(uniform: Column, inclusion: Column, bits: int = RANK_BITS) -> Column:
    """Random odds over inclusion odds, mapped to whole numbers of ``bits`` bits in the same order."""
    odds = (uniform / (1 - uniform)) / (inclusion / (1 - inclusion))
    return F.floor(odds / (1 + odds) * F.lit(float((1 << bits) - 1))).cast("bigint")


def _cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, want, prefix, done): the rank at which the sizes in rank order reach ``want``.

    ``rows`` has source, rank and size. ``done`` is the sum before that rank; ``prefix`` is null if
    the sum never gets there. The cut is found by sums over coarse, then ever finer ranges of the
    rank, so no task sorts a source.
    """
    at = wanted.select(
        "source", "want", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("done")
    )
    for low in range(RANK_BITS - STEP_BITS, -1, -STEP_BITS):
        at = cut_lineage(at)
        sums = (
            with_facts(rows, at, "source")
            .where(F.shiftright("rank", low + STEP_BITS) == F.col("prefix"))
            .groupBy("source", "want", "done", F.shiftright("rank", low).alias("block"))
            .agg(F.sum("size").alias("size"))
        )
        # At most 2 ** STEP_BITS blocks of a source in one list.
        listed = sums.groupBy("source", "want", "done").agg(
            F.array_sort(F.collect_list(F.struct("block", "size"))).alias("blocks")
        )
        start = F.struct(F.col("done").alias("sum"), F.lit(None).cast("bigint").alias("prefix"))
        at = listed.select("source", "want", F.aggregate("blocks", start, _pass_block).alias("f")).select(
            "source", "want", F.col("f.prefix").alias("prefix"), F.col("f.sum").alias("done")
        )
    return cut_lineage(at)


def _pass_block(acc: Column, x: Column) -> Column:
    found = acc["prefix"].isNotNull()
    over = ~found & (acc["sum"] + x["size"] >= F.col("want"))
    return F.struct(
        F.when(over | found, acc["sum"]).otherwise(acc["sum"] + x["size"]).alias("sum"),
        F.when(over, x["block"]).otherwise(acc["prefix"]).alias("prefix"),
    )


def _last_places(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, prefix, ties, last): of the cut's rank how many rows of each size fit, and the rank and size that fill the rest."""
    met = with_facts(rows, cuts, "source").where(F.col("rank") >= F.col("prefix"))
    by_size = met.where(F.col("rank") == F.col("prefix")).groupBy("source", "want", "prefix", "done", "size").agg(F.count(F.lit(1)).alias("n"))
    # Rows of one rank: repeats, and now and then another document. Few sizes, the smaller first.
    listed = by_size.groupBy("source", "want", "prefix", "done").agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("sizes"))
    start = F.struct(
        (F.col("want") - F.col("done")).alias("room"),
        (F.col("want") - F.col("done")).alias("gap"),
        F.array().cast("array<struct<size:bigint,n:bigint,full:bigint>>").alias("ties"),
    )
    held = cut_lineage(
        listed.withColumn("f", F.aggregate("sizes", start, _fill)).select("source", "prefix", "f.ties", "f.gap")
    )
    miss = F.abs(F.col("size") - F.col("gap"))
    tie = _tie()
    free = (F.col("rank") > F.col("prefix")) | ((F.col("rank") == F.col("prefix")) & (tie["full"] < tie["n"]))
    last = (
        with_facts(rows, held, "source")
        .where(free & (F.col("size") > 0) & (miss < F.col("gap")))
        .groupBy(F.col("source").alias("_s"))
        .agg(F.min(F.struct(miss.alias("miss"), F.col("rank").alias("rank"), F.col("size").alias("size"))).alias("last"))
    )
    return held.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "prefix", "ties", "last")


def _fill(acc: Column, x: Column) -> Column:
    fits = F.when(x["size"] > 0, F.greatest(F.lit(0), F.least(x["n"], F.floor(acc["room"] / x["size"])))).otherwise(0).cast("bigint")
    return F.struct(
        (acc["room"] - x["n"] * x["size"]).alias("room"),
        (acc["gap"] - fits * x["size"]).alias("gap"),
        F.concat(acc["ties"], F.array(F.struct(x["size"].alias("size"), x["n"].alias("n"), fits.alias("full")))).alias("ties"),
    )


def _tie() -> Column:
    return F.get(F.filter("ties", lambda t: t["size"] == F.col("size")), F.lit(0))


def inclusion_plan(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, certain, per_word, left): sizes from ``certain`` on are taken for certain, others with ``per_word`` times their size.

    ``plan`` has the words wanted of each source; ``left`` are those that the certain documents leave.
    Of sizes in falling order those are certain whose share of what the larger ones leave is one or
    more. One row a source and size is sorted: sizes repeat, however many documents there are.
    """
    sizes = cut_lineage(narrow.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    met = with_facts(sizes, plan.select("source", "want"), "source")
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(38,0)") * F.col("size")
    larger = F.coalesce(F.sum(words).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others_ = F.sum(squares.cast("decimal(38,0)")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    sure = (F.col("want") - larger) * F.col("size") >= others_.cast("double")
    told = met.withColumn("sure", sure).withColumn("words", words).withColumn("squares", squares.cast("decimal(38,0)"))
    held = told.groupBy("source", "want").agg(
        F.min(F.when(F.col("sure"), F.col("size"))).alias("certain"),
        F.coalesce(F.sum(F.when(F.col("sure"), F.col("words"))), F.lit(0)).alias("held"),
        F.sum(F.when(~F.col("sure"), F.col("squares"))).cast("double").alias("squares"),
    )
    left = F.col("want") - F.col("held")
    return held.select("source", "certain", (left / F.col("squares")).alias("per_word"), left.alias("left"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
    seed: int = 42,
    most: int = MOST_COPIES,
    weights=WEIGHTS,
) -> DataFrame:
    """``keep`` (the id by default) and size, source_size, target, copies, taken, inclusion of every row.

    ``taken`` is size times copies; ``inclusion`` is the probability of the last copy. The random
    number of a document comes from a hash of seed, id and text, so reruns agree, and different
    texts of one id, or without any, are drawn each for itself. A null or empty text has size 0 and
    is taken 0 words; a source of size 0 has target 0. A null source is a source, a null id hashes
    like an empty one. Repeated rows share a rank; if the cut falls among them as many are taken as
    needed. Equal ranks are ordered by size. An empty table gives an empty one. Kept columns
    whose names clash with a result are left out.
    """
    results = ("size", "source_size", "target", "copies", "taken", "inclusion")
    wide = docs.select(*[col(c) for c in others(docs, results) if c in (keep or [id_col])])
    kept = wide.columns
    text = col(text_col).cast("string")
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))), 256)
    rows = docs.select(
        *[col(c).alias(f"__k{i}") for i, c in enumerate(kept)],
        col(id_col).alias("__doc"),
        F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint").alias("__u"),
        col(source_col).alias("source__"),
        word_count(text).alias("size"),
    )
    if not keep:
        rows = cut_lineage(rows)
    narrow = rows.select("__doc", "__u", F.col("source__").alias("source"), "size")
    narrow = cut_lineage(narrow) if keep else narrow
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut_lineage(
        source_targets(sizes, most, weights)
        .withColumn("whole", F.floor(ratio).cast("bigint"))
        .withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    drawn_from = cut_lineage(inclusion_plan(narrow, plan.where("want > 0")))
    sure = F.coalesce(F.col("size") >= F.col("certain"), F.lit(False))
    own = F.when(F.col("size") > 0, F.when(sure, F.lit(1.0)).otherwise(F.col("per_word") * F.col("size")))
    inclusion = F.coalesce(own, F.lit(0.0))
    uniform = (F.col("__u") + 0.5) / float(1 << 48)
    rank = F.when((inclusion > 0) & (inclusion < 1), pareto_rank(uniform, inclusion))

    drawn = with_facts(narrow, drawn_from, "source")
    drawn = cut_lineage(drawn.select("source", rank.alias("rank"), "size").where("rank is not null"))
    cuts = _cuts(drawn, drawn_from.select("source", F.col("left").alias("want")))
    places = _last_places(drawn, cuts)
    facts = plan.select(F.col("source").alias("source__"), "source_size", "target", "whole")
    for more in (drawn_from.drop("left"), places):
        facts = facts.join(more.withColumnRenamed("source", "_s"), F.col("source__").eqNullSafe(F.col("_s")), "left").drop("_s")
    facts = cut_lineage(facts)
    ranked = with_facts(rows, facts, "source__").withColumn("inclusion", inclusion).withColumn("rank", rank)
    fills = (F.col("rank") == F.col("last.rank")) & (F.col("size") == F.col("last.size"))
    at_cut = F.coalesce((F.col("rank") == F.col("prefix")) | fills, F.lit(False))
    before = (F.col("rank") < F.col("prefix")) | (F.col("rank").isNotNull() & F.col("prefix").isNull()) | (F.col("inclusion") == 1)
    plain = ranked.where(~at_cut).withColumn("more", F.coalesce(before, F.lit(False)))
    # One or two documents a source, or their repeats; which of the repeats are taken makes no difference.
    edge = cut_lineage(ranked.where(at_cut).withColumn("_any", F.monotonically_increasing_id()))
    quota = F.when(F.col("rank") == F.col("prefix"), F.coalesce(_tie()["full"], F.lit(0))).otherwise(0) + F.coalesce(
        fills.cast("bigint"), F.lit(0)
    )
    last = row_index(edge, ["__doc", "_any"], ["source__", "rank", "size"], "_k", max_rows=GROUP_ROWS)
    last = last.withColumn("more", F.col("_k") < quota).drop("_k", "_any")
    copies = F.col("whole") + F.col("more").cast("bigint")
    return plain.unionByName(last).select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"), "inclusion",
    )
