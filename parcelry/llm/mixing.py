"""Mixing sources to target weights by temperature, in DataFrame functions throughout.

A source with the share p of all tokens gets a weight in proportion to p ** exponent. Exponent 1 keeps the
shares, 0 makes all sources equal; entropy falls and the repetition of small sources falls as it grows, so
both targets are met by bisection over one narrow table of source totals.

Weights become budgets of tokens. A source is a sequence of passes over its documents. Documents lie in
blocks by the leading bits of a seeded hash of their doc_id; each pass visits the blocks in an order of its
own, an affine permutation of the block numbers, so any block's place in any pass is arithmetic and no
global order is ever sorted. Whole passes give every document the same number of copies; of the last pass,
whole blocks are taken until the budget ends inside one, and only that block is put in order document by
document. A source of any size is thus cut by its block totals, and a hot source spreads over all its blocks.

Results by case: a null source is a source of its own; a null text has no tokens; a source without any
token keeps one copy of each row; rows that repeat a doc_id get the same copies; a row with a null doc_id is
hashed as such; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.llm.common import small, stage

#: Documents of a block, about; blocks of a source are the next power of two of its rows over this.
BLOCK_ROWS = 1024
SEED = 20_240_131
#: Halvings of a bisection, a multiple of four: the exponent is met to 2 ** -STEPS.
STEPS = 32


def token_count(text: Column) -> Column:
    """Words of a text, by ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t-\r]+|[ \t-\r]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def document_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens, h): what mixing needs of each row; h is a non-negative hash."""
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), token_count(F.col(text)).alias("n_tokens"), _hash(F.col(key)).alias("h")
    )


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit(SEED)).bitwiseAND((1 << 62) - 1)


def _log_weight(exponent: Column) -> Column:
    """ln of a source's weight before all are divided by their sum."""
    return exponent * F.ln(F.col("tokens") / F.col("all_tokens"))


def met(sources: DataFrame, exponents: list[float], budget: int) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of the weights, their entropy once divided by it, and the most passes of any source."""
    grid = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("exponent")
    rows = (
        sources.where("tokens > 0").select("tokens", "all_tokens", grid)
        .withColumn("l", _log_weight(F.col("exponent"))).withColumn("w", F.exp("l"))
        .groupBy("exponent").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("l")).alias("wl"), F.max(F.col("w") / F.col("tokens")).alias("r"))
        .collect()
    )
    found = {r["exponent"]: (r["z"], math.log(r["z"]) - r["wl"] / r["z"], budget * r["r"] / r["z"]) for r in rows}
    return [found.get(x, (1.0, 0.0, 0.0)) for x in exponents]


def bisected(holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest exponent in [0, 1) at which ``holds`` is still true, which it is up to some point: STEPS halvings, four to a job."""
    low, high = 0.0, 1.0
    for _ in range(STEPS // 4):
        inner = [low + (high - low) * k / 16 for k in range(1, 16)]
        true = holds(inner)
        edges = [low, *inner, high]
        k = true.index(False) if False in true else 15
        low, high = edges[k], edges[k + 1]
    return low


def solved_exponent(sources: DataFrame, budget: int, entropy: float | None, repeats: float | None) -> float:
    """The largest exponent up to 1 whose entropy reaches the target, raised as far as the repetition limit asks.

    Where both can't be met, the limit wins; where even exponent 1 repeats too often, it is 1.
    """
    exponent = 1.0
    if entropy is not None and met(sources, [1.0], budget)[0][1] < entropy:
        exponent = bisected(lambda xs: [h >= entropy for _, h, _ in met(sources, xs, budget)])
    if repeats is not None and met(sources, [exponent], budget)[0][2] > repeats:
        floor = bisected(lambda xs: [r > repeats for _, _, r in met(sources, xs, budget)])
        exponent = max(exponent, min(1.0, floor + 2.0**-STEPS))
    return exponent


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, n_docs, tokens, all_tokens): one row for each source."""
    totals = stage(rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "mix-totals")
    return totals.withColumn("all_tokens", F.lit(totals.agg(F.sum("tokens")).first()[0] or 0).cast("long"))


def source_plan(sources: DataFrame, exponent: float, budget: int) -> DataFrame:
    """Adds to each source its weight, its budget in tokens, its whole passes, what is left for the last, and its blocks."""
    z = met(sources, [exponent], budget)[0][0]
    weight = F.when(F.col("tokens") > 0, F.exp(_log_weight(F.lit(exponent))) / z).otherwise(0.0)
    mask = F.expr("shiftleft(CAST(1 AS BIGINT), bits) - 1")
    drawn = lambda what: F.xxhash64("source", "passes", F.lit(what), F.lit(SEED))
    return (
        sources.withColumn("weight", weight)
        .withColumn("budget_tokens", F.round(F.col("weight") * budget).cast("long"))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.expr("budget_tokens DIV tokens")).otherwise(1))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget_tokens") % F.col("tokens")).otherwise(0))
        .withColumn("bits", F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n_docs") / BLOCK_ROWS))).cast("int"))
        .withColumn("times", drawn("times").bitwiseAND(mask).bitwiseOR(1))
        .withColumn("plus", drawn("plus").bitwiseAND(mask))
    )


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each row to its source's plan and adds the place of its block in the source's last pass."""
    of = plan.select(F.col("source").alias("_source"), *[c for c in plan.columns if c not in ("source", "n_docs")])
    block = F.expr("shiftright(h, 62 - bits)")
    return (
        rows.join(small(of), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("place", (block * F.col("times") + F.col("plus")).bitwiseAND(F.expr("shiftleft(CAST(1 AS BIGINT), bits) - 1")))
    )


def with_cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to the plan where each source's last pass ends: the block, and the last hash taken inside it."""
    blocks = placed(rows, plan).groupBy("source", "place", "rest").agg(F.sum("n_tokens").alias("in_block"))
    ahead = F.sum("in_block").over(Window.partitionBy("source").orderBy("place")) - F.col("in_block")
    ends = blocks.withColumn("ahead", ahead).where("ahead < rest AND rest <= ahead + in_block").select(
        F.col("source").alias("_source"), F.col("place").alias("cut_place"), (F.col("rest") - F.col("ahead")).alias("room")
    )
    ends = stage(ends, "mix-ends")
    inside = placed(rows, plan).join(small(ends), F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("cut_place")))
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = inside.withColumn("before", before).where("before < room").groupBy("source", "cut_place").agg(F.max("h").alias("cut_hash"))
    taken = taken.withColumnRenamed("source", "_source")
    return stage(plan.join(taken, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-plan")


def mixing_plan(rows: DataFrame, entropy_share: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """One row for each source: weight, budget and where its last pass ends.

    ``entropy_share`` is of the greatest entropy these sources could have, ``repeats`` the most passes over
    any source, ``budget`` the tokens to draw (all there are, if None).
    """
    sources = source_totals(rows)
    facts = sources.where("tokens > 0").agg(F.count("*").alias("n"), F.max("all_tokens").alias("t")).first()
    budget = (facts["t"] or 0) if budget is None else budget
    entropy = None if entropy_share is None or facts["n"] == 0 else entropy_share * math.log(facts["n"])
    exponent = solved_exponent(sources, budget, entropy, repeats) if facts["n"] else 1.0
    return with_cuts(rows, source_plan(sources, exponent, budget))


def copies() -> Column:
    """How often a placed row is drawn."""
    last = F.expr("cut_place IS NOT NULL AND (place < cut_place OR place = cut_place AND h <= cut_hash)")
    return (F.col("passes") + last.cast("long")).cast("long")


def mixed_copies(docs: DataFrame, entropy_share: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, budget_tokens, copies) for every row of ``docs``."""
    rows = stage(document_tokens(docs), "mix-rows")
    plan = mixing_plan(rows, entropy_share, repeats, budget)
    return placed(rows, plan).select("doc_id", "source", "n_tokens", "weight", "budget_tokens", copies().alias("copies"))


def mix(docs: DataFrame, entropy_share: float | None = 0.95, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, columns as they are. Texts aren't shuffled."""
    rows = stage(document_tokens(docs), "mix-rows")
    plan = mixing_plan(rows, entropy_share, repeats, budget)
    whole = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["source"].cast("string").alias("source"), _hash(docs["doc_id"]).alias("h")
    )
    drawn = placed(whole, plan).withColumn("copies", copies()).where("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")
