"""Mixing sources to target weights: temperature mixing, realised as budgeted permutations of blocks of documents."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, cut, table


def exponent(moments: Callable[[list[float]], list[tuple[float, float]]], sources: int, least: float, budget_ratio: float, entropy: float, repeats: float, points: int = 40, rounds: int = 7) -> float:
    """The exponent in [0, 1] of the weights share**exponent, normalised.

    moments: for each of some exponents a, the sums over sources of share**a and of share**a * log(share); least: the smallest share.
    Entropy falls and the most repeated source's repeats fall as the exponent grows. The largest exponent whose entropy is at least
    `entropy` times the most possible is bisected, then raised to the least one at which no source is repeated over `repeats` times;
    that limit wins, and 1 is taken where neither can be met. Both edges are bisected at once, `points` exponents a round.
    """
    goal = entropy * math.log(sources) - 1e-12
    flat = lambda a, z, s: math.log(z) - a * s / z < goal  # noqa: E731  the weights' entropy is below the goal
    rare = lambda a, z, s: budget_ratio * least ** (a - 1) / z <= repeats + 1e-12
    z, s = moments([1.0])[0]
    bounds = {f: (-1.0, 1.0) for f in (flat, rare) if f(1.0, z, s)}
    for _ in range(rounds):
        # Each target holds above an edge; an interval starts below 0, so that 0 itself is tried.
        tried = {f: [max(0.0, low + (high - low) * k / points) for k in range(1, points)] for f, (low, high) in bounds.items()}
        every = sorted({a for xs in tried.values() for a in xs})
        at = dict(zip(every, moments(every))) if every else {}
        for f, xs in tried.items():
            low, high = bounds[f]
            holds = [a for a in xs if f(a, *at[a])]
            high = min([high, *holds])
            bounds[f] = (max([low, *(a for a in xs if a < high)]), high)
    return max([high for _, high in bounds.values()], default=1.0) if len(bounds) == 2 else 1.0


def temperature(tokens: dict[str, int], budget: float, entropy: float, repeats: float) -> tuple[float, dict[str, float]]:
    """The exponent and the weights of a few sources whose tokens are at hand."""
    total = sum(tokens.values())
    share = {s: t / total for s, t in tokens.items()}
    sums = lambda a: (sum(p**a for p in share.values()), sum(p**a * math.log(p) for p in share.values()))
    a = exponent(lambda xs: [sums(x) for x in xs], len(share), min(share.values()), budget / total, entropy, repeats)
    return a, {s: p**a / sums(a)[0] for s, p in share.items()}


def _source(source_col: str) -> Column:
    return F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("_source")


def _keys(id_col: str, source_col: str, blocks: int, seed: int) -> list[Column]:
    own = F.col(f"`{id_col}`")
    return [_source(source_col), F.pmod(F.xxhash64(F.lit(seed), own), F.lit(blocks)).cast("int").alias("_block"), F.xxhash64(F.lit(seed + 1), own).alias("_order")]


def _tokens(text_col: str) -> Column:
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SPACE), lambda w: w != "")
    return F.greatest(F.lit(1), F.size(words)).cast("long").alias("_tokens")


def _plan(keyed: DataFrame, seed: int, budget_ratio: float, entropy: float, repeats: float) -> DataFrame | None:
    """A row for each (source, block) that documents have: weight, epochs, rounds, rank of the block, taken (1: once more, 0: not, null: up to
    _edge). However many sources there are, only sums over all of them go to the driver."""
    sums = cut(keyed.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_sum")), "block-tokens")
    totals = sums.groupBy("_source").agg(F.sum("_sum").alias("_t"))
    total, sources, least = totals.agg(F.sum("_t"), F.count("*"), F.min("_t")).first()
    if not sources:
        return None
    share = F.col("_t") / total

    def moments(xs: list[float]) -> list[tuple[float, float]]:
        each = totals.select(F.log(share).alias("_l"), F.explode(F.array(*[F.lit(x) for x in xs])).alias("a"))
        got = each.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("_l"))).alias("z"), F.sum(F.exp(F.col("a") * F.col("_l")) * F.col("_l")).alias("s"))
        of = {r["a"]: (r["z"], r["s"]) for r in got.collect()}  # at most two grids of exponents
        return [of[x] for x in xs]

    a = exponent(moments, sources, least / total, budget_ratio, entropy, repeats)
    z = moments([a])[0][0]
    weight = F.exp(a * F.log(share)) / z
    quota = F.col("weight") * (budget_ratio * total)
    q = totals.withColumn("weight", weight).withColumn("_rounds", quota / F.col("_t")).withColumn("_epochs", F.floor("_rounds").cast("int"))
    q = q.select("_source", "weight", "_rounds", "_epochs", (quota - F.col("_epochs") * F.col("_t")).alias("_left"))
    by = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_block"), "_block")
    ranked = sums.withColumn("_rank", F.row_number().over(by)).withColumn("_upto", F.sum("_sum").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    plan = ranked.join(q, "_source")
    plan = cut(plan.withColumn("_taken", F.when(F.col("_upto") <= F.col("_left"), 1).when(F.col("_upto") - F.col("_sum") >= F.col("_left"), 0)), "mixture")
    # Within the one block of a source that the budget ends in, documents are taken by their order while they fit: first whole ranges of
    # orders, by their sums, then the documents of the one range that is left, a 65536th of the block.
    ends = plan.where(F.col("_taken").isNull()).select("_source", "_block", (F.col("_left") - F.col("_upto") + F.col("_sum")).alias("_room"))
    inside = keyed.join(ends, ["_source", "_block"]).withColumn("_range", F.shiftright("_order", 48))
    ranges = inside.groupBy("_source", "_room", "_range").agg(F.sum("_tokens").alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    last = ranges.withColumn("_to", upto).where((F.col("_to") > F.col("_room")) & (F.col("_to") - F.col("_in") <= F.col("_room")))
    last = last.select("_source", "_range", (F.col("_room") - F.col("_to") + F.col("_in")).alias("_rest"))
    run = inside.join(last, ["_source", "_range"]).withColumn("_run", F.sum("_tokens").over(Window.partitionBy("_source").orderBy("_order").rangeBetween(Window.unboundedPreceding, 0)))
    edge = run.groupBy("_source").agg(F.coalesce(F.max(F.when(F.col("_run") <= F.col("_rest"), F.col("_order"))), F.shiftleft(F.min("_range"), 48) - 1).alias("_edge"))
    return cut(plan.join(edge, "_source", "left").select("_source", "_block", "weight", "_epochs", "_rounds", "_rank", "_taken", "_edge"), "mixture-edges")


def _copies(keyed: DataFrame, plan: DataFrame, blocks: int) -> DataFrame:
    """Rows with _source, _block and _order as often as the plan takes them: adds weight, copy from 1 and slot."""
    once = F.coalesce("_taken", (F.col("_order") <= F.col("_edge")).cast("int"), F.lit(0))
    out = keyed.join(plan, ["_source", "_block"]).withColumn("_n", F.col("_epochs") + once).where(F.col("_n") > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    turn = (F.col("_rank") - 1 + F.pmod(F.col("_order"), F.lit(1 << 20)) / (1 << 20)) / blocks
    return out.withColumn("slot", (F.col("copy") - 1 + turn) / F.greatest(F.col("_rounds"), F.lit(1e-9)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_ratio: float = 1.0,
    entropy: float = 0.95, repeats: float = 4.0, blocks: int = 256, seed: int = 11,
) -> DataFrame:
    """One row per copy that the mixture takes: doc_id, source, copy (int, from 1), tokens (words, at least 1), weight (of the source),
    slot (double; ordering by it interleaves the sources in proportion to their weights).

    The budget is budget_ratio times the corpus' words. A source whose quota is n whole rounds and a rest gives each document n times and
    the rest from a permutation of its blocks. A null source is the source "". Null texts count as one word. Repeated rows and null ids
    share an order and are taken together. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _tokens(text_col), *_keys(id_col, source_col, blocks, seed))
    keyed = cut(own, "tokens")  # the one pass over the texts
    plan = _plan(keyed, seed, budget_ratio, entropy, repeats)
    if plan is None:
        return keyed.selectExpr("doc_id", "source", "1 AS copy", "_tokens AS tokens", "0D AS weight", "0D AS slot")
    return _copies(keyed, plan, blocks).select("doc_id", "source", "copy", F.col("_tokens").alias("tokens"), "weight", "slot")


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_ratio: float = 1.0,
    entropy: float = 0.95, repeats: float = 4.0, blocks: int = 256, seed: int = 11,
) -> DataFrame:
    """The rows that mix_sources takes, as often as it takes them, with docs' columns, whatever their names.

    Null texts, sources and ids and repeated rows are as in mix_sources; a row that is taken comes with all its copies of equal id and
    source. An empty table gives an empty result.
    """
    keyed = cut(docs.select(_tokens(text_col), *_keys(id_col, source_col, blocks, seed)), "tokens")
    plan = _plan(keyed, seed, budget_ratio, entropy, repeats)
    if plan is None:
        return docs
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *_keys(id_col, source_col, blocks, seed))
    return _copies(whole, plan, blocks).select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
