"""Audits: hidden text, differing extractions, extraction confidence and the policy over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import geometry as G
from pagemill.functions import text as T
from pagemill.operators.spatial import crossing_pairs

#: Tiers from best to worst; Unverified ranks below Degraded.
TIERS = ("Ok", "Unverified", "Degraded", "Severe")


def hidden_items(items: DataFrame, obstructions: DataFrame, least_cover: float = 0.5) -> DataFrame:
    """items (doc_id, page_no, idx, box) covered by at least half by a later obstruction, with the first such one (hidden_by)."""
    keys = ["doc_id", "page_no"]
    over = obstructions.select(*keys, F.col("idx").alias("cover_idx"), F.col("box").alias("cover"))
    pairs = crossing_pairs(items, over, keys, "box", "cover").where((F.col("cover_idx") > F.col("idx")) & (G.cover_share(F.col("box"), F.col("cover")) >= least_cover))
    return first_cover(pairs, [*keys, "idx"], [c for c in items.columns if c not in (*keys, "idx")], [])


def first_cover(pairs: DataFrame, by: list[str], carried: list[str], of_cover: list[str]) -> DataFrame:
    """Of pairs of an item and what covers it (cover_idx) the one with the first cover, as hidden_by; combined before the shuffle."""
    first = F.min(F.struct("cover_idx", *of_cover)).alias("_first")
    found = pairs.groupBy(*by).agg(*(F.first(c).alias(c) for c in carried), first)
    return found.select(*by, *carried, F.col("_first.cover_idx").alias("hidden_by"), *(F.col(f"_first.{c}").alias(c) for c in of_cover))


def outside_bands(items: DataFrame, bands: DataFrame, keys: list[str], margin: float = 1.0) -> DataFrame:
    """items (keys, idx, box) whose height overlaps no band (keys, box) widened by the margin; what lies to the left or right does not count."""
    flat = lambda b, m: G.rect(F.lit(0), b["b"] - m, F.lit(1), b["t"] + m)
    heights = items.select(*keys, "idx", flat(F.col("box"), 0.0).alias("height"))
    beside = crossing_pairs(heights, bands.select(*keys, flat(F.col("box"), margin).alias("band")), keys, "height", "band").select(*keys, "idx")
    return items.join(beside.distinct(), [*keys, "idx"], "left_anti")


def words_not_seen(words: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, word) that are not among the visible ones, by lower case without edge punctuation."""
    key = F.lower(T.trim_edges(F.col("word")))
    seen = visible.select(*keys, key.alias("_key")).distinct()
    return words.withColumn("_key", key).where("_key <> ''").join(seen, [*keys, "_key"], "left_anti").drop("_key")


def page_confidence(pages: DataFrame) -> DataFrame:
    """pages (…, extracted, expected) with coverage, similarity and tier."""
    keyed = pages.withColumn("_kx", T.confidence_key(F.col("extracted"))).withColumn("_ke", T.confidence_key(F.col("expected")))
    known = F.col("expected").isNotNull()
    scored = keyed.withColumn("coverage", F.when(known, T.coverage_ratio(F.col("extracted"), F.col("expected")))).withColumn("similarity", T.bigram_jaccard(F.col("_kx"), F.col("_ke")))
    return scored.withColumn("tier", T.page_tier(F.col("_ke"), F.col("coverage"), F.col("similarity"))).drop("_kx", "_ke")


def worst_tier(tier: Column) -> Column:
    """Aggregate: the worst tier of a group."""
    order = F.array(*map(F.lit, TIERS))
    return F.element_at(order, F.max(F.array_position(order, tier)).cast("int"))


def policy(tier: Column, mode: str) -> Column:
    """What to do with a document: strict refuses all but Ok, default refuses Severe, warn never refuses."""
    refuse = {"strict": tier != "Ok", "default": tier == "Severe", "warn": F.lit(False)}[mode]
    return F.when(refuse, "Refuse").when(tier == "Ok", "Proceed").otherwise("Warn")
