"""Which rubric items are missed together: support, pair similarity, edges and clusters.

Co-occurrence is counted, not listed. Every student becomes one or more *units*, rows with a left and a
right array of item numbers of about ``UNIT_ITEMS`` entries at most; a student with more items is split
over the tiles of an item grid, so no task ever holds a large group. The pairs of a unit go straight into a
partial aggregate, and only the (a, b, n) counts are shuffled.

Where only the pairs over a threshold are wanted (edges, clusters, top pairs), most pairs are never made. The
students of an item are put into one order for all items, those with the fewest items first. A pair that reaches
a threshold has a common student within a *prefix* of both orders, whose length follows from the threshold; the
students with very many items are seldom in a prefix. What lies beyond the prefixes is counted only for the pairs that can
still reach their threshold. Both ways are exact; prefixes are used where they leave out most pairs, else all are tallied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.functions.text import clean
from redpencil.operators.components import connected_components
from redpencil.operators.shared import materialize, ordinals, running_totals
from redpencil.schemas import empty

# Size bound: items per unit side.
UNIT_ITEMS = 512
# Size bound: students of an item that meet a candidate pair in one join key.
CHUNK_STUDENTS = 4096
# Falling bounds of the similarity of top pairs; below the last one all pairs are counted.
TOP_BANDS = (0.5, 0.2)
# Bounds are lowered by this share, so that rounding cannot cost a pair. The measures themselves decide.
SLACK = 1e-9
# A pair met in prefixes, and a row beyond one, cost about as much as so many pairs of a tally, which combine before they are shuffled.
PREFIX_COST, BEYOND_COST = 8, 4

CLUSTER_DDL = "label string, rubric_item string, size bigint, support_students bigint"


def incidence(df: DataFrame) -> DataFrame:
    """Distinct (rubric_item, student_id) with a non-blank item."""
    return (
        df.select(clean(F.col("rubric_item")).alias("rubric_item"), F.col("student_id").cast("string"))
        .filter(F.col("rubric_item") != "")
        .distinct()
    )


def item_support(df: DataFrame, min_support: int = 2) -> DataFrame:
    """Rows (rubric_item, students) of the items that enough students have; none when fewer than two do."""
    supported = materialize(_supported(incidence(df), min_support))
    return supported.limit(0) if supported.limit(2).count() < 2 else supported.orderBy("rubric_item")


@dataclass(frozen=True)
class Incidence:
    """Numbered supported items (rubric_item, students, item_no) and who has them (unit, item_no, weight)."""

    items: DataFrame
    rows: DataFrame

    @cached_property
    def placed(self) -> DataFrame:
        """Rows (item_no, size, unit, spread, place): the place of a student among the item's, rare students first.

        ``spread`` is the student's number of items. A null student is one student.
        """
        unit = F.coalesce(F.concat(F.lit("s"), F.col("unit")), F.lit(""))
        rows = self.rows.select(unit.alias("unit"), "item_no")
        spread = rows.groupBy("unit").agg(F.count("*").alias("spread"))
        sizes = self.items.select("item_no", F.col("students").alias("size"))
        every = rows.join(spread, "unit").join(sizes, "item_no")
        return materialize(running_totals(every, ["spread", "unit"], F.lit(1).cast("bigint"), ["item_no"], "place"))

    @cached_property
    def spreads(self) -> list[tuple[int, int]]:
        """(rows, pairs) of the students with 1, 2 to 3, 4 to 7, … items; at most 64 entries."""
        spread = self.rows.groupBy("unit").agg(F.count("*").alias("_k"))
        pairs = F.col("_k") * (F.col("_k") - 1) / 2
        doubling = spread.groupBy(F.floor(F.log2("_k")).alias("_d")).agg(F.sum("_k").alias("rows"), F.sum(pairs).alias("pairs"))
        return [(row["rows"], row["pairs"]) for row in doubling.orderBy("_d").collect()]

    def with_catalogue(self, first: int | None = None) -> DataFrame:
        """The rows plus one weightless unit that has every item, or the first few: it adds pairs, not counts."""
        items = self.items if first is None else self.items.filter(F.col("item_no") <= first)
        return self.rows.unionByName(
            items.select(F.lit(None).cast("string").alias("unit"), "item_no", F.lit(0).alias("weight"))
        )


def supported_incidence(df: DataFrame, min_support: int = 2) -> Incidence:
    """The distinct incidence is computed once; item numbers follow the lexicographic order of the items."""
    distinct = materialize(incidence(df))
    items = materialize(ordinals(_supported(distinct, min_support), "rubric_item", "item_no"))
    rows = distinct.join(items, "rubric_item").select(
        F.col("student_id").alias("unit"), "item_no", F.lit(1).alias("weight")
    )
    return Incidence(items, rows)


def pair_similarity(df: DataFrame, min_support: int = 2) -> DataFrame:
    """All pairs of supported items, also those that no student has both of.

    The result has a row per pair of items by definition, whatever the number of students. Callers that
    only need the pairs with something in common use ``overlapping_pairs``.
    """
    data = supported_incidence(df, min_support)
    pairs = _measures(_pair_counts(data.with_catalogue()), data.items)
    return _named(pairs, data.items).orderBy(F.desc("jaccard"), "rubric_item_a", "rubric_item_b")


def overlapping_pairs(df: DataFrame, min_support: int = 2) -> DataFrame:
    """The pairs of supported items that at least one student has both of."""
    data = supported_incidence(df, min_support)
    return _named(_measures(_pair_counts(data.rows), data.items), data.items)


def top_pairs(df: DataFrame, n: int = 20, min_support: int = 2) -> DataFrame:
    """The most similar pairs, ranked on the exact values and rounded for display.

    Bands of falling similarity are read until one holds ``n`` pairs, ties included; see ``_best_pairs``.
    """
    data = supported_incidence(df, min_support)
    ranked = _best_pairs(data, n)
    # Item numbers sort as the item names do.
    top = _named(ranked.orderBy(F.desc("jaccard"), "a", "b").limit(n), data.items)
    ordered = top.orderBy(F.desc("jaccard"), "rubric_item_a", "rubric_item_b")
    return ordered.withColumns({"jaccard": F.bround("jaccard", 3), "corr": F.bround("corr", 3)})


def similarity_edges(
    df: DataFrame, jaccard_threshold: float = 0.2, corr_threshold: float = 0.3, min_support: int = 2
) -> DataFrame:
    """Pairs similar enough by either measure."""
    data = supported_incidence(df, min_support)
    return _named(_edges(data, jaccard_threshold, corr_threshold), data.items)


def misconception_clusters(
    df: DataFrame, jaccard_threshold: float = 0.2, corr_threshold: float = 0.3, min_support: int = 2
) -> DataFrame:
    """Connected groups of similar items, single items included, one row per member.

    Columns: label, rubric_item, size, support_students (distinct students over all members). Clusters are
    numbered by their smallest member. Members are rows, not one array, as a cluster has no size bound.
    """
    data = supported_incidence(df, min_support)
    if data.items.limit(2).count() < 2:
        return empty(df.sparkSession, CLUSTER_DDL)
    number = data.items.select("rubric_item", "item_no")
    near = _edges(data, jaccard_threshold, corr_threshold)
    component = connected_components(number.select("item_no"), near.select("a", "b"))
    sizes = component.groupBy("component").agg(F.count("*").alias("size"))
    support = (
        data.rows.join(component, "item_no")
        .groupBy("component")
        .agg(F.count_distinct("unit").alias("support_students"))
    )
    labels = ordinals(sizes, "component", "_n")
    return (
        number.join(component, "item_no")
        .join(labels, "component")
        .join(support, "component")
        .orderBy("_n", "rubric_item")
        .select(F.format_string("Misconception %d", "_n").alias("label"), "rubric_item", "size", "support_students")
    )


def pair_tallies(units: DataFrame, ordered: bool) -> DataFrame:
    """Sum of weights per (a, b) from units (left, right, same, weight).

    ``same`` marks units whose sides are one and the same set, kept in ``left``; there each pair counts once.
    An unordered pair is returned smaller number first, an ordered one as (left, right).
    """
    other = F.when(F.col("same"), F.col("left")).otherwise(F.col("right"))
    pairs = (
        units.select(F.explode("left").alias("a"), other.alias("other"), "same", "weight")
        .select("a", F.explode("other").alias("b"), "same", "weight")
        .filter(~F.col("same") | (F.col("a") < F.col("b")))
    )
    key = ["a", "b"] if ordered else [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return pairs.groupBy(*key).agg(F.sum("weight").alias("n"))


def unit_blocks(count: Column) -> Column:
    """Into how many item blocks a side with this many items is split."""
    return F.ceil(count / UNIT_ITEMS).cast("int")


def no_items() -> Column:
    return F.array().cast("array<bigint>")


def block_of(item: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(item), blocks).cast("int")


def _supported(distinct: DataFrame, min_support: int) -> DataFrame:
    counts = distinct.groupBy("rubric_item").agg(F.count("*").alias("students"))
    return counts.filter(F.col("students") >= min_support)


def _edges(data: Incidence, jaccard_threshold: float, corr_threshold: float) -> DataFrame:
    near = (F.col("jaccard") >= jaccard_threshold) | (F.col("corr") >= corr_threshold)
    if min(jaccard_threshold, corr_threshold) > 0:
        counts = _prefix_counts(data, _Bounds(jaccard_threshold, corr_threshold))
        if counts is None:
            counts = _pair_counts(data.rows)
    else:  # pairs without overlap score 0, so they count as well
        counts = _pair_counts(data.with_catalogue())
    return _measures(counts, data.items).filter(near)


def _best_pairs(data: Incidence, n: int) -> DataFrame:
    """Measures of pairs among which the ``n`` with the greatest Jaccard similarity are, with all their ties.

    The sizes of two items bound their similarity, and a prefix join reads only what can reach the bound of a band; a band
    whose prefixes leave out too little is passed over.
    Pairs without overlap only matter when fewer than ``n`` pairs overlap, and then the ones wanted are all
    among the first ``2 n`` items; so no other such pair is made.
    """
    for bound in TOP_BANDS:
        counts = _prefix_counts(data, _Bounds(bound, math.inf), n)
        if counts is None:
            continue
        measures = _measures(counts, data.items)
        best = materialize(measures.filter(F.col("jaccard") >= bound))
        if best.limit(n).count() == n:
            return best
    return _measures(_pair_counts(data.with_catalogue(first=2 * n)), data.items)


@dataclass(frozen=True)
class _Bounds:
    """What the thresholds ask of a pair at the least, for items of sizes small <= large."""

    jaccard: float
    corr: float

    @property
    def ratio(self) -> float:
        """A pair has small >= ratio * large, and ratio * large students in common."""
        return min(self.jaccard, self.corr**2) * (1 - SLACK)

    @property
    def share(self) -> float:
        """A pair has share * small students in common."""
        return min(2 * self.jaccard / (1 + self.jaccard), self.corr) * (1 - SLACK)

    def index_length(self, size: Column) -> Column:
        """Length of the prefix in which an item meets larger ones."""
        return size - F.ceil(size * self.share) + 1

    def probe_length(self, size: Column) -> Column:
        """Length of the prefix in which an item meets smaller ones; at least the other length."""
        return size - F.ceil(size * self.ratio) + 1

    def common(self, small: Column, large: Column) -> Column:
        by_jaccard = (small + large) * (self.jaccard / (1 + self.jaccard))
        return F.least(by_jaccard, F.sqrt(small * large) * self.corr) * (1 - SLACK)

    def size_class(self, size: Column) -> Column:
        """Sizes of a pair are in one class, or in two neighbouring ones."""
        return F.floor(F.log(size.cast("double")) / -math.log(min(self.ratio, 0.99)))


def _prefix_counts(data: Incidence, bounds: _Bounds, n: int = 0) -> DataFrame | None:
    """Counts of all pairs that can reach the bounds; None where a tally of all pairs is less work, or under ``n`` pairs can."""
    every = sum(pairs for _, pairs in data.spreads)
    if PREFIX_COST * _prefix_pairs(data, bounds) >= every:
        return None
    candidates = materialize(_candidates(data.placed, bounds))
    beyond = F.col("small_size") - F.col("index_length") + F.col("large_size") - F.col("probe_length")
    size = candidates.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(beyond), F.lit(0)).alias("beyond")).first()
    if size["pairs"] < n or BEYOND_COST * size["beyond"] >= every:
        return None
    return _complete(data.placed, candidates)


def _prefix_pairs(data: Incidence, bounds: _Bounds) -> float:
    """About how many pairs meet in prefixes: those of the students with the fewest items, up to the prefixes' share of rows."""
    size = F.col("students")
    share = data.items.agg(F.sum(bounds.index_length(size)) / F.sum(size)).first()[0] or 0.0
    left, met = share * sum(rows for rows, _ in data.spreads), 0.0
    for rows, pairs in data.spreads:
        taken = min(left, rows)
        met, left = met + pairs * taken / rows, left - taken
    return met


def _candidates(placed: DataFrame, bounds: _Bounds) -> DataFrame:
    """Rows (small, large, index_length, probe_length, small_size, large_size, met) of the pairs that can reach a threshold.

    ``met`` counts the common students within both prefixes. The items of a student meet by size class, and those of a
    student with many items in blocks.
    """
    size, place = F.col("size"), F.col("place")
    blocks = unit_blocks(F.col("spread"))
    small = placed.filter(place <= bounds.index_length(size)).select(
        "unit",
        block_of(F.col("item_no"), blocks).alias("block"),
        F.explode(F.array(bounds.size_class(size), bounds.size_class(size) + 1)).alias("size_class"),
        F.col("item_no").alias("small"),
        size.alias("small_size"),
        place.alias("small_place"),
    )
    large = placed.filter(place <= bounds.probe_length(size)).select(
        "unit",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        bounds.size_class(size).alias("size_class"),
        F.col("item_no").alias("large"),
        size.alias("large_size"),
        place.alias("large_place"),
    )
    sizes = F.col("small_size"), F.col("large_size")
    ordered = (sizes[0] < sizes[1]) | ((sizes[0] == sizes[1]) & (F.col("small") < F.col("large")))
    met = (
        small.join(large, ["unit", "block", "size_class"])
        .filter(ordered & (sizes[0] >= sizes[1] * bounds.ratio))
        .groupBy("small", "large", "small_size", "large_size")
        .agg(F.count("*").alias("met"), F.max("small_place").alias("_s"), F.max("large_place").alias("_l"))
    )
    most = F.col("met") + F.least(sizes[0] - F.col("_s"), sizes[1] - F.col("_l"))
    return met.filter(most >= bounds.common(*sizes)).select(
        "small",
        "large",
        bounds.index_length(sizes[0]).alias("index_length"),
        bounds.probe_length(sizes[1]).alias("probe_length"),
        "small_size",
        "large_size",
        "met",
    )


def _complete(placed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pair counts (a, b, n): what the candidates met, and their common students beyond a prefix.

    Such a student is beyond the prefix of the smaller item, or within it and beyond that of the larger one.
    """
    chunk = F.floor(F.col("place") / CHUNK_STUDENTS)

    def asked(item: str, other: str, length: str, limit: Column) -> DataFrame:
        """Rows (small, large, unit, other, limit): is the student among the first ``limit`` of the other item?"""
        beyond = placed.select(F.col("item_no").alias(item), "unit", "place", chunk.alias("chunk"))
        first, last = F.col(length) + 1, F.col(f"{item}_size")
        chunks = F.sequence(F.floor(first / CHUNK_STUDENTS), F.floor(last / CHUNK_STUDENTS))
        open_ = candidates.filter(first <= last).withColumn("chunk", F.explode(chunks))
        return (
            open_.join(beyond, [item, "chunk"])
            .filter(F.col("place") > F.col(length))
            .select("small", "large", "unit", F.col(other).alias("other"), limit.alias("limit"))
        )

    questions = asked("small", "large", "index_length", F.col("large_size")).unionByName(
        asked("large", "small", "probe_length", F.col("index_length"))
    )
    answers = placed.select(F.col("item_no").alias("other"), "unit", "place")
    rest = (
        questions.join(answers, ["other", "unit"])
        .filter(F.col("place") <= F.col("limit"))
        .groupBy("small", "large")
        .agg(F.count("*").alias("rest"))
    )
    return candidates.join(rest, ["small", "large"], "left").select(
        F.least("small", "large").alias("a"),
        F.greatest("small", "large").alias("b"),
        (F.col("met") + F.coalesce("rest", F.lit(0))).alias("n"),
    )


def _pair_counts(rows: DataFrame) -> DataFrame:
    """Pair counts from (unit, item_no, weight); a unit with many items is split into tiles.

    The rows of large units are dealt out by item before they are copied to their tiles, and the tiles are
    dealt out again, so that no task gets all of one unit.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("unit")), F.lit("catalogue"))
    rows = rows.select(key.alias("unit"), "item_no", F.col("weight").cast("bigint").alias("weight"))
    large = (
        rows.groupBy("unit")
        .agg(F.count("*").alias("_k"))
        .filter(F.col("_k") > UNIT_ITEMS)
        .select("unit", unit_blocks(F.col("_k")).alias("_blocks"))
    )
    sized = rows.join(large, "unit", "left")
    whole = (
        sized.filter(F.col("_blocks").isNull())
        .groupBy("unit")
        .agg(F.collect_list("item_no").alias("left"), F.max("weight").alias("weight"))
        .select("left", no_items().alias("right"), F.lit(True).alias("same"), "weight")
    )
    own, lo, hi = F.col("_own"), F.col("_lo"), F.col("_hi")
    tiled = (
        sized.filter(F.col("_blocks").isNotNull())
        .repartition("unit", "item_no")
        .withColumn("_own", block_of(F.col("item_no"), F.col("_blocks")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_lo": F.least("_own", "_other"), "_hi": F.greatest("_own", "_other")})
        .repartition("unit", "_lo", "_hi")
        .groupBy("unit", "_lo", "_hi")
        .agg(
            F.collect_list(F.when(own == lo, F.col("item_no"))).alias("left"),
            F.collect_list(F.when((own == hi) & (lo != hi), F.col("item_no"))).alias("right"),
            F.max("weight").alias("weight"),
        )
        .select("left", "right", (lo == hi).alias("same"), "weight")
    )
    return pair_tallies(whole.unionByName(tiled), ordered=False)


def _measures(counts: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (a, b, jaccard, corr, n) from pair counts and the supports of both items."""
    size_a = items.select(F.col("item_no").alias("a"), F.col("students").cast("double").alias("_sa"))
    size_b = items.select(F.col("item_no").alias("b"), F.col("students").cast("double").alias("_sb"))
    both = F.col("n").cast("double")
    return (
        counts.join(size_a, "a")
        .join(size_b, "b")
        .select(
            "a",
            "b",
            (both / (F.col("_sa") + F.col("_sb") - both)).alias("jaccard"),
            (both / F.sqrt(F.col("_sa") * F.col("_sb"))).alias("corr"),
            "n",
        )
    )


def _named(measures: DataFrame, items: DataFrame) -> DataFrame:
    name_a = items.select(F.col("item_no").alias("a"), F.col("rubric_item").alias("rubric_item_a"))
    name_b = items.select(F.col("item_no").alias("b"), F.col("rubric_item").alias("rubric_item_b"))
    named = measures.join(name_a, "a").join(name_b, "b")
    return named.select("rubric_item_a", "rubric_item_b", "jaccard", "corr", F.col("n").alias("cooccurrence"))
