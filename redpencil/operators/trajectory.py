"""What happens to a mistake in the next exam: transitions between items and the fate of each item.

Both work on consecutive exams a student sat, in exam order. The reference only fixes the column names of
the transitions; the definitions are stated in the README.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions.exams import sort_keys
from redpencil.functions.text import clean
from redpencil.operators.shared import materialize, ordinals
from redpencil.operators.similarity import UNIT_ITEMS, block_of, pair_tallies, unit_blocks


def sittings(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Rows (student_id, exam_id, seq, last): the exams of each student, numbered from 0 in exam order."""
    own = W.partitionBy("student_id")
    return (
        df.select("student_id", "exam_id")
        .distinct()
        .withColumn("seq", F.row_number().over(own.orderBy(*sort_keys(order))) - 1)
        .withColumn("last", F.max("seq").over(own))
    )


def item_sittings(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct (student_id, exam_id, rubric_item) with the place of the exam among the student's own."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("student_id", "exam_id")]
    items = df.select(*ids, clean(F.col("rubric_item")).alias("rubric_item")).distinct()
    return items.join(sittings(items, order), ["student_id", "exam_id"])


def trajectory(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Per item: how often it was followed by another exam, repeated there or dropped, and how often it emerged."""
    own = W.partitionBy("student_id", "rubric_item").orderBy("seq")
    seq = F.col("seq")
    steps = item_sittings(df, order).select(
        "rubric_item",
        (seq < F.col("last")).alias("_followed"),
        F.coalesce(F.lead("seq").over(own) == seq + 1, F.lit(False)).alias("_repeated"),
        ((seq > 0) & F.coalesce(F.lag("seq").over(own) != seq - 1, F.lit(True))).alias("_emerged"),
    )
    out = steps.groupBy("rubric_item").agg(
        F.count_if("_followed").alias("followed"),
        F.count_if("_repeated").alias("repeated"),
        (F.count_if("_followed") - F.count_if("_repeated")).alias("dropped"),
        F.count_if("_emerged").alias("emerged"),
    )
    share = F.nullif(F.col("followed"), F.lit(0))
    return out.withColumns(
        {"persistence_share": F.col("repeated") / share, "drop_off_share": F.col("dropped") / share}
    ).orderBy("rubric_item")


@dataclass(frozen=True)
class _Steps:
    """Numbered items (rubric_item, item_no) and the sides of each step from an exam to the next (…, item_no, source).

    ``support`` has for each item how often it is a source (occasions) and a target (appearances).
    """

    items: DataFrame
    sides: DataFrame
    support: DataFrame


def _steps(df: DataFrame, order: Sequence[str] | None) -> _Steps:
    steps = materialize(item_sittings(df, order))
    items = materialize(ordinals(steps.select("rubric_item").distinct(), "rubric_item", "item_no"))
    placed = steps.join(items, "rubric_item")
    seq = F.col("seq")
    sides = placed.select(
        "student_id",
        "item_no",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(seq < F.col("last"), F.struct(seq.alias("step"), F.lit(True).alias("source"))),
                    F.when(seq > 0, F.struct((seq - 1).alias("step"), F.lit(False).alias("source"))),
                )
            )
        ).alias("side"),
    ).select("student_id", "item_no", "side.*")
    sides = materialize(sides)
    support = sides.groupBy("item_no").agg(
        F.count_if("source").alias("occasions"), F.count_if(~F.col("source")).alias("appearances")
    )
    return _Steps(items, sides, materialize(support))


def _tallied(steps: _Steps, sides: DataFrame) -> DataFrame:
    counts = pair_tallies(_step_units(sides), ordered=True)
    source = steps.items.select(F.col("item_no").alias("a"), F.col("rubric_item").alias("source"))
    target = steps.items.select(F.col("item_no").alias("b"), F.col("rubric_item").alias("target"))
    occasions = steps.support.select(F.col("item_no").alias("a"), "occasions")
    return (
        counts.join(source, "a")
        .join(target, "b")
        .join(occasions, "a")
        .select("source", "target", F.col("n").alias("count"), (F.col("n") / F.col("occasions")).alias("conditional_prob"))
        .orderBy(F.desc("count"), F.desc("conditional_prob"), "source", "target")
    )


def transitions(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Rows (source, target, count, conditional_prob) over consecutive exams, most frequent first.

    A unit is one student's step from an exam to the next; its item pairs are tallied, never listed.
    """
    steps = _steps(df, order)
    return _tallied(steps, steps.sides)


def top_transitions(df: DataFrame, order: Sequence[str] | None = None, n: int = 20) -> DataFrame:
    """The first ``n`` transitions, the probability rounded to 3 places.

    A count is at most the occasions of its source and the appearances of its target. The pairs of the few most
    frequent items give a count that ``n`` pairs reach; items that cannot reach it are left out of the tally.
    """
    steps = _steps(df, order)
    top = _tallied(steps, _sides_reaching(steps, _reached(steps, n))).limit(n)
    return top.withColumn("conditional_prob", F.bround("conditional_prob", 3))


def _reached(steps: _Steps, n: int) -> int:
    """A count that at least ``n`` transitions reach, from those of the 2 n most frequent sources and targets; else 0."""
    often = [steps.support.orderBy(F.desc(c), "item_no").limit(2 * n).select("item_no") for c in ("occasions", "appearances")]
    sides = [
        steps.sides.filter(side).join(F.broadcast(items), "item_no", "left_semi").select(*steps.sides.columns)
        for side, items in zip(("source", "not source"), often)
    ]
    counts = pair_tallies(_step_units(sides[0].unionByName(sides[1])), ordered=True)
    best = [row["n"] for row in counts.orderBy(F.desc("n")).limit(n).select("n").collect()]  # at most n
    return best[-1] if len(best) == n else 0


def _sides_reaching(steps: _Steps, count: int) -> DataFrame:
    """The sides of items that can be in a transition of this count."""
    enough = F.when(F.col("source"), F.col("occasions")).otherwise(F.col("appearances")) >= count
    return steps.sides.join(steps.support, "item_no").filter(enough).select(*steps.sides.columns)


def _step_units(sides: DataFrame) -> DataFrame:
    """One unit per step; a step with many items on a side is split into tiles of item blocks.

    As with pairs of items, the rows of large steps are dealt out before and after they are copied to tiles.
    """
    step = ["student_id", "step"]
    source = F.col("source")
    both = [
        F.collect_list(F.when(source, F.col("item_no"))).alias("left"),
        F.collect_list(F.when(~source, F.col("item_no"))).alias("right"),
    ]
    large = (
        sides.groupBy(*step)
        .agg(F.count_if("source").alias("_l"), F.count_if(~source).alias("_r"))
        .filter((F.col("_l") > UNIT_ITEMS) | (F.col("_r") > UNIT_ITEMS))
        .select(*step, unit_blocks(F.col("_l")).alias("_lb"), unit_blocks(F.col("_r")).alias("_rb"))
    )
    sized = sides.join(large, step, "left")
    whole = sized.filter(F.col("_lb").isNull()).groupBy(*step).agg(*both)
    one = F.lit(1)
    mine = F.greatest(F.when(source, F.col("_lb")).otherwise(F.col("_rb")), one)
    others = F.greatest(F.when(source, F.col("_rb")).otherwise(F.col("_lb")), one)
    own, other = F.col("_own"), F.col("_other")
    tiled = (
        sized.filter(F.col("_lb").isNotNull())
        .repartition(*step, "item_no")
        .withColumn("_own", block_of(F.col("item_no"), mine))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
        .withColumns({"_lt": F.when(source, own).otherwise(other), "_rt": F.when(source, other).otherwise(own)})
        .repartition(*step, "_lt", "_rt")
        .groupBy(*step, "_lt", "_rt")
        .agg(*both)
    )
    units = whole.select("left", "right").unionByName(tiled.select("left", "right"))
    return units.select("left", "right", F.lit(False).alias("same"), F.lit(1).cast("bigint").alias("weight"))
