"""Risk that a student shows a rubric item in the next exam, by logistic regression.

The reference has one row per (student, exam, item), for every item there is. Nearly all of those rows say
"not seen, not repeated", so the work is done on a compact frame that is exactly equivalent: the rows of
items a student has shown are listed one by one, and all the others are counted, once per concept with
points and once for the rest. ``n_items`` is the number of reference rows a compact row stands for; the fit
uses it as a weight. Null student and exam ids are blank ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.functions.text import clean
from redpencil.operators.shared import materialize
from redpencil.operators.trajectory import sittings

# Feature names, confidence thresholds and the messages for data that cannot be fitted.
FEATURES = ["prior_seen", "prior_concept_points"]
HIGH, MEDIUM = 0.7, 0.4
NO_HISTORY = "No student sat two exams, so there is nothing to fit."
ONE_CLASS = "Every item was repeated, or none was, so no model can be fitted."
NOT_CONVERGED = "The fit did not converge, so its coefficients are not used."
# Newton's method: most steps and most halvings of one, and the change of a typical row's margin that ends it.
STEPS, HALVINGS, SMALL = 50, 40, 1e-10
# Share of the loss by which sums over the same rows may differ.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Fitted:
    intercept: float
    coefficients: tuple[float, float]


@dataclass(frozen=True)
class RiskModel:
    model: Fitted | None
    warning: str | None

    def coefficients(self, like: DataFrame) -> DataFrame:
        """Rows (feature, coefficient)."""
        rows = [] if self.model is None else list(zip(FEATURES, self.model.coefficients))
        return like.sparkSession.createDataFrame(rows, "feature string, coefficient double")

    def probability(self) -> Column:
        if self.model is None:
            return F.lit(None).cast("double")
        return _chance(self.model.intercept, *self.model.coefficients)


@dataclass(frozen=True)
class RiskBase:
    """What all frames are made from, each part computed once.

    ``history`` has points and rows per (student, exam, item, concept); ``seq`` is the place of the exam among the
    student's own, ``last`` the last such place. ``catalogue`` has every item with its most frequent concept.
    """

    history: DataFrame
    catalogue: DataFrame
    n_items: int


def risk_base(df: DataFrame, order: Sequence[str] | None = None) -> RiskBase:
    concept = clean(F.col("concept")) if "concept" in df.columns else F.lit("")
    facts = (
        df.select(
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("student_id", "exam_id")],
            clean(F.col("rubric_item")).alias("rubric_item"),
            concept.alias("concept"),
            F.coalesce(F.col("points_lost").cast("double"), F.lit(0.0)).alias("points_lost"),
        )
        .groupBy("student_id", "exam_id", "rubric_item", "concept")
        .agg(F.sum("points_lost").alias("points"), F.count("*").alias("n"))
    )
    # A student's exams are numbered as (student, exam) pairs and joined back, so that no task gets all rows of a student.
    # Both sides are stored, as only joins of plain shuffles are split where a student holds many rows.
    facts = materialize(facts)
    history = materialize(facts.join(materialize(sittings(facts, order)), ["student_id", "exam_id"]))
    catalogue = materialize(_modes(history.groupBy("rubric_item", "concept").agg(F.sum("n").alias("n"))))
    return RiskBase(history, catalogue, catalogue.count())


def item_concept_mode(df: DataFrame) -> DataFrame:
    """The most frequent concept of each rubric item, the smallest one on ties."""
    concept = clean(F.col("concept")).alias("concept")
    items = df.select(clean(F.col("rubric_item")).alias("rubric_item"), concept)
    return _modes(items.groupBy("rubric_item", "concept").agg(F.count("*").alias("n")))


def risk_train(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Training rows for the exams of a student after the first; unlisted items are counted in ``n_items``.

    Rows that stand for unlisted items have no rubric_item, and a concept only where the student has points in it.
    """
    return _compact(risk_base(df, order), "train")


def risk_score_frame(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Scoring rows, as things stood before a student's last exam, in the form of the training rows."""
    return _compact(risk_base(df, order), "score").drop("label")


def risk_train_weights(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """How many training rows share each combination of features and label."""
    return _weights(risk_base(df, order))


def fit_risk_model(df: DataFrame, order: Sequence[str] | None = None) -> RiskModel:
    return _fit(risk_base(df, order))


def risk_coefficients(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    return fit_risk_model(df, order).coefficients(df)


def risk_scores(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The scoring rows with probability and confidence; no rows when no model can be fitted."""
    base = risk_base(df, order)
    return _scored(_compact(base, "score").drop("label"), _fit(base))


def top_risks(df: DataFrame, order: Sequence[str] | None = None, n: int = 50) -> DataFrame:
    """The n highest risks, probability rounded to 3 places, ties by student and item.

    The compact rows tell which students can be among them: the first n (probability, student) groups
    hold at least n rows. Only for those at most n students every item gets a row.
    """
    base = risk_base(df, order)
    model = _fit(base)
    risk = F.bround("probability", 3)
    groups = (
        _scored(_compact(base, "score"), model)
        .select(risk.alias("probability"), "student_id")
        .distinct()
        .orderBy(F.desc("probability"), "student_id")
        .limit(n)
    )
    students = sorted({row["student_id"] for row in groups.collect()})  # at most n
    full = _scored(_every_item(base, students), model)
    return full.withColumn("probability", risk).orderBy(F.desc("probability"), "student_id", "rubric_item").limit(n)


def confidence(probability: Column) -> Column:
    return F.when(probability >= HIGH, "high").when(probability >= MEDIUM, "medium").otherwise("low")


def _margin(intercept: float, seen: float, points: float) -> Column:
    return F.lit(intercept) + F.lit(seen) * F.col(FEATURES[0]) + F.lit(points) * F.col(FEATURES[1])


def _chance(intercept: float, seen: float, points: float) -> Column:
    return 1 / (1 + F.exp(-_margin(intercept, seen, points)))


def _weights(base: RiskBase) -> DataFrame:
    return _compact(base, "train").groupBy(*FEATURES, "label").agg(F.sum("n_items").alias("n_rows"))


def _fit(base: RiskBase) -> RiskModel:
    """Logistic regression with a unit L2 penalty on the slopes, by Newton's method with step halving.

    The rows are reduced to distinct feature combinations with counts. One aggregate over these gives the penalised
    loss with its gradient and curvature at a point. A step that raises the loss is halved until it does not.
    """
    weights = materialize(_weights(base))
    size = weights.agg(F.sum("n_rows").alias("rows"), F.count_distinct("label").alias("classes")).first()
    if not size["rows"]:
        return RiskModel(None, NO_HISTORY)
    if size["classes"] < 2:
        return RiskModel(None, ONE_CLASS)
    here = _loss_at(weights, np.zeros(3))
    for _ in range(STEPS):
        try:
            step = np.linalg.solve(here.curvature, here.gradient)
        except np.linalg.LinAlgError:
            break
        # Features differ in scale, so a step counts by what it changes for a row of typical features.
        typical = np.sqrt(np.diag(here.curvature) / here.curvature[0, 0])
        for _ in range(HALVINGS):
            there = _loss_at(weights, here.at - step)
            if there.loss <= here.loss + ROUNDING * abs(here.loss):
                break
            step = step / 2
        else:
            break
        here = there
        if (np.abs(step) * typical).max() < SMALL:
            intercept, *slopes = map(float, here.at)
            return RiskModel(Fitted(intercept, tuple(slopes)), None)
    return RiskModel(None, NOT_CONVERGED)


@dataclass(frozen=True)
class _Loss:
    at: np.ndarray
    loss: float
    gradient: np.ndarray
    curvature: np.ndarray


def _loss_at(weights: DataFrame, at: np.ndarray) -> _Loss:
    """Penalised negative log-likelihood of the counted rows at a point, with its derivatives, in one aggregate."""
    x, n, penalty = [F.lit(1.0), *map(F.col, FEATURES)], F.col("n_rows"), np.diag([0.0, 1.0, 1.0])
    point = list(map(float, at))
    margin, p = _margin(*point), _chance(*point)
    loss = n * (F.greatest(margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin))) - F.col("label") * margin)
    off, slope = n * (p - F.col("label")), n * p * (1 - p)
    total, *sums = weights.agg(
        F.sum(loss), *[F.sum(off * a) for a in x], *[F.sum(slope * a * b) for a in x for b in x]
    ).first()
    return _Loss(
        at, total + at @ penalty @ at / 2, np.array(sums[:3]) + penalty @ at, np.array(sums[3:]).reshape(3, 3) + penalty
    )


def _scored(frame: DataFrame, model: RiskModel) -> DataFrame:
    scored = frame.withColumn("probability", model.probability())
    scored = scored.withColumn("confidence", confidence(F.col("probability")))
    return scored if model.model is not None else scored.filter(F.lit(False))


def _modes(counts: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("_n"), F.col("concept")))
    return counts.groupBy("rubric_item").agg(best["concept"].alias("concept"))


def _targets(history: DataFrame, which: str) -> DataFrame:
    """The (student, exam) pairs that need rows."""
    due = F.col("seq") > 0 if which == "train" else F.col("seq") == F.col("last")
    return history.filter(due).select("student_id", "exam_id", "seq").distinct()


def _span(first: Column, which: str) -> Column:
    """The exams from ``first`` on that need a row: all after the student's first one, or the last one alone."""
    last = F.col("last")
    low = F.greatest(first, F.lit(1)) if which == "train" else F.greatest(first, last)
    return F.when(low <= last, F.sequence(low, last))


def _listed(history: DataFrame, which: str) -> DataFrame:
    """Rows (student_id, seq, rubric_item, prior_seen, label) of the items a student has shown so far.

    ``at`` holds the exams in which the student showed the item, so it is no longer than the exam list.
    """
    shown = history.groupBy("student_id", "rubric_item").agg(
        F.collect_set("seq").alias("at"), F.min("seq").alias("first"), F.max("last").alias("last")
    )
    rows = shown.withColumn("target", F.explode(_span(F.col("first"), which)))
    return rows.select(
        "student_id",
        F.col("target").alias("seq"),
        "rubric_item",
        (F.col("first") < F.col("target")).cast("int").alias("prior_seen"),
        F.array_contains("at", F.col("target")).cast("int").alias("label"),
    )


def _concept_points(history: DataFrame, which: str) -> DataFrame:
    """Rows (student_id, seq, concept, prior_concept_points): points lost in the concept before exam ``seq``."""
    own = W.partitionBy("student_id", "concept").orderBy("seq")
    totals = (
        history.filter(F.col("concept") != "")
        .groupBy("student_id", "concept", "seq")
        .agg(F.sum("points").alias("_points"), F.max("last").alias("last"))
        .withColumn("prior_concept_points", F.sum("_points").over(own.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_until", F.coalesce(F.lead("seq").over(own), F.col("last")))
    )
    # A running total holds from the next exam until the concept costs points again.
    low = F.col("seq") + 1 if which == "train" else F.greatest(F.col("seq") + 1, F.col("last"))
    rows = totals.withColumn("_target", F.explode(F.when(low <= F.col("_until"), F.sequence(low, F.col("_until")))))
    return rows.select("student_id", F.col("_target").alias("seq"), "concept", "prior_concept_points")


def _compact(base: RiskBase, which: str) -> DataFrame:
    """The rows of a frame, from one shuffle of three kinds of rows by (student, exam): such a group is no larger than the catalogue.

    Listed rows take the points of their concept's row. A concept's row counts its items that are not listed, and the
    row of the exam itself all items that the others do not account for.
    """
    history, nothing = base.history, F.lit(None)
    sizes = base.catalogue.groupBy("concept").agg(F.count("*").alias("_size"))
    states = _concept_points(history, which).join(sizes, "concept")
    listed = _listed(history, which).join(base.catalogue, "rubric_item")

    def rows(kind: DataFrame, **own: Column) -> DataFrame:
        columns = {
            "student_id": F.col("student_id"),
            "seq": F.col("seq"),
            "rubric_item": nothing.cast("string"),
            "concept": nothing.cast("string"),
            "prior_seen": F.lit(0),
            "prior_concept_points": nothing.cast("double"),
            "label": F.lit(0),
            "exam_id": nothing.cast("string"),
            "_size": nothing.cast("bigint"),
            "_listed": F.lit(False),
        }
        return kind.select(*[value.alias(name) for name, value in (columns | own).items()])

    same = {c: F.col(c) for c in ("rubric_item", "concept", "prior_seen", "prior_concept_points", "label", "exam_id", "_size")}
    pick = lambda *names: {c: same[c] for c in names}
    every = (
        rows(listed, **pick("rubric_item", "concept", "prior_seen", "label"), _listed=F.lit(True))
        .unionByName(rows(states, **pick("concept", "prior_concept_points", "_size")))
        .unionByName(rows(_targets(history, which), **pick("exam_id")))
        .repartition("student_id", "seq")
    )
    exam, own = W.partitionBy("student_id", "seq"), W.partitionBy("student_id", "seq", "concept")
    is_listed, points, size = F.col("_listed"), F.col("prior_concept_points"), F.col("_size")
    held = every.withColumns(
        {
            "_points": F.max("prior_concept_points").over(own),
            "_n": F.count_if("_listed").over(own),
        }
    )
    accounted = F.when(is_listed, F.when(F.col("_points").isNull(), 1).otherwise(0)).otherwise(F.coalesce(size, F.lit(0)))
    known = held.withColumns(
        {"_accounted": F.sum(accounted.cast("bigint")).over(exam), "exam_id": F.max("exam_id").over(exam)}
    )
    count = (
        F.when(is_listed, F.lit(1))
        .when(size.isNotNull(), size - F.col("_n"))
        .otherwise(F.lit(base.n_items) - F.col("_accounted"))
    )
    return known.select(
        "student_id",
        "rubric_item",
        "concept",
        "prior_seen",
        F.coalesce(F.when(is_listed, F.col("_points")).otherwise(points), F.lit(0.0)).alias("prior_concept_points"),
        "label",
        count.cast("bigint").alias("n_items"),
        "exam_id",
    ).filter(F.col("n_items") > 0)


def _every_item(base: RiskBase, students: Sequence[str]) -> DataFrame:
    """Scoring rows of a bounded list of students with a row for every item there is."""
    if not students:
        return base.catalogue.select(F.lit("").alias("student_id"), "rubric_item", F.lit(0).alias(FEATURES[0]), F.lit(0.0).alias(FEATURES[1])).limit(0)
    history = base.history.filter(F.col("student_id").isin(list(students)))
    grid = base.catalogue.withColumn("student_id", F.explode(F.array(*map(F.lit, students))))
    seen = _listed(history, "score").select("student_id", "rubric_item", "prior_seen")
    points = _concept_points(history, "score").select("student_id", "concept", "prior_concept_points")
    return (
        grid.join(seen, ["student_id", "rubric_item"], "left")
        .join(points, ["student_id", "concept"], "left")
        .select(
            "student_id",
            "rubric_item",
            F.coalesce("prior_seen", F.lit(0)).alias("prior_seen"),
            F.coalesce("prior_concept_points", F.lit(0.0)).alias("prior_concept_points"),
        )
    )
