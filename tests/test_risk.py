import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import tuples
from redpencil.operators import concepts, risk

DDL = "student_id string, exam_id string, rubric_item string, points_lost double, concept string"


def brute(rows, order=None):
    """Training and scoring rows, one by one."""
    order = order or sorted({r[1] for r in rows})
    rank = lambda e: (order.index(e) if e in order else len(order), e)
    items, counts = sorted({r[2] for r in rows}), {}
    for _, _, item, _, concept in rows:
        counts.setdefault(item, {}).setdefault(concept, 0)
        counts[item][concept] += 1
    mode = {i: min(c, key=lambda k: (-c[k], k)) for i, c in counts.items()}
    train, score = {}, {}

    def state(prior, item):
        seen = int(any(r[2] == item for r in prior))
        points = sum(r[3] for r in prior if r[4] == mode[item]) if mode[item] else 0.0
        return seen, points

    for student in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == student]
        exams = sorted({r[1] for r in own}, key=rank)
        for k, exam in enumerate(exams):
            prior = [r for r in own if r[1] in exams[:k]]
            now = {r[2] for r in own if r[1] == exam}
            for item in items:
                if k:
                    train[student, exam, item] = (*state(prior, item), int(item in now))
                if exam == exams[-1]:
                    score[student, item] = state(prior, item)
    return train, score


def newton(train):
    """The penalised optimum by Newton's method."""
    x = np.array([(1.0, s, p) for s, p, _ in train.values()])
    y = np.array([label for *_, label in train.values()])
    w, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for s in range(25):
        for e in rng.sample(["E1", "E2", "E3", "E4"], rng.randint(1, 4)):
            for _ in range(rng.randint(1, 4)):
                item = rng.randint(0, 9)
                concept = rng.choice(["", "c9"]) if item == 9 else f"c{item % 3}" if rng.random() < 0.8 else "odd"
                out.append((f"s{s}", e, f"i{item}", float(rng.randint(0, 3)), concept))
    # One student holds a third of all rows.
    out += [("hot", f"E{1 + k % 4}", f"i{k % 8}", 1.0, "c1") for k in range(len(out) // 2)]
    return out


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, DDL)


def counted(pairs):
    """How often each key occurs."""
    out = {}
    for key, n in pairs:
        out[key] = out.get(key, 0) + n
    return out


@pytest.mark.parametrize("order", [None, ["E3", "E1", "E4"]])
def test_compact_frames_stand_for_every_row(data, rows, order):
    train, score = brute(rows, order)
    frame = risk.risk_train(data, order).cache()
    listed = frame.filter("rubric_item is not null").select("student_id", "exam_id", "rubric_item", *risk.FEATURES, "label")
    assert all(train[r[:3]] == r[3:] for r in tuples(listed))
    got = counted(((r.student_id, r.exam_id, r.prior_seen, r.prior_concept_points, r.label), r.n_items) for r in frame.collect())
    assert got == counted(((s, e, *features), 1) for (s, e, _), features in train.items())
    frame = risk.risk_score_frame(data, order)
    got = counted(((r.student_id, r.prior_seen, r.prior_concept_points), r.n_items) for r in frame.collect())
    assert got == counted(((s, *features), 1) for (s, _), features in score.items())
    weights = {r[:3]: r[3] for r in tuples(risk.risk_train_weights(data, order))}
    assert weights == counted((features, 1) for features in train.values())


def test_rows_without_ids_are_counted(spark, rows):
    some = [(None if s == "s1" else s, *rest) for s, *rest in rows]
    blank = [("" if s == "s1" else s, *rest) for s, *rest in rows]
    got = risk.risk_score_frame(spark.createDataFrame(some, DDL)).agg(F.sum("n_items")).first()[0]
    assert got == len(brute(blank)[1])


def test_model_and_scores(data, rows):
    train, score = brute(rows)
    w = newton(train)
    model = risk.fit_risk_model(data)
    assert model.warning is None
    assert [model.model.intercept, *model.model.coefficients] == pytest.approx(list(w), abs=1e-5)
    assert dict(tuples(risk.risk_coefficients(data))) == pytest.approx(dict(zip(risk.FEATURES, w[1:])), abs=1e-5)
    chance = {k: 1 / (1 + np.exp(-(w[0] + w[1] * s + w[2] * p))) for k, (s, p) in score.items()}
    for r in risk.risk_scores(data).collect():
        if r.rubric_item is not None:
            assert r.probability == pytest.approx(chance[r.student_id, r.rubric_item], abs=1e-6)
        assert r.confidence == ("high" if r.probability >= 0.7 else "medium" if r.probability >= 0.4 else "low")


@pytest.mark.parametrize("n", [1, 7, 50, 10_000])
def test_top_risks_equal_the_sorted_full_frame(data, rows, n):
    train, score = brute(rows)
    w = newton(train)
    full = [(round(1 / (1 + np.exp(-(w[0] + w[1] * s + w[2] * p))), 3), *k, s, p) for k, (s, p) in score.items()]
    expected = [(*k, s, p, c) for c, *k, s, p in sorted(full, key=lambda r: (-r[0], r[1], r[2]))[:n]]
    assert [r[:5] for r in tuples(risk.top_risks(data, n=n))] == expected


def test_sample_sizes(sample):
    data = concepts.apply_concepts(sample)
    assert risk.risk_train(data).agg(F.sum("n_items")).first()[0] == 30
    assert risk.risk_score_frame(data).agg(F.sum("n_items")).first()[0] == 25
    assert risk.item_concept_mode(data).count() == 5


def test_no_model(spark, sample):
    data = concepts.apply_concepts(sample)
    one_exam = data.filter("exam_id = 'Fall'")
    assert risk.fit_risk_model(one_exam).warning == risk.NO_HISTORY
    assert risk.risk_scores(one_exam).count() == 0 and risk.risk_coefficients(one_exam).count() == 0
    always = spark.createDataFrame([("s", e, "i", 1.0, "c") for e in ("E1", "E2")], DDL)
    assert risk.fit_risk_model(always).warning == risk.ONE_CLASS
    assert risk.top_risks(always).count() == 0


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_fit_on_any_scale_of_points(spark, rows, scale):
    data = spark.createDataFrame([(*r[:3], r[3] * scale, r[4]) for r in rows], DDL)
    model = risk.fit_risk_model(data).model
    weights = risk.risk_train_weights(data)
    found = risk._loss_at(weights, np.array([model.intercept, *model.coefficients]))
    # At the optimum the gradient vanishes, measured against the curvature along each feature.
    assert (np.abs(found.gradient) / np.sqrt(np.diag(found.curvature))).max() < 1e-6


def test_fit_of_separable_rows_and_of_too_few_steps(spark, monkeypatch):
    """An item is repeated exactly where it was seen before; only the penalty keeps the slope finite."""
    rows = [(f"s{s}", e, f"i{s % 2}", 1000.0, "c") for s in range(12) for e in ("E1", "E2")]
    data = spark.createDataFrame(rows, DDL)
    model = risk.fit_risk_model(data)
    assert model.warning is None and 0 < model.model.coefficients[0] < 50
    monkeypatch.setattr(risk, "STEPS", 1)
    assert risk.fit_risk_model(data).warning == risk.NOT_CONVERGED
    assert risk.risk_scores(data).count() == 0


def test_exams_of_a_hot_student_are_numbered_as_pairs(data):
    """No window is over the rows of a student: numbering takes one row for each exam."""
    history = risk.risk_base(data).history
    hot = history.filter("student_id = 'hot'")
    assert sorted({(r.exam_id, r.seq, r.last) for r in hot.collect()}) == [(f"E{k + 1}", k, 3) for k in range(4)]


def test_frames_take_one_shuffle_by_exam(spark, rows, capsys):
    """Listed rows, concepts and exams meet in one shuffle; they are not joined by (student, exam)."""
    base = risk.risk_base(spark.createDataFrame(rows, DDL))
    for which in ("train", "score"):
        risk._compact(base, which).explain()
        plan = capsys.readouterr().out
        assert "FullOuter" not in plan and "LeftOuter" not in plan
