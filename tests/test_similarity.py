import random
from itertools import combinations

import pytest

from conftest import tuples
from redpencil.operators import similarity, trajectory


def brute_pairs(rows, min_support=2):
    have = {}
    for student, item in rows:
        have.setdefault(item, set()).add(student)
    items = sorted(i for i, s in have.items() if len(s) >= min_support)
    out = {}
    for a, b in combinations(items, 2):
        both, either = len(have[a] & have[b]), len(have[a] | have[b])
        out[a, b] = (both / either, both / (len(have[a]) * len(have[b])) ** 0.5, both)
    return have, items, out


def brute_clusters(rows, jaccard, corr):
    have, items, pairs = brute_pairs(rows)
    group = {i: {i} for i in items}
    for (a, b), (j, c, _) in pairs.items():
        if (j >= jaccard or c >= corr) and group[a] is not group[b]:
            merged = group[a] | group[b]
            for i in merged:
                group[i] = merged
    found = sorted({min(g): sorted(g) for g in group.values()}.values())
    return [
        (f"Misconception {n}", item, len(g), len(set().union(*(have[i] for i in g))))
        for n, g in enumerate(found, 1)
        for item in g
    ]


@pytest.fixture(scope="module")
def crowd():
    """A few students have nearly all items, one of them a third of all rows; the others have a handful."""
    rng = random.Random(7)
    items = [f"item {i:03d}" for i in range(90)]
    rows = {(f"s{s}", rng.choice(items[:60])) for s in range(40) for _ in range(rng.randint(1, 4))}
    rows |= {("hot", i) for i in items[:75]} | {("warm", i) for i in items[10:50]}
    rows |= {("pair", items[88]), ("pair2", items[88]), ("pair", items[89]), ("pair2", items[89])}
    return sorted(rows)


@pytest.fixture(params=[512, 7])
def unit_items(request, monkeypatch):
    """The small bound splits the large students into many tiles."""
    monkeypatch.setattr(similarity, "UNIT_ITEMS", request.param)
    monkeypatch.setattr(trajectory, "UNIT_ITEMS", request.param)
    return request.param


def test_all_pairs(spark, crowd, unit_items):
    df = spark.createDataFrame(crowd * 2, "student_id string, rubric_item string")
    expected = brute_pairs(crowd)[2]
    got = {r[:2]: r[2:] for r in tuples(similarity.pair_similarity(df))}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k]) for k in expected)
    assert 0 in {v[2] for v in expected.values()}
    overlapping = {r[:2] for r in tuples(similarity.overlapping_pairs(df))}
    assert overlapping == {k for k, v in expected.items() if v[2]}


def test_top_pairs_and_edges(spark, crowd, unit_items):
    df = spark.createDataFrame(crowd, "student_id string, rubric_item string")
    pairs = brute_pairs(crowd)[2]
    ranked = sorted(pairs, key=lambda k: (-pairs[k][0], k))
    assert [r[:2] for r in tuples(similarity.top_pairs(df, 15))] == ranked[:15]
    near = {k for k, v in pairs.items() if v[0] >= 0.2 or v[1] >= 0.3}
    assert {r[:2] for r in tuples(similarity.similarity_edges(df))} == near
    assert similarity.similarity_edges(df, 0.0, 2.0).count() == len(pairs)


def test_top_pairs_fill_up_with_pairs_without_overlap(spark):
    rows = [(f"s{i}{c}", f"item {i:02d}") for i in range(30) for c in "ab"] + [("both", "item 28"), ("both", "item 29")]
    df = spark.createDataFrame(rows, "student_id string, rubric_item string")
    pairs = brute_pairs(rows)[2]
    ranked = sorted(pairs, key=lambda k: (-pairs[k][0], k))
    assert [r[:2] for r in tuples(similarity.top_pairs(df, 12))] == ranked[:12]


@pytest.mark.parametrize(("jaccard", "corr"), [(0.2, 0.3), (0.34, 2.0), (0.9, 0.95)])
def test_clusters(spark, crowd, jaccard, corr):
    df = spark.createDataFrame(crowd, "student_id string, rubric_item string")
    assert tuples(similarity.misconception_clusters(df, jaccard, corr)) == brute_clusters(crowd, jaccard, corr)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(1, 301).withColumnRenamed("id", "item_no")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(250, 300)], "a bigint, b bigint")
    got = dict(tuples(similarity.connected_components(nodes, edges)))
    assert all(got[i] == 1 for i in range(1, 201)) and got[300] == 250 and got[240] == 240


def test_tallies_of_units(spark):
    units = [([3, 1, 2], [], True, 1), ([1, 5], [2, 9], False, 1), ([], [4], False, 1), ([2, 1], [], True, 0), ([7, 8], [], True, 0)]
    df = spark.createDataFrame(units, "left array<bigint>, right array<bigint>, same boolean, weight bigint")
    total = {r[:2]: r[2] for r in tuples(similarity.pair_tallies(df, ordered=False))}
    assert total == {(1, 3): 1, (2, 3): 1, (1, 2): 2, (1, 9): 1, (2, 5): 1, (5, 9): 1, (7, 8): 0}
    assert (5, 2) in {r[:2] for r in tuples(similarity.pair_tallies(df, ordered=True))}


def test_too_little_support(spark, sample):
    few = sample.filter("student_id in ('u1', 'u5')")
    assert similarity.item_support(few).count() == 0
    assert similarity.pair_similarity(few).count() == 0
    assert similarity.misconception_clusters(few).count() == 0
    assert similarity.item_support(few, 1).count() == 3


def test_transitions_and_trajectory(spark, unit_items):
    rng = random.Random(3)
    rows = sorted({(f"s{s}", f"E{e}", f"i{rng.randint(0, 25):02d}") for s in range(12) for e in range(4) for _ in range(rng.choice([0, 2, 5, 20]))})
    df = spark.createDataFrame(rows, "student_id string, exam_id string, rubric_item string")
    seen = {}
    for s, e, i in rows:
        seen.setdefault(s, {}).setdefault(e, set()).add(i)
    count, occasions, fate = {}, {}, {}
    for exams in seen.values():
        order = sorted(exams)
        for k, e in enumerate(order):
            for i in exams[e]:
                f = fate.setdefault(i, [0, 0, 0, 0])
                f[3] += k > 0 and i not in exams[order[k - 1]]
                if k + 1 < len(order):
                    occasions[i] = occasions.get(i, 0) + 1
                    after = exams[order[k + 1]]
                    f[0] += 1
                    f[1] += i in after
                    f[2] += i not in after
                    for j in after:
                        count[i, j] = count.get((i, j), 0) + 1
    got = {r[:2]: r[2:] for r in tuples(trajectory.transitions(df))}
    assert got == {k: (n, n / occasions[k[0]]) for k, n in count.items()}
    assert {r[0]: list(r[1:5]) for r in tuples(trajectory.trajectory(df))} == fate
    ranked = sorted(count, key=lambda k: (-count[k], -count[k] / occasions[k[0]], k))
    for n in (1, 5):
        assert [r[:2] for r in tuples(trajectory.top_transitions(df, n=n))] == ranked[:n]


def test_top_transitions_tally_only_items_that_can_reach_the_count(spark):
    rows = [(f"s{s}", e, i) for s in range(20) for e, i in (("E1", "often"), ("E2", "after"), ("E2", f"rare {s}"))]
    df = spark.createDataFrame(rows, "student_id string, exam_id string, rubric_item string")
    steps = trajectory._steps(df, None)
    assert trajectory._reached(steps, 1) == 20 and trajectory._reached(steps, 1000) == 0
    kept = trajectory._sides_reaching(steps, 20).join(steps.items, "item_no").select("rubric_item").distinct()
    assert {r[0] for r in tuples(kept)} == {"often", "after"}
    assert tuples(trajectory.top_transitions(df, n=1)) == [("often", "after", 20, 1.0)]


def test_few_candidates_of_items_that_frequent_students_share(spark):
    """Two students with all items make every pair overlap; the edges are those of the items in twos."""
    rows = {(f"hot {h}", f"item {i:03d}") for h in range(2) for i in range(120)}
    rows |= {(f"s{i // 2}.{k}", f"item {i:03d}") for i in range(120) for k in range(12)}
    df = spark.createDataFrame(sorted(rows), "student_id string, rubric_item string")
    data = similarity.supported_incidence(df)
    candidates = similarity._candidates(data.placed, similarity._Bounds(0.5, 0.6))
    pairs = brute_pairs(rows)[2]
    near = {k for k, v in pairs.items() if v[0] >= 0.5 or v[1] >= 0.6}
    assert len(pairs) == 120 * 119 // 2 and len(near) == 60
    assert candidates.count() == 60
    assert {r[:2] for r in tuples(similarity.similarity_edges(df, 0.5, 0.6))} == near


@pytest.mark.parametrize(("jaccard", "corr"), [(0.5, 0.7), (1.0, 1.0), (0.05, 0.1), (3.0, 0.5)])
def test_edges_over_chunks_of_students(spark, monkeypatch, jaccard, corr):
    """Items of very different sizes, counted beyond their prefixes in many chunks; a null student is one student."""
    monkeypatch.setattr(similarity, "CHUNK_STUDENTS", 5)
    rng = random.Random(5)
    rows = {(s, f"item {i:02d}") for i in range(25) for s in rng.sample(range(60), rng.choice([2, 3, 10, 40, 58]))}
    rows |= {(s, "twin a") for s in range(30)} | {(s, "twin b") for s in range(30)}
    named = sorted((None if s == 7 else f"s{s:02d}", i) for s, i in rows if s != 7) + [(None, i) for s, i in rows if s == 7]
    df = spark.createDataFrame(named, "student_id string, rubric_item string")
    pairs = brute_pairs(named)[2]
    near = {k: v for k, v in pairs.items() if v[0] >= jaccard or v[1] >= corr}
    got = {r[:2]: r[2:] for r in tuples(similarity.similarity_edges(df, jaccard, corr))}
    assert got.keys() == near.keys() and all(got[k] == pytest.approx(near[k]) for k in near)


def test_top_pairs_end_with_the_first_band_that_holds_them(spark, monkeypatch):
    rows = [(f"s{i // 2}{c}", f"item {i:02d}") for i in range(20) for c in "abc"] + [("all", f"item {i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "student_id string, rubric_item string")
    pairs = brute_pairs(rows)[2]
    ranked = sorted(pairs, key=lambda k: (-pairs[k][0], k))
    read = []
    bounds = similarity._Bounds
    monkeypatch.setattr(similarity, "_Bounds", lambda j, c: read.append(j) or bounds(j, c))
    assert [r[:2] for r in tuples(similarity.top_pairs(df, 8))] == ranked[:8] and read == [0.5]
    read.clear()
    assert [r[:2] for r in tuples(similarity.top_pairs(df, 15))] == ranked[:15] and read == [0.5, 0.2]


def test_prefixes_only_where_they_leave_out_most_pairs(spark, monkeypatch):
    """Students with equally many items: prefixes would hold most pairs, and all are tallied. Frequent students: prefixes."""
    rng = random.Random(9)
    even = {(f"s{s}", f"item {i:02d}") for s in range(40) for i in rng.sample(range(30), 12)}
    hot = {(f"s{i // 2}.{k}", f"item {i:02d}") for i in range(30) for k in range(12)} | {(f"hot {h}", f"item {i:02d}") for h in range(4) for i in range(30)}
    tallied = []
    tally = similarity._pair_counts
    monkeypatch.setattr(similarity, "_pair_counts", lambda rows: tallied.append(True) or tally(rows))
    for rows, whole in ((even, True), (hot, False)):
        df = spark.createDataFrame(sorted(rows), "student_id string, rubric_item string")
        pairs = brute_pairs(rows)[2]
        tallied.clear()
        near = {k for k, v in pairs.items() if v[0] >= 0.4}
        assert {r[:2] for r in tuples(similarity.similarity_edges(df, 0.4, 2.0))} == near and bool(tallied) == whole
        ranked = sorted(pairs, key=lambda k: (-pairs[k][0], k))
        assert [r[:2] for r in tuples(similarity.top_pairs(df, 10))] == ranked[:10]
