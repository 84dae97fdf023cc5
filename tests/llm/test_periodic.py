"""Runs against a brute-force search by definition, and the defined handling of odd rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redpencil.llm import periodic_runs
from redpencil.llm.periodic_runs import find_runs, periodic_tail


def brute(words):
    """(start, length, period) of all runs, straight from the definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(6, 4 * q) and (at, length) not in found:
                found[at, length] = q  # periods rise, so the first one is the smallest
            at = end + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def runs_of(words):
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    return [tuple(r) for r in find_runs(ids, len(words)).tolist()] if words else []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120))
def test_two_words(words):
    assert runs_of(words) == brute(words)


@pytest.mark.parametrize("seed", range(60))
def test_planted(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 8)):
        part = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 40))]
        words += part * rng.randrange(1, 9) + part[: rng.randrange(len(part) + 1)]
    assert runs_of(words) == brute(words)


def test_fibonacci_and_powers():
    a, b = "a", "ab"
    for _ in range(10):
        a, b = b, b + a
    for words in (list(b), list("ab" * 200), ["x"] * 500, list("abaab" * 60 + "abaababaab" * 20)):
        assert runs_of(words) == brute(words)


def test_seeds_of_a_long_run_are_extended_once(monkeypatch):
    calls = []
    real = periodic_runs._agreeing
    monkeypatch.setattr(periodic_runs, "_agreeing", lambda a, b: calls.append(1) or real(a, b))
    assert runs_of(list("abc") * 20_000) == [(0, 60_000, 3)]
    assert len(calls) <= 4


def test_bands_guarantee_the_gram():
    seen = []
    for a, b, k in periodic_runs.bands(100_000):
        assert 2 * (b - 1) <= k == 3 * a
        seen += range(a, b)
    assert seen[:20_000] == list(range(1, 20_001))


def collapsed_by_hand(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_report(spark):
    rng = random.Random(5)
    texts = {k: " ".join(rng.choice("abA") for _ in range(rng.randrange(0, 200))) for k in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in periodic_runs.report(docs).collect()}
    assert set(got) == set(texts)
    tails = 0
    for k, text in texts.items():
        words = [w.decode() for w in periodic_tail(k, text.encode().split())]
        tails += words != text.split()
        runs = brute(words)
        row = got[k]
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
        if runs:
            best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0]
            assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        else:
            assert row["start"] is None and row["exponent_milli"] is None
    assert tails > 5


def test_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs.periodic_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_key = {(r["doc_id"], r["n_words"]): r for r in rows}
    for key in ((3, 0), (4, 0), (5, 0), (None, 0)):
        assert by_key[key]["runs"] == [] and by_key[key]["collapsed"] == "" and by_key[key]["start"] is None
    assert by_key[6, 60_000]["n_words"] == 60_000
    assert by_key[9, 5]["collapsed"] == "ßé ñ 漢字 \U0001f600 word"
    assert periodic_runs.report(no_docs).collect() == []


def test_long_periodic_text(spark):
    text = " ".join(["x", *[str(k % 7919) for k in range(7919 * 5)], "y"])
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = periodic_runs.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 7919 * 5, 7919)]
    assert row["collapsed"].split() == ["x", *map(str, range(7919)), "y"]
