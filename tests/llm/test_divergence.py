"""The source audit against a brute-force version, the iceberg search level by level, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from redpencil.llm import divergence
from redpencil.llm.divergence import SCALE, refined

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, ranks=200):
    docs = defaultdict(list)
    for _, text, lang, source in rows:
        docs[lang or ""].append((source or "", TERM.findall((text or "").translate(UPPER))))
    out = []
    share = lambda n, tokens, terms: 1 + SCALE * (n + 1) // (tokens + terms)
    gap = lambda p, q: (p - q) * (p - q) // q
    for lang, found in docs.items():
        seen = Counter(t for _, terms in found for t in set(terms))
        kept = [t for t, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for source, terms in found:
            counts[source].update(t for t in terms if seen[t] >= least)
        whole = sum(counts.values(), Counter())
        tokens = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: share(c[t], tokens[s], len(kept)) for t in kept} for s, c in counts.items()}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in counts:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def made(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(parts)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, docs=120):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("pre", "p", "über", "") for b in ("x", "yy", "Z") for c in ("", "q", "漢字", "longending")] + ["a" * 300, "a" * 301]
    text = lambda: " ".join(rng.choice(words) if rng.random() < 0.9 else f"once{''.join(rng.choices('abcdef', k=5))}" for _ in range(rng.randrange(30)))
    return [(k, text(), rng.choice(["en", "de"]), rng.choices(["s0", "s1", "s2", "é"], [6, 2, 2, 1])[0]) for k in range(docs)]


@pytest.mark.parametrize("unit, least, at_once", [(divergence.UNIT, 3, 200_000), (2, 3, 40), (5, 1, 10)])
def test_against_brute_force(spark, unit, least, at_once, monkeypatch):
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", at_once)
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", at_once)
    rows = corpus(unit)
    found = divergence.divergence(made(spark, rows), least=least, ranks=7, unit=unit)
    assert rows_of(found) == brute(rows, least, 7)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert rows_of(divergence.divergence(odd_docs)) == brute(rows)
    assert divergence.divergence(no_docs).collect() == []


def test_language_without_kept_terms(spark):
    rows = [(1, "once", "xx", "a"), (2, None, "xx", "b"), (3, "", "xx", None)]
    got = rows_of(divergence.divergence(made(spark, rows)))
    assert got == brute(rows) and len(got) == 6 and {r[4] for r in got} == {0}


def test_one_term_in_more_rows_than_a_unit(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BYTES_AT_ONCE", 1)
    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 10)
    rows = [(k, "a b" if k % 7 == 0 else "a", "en", f"s{k % 3}") for k in range(90)]
    assert rows_of(divergence.divergence(made(spark, rows), unit=1)) == brute(rows)


def test_prefixes_are_discarded_with_all_below(spark):
    """One document of very many terms with a prefix of its own: dropped at that prefix, before any term is dealt out."""
    rows = [(k, "shared words", "en", "s") for k in range(5)] + [(9, " ".join(f"zz{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)), "en", "s")]
    terms = divergence.counted_terms(made(spark, rows, 1)).persist()
    levels, dead = divergence._large_prefixes(terms, 3, 50)
    assert dead == {b"en\0zz"} and levels == []
    assert {bytes(r["term"]) for r in divergence.kept_terms(terms, 3, 50).collect()} == {b"shared", b"words"}
    terms.unpersist()


def test_lists_are_moved_as_bytes(spark):
    """No column that is sorted or shuffled is an array, and any names and counts come back."""
    names = ["", "a", "a\0b", "a\0", "ÿ", "漢,字", " "]
    rows = [(k, "a ab b abcdef über " * (k % 3 + 1), names[k // 4 % 7], names[k % 7]) for k in range(84)]
    docs = made(spark, rows)
    assert not [t for _, t in divergence.counted_terms(docs).dtypes if t.startswith("array")]
    for unit in (1, 10, 1000):
        assert rows_of(divergence.divergence(docs, unit=unit)) == brute(rows)


def test_short_prefixes_are_counted_in_one_pass(spark, monkeypatch):
    """The levels up to four bytes read counts of prefixes, not the terms again."""
    terms = divergence.counted_terms(made(spark, [(k, "abcdefgh abcdefgi xy ab", "en", "s") for k in range(9)], 3)).persist()
    stored = []
    monkeypatch.setattr(divergence, "store", lambda df, name: stored.append(df.persist()) or stored[-1])
    levels, _ = divergence._large_prefixes(terms, 3, 2)
    key = lambda *prefixes: {b"en\0" + p for p in prefixes}
    assert levels == [(2, key(b"ab", b"xy")), (3, key(b"abc")), (4, key(b"abcd")), (6, key(b"abcdef")), (9, key(b"abcdefgh", b"abcdefgi"))]
    assert len(stored) == 1 and stored[0].count() == 3
    terms.unpersist()


@pytest.mark.parametrize("n, tokens", [(0, 7), (8_999_999_999, 9_000_000_001), (9_000_000_000, 9_000_000_001), (10**15, 10**15 + 3)])
def test_share_at_the_bound_of_long_products(spark, n, tokens):
    frame = spark.createDataFrame([(n, tokens, 5)], "n bigint, tokens bigint, terms bigint")
    got = frame.select(divergence._share(*(divergence.F.col(c) for c in frame.columns))).first()[0]
    assert got == 1 + SCALE * (n + 1) // (tokens + 5)


@pytest.mark.parametrize("seed", range(30))
def test_refinement(seed):
    rng = random.Random(seed)
    terms = sorted({bytes(rng.choices(b"ab", k=rng.randrange(1, 7))) for _ in range(60)})
    docs = [list(set(rng.choices(range(20), k=rng.randrange(1, 5)))) for _ in terms]
    again = [list(set(rng.choices(range(20), k=rng.randrange(1, 3)))) for _ in terms]
    owner = np.repeat(np.arange(len(terms)), 2)
    lists = pa.array([d for pair in zip(docs, again) for d in pair], pa.list_(pa.int64()))
    want = [len({*a, *b}) >= 3 for a, b in zip(docs, again)]
    assert refined(pa.array(terms, pa.binary()), owner, lists, 3).tolist() == want
