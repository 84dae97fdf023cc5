"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from redpencil.llm import components, exact_dedup, simhash
from redpencil.llm.storage import without_rows


def plain_hash(text: str, words: int = 3) -> int:
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(edges, vertices):
    root = {v: v for v in vertices}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def near_values(count: int, seed: int) -> list[int]:
    """Clustered 64-bit values, so that many lie within a few bits of each other."""
    rng = random.Random(seed)
    out = []
    while len(out) < count:
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            value = centre
            for _ in range(rng.randrange(0, 6)):
                value ^= 1 << rng.randrange(64)
            out.append(value)
    return out[:count]


@pytest.mark.parametrize("node_rows", [1 << 15, 8])
@pytest.mark.parametrize("budget", [1, 3])
def test_links_reach_what_brute_force_links(spark, budget, node_rows):
    """Small nodes make the walk above the tasks go down many levels; the outcome is the same."""
    values = np.unique(np.array(near_values(400, budget), np.uint64)).view(np.int64).tolist()
    distinct = spark.createDataFrame([(v,) for v in values], "bits bigint")
    found = [(r.u, r.v) for r in simhash.links(distinct, budget, node_rows).collect()]
    pairs = [
        (a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= budget
    ]
    assert pairs and groups(found, values) == groups(pairs, values)
    assert len(found) <= (budget + 1) * len(values) or node_rows == 8


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want = [(r.doc_id, plain_hash(r.text)) for r in rows]
    links = [(a, b) for a in {h for _, h in want} for b in {h for _, h in want} if a < b and bin(a ^ b).count("1") <= 3]
    root = groups(links, {h for _, h in want})
    least = {}
    for doc, h in want:
        if doc is not None:
            least[root[h]] = min(doc, least.get(root[h], doc))
    got = sorted(((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == sorted(((doc, h, least.get(root[h])) for doc, h in want), key=str)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_each_keeps_columns_and_rows_without_id(odd_docs):
    kept = simhash.keep_one_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 3 and 2 not in ids and 8 not in ids and ids.count(None) == 2 and 6 in ids


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.u: r.root for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 1000 for k in range(1001, 1100)}


def test_chunk_hashes_compose_to_the_hash_of_the_whole():
    text = bytes(random.Random(1).randbytes(3 * exact_dedup.CHUNK + 5))
    for k in (0, 1):
        whole = 0
        for byte in text:
            whole = (whole * exact_dedup.BASES[k] + byte + 1) % exact_dedup.PRIMES[k]
        assert sum(pair[k] for pair in exact_dedup.shifted_hashes(text)) % exact_dedup.PRIMES[k] == whole


def test_normalise_is_the_regular_expression():
    for text in (b"", b" ", b"\x0b\x0c a\r\nb ", b"a", "é  x y".encode()):
        assert exact_dedup.normalise(text) == re.sub(rb"[\x20\x09-\x0D]+", b" ", text)


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows]
    out = []
    for r, text in zip(rows, norm):
        same = [o.doc_id for o, t in zip(rows, norm) if t == text]
        ids = [i for i in same if i is not None]
        keep = min(ids) if ids else None
        out.append((r.doc_id, keep, len(same), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_duplicates_of_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in exact_dedup.exact_duplicates(odd_docs).drop("text_key").collect()), key=str)
    assert got == brute_exact(odd_docs.collect())
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    """With a hash that says nothing, the comparison of chunks alone forms the groups."""
    texts = ["xa", "xb", "xa", "xc", "xb", "xa", "yy"]
    docs = spark.createDataFrame([(k, t, None, None, 1) for k, t in enumerate(texts)], "doc_id int, text string, lang string, source string, n_chars int")
    honest = exact_dedup.fingerprints

    def blind(frame):
        from pyspark.sql import functions as F

        return honest(frame).withColumns({"h1": F.lit(1).cast("bigint"), "h2": F.lit(1).cast("bigint")})

    monkeypatch.setattr(exact_dedup, "fingerprints", blind)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {0: (0, 3), 1: (1, 2), 2: (0, 3), 3: (3, 1), 4: (1, 2), 5: (0, 3), 6: (6, 1)}


def test_keep_first_keeps_one_document_of_each_text(odd_docs):
    kept = exact_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    # 2 has the text of 1 and 4 that of 3; rows of one id and text stay together, rows without an id always stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "1", "3", "5", "6", "7", "8", "9", "None", "None"])


def test_without_rows_takes_only_the_given_text_of_an_id(odd_docs):
    from redpencil.llm.storage import text_key

    gone = odd_docs.filter("text = 'a b c d'").select("doc_id", text_key().alias("text_key"))
    left = [r.text for r in without_rows(odd_docs, gone).filter("doc_id = 1").collect()]
    assert left == ["another text of the same id"]
