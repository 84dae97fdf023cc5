"""The pipeline stage by stage, and its near-copy stage against brute force over all pairs of fingerprints."""

import random

import xxhash

import corpus_pipeline


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_near_copies_are_those_of_the_fingerprints(spark, tmp_path):
    rng, rows = random.Random(21), []
    vocabulary = [f"w{k}" for k in range(300)]
    for family in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 500))]
        for _ in range(rng.randrange(1, 7)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 40])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    rows += [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    bits = [fingerprint(r[1]) for r in rows]
    label = [r[0] for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (bits[a] ^ bits[b]).bit_count() <= 3 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["near dedup"](spark, docs, str(tmp_path)).collect()}
    assert kept == set(label) and 50 < len(kept) < len(rows)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "word number one of a benchmark")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, folder)
            assert after.columns == docs.columns and after.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()


def test_pipeline_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    docs, survivors = spark.read.parquet(f"{folder}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        if name == "exact dedup":
            texts = [" ".join(r.text.split()) for r in docs.collect()]
            assert len(texts) == len(set(texts))
    survivors = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == survivors and survivors < {r.doc_id for r in rows}
    assert len(survivors) > 0.6 * len(rows)
