"""Toxicity, language model, co-training and chat formatting against brute force and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpencil.llm import chat_format, cotraining, hmm_lm, toxicity

FOLDER = "/root/testdata/sf0.001"


def held_out(key, folds):
    return key is None or zlib.crc32(str(key).encode()) % folds == 0


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


# Toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_automaton_accepts_exactly_one_edit():
    rng = random.Random(4)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(25)]
    lexicon = toxicity.Lexicon({t: 1.0 for t in terms}, {"caca": 2.0})
    for _ in range(4000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))
        found = lexicon.find(word)
        if word in terms:
            assert found == (word, 0, 1.0)
        elif word.startswith("caca"):
            assert found == ("caca", 0, 2.0)
        else:
            near = [t for t in terms if len(t) >= 5 and edits(t, word) == 1 and len(word) >= 4]
            assert found == ((min(near), 1, 1.0) if near else None), word


def test_context_of_hits():
    found = toxicity._Found(toxicity.Lexicon({"moron": 1.0}, {}))
    out = toxicity.hits('he said: "moron" . . . . . . you are a m0ron , indeed'.split(), found)
    assert [(h[1], h[2], h[4], h[5]) for h in out] == [("moron", 0, True, False), ("moron", 1, False, True)]


def test_toxicity_finds_planted_words_and_leaves_the_rest(spark):
    rng = random.Random(8)
    clean = [f"{a}{b}" for a in "ka lo mi nu pe ra si to".split() for b in "ban cel dor fin gul hem".split()]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(clean) for _ in range(60)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["gralstub", "gralmert", "idiot", "lozer"])
        rows.append((k, " ".join(words)))
        if k < 500:
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = toxicity.report(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert all(r.held_out == held_out(r.doc_id, 5) for r in got)
    unseen = [(r.score, r.doc_id % 5 == 0) for r in got if r.held_out or r.doc_id >= 500]
    assert auc(unseen) > 0.97
    assert [r.predicted for r in got if r.doc_id % 5].count(1) == 0
    clean_docs = toxicity.without_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert clean_docs.columns == docs.columns and clean_docs.filter("doc_id % 5 != 0").count() == 480


def test_texts_that_share_a_word_all_count_while_mining(spark):
    rows = [(k, f"the same words and number{k}", int(k % 5 == 0)) for k in range(200)]
    rows += [(1000 + k, "The  same words\nand NUMBER1 ", 0) for k in range(20)]
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    kept = toxicity.distinct_texts(sample).collect()
    assert len(kept) == 200 and sum(r.toxic for r in kept) == 40
    # The mining itself: a word of few toxic texts is found although all texts share the word of the smallest hash.
    planted = [(k, "the same words and number%d %s" % (k, "zorgblat" if k % 5 == 0 else "fine"), int(k % 5 == 0)) for k in range(200)]
    lexicon = toxicity.mine_lexicon(spark.createDataFrame(planted, "doc_id bigint, text string, toxic int"))
    assert "zorgblat" in lexicon.words


def test_toxicity_of_odd_rows_and_empty_tables(odd_docs, no_docs, labels, no_labels):
    for known in (labels, no_labels):
        rows = toxicity.report(odd_docs, known).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert toxicity.without_toxic(odd_docs, known).columns == odd_docs.columns
    assert toxicity.report(no_docs, labels).count() == 0


# Language model


def all_paths(model, sequence):
    states, total = range(len(model.start)), 0.0
    for path in itertools.product(states, repeat=len(sequence)):
        p = model.start[path[0]]
        for k, s in enumerate(path):
            p *= (model.move[path[k - 1], s] if k else 1) * model.emit[sequence[k], s]
        total += p
    return total


def some_model():
    rng = np.random.default_rng(3)
    start, move, emit = rng.random(2), rng.random((2, 2)), rng.random((4, 2))
    return hmm_lm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_the_sum_over_all_paths():
    model, rng = some_model(), np.random.default_rng(5)
    sequences = [rng.integers(0, 4, n) for n in (1, 7, 2, 5, 5, 1)]
    want = [math.log10(all_paths(model, s)) for s in sequences]
    assert np.allclose(hmm_lm.log_likelihoods(model, sequences), want)


@pytest.mark.parametrize("kept", [hmm_lm.KEPT_TOKENS, 1, 9])
def test_baum_welch_counts_are_expectations(monkeypatch, kept):
    monkeypatch.setattr(hmm_lm, "KEPT_TOKENS", kept)
    model, rng = some_model(), np.random.default_rng(6)
    sequences = [rng.integers(0, 4, n) for n in (1, 4, 6, 3)]
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in sequences:
        whole = all_paths(model, s)
        for path in itertools.product(range(2), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for k in range(1, len(s)):
                p *= model.move[path[k - 1], path[k]] * model.emit[s[k], path[k]]
            starts[path[0]] += p / whole
            for k, state in enumerate(path):
                emits[s[k], state] += p / whole
                if k:
                    moves[path[k - 1], state] += p / whole
    for got, want in zip(hmm_lm.expected_counts(model, sequences), (starts, moves, emits)):
        assert np.allclose(got, want)


def check_base(rows, found):
    words = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for doc, t in rows if not held_out(doc, 10) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words(t))
        want.append((str(doc), held_out(doc, 10), len(words(t)), sum(counts[w] > 0 for w in words(t)), total, round(base, 5)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("chunk", [hmm_lm.CHUNK_BYTES, 300])
def test_language_model_of_odd_rows(odd_docs, no_docs, monkeypatch, chunk):
    monkeypatch.setattr(hmm_lm, "CHUNK_BYTES", chunk)
    found = hmm_lm.report(odd_docs).collect()
    check_base([(r.doc_id, r.text) for r in odd_docs.collect()], found)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert hmm_lm.report(no_docs).count() == 0


def test_language_model_beats_word_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [r for r in hmm_lm.report(docs).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


# Co-training


def test_cotraining_on_held_out_labels(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in known.collect()}
    rows = [(r.score, truth[r.doc_id]) for r in cotraining.report(docs, known).collect() if r.held_out and r.doc_id in truth]
    assert auc(rows) > 0.95


def test_cotraining_of_odd_rows_and_empty_tables(odd_docs, no_docs, labels, no_labels):
    for known in (labels, no_labels):
        rows = cotraining.report(odd_docs, known).collect()
        assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows} == {0.5}
    assert cotraining.report(no_docs, labels).count() == 0


# Chat formatting


def test_segments_at_speaker_markers():
    assert chat_format.segments("no marker here") == [(3, "no marker here")]
    text = "Intro\nUser: hi\nthere\n### Assistant\nhello\n<|system|> be kind\n**Human:** ok"
    assert chat_format.segments(text) == [(3, "Intro"), (1, "hi\nthere"), (2, "hello"), (0, "be kind"), (1, "ok")]


def best_path(model, observed):
    emit = model.emit(np.array(observed))
    best = None
    for path in itertools.product(range(3), repeat=len(observed)):
        w = model.start[path[0]] + emit[0, path[0]]
        for k in range(1, len(path)):
            w += model.move[path[k - 1], path[k]] + emit[k, path[k]]
        if best is None or w > best[0] + 1e-12:
            best = (w, path)
    return best


def weight(model, observed, path):
    emit = model.emit(np.array(observed))
    return model.start[path[0]] + emit[0, path[0]] + sum(model.move[path[k - 1], path[k]] + emit[k, path[k]] for k in range(1, len(path)))


@pytest.mark.parametrize("run", [128, 2])
def test_roles_are_the_best_path_also_over_several_runs(spark, monkeypatch, run):
    monkeypatch.setattr(chat_format, "RUN", run)
    rng, rows = random.Random(run), []
    for conv in range(12):
        for turn in range(rng.randrange(1, 8)):
            text = rng.choice(["User: what now?", "Assistant: " + "word " * 60, "plain " * rng.randrange(1, 80), "- a\n- b", "why?"])
            role = rng.choice(["user", "assistant", "system", None, "other"])
            rows.append((conv, turn, role, text))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    model = chat_format.RoleModel.prior()
    monkeypatch.setattr(chat_format, "learn", lambda runs: model)
    found = sorted(chat_format.formatted(frame).collect(), key=lambda r: (r.conv_id, r.turn, r.segment))
    for conv, got in itertools.groupby(found, key=lambda r: r.conv_id):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        parts = [s for r in own for s in chat_format.segments(r[3])]
        got = list(got)
        observed = [chat_format.observation(m, t, k) for k, (m, t) in enumerate(parts)]
        path = tuple(chat_format.ROLES.index(r.role) for r in got)
        assert math.isclose(weight(model, observed, path), best_path(model, observed)[0], abs_tol=1e-9)
        assert [r.rendered for r in got] == [f"<|{r.role}|>\n{t}\n<|end|>\n" for r, (_, t) in zip(got, parts)]


def test_roles_of_held_out_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    found = [r for r in chat_format.formatted(turns).collect() if r.held_out]
    assert sum(truth[r.conv_id, r.turn] == r.role for r in found) > 0.9 * len(found)


def test_chat_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", ""), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, None, "x", "User:")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("own"))
    found = chat_format.formatted(frame).collect()
    assert sorted((str(r.conv_id), str(r.turn)) for r in found) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert chat_format.formatted(frame.limit(0)).count() == 0
