"""Periodic stretches of words in documents: every maximal run of at least four periods, by seed and extend.

A run with smallest period q agrees with itself, shifted by q words, over at least three periods. Periods are
taken in bands from a to under 1.5 a, and each band indexes the k-grams of k = 3 a words, the least overlap that a
run of the band can have. As k is at least two periods, the next occurrence of a run's k-gram is exactly one
smallest period on, so that neighbouring occurrences in the same document are all the pairs that are needed. A pair
is a seed on the diagonal of its lag and is extended both ways by comparing words. A table of the furthest covered
word per lag drops the seeds that an extension has passed already.

K-grams are told apart exactly, by numbering pairs of numbered grams of half the length. A gram that occurs once in
its document cannot be part of a longer one that occurs twice, so the positions left shrink from band to band.

Defined results: a null or blank text has no words and no runs, and its collapsed text is empty. Every row gives one
row, repeated rows and rows without a doc_id too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.llm.storage import text_key
from redpencil.llm.words import pieces, texts

PERIODS = 4
LEAST_WORDS = 6
# Words that are worked on at once; a longer document is worked on alone.
WORDS_AT_ONCE = 300_000
FIRST_STEP = 32

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def periodic_tail(doc_id, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail for one document in ten, chosen and shaped by the checksum of its id."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def bands(longest: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, k): periods from a to under b, and the length of the grams that find them, up to ``longest`` words."""
    a = 1
    while PERIODS * a <= longest:
        b = (3 * a + 1) // 2
        yield a, b, 3 * a
        a = b


def _numbered(keys: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    """Numbers by key at the given positions, and -1 for what occurs once and everywhere else."""
    _, number, seen = np.unique(keys, return_inverse=True, return_counts=True)
    out = np.full(size, -1, np.int64)
    again = seen[number] > 1
    out[where[again]] = number[again]
    return out


def _seeds(ids: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of neighbouring occurrences of k-grams, band by band, each lag in one band only."""
    size, width = len(ids), 1
    grams = _numbered(ids, np.arange(size), size)
    for a, b, k in bands(longest):
        places = np.flatnonzero(grams >= 0)
        while 2 * width <= k and len(places):
            places = places[places < size - width]
            places = places[grams[places + width] >= 0]
            grams = _numbered(grams[places] * size + grams[places + width], places, size)
            width *= 2
            places = np.flatnonzero(grams >= 0)
        if not len(places):
            return
        places = places[places < size - (k - width)]
        places = places[grams[places + k - width] >= 0]
        keys = grams[places] * size + grams[places + k - width]
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        lags = np.diff(places)
        near = (keys[1:] == keys[:-1]) & (lags >= a) & (lags < b)
        yield places[:-1][near], lags[near]


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many words from the first on are equal."""
    at, step, size = 0, FIRST_STEP, len(right)
    while at < size:
        stop = min(size, at + step)
        differs = left[at:stop] != right[at:stop]
        first = int(differs.argmax())
        if differs[first]:
            return at + first
        at, step = stop, 2 * step
    return size


def find_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; ids of different documents must differ."""
    found = []
    for places, lags in _seeds(ids, longest):
        furthest: dict[int, int] = {}
        order = np.lexsort([places, lags])
        places, lags = places[order], lags[order]
        at, seeds = 0, len(places)
        while at < seeds:
            start, lag = int(places[at]), int(lags[at])
            if start < furthest.get(lag, 0):
                # All seeds of this lag under the furthest covered word are passed at once.
                end = int(np.searchsorted(lags, lag, side="right"))
                at += int(np.searchsorted(places[at:end], furthest[lag]))
                continue
            ahead = _agreeing(ids[start:], ids[start + lag :])
            back = _agreeing(ids[start - 1 :: -1], ids[start - 1 + lag : lag - 1 if lag else None : -1]) if start else 0
            furthest[lag] = start + ahead
            length = back + ahead + lag
            if length >= max(LEAST_WORDS, PERIODS * lag):
                found.append((start - back, length, lag))
            at += 1
    return np.array(sorted(found, key=lambda run: (run[0], run[2])), np.int64).reshape(-1, 3)


def _best(runs: list[tuple[int, int, int]]) -> tuple | None:
    """The run of the greatest length in periods; ties go to the smaller start, then the smaller period."""
    return max(runs, key=lambda run: (Fraction(run[1], run[2]), -run[0], -run[2]), default=None)


def _solved(batch: pa.RecordBatch, words: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
    ids, base = [], 0
    for found in words:
        number = defaultdict(count(base).__next__)
        ids.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        base += len(number)
    sizes = np.array([len(found) for found in words], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    runs = find_runs(np.concatenate(ids), int(sizes.max())) if sizes.sum() else np.zeros((0, 3), np.int64)
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    dropped = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    runs[:, 0] -= begins[owner]
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    collapsed, best = [], []
    for k, found in enumerate(words):
        if cuts[k] == cuts[k + 1]:
            best.append(None)
        else:
            best.append(_best([tuple(run) for run in runs[cuts[k] : cuts[k + 1]].tolist()]))
            found = compress(found, kept[begins[k] : begins[k + 1]].tolist())
        collapsed.append(b" ".join(found))
    listed = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], ["start", "length", "period"])
    columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes)]
    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), listed))
    columns += [pa.array([b and b[c] for b in best], pa.int64()) for c in range(3)]
    columns.append(pa.array(collapsed, pa.large_binary()))
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Rows (doc_id, text_key, n_words, runs, start, length, period, collapsed), one for every row of ``docs``.

    ``runs`` lists all runs by start and period; start, length and period are those of the run with most periods, or
    null. ``collapsed`` is the text without the words that only repeat. ``rewrite`` may change a document's words first.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_kind}, text_key bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
        "start bigint, length bigint, period bigint, collapsed string"
    )

    def run(batches):
        run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for whole in batches:
            shape = pa.schema(
                [("doc_id", whole.schema.field("doc_id").type), ("text_key", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_kind))]
                + [(c, pa.int64()) for c in ("start", "length", "period")]
                + [("collapsed", pa.string())]
            )
            for batch in pieces(whole):
                first, waiting, words = 0, 0, []
                for k, (doc_id, text) in enumerate(zip(batch.column("doc_id"), texts(batch))):
                    found = text.split()  # at white space x20 and x09 to x0D; case is kept
                    if words and waiting + len(found) > WORDS_AT_ONCE:
                        yield _solved(batch.slice(first, k - first), words, shape)
                        first, waiting, words = k, 0, []
                    words.append(rewrite(doc_id.as_py(), found) if rewrite else found)
                    waiting += len(found)
                if words:
                    yield _solved(batch.slice(first), words, shape)

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def report(docs: DataFrame, rewrite: Rewrite | None = periodic_tail) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    lines = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    return periodic_runs(docs, rewrite).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "start",
        "length",
        "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        _digest(lines).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
