"""A hidden Markov language model, trained by Baum-Welch counts that are added up over partitions.

A latent state emits the class of a word, and the class the word. Frequent words (at least ``FREQUENT`` of all
tokens, so their number is bounded) have a class each; the others share ``ENDINGS`` classes by their ending. So
the states' tables have a bounded size and are broadcast, while the words themselves, whose number is not
bounded, are counted over the whole corpus. The probability of a text is that of its class sequence, summed over
all state paths by the scaled forward recursion, times that of each word within its class.

Words meet their corpus counts without a row for each word of each document: a chunk of documents is numbered
with a vocabulary of its own, the (chunk, word) rows are summed over the corpus by word, and go back to their
chunk, where they are looked up by number. Chunks have a bounded size. The rows of a chunk are sorted with its
vocabulary first, so that a task holds the vocabulary of one chunk and streams the texts past it.

Training starts from a bounded sample (the ``SAMPLE`` whole texts of the smallest hash, for the first guess only) and
goes on with ``ROUNDS`` Baum-Welch rounds over all training texts. Sequences are never cut: the forward states are
kept for ``KEPT_TOKENS`` tokens at a time and made again from those at the bounds, for the way back.

Words are told apart by 64-bit hashes. Defined results: a null or blank text is its end token alone. Rows that
repeat are counted and scored each. A row without a doc_id is held out. With no training rows, the base score is 0
for each token and the model is uniform. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.llm.storage import discard, store, store_at, text_key
from redpencil.llm.words import pieces, spaced_words, texts

FOLDS = 10
SMOOTHING = 0.1
STATES = 6
FREQUENT = 5e-4
ENDINGS = 1024
SAMPLE = 400
SAMPLE_ROUNDS = 12
SAMPLE_PARTS = 8
ROUNDS = 2
CHUNK_BYTES = 32 << 20
CHUNK_WORDS = 400_000
# Tokens that are worked on at once, padding included.
BLOCK = 200_000
# Tokens whose forward states are held at once.
KEPT_TOKENS = 50_000
END_WORD = b" "  # no word holds a space


def is_held_out(folds: int = FOLDS):
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(True))


# Texts to numbers


def _ending(word: bytes) -> int:
    """A class by length and last characters, for words that are not frequent."""
    return zlib.crc32(word[-3:] + bytes([min(len(word), 12) // 4])) % ENDINGS


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers with their bytes grouped by place, which compresses well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1)


def _numbered(docs: DataFrame) -> DataFrame:
    """Document rows (ids filled) and vocabulary rows (word filled) of every chunk.

    A vocabulary row tells how often the word occurs in the training texts of the chunk.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"chunk bigint, doc_id {id_type}, text_key bigint, held_out boolean, ids binary, "
        "place int, word bigint, ending int, n bigint"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        index: dict[bytes, int] = defaultdict(count().__next__)
        training, size, number = np.zeros(0, np.int64), 0, 0

        def vocabulary(part: int, id_kind: pa.DataType) -> pa.RecordBatch:
            n, words = len(index), list(index)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n).view(np.int64)
            none = lambda kind: pa.nulls(n, kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int64)), none(id_kind), none(pa.int64()), none(pa.bool_()), none(pa.binary())]
                + [pa.array(np.arange(n, dtype=np.int32)), pa.array(hashes), pa.array(list(map(_ending, words)), pa.int32())]
                + [pa.array(np.pad(training, (0, n - len(training))))],
                names,
            )

        part, kind = None, None
        for whole in batches:
            for batch in pieces(whole):
                kind = batch.column("doc_id").type
                part = (batch.column("part")[0].as_py() << 32) + number
                held = batch.column("held_out").to_pylist()
                ids, learned = [], []
                for out, text in zip(held, texts(batch)):
                    size += len(text)
                    row = np.array([*map(index.__getitem__, spaced_words(text)), index[END_WORD]], np.int64)
                    ids.append(_planes(row))
                    if not out:
                        learned.append(row)
                if learned:
                    seen = np.bincount(np.concatenate(learned), minlength=len(index))
                    training = np.pad(training, (0, len(seen) - len(training))) + seen
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int64)), batch.column("doc_id"), batch.column("text_key"), batch.column("held_out")]
                    + [pa.array(ids, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                    names,
                )
                if size >= CHUNK_BYTES or len(index) >= CHUNK_WORDS:
                    yield vocabulary(part, kind)
                    index = defaultdict(count().__next__)
                    training, size, number, part = np.zeros(0, np.int64), 0, number + 1, None
        if part is not None:
            yield vocabulary(part, kind)

    rows = docs.select(F.spark_partition_id().alias("part"), "doc_id", text_key().alias("text_key"), is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Counts:
    """Sizes of the training corpus, and per class its tokens and distinct words."""

    tokens: int
    distinct: int
    frequent: dict[int, int]
    class_tokens: np.ndarray
    class_words: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.class_tokens)


def encoded(docs: DataFrame) -> tuple[DataFrame, Counts]:
    """Rows (doc_id, text_key, held_out, n_tokens, n_known, base_score, word_score, classes), and the counts.

    ``word_score`` is the log10 probability of the words within their classes, ``classes`` the class sequence.
    """
    spark = docs.sparkSession
    rows, path = store_at(_numbered(docs), "numbered")
    words = rows.filter(F.col("word").isNotNull())
    total = words.agg(F.sum("n")).first()[0] or 0
    # Added up where they are, then by word; the counts go back to the chunks by a join, which splits hot words.
    summed, summed_path = store_at(words.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "word-counts")
    # Bounded: at most 1 / FREQUENT words can be that frequent.
    common = summed.filter(F.col("n") >= max(1.0, FREQUENT * total)).select("word").orderBy("word").collect()
    frequent = {row["word"]: ENDINGS + k for k, row in enumerate(common)}
    classes = ENDINGS + len(frequent)
    table = spark.createDataFrame(list(frequent.items()), "word bigint, own int")
    classed = summed.join(F.broadcast(table), "word", "left").select("word", "n", F.coalesce("own", "ending").alias("class"))
    per_class = classed.filter("n > 0").groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for row in per_class.collect():
        class_tokens[row["class"]], class_words[row["class"]] = row["n"], row["words"]
    counts = Counts(total, int(class_words.sum()), frequent, class_tokens, class_words)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, word_score double, classes binary"

    names = [part.split()[0] for part in schema.split(", ")]

    def look_up(batches):
        chunk, base, inside, kind = None, None, None, None
        places, numbers, kinds = [], [], []
        for whole in batches:
            of, is_text = whole.column("chunk").to_numpy(), whole.column("is_text").to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero((of[1:] != of[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for lo, hi in zip(np.append(0, bounds), np.append(bounds, len(of))):
                if lo == hi:
                    continue
                part = whole.slice(lo, hi - lo)
                if of[lo] != chunk:
                    chunk, base = of[lo], None
                    places, numbers, kinds = [], [], []
                if not is_text[lo]:
                    places.append(part.column("place").to_numpy())
                    numbers.append(part.column("n").to_numpy())
                    kinds.append(part.column("class").to_numpy())
                    continue
                if base is None:
                    place = np.concatenate(places)
                    n, kind = np.empty(len(place), np.int64), np.empty(len(place), np.int32)
                    n[place], kind[place] = np.concatenate(numbers), np.concatenate(kinds)
                    places, numbers, kinds = [], [], []
                    base = np.log10((n + SMOOTHING) / (counts.tokens + SMOOTHING * (counts.distinct + 1)))
                    inside = np.log10((n + SMOOTHING) / (class_tokens[kind] + SMOOTHING * (class_words[kind] + 1)))
                    known = n > 0
                out = []
                for data in part.column("ids"):
                    ids = _from_planes(data.as_py())
                    out.append((len(ids), int(known[ids].sum()), base[ids].sum(), inside[ids].sum(), kind[ids].astype("<u2").tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names[:3]] + columns, names)

    texts_ = rows.filter(F.col("ids").isNotNull()).select("chunk", F.lit(True).alias("is_text"), "place", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("int").alias("class"), *names[:3], "ids")
    nothing = [rows[c].alias(c) for c in (*names[:3], "ids")]
    vocabulary = words.select("chunk", "place", "word", *nothing).join(classed.hint("shuffle_merge"), "word")
    vocabulary = vocabulary.select("chunk", F.lit(False).alias("is_text"), "place", "n", "class", *names[:3], "ids")
    both = texts_.unionByName(vocabulary).repartition("chunk").sortWithinPartitions("chunk", "is_text")
    made = store(both.mapInArrow(look_up, schema), "encoded")
    discard(spark, path)
    discard(spark, summed_path)
    return made, counts


# The model


@dataclass
class Hmm:
    start: np.ndarray  # (states)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)

    @classmethod
    def guess(cls, class_tokens: np.ndarray, states: int = STATES) -> Hmm:
        """Sticky states whose tables are the class frequencies with fixed disturbances."""
        noise = np.random.default_rng(7).normal(0, 0.5, (len(class_tokens), states))
        emit = (class_tokens[:, None] + 0.5) * np.exp(noise)
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        """Maximum-likelihood tables, with small counts added so that nothing is impossible."""
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _blocks(sequences: list[np.ndarray]):
    """(indexes, padded (time, text) matrix, active texts at each time): texts of similar length, longest first."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        chosen = order[at : at + max(1, BLOCK // max(1, longest))]
        lengths = np.array([len(sequences[k]) for k in chosen])
        padded = np.zeros((longest, len(chosen)), np.int64)
        for column, k in enumerate(chosen):
            padded[: lengths[column], column] = sequences[k]
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        yield chosen, padded, active
        at += len(chosen)


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence over all state paths, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for chosen, padded, active in _blocks(sequences):
        forward = model.start * model.emit[padded[0]]
        scale = forward.sum(1)
        forward /= scale[:, None]
        log = np.log(scale)
        for time in range(1, len(padded)):
            m = active[time]
            step = (forward[:m] @ model.move) * model.emit[padded[time, :m]]
            scale = step.sum(1)
            forward[:m] = step / scale[:, None]
            log[:m] += np.log(scale)
        out[chosen] = log / math.log(10)
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts, moves and emissions, added up over the sequences."""
    states, classes = len(model.start), len(model.emit)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))

    def forward(padded, active, lo: int, hi: int, last):
        """States and scales of the times from lo to under hi, after the states of the time before."""
        found, scales = [], []
        for time in range(lo, hi):
            m = active[time]
            step = (model.start if time == 0 else last[:m] @ model.move) * model.emit[padded[time, :m]]
            scale = step.sum(1)
            last = step / scale[:, None]
            found.append(last)
            scales.append(scale)
        return found, scales

    for _, padded, active in _blocks(sequences):
        step = max(1, KEPT_TOKENS // padded.shape[1])
        bounds = [*range(0, len(padded), step), len(padded)]
        before = [None]
        for lo, hi in zip(bounds[:-2], bounds[1:-1]):
            before.append(forward(padded, active, lo, hi, before[-1])[0][-1])
        backward, ahead = np.ones((padded.shape[1], states)), None
        for lo, hi, last in reversed(list(zip(bounds, bounds[1:], before))):
            found, scales = forward(padded, active, lo, hi, last)
            shares = [None] * (hi - lo)
            for time in range(hi - 1, lo - 1, -1):
                m, here = active[time], found[time - lo]
                if ahead is not None:
                    k = len(ahead)
                    moves += (here[:k].T @ ahead) * model.move
                    backward[:k] = ahead @ model.move.T
                shares[time - lo] = here * backward[:m]
                ahead = model.emit[padded[time, :m]] * backward[:m] / scales[time - lo][:, None]
            if lo == 0:
                starts += shares[0].sum(0)
            seen = np.concatenate([padded[time, : active[time]] for time in range(lo, hi)])
            share = np.concatenate(shares)
            for state in range(states):
                emits[:, state] += np.bincount(seen, share[:, state], classes)
    return starts, moves, emits


def _sequences(column) -> list[np.ndarray]:
    return [np.frombuffer(value.as_py(), "<u2") for value in column]


def _trained_once(training: DataFrame, model: Hmm) -> Hmm:
    """One Baum-Welch round over all rows: each task adds up its own counts, Spark adds up those of the tasks."""
    shared = training.sparkSession.sparkContext.broadcast(model)
    shapes = [model.start.shape, model.move.shape, model.emit.shape]

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([c.ravel() for c in expected_counts(shared.value, _sequences(batch.column("classes")))])
                total = found if total is None else total + found
        if total is not None:
            filled = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], ["place", "n"])

    summed = training.select("classes").mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n"))
    sizes = [math.prod(shape) for shape in shapes]
    flat = np.zeros(sum(sizes))
    for place, n in summed.collect():  # bounded by the size of the model
        flat[place] = n
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    return Hmm.from_counts(*(part.reshape(shape) for part, shape in zip(parts, shapes)))


def train(rows: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS, sample: int = SAMPLE) -> Hmm:
    """Baum-Welch: a first guess from a bounded sample, then ``rounds`` rounds over all training rows."""
    training = rows.filter(~F.col("held_out"))
    model = Hmm.guess(counts.class_tokens, states)
    # The texts of the smallest hashes: a sample of fixed size, of whole texts, and the same on every run.
    few = store(training.orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(sample).select("classes").repartition(SAMPLE_PARTS), "sample")
    if few.isEmpty():
        return model
    for _ in range(SAMPLE_ROUNDS):
        model = _trained_once(few, model)
    # Classes that the sample lacks get their corpus frequency in every state.
    rest = counts.class_tokens / max(1.0, counts.class_tokens.sum()) + 1e-9
    emit = 0.8 * model.emit + 0.2 * (rest / rest.sum())[:, None]
    model = Hmm(model.start, model.move, emit)
    for _ in range(rounds):
        model = _trained_once(training, model)
    return model


def scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    rows, counts = encoded(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, counts, states, rounds))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            score = log_likelihoods(shared.value, _sequences(batch.column("classes"))) + batch.column("word_score").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(score)], names)

    return rows.mapInArrow(run, schema).withColumn("train_tokens", F.lit(counts.tokens).cast("bigint"))


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    return scores(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
