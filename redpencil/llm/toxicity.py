"""Toxicity by a lexicon that tolerates misspellings, with windows of context around each hit.

The lexicon is a trie of words and stems. A Levenshtein automaton is intersected with it: a state is a set of
(trie node, edits so far), and a word is followed letter by letter until the set is empty, which for nearly all
words is after a few letters. States and steps are kept, so the intersection becomes a table that is filled
as it is used. A word of five or more letters may be off by one edit; a stem must be the beginning of the word.

Around a hit, a window of words tells quotation (quote marks, words of reporting) from abuse (address in the
second person). Counts of hits by kind are the features of a logistic regression.

Words and stems are fixed seeds and those that labelled toxic texts have far more often. They are mined in one
half of a sample of labelled rows, and the weights are fitted in the other half. The sample holds about
``SAMPLE`` rows at any size of the input, so it can be broadcast; texts that repeat count once while mining.

Scoring reads each text where it is, without a shuffle. Labels, lang, source and doc_id are not inputs of a score.

Defined results: a null or empty text has no hits and gets the score of a text without hits. Labels that
contradict each other count as toxic, rows with a null label are ignored. Without labels of both classes, fixed
weights are used. Rows that repeat are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.storage import store, text_key
from redpencil.llm.words import pieces

SAMPLE = 20_000
FOLDS = 5
# Common insults, and the words and marks that make a quotation or an address likely.
SEEDS = (
    "idiot moron stupid trash scum pathetic worthless loser disgusting clown imbecile dumb jerk bastard bitch asshole fuck shit "
    "arschloch dummkopf abschaum widerlich connard salaud ordure minable estúpido imbécil basura escoria asqueroso"
).split()
REPORTING = frozenset("said says called calls wrote writes quote quoted quoting word term sagte nannte schrieb dit écrit dijo llamó".split())
ADDRESS = frozenset("you your you're youre u ur yourself du dich dein tu toi vous te ti usted".split())
QUOTES = frozenset("\"'“”„‟«»‹›‘’`")
WINDOW = 5
LEAST_FUZZY = 5
LEAST_DOCS = 5
LEAST_LOG_ODDS = 3.0
MOST_TERMS = 500
STEM_LENGTHS = range(4, 9)
# Bounds on what a Python worker keeps; it starts anew beyond them.
WORD_CACHE = 150_000
STATES = 10_000
COUNTED = 200_000
# Weights used where nothing can be learned; in the order of ``FEATURES``.
FEATURES = ("any", "exact", "stems", "fuzzy", "quoted", "addressed", "strongest", "terms", "density")
PLAIN_WEIGHTS = (-3.0, 3.0, 1.0, 1.0, 0.5, -0.5, 0.5, 0.0, 0.5, 0.0)
_STRIP = string.punctuation + "“”„«»‹›‘’…"


@dataclass
class Lexicon:
    """Words and stems with their strength, and words that look misspelled but are common in clean texts."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    _children: list[dict[str, int]] = field(default_factory=list, repr=False)

    def __post_init__(self):
        self._start()

    def __getstate__(self):
        return self.words, self.stems, self.exceptions

    def __setstate__(self, state):
        self.words, self.stems, self.exceptions = state
        self._start()

    def _start(self) -> None:
        self._children, self._word, self._stem = [{}], {}, {}
        for table, terms in ((self._word, self.words), (self._stem, self.stems)):
            for term in terms:
                node = 0
                for letter in term:
                    if letter not in self._children[node]:
                        self._children[node][letter] = len(self._children)
                        self._children.append({})
                    node = self._children[node][letter]
                table[node] = term
        self._forget()

    def _forget(self) -> None:
        """Start the table of states and steps anew; state 0 is the dead one, 1 the initial one."""
        self._states: list[tuple] = []
        self._numbers: dict[tuple, int] = {}
        self._steps: dict[tuple[int, str], int] = {}
        self._numbered({})
        self._numbered({0: 0})

    def _numbered(self, state: dict[int, int]) -> int:
        """Number of a state, closed under leaving letters of the term out; one edit in all."""
        for node, edits in list(state.items()):
            if edits == 0:
                for child in self._children[node].values():
                    state.setdefault(child, 1)
        key = tuple(sorted(state.items()))
        number = self._numbers.setdefault(key, len(self._states))
        if number == len(self._states):
            self._states.append(key)
        return number

    def _step(self, number: int, letter: str) -> int:
        after = self._steps.get((number, letter))
        if after is None:
            reached: dict[int, int] = {}
            for node, edits in self._states[number]:
                children = self._children[node]
                child = children.get(letter)
                if child is not None:
                    reached[child] = min(edits, reached.get(child, 2))
                if edits == 0:
                    reached.setdefault(node, 1)  # a letter too many
                    for other in children.values():
                        reached.setdefault(other, 1)  # a letter instead of another
            after = self._steps[number, letter] = self._numbered(reached)
        return after

    def find(self, word: str) -> tuple[str, int, float] | None:
        """(term, edits, strength) of the best match: exact words, then stems, then words with one edit."""
        if len(self._states) > STATES:
            self._forget()
        number, stem = 1, None
        for letter in word:
            number = self._step(number, letter)
            if not number:
                break
            for node, edits in self._states[number]:
                if edits == 0 and node in self._stem:
                    stem = self._stem[node]
        fuzzy = None
        for node, edits in self._states[number]:
            term = self._word.get(node)
            if term is None:
                continue
            if edits == 0:
                return term, 0, self.words[term]
            if len(term) >= LEAST_FUZZY and (fuzzy is None or term < fuzzy):
                fuzzy = term
        if stem is not None:
            return stem, 0, self.stems[stem]
        if fuzzy is not None and len(word) >= LEAST_FUZZY - 1 and word not in self.exceptions:
            return fuzzy, 1, self.words[fuzzy]
        return None


class _Found(dict):
    """Raw token to match, filled on first sight."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        found = self.lexicon.find(token.strip(_STRIP))
        if len(token) <= 64:
            self[token] = found
        return found


def hits(tokens: list[str], found: _Found) -> list[tuple[int, str, int, float, bool, bool]]:
    """(place, term, edits, strength, quoted, addressed) of every hit in lower-cased tokens."""
    if len(found) > WORD_CACHE:
        found.clear()
    out = []
    for place, match in enumerate(map(found.__getitem__, tokens)):
        if match is None:
            continue
        around = tokens[max(0, place - WINDOW) : place + WINDOW + 1]
        bare = {token.strip(_STRIP) for token in around}
        raw = tokens[place]
        quoted = raw[0] in QUOTES or raw[-1] in QUOTES or not bare.isdisjoint(REPORTING)
        out.append((place, *match, quoted, not bare.isdisjoint(ADDRESS)))
    return out


def features(tokens: list[str], found: _Found) -> list[float]:
    out = hits(tokens, found)
    if not out:
        return [0.0] * len(FEATURES)
    words = found.lexicon.words
    exact = sum(h[2] == 0 and h[1] in words for h in out)
    fuzzy = sum(h[2] > 0 for h in out)
    counts = (exact, len(out) - exact - fuzzy, fuzzy, sum(h[4] for h in out), sum(h[5] for h in out))
    return [
        1.0,
        *map(math.log1p, counts),
        max(h[3] if h[2] == 0 else h[3] / 2 for h in out) / 5,
        math.log1p(len({h[1] for h in out})),
        min(1.0, 10 * len(out) / len(tokens)),
    ]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple[float, ...]

    def score(self, text: str | None, found: _Found) -> float:
        x = features((text or "").lower().split(), found)
        margin = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def _fold(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string"))


def is_held_out(folds: int = FOLDS):
    """Rows that no label is learned from; a null doc_id is held out."""
    return F.coalesce(F.pmod(_fold(), F.lit(folds)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text, toxic, half) of about ``rows`` labelled documents, chosen by a hash of their id."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = store(known, "labels")
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half")
    # At most about ``rows`` ids and labels are broadcast, at any size of the input.
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic", half)


def _term_counts(sample: DataFrame) -> DataFrame:
    """Rows (term, stem, toxic_docs, clean_docs): in how many texts a word or a beginning of a word occurs."""

    def run(batches):
        counts: dict[tuple[str, bool], list[int]] = {}
        for whole in batches:
            for batch in pieces(whole):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                    words = {w.strip(_STRIP) for w in set((text or "").lower().split())}
                    stems = {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}
                    for kind, terms in ((False, words), (True, stems)):
                        for term in terms:
                            counts.setdefault((term, kind), [0, 0])[int(toxic == 0)] += 1
                if len(counts) > COUNTED:
                    yield _counted(counts)
                    counts = {}
        yield _counted(counts)

    partial = sample.select("text", "toxic").mapInArrow(run, "term string, stem boolean, toxic_docs bigint, clean_docs bigint")
    return partial.groupBy("term", "stem").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def _counted(counts: dict) -> pa.RecordBatch:
    keys, values = list(counts), np.array(list(counts.values()), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array(values[:, 0]), pa.array(values[:, 1])],
        ["term", "stem", "toxic_docs", "clean_docs"],
    )


def distinct_texts(sample: DataFrame) -> DataFrame:
    """One row of each text and label; case and white space do not tell texts apart."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " "))
    return sample.withColumn("plain", F.sha2(plain, 256)).dropDuplicates(["plain", "toxic"]).drop("plain")


def mine_lexicon(sample: DataFrame) -> Lexicon:
    """Seeds, and at most ``MOST_TERMS`` words and stems that are far more frequent in toxic texts."""
    distinct = distinct_texts(sample)
    counts = store(_term_counts(distinct), "term-counts")
    sizes = distinct.groupBy().agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    n_toxic, n_clean = sizes["toxic"] or 0, (sizes["all"] or 0) - (sizes["toxic"] or 0)
    odds = F.log((F.col("toxic_docs") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean_docs") + 0.5) / (n_clean + 1))
    strong = (
        counts.withColumn("odds", odds)
        .filter((F.col("toxic_docs") >= LEAST_DOCS) & (F.col("odds") >= LEAST_LOG_ODDS) & (F.length("term") >= STEM_LENGTHS[0]))
        .orderBy(F.desc(F.col("toxic_docs") * F.col("odds")), F.length("term"), "term", "stem")
        .limit(MOST_TERMS)
        .collect()
    )
    found = {seed: 3.0 for seed in SEEDS}
    stems: dict[str, float] = {}
    for row in strong:
        term = row["term"]
        if not row["stem"]:
            found[term] = max(row["odds"], found.get(term, 0.0))
        elif not any(term.startswith(s) or s.startswith(term) for s in stems):
            stems[term] = row["odds"]
    # A stem that only one word has adds nothing to that word.
    stems = {s: odds for s, odds in stems.items() if sum(w.startswith(s) for w in SEEDS) == 0}
    lexicon = Lexicon(found, stems)

    def misread(batches):
        known = _Found(lexicon)
        for batch in batches:
            near = [bool(m := known[w]) and m[1] > 0 for w in batch.column("term").to_pylist()]
            yield batch.filter(pa.array(near, pa.bool_()))

    common = counts.filter(~F.col("stem") & (F.col("clean_docs") >= 2) & (odds < 1)).select("term")
    rows = common.mapInArrow(misread, "term string").orderBy("term").limit(20 * MOST_TERMS).collect()
    return Lexicon(found, stems, frozenset(r["term"] for r in rows))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton steps with an L2 penalty on all but the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ToxicityModel:
    sample = store(labelled_sample(docs, labels, rows), "toxicity-sample")
    lexicon = mine_lexicon(sample.filter("half = 0"))
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        found = _Found(lexicon)
        for batch in batches:
            x = [features((t.as_py() or "").lower().split(), found) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], schema.names)

    # Bounded: about half of the sample, some numbers a row.
    table = sample.filter("half = 1").select("text", "toxic").mapInArrow(run, schema).collect()
    y = np.array([r["toxic"] for r in table], float)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(lexicon, PLAIN_WEIGHTS)
    return ToxicityModel(lexicon, fit_weights(np.array([r["x"] for r in table]), y))


def scores(docs: DataFrame, model: ToxicityModel, with_hits: bool = False) -> DataFrame:
    """Rows (doc_id, text_key, score[, hits]); hits are (place, term, edits, quoted, addressed) by word number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hit = T.StructType(
        [T.StructField("place", T.LongType()), T.StructField("term", T.StringType()), T.StructField("edits", T.LongType())]
        + [T.StructField("quoted", T.BooleanType()), T.StructField("addressed", T.BooleanType())]
    )
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + ([T.StructField("hits", T.ArrayType(hit))] if with_hits else []))
    hit_type = pa.list_(pa.struct([("place", pa.int64()), ("term", pa.string()), ("edits", pa.int64()), ("quoted", pa.bool_()), ("addressed", pa.bool_())]))

    def run(batches):
        known = shared.value
        found = _Found(known.lexicon)
        for whole in batches:
            for batch in pieces(whole):
                values = [t.as_py() for t in batch.column("text")]
                columns = [batch.column("doc_id"), batch.column("text_key"), pa.array([known.score(t, found) for t in values], pa.float64())]
                if with_hits:
                    rows = [
                        [{"place": p, "term": t, "edits": e, "quoted": q, "addressed": a} for p, t, e, _, q, a in hits((v or "").lower().split(), found)]
                        for v in values
                    ]
                    columns.append(pa.array(rows, hit_type))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted)."""
    scored = scores(docs, learn(docs, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more, filtered where they are read; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        model = shared.value
        found = _Found(model.lexicon)
        for batch in batches:
            clean = [model.score(t.as_py(), found) < threshold for t in batch.column("text")]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
