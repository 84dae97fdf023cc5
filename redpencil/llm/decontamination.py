"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of all benchmark items: ``window`` consecutive words, or the whole item where it
is shorter. A block of the last words under the search position tells how far the search may jump: blocks that
no pattern has allow a jump over almost a whole window. Where the jump is zero, the block leads to the patterns
that end with it, and these are compared word by word.

Documents are searched where they are read, without a shuffle. The benchmark is a stated query set. It is taken
in parts whose size is bounded by ``PART_CHARS``, and the documents are searched once for each part; with more
than one part, the hit places of a document are brought together by its row.

Defined results: null or blank texts have no words, are never hit, and as items match nothing. Items that repeat
count once per item_id; items with a null id count as one item with the id "null". Rows that repeat are reported each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.storage import fresh_name, text_key, without_rows
from redpencil.llm.words import pieces, plain_words, texts

WINDOW = 10
BLOCK = 3
PART_CHARS = 4_000_000


@dataclass
class _Table:
    """Shifts and suffix buckets of the patterns of one length."""

    length: int
    block: int
    shifts: dict[bytes, int] = field(default_factory=dict)
    buckets: dict[bytes, dict[tuple[bytes, ...], set[int]]] = field(default_factory=dict)

    def add(self, pattern: list[bytes], item: int) -> None:
        for end in range(self.block, self.length + 1):
            key = b" ".join(pattern[end - self.block : end])
            self.shifts[key] = min(self.shifts.get(key, self.length), self.length - end)
        self.buckets.setdefault(key, {}).setdefault(tuple(pattern), set()).add(item)

    def search(self, words: list[bytes], hits: set[int], items: set[int]) -> None:
        far, shifts, block, length = self.length - self.block + 1, self.shifts, self.block, self.length
        end, count = length, len(words)
        while end <= count:
            key = b" ".join(words[end - block : end])
            jump = shifts.get(key, far)
            if not jump:
                for pattern, owners in self.buckets.get(key, {}).items():
                    if all(a == b for a, b in zip(pattern, words[end - length : end])):
                        hits.update(range(end - length, end))
                        items |= owners
                jump = 1
            end += jump


class Patterns:
    """Search tables of benchmark items (id, text). Item ids are kept as strings."""

    def __init__(self, items, window: int = WINDOW):
        self.ids: list[str] = []
        self.tables: dict[int, _Table] = {}
        known: dict[str, int] = {}
        for name, text in items:
            words = plain_words((text or "").encode())
            if not words:
                continue
            name = "null" if name is None else str(name)
            item = known.setdefault(name, len(known))
            length = min(window, len(words))
            table = self.tables.setdefault(length, _Table(length, min(BLOCK, length)))
            for start in range(len(words) - length + 1):
                table.add(words[start : start + length], item)
        self.ids = list(known)

    def search(self, words: list[bytes]) -> tuple[set[int], set[int]]:
        hits: set[int] = set()
        items: set[int] = set()
        for table in self.tables.values():
            table.search(words, hits, items)
        return hits, items


def _parts(benchmark: DataFrame, window: int) -> list[Patterns]:
    """The benchmark in parts of bounded size. An id lies in one part, so that counts of items add up."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(chars // PART_CHARS) + 1
    key = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(parts))
    rows = benchmark.select("item_id", "text")
    return [Patterns([tuple(r) for r in rows.filter(key == k).toLocalIterator()], window) for k in range(parts)]


def _search(docs: DataFrame, patterns: Patterns, places: bool) -> DataFrame:
    """Rows (doc_id, text_key, n_words, n_hit, items, places). ``places`` is filled on request only."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("text_key", "n_words", "n_hit")]
        + [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("places", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        found = shared.value
        for whole in batches:
            for batch in pieces(whole):
                n_words, n_hit, items, at = [], [], [], []
                for text in texts(batch):
                    words = plain_words(text)
                    hits, owners = found.search(words)
                    n_words.append(len(words))
                    n_hit.append(len(hits))
                    items.append(sorted(found.ids[k] for k in owners))
                    at.append(sorted(hits) if places else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64())]
                    + [pa.array(items, pa.list_(pa.string())), pa.array(at, pa.list_(pa.int64()))],
                    schema.names,
                )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_key, n_words, n_hit, items): how many words lie in windows of which items."""
    parts = _parts(benchmark, window)
    if len(parts) == 1:
        return _search(docs, parts[0], False).drop("places")
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    all_found = None
    for part in parts:
        found = _search_rows(numbered, part)
        all_found = found if all_found is None else all_found.unionByName(found)
    return (
        all_found.groupBy("doc_id", "text_key", "_row")
        .agg(
            F.max("n_words").alias("n_words"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_hit"),
            F.array_sort(F.flatten(F.collect_list("items"))).alias("items"),
        )
        .drop("_row")
    )


def _search_rows(numbered: DataFrame, part: Patterns) -> DataFrame:
    """As ``_search``, carrying the row number in the place of the doc_id and putting both back."""
    packed = numbered.select(F.struct("doc_id", "_row").alias("doc_id"), "text")
    found = _search(packed, part, True)
    return found.select("doc_id.doc_id", "text_key", F.col("doc_id._row").alias("_row"), "n_words", "n_hit", "items", "places")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated)."""
    return search(docs, benchmark, window).select(
        "doc_id",
        "text_key",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that a window of a benchmark item occurs in; all columns stay.

    With one part of the benchmark the rows are filtered where they are read.
    """
    parts = _parts(benchmark, window)
    if len(parts) > 1:
        return without_rows(docs, contamination(docs, benchmark, window).filter("contaminated").select("doc_id", "text_key").distinct())
    shared = docs.sparkSession.sparkContext.broadcast(parts[0])

    def run(batches):
        found = shared.value
        for batch in batches:
            clean = [not found.search(plain_words(text))[0] for text in texts(batch)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
