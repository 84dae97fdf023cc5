"""Sequence packing by concatenate and cut.

All documents, each followed by an end id, are seen as one stream of ids, which is cut into sequences of a fixed
length. Two passes give every document its place: the first tokenises, and keeps the ids with the number of ids
before them in their own partition; the totals of the partitions are added up to offsets, one row for each
partition. The second pass knows the global place of every document and cuts it at multiples of the sequence
length, without moving it. Only the last sequence can be short.

Ids are stored as unsigned 16-bit numbers when the vocabulary allows it, else as 32-bit ones.

Defined results: a null text is empty and is packed as its end id alone. Rows that repeat are packed each. The
stream follows the order in which the table is read. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.storage import store
from redpencil.llm.words import pieces

SEQUENCE = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
# Words kept with their ids in each Python worker; the table starts anew when it is full.
WORD_CACHE = 600_000
# A unit is a run of spaces and line feeds with what follows it. Cutting there never changes the ids, unless other
# white space is in the text, so texts with any are not cut. The tokenizer's own special strings hold no space.
_UNIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


class Tokenizer:
    """Ids of the named public vocabulary, as the ``tokenizers`` library gives them, with a cache of words.

    Words of Latin letters (below U+0250) are encoded by the rank table of the same vocabulary, which is faster
    and gives the same ids (tested); all else goes through the library itself.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.size = self.whole.get_vocab_size()
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if "<|" not in text and (text.isascii() or max(text) < "ɐ"):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.type).tobytes()

    def __call__(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        cache, out = self.cache, []
        for unit in _UNIT.findall(text):
            ids = cache.get(unit)
            if ids is None:
                if len(cache) >= WORD_CACHE:
                    cache.clear()
                ids = self._encode(unit)
                if len(unit) <= 64:
                    cache[unit] = ids
            out.append(ids)
        return b"".join(out)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(vocabulary: str) -> Tokenizer:
    """One tokenizer for each worker process."""
    if vocabulary not in _TOKENIZERS:
        _TOKENIZERS[vocabulary] = Tokenizer(vocabulary)
    return _TOKENIZERS[vocabulary]


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Rows (part, before, doc_id, ids): a document's ids with its end id, and the ids before it in its partition."""
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())]
        + [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())]
    )

    def run(batches):
        encode, before = tokenizer(vocabulary), 0
        last = np.array([end], encode.type).tobytes()
        for whole in batches:
            for batch in pieces(whole):
                starts, ids = [], []
                for text in batch.column("text"):
                    found = encode(text.as_py() or "") + last
                    starts.append(before)
                    ids.append(found)
                    before += len(found) // encode.type.itemsize
                columns = [batch.column("part"), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens[, ids]).

    ``sequence_tokens`` is what the sequence holds; it is padded to ``sequence`` unless that is a power of two.
    With ``with_ids`` the ids of each piece come along as unsigned little-endian 32-bit numbers.
    """
    width = tokenizer(vocabulary).type
    kept = store(tokenised(docs, vocabulary, end), "ids")
    count = (F.octet_length("ids") / width.itemsize).cast("bigint")
    # One row for each partition of the input: its size is bounded by the number of input splits.
    totals = kept.groupBy("part").agg(F.sum(count).alias("n"))
    running = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    offsets = store(totals.select("part", F.coalesce(running, F.lit(0)).alias("offset"), total.alias("total")), "offsets")
    placed = kept.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("place"), "total", "ids"
    )
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [
        T.StructField(c, T.LongType())
        for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")
    ]
    schema = T.StructType(fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                rows, numbers, data = [], [], []
                places, sums = batch.column("place").to_pylist(), batch.column("total").to_pylist()
                for k, raw in enumerate(batch.column("ids")):
                    ids = np.frombuffer(raw.as_py(), width).astype("<u4")
                    start, place = 0, places[k]
                    while start < len(ids):
                        number, offset = divmod(place + start, sequence)
                        length = min(len(ids) - start, sequence - offset)
                        piece = ids[start : start + length].tobytes()
                        rows.append(k)
                        holds = min(sequence, sums[k] - number * sequence)
                        numbers.append((start, length, zlib.crc32(piece), len(ids), number, offset, holds))
                        if with_ids:
                            data.append(piece)
                        start += length
                table = np.array(numbers, np.int64).reshape(-1, 7)
                columns = [batch.column("doc_id").take(pa.array(rows, pa.int64()))] + [pa.array(table[:, c]) for c in range(7)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if with_ids else []), schema.names)

    return placed.mapInArrow(run, schema)
