"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing chunks.

A text is normalised (white-space runs become one space) and cut into chunks. Every chunk gets a polynomial
hash by itself. The hash of a text is the sum of its chunk hashes, each shifted by the power of the base that
belongs to the bytes after it, so the chunks of a huge text can be hashed and added up in any order and place:
the sum is a Spark aggregate. Two moduli and the length make the fingerprint.

Rows with equal fingerprints are candidates. Their texts are read again, and each chunk is compared, byte by
byte, with the same chunk of the candidate that has the smallest doc_id; a text that differs forms a
group with the others that differ, and is compared again. So equality never rests on a hash alone.

Defined results: a null text equals an empty one. Rows that share a doc_id and a text are one document and
are kept or dropped together; group_size counts rows. Rows without a doc_id come after all others as the
row to keep; where a group has none with a doc_id, keep_id is null and all its rows stay. Other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.storage import store, text_key, without_rows
from redpencil.llm.words import pieces, texts

# Two primes under 2^31 and two bases. A product of a byte and a power fits 64 bits, with room for 2^25 terms.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 16
_SPACE = b" \t\n\r\x0b\x0c"
_POWERS: dict[int, np.ndarray] = {}


def normalise(text: bytes) -> bytes:
    """White-space runs (x20, x09 to x0D) become one space, at the ends as well."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + inner + (b" " if text[-1] in _SPACE else b"")


def _powers(which: int) -> np.ndarray:
    """base^0 … base^(CHUNK - 1), made by doubling."""
    if which not in _POWERS:
        table, prime = np.ones(1, np.uint64), np.uint64(PRIMES[which])
        while len(table) < CHUNK:
            shift = np.uint64(pow(BASES[which], len(table), PRIMES[which]))
            table = np.concatenate([table, table * shift % prime])
        _POWERS[which] = table[:CHUNK]
    return _POWERS[which]


def chunk_hash(chunk: bytes, which: int) -> int:
    values = np.frombuffer(chunk, np.uint8)[::-1].astype(np.uint64) + np.uint64(1)
    return int(np.dot(values, _powers(which)[: len(values)])) % PRIMES[which]


def chunks(text: bytes) -> Iterator[bytes]:
    """At least one chunk, also of an empty text."""
    for start in range(0, max(1, len(text)), CHUNK):
        yield text[start : start + CHUNK]


def shifted_hashes(text: bytes) -> Iterator[tuple[int, int]]:
    """Per chunk, its two hashes times base^(bytes after it); their sum is the hash of the text."""
    left = len(text)
    for chunk in chunks(text):
        left -= len(chunk)
        yield tuple(chunk_hash(chunk, k) * pow(BASES[k], left, PRIMES[k]) % PRIMES[k] for k in (0, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, n, n_bytes, h1, h2, text_sha256), one for each (doc_id, text_key); n counts its rows."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(c, T.LongType()) for c in ("text_key", "first", "n_bytes", "h1", "h2")]
        + [T.StructField("text_sha256", T.StringType())]
    )

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                at, first, size, one, two, sha = [], [], [], [], [], []
                for k, text in enumerate(texts(batch)):
                    text = normalise(text)
                    digest = hashlib.sha256(text).hexdigest()
                    for c, (a, b) in enumerate(shifted_hashes(text)):
                        at.append(k)
                        first.append(int(c == 0))
                        size.append(len(text))
                        one.append(a)
                        two.append(b)
                        sha.append(digest)
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows)]
                    + [pa.array(v, pa.int64()) for v in (first, size, one, two)]
                    + [pa.array(sha, pa.string())],
                    schema.names,
                )

    made = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)
    # Rows that share doc_id and text add up n times; a sum that n divides is brought back by it.
    added = made.groupBy("doc_id", "text_key").agg(
        F.sum("first").alias("n"),
        F.first("n_bytes").alias("n_bytes"),
        *[F.sum(h).alias(h) for h in ("h1", "h2")],
        F.first("text_sha256").alias("text_sha256"),
    )
    return added.withColumns({h: F.expr(f"(({h} div n) % {p})").cast("bigint") for h, p in zip(("h1", "h2"), PRIMES)})


def _chunk_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, chunk_no, n_chunks, chunk) of normalised texts."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("text_key", T.LongType()), T.StructField("chunk_no", T.IntegerType())]
        + [T.StructField("n_chunks", T.IntegerType()), T.StructField("chunk", T.BinaryType())]
    )

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, 128):
                at, no, count, data = [], [], [], []
                for k, text in enumerate(texts(batch)):
                    parts = list(chunks(normalise(text)))
                    at += [k] * len(parts)
                    no += range(len(parts))
                    count += [len(parts)] * len(parts)
                    data += parts
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows)]
                    + [pa.array(no, pa.int32()), pa.array(count, pa.int32()), pa.array(data, pa.binary())],
                    schema.names,
                )

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


GROUP = ["n_bytes", "h1", "h2"]
ROW = ["doc_id", "text_key"]


def _members(open_rows: DataFrame) -> DataFrame:
    """Rows of groups with two or more documents, with the row that leads each group."""
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    groups = open_rows.groupBy(*GROUP).agg(lead.alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    led = groups.select(*GROUP, F.col("lead.doc_id").alias("lead_id"), F.col("lead.text_key").alias("lead_key"))
    # Stored, as only a join of two plain shuffles is split where a group holds many rows.
    led = store(led, "groups")
    return open_rows.join(led, GROUP).select(*ROW, *GROUP, "lead_id", "lead_key")


def classes(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, lead_id, lead_key): the leader of each document whose text another document has too."""
    open_rows, done = prints, None
    while True:
        members = store(_members(open_rows), "members")
        if members.isEmpty():
            break
        wanted = members.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"))
        keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
        # Always by shuffle: the candidates grow with the corpus.
        found = keyed.join(wanted.hint("merge"), keyed["doc_id"].eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left_semi")
        cut = store(_chunk_rows(found), "chunks")
        mine = cut.select(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"), "chunk_no", F.col("chunk").alias("mine"))
        pairs = members.select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), "lead_id", "lead_key")
        leads = members.select("lead_id", "lead_key").distinct()
        # One row for each chunk of a leader: rows that repeat a leader would repeat its comparisons.
        theirs = (
            cut.join(leads, F.col("doc_id").eqNullSafe(F.col("lead_id")) & (F.col("text_key") == F.col("lead_key")), "left_semi")
            .select(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"), F.col("chunk_no").alias("l_no"), F.col("chunk").alias("theirs"))
            .dropDuplicates(["l_id", "l_key", "l_no"])
        )
        theirs = store(theirs, "leading-chunks")
        led = mine.join(pairs, F.col("a_id").eqNullSafe(F.col("p_id")) & (F.col("a_key") == F.col("p_key")))
        compared = led.join(
            theirs,
            F.col("lead_id").eqNullSafe(F.col("l_id")) & (F.col("lead_key") == F.col("l_key")) & (F.col("chunk_no") == F.col("l_no")),
            "left",
        )
        verdict = compared.groupBy(F.col("a_id").alias("doc_id"), F.col("a_key").alias("text_key"), "lead_id", "lead_key").agg(
            F.bool_and(F.col("mine").eqNullSafe(F.col("theirs"))).alias("same")
        )
        verdict = store(verdict, "verdicts")
        equal = verdict.filter("same").drop("same")
        done = equal if done is None else done.unionByName(equal)
        differing = verdict.filter("not same").select(F.col("doc_id").alias("v_id"), F.col("text_key").alias("v_key"))
        if differing.isEmpty():
            break
        open_rows = members.join(differing, F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("text_key") == F.col("v_key")), "left_semi").select(*ROW, *GROUP)
    return done


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, keep_id, group_size, kept, text_sha256), one for each row of ``docs``."""
    prints = store(fingerprints(docs), "prints")
    found = classes(docs, prints)
    row = prints.select("doc_id", "text_key", "n", "text_sha256")
    if found is None:
        led = row.withColumns({"keep_id": F.col("doc_id"), "group_size": F.col("n")})
    else:
        found = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "lead_id", "lead_key")
        joined = row.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
        grouped = store(joined.filter(F.col("lead_key").isNotNull()), "grouped")
        sizes = grouped.groupBy(F.col("lead_id").alias("s_id"), F.col("lead_key").alias("s_key")).agg(F.sum("n").alias("group_size"))
        many = grouped.join(store(sizes, "group-sizes"), F.col("lead_id").eqNullSafe(F.col("s_id")) & (F.col("lead_key") == F.col("s_key")))
        many = many.select(*row.columns, F.col("lead_id").alias("keep_id"), "group_size")
        one = joined.filter(F.col("lead_key").isNull()).select(*row.columns, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        led = one.unionByName(many)
    repeated = led.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return repeated.select("doc_id", "text_key", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row with a smaller doc_id has; all columns stay."""
    return without_rows(docs, exact_duplicates(docs).filter("not kept").select("doc_id", "text_key").distinct())
