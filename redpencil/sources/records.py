"""CSV records over line breaks inside quotes, read from one large file by many tasks.

Every task reads the physical lines of its blocks, in their order, so no line is sorted or moved. A block is a function on
two states: begun outside or inside quotes, it ends outside or inside. A first pass finds the functions, which are
composed over the blocks of each file, so that the state before every block is known without reading a file from its
start. A second pass cuts the blocks into records; only the pieces of those that go over a block's end are brought together.

The rules are the usual ones: a quote opens a field only as its first character, a doubled quote inside a quoted field
is a quote, and whatever follows a closing quote up to the next separator belongs to the field as it is. Line breaks
are line feeds, with or without a carriage return before them, and are kept as they are inside quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.operators.shared import materialize

# States of the reading of a line: at the start of a field, further on in an unquoted one, inside quotes, and after
# a quote inside quotes, which closes the field unless another one follows.
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
BLOCK = ["file", "block"]


def _end_state(line: Column, entry: int) -> Column:
    """1 when a line that is begun in the given state ends inside quotes, else 0."""
    parts = F.split(line, '"')

    def over_text(state: Column, part: Column) -> Column:
        there = F.when(part.endswith(","), F.lit(_START)).otherwise(F.lit(_PLAIN))
        return F.when((part == "") | (state == _QUOTED), state).otherwise(there)

    def over_quote(state: Column) -> Column:
        closed = F.when(state == _QUOTED, F.lit(_CLOSED)).otherwise(F.lit(_PLAIN))
        return F.when(state.isin(_START, _CLOSED), F.lit(_QUOTED)).otherwise(closed)

    before_last = F.slice(parts, 1, F.size(parts) - 1)
    state = F.aggregate(before_last, F.lit(entry), lambda state, part: over_quote(over_text(state, part)))
    # A text after the last quote never opens or closes anything, so the state there decides.
    return (over_text(state, F.element_at(parts, -1)) == _QUOTED).cast("int")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, block, pos, line, from_outside, from_inside): what a line does to either state.

    ``pos`` rises within a block, and blocks rise within a file.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    quotes = F.contains("line", F.lit('"'))
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    ).withColumns(
        {
            "from_outside": F.when(quotes, _end_state(F.col("line"), _START)).otherwise(0),
            "from_inside": F.when(quotes, _end_state(F.col("line"), _QUOTED)).otherwise(1),
        }
    )


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether any record goes over a line break. The first line of such a record begins outside and ends inside quotes."""
    return not _lines(spark, path).filter("from_outside = 1").isEmpty()


def _flipped(state: Column, swaps: Column) -> Column:
    return F.pmod(state + swaps, F.lit(2))


def _scanned(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """With the composition of all functions up to each row: ``swaps``, and ``fixed`` (null while none is constant).

    The state after a row is ``fixed``, or the state at the start where that is null, flipped ``swaps`` times.
    """
    upto = W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, W.currentRow)
    swap = (F.col("from_outside") > F.col("from_inside")).cast("int")
    constant = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    return (
        rows.withColumn("swaps", F.sum(swap).over(upto))
        .withColumn("fixed", F.last(_flipped(constant, F.col("swaps")), ignorenulls=True).over(upto))
        .withColumn("swaps", F.pmod("swaps", F.lit(2)))
    )


# The same rules for a text of whole lines. What repeats never gives back, so that a text is read once.
_FIELD = rb'(?:"(?:[^"]++|"")*+"[^,\n]*+|(?!")[^,\n]*+)'
_RECORD = rb"(?:" + _FIELD + rb",)*+" + _FIELD + rb"\n"
_REST = rb'(?:[^"]++|"")*+"[^,\n]*+(?:,' + _FIELD + rb")*+\n"
_ONE, _END_OF_ONE, _BLANK = re.compile(_RECORD), re.compile(_REST), re.compile(rb"(?: *\n)*+")
_ENDS_OUTSIDE = re.compile(rb"(?:" + _RECORD + rb")*+\Z"), re.compile(_REST + rb"(?:" + _RECORD + rb")*+\Z")
BLOCK_DDL = "file string, block bigint, from_outside int, from_inside int, begins_outside boolean, begins_inside boolean"
PIECE_DDL = "record string, first boolean, file string, block bigint, part int"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
    """The lines of each batch and block as one text, with the batch and the row it begins at. Blocks come one after another."""
    for batch in batches:
        n, (files, blocks, lines) = batch.num_rows, batch.columns[:3]
        key = lambda row: (blocks[row].as_py(), files[row].as_py())
        begin = 0
        while begin < n:
            end = n
            if key(begin) != key(n - 1):
                end = next(row for row in range(begin + 1, n) if key(row) != key(begin))
            part = lines.slice(begin, end - begin)
            offsets = memoryview(part.buffers()[1]).cast("i")
            yield batch, begin, part.buffers()[2][offsets[part.offset] : offsets[part.offset + len(part)]].to_pybytes()
            begin = end


def _block_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: the states it ends in, and whether a record that is not blank begins in it, from either state."""
    names = [field.split()[0] for field in BLOCK_DDL.split(", ")]
    key, ends, begins = None, [0, 1], [False, False]
    row = lambda: pa.RecordBatch.from_pylist([dict(zip(names, (*key, *ends, *begins)))], _ARROW_BLOCK)
    for batch, at, text in _texts(batches):
        here = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
        if here != key:
            if key is not None:
                yield row()
            key, ends, begins = here, [0, 1], [False, False]
        after = {}
        for entry in (0, 1):
            state = ends[entry]
            if not begins[entry]:
                closed = _END_OF_ONE.match(text) if state else None
                past = closed.end() if closed else len(text) if state else 0
                begins[entry] = _BLANK.match(text, past).end() < len(text)
            if state not in after:
                after[state] = int(_ENDS_OUTSIDE[state].match(text) is None)
            ends[entry] = after[state]
    if key is not None:
        yield row()


_ARROW_BLOCK = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.int32()), ("from_inside", pa.int32()),
     ("begins_outside", pa.bool_()), ("begins_inside", pa.bool_())]
)
_ARROW_PIECE = pa.schema(
    [("record", pa.string()), ("first", pa.bool_()), ("file", pa.string()), ("block", pa.int64()), ("part", pa.int32())]
)


def _pieces(headers: bool):
    """Cuts blocks, whose rows say how they begin (entry) and whether the file's header begins there, into records.

    A row is a whole record without its last line break (part null), or a piece with it: the rest of a record from
    an earlier block (0), or the beginning of one that goes on in a later block (1).
    """

    def rows(records: list[bytes], firsts: list[bool], key: tuple, part: int | None) -> pa.RecordBatch:
        n, (file, block) = len(records), key if part is not None else (None, None)
        columns = [pa.array(records, pa.binary()).cast(pa.string()), pa.array(firsts, pa.bool_())]
        columns += [pa.array([value] * n, kind) for value, kind in ((file, pa.string()), (block, pa.int64()), (part, pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW_PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, header, begun, first, earlier = None, False, [], False, False
        for batch, at, text in _texts(batches):
            here = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            if here != key:
                if begun or earlier:
                    yield rows([b"".join(begun)], [first], key, 0 if earlier else 1)
                key, header = here, batch.column(4)[at].as_py()
                begun, first, earlier = [], False, batch.column(3)[at].as_py() == 1
            position, records, firsts = 0, [], []
            if begun or earlier:
                closed = _END_OF_ONE.match(text)
                begun.append(text[: closed.end()] if closed else text)
                if not closed:
                    continue
                if earlier:
                    yield rows([b"".join(begun)], [False], key, 0)
                elif headers or not first:
                    records.append(b"".join(begun)[:-1])
                    firsts.append(first)
                position, begun, first, earlier = closed.end(), [], False, False
            if header:
                position = _BLANK.match(text, position).end()
            match, size = _ONE.match, len(text)
            while position < size:
                found, leads = match(text, position), header
                header = False
                if found is None:
                    begun, first = [text[position:]], leads
                    break
                end = found.end()
                if headers or not leads:
                    records.append(text[position : end - 1])
                    firsts.append(leads)
                position = end
            if records:
                yield rows(records, firsts, key, None)
        if begun or earlier:
            yield rows([b"".join(begun)], [first], key, 0 if earlier else 1)

    return cut


def _blocks(texts: DataFrame) -> DataFrame:
    """Rows (file, block, entry, ends_inside, header): the state before and after each block, and whether the file's header begins there."""
    states = materialize(texts.mapInArrow(_block_states, BLOCK_DDL))
    after = _flipped(F.coalesce("fixed", F.lit(0)), F.col("swaps"))
    before = W.partitionBy("file").orderBy("block")
    known = (
        _scanned(states, ["file"], "block")
        .withColumn("ends_inside", after)
        .withColumn("entry", F.coalesce(F.lag("ends_inside").over(before), F.lit(0)))
    )
    begins = F.when(F.col("entry") == 0, F.col("begins_outside")).otherwise(F.col("begins_inside"))
    header = F.min(F.when(begins, F.col("block"))).over(W.partitionBy("file"))
    return known.select(*BLOCK, "entry", "ends_inside", F.coalesce(F.col("block") == header, F.lit(False)).alias("header"))


def records(spark: SparkSession, path: str, headers: bool = True) -> DataFrame:
    """Rows (first, record): every record as one text; ``first`` marks the first one of each file, its header.

    A file that ends inside quotes is rejected. Headers are left out where ``headers`` says so.
    """
    texts = _lines(spark, path).select(*BLOCK, F.concat("line", F.lit("\n")).alias("line"))
    blocks = materialize(_blocks(texts))
    open_end = blocks.groupBy("file").agg(F.max_by("ends_inside", "block").alias("inside")).filter("inside = 1").limit(1).collect()
    if open_end:
        raise ValueError(f"The file ends inside quotes: {open_end[0]['file']}")
    # A row per block: the hint keeps the lines where and in the order they are.
    begun = texts.join(F.broadcast(blocks.select(*BLOCK, "entry", "header")), BLOCK).select(*BLOCK, "line", "entry", "header")
    stored = materialize(begun.mapInArrow(_pieces(headers), PIECE_DDL))
    whole = stored.filter("part IS NULL").select("first", "record")
    # At most two pieces per block; one that begins a record leads all up to the next.
    upto = W.partitionBy("file").orderBy("block", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    glued = (
        stored.filter("part IS NOT NULL")
        .withColumn("number", F.sum("part").over(upto))
        .groupBy("file", "number")
        .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("parts"))
        .select("first", F.array_join("parts.record", "").alias("record"))
        .select("first", F.left("record", F.length("record") - 1).alias("record"))
    )
    if not headers:
        # Stored, as a later check that raises could otherwise be moved ahead of the removal of the headers.
        glued = materialize(glued.filter(~F.col("first")))
    return (
        whole.unionByName(glued)
        .select("first", F.regexp_replace("record", "\r$", "").alias("record"))
        .filter(F.trim("record") != "")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a CSV file with a header, as text; missing fields are null."""
    options = {"header": "true", "escape": '"', "multiLine": "true"}
    columns = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    kept = records(spark, path, headers=False)
    parsed = F.from_csv("record", schema, {"escape": '"', "multiLine": "true", "lineSep": "\n"})
    # Unfolded, as fields of one parsed column would each parse the record again.
    return kept.select(F.inline(F.array(parsed))).toDF(*columns)
