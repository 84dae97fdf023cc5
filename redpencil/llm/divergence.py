"""How the sources of a language differ in their terms, over the terms that an iceberg search of prefixes keeps.

A language keeps the terms that occur in at least ``LEAST_DOCS`` of its documents. The search goes down byte prefixes
level by level: a prefix whose distinct documents are fewer than that is discarded with all terms below it, and the
others are extended until only complete terms are left. Distinct documents need no full lists: a task lists each
term's first ``LEAST_DOCS`` documents, which decides the threshold for every union of them exactly.

Levels over the tables use counts alone, those of short prefixes from one pass: prefixes below which few rows lie are
units, the others are extended by half their length, and large ones of too few documents go before any term is moved. Then
terms are dealt out by unit, sorted, and refined further down inside the tasks. Lists are moved as bytes, and a language and
a term as one key, as Spark compares and converts these much faster than arrays and several columns. A unit has at most ``UNIT`` rows unless it is one complete term, whose rows are
added up as they come.

The pair sums over all kept terms are taken apart: what a source's terms give against a term that the other source
lacks follows from how often each count occurs, and only the terms that both hold are looked at in pairs, inside the
tasks, which return sums by pair of sources.

Defined results: a null text, lang or source is empty. Repeated rows are documents of their own. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.llm.storage import discard, store, store_at
from redpencil.llm.words import pieces, texts

LEAST_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
# Counts below which SCALE * (count + 1) is a long.
LONG_PRODUCTS = 9_000_000_000
# Rows of counted terms below one prefix that a task refines at once. It grows with the table, so that the prefixes
# above the bound are never more than LARGE_PREFIXES at a level.
UNIT = 1 << 16
LARGE_PREFIXES = 4096
# Length of the prefixes that are counted once for all levels up to it.
SHORT = 4
# Bytes of text whose terms a task counts together, rows that are looked at together, and pairs and sums that are held
# at once.
BYTES_AT_ONCE = 12_000_000
ROWS_AT_ONCE = 50_000
PAIRS_AT_ONCE = 1 << 19
SUMS_AT_ONCE = 1 << 20

# The bytes of terms by characters. Letters a-z and every byte of a non-ASCII character; A-Z are lower-cased.
_TERM_BYTES = np.array([k if k >= 128 or 97 <= k <= 122 else k + 32 if 65 <= k <= 90 else 32 for k in range(256)], np.uint8)
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")

# A byte that UTF-8 does not have, between a language and a term and between the sources of a list.
_APART = b"\xff"

TERMS = "lang string, term binary, sources binary, counts binary, docs binary, full boolean"
KEPT = "lang string, source string, term binary, n bigint, total bigint, first boolean"


def _cuts(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in parts of about this size, cut between terms."""
    start = 0
    while len(text) - start > size:
        gap = _GAP.search(text, start + size)
        if gap is None:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:] if start else text


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Lists of long numbers as bytes, eight for each number."""
    offsets = np.append(0, np.cumsum(sizes * 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(np.int64))])


def _joined(sources: pa.Array, sizes: np.ndarray) -> pa.BinaryArray:
    """Lists of sources as bytes."""
    return pc.binary_join(_lists(sources.cast(pa.binary()), sizes), _APART)


def _numbers(packed: pa.BinaryArray) -> pa.ListArray:
    """The lists that ``_packed`` made."""
    sizes = pc.binary_length(packed).to_numpy() // 8
    data = b"".join(packed.to_pylist()) if packed.buffers()[2] is None else memoryview(packed.buffers()[2])
    start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset] if len(packed) else 0
    return _lists(pa.array(np.frombuffer(data, np.uint8, int(sizes.sum()) * 8, start).view(np.int64)), sizes)


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (key, width, sources, counts, docs) as (lang, term, width, sources, counts, docs) with lists."""
    both = pc.split_pattern(batch.column("key"), _APART, max_splits=1).flatten()
    at = np.arange(batch.num_rows) * 2
    columns = [both.take(pa.array(at)).cast(pa.string()), both.take(pa.array(at + 1)), batch.column("width")]
    columns += [pc.split_pattern(batch.column("sources"), _APART).cast(pa.list_(pa.string()))]
    columns += [_numbers(batch.column(c)) for c in ("counts", "docs")]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "width", "sources", "counts", "docs"])


def _coded(documents: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts in order, as codes, and how many there are up to the end of each text."""
    data = _TERM_BYTES[np.frombuffer(b" ".join(documents), np.uint8)]
    inside = data != 32
    edges = np.flatnonzero(np.append(inside, False) != np.append(False, inside))
    starts, ends = edges[::2], edges[1::2]
    upto = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in documents]))
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    return pa.Array.from_buffers(pa.binary(), len(starts), buffers).dictionary_encode(), upto


def _counted(documents: list[tuple[str, str, int, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """Counted terms of (lang, source, number, text) documents, by one sort of their (term, document) pairs."""
    documents.sort(key=lambda d: d[:3])  # so that the documents of a language, and of a source in it, stand together
    coded, upto = _coded([d[3] for d in documents])
    pairs = coded.indices.to_numpy() * np.int64(len(documents))
    pairs += np.repeat(np.arange(len(documents)), np.diff(upto, prepend=0))
    pairs.sort()
    edges = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    n = np.diff(edges, append=len(pairs))
    term, document = np.divmod(pairs[edges], len(documents))
    del pairs, edges

    langs = pa.array([d[0] for d in documents], pa.string())
    sources = pa.array([d[1] for d in documents], pa.string())
    lang, group = np.cumsum(_changes(langs))[document], np.cumsum(_changes(langs, sources))[document]
    row_first = np.append(True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))[: len(term)]
    group_first = np.append(True, row_first[1:] | (group[1:] != group[:-1]))[: len(term)]
    rows, groups = np.flatnonzero(row_first), np.flatnonzero(group_first)
    n = np.add.reduceat(n, groups) if len(groups) else n
    row = np.cumsum(row_first) - 1
    listed = np.arange(len(term)) - rows[row] < least
    numbers = np.array([d[2] for d in documents], np.int64)
    seen = np.bincount(row[listed], minlength=len(rows))
    size = np.bincount(row[groups], minlength=len(rows))
    columns = [langs.take(pa.array(document[rows])), coded.dictionary.take(pa.array(term[rows]))]
    columns += [_joined(sources.take(pa.array(document[groups])), size), _packed(n, size)]
    columns += [_packed(numbers[document[listed]], seen), pa.array(seen >= least)]
    whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts", "docs", "full"])
    yield from pieces(whole, ROWS_AT_ONCE)


def counted_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Rows (lang, term, sources, counts, docs, full), added up within parts of a task.

    docs lists up to ``least`` documents, and ``full`` tells that it lists as many. The lists are packed.
    """

    def run(batches):
        held: list[tuple[str, str, int, bytes]] = []
        size, number = 0, 0
        for batch in batches:
            names = (batch.column(c).to_pylist() for c in ("part", "lang", "source"))
            for part, lang, source, text in zip(*names, texts(batch)):
                for cut in _cuts(text, BYTES_AT_ONCE):
                    held.append((lang, source, (part << 33) + number, cut))
                    size += len(cut) + 1
                    if size > BYTES_AT_ONCE:
                        yield from _counted(held, least)
                        held, size = [], 0
                        pa.default_memory_pool().release_unused()  # a worker lives on, and would keep it
                number += 1
        if held:
            yield from _counted(held, least)
            held.clear()
            pa.default_memory_pool().release_unused()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(F.spark_partition_id().alias("part"), empty("lang"), empty("source"), "text").mapInArrow(run, TERMS)


# The iceberg search


def _widths() -> Iterator[int]:
    """Lengths of the prefixes, level by level."""
    width = 2
    while True:
        yield width
        width += width // 2


def _key(width: int) -> Column:
    """A language and a prefix of this many bytes, apart by a byte that terms do not have."""
    return F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.substring("term", 1, width))


def _among(column: Column, keys: set[bytes]) -> Column:
    return column.isin(*sorted(keys)) if keys else F.lit(False)


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def _documents(owner: np.ndarray, docs: pa.ListArray, size: int) -> np.ndarray:
    """How many distinct documents the lists of each owner hold."""
    owners = np.repeat(owner, docs.value_lengths().to_numpy())
    _, docs = np.unique(docs.flatten().to_numpy(), return_inverse=True)
    pairs = np.unique(owners * (int(docs.max(initial=0)) + 1) + docs)
    return np.bincount(pairs // (int(docs.max(initial=0)) + 1), minlength=size)


def _large_prefixes(terms: DataFrame, least: int, unit: int) -> tuple[list[tuple[int, set[bytes]]], set[bytes]]:
    """Prefixes with more rows than a unit, as keys: those to be extended, by width, and those of too few documents.

    At most as many for each level as units fit the table.
    """
    counted = lambda rows, n, *by: rows.groupBy(*by).agg(n.alias("rows"), F.max("full").alias("full"))
    short = store(counted(terms, F.count(F.lit(1)), "lang", F.substring("term", 1, SHORT).alias("term")), "prefixes")
    levels, dead, below = [], set(), terms
    for width in _widths():
        # A short prefix is as long as its terms where those are not longer than the level.
        rows, n = (short, F.sum("rows")) if width <= SHORT else (below, F.count(F.lit(1)))
        # A row that lists enough documents settles its prefix. Elsewhere all lists are complete and are counted.
        found = counted(rows, n, _key(width).alias("key")).filter(F.col("rows") > unit).collect()
        open_ = {bytes(r["key"]) for r in found}
        unsettled = {bytes(r["key"]) for r in found if not r["full"]}
        if unsettled:
            keyed = below.withColumn("key", _key(width)).filter(_among(F.col("key"), unsettled))
            ids = F.transform(F.sequence(F.lit(1), F.octet_length("docs"), F.lit(8)), lambda at: F.substring("docs", at, F.lit(8)))
            documents = keyed.select("key", F.explode(ids).alias("doc")).distinct()
            rare = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least).collect()
            dead |= {bytes(r["key"]) for r in rare}
        open_ -= dead
        if not open_:
            return levels, dead
        levels.append((width, open_))
        # A complete term is not extended.
        longer = _among(_key(width), open_) & (F.octet_length("term") > width)
        below, short = below.filter(longer), short.filter(longer)


def refined(terms: pa.Array, owner: np.ndarray, docs: pa.ListArray, least: int) -> np.ndarray:
    """Which of the sorted distinct ``terms`` have at least ``least`` documents, by prefixes extended level by level.

    Row k of ``docs`` lists documents of the term ``owner[k]``.
    """
    alive = np.arange(len(terms))
    for width in _widths():
        prefixes = pc.binary_slice(terms.take(pa.array(alive)), 0, width)
        own = np.cumsum(_changes(prefixes)) - 1 if len(alive) else alive
        place = np.full(len(terms), -1)
        place[alive] = own
        rows = place[owner] >= 0
        seen = _documents(place[owner[rows]], docs.filter(pa.array(rows)), own[-1] + 1 if len(own) else 0)
        complete = len(own) == 0 or own[-1] + 1 == len(alive)  # every prefix is left with one term
        longest = complete or pc.max(pc.binary_length(terms)).as_py() <= width
        alive = alive[seen[own] >= least] if len(own) else alive
        if longest:
            out = np.zeros(len(terms), bool)
            out[alive] = True
            return out


def _kept_of(table: pa.Table, least: int) -> pa.RecordBatch:
    """The kept terms of one unit, whose rows are sorted by term."""
    table = table.combine_chunks()
    lang, term, sources, counts, docs = (table.column(c).combine_chunks() for c in ("lang", "term", "sources", "counts", "docs"))
    new = _changes(term)
    owner = np.cumsum(new) - 1
    terms = term.filter(pa.array(new))
    kept = refined(terms, owner, docs, least)
    owner = np.repeat(owner, sources.value_lengths().to_numpy())
    rows = kept[owner]
    coded = sources.flatten().dictionary_encode()
    names, n = coded.dictionary, counts.flatten().to_numpy()[rows]
    pairs, place = np.unique(owner[rows] * len(names) + coded.indices.to_numpy()[rows], return_inverse=True)
    added, totals = np.zeros(len(pairs), np.int64), np.zeros(len(terms), np.int64)
    np.add.at(added, place, n)
    np.add.at(totals, owner[rows], n)
    of = pairs // max(1, len(names))
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    columns = [lang.take(pa.array(np.zeros(len(pairs), np.int64))), names.take(pa.array(pairs % max(1, len(names)))), terms.take(pa.array(of))]
    columns += [pa.array(added), pa.array(totals[of]), pa.array(first)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "total", "first"])


def _starts(table: pa.Table) -> np.ndarray:
    """Where the units start, in rows sorted by language and term; ``width`` is the length of a row's unit."""
    lang, term, width = (table.column(c).combine_chunks() for c in ("lang", "term", "width"))
    new, widths = _changes(lang, width), width.to_numpy()
    for size in np.unique(widths).tolist():
        new |= (widths == size) & _changes(pc.binary_slice(term, 0, size))
    return np.flatnonzero(new)


def _shrunk(table: pa.Table, least: int) -> pa.Table:
    """The rows of one term as one row: counts added up by source, with at most ``least`` documents."""
    added: Counter = Counter()
    docs: set[int] = set()
    for sources, counts, seen in zip(*(table.column(c).to_pylist() for c in ("sources", "counts", "docs"))):
        for source, n in zip(sources, counts):
            added[source] += n
        if len(docs) < least:
            docs.update(seen)
    first = table.slice(0, 1)
    rows = [first.column(c).combine_chunks() for c in ("lang", "term", "width")]
    rows += [pa.array([list(added)], pa.list_(pa.string())), pa.array([list(added.values())], pa.list_(pa.int64())), pa.array([sorted(docs)[:least]], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(rows, table.column_names)


def kept_terms(terms: DataFrame, least: int = LEAST_DOCS, unit: int = UNIT) -> DataFrame:
    """Rows (lang, source, term, n, total, first) of the terms that a language keeps, by source that holds them.

    ``total`` is the term's count in its language, and ``first`` is true on one row for each (lang, term).
    """
    unit = max(unit, terms.count() // LARGE_PREFIXES)
    levels, dead = _large_prefixes(terms, least, unit)
    deepest = next(w for w in _widths() if not levels or w > levels[-1][0])
    place = F.lit(deepest)
    for width, open_ in reversed(levels):
        place = F.when(_among(_key(width), open_), place).otherwise(F.lit(width))
    prefix = F.substring("term", F.lit(1), place)
    key = F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), prefix)

    def refine(batches):
        held, rows = [], 0
        for batch in batches:
            # Units whose end has come are solved; of the last one it is not known yet.
            held.append(_unpacked(batch))
            rows += batch.num_rows
            if rows < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            for lo, hi in zip(starts[:-1], starts[1:]):
                yield _kept_of(table.slice(lo, hi - lo), least)
            table = table.slice(starts[-1])
            if table.num_rows > 2 * unit and table.column("term")[0] == table.column("term")[-1]:
                table = _shrunk(table, least)
            held, rows = table.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = np.append(_starts(table), table.num_rows)
            for lo, hi in zip(starts[:-1], starts[1:]):
                yield _kept_of(table.slice(lo, hi - lo), least)

    # The terms of a unit are a range of the keys.
    whole = F.concat(F.encode("lang", "UTF-8"), F.lit(_APART), "term")
    moved = terms.filter(~_among(key, dead)).repartition("lang", prefix)
    moved = moved.select(whole.alias("key"), place.alias("width"), "sources", "counts", "docs").sortWithinPartitions("key")
    return moved.mapInArrow(refine, KEPT)


# Shares and divergences


def _share(n: Column, tokens: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (tokens + terms)) without rounding; null without terms."""
    size, n = F.nullif(tokens + terms, F.lit(0)), n.cast("bigint")
    # Decimals are slow, and only needed where the product exceeds a long.
    exact = F.lit(SCALE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)")
    large = F.call_function("div", exact, size.cast("decimal(20,0)"))
    small = F.call_function("div", F.lit(SCALE).cast("bigint") * (n + 1), size)
    return (F.when(n < LONG_PRODUCTS, small).otherwise(large) + 1).cast("bigint")


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _common_sums(kept: DataFrame) -> DataFrame:
    """Rows (lang, source, item, value): what terms in both sources give beyond what they give where one lacks them."""
    shape = "lang string, source string, item string, value bigint"

    def run(batches):
        number: dict[tuple, int] = {}
        sums: Counter = Counter()

        def add(table: pa.Table) -> None:
            """Ordered pairs of the rows of a term; the rows of one term stand together."""
            owner = np.cumsum(_changes(*(table.column(c).combine_chunks() for c in ("lang", "term"))))
            p, none = table.column("p").to_numpy(), table.column("none").to_numpy()
            group, names = _groups(table)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            others, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
            upto = np.cumsum(others)
            at = 0
            while at < len(owner):
                base = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, side="right")))
                i = np.repeat(np.arange(at, end), others[at:end])
                j = np.arange(len(i)) - np.repeat(upto[at:end] - others[at:end] - base, others[at:end]) + first[i]
                i, j = i[i != j], j[i != j]
                value = _gaps(p[i], p[j]) - _gaps(p[i], none[j]) - _gaps(none[i], p[j]) + _gaps(none[i], none[j])
                pair = group[i] * len(names) + group[j]
                if len(names) <= 512:
                    total = np.zeros(len(names) ** 2, np.int64)
                    np.add.at(total, pair, value)
                    pair = np.flatnonzero(np.bincount(pair, minlength=len(total)))
                    total = total[pair]
                else:
                    pair, place = np.unique(pair, return_inverse=True)
                    total = np.zeros(len(pair), np.int64)
                    np.add.at(total, place, value)
                for both, found in zip(pair.tolist(), total.tolist()):
                    g, o = divmod(both, len(names))
                    sums[number.setdefault(names[g], len(number)), number.setdefault(names[o], len(number))] += found
                at = end

        def written():
            names = list(number)
            rows = [(*names[g], names[o][1], value) for (g, o), value in sums.items()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate([pa.string()] * 3 + [pa.int64()])]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(_changes(*(table.column(c).combine_chunks() for c in ("lang", "term"))))[-1])
            if cut:  # the last term may go on
                add(table.slice(0, cut).combine_chunks())
                table = table.slice(cut)
            held, rows = table.to_batches(), table.num_rows
            if len(sums) > SUMS_AT_ONCE:
                yield written()
                number.clear()
                sums.clear()
        if rows:
            add(pa.Table.from_batches(held).combine_chunks())
        yield written()

    rows = kept.select("lang", "source", "term", "p", "none").repartition("lang", "term").sortWithinPartitions("term", "lang")
    return rows.mapInArrow(run, shape).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _groups(table: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's (lang, source), and what the numbers stand for."""
    lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    found, group = np.unique(both, return_inverse=True)
    names = [(lang.dictionary[k // len(source.dictionary)].as_py(), source.dictionary[k % len(source.dictionary)].as_py()) for k in found.tolist()]
    return group, names


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS, unit: int = UNIT) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair`` compares a source with each other source of its language over all kept terms; part ``term`` lists
    the terms that the source holds more often than its language, the first ``ranks`` of them.
    """
    spark = docs.sparkSession
    terms, path = store_at(counted_terms(docs, least), "terms")
    kept = store(kept_terms(terms, least, unit), "kept-terms")
    discard(spark, path)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_tokens"), F.count_if("first").alias("terms"))
    groups = (
        docs.select(empty("lang"), empty("source"))
        .distinct()
        .join(langs, "lang", "left")
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("tokens")), ["lang", "source"], "left")
        .fillna(0, ["lang_tokens", "terms", "tokens"])
        .withColumn("none", _share(F.lit(0), F.col("tokens"), F.col("terms")))
    )
    groups = store(groups, "groups")
    shares = store(
        kept.join(groups, ["lang", "source"]).select(
            "lang",
            "source",
            "term",
            "none",
            _share(F.col("n"), F.col("tokens"), F.col("terms")).alias("p"),
            _share(F.col("total"), F.col("lang_tokens"), F.col("terms")).alias("q"),
        ),
        "shares",
    )

    own = groups.select("lang", "source", "none", "terms")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    all_pairs = own.join(other, "lang").filter("source != item")
    absent = all_pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * _gap(F.col("none"), F.col("item_none")), F.lit(0)).alias("value"))
    # How often each share occurs in a source, against each other source that lacks the term; the same for its partner.
    counts = shares.groupBy("lang", "source", "none", "p").agg(F.count(F.lit(1)).alias("n"))
    against = counts.join(other, "lang").filter("source != item")
    base = lambda a, b: _gap(F.col(a), F.col(b))
    alone = against.groupBy("lang", "source", "item").agg(
        F.sum(F.col("n") * (base("p", "item_none") - base("none", "item_none"))).alias("mine"),
        F.sum(F.col("n") * (base("item_none", "p") - base("item_none", "none"))).alias("theirs"),
    )
    alone = store(alone, "alone")
    sums = [
        absent,
        alone.select("lang", "source", "item", F.col("mine").alias("value")),
        alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value")),
        _common_sums(shares),
    ]
    pairs = sums[0]
    for part in sums[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    over = shares.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")).withColumn("part", F.lit("term"))

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_terms = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    found = pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked_terms)
    return found.select("lang", "source", "part", "item", "value", "rank")
