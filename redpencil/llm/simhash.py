"""Near-duplicates by SimHash: a trie self-join of 64-bit fingerprints, then connected components.

Fingerprints are made once per document and reduced to the distinct ones. Two fingerprints link when they
differ in at most ``budget`` bits. The join walks a binary trie against itself: node pairs go down one bit at
a time and add up the bits in which they differ, and a pair is dropped as soon as it exceeds the budget.

To share the walk out, the bits are rotated ``budget + 1`` times by equal blocks. Two fingerprints within the
budget agree on at least one whole block, so in one of the rotations they meet under the same node at the
depth of a block. A node below which too many fingerprints lie is replaced by the pairs of its children that
are still within the budget, level by level, until every pair fits a task. A task returns a spanning forest of
the links it finds and not the links themselves, so its output is never larger than its input.

Defined results: a null or blank text has no words and the fingerprint zero, linked like any other. Rows that
share a doc_id are told apart by their text. A row without a doc_id gets the component of its fingerprint; if
no row of the component has a doc_id, it is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.components import connected_components
from redpencil.llm.storage import store, text_key, without_rows
from redpencil.llm.words import pieces, spaced_words, texts

BITS = 64
SEED = 42
WORDS = 3
BUDGET = 3
# Bound on the fingerprints below one node that a task takes; it bounds memory, not the result.
NODE_ROWS = 1 << 15
# Node pairs of at most so many comparisons are compared at once.
DIRECT = 64
FRONTIER = 1 << 18
SHINGLES_AT_ONCE = 1 << 16
STEP = 8


def _hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles, repeats included, in arrays of bounded size."""
    found = spaced_words(text)
    if not found:
        return
    count = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    for start in range(0, count, SHINGLES_AT_ONCE):
        stop = min(count, start + SHINGLES_AT_ONCE)
        rows = zip(*(found[start + k : stop + k] for k in range(words))) if len(found) >= words else [found]
        yield np.fromiter((digest(b" ".join(row), SEED) for row in rows), np.uint64, stop - start)


def _fingerprints_of(batch: list[bytes], words: int) -> np.ndarray:
    """A fingerprint for each text: a bit is set when it is set in over half of the shingle hashes."""
    ones = np.zeros((len(batch), BITS), np.int64)
    totals = np.zeros(len(batch), np.int64)
    parts, owners, waiting = [], [], 0

    def flush() -> None:
        nonlocal waiting
        if parts:
            joined = np.concatenate(parts).astype(">u8").view(np.uint8).reshape(-1, 8)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
            np.add.at(ones, owners, np.add.reduceat(np.unpackbits(joined, axis=1), starts, axis=0, dtype=np.int64))
            parts.clear()
            owners.clear()
            waiting = 0

    for k, text in enumerate(batch):
        for part in _hashes(text, words):
            parts.append(part)
            owners.append(k)
            totals[k] += len(part)
            waiting += len(part)
            if waiting >= SHINGLES_AT_ONCE:
                flush()
    flush()
    return np.packbits(ones * 2 > totals[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, text_key, bits): the fingerprint of each document as a signed 64-bit number."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text_key", T.LongType()), T.StructField("bits", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                bits = _fingerprints_of(list(texts(batch)), words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(bits)], ["doc_id", "text_key", "bits"]
                )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


# The walk inside a task


class _Forest:
    """Union of linked rows by smallest index, vectorised."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if np.array_equal(jumped, label):
                    break
                label[:] = jumped


def _combinations(a_lo, a_n, b_lo, b_n) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of the given index ranges."""
    sizes = a_n * b_n
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_lo[owner] + place // b_n[owner], b_lo[owner] + place % b_n[owner]


def _walk(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int, forest: _Forest) -> None:
    """Link the values within the budget below the given node pairs.

    ``values`` are sorted below each node, so a node is an index range. ``pairs`` has rows
    (a_lo, a_hi, b_lo, b_hi, errors); equal ranges stand for a node paired with itself.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, pairs)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [(depth, part) for part in np.array_split(pairs, len(pairs) // FRONTIER + 1)]
            continue
        a_lo, a_hi, b_lo, b_hi, errors = pairs.T
        small = (a_hi - a_lo) * (b_hi - b_lo) <= DIRECT
        if small.any():
            i, j = _combinations(a_lo[small], (a_hi - a_lo)[small], b_lo[small], (b_hi - b_lo)[small])
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            forest.link(i[near], j[near])
            a_lo, a_hi, b_lo, b_hi, errors = pairs[~small].T
        if not len(a_lo):
            continue
        if depth == BITS:  # only equal values are left below a node
            i, j = np.concatenate([a_lo, b_lo]), np.concatenate([b_lo, b_lo])
            forest.link(i, j)
            for lo, hi in ((a_lo, a_hi), (b_lo, b_hi)):
                rest, first = _combinations(lo, hi - lo, lo, np.ones_like(lo))
                forest.link(rest, first)
            continue
        if depth not in ones:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        total = ones[depth]
        a_mid, b_mid = a_hi - (total[a_hi] - total[a_lo]), b_hi - (total[b_hi] - total[b_lo])
        itself = a_lo == b_lo
        children = [
            np.stack([a_lo, a_mid, b_lo, b_mid, errors], 1),
            np.stack([a_mid, a_hi, b_mid, b_hi, errors], 1),
            np.stack([a_lo, a_mid, b_mid, b_hi, errors + 1], 1),
            np.stack([a_mid, a_hi, b_lo, b_mid, errors + 1], 1)[~itself],
        ]
        below = np.concatenate(children)
        below = below[(below[:, 4] <= budget) & (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])]
        below = below[(below[:, 0] != below[:, 2]) | (below[:, 1] - below[:, 0] > 1)]
        if len(below):
            stack.append((depth + 1, below))


def _join_units(batches, depth: int, budget: int) -> Iterator[pa.RecordBatch]:
    """Links of the units (turn, a, b) in a partition that is sorted by unit, side and value."""

    def changes(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in ("turn", "a", "b")]
        return np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1

    def solve(table: pa.Table) -> pa.RecordBatch:
        starts = np.concatenate([[0], changes(table)])
        ends = np.append(starts[1:], table.num_rows)
        second = np.concatenate([[0], np.cumsum(table.column("side").to_numpy())])
        cut = ends - (second[ends] - second[starts])  # where the rows of node b begin
        errors = table.column("errors").to_numpy()[starts]
        itself = table.column("a").to_numpy()[starts] == table.column("b").to_numpy()[starts]
        lone = np.stack([starts, ends, starts, ends, errors], 1)[itself & (ends - starts > 1)]
        pair = np.stack([starts, cut, cut, ends, errors], 1)[~itself]
        values = table.column("turned").to_numpy().astype(np.uint64)
        forest = _Forest(len(values))
        _walk(values, np.concatenate([lone, pair]).astype(np.int64), depth, budget, forest)
        moved = np.flatnonzero(forest.label != np.arange(len(values)))
        bits = table.column("bits").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(bits[moved]), pa.array(bits[forest.label[moved]])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows < NODE_ROWS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        inner = changes(table)
        if len(inner):
            yield solve(table.slice(0, inner[-1]))
            table = table.slice(inner[-1])
        held, rows = table.to_batches(), table.num_rows
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


# The walk above the tasks


def _rotations(distinct: DataFrame, budget: int) -> DataFrame:
    """Rows (turn, bits, turned) for each rotation by a block. ``turned`` is offset so that it sorts as unsigned."""
    block = BITS // (budget + 1)
    turns = F.array(
        *[
            F.struct(
                F.lit(k).alias("turn"),
                (F.shiftleft("bits", k * block).bitwiseOR(F.shiftrightunsigned("bits", BITS - k * block)) if k else F.col("bits")).alias("turned"),
            )
            for k in range(budget + 1)
        ]
    )
    return distinct.select("bits", F.explode(turns).alias("t")).select("t.turn", "bits", "t.turned")


def _node(depth: int) -> Column:
    return F.shiftrightunsigned("turned", BITS - depth)


def _below(rotated: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """Rows (turn, a, b, errors, side, turned, bits): everything below both nodes of each pair."""
    left = pairs.select("turn", F.col("a").alias("node"), "a", "b", "errors", F.lit(0).alias("side"))
    right = pairs.filter("a != b").select("turn", F.col("b").alias("node"), "a", "b", "errors", F.lit(1).alias("side"))
    return rotated.withColumn("node", _node(depth)).join(left.unionByName(right), ["turn", "node"]).drop("node")


def _units(rotated: DataFrame, budget: int, node_rows: int) -> Iterator[tuple[int, DataFrame]]:
    """(depth, rows) of the node pairs that fit a task, with all that lies below them."""
    depth = BITS // (budget + 1)
    nodes = rotated.groupBy("turn", _node(depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    large = store(nodes.filter(F.col("n") > node_rows).select("turn", "node"), "large-nodes")
    fitting = rotated.withColumn("node", _node(depth))
    split = not large.isEmpty()
    if split:
        fitting = fitting.join(large, ["turn", "node"], "left_anti")
    alone = [F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("errors")]
    yield depth, fitting.select("turn", *alone, F.lit(0).alias("side"), "turned", "bits")
    pairs = large.select("turn", *alone)
    while split:
        step = min(STEP, BITS - depth)
        inside = rotated.withColumn("node", _node(depth)).join(large, ["turn", "node"], "left_semi")
        children = store(inside.groupBy("turn", "node", _node(depth + step).alias("child")).agg(F.count(F.lit(1)).alias("n")), "children")
        depth += step
        one = children.select("turn", F.col("node").alias("a"), F.col("child").alias("c"), F.col("n").alias("n_c"))
        two = children.select("turn", F.col("node").alias("b"), F.col("child").alias("d"), F.col("n").alias("n_d"))
        down = (
            pairs.join(one, ["turn", "a"])
            .join(two, ["turn", "b"])
            .filter("a != b or c < d or (c = d and n_c > 1)")
            .withColumn("errors", F.bit_count(F.col("c").bitwiseXOR(F.col("d"))).cast("int"))  # nodes are whole prefixes
            .filter(F.col("errors") <= budget)
            .select("turn", F.col("c").alias("a"), F.col("d").alias("b"), "errors", F.greatest("n_c", "n_d").alias("n"))
        )
        down = store(down, "node-pairs")
        fits = (F.col("n") <= node_rows) | F.lit(depth >= BITS)
        yield depth, _below(rotated, down.filter(fits), depth).select("turn", "a", "b", "errors", "side", "turned", "bits")
        pairs = down.filter(~fits)
        large = store(pairs.select("turn", F.explode(F.array("a", "b")).alias("node")).distinct(), "large-nodes")
        split = not large.isEmpty()


def links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (u, v) that connect all fingerprints ``bits`` within the budget of each other, directly or over others."""
    rotated = _rotations(distinct, budget)
    found = None
    for depth, rows in _units(rotated, budget, node_rows):
        dealt = rows.repartition("turn", "a", "b").sortWithinPartitions("turn", "a", "b", "side", "turned")
        part = dealt.mapInArrow(lambda batches, depth=depth: _join_units(batches, depth, budget), "u bigint, v bigint")
        found = part if found is None else found.unionByName(part)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Rows (doc_id, text_key, bits, component_id): the smallest doc_id reachable over links, for every row of ``docs``."""
    made = store(fingerprints(docs, words), "fingerprints")
    distinct = store(made.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(distinct, budget, node_rows))
    rooted = distinct.join(roots, F.col("bits") == F.col("u"), "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    rooted = store(rooted, "rooted")
    # Both stored, as only joins of plain shuffles are split where a component or fingerprint holds many rows.
    smallest = store(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    components = store(rooted.join(smallest, "root").select("bits", "component_id"), "components")
    return made.join(components, "bits", "left").select("doc_id", "text_key", "bits", "component_id")


def keep_one_each(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component; all columns stay."""
    found = near_duplicates(docs, words, budget)
    return without_rows(docs, found.filter(F.col("doc_id") != F.col("component_id")))
