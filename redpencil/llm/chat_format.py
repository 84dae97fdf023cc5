"""Chat formatting: roles of transcript lines by a hidden Markov model, then one canonical form of the turns.

A transcript is a sequence of turns; a turn's text may hold several speakers, each opened by a speaker marker at
the start of a line ("User:", "### Assistant", "<|system|>"). Texts are cut at the markers into segments. The
states of the model are roles; a segment's observation is its marker and the shape of its lines (length,
question, list or code, place in the transcript). The tables are counts over segments of known role.

The best role sequence comes from Viterbi, which is a product of matrices in the (max, +) algebra and so can be
cut anywhere: segments are range-partitioned by conversation and turn, each partition reduces its runs
to one matrix each, the matrices of a conversation that spans partitions are multiplied in order, and each
partition then decodes its runs between known ends. So a conversation may hold any share of all turns.

Defined results: a null text is empty; an empty turn is one empty segment. Turns of equal number in a conversation
are ordered by role and text; rows that repeat are segments each. A null conv_id is a conversation of its own. Without known
roles, marked segments have the role of their marker, and the others alternate as the fixed prior says. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redpencil.llm.storage import store

ROLES = ("system", "user", "assistant")
# Names of speakers and the roles they stand for.
SPEAKERS = {
    "system": "system instruction instructions",
    "user": "user human question q customer client prompter",
    "assistant": "assistant ai bot answer a gpt model agent response",
}
_ROLE_OF = {name: ROLES.index(role) for role, names in SPEAKERS.items() for name in names.split()}
_NAMES = "|".join(sorted(_ROLE_OF, key=lambda n: (-len(n), n)))
_MARKER = re.compile(rf"(?im)^[ \t]*(?:<\|({_NAMES})\|>|\[({_NAMES})\]:?|(?:#+|\*\*)[ \t]*({_NAMES})[ \t]*(?:\*\*)?:?[ \t]*(?=$)|(?:\*\*)?({_NAMES})(?:\*\*)?[ \t]*[:>](?:\*\*)?)[ \t]*")
_LIST = re.compile(r"(?m)^\s*(?:[-*•]|\d+[.)])\s")
SIZES = (40, 100, 200, 400, 800, 1600)
MARKERS, LENGTHS, SHAPES, PLACES = len(ROLES) + 1, len(SIZES) + 1, 4, 3
OBSERVATIONS = (MARKERS, LENGTHS, SHAPES, PLACES)
FOLDS = 5


def segments(text: str) -> list[tuple[int, str]]:
    """(marker, text) of a turn: the role of the marker, or ``len(ROLES)`` for none."""
    found = list(_MARKER.finditer(text))
    if not found:
        return [(len(ROLES), text)]
    out = []
    if text[: found[0].start()].strip():
        out.append((len(ROLES), text[: found[0].start()].strip()))
    for match, after in zip(found, [*found[1:], None]):
        name = next(g for g in match.groups() if g)
        out.append((_ROLE_OF[name.lower()], text[match.end() : after.start() if after else len(text)].strip()))
    return out


def observation(marker: int, text: str, place: int) -> tuple[int, int, int, int]:
    """Marker, length, shape of the lines, and place: first segment, second, or later."""
    length = sum(len(text) > size for size in SIZES)
    shape = 3 if "```" in text or "\n    " in text else 2 if _LIST.search(text) else 1 if text.rstrip().endswith("?") else 0
    return marker, length, shape, min(place, PLACES - 1)


@dataclass
class RoleModel:
    """Logarithms: start (roles), move (roles, roles), and a table for each part of the observation."""

    start: np.ndarray
    move: np.ndarray
    tables: list[np.ndarray]

    @classmethod
    def prior(cls) -> RoleModel:
        """Conversations open with a system or user turn and alternate; markers are nearly always right."""
        start = np.array([0.3, 0.6, 0.1])
        move = np.array([[0.02, 0.95, 0.03], [0.01, 0.09, 0.9], [0.01, 0.9, 0.09]])
        marker = np.full((3, MARKERS), 0.005)
        marker[:, -1] = 0.5
        marker[np.arange(3), np.arange(3)] = 0.49
        flat = [np.full((3, n), 1 / n) for n in OBSERVATIONS[1:]]
        return cls(np.log(start), np.log(move), [np.log(t) for t in (marker, *flat)])

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, tables: list[np.ndarray]) -> RoleModel:
        """Relative frequencies, with the prior as ten more observations of each role."""
        prior = cls.prior()
        mix = lambda n, p: np.log((n + 10 * np.exp(p)) / (n + 10 * np.exp(p)).sum(-1, keepdims=True))
        return cls(mix(start, prior.start), mix(move, prior.move), [mix(n, p) for n, p in zip(tables, prior.tables)])

    def emit(self, observed: np.ndarray) -> np.ndarray:
        """(segments, roles) log weights of the observations."""
        return sum(table.T[observed[:, k]] for k, table in enumerate(self.tables))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) algebra."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def run_matrix(model: RoleModel, emit: np.ndarray, opens: bool = False) -> np.ndarray:
    """Best weight from a role before the run to a role at its end; a run that opens a conversation has no role before it."""
    total = (np.tile(model.start, (len(ROLES), 1)) if opens else model.move) + emit[0]
    for row in emit[1:]:
        total = _join(total, model.move + row)
    return total


def decode(model: RoleModel, emit: np.ndarray, entry: np.ndarray, exit_: np.ndarray) -> np.ndarray:
    """Best roles of a run, given the weights of the roles at its first segment and of what follows its last."""
    best, back = entry + emit[0], []
    for row in emit[1:]:
        step = best[:, None] + model.move
        back.append(step.argmax(0))
        best = step.max(0) + row
    roles = np.empty(len(emit), np.int64)
    roles[-1] = (best + exit_).argmax()
    for k in range(len(emit) - 2, -1, -1):
        roles[k] = back[k][roles[k + 1]]
    return roles


# Spark

RUN = 128
RUN_CHARS = 1 << 20


def is_held_out(folds: int = FOLDS):
    """Conversations whose known roles are not learned from."""
    return F.coalesce(F.pmod(F.crc32(F.expr("substring(conv, 2)")), F.lit(folds)) == 0, F.lit(True))


def parsed(turns: DataFrame) -> DataFrame:
    """Runs of at most ``RUN`` consecutive segments of a conversation, a row each.

    Turns are range-partitioned by conversation and order, so a large conversation is spread over partitions.
    ``part`` and ``run`` give the order; ``before`` and ``previous`` are the number of segments and the last known role
    of the conversation before the run in the same partition. Roles are numbers, -1 for unknown.
    """
    turn_type = turns.schema["turn"].dataType.simpleString()
    schema = (
        f"conv string, part int, run int, n int, before int, previous int, turns array<{turn_type}>, places array<int>, "
        "known array<int>, observed binary, texts array<string>"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    keyed = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"),
        "turn",
        F.col("role").cast("string").alias("role"),
        "text",
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "text", "tie"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        state = {"conv": None, "run": 0, "before": 0, "previous": -1}
        held: list[tuple] = []  # (turn, place, known, marker, length, shape, text)
        out: list[tuple] = []
        size, part, turn_kind = 0, 0, None

        def close() -> None:
            nonlocal size
            if held:
                turn, place, known, *observed, text = (list(c) for c in zip(*held))
                codes = np.array(observed, np.uint8).T.tobytes()
                out.append((state["conv"], part, state["run"], len(held), state["before"], state["previous"], turn, place, known, codes, text))
                state.update(run=state["run"] + 1, before=state["before"] + len(held), previous=known[-1])
                held.clear()
                size = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), *[pa.int32()] * 5, pa.list_(turn_kind), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string())]
            columns = zip(*out) if out else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)
            out.clear()
            return made

        for batch in batches:
            turn_kind = batch.column("turn").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "part", "turn", "role", "text")]
            for conv, part, turn, role, text in zip(*columns):
                if conv != state["conv"]:
                    close()
                    state.update(conv=conv, before=0, previous=-1)
                found = segments(text or "")
                known = ROLES.index(role) if role in ROLES and len(found) == 1 else -1
                for place, (marker, piece) in enumerate(found):
                    held.append((turn, place, known, *observation(marker, piece, 0)[:3], piece))
                    size += len(piece)
                    if len(held) >= RUN or size >= RUN_CHARS:
                        close()
                if len(out) >= 2000:
                    yield flush()
        close()
        if out:
            yield flush()

    return dealt.select("conv", "part", "turn", "role", "text").mapInArrow(run, schema)


def _parts(runs: DataFrame) -> DataFrame:
    """Rows (conv, part, offset, carried, runs_in_all): what came before each part of a conversation, and its runs in all.

    A conversation has at most one row for each range partition.
    """
    parts = runs.groupBy("conv", "part").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_runs"), F.max_by(F.element_at("known", -1), "run").alias("last")
    )
    ordered = W.partitionBy("conv").orderBy("part")
    return parts.select(
        "conv",
        "part",
        F.coalesce(F.sum("n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("offset"),
        F.coalesce(F.lag("last").over(ordered), F.lit(-1)).alias("carried"),
        F.sum("n_runs").over(W.partitionBy("conv")).alias("runs_in_all"),
    )


def _observed(data: bytes, n: int, before: int) -> np.ndarray:
    places = np.minimum(before + np.arange(n), PLACES - 1)
    return np.column_stack([np.frombuffer(data, np.uint8).reshape(n, 3), places]).astype(np.int64)


_SHAPES = [(3,), (3, 3), *[(3, n) for n in OBSERVATIONS]]


def learn(runs: DataFrame) -> RoleModel:
    """Counts of starts, moves and observations over all segments of known role that are not held out."""
    def run(batches):
        counts = [np.zeros(shape) for shape in _SHAPES]
        for batch in batches:
            for row in batch.to_pylist():
                known = np.array(row["known"])
                observed = _observed(row["observed"], row["n"], row["before"] + row["offset"])
                sure = known >= 0
                first = row["before"] + row["offset"] == 0
                if first and sure[0]:
                    counts[0][known[0]] += 1
                earlier = row["previous"] if row["before"] else row["carried"]
                chain = known if first else np.concatenate([[earlier], known])
                both = (chain[:-1] >= 0) & (chain[1:] >= 0)
                np.add.at(counts[1], (chain[:-1][both], chain[1:][both]), 1)
                for k in range(len(OBSERVATIONS)):
                    np.add.at(counts[2 + k], (known[sure], observed[sure, k]), 1)
        flat = np.concatenate([c.ravel() for c in counts])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "n"])

    used = runs.filter(~is_held_out()).select("known", "observed", "n", "before", "offset", "previous", "carried")
    summed = used.mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n"))
    sizes = [int(np.prod(shape)) for shape in _SHAPES]
    flat = np.zeros(sum(sizes))
    for place, n in summed.collect():  # bounded: the size of the tables
        flat[place] = n
    start, move, *tables = (p.reshape(s) for p, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), _SHAPES))
    return RoleModel.from_counts(start, move, tables)


def _bounds(runs: DataFrame, model: RoleModel) -> DataFrame:
    """Rows (conv, part, run, entry, exit) for conversations of several runs: weights around each run.

    Runs are multiplied per part first, so that no group holds more than the runs of a part or the parts of a conversation.
    """
    def matrices(batches):
        for batch in batches:
            made = []
            for r in batch.select(["observed", "n", "before", "offset"]).to_pylist():
                at = r["before"] + r["offset"]
                made.append(run_matrix(model, model.emit(_observed(r["observed"], r["n"], at)), at == 0).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv", "part", "run")] + [pa.array(made, pa.list_(pa.float64()))], ["conv", "part", "run", "m"])

    def around(m: list[np.ndarray]) -> tuple[list, list]:
        """Products before and after each place; None for nothing."""
        left, right = [None], [None]
        for x in m[:-1]:
            left.append(x if left[-1] is None else _join(left[-1], x))
        for x in m[:0:-1]:
            right.append(x if right[-1] is None else _join(x, right[-1]))
        return left, right[::-1]

    flat = lambda xs: [None if x is None else x.ravel().tolist() for x in xs]

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        m = [np.array(x).reshape(3, 3) for x in table.column("m").to_pylist()]
        left, right = around(m)
        total = m[0] if len(m) == 1 else _join(left[-1], m[-1])
        lists = pa.list_(pa.float64())
        return pa.table(
            {"conv": table.column("conv"), "part": table.column("part"), "run": table.column("run")}
            | {"l": pa.array(flat(left), lists), "r": pa.array(flat(right), lists)}
            | {"total": pa.array(flat([total if k == 0 else None for k in range(len(m))]), lists)}
        )

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        left, right = around([np.array(x).reshape(3, 3) for x in table.column("total").to_pylist()])
        lists = pa.list_(pa.float64())
        return pa.table({"conv": table.column("conv"), "part": table.column("part"), "pl": pa.array(flat(left), lists), "pr": pa.array(flat(right), lists)})

    several = runs.filter("runs_in_all > 1").select("conv", "part", "run", "n", "before", "offset", "observed")
    made = several.mapInArrow(matrices, "conv string, part int, run int, m array<double>")
    inner = store(
        made.groupBy("conv", "part").applyInArrow(within, "conv string, part int, run int, l array<double>, r array<double>, total array<double>"), "runs-in-parts"
    )
    totals = inner.filter(F.col("total").isNotNull()).select("conv", "part", "total")
    outer = totals.groupBy("conv").applyInArrow(across, "conv string, part int, pl array<double>, pr array<double>")
    return inner.join(outer, ["conv", "part"]).select("conv", "part", "run", "l", "r", "pl", "pr")


def _product(*flat: list | None) -> np.ndarray | None:
    total = None
    for x in flat:
        if x is not None:
            m = np.array(x).reshape(len(ROLES), len(ROLES))
            total = m if total is None else _join(total, m)
    return total


def rendered(role: str, text: str) -> str:
    """The canonical form of a segment."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def formatted(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, segment, held_out, role, rendered): every segment with its recovered role, as canonical text."""
    conv_type, turn_type = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    made = store(parsed(turns), "chat-runs")
    # Small rows beside the runs, stored so that the join back can split a conversation that holds many runs.
    runs = made.join(store(_parts(made), "chat-parts"), ["conv", "part"])
    model = learn(runs)
    bounds = store(_bounds(runs, model), "chat-bounds")
    schema = f"conv string, turn {turn_type}, segment int, role string, rendered string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            turn_kind = batch.column("turns").type.value_type
            for r in batch.to_pylist():
                emit = model.emit(_observed(r["observed"], r["n"], r["before"] + r["offset"]))
                left, right = _product(r["pl"], r["l"]), _product(r["r"], r["pr"])
                entry = model.start if left is None else (left[0][:, None] + model.move).max(0)
                roles = decode(model, emit, entry, np.zeros(len(ROLES)) if right is None else right.max(1))
                for turn, place, role, text in zip(r["turns"], r["places"], roles, r["texts"]):
                    out.append((r["conv"], turn, place, ROLES[role], rendered(ROLES[role], text)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), turn_kind, pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names)

    known = runs.join(bounds, ["conv", "part", "run"], "left").select("conv", "n", "before", "offset", "turns", "places", "observed", "texts", "l", "r", "pl", "pr")
    conv_id = F.when(F.col("conv") != "null", F.expr("substring(conv, 2)")).cast(conv_type)
    return known.mapInArrow(run, schema).select(
        conv_id.alias("conv_id"), "turn", "segment", is_held_out().alias("held_out"), "role", "rendered"
    )
