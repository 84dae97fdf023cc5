"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns. Their values, as hashes, are counted over the whole corpus by distinct
repositories and owners: a value that several owners hold, or two owners in many repositories, is a copied example.
One that stays with its owner looks like a live credential, in however many repositories the owner has it. Base kinds
are always reported; the further kinds, whose patterns are wider, are added where the counts say live.

A source is an owner; the parts of a source in one language are its repositories. Both columns are parameters.

Defined results: a null text is empty. Positions count code points, end exclusive. Rows that repeat are
reported each and do not add to the distinct counts. A null owner or repository counts as one more owner or
repository. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redpencil.llm.storage import store, text_key

# Values held by at least so many owners are copied examples.
WIDE_OWNERS = 3
# So are values held in at least so many repositories, if not by one owner alone.
WIDE_REPOSITORIES = 6
# Matches whose positions are added up together; their sums are added up after that.
MATCHES_AT_ONCE = 256


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, the least length of that group, and a cheap test of the text."""

    name: str
    pattern: str
    group: int
    least: int
    test: str


# The base kinds, in the order in which spans of equal start are listed.
BASE = [
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)passw|secret|token|api_?key"),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
]
# Public credential formats that are added where they look live.
ADDED = [
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})", 1, 16, r"(?i)bearer\x20"),
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34, r"gh[pousr]_"),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, r"xox[abprs]-"),
    Kind("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, r"eyJ"),
    Kind("upperhex", r"[0-9A-F]{32,}", 0, 32, r"[0-9A-F]{32}"),
    Kind("login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", 1, 4, r"://[^\s/@]+@"),
]
_SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string>>"


def _spans(text: Column, kind: Kind, number: int) -> Column:
    """All matches of a kind in order. The pieces between matches, as cut by the same pattern, give the positions."""
    pattern = F.lit(kind.pattern)
    zipped = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def span(begin: Column, end: Column, value: Column) -> Column:
        names = [F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), value.alias("value")]
        return F.struct(begin.alias("start"), *names)

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.length(part["hit"])
        fits = F.length(part["value"]) >= kind.least
        one = F.when(fits, F.array(span(begin, end, F.sha2(part["value"], 256)))).otherwise(F.array()).cast(_SPANS)
        return F.struct(end.alias("at"), F.concat(state["found"], one).cast(_SPANS).alias("found"))

    def moved(part: Column, at: Column) -> Column:
        return F.transform(part["found"], lambda s: span(s["start"] + at, s["end"] + at, s["value"])).cast(_SPANS)

    matched = F.filter(zipped, lambda part: part["hit"].isNotNull())
    # Arrays grow by copies, so positions are counted in short parts from each part's own start and then moved.
    parts = _each(matched, lambda all_: F.transform(_slices(all_), lambda some: F.aggregate(some, start, step)))
    found = _each(parts, lambda all_: F.flatten(F.zip_with(all_, _starts(all_["at"]), moved)))
    return F.when(text.rlike(kind.test), found).otherwise(F.array().cast(_SPANS))


def _each(value: Column, what: Callable[[Column], Column]) -> Column:
    """``what`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), what)[0]


def _slices(values: Column) -> Column:
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / MATCHES_AT_ONCE).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * MATCHES_AT_ONCE + 1, MATCHES_AT_ONCE))


def _starts(lengths: Column) -> Column:
    """Where parts of these lengths start, one after the other."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        none,
        lambda state, n: F.struct((state["at"] + n).alias("at"), F.concat(state["starts"], F.array(state["at"])).cast("array<int>").alias("starts")),
        lambda state: state["starts"],
    )


def candidates(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """Rows (doc_id, text_key, owner, repository, base, added): spans with the hash of their value."""
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    text = F.coalesce("text", F.lit(""))
    kinds = [*BASE, *ADDED]
    columns = [_spans(text, kind, k) for k, kind in enumerate(kinds)]
    return docs.select(
        "doc_id",
        text_key().alias("text_key"),
        F.xxhash64(owner, owner.isNull()).alias("owner"),
        F.xxhash64(repository, owner.isNull()).alias("repository"),
        F.array_sort(F.concat(*columns[: len(BASE)])).alias("base"),
        F.array_sort(F.concat(*columns[len(BASE) :])).alias("added"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, n_repositories, n_owners): how widely each candidate value is held."""
    held = found.select("owner", "repository", F.explode(F.concat("base", "added")["value"]).alias("value"))
    return held.distinct().groupBy("value").agg(
        F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners")
    )


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(
    docs: DataFrame,
    wide_owners: int = WIDE_OWNERS,
    owner: Column | None = None,
    repository: Column | None = None,
    wide_repositories: int = WIDE_REPOSITORIES,
) -> DataFrame:
    """Rows (doc_id, text_key, base, spans, n_live, n_example, most_owners, most_repositories).

    ``base`` and ``spans`` are arrays of (start, kind_no, end, kind, value); n_live and n_example count the
    spans of ``spans`` by the verdict on their values, and the last two are the widest spread of any of these values.
    """
    found = store(candidates(docs, owner, repository), "secret-candidates")
    rows = found.select("doc_id", "text_key", F.explode(F.concat("base", "added")).alias("span"))
    copied = (F.col("n_owners") >= wide_owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= wide_repositories))
    judged = rows.join(store(ownership(found), "ownership"), F.col("span.value") == F.col("value")).select(
        "doc_id", "text_key", "span", "n_owners", "n_repositories", (~copied).alias("live")
    )
    per_row = judged.groupBy(F.col("doc_id").alias("j_id"), F.col("text_key").alias("j_key")).agg(
        F.collect_set(F.struct("span", "live", "n_owners", "n_repositories")).alias("judged")
    )
    base_kinds = F.lit(len(BASE))
    joined = found.join(per_row, F.col("doc_id").eqNullSafe(F.col("j_id")) & (F.col("text_key") == F.col("j_key")), "left")
    verdicts = F.filter(
        F.coalesce("judged", F.array().cast(per_row.schema["judged"].dataType)),
        lambda j: (j["span"]["kind_no"] < base_kinds) | j["live"],
    )
    live_added = F.filter(verdicts, lambda j: j["span"]["kind_no"] >= base_kinds)["span"]
    return joined.select(
        "doc_id",
        "text_key",
        "base",
        F.array_sort(F.concat("base", live_added)).alias("spans"),
        F.size(F.filter(verdicts, lambda j: j["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter(verdicts, lambda j: ~j["live"])).cast("bigint").alias("n_example"),
        F.coalesce(F.array_max(verdicts["n_owners"]), F.lit(0)).cast("bigint").alias("most_owners"),
        F.coalesce(F.array_max(verdicts["n_repositories"]), F.lit(0)).cast("bigint").alias("most_repositories"),
    )


def _count(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == number)).cast("bigint")


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repositories)."""
    counts = [_count("base", k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)]
    return scan(docs).select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
        "most_owners",
        "most_repositories",
    )
