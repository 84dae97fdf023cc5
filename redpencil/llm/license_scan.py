"""License scan: exact phrases, and short notices with a bounded number of edits.

The words of a text, joined by single spaces, are searched for notices. A notice that may have k edits is split
into k + 1 pieces, of which at least one must occur unchanged; all pieces of all notices are looked up in one
pass by a keyword automaton. Around each piece found, the ``regex`` library's bounded-error matching decides
whether the notice is there, with how many edits, and over which words.

Documents are scanned where they are read, without a shuffle.

Defined results: a null or blank text has no words, no places and score 0. Rows that repeat are reported each.
Overlapping finds of one notice count once, as the best of them. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.storage import text_key
from redpencil.llm.words import pieces, plain_words, texts

# The base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public notices, as words, with the labels they stand for.
NOTICES = {
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version": "mpl",
    "licensed under a creative commons attribution": "cc-by",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "free and unencumbered software released into the public domain": "unlicense",
    "this program is distributed in the hope that it will be useful": "gpl",
    "eclipse public license": "epl",
}
# One edit for so many characters of a notice, so that pieces are about as long.
CHARS_PER_EDIT = 10


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str], chars_per_edit: int):
        self.base = [(f" {phrase} ", label) for phrase, label in base.items()]
        self.notices = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate(notices.items()):
            edits = max(1, len(notice) // chars_per_edit - 1)
            cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
            for start, stop in zip(cuts, cuts[1:]):
                owners.setdefault(notice[start:stop], []).append((number, start))
            pattern = regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")
            self.notices.append((notice, label, edits, pattern))
        self.seeds = ahocorasick.Automaton()
        for seed, places in owners.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def exact(self, joined: str) -> list[tuple[str, int]]:
        """(label, word number) of every place of a base phrase in " word word … "."""
        found = []
        for needle, label in self.base:
            at = joined.find(needle)
            while at >= 0:
                found.append((label, joined.count(" ", 0, at)))
                at = joined.find(needle, at + 1)
        return found

    def fuzzy(self, joined: str) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, last word, edits, allowed edits) of the notices found."""
        windows: dict[int, list[int]] = {}
        for end, (length, places) in self.seeds.iter(joined):
            for number, offset in places:
                windows.setdefault(number, []).append(end + 1 - length - offset)
        found, spaces = [], None
        for number, starts in windows.items():
            notice, label, edits, pattern = self.notices[number]
            done = -1
            for start in sorted(set(starts)):
                if start + edits < done:
                    continue
                match = pattern.search(joined, max(0, start - edits), start + len(notice) + edits)
                if match is None:
                    continue
                done = match.end()
                spaces = spaces or [k for k, c in enumerate(joined) if c == " "]
                first = max(0, bisect_right(spaces, match.start() + (joined[match.start()] == " ")) - 1)
                last = max(first, bisect_right(spaces, match.end() - 1 - (joined[match.end() - 1] == " ")) - 1)
                found.append((label, first, last, sum(match.fuzzy_counts), edits))
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))


@cache
def _scanner(base: tuple, notices: tuple, chars_per_edit: int) -> Scanner:
    return Scanner(dict(base), dict(notices), chars_per_edit)


def scan(docs: DataFrame, base=BASE, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Rows (doc_id, text_key, n_words, places, notices).

    ``places`` are the (label, word) of base phrases, ``notices`` the (label, first_word, last_word, edits, allowed) of
    the notices found.
    """
    key = (tuple(base.items()), tuple(notices.items()), chars_per_edit)
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
    notice = T.StructType([T.StructField("label", T.StringType())] + [T.StructField(c, T.LongType()) for c in ("first_word", "last_word", "edits", "allowed")])
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("n_words", T.LongType())]
        + [T.StructField("places", T.ArrayType(place)), T.StructField("notices", T.ArrayType(notice))]
    )
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    notice_type = pa.list_(pa.struct([("label", pa.string())] + [(c, pa.int64()) for c in ("first_word", "last_word", "edits", "allowed")]))

    def run(batches):
        scanner = _scanner(*key)
        for whole in batches:
            for batch in pieces(whole):
                n_words, places, found = [], [], []
                for text in texts(batch):
                    words = plain_words(text)
                    joined = f" {b' '.join(words).decode()} "
                    n_words.append(len(words))
                    places.append([{"label": a, "word": b} for a, b in scanner.exact(joined)])
                    found.append([dict(zip(("label", "first_word", "last_word", "edits", "allowed"), f)) for f in scanner.fuzzy(joined)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(n_words, pa.int64())]
                    + [pa.array(places, place_type), pa.array(found, notice_type)],
                    schema.names,
                )

    return docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    The score is 1 with a base phrase, else that of the best notice: 1 without edits, falling to 1/2 at the bound.
    """
    closeness = F.transform("notices", lambda n: 1.0 - 0.5 * n["edits"] / n["allowed"])
    best = F.coalesce(F.array_max(closeness), F.lit(0.0))
    base = F.array_sort(F.array_distinct(F.col("places")["label"]))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places")["label"], F.col("notices")["label"])))
    n_base = F.size("places").cast("bigint")
    return scan(docs).select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.col("places")["word"]).alias("first_word"),
        F.array_max(F.col("places")["word"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
    )
