"""Licence notices, exact and slightly edited, in whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of


@dataclass(frozen=True)
class Notice:
    """A short notice: its label, its words, how many edits of a byte it may carry, and whether it is a base phrase."""

    label: str
    phrase: str
    errors: int
    base: bool = False


NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 2, True),
    Notice("gpl", "general public license", 3, True),
    Notice("cc", "licensed under cc by", 2),
    Notice("cc", "creative commons attribution", 3),
    Notice("mpl", "mozilla public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("apache", "unless required by applicable law or agreed to in writing", 5),
    Notice("gpl", "under the terms of the gnu general public", 4),
    Notice("reserved", "all rights reserved", 2),
)

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def _pieces(phrase: bytes, errors: int) -> list[tuple[int, bytes]]:
    """The phrase in errors + 1 pieces with their places: after that many edits one of them is still intact."""
    cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds a set of notices in texts."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        import regex

        self.notices = []
        for n in notices:
            phrase = n.phrase.encode()
            edge = rb"[0-9a-z\x80-\xff]"
            fuzzy = regex.compile(rb"(?b)(?<!%b)(?:%b){e<=%d}(?!%b)" % (edge, regex.escape(phrase, literal_spaces=True), n.errors, edge))
            self.notices.append((n, phrase, _pieces(phrase, n.errors), fuzzy))

    def spans(self, text: bytes) -> tuple[int, list[tuple[Notice, int, int, int]]]:
        """Number of words, and the matches as (notice, first word, words, edits) in the order of notices and places.

        Words are joined by one space. Every place of every piece proposes where its notice would start; the bounded
        match then decides within that place's window, the fewest edits winning. A match without edits is thus found
        at each of its places, also where others overlap it.
        """
        words = WORDS(text.lower())
        line = b" ".join(words)
        found = []
        for notice, phrase, pieces, fuzzy in self.notices:
            starts = set()
            for at, piece in pieces:
                i = line.find(piece)
                while i >= 0:
                    starts.add(i - at)
                    i = line.find(piece, i + 1)
            hits: dict[tuple[int, int], int] = {}
            for s in sorted(starts):
                # one byte of room before: a match may not begin with an insertion at the very start of the search
                m = fuzzy.search(line, max(0, s - notice.errors - 1), min(len(line), s + len(phrase) + notice.errors + 1))
                if m:
                    hits[m.span()] = min(sum(m.fuzzy_counts), hits.get(m.span(), len(phrase)))
            first = at = 0  # the words before ``at``, counted on from match to match
            for (a, b), e in self._apart(hits, len(line)):
                first, at = first + line.count(b" ", at, a), a
                found.append((notice, first, line.count(b" ", a, b) + 1, e))
        return len(words), found

    @staticmethod
    def _apart(hits: dict[tuple[int, int], int], size: int) -> list[tuple[tuple[int, int], int]]:
        """All exact matches, and of edited ones those that overlap no better match; places taken are marked."""
        kept: list[tuple[tuple[int, int], int]] = []
        taken = bytearray(size)
        for (a, b), e in sorted(hits.items(), key=lambda x: (x[1], x[0])):
            if e == 0 or taken.find(1, a, b) < 0:
                kept.append(((a, b), e))
                taken[a:b] = b"\1" * (b - a)
        return sorted(kept)


MATCHES = "array<struct<label: string, base: boolean, first_word: int, words: int, errors: int, share: double>>"


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, matches (label, base, first_word, words, errors, share).

    A-Z is lower-cased and words are runs of digits, letters and anything outside ASCII. ``share`` is the part of the
    notice's bytes left unedited. A null or empty text has no words and no matches; repeated rows are scanned each; an
    empty table gives no rows; other columns of ``docs`` play no part. Texts are scanned whole, however long; of edited
    matches of one notice that overlap, the one with fewest edits counts, of equals the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int32()), ("words", pa.int32()), ("errors", pa.int32()), ("share", pa.float64())]))
        for b in batches:
            n_words, matches = [], []
            for t in b.column(1).to_pylist():
                n, found = scanner.spans(t)
                n_words.append(n)
                matches.append([{"label": x.label, "base": x.base, "first_word": w, "words": k, "errors": e, "share": 1 - e / len(x.phrase)} for x, w, k, e in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, matches {MATCHES}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices of every document; the base columns count exact base phrases only, ``labels`` all matches."""
    found = license_scan(documents(spark, sf_dir))
    exact = F.filter("matches", lambda m: m["base"] & (m["errors"] == 0))
    starts = F.transform(exact, lambda m: m["first_word"].cast("long"))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
        F.transform("matches", lambda m: F.struct(m["label"].alias("label"), m["first_word"].alias("first_word"), m["words"].alias("words"), m["errors"].alias("errors"))).alias("spans"),
    )


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
