"""License scans: fuzzy search for short notices.

A notice of n letters may be hit with k errors. Split into k + 1 pieces, at least
one piece must stand in the text unchanged (the pigeonhole principle). All pieces
of all notices are found in one pass by an Aho-Corasick automaton. Each find tells
where the notice would stand, give or take k letters. A bit-parallel pass over that
window tells whether the notice can be there with so few errors; in those that are
left, from left to right, the regex library matches the whole notice with at most k
errors and gives the span and the number of edits.

Texts are searched in a plain form: A-Z lower-cased, words joined by one blank.
Documents are independent of each other: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, table

#: Fixed phrases: where their words stand one after another, the label holds.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed notices, found with errors too.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Bytes to the plain form: letters, digits and everything beyond ASCII stay, the rest parts words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int
    places: dict[str, int]  # of each letter, a bit for each place it has in the notice
    pattern: regex.Pattern


@dataclass(frozen=True)
class Searcher:
    notices: tuple[Notice, ...]
    seeds: ahocorasick.Automaton
    longest: int


@lru_cache(maxsize=4)
def searcher(notices: tuple[tuple[str, str], ...], error_rate: float) -> Searcher:
    seeds, made, pieces = ahocorasick.Automaton(), [], {}
    for n, (text, label) in enumerate(notices):
        k = max(1, int(len(text) * error_rate))
        places = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in set(text)}
        made.append(Notice(text, label, k, places, regex.compile(rf"(?e)(?:\b{regex.escape(text, special_only=True)}\b){{e<={k}}}")))
        cuts = [round(len(text) * i / (k + 1)) for i in range(k + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(text[a:b], []).append((n, a))
    for piece, where in pieces.items():
        seeds.add_word(piece, (len(piece), tuple(where)))
    seeds.make_automaton()
    return Searcher(tuple(made), seeds, max(map(len, pieces), default=0))


def plain(text: str) -> str:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(PLAIN).split()).decode("utf-8", "replace")


def may_stand(window: str, notice: Notice) -> bool:
    """Whether some stretch of the window is at most the notice's errors away from it (columns of the edit table as bits)."""
    size, k = len(notice.text), notice.errors
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, edits = full, 0, size
    for c in window:
        same = notice.places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(diagonal | up) & full, diagonal & up
        edits += 1 if more & top else -1 if less & top else 0
        if edits <= k:
            return True
        more = more << 1 & full
        up, down = (less << 1 | ~(diagonal | more)) & full, diagonal & more
    return False


def fuzzy_spans(text: str, find: Searcher) -> list[tuple[str, int, int, int, float]]:
    """(label, first letter, letter after the last, edits, similarity) of each notice in a plain text.

    Finds of one notice do not overlap; the window that begins first comes first.
    """
    starts: dict[int, set[int]] = {}
    for end, (size, where) in find.seeds.iter(text):
        for n, at in where:
            starts.setdefault(n, set()).add(end - size + 1 - at)
    found = []
    for n, places in starts.items():
        notice, free = find.notices[n], 0
        size, k = len(notice.text), notice.errors
        for start in sorted(places):
            # a notice with an unspoilt piece here begins at most k letters off
            first, stop = max(0, start - k, free), min(len(text), start + size + k)
            if start + k < free or not may_stand(text[first:stop], notice):
                continue
            m = notice.pattern.search(text, first, stop)
            # at a window's end a word may go on
            if m and (m.end() < stop or stop == len(text) or text[stop] == " "):
                edits = sum(m.fuzzy_counts)
                found.append((notice.label, m.start(), m.end(), edits, 1 - edits / size))
                free = m.end()
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def spans_by_word(text: str, find: Searcher) -> list[dict]:
    """The notices of a plain text with the numbers of their first and last words; the text is counted through once."""
    rows, word, counted = [], 0, 0
    for label, a, b, edits, similarity in fuzzy_spans(text, find):
        word, counted = word + text.count(" ", counted, a), a
        last = word + text.count(" ", a, max(a, b - 1))
        rows.append({"label": label, "first_word": word, "last_word": last, "matched": text[a:b], "edits": edits, "similarity": similarity})
    return rows


def phrase_starts(text: str, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(word number, label) of each place of a phrase in a plain text."""
    found, padded = [], f" {text} "
    for phrase, label in phrases.items():
        at, word, counted = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word, counted = word + padded.count(" ", counted, at), at
            found.append((word, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(found)


SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("matched", T.StringType()), T.StructField("edits", T.IntegerType()), T.StructField("similarity", T.DoubleType())])
FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("exact", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("spans", T.ArrayType(SPAN))])


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, error_rate: float = 0.08,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find license phrases and notices in each row's whole text.

    Returns doc_id, n_words, exact (word number and label of each phrase), spans
    (label, first and last word, matched text, edits, similarity of each notice found
    with at most error_rate edits a letter, one at least). Words are runs of digits, letters and
    everything beyond ASCII. Null and empty texts have no words and no finds. Null and
    repeated ids are carried along. Very long texts are scanned whole, one at a time, in
    windows of a notice's length. Other columns are ignored. An empty table gives an
    empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = searcher(notices, error_rate)
        exact_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64())]))
        for batch in batches:
            counts, exact, spans = [], [], []
            for value in batch.column("text"):
                text = plain(value.as_py())
                counts.append(text.count(" ") + 1 if text else 0)
                exact.append([{"word": w, "label": x} for w, x in phrase_starts(text, phrases)])
                spans.append(spans_by_word(text, find))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(exact, exact_type), pa.array(spans, span_type)], names=FOUND.names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, FOUND)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("exact.label"))
    every = F.array_sort(F.array_distinct(F.concat("exact.label", "spans.label")))
    best = F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.word").alias("first_word"), F.array_max("exact.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), best.alias("score"))
