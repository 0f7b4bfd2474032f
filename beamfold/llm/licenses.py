"""License scans: exact phrases, and short notices with a bounded number of edits.

Texts are brought to lower-case words with one space between them, whole blocks of texts at a time. A notice of k allowed
edits is cut into k + 1 pieces; a place within k edits holds at least one piece unchanged (pigeonhole), so one search for all
the pieces gives every candidate place. The regex library's bounded-error matching then judges a stretch around each
candidate by itself, as long as the notice and its edits allow, and gives the best match and its edits. The words that tell a
notice apart must stand in it as whole words, and unchanged if they are short, where an edit gives another licence's ("mit", "mpl"),
else with at most one edit. Of matches of a notice
that overlap the one with the fewest edits counts, then the first; what a stretch has left beside it is judged again.

Edits are counted on the UTF-8 bytes of the normal form; spans are byte ranges of the text as given. A span's score is the
share of the notice that is unchanged, an exact phrase scores 1, a document the best of its spans, 0 without any.

Defined cases: a null or empty text has no words, empty labels and score 0; equal rows each get a row; a match never
crosses documents; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from beamfold.llm import words as W
from beamfold.llm.catalog import query, table

# Phrases and labels that count at every place.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Short notices in their normal form, the label each one stands for, and the words of it that tell it apart.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", "hereby granted"),
    ("released under the mit license", "mit", "mit"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("licensed under the gnu general public license", "gpl", "general"),
    ("gnu lesser general public license", "lgpl", "lesser"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "source and binary"),
    ("mozilla public license version 2 0", "mpl", "mozilla"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "by nc"),
    ("creative commons attribution", "cc", "commons"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", "use copy modify"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered"),
)
#: Words of so many bytes that tell a notice apart may have one of its edits.
LONG_WORDS = 6
#: One edit for so many bytes of a notice, so that no piece is shorter than about this less one.
BYTES_PER_EDIT = 14

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, " \
         "spans array<struct<label:string,start:long,end:long,edits:long>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of nearly equal length, with their places in the notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@cache
def _plan() -> tuple[list[tuple], ahocorasick.Automaton]:
    """Notices with label, edits and pattern; an automaton of all pieces with (notice, place of the piece's end)."""
    plan, where = [], {}
    for i, (text, label, own) in enumerate(NOTICES):
        notice = text.encode()
        k = len(notice) // BYTES_PER_EDIT
        fuzzy = lambda part: b"(?:" + regex.escape(part) + b"){e<=%d}" % k if part else b""  # noqa: E731, B023
        before, behind = notice.split(own.encode())
        apart = b"(?:" + regex.escape(own.encode()) + (b"){e<=1}" if len(own) >= LONG_WORDS else b")")
        plan.append((notice, label, k, regex.compile(b"(?b)" + fuzzy(before) + rb"(?<![^ \n])" + apart + rb"(?![^ \n])" + fuzzy(behind))))
        for offset, piece in pieces(notice, k):
            where.setdefault(piece.decode("latin-1"), []).append((i, offset + len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, places in where.items():
        automaton.add_word(piece, places)
    automaton.make_automaton()
    return plan, automaton


def normal(block: W.Block) -> tuple[bytes, np.ndarray]:
    """Lower-case words with one space between them and a line end after each text, and the byte of the block behind each byte."""
    inside = W.ALNUM[block.data]
    out = np.where(inside, W._LOWER[block.data], 0x20).astype(np.uint8)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.flatnonzero(keep)
    ends = block.offsets[1:]
    where = np.searchsorted(at, ends)
    return np.insert(out[at], where, 0x0A).tobytes(), np.insert(at, where, ends)


def _apart(form: bytes, stretches: set[tuple[int, int]], notice: bytes, k: int, pattern: regex.Pattern) -> Iterator[tuple[int, int, int]]:
    """Start, end and edits of the matches in the stretches, fewest edits first, none over another."""
    found: list[tuple[int, int, int, int, int]] = []

    def judge(a: int, b: int) -> None:
        if b - a < len(notice) - k:
            return
        at = form.find(notice, a, b)
        if at >= 0 and pattern.match(form, at, at + len(notice)):
            heapq.heappush(found, (0, at, at + len(notice), a, b))
        elif (m := pattern.search(form, a, b)) and sum(m.fuzzy_counts) <= k:
            heapq.heappush(found, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

    for a, b in stretches:
        judge(a, b)
    taken: list[tuple[int, int]] = []
    while found:
        edits, start, end, a, b = heapq.heappop(found)
        i = bisect.bisect_left(taken, (start, end))
        if not (i and taken[i - 1][1] > start or i < len(taken) and taken[i][0] < end):
            taken.insert(i, (start, end))
            yield start, end, edits
            # A stretch can have room for another match beside this one; places before and behind it are judged again.
        for x, y in taken[max(bisect.bisect_left(taken, (a, a)) - 1, 0):]:
            if x >= b:
                break
            judge(a, min(x, b))
            a = max(a, y)
        judge(a, b)


def notices(form: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Label, start, end, edits and length of notice for every notice in a normal form."""
    plan, automaton = _plan()
    places: dict[int, set[tuple[int, int]]] = {}
    for last, hits in automaton.iter(form.decode("latin-1")):
        for i, offset in hits:
            notice, _, k, _ = plan[i]
            at = last + 1 - offset
            # A stretch may go over the end of a text: a match stays in the text of its piece.
            a, b = max(at - k, 0), min(at + len(notice) + k, len(form))
            before, behind = form.rfind(b"\n", a, last + 1), form.find(b"\n", last + 1, b)
            places.setdefault(i, set()).add((max(a, before + 1), behind if behind >= 0 else b))
    for i, stretches in places.items():
        notice, label, k, pattern = plan[i]
        for start, end, edits in _apart(form, stretches, notice, k, pattern):
            yield label, start, end, edits, len(notice)


def _phrase_places(w: W.Words) -> list[tuple[str, np.ndarray]]:
    found = []
    for phrase, label in PHRASES:
        key = W.words(next(W.blocks(pa.array([phrase]))), W.ALNUM).hash
        n = len(w.hash) - len(key) + 1
        if n <= 0:
            continue
        at = np.flatnonzero(w.hash[len(key) - 1:] == key[-1])
        for i, h in enumerate(key[:-1]):
            at = at[w.hash[at + i] == h]
        found.append((label, at[w.text[at] == w.text[at + len(key) - 1]]))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, base, spans = [], {}, {}
        for block in W.blocks(batch.column("text")):
            w = W.words(block, W.ALNUM)
            n_words.append(w.counts)
            for label, at in _phrase_places(w):
                for i in at.tolist():
                    row = int(w.text[i])
                    base.setdefault(block.first + row, []).append((i - int(w.firsts[row]), label))
            form, back = normal(block)
            for label, a, b, edits, length in notices(form):
                row = int(np.searchsorted(block.offsets, back[a], "right")) - 1
                began = int(block.offsets[row])
                spans.setdefault(block.first + row, {})[(int(back[a]) - began, int(back[b - 1]) + 1 - began, label, edits)] = 1 - edits / length
        n = batch.num_rows
        places = [base.get(i, ()) for i in range(n)]
        found = [spans.get(i, {}) for i in range(n)]
        join = lambda labels: ",".join(sorted(set(labels)))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(n_words).astype(np.int64) if n_words else [], pa.int64()),
            pa.array([len(p) for p in places], pa.int64()), pa.array([min(p)[0] if p else None for p in places], pa.int64()),
            pa.array([max(p)[0] if p else None for p in places], pa.int64()), pa.array([join(x[1] for x in p) for p in places]),
            pa.array([join([x[1] for x in p] + [s[2] for s in f]) for p, f in zip(places, found)]),
            pa.array([float(max([*f.values(), *([1.0] if p else [0.0])])) for p, f in zip(places, found)]),
            pa.array([[dict(zip(("start", "end", "label", "edits"), s)) for s in sorted(f)] for f in found], _SPANS),
        ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: exact phrases, labels, score and the spans of notices."""
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA)


@query("op10_license_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
