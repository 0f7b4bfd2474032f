"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a block of whole texts. Its words become symbols: the benchmark's vocabulary is numbered, every other word is
one separator, and a run of numbered words shorter than the shortest test phrase is a separator too, as no phrase fits
into it. Over that sequence the shard builds its suffix order, the transform of it, a wavelet matrix for ranks and a
sample of suffix positions. All test phrases search backwards at once; found suffixes walk to the next sampled one.
Occurrences are merged into removal spans of each text.

The benchmark is the query set. It is sent to the tasks in parts of at most ``part_bytes`` of text, one pass over the
shards for each part, so that what is broadcast is bounded whatever the benchmark's size.

Defined cases: a null or empty text or item has no words; an item without words never occurs; equal items share their
occurrences and each counts by its id; a null item id counts as the empty string; equal documents each get a row; empty
tables give no rows, or rows without hits; other columns are kept by ``clean`` and ignored by ``scan``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from beamfold.llm import words as W
from beamfold.llm.catalog import column, query, table
from beamfold.session import stage

WINDOW = 10
PART_BYTES = 8 << 20
SAMPLE = 8

_SPANS = ArrayType(StructType([StructField(c, LongType()) for c in ("first", "last", "start", "end")]))
_ADDED = StructType([StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("items", ArrayType(StringType()))])
_SPANS_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))


@dataclass
class Phrases:
    """Test phrases of one part of the benchmark: symbols by phrase (padded on the left with -1), and their items."""
    vocabulary: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    item_start: np.ndarray
    item_of: np.ndarray
    items: list[str]


def phrases(rows: list[tuple], window: int = WINDOW) -> Phrases | None:
    """Distinct windows of the items' words; an item of fewer words, but not none, is one window."""
    ids = ["" if i is None else str(i) for i, _ in rows]
    found: dict[tuple, set[int]] = {}
    at = 0
    for block in W.blocks(pa.array([t for _, t in rows], pa.large_string())):
        w = W.words(block, W.ALNUM)
        for k in range(block.rows):
            h = w.hash[w.firsts[k]:w.firsts[k] + w.counts[k]].tolist()
            for i in range(max(1, len(h) - window + 1) if h else 0):
                found.setdefault(tuple(h[i:i + window]), set()).add(at + k)
        at += block.rows
    if not found:
        return None
    vocabulary = np.unique(np.array([h for p in found for h in p], np.uint64))
    symbols = np.full((len(found), window), -1, np.int64)
    for r, p in enumerate(found):
        symbols[r, window - len(p):] = np.searchsorted(vocabulary, np.array(p, np.uint64)) + 2
    sizes = [len(x) for x in found.values()]
    return Phrases(vocabulary, symbols, (symbols >= 0).sum(1), np.concatenate([[0], np.cumsum(sizes)]),
                   np.array([i for x in found.values() for i in sorted(x)]), ids)


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in order, by doubling the compared length."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = steps
        k *= 2
        if steps[-1] == n - 1 or k >= n:
            return order


class FmIndex:
    """Counts, wavelet matrix of the transform, and every ``SAMPLE``-th suffix position of a symbol sequence that ends with 0."""

    def __init__(self, s: np.ndarray):
        order = suffix_order(s)
        last = s[order - 1]
        self.n, sigma = len(s), int(s.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels = []
        row = last
        for b in range(self.bits - 1, -1, -1):
            one = (row >> b) & 1
            ones = np.concatenate([[0], np.cumsum(one)])
            self.levels.append((b, ones, self.n - int(ones[-1])))
            row = np.concatenate([row[one == 0], row[one == 1]])
        # LF keeps ties of the suffixes that follow the separators in order, as each place is a suffix of its own.
        self.last = last
        kept = order % SAMPLE == 0
        self.sampled = kept
        self.place = np.concatenate([[0], np.cumsum(kept)])
        self.sample = order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol among the first i of the transform."""
        low = np.zeros_like(i)
        for b, ones, zeros in self.levels:
            bit = (symbol >> b) & 1
            low1, i1 = ones[low], ones[i]
            low = np.where(bit, zeros + low1, low - low1)
            i = np.where(bit, zeros + i1, i - i1)
        return i - low

    def search(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows of symbols occur, and their ranges of suffixes."""
        live = np.flatnonzero((symbols < len(self.first) - 1).all(1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(symbols.shape[1] - 1, -1, -1):
            c = symbols[live, j]
            go = c >= 0
            cc = np.maximum(c, 0)
            low = np.where(go, self.first[cc] + self.rank(cc, low), low)
            high = np.where(go, self.first[cc] + self.rank(cc, high), high)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            if not len(live):
                break
        return live, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        steps, place, out = np.zeros(len(at), np.int64), at.copy(), np.full(len(at), -1, np.int64)
        todo = np.arange(len(at))
        while len(todo):
            p = place[todo]
            hit = self.sampled[p]
            out[todo[hit]] = self.sample[self.place[p[hit]]] + steps[todo[hit]]
            todo = todo[~hit]
            c = self.last[place[todo]]
            place[todo] = self.first[c] + self.rank(c, place[todo])
            steps[todo] += 1
        return out


def _occurrences(w: W.Words, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase and first word (index in the block) of every occurrence."""
    none = np.zeros(0, np.int64)
    if not len(w.hash):
        return none, none
    gate = np.zeros(1 << 16, bool)
    gate[(p.vocabulary >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(gate[(w.hash >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(p.vocabulary, w.hash[maybe]), len(p.vocabulary) - 1)
    known = p.vocabulary[at] == w.hash[maybe]
    maybe, symbol = maybe[known], at[known] + 2
    if not len(maybe):
        return none, none
    new = np.concatenate([[True], (np.diff(maybe) > 1) | (np.diff(w.text[maybe]) != 0)])
    run = np.cumsum(new) - 1
    fits = np.bincount(run)[run] >= p.length.min()
    maybe, symbol, new = maybe[fits], symbol[fits], new[fits]
    if not len(maybe):
        return none, none
    # A separator before each run; the sequence ends with 0.
    place = np.arange(len(maybe)) + np.cumsum(new)
    s = np.ones(place[-1] + 2, np.int64)
    s[place] = symbol
    s[-1] = 0
    back = np.full(len(s), -1, np.int64)
    back[place] = maybe
    index = FmIndex(s)
    live, low, high = index.search(p.symbols)
    many = high - low
    each = np.repeat(np.arange(len(live)), many)
    suffixes = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    return live[each], back[index.locate(suffixes)]


def merge(spans: list[tuple]) -> list[dict]:
    """Union of word ranges (first, last, start byte, end byte); neighbours become one."""
    out: list[list] = []
    for a in sorted(spans):
        if out and a[0] <= out[-1][1] + 1:
            if a[1] > out[-1][1]:
                out[-1][1], out[-1][3] = a[1], a[3]
        else:
            out.append(list(a))
    return [dict(zip(("first", "last", "start", "end"), x)) for x in out]


def _pass(p: Phrases | None, keep: bool, slim: bool):
    """A pass over all texts for one part of the benchmark; adds to what earlier passes found. slim: only doc_id goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found = [], {}
            for block in W.blocks(batch.column("_row").field("text")):
                w = W.words(block, W.ALNUM)
                n_words.append(w.counts)
                if p is None:
                    continue
                which, first = _occurrences(w, p)
                last = first + p.length[which] - 1
                for k, a, b in zip(which.tolist(), first.tolist(), last.tolist()):
                    row = int(w.text[a])
                    base, began = int(w.firsts[row]), int(block.offsets[row])
                    spans, items = found.setdefault(block.first + row, (set(), set()))
                    spans.add((a - base, b - base, int(w.start[a]) - began, int(w.end[b]) - began))
                    items.update(p.items[i] for i in p.item_of[p.item_start[k]:p.item_start[k + 1]].tolist())
            old_spans, old_items = (batch.column(c).to_pylist() if keep else [[]] * batch.num_rows for c in ("spans", "items"))
            spans, items = list(old_spans), list(old_items)
            for row, (s, i) in found.items():
                spans[row] = merge([tuple(x.values()) for x in old_spans[row]] + sorted(s))
                items[row] = sorted(i.union(old_items[row]))
            count = np.concatenate(n_words) if n_words else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").field("doc_id") if slim else batch.column("_row"), pa.array(count.astype(np.int64)), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))],
                ["doc_id" if slim else "_row", "n_words", "spans", "items"])

    return run


def _scanned(documents: DataFrame, benchmark: DataFrame, window: int, part_bytes: int, slim: bool) -> DataFrame:
    """All columns as struct ``_row``, or only doc_id, with n_words, merged spans (words and UTF-8 bytes) and sorted item ids."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part_bytes))
    rows = documents.select(F.struct(*map(column, ["doc_id", "text"] if slim else documents.columns)).alias("_row"))
    for k in range(parts):
        # Every part has about part_bytes; xxhash deals the items out evenly.
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        last = slim and k == parts - 1
        row = StructField("doc_id", documents.schema["doc_id"].dataType) if last else rows.schema["_row"]
        rows = rows.mapInArrow(_pass(phrases([(r[0], r[1]) for r in part], window), k > 0, last), StructType([row, *_ADDED.fields]))
        if k < parts - 1:
            # Each part is a job of its own, so that tasks hold the phrases of one part, however large the benchmark.
            rows = stage(rows, "screened")
    return rows


def scan(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, spans to remove, items found."""
    return _scanned(documents, benchmark, window, part_bytes, True)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents in which no test phrase occurs, all their columns. A contaminated document goes as a whole: what is
    left around a removed span can be the rest of the same test item."""
    return _scanned(documents, benchmark, window, part_bytes, False).where(F.size("items") == 0).select("_row.*")


SQL_SCAN = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS (SELECT k, item, g.n, i FROM g JOIN win USING (n, g)),
s AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN s USING (k) LEFT JOIN t USING (k)
"""


@query("op2_decontamination", SQL_SCAN)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
