"""Quality rules: thresholds from mergeable quantile sketches per language and source.

Every document gets integer rates. A sketch is a table of counts per (language, source, rate, bucket); buckets keep the
six leading bits of a value, so a quantile is exact up to 1/32 of its value, sketches merge by adding counts, and the
result does not depend on how the rows were dealt out. A rate's fence is the upper quartile plus three times the spread
of the quartiles (for the mean word length also the lower side); a group of fewer than ``min_documents`` takes the merged
sketch of its language, a small language that of all documents. Documents join the fences of their group.

Defined cases: a null text has no words and fails the base rule; a null language or source is a group of its own; equal
rows are judged alike, one result row each; an empty table gives no rows; other columns are kept by ``accepted`` and
ignored by ``judge``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beamfold.llm import words as W
from beamfold.llm.catalog import column, query, table
from beamfold.session import stage

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Rate, smallest spread of its quartiles that a fence assumes, whether it also has a lower fence.
RATES = (("symbol_rate", 30, False), ("dup_line_rate", 50, False), ("repeat_rate", 50, False), ("word_length", 60, True))
MIN_DOCUMENTS = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _counts(block: W.Block) -> list[np.ndarray]:
    w = W.words(block, W.NOT_SPACE, lower=False)
    ends = block.offsets
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    inside = total(W.NOT_SPACE[block.data])
    chars = total(W.NOT_SPACE[block.data] & ((block.data & 0xC0) != 0x80))
    symbols = total(_SYMBOL[block.data])

    newline = np.flatnonzero(block.data == 0x0A)
    start = np.sort(np.concatenate([ends[:-1], newline + 1]))
    # A newline at the end of a text begins an empty line of the next text's start; empty lines hold no word.
    stop = np.append(start[1:], len(block.data))
    stop = np.where((stop > start) & (stop > 0) & np.isin(stop - 1, newline), stop - 1, stop)
    worded = inside[stop] > inside[start]
    start, stop = start[worded], stop[worded]
    line_text = np.searchsorted(ends, start, "right") - 1
    line = W.ranges_hash(block, start, stop) ^ W.mix(line_text.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(line, return_index=True)
    n_lines = np.bincount(line_text, minlength=block.rows)
    dup = n_lines - np.bincount(line_text[first], minlength=block.rows)

    gram, at = W.grams(w, WINDOW)
    gram ^= W.mix(w.text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(gram)
    same = gram[order][1:] == gram[order][:-1]
    again = np.zeros(len(gram), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + WINDOW, -1)
    repeat = W.per_text(w.counts, np.cumsum(cover)[:-1] > 0)
    return [w.counts, chars[ends[1:]] - chars[ends[:-1]], symbols[ends[1:]] - symbols[ends[:-1]], dup, repeat, n_lines]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = "_text" not in batch.schema.names
        parts = [_counts(b) for b in W.blocks(batch.column("_row").field("text") if whole else batch.column("_text"))]
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)] or [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", *COUNTS])


def measure(documents: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as struct ``_row``, next to the counts of the whole text."""
    text = [] if "text" in columns else [F.col("text").alias("_text")]
    rows = documents.select(F.struct(*map(column, columns)).alias("_row"), *text)
    return rows.mapInArrow(_measure, rows.select("_row", *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema)


def _rates() -> dict[str, Column]:
    """Whole rates per thousand (hundredths for the word length); a few words more below the line keep short texts from extremes."""
    per = lambda n, d, more: F.floor(F.col(n) * 1000 / (F.col(d) + more)).cast("long")
    return {
        "symbol_rate": per("n_symbols", "n_words", 50), "dup_line_rate": per("n_dup_lines", "n_lines", 10),
        "repeat_rate": per("n_repeat_words", "n_words", 50),
        "word_length": F.when(F.col("n_words") >= 50, F.floor(F.col("word_chars") * 100 / F.col("n_words")).cast("long")),
    }


def _bucket(value: Column) -> Column:
    bits = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    low = F.lit(1).cast("long") * F.pow(F.lit(2.0), bits).cast("long")
    return value - value % low


def _group(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"_row.{name}").cast("string")), F.lit(""))


def _quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Quartiles and size of the merged sketches per key and rate."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "rate")
    below = merged.withColumns({"total": F.sum("n").over(over), "reached": F.sum("n").over(over.orderBy("bucket"))})
    at = lambda q: F.min(F.when(F.col("reached") * 4 >= F.col("total") * q, F.col("bucket")))
    return below.groupBy(*keys, "rate").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("size"))


def fences(measured: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per (language, source): columns ``<rate>_high`` and, for two-sided rates, ``<rate>_low``."""
    long = measured.select(
        _group("lang").alias("g_lang"), _group("source").alias("g_source"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), v.alias("value")) for k, v in _rates().items()))).alias("r"))
    sketch = stage(
        long.where("r.value is not null").groupBy("g_lang", "g_source", F.col("r.rate").alias("rate"), _bucket(F.col("r.value")).alias("bucket"))
        .agg(F.count("*").alias("n")), "sketch")
    own, by_lang, by_all = _quartiles(sketch, "g_lang", "g_source"), _quartiles(sketch, "g_lang"), _quartiles(sketch)
    both = own.alias("o").join(by_lang.alias("l"), ["g_lang", "rate"], "left").join(by_all.alias("a"), "rate", "left")
    pick = lambda c: F.when(F.col("o.size") >= min_documents, F.col(f"o.{c}")).when(F.col("l.size") >= min_documents, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    chosen = both.select("g_lang", "g_source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"))
    wide = []
    for rate, least, two_sided in RATES:
        reach = 3 * F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        wide.append(F.max(F.when(F.col("rate") == rate, F.col("q3") + reach)).alias(f"{rate}_high"))
        if two_sided:
            wide.append(F.max(F.when(F.col("rate") == rate, F.col("q1") - reach)).alias(f"{rate}_low"))
    return chosen.groupBy("g_lang", "g_source").agg(*wide)


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for (rate, _, two_sided), value in zip(RATES, _rates().values()):
        inside &= F.coalesce(value <= F.col(f"{rate}_high"), F.lit(True))
        if two_sided:
            inside &= F.coalesce(value >= F.col(f"{rate}_low"), F.lit(True))
    keyed = measured.withColumns({"g_lang": _group("lang"), "g_source": _group("source"), "base_failed": failed})
    return keyed.join(limits, ["g_lang", "g_source"], "left").withColumn("kept", ~F.col("base_failed") & inside)


def judge(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row per document: counts, base verdict and verdict. The narrow counts are written once and read twice."""
    measured = stage(measure(documents, ["doc_id", "lang", "source"]), "quality")
    return _judged(measured, fences(measured, min_documents)).select(
        F.col("_row.doc_id").alias("doc_id"), *COUNTS[:5], "base_failed", "kept")


def accepted(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with a good verdict, all their columns; texts are read twice instead of being shuffled."""
    limits = stage(fences(measure(documents, ["lang", "source"]), min_documents), "fences")
    return _judged(measure(documents, documents.columns), limits).where("kept").select("_row.*")


SQL_JUDGE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
ws AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
w AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM ws),
five AS (SELECT k, i, CASE WHEN lead(i, 4) OVER o = i + 4 THEN
    x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o END AS g
  FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM five WHERE g IS NOT NULL) WHERE c >= 2),
rep AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS j) GROUP BY k),
li AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM li
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT d.k, doc_id, coalesce('=' || lang, '') AS gl, coalesce('=' || source, '') AS gs, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x)))::BIGINT, 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN ws USING (k) LEFT JOIN rep USING (k) LEFT JOIN ln USING (k)),
r AS (SELECT k, gl, gs, n_symbols * 1000 // (n_words + 50) AS symbol_rate, n_dup_lines * 1000 // (n_lines + 10) AS dup_line_rate,
    n_repeat_words * 1000 // (n_words + 50) AS repeat_rate,
    CASE WHEN n_words >= 50 THEN word_chars * 100 // n_words END AS word_length FROM m),
lg AS (UNPIVOT r ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE v),
b AS (SELECT gl, gs, rate, v - v % (1 << greatest(length(ltrim(v::BIGINT::BIT::VARCHAR, '0')) - 6, 0)) AS bucket FROM lg),
own AS (SELECT gl, gs, rate, count(*) AS size, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
bl AS (SELECT gl, rate, count(*) AS size, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
ba AS (SELECT rate, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY ALL),
c AS (SELECT own.gl, own.gs, own.rate,
    CASE WHEN own.size >= 100 THEN own.q1 WHEN bl.size >= 100 THEN bl.q1 ELSE ba.q1 END AS q1,
    CASE WHEN own.size >= 100 THEN own.q3 WHEN bl.size >= 100 THEN bl.q3 ELSE ba.q3 END AS q3,
    CASE own.rate WHEN 'symbol_rate' THEN 30 WHEN 'word_length' THEN 60 ELSE 50 END AS least
  FROM own JOIN bl ON own.gl = bl.gl AND own.rate = bl.rate JOIN ba ON own.rate = ba.rate),
bad AS (SELECT DISTINCT k FROM (UNPIVOT r ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE v) u
  JOIN c USING (gl, gs, rate)
  WHERE v > q3 + 3 * greatest(q3 - q1, least) OR rate = 'word_length' AND v < q1 - 3 * greatest(q3 - q1, least)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND k NOT IN (SELECT k FROM bad) AS kept FROM f
"""


@query("op9_quality_rules", SQL_JUDGE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
