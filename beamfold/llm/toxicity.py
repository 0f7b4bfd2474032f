"""Toxicity scores: the most suspicious of all overlapping windows of a text, by a recurrent network trained here.

The network (``gru``) is fitted on the driver on at most ``PER_LABEL`` labelled documents of each label, of at most
``TRAIN_BYTES`` bytes, those with the smallest hash of their doc_id (of rows of one doc_id, of their text), none of them held out. Every text is scored whole.

Defined cases: a null or empty text, or one without words, gets the share of toxic rows in the sample, halved; without
labels of both kinds every score is that value (0 without any); a null doc_id counts as the empty string for the fold; equal
rows each get a row; labels without a value are ignored; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.llm import words as W
from beamfold.llm.catalog import query, table
from beamfold.llm.gru import Network, inputs

PER_LABEL, TRAIN_BYTES, VOCABULARY = 1500, 16384, 20_000
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(documents: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the bounded training sample."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = documents.where(F.octet_length("text") <= TRAIN_BYTES)
    # The rows themselves are chosen, by their hashes; only chosen ones have their texts read.
    rows = short.select("doc_id", F.xxhash64("text").alias("tie")).distinct().join(known, "doc_id")
    chosen = {}
    for label in (0, 1):
        found = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(PER_LABEL).collect()
        chosen |= {(r.doc_id, r.tie): label for r in found}
    if not chosen:
        return [], np.zeros(0, np.int64)
    tie = F.xxhash64("text")
    texts = short.where(F.col("doc_id").isin(sorted({i for i, _ in chosen})) & tie.isin(sorted({t for _, t in chosen}))).select(
        "doc_id", tie.alias("tie"), "text").dropDuplicates(["doc_id", "tie"]).collect()
    texts = sorted((r.doc_id, r.text, chosen[r.doc_id, r.tie]) for r in texts if (r.doc_id, r.tie) in chosen)
    return [t for _, t, _ in texts], np.array([label for *_, label in texts], np.int64)


def train(texts: list[str], labels: np.ndarray) -> Network | None:
    """A network, unless the sample lacks a label or has no words."""
    if len(set(labels.tolist())) < 2:
        return None
    block = W.Block(0, *_joined(texts))
    w = W.words(block, W.ALNUM)
    if not len(w.hash):
        return None
    pair = np.unique(np.stack([w.hash, w.text.astype(np.uint64)]), axis=1)
    word, count = np.unique(pair[0], return_counts=True)
    often = np.lexsort((word, -count))[:VOCABULARY]
    network = Network(np.sort(word[often[count[often] >= 2]]))
    network.fit(inputs(block, network.vocabulary), labels)
    return network


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def scores(documents: DataFrame, network: Network | None, empty: float) -> DataFrame:
    """doc_id and the score of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, empty)
            for block in W.blocks(batch.column("text")) if network else ():
                x = inputs(block, network.vocabulary)
                best = np.full(block.rows, -1.0)
                np.maximum.at(best, x.text, network.score(x))
                out[block.first:block.first + block.rows] = np.where(best >= 0, best, empty)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    texts, known = sample(documents, labels)
    empty = float(known.mean()) / 2 if len(known) else 0.0
    found = scores(documents, train(texts, known), empty)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
