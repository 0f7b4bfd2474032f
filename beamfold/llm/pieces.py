"""SentencePiece encoding and decoding with a table of distinct chunks.

If no piece of the model crosses from a word into a following whitespace marker, the segmentation of a text is that of its
marked words (a run of markers and what follows up to the next marker), each by itself. A task segments each distinct marked
word of its texts once and joins the ids back by position; the table is emptied when it holds ``TABLE`` words, so memory is
bounded. A model with crossing pieces, or one that rewrites spaces, is given whole texts instead.

Defined cases: a null or empty text has no ids and decodes to the empty text; equal rows each get a row; a very long text is
one list of ids; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from beamfold.llm.catalog import query, table

TABLE = 150_000
GROUP = 256
MARK = "▁"
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class Segmenter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        crossing = any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(size))
        self.apart = not crossing and self.model.normalize(" a  b ") == f"{MARK}{MARK}a{MARK}{MARK}b{MARK}"
        self.lone = (self.model.piece_to_id(MARK),)
        #: Text after the first marker of a marked word -> its ids and their decimal form.
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def chunks(self, text: str) -> list[str]:
        """Marked words of a text, each without its first marker."""
        if not text:
            return []
        if not self.apart:
            return [text]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            found = _RUN.findall(MARK + text.replace(" ", MARK))
            return [x[1:].replace(MARK, " ") for x in found]
        return text.split(" ")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids of each text and their decimal form, joined by commas."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > TABLE:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1)):
            ids = tuple(ids) if chunk else self.lone
            self.known[chunk] = ids, ",".join(map(str, ids))
        known = self.known.__getitem__
        for c in cut:
            rows = list(map(known, c))
            yield list(chain.from_iterable([r[0] for r in rows])), ",".join([r[1] for r in rows])


@cache
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = segmenter(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for at in range(0, batch.num_rows, GROUP):
                texts = [t or "" for t in batch.column("text").slice(at, GROUP).to_pylist()]
                for ids, decimal in tool.encode(texts):
                    n.append(len(ids))
                    ids_sha.append(sha(decimal))
                    text_sha.append(sha(tool.model.decode(ids) if ids else ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([i for i, _ in segmenter(path).encode(texts)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each list of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [segmenter(path).model.decode(i) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """One row per document: number of ids, hash of the ids, hash of the text they decode to."""
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _encode(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path())
