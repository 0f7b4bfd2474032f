"""Packing of token ids into windows of a fixed length by the sum-of-squares rule.

A document's ids and an end id are an item. What fills whole windows is cut off the front of a longer item and stands alone.
The rest is placed online: with N(h) windows open at fill h, an item of size s goes to the fill (0: a new window) that makes the
sum of N(h)**2 over 0 < h < length least, the fullest of equal ones. One array holds N by level, so a choice is a few vector
operations and does not depend on the number of windows. A window that is full is written at once.

Each task packs its own rows, so nothing is shuffled and a lost task is packed anew by itself. At its end a task closes the
windows still open: the emptiest are cut into the gaps of the fullest, which leaves one partial window a task at most; its ids
are cut at powers of two, lengths that need no padding. What a task holds is its open windows, whose number grows like the
square root of its items at most.

The result is written as a table of pieces with their ids (``write``), window by window; ids of windows come from the windows
of the tasks before. Texts null or empty have the end id only. Repeated rows are packed as often as they occur, a null doc_id is
kept, other columns are ignored, an empty table gives no pieces.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beamfold.llm.catalog import query, table
from beamfold.llm.tokens import encoder, tokenizer_path
from beamfold.session import new_folder

LENGTH, END_ID, GROUP = 2048, 1, 128
_PIECE = "part int, window long, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"
_KINDS = [pa.int32(), *[pa.int64()] * 6, pa.binary()]

#: doc_id, start, doc_tokens, ids as little-endian u32
Piece = tuple[int | None, int, int, bytes]


class Packer:
    """Online sum-of-squares packing; ``full`` collects windows as lists of pieces."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.at: list[list[list[Piece]]] = [[] for _ in range(length + 1)]
        self.full: list[list[Piece]] = []

    def level(self, size: int) -> int:
        """Fill to place an item of less than ``length`` at."""
        n, top = self.counts, self.length - size
        # A window goes from h to h + size, which changes the sum by 2 (N(h + size) - N(h) + 1).
        change = 2 * (n[size:] - n[:top + 1] + 1)
        # A new one leaves no level, a full one enters none.
        change[0] -= 1
        change[top] -= 1
        open_ = np.flatnonzero(n[:top + 1])
        if not len(open_):
            return 0
        values = change[open_]
        best = values.min()
        return 0 if change[0] < best else int(open_[values == best][-1])

    def _place(self, piece: Piece, size: int) -> None:
        h = self.level(size)
        window = self.at[h].pop() if h else []
        self.counts[h] -= bool(h)
        window.append(piece)
        if h + size == self.length:
            self.full.append(window)
        else:
            self.at[h + size].append(window)
            self.counts[h + size] += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.length
        whole = total // step * step
        for start in range(0, whole, step):
            self.full.append([(doc_id, start, total, ids[4 * start:4 * (start + step)])])
        if whole < total:
            self._place((doc_id, whole, total, ids[4 * whole:]), total - whole)

    def close(self) -> None:
        """The fullest windows take the pieces of the emptiest, cut to fit; the last one is cut at powers of two."""
        ordered = [w for h in range(self.length, 0, -1) for w in self.at[h]]
        self.at, self.counts[:] = [[] for _ in range(self.length + 1)], 0
        first, last = 0, len(ordered) - 1
        while first < last:
            window, gap = ordered[first], self.length - sum(len(p[3]) for p in ordered[first]) // 4
            while gap and last > first:
                doc_id, start, total, ids = ordered[last].pop()
                keep = max(len(ids) // 4 - gap, 0)
                # The piece's end goes, its beginning stays where it is.
                window.append((doc_id, start + keep, total, ids[4 * keep:]))
                gap -= len(ids) // 4 - keep
                if keep:
                    ordered[last].append((doc_id, start, total, ids[:4 * keep]))
                elif not ordered[last]:
                    last -= 1
            if gap:
                break
            self.full.append(window)
            first += 1
        if first <= last:
            self._split(ordered[first])

    def _split(self, window: list[Piece]) -> None:
        left, pieces = sum(len(p[3]) for p in window) // 4, window[::-1]
        while left:
            size = min(1 << left.bit_length() - 1, self.length)
            left -= size
            out = []
            while size:
                doc_id, start, total, ids = pieces.pop()
                n = min(len(ids) // 4, size)
                out.append((doc_id, start, total, ids[:4 * n]))
                size -= n
                if 4 * n < len(ids):
                    pieces.append((doc_id, start + n, total, ids[4 * n:]))
            self.full.append(out)


def _pack(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, done, end = TaskContext.get().partitionId(), Packer(length), 0, struct.pack("<I", end_id)

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal done
            rows = []
            for window in packer.full:
                offset = 0
                for doc_id, start, total, ids in window:
                    rows.append((part, done, doc_id, start, len(ids) // 4, total, offset, ids))
                    offset += len(ids) // 4
                done += 1
            packer.full.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                texts = [t or "" for t in batch.column("text").slice(at, GROUP).to_pylist()]
                for doc_id, ids in zip(batch.column("doc_id").slice(at, GROUP).to_pylist(), encoder(path).encode(texts)):
                    packer.add(doc_id, ids + end)
                yield from written()
        packer.close()
        yield from written()

    return run


def write(documents: DataFrame, path: str, folder: str, length: int = LENGTH, end_id: int = END_ID) -> None:
    """Pack the documents and write the pieces with their ids, one row each, windows one after the other."""
    documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_pack(path, length, end_id), _PIECE).write.parquet(folder)


def read_pieces(spark: SparkSession, folder: str, ids: Column | str = "ids") -> DataFrame:
    """Written pieces: doc_id, start, length, doc_tokens, sequence_id (from 0 without gaps), offset, ids, or what is asked of ids."""
    pieces = spark.read.schema(_PIECE).parquet(folder)
    own = pieces.select("part", "window", "doc_id", "start", "length", "doc_tokens", "offset", ids)
    # One row per written part: as many as the write had tasks, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("part").agg((F.max("window") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return own.join(parts, "part").select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset", own.columns[-1])


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "packed")
    write(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_pieces(spark, folder, F.crc32("ids").alias("ids_crc32"))
