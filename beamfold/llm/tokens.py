"""Token ids as a binary table: documents compressed one by one with a shared zstandard dictionary.

Format: a folder with two Parquet tables. ``dictionary`` has one row: sha256 and content of the zstandard dictionary, and
how many documents it was trained on. ``blocks`` has one row per block, in ascending order of doc_id over (part, block):
first_id, last_id, n_docs, n_tokens and ``payload``, which is

    magic ``TIDS`` | sha256 of the dictionary (32 bytes) | n u32 | doc_id i64[n] | is null u8[n] | n_tokens u32[n]
    | offset u64[n + 1] | zstandard frames, one per document, of its ids as little-endian u32

A reader checks the dictionary's hash, finds a document by the block's id range and its offset, and decompresses that frame
alone. Spark's writer commits the tables, so a lost executor or a repeated task leaves no half-written block.

Ids come from the tokenizers library. A space between two visible characters always begins a pre-token, so a text is cut
there and each distinct cut of a task's texts is encoded once; texts with runs of white space are cut only at single spaces.

The dictionary is a model fitted on at most ``SAMPLE_DOCUMENTS`` documents of at most ``SAMPLE_BYTES`` bytes, those with the
smallest hash of their doc_id (of rows of one doc_id, of their text). Rows of one doc_id are ordered by the hash of their text; a null doc_id comes first. A null or
empty text has the end id only. Other columns are ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beamfold.llm.catalog import query, table
from beamfold.session import new_folder

SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8192, 64 << 10
END_ID = 2
BLOCK_BYTES = 1 << 20
TABLE = 600_000
GROUP = 128
LEVEL = 1
MAGIC = b"TIDS"
_TWO_SPACES = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")
_BLOCK = "part int, block int, first_id long, last_id long, n_docs long, n_tokens long, payload binary"


class _Table(dict):
    """What follows a space, up to the next cut -> ids of the space and it; a new entry is encoded when it is first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # The byte-level model's own letters: printable bytes stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}

    def __missing__(self, text: str) -> bytes:
        if text.isalpha():  # a space and letters are one pre-token
            shown = (" " + text).encode().decode("latin-1").translate(self.letters)
            raw = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        elif text[-1:] in (".", ",") and text[:-1].isalpha():  # so is one mark at the end
            raw = self[text[:-1]] + self.marks[text[-1]]
        else:
            raw = self.whole(" " + text)
        self[text] = raw
        return raw

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @cached_property
    def marks(self) -> dict[str, bytes]:
        return {m: self.whole(m) for m in ".,"}

    def trim(self) -> None:
        """Keep the words met first, which are the common ones."""
        if len(self) > TABLE:
            first = dict(islice(self.items(), TABLE // 4))
            self.clear()
            self.update(first)


class Encoder:
    """Texts to little-endian u32 ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _Table(Tokenizer.from_file(path))

    @staticmethod
    def cut(text: str) -> list[str]:
        """The text up to the first cut, then what follows the space of each cut."""
        if not _TWO_SPACES.search(text):
            return text.split(" ")
        first, *rest = _SINGLE_SPACE.split(text)
        return [first, *(x[1:] for x in rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, known = [], self.known.__getitem__
        for text in texts:
            first, *rest = self.cut(text)
            out.append(self.known.whole(first) + b"".join(map(known, rest)))
        self.known.trim()
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(documents: DataFrame, path: str, end_id: int) -> tuple[bytes, int]:
    """Content of a dictionary, and how many documents it has seen; too few documents to train on are the content themselves."""
    # The rows themselves are chosen, by their hashes; only chosen ones have their texts read.
    tie = F.xxhash64("text")
    short = documents.where(F.col("doc_id").isNotNull() & F.octet_length("text").between(1, SAMPLE_BYTES))
    chosen = {tuple(r) for r in short.select("doc_id", tie.alias("tie")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(SAMPLE_DOCUMENTS).collect()}
    rows = short.where(F.col("doc_id").isin(sorted({i for i, _ in chosen})) & tie.isin(sorted({t for _, t in chosen}))).select(
        "doc_id", "text", tie.alias("tie")).dropDuplicates(["doc_id", "tie"]).collect() if chosen else []
    rows = sorted(r for r in rows if (r[0], r[2]) in chosen)
    samples = [x + struct.pack("<I", end_id) for x in encoder(path).encode([r[1] for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), len(samples)
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES], len(samples)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def pack(ids: list[int | None], arrays: list[bytes], frames: list[bytes], sha: bytes) -> bytes:
    n = len(ids)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    return b"".join([
        MAGIC, sha, struct.pack("<I", n), np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids),
        np.array([len(a) // 4 for a in arrays], "<u4").tobytes(), offsets.tobytes(), *frames])


def unpack(payload: bytes, sha: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, memoryview]:
    """doc_ids, numbers of ids, offsets and frames; refuses a block of another dictionary."""
    if payload[:4] != MAGIC or payload[4:36] != sha:
        raise ValueError("not a block of this dictionary")
    n, at = struct.unpack_from("<I", payload, 36)[0], 40
    ids = np.frombuffer(payload, "<i8", n, at).tolist()
    empty = payload[at + 8 * n:at + 9 * n]
    counts = np.frombuffer(payload, "<u4", n, at + 9 * n)
    offsets = np.frombuffer(payload, "<u8", n + 1, at + 13 * n)
    return [None if e else i for i, e in zip(ids, empty)], counts, offsets, memoryview(payload)[at + 13 * n + 8 * (n + 1):]


def _blocks(path: str, content: bytes, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        sha, end = hashlib.sha256(content).digest(), struct.pack("<I", end_id)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(content)).compress
        ids, arrays, size = [], [], 0

        def flush() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [part, number, min(known, default=None), max(known, default=None), len(ids), sum(map(len, arrays)) // 4, pack(ids, arrays, [squeeze(a) for a in arrays], sha)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                texts = [t or "" for t in batch.column("text").slice(at, GROUP).to_pylist()]
                for i, a in zip(batch.column("doc_id").slice(at, GROUP).to_pylist(), encoder(path).encode(texts)):
                    ids.append(i)
                    arrays.append(a + end)
                    size += len(a) + 4
                    if size >= BLOCK_BYTES:
                        yield flush()
                        ids, arrays, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return run


def write(documents: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the documents' ids in ascending order of doc_id. Only texts are shuffled, once, by ranges of (doc_id, hash)."""
    spark = documents.sparkSession
    texts = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    content, seen = train_dictionary(texts, path, end_id)
    spark.createDataFrame([(hashlib.sha256(content).hexdigest(), content, seen)], "sha256 string, content binary, documents long").coalesce(1).write.parquet(f"{folder}/dictionary")
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(_blocks(path, content, end_id), _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def _content(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens and crc32 of the ids."""
    content = _content(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256(content).digest()
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress
        for batch in batches:
            for part, block, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "payload"))):
                ids, counts, offsets, frames = unpack(payload, sha)
                crc = [zlib.crc32(open_(frames[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                n = len(ids)
                within = np.cumsum(counts, dtype=np.int64) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(within), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    documents = blocks.select("part", "block", "payload").mapInArrow(run, "part int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    heads = blocks.select("part", "block", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # One row per written part: as many as the write had tasks, whatever the number of documents.
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("parts_before", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)))
    bases = heads.withColumn("blocks_before", F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("block")), F.lit(0)))
    bases = bases.join(parts, "part").select("part", "block", (F.col("parts_before") + F.col("blocks_before")).alias("base"))
    return documents.join(bases, ["part", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents: the block ranges select the blocks, the offsets select the frames."""
    content, wanted = _content(spark, folder), set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256(content).digest()
        open_ = zstandard.ZstdDecompressor(dict_data=_dictionary(content)).decompress
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                ids, _, offsets, frames = unpack(payload, sha)
                got = [(i, np.frombuffer(open_(frames[int(offsets[k]):int(offsets[k + 1])]), "<u4")) for k, i in enumerate(ids) if i in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([a.tolist() for _, a in got], pa.list_(pa.int64()))], ["doc_id", "ids"])

    near = F.lit(False)
    for i in wanted:
        near |= F.lit(i).between(F.col("first_id"), F.col("last_id"))
    return spark.read.parquet(f"{folder}/blocks").where(near).select("payload").mapInArrow(run, "doc_id long, ids array<long>")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_token_binary")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write(table(spark, sf_dir, "documents"), tokenizer_path(), folder)
    return read_digests(spark, folder)
