"""Phrases whose words stand together more often than apart, per language, by dynamic itemset counting.

Rows are dealt to ``SHARDS`` shards that are scanned in turn, round and round. From the first scan on every word is counted; a phrase
of k words becomes active in the scan after both its parts of k - 1 words have reached the threshold, and is counted in each scan
until it has seen every shard once. So scans of one cycle count several lengths together, and the rounds end when no active phrase is
left. As counts only grow, each phrase that reaches the threshold in the end has parts that reach it before, and is counted whole.

A phrase is a 64-bit hash of its language and words, and counts as equal to one with the same hash. When a phrase has reached the
threshold, the scan after which it did so is noted in a table of ``1 << SLOT_BITS`` bytes under the first bits of its hash, the
stamps. A phrase is active from the later stamp of its two parts on, so that a stamp is all a scan needs to know, and each task
gets this table of fixed size. Where two phrases share a slot, the later is counted earlier or without need; its count stays right.

A task counts its phrases in sorted arrays and hands them over in slices by the first bits of their hash, packed; one group per slice
adds them to the slice's counts so far. Nothing is grouped by phrase in rows, a frequent phrase is one entry a task. After a
phrase's cycle, counts under the threshold are dropped. The driver gets the new stamps, a bit a slot at most. A last scan finds
the words of the phrases that reached the threshold, in slices as well; cuts, scores, drops and ranks are joins and windows.

Texts null or empty have no words, a null language is ``und``. Repeated rows count as often as they occur; texts are never cut, long
ones are counted as a block of their own. Equal scores and counts rank by phrase. Other columns are ignored; an empty table
has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from beamfold.llm import words as W
from beamfold.llm.catalog import query, table
from beamfold.session import new_folder, stage

THRESHOLD, LONGEST, TOP = 100, 5, 2000
SHARDS, SLOT_BITS = 4, 24
#: Stamps of a slot without a phrase, and of one whose only phrases have full length, so that nothing follows from them.
NEVER, LAST = 255, 254
FLUSH = 1 << 22
OTHER_LANGUAGE = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STATE = "slice int, keys binary, counts binary, marks binary, bits binary, last binary"
_STATE_KINDS = [pa.int32(), *[pa.binary()] * 5]
_MET = "slice int, keys binary, langs array<string>, phrases array<string>"
_MET_KINDS = [pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
_FOUND = "lang string, words long, key long, phrase string, heads array<long>, tails array<long>"
_FOUND_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
#: Slice of the languages' numbers of words.
TOTALS = -1


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in schema.split(", ")])


def _squeeze(a: np.ndarray) -> bytes:
    """Equal bytes of the values next to each other, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def _expand(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(keys: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> list[bytes]:
    """Sorted keys by their steps, which are short."""
    return [_squeeze(np.diff(keys, prepend=np.uint64(0))), _squeeze(counts), _squeeze(marks)]


def _unpack(keys: bytes, counts: bytes, marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(_expand(keys, np.uint64), dtype=np.uint64), _expand(counts, np.int64), _expand(marks, np.uint16)


def _added(keys: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their counts; a key has one mark wherever it stands."""
    if not len(keys):
        return keys, counts, marks
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at), marks[order[at]]


class Grams:
    """Phrases of a block by length: places of their first words, hashes, and the scan from which they are active."""

    def __init__(self, block: W.Block, languages: np.ndarray, stamps: np.ndarray, shift: int):
        w = self.words = W.words(block, _WORD)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[block.data])])[w.start]
        #: words behind which another one of the same piece stands
        self.joined = (w.text[1:] == w.text[:-1]) & (breaks[1:] == breaks[:-1])
        self.languages, self.stamps, self.shift = languages, stamps, np.uint64(shift)

    def stamped(self, keys: np.ndarray) -> np.ndarray:
        return self.stamps[keys >> self.shift] != NEVER

    def lengths(self, longest: int, until: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places, hashes, active from), phrases active by ``until``, shortest first; ends where there are none."""
        n = len(self.words.hash)
        places, keys = np.arange(n), W.mix(self.words.hash ^ self.languages[self.words.text])
        since = np.zeros(n, np.uint8)
        for length in range(1, longest + 1):
            yield length, places, keys, since
            if length == longest:
                return
            # A slot may be stamped for another phrase before this one is counted at all.
            since = np.maximum(since, self.stamps[keys >> self.shift])
            # Both parts are known where the next place is a phrase too, and the word behind it belongs to the piece.
            at = np.flatnonzero(places[1:] == places[:-1] + 1)
            at = at[self.joined[places[at] + length - 1]]
            both = np.maximum(since[at], since[at + 1])
            at, since = at[both <= until], both[both <= until]
            tail = self.words.hash[places[at] + length]
            places, keys = places[at], W.mix(keys[at] * np.uint64(0x9FB21C651E98DF25) + W.mix(tail + np.uint64(length)))


def _language_keys(column: pa.Array) -> tuple[list[str], np.ndarray]:
    names = column.to_pylist()
    known = {}
    for v in dict.fromkeys(names):
        raw = np.frombuffer(v.encode(), np.uint8)
        known[v] = W.ranges_hash(W.Block(0, raw, np.array([0, len(raw)])), np.array([0]), np.array([len(raw)]))[0]
    return names, np.array([known[v] for v in names], np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], stamps: bytes, slot_bits: int) -> Iterator[tuple[list[str], W.Block, Grams]]:
    """(languages of the block's texts, block, phrases)"""
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(stamps), np.uint8)
    for batch in batches:
        names, keys = _language_keys(batch.column("lang"))
        for block in W.blocks(batch.column("text")):
            own = slice(block.first, block.first + block.rows)
            yield names[own], block, Grams(block, keys[own], table, 64 - slot_bits)


def _edges(slices: int) -> np.ndarray:
    """First key of each slice; the last slice has no end."""
    return np.array([-(-(s << 64) // slices) for s in range(slices)], np.uint64)


def _slots(number: int, slices: int, slot_bits: int) -> tuple[int, int]:
    """Slots that a slice's keys can have."""
    edges = (_edges(slices) >> np.uint64(64 - slot_bits)).tolist()
    return edges[number], edges[number + 1] + 1 if number + 1 < slices else 1 << slot_bits


def _scan(stamps: bytes, step: int, shards: int, longest: int, slices: int, slot_bits: int):
    """Count what is active in this scan: phrases active since one of the last ``shards`` scans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, marks = (np.concatenate(h) for h in zip(*held))
            held.clear()
            keys, counts, marks = _added(keys, np.ones(len(keys), np.int64), marks)
            cut = [*np.searchsorted(keys, _edges(slices)).tolist(), len(keys)]
            return _batch([(s, *_pack(keys[a:b], counts[a:b], marks[a:b]), None, None) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b], _STATE, _STATE_KINDS)

        for _, _, grams in _blocks(batches, stamps, slot_bits):
            for length, _, keys, since in grams.lengths(longest, step):
                keep = since.astype(np.int64) > step - shards
                held.append((keys[keep], since[keep].astype(np.uint16) << np.uint16(8) | np.uint16(length)))
            if sum(len(k) for k, _ in held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def _merge(step: int, shards: int, threshold: int, longest: int, slices: int, slot_bits: int):
    """Add up a slice's counts and drop what is complete and rare. bits and last: which of the slice's slots hold a phrase that has
    reached the threshold, of less than full length and of full length."""
    def run(group: pa.Table) -> pa.Table:
        number = group.column("slice")[0].as_py()
        parts = [_unpack(*p) for p in zip(*(group.column(c).to_pylist() for c in ("keys", "counts", "marks")))]
        keys, counts, marks = _added(*(np.concatenate(p) for p in zip(*parts)))
        many, full = counts >= threshold, (marks & np.uint16(255)) == longest
        keep = many | ((marks >> np.uint16(8)).astype(np.int64) > step + 1 - shards)
        low, high = _slots(number, slices, slot_bits)
        bits = []
        for which in (many & ~full, many & full):
            own = np.zeros(high - low, bool)
            own[(keys[which] >> np.uint64(64 - slot_bits)).astype(np.int64) - low] = True
            bits.append(np.packbits(own).tobytes())
        return pa.Table.from_batches([_batch([(number, *_pack(keys[keep], counts[keep], marks[keep]), *bits)], _STATE, _STATE_KINDS)])

    return run


def _met(longest: int, stamps: bytes, slices: int, slot_bits: int):
    """Language and words of stamped phrases of two words or more, each once a task, in slices; and each language's number of words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        new: dict[int, tuple[str, str]] = {}
        totals: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.fromiter(new, np.uint64, len(new)))
            cut = [*np.searchsorted(keys, _edges(slices)).tolist(), len(keys)]
            rows = []
            for number, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
                if a < b:
                    own = [new[k] for k in keys[a:b].tolist()]
                    rows.append((number, keys[a:b].tobytes(), [x[0] for x in own], [x[1] for x in own]))
            new.clear()
            return _batch(rows, _MET, _MET_KINDS)

        for names, block, grams in _blocks(batches, stamps, slot_bits):
            w, data = grams.words, block.data.tobytes()
            for name, n in zip(names, w.counts.tolist()):
                totals[name] = totals.get(name, 0) + n
            for length, places, keys, _ in grams.lengths(longest, LAST - 1):
                if length == 1:
                    continue
                keep = np.flatnonzero(grams.stamped(keys))
                known, index = np.unique(keys[keep], return_index=True)
                for k, p in zip(known.tolist(), places[keep[index]].tolist()):
                    if k not in seen:
                        seen.add(k)
                        words = b" ".join([data[a:b] for a, b in zip(w.start[p:p + length].tolist(), w.end[p:p + length].tolist())])
                        new[k] = names[w.text[p]], words.lower().decode()
            if len(new) > FLUSH // 16:
                yield flush()
        if new:
            yield flush()
        yield _batch([(TOTALS, np.array(list(totals.values()), np.int64).tobytes(), list(totals), None)], _MET, _MET_KINDS)

    return run


def _named(longest: int, stamps: bytes, slot_bits: int):
    """Each phrase of a slice once, with the keys of its parts; or each language's number of words in all."""
    def run(group: pa.Table) -> pa.Table:
        langs = [x for v in group.column("langs").to_pylist() for x in v]
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.int64)
        if group.column("slice")[0].as_py() == TOTALS:
            total: dict[str, int] = {}
            for name, n in zip(langs, keys.tolist()):
                total[name] = total.get(name, 0) + n
            return pa.Table.from_batches([_batch([(name, n, None, None, None, None) for name, n in total.items()], _FOUND, _FOUND_KINDS)])
        phrases = [x for v in group.column("phrases").to_pylist() for x in v]
        first = np.unique(keys, return_index=True)[1].tolist()
        rows, at = [], 0
        batch = pa.RecordBatch.from_arrays([pa.array([langs[i] for i in first], pa.string()), pa.array([phrases[i] for i in first], pa.string())], ["lang", "text"])
        for names, block, grams in _blocks(iter([batch]), stamps, slot_bits):
            levels = [(places, level) for _, places, level, _ in grams.lengths(longest, LAST - 1)]

            def key(length: int, place: int) -> int:
                places, level = levels[length - 1]
                return int(level[np.searchsorted(places, place)].view(np.int64))

            for name, n, p in zip(names, grams.words.counts.tolist(), grams.words.firsts.tolist()):
                i, cuts = first[at], range(1, n)
                rows.append((name, None, int(keys[i]), phrases[i], [key(c, p) for c in cuts], [key(n - c, p + c) for c in cuts]))
                at += 1
        return pa.Table.from_batches([_batch(rows, _FOUND, _FOUND_KINDS)])

    return run


def _entries(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "marks"))):
                keys, counts, _ = _unpack(*row)
                many = counts >= threshold
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], ["key", "n"])

    return run


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def count_phrases(documents: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """(counts, names). counts: (key, n) of every phrase of up to ``longest`` words with n >= threshold occurrences. names: its lang,
    key and phrase where it has two words or more, and the keys of its parts by cut, heads and tails; also other phrases that share a
    slot with one of these. Rows of names without a key have a language's number of words."""
    if shards * longest >= LAST:
        raise ValueError(f"shards times longest must stay below {LAST}")
    spark = documents.sparkSession
    slices = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit(OTHER_LANGUAGE)).alias("lang"), "text").where("length(text) > 0")
    dealt = new_folder(spark, "shards")
    texts.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(dealt)
    dealt_texts = spark.read.schema("lang string, text string, shard int").parquet(dealt)

    stamps, state, folder, step = np.full(1 << slot_bits, NEVER, np.uint8), None, None, 0
    squeeze = zstandard.ZstdCompressor(level=1).compress
    while step < shards or ((stamps < LAST) & (stamps > step - shards)).any():
        shard = dealt_texts.where(F.col("shard") == step % shards).select("lang", "text")
        counted = shard.mapInArrow(_scan(squeeze(stamps.tobytes()), step, shards, longest, slices, slot_bits), _STATE)
        if state is not None:
            counted = counted.unionAll(state)
        before, folder = folder, new_folder(spark, "counts")
        counted.groupBy("slice").applyInArrow(_merge(step, shards, threshold, longest, slices, slot_bits), _STATE).write.option("compression", "none").parquet(folder)
        state = spark.read.schema(_STATE).parquet(folder)
        if before:
            _delete(spark, before)
        step += 1
        for number, bits, last in state.select("slice", "bits", "last").collect():
            low, high = _slots(number, slices, slot_bits)
            own = stamps[low:high]
            for raw, stamp in ((last, LAST), (bits, step)):
                own[np.unpackbits(np.frombuffer(raw, np.uint8), count=high - low).astype(bool) & (own >= (LAST if stamp == step else NEVER))] = stamp
    counts = stage(state.select("keys", "counts", "marks").mapInArrow(_entries(threshold), "key long, n long"), "phrases")
    final = squeeze(stamps.tobytes())
    met = dealt_texts.select("lang", "text").mapInArrow(_met(longest, final, slices, slot_bits), _MET)
    return counts, stage(met.groupBy("slice").applyInArrow(_named(longest, final, slot_bits), _FOUND), "names")


def collocations(documents: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    counts, names = count_phrases(documents, threshold, longest, shards, slot_bits)
    totals = names.where("key is null").select("lang", F.col("words").alias("n"))
    found = stage(names.where("key is not null").drop("words").join(counts.withColumnRenamed("n", "a"), "key"), "candidates")

    cut = found.select("lang", "key", "a", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "c")).select("lang", "key", "a", "k", "c.*")
    cut = cut.join(counts.select(F.col("key").alias("heads"), F.col("n").alias("l")), "heads").join(counts.select(F.col("key").alias("tails"), F.col("n").alias("r")), "tails").join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.expr("(cast(1000 as decimal(4,0)) * big_a * big_n) div (big_l * big_r)")
    cut = cut.withColumns({f"big_{c}": wide(c) for c in ("a", "n", "l", "r")}).select("key", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = cut.groupBy("key").agg(F.min("cut").alias("cut"), F.min("n").alias("n"))

    # Counts only fall as phrases grow, so if a longer one equals a phrase, so does one that is a word longer.
    longer = found.where("size(heads) > 1").select("a", F.explode(F.array(F.element_at("heads", F.lit(-1)), F.element_at("tails", F.lit(1)))).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("most"))
    kept = found.join(longer, "key", "left").where("most is null or most < a").select("lang", "key", "phrase", "a").join(scored, "key")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL_COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + m - 1] AS g, CAST(count(*) AS HUGEINT) AS f FROM starts, range(1, 6) AS lengths(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
many AS (SELECT * FROM grams WHERE f >= 100),
cuts AS (SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, k, 1000 * c.f * n // (l.f * r.f) AS score FROM many c JOIN range(1, 5) AS cut(k) ON k < len(c.g)
    JOIN totals USING (lang) JOIN many l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN many r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT c.lang, c.g[i:i + m - 1] AS g, max(c.f) AS most FROM many c, range(1, 5) AS s(i), range(2, 5) AS lengths(m)
    WHERE m < len(c.g) AND i + m - 1 <= len(c.g) GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inner_ USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
    CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", SQL_COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
