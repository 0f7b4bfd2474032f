"""Exact-substring dedup: every byte under a string of ``SPAN`` bytes that starts at two places or more.

1. Anchors. Each window of SPAN bytes names one of its k-grams, the one of the least hash. Equal windows name the same k-gram,
   so a window whose anchor occurs once cannot repeat. Windows in a row with one anchor form a context.
2. Contexts of the anchors that occur at two places are collapsed by content. A context found twice repeats in all its windows.
3. Of each anchor with several distinct contexts, of which one at least is new, all meet in one shard. How far each agrees with
   any other to the left and to the right of the anchor leaves only windows that can repeat; a suffix order by linear grouping
   (``suffixes``) puts equal ones of these next to each other, where what all contexts share around the anchor is one symbol, and
   neighbours are compared byte by byte. An anchor of more than ``MOST`` contexts, such as the end of a passage that very many
   documents share, is split first: a window reaches far to its right or else far to its left, so it also contains one of two
   longer anchors (``_split``). Its contexts under these are collapsed and ordered likewise, or split again, at last down to whole
   windows; so no task holds more than ``MOST`` contexts at once, and every window is settled by content or by the order.
4. Repeating windows are merged into removal spans of each distinct text; equal texts are worked on once.

Hashes have 64 bits; texts and contexts count as equal if these agree.

Defined cases: a null or empty text has no bytes, nothing is removed; a text shorter than SPAN keeps all; equal rows are
copies of each other and each gets a row; matches never cross documents, overlapping ones count; other columns are ignored;
an empty table gives no rows. Kept bytes are given by hash, and by ``cleaned`` as text, in which bytes of a letter cut in two
become the replacement character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.llm import words as W
from beamfold.llm.catalog import query, table
from beamfold.llm.suffixes import suffix_order
from beamfold.session import stage

SPAN, GRAM = 200, 40
MOST = 4000
_PLACE_BITS = 31
_PLACE = W.series(5, 1)[0] | np.uint64(1)


def _keys(block: W.Block) -> np.ndarray:
    return W.ranges_hash(block, block.offsets[:-1], block.offsets[1:]).view(np.int64)


def _identity(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One number for a place of a text."""
    return W.mix(keys.view(np.uint64) + places.astype(np.uint64) * _PLACE).view(np.int64)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, size, sha = [], [], []
        for block in W.blocks(batch.column("text")):
            key.append(_keys(block))
            size.append(np.diff(block.offsets))
            sha += [hashlib.sha256(block.data[a:b]).hexdigest() for a, b in zip(block.offsets[:-1], block.offsets[1:])]
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), join(key), join(size), pa.array(sha, pa.string())], ["doc_id", "key", "n_bytes", "sha"])


_CONTEXT = "anchor long, place long, key long, start int, windows int, lead int, content long"


def contexts(block: W.Block) -> dict[str, np.ndarray] | None:
    """All contexts of a block: anchor hash, identity of the place, text key, first window, number of windows, windows
    before the anchor, hash of the bytes under the windows."""
    n = len(block.data)
    if n < SPAN:
        return None
    total = W.prefix(block)
    at = np.arange(n - GRAM + 1)
    gram = W.ranges_hash(block, at, at + GRAM, total=total)
    packed = (gram >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    width, least = 1, packed
    while width * 2 <= SPAN - GRAM + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    more = SPAN - GRAM + 1 - width
    least = np.minimum(least[:len(least) - more], least[more:]) if more else least
    window = np.arange(len(least))
    text = np.searchsorted(block.offsets, window, "right") - 1
    inside = window + SPAN <= block.offsets[text + 1]
    window, text, place = window[inside], text[inside], (least[inside] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    if not len(window):
        return None
    first = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    count = np.diff(np.append(first, len(window)))
    start, text, place = window[first], text[first], place[first]
    key = _keys(block)[text]
    base = block.offsets[text]
    return {"anchor": gram[place].view(np.int64), "place": _identity(key, place - base), "key": key, "start": (start - base).astype(np.int32),
            "windows": count.astype(np.int32), "lead": (place - start).astype(np.int32),
            "content": W.ranges_hash(block, start, start + count - 1 + SPAN, total=total).view(np.int64)}


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column("text")):
            if found := contexts(block):
                yield pa.RecordBatch.from_pydict(found)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_keys(b) for b in W.blocks(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), batch.column("text")], ["key", "text"])


_SNIPPET = "anchor long, many long, place long, key long, start int, windows int, lead int, repeated boolean, bytes binary"
_KNOWN = [c.split()[0] for c in _SNIPPET.split(", ")][:-1]


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes under the wanted contexts of a text."""
    for batch in batches:
        for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "wanted"))):
            raw = text.encode()
            rows = [(w["anchor"], w["many"], w["place"], key, w["start"], w["windows"], w["lead"], w["repeated"], raw[w["start"]:w["start"] + w["windows"] - 1 + SPAN]) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()])], [*_KNOWN, "bytes"])


def _common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def _agreement(sides: list[bytes]) -> tuple[list[int], int]:
    """Bytes that each begins with like another one, and those that all begin with."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    near = [_common(sides[a], sides[b]) for a, b in zip(order, order[1:])]
    most = [0] * len(sides)
    for k, before, after in zip(order, [0, *near], [*near, 0]):
        most[k] = max(before, after)
    return most, min(near)


def repeated_windows(members: list[tuple[bytes, int, int, bool]], core: int = GRAM) -> list[list[int]]:
    """members: distinct contexts of one anchor of ``core`` bytes as (bytes, windows, lead, all its windows repeat anyway). The
    windows of each that some other one has, too."""
    out = [list(range(m[1])) if m[3] else [] for m in members]
    left, _ = _agreement([m[0][:m[2]][::-1] for m in members])
    right, _ = _agreement([m[0][m[2] + core:] for m in members])
    # Windows that go beyond what a context has in common with any other one on either side are its own.
    able = [(k, max(m[2] - left[k], 0), min(m[1], m[2] + core + right[k] - SPAN + 1)) for k, m in enumerate(members)]
    able = [(k, a, b) for k, a, b in able if a < b]
    if len(able) > 1 and not all(members[k][3] for k, *_ in able):
        found = _same_windows([(members[k][0][a:b - 1 + SPAN], b - a, members[k][2] - a) for k, a, b in able], core)
        for (k, a, _), windows in zip(able, found):
            if not members[k][3]:
                out[k] = [a + w for w in sorted(windows)]
    return out


def _same_windows(members: list[tuple[bytes, int, int]], core: int) -> list[set[int]]:
    """Windows (bytes, windows, lead) of each that some other one has, by the suffix order of all."""
    _, same = _agreement([m[0][:m[2]][::-1] for m in members])  # bytes before the anchor that all share
    _, more = _agreement([m[0][m[2] + core:] for m in members])
    end = core + more  # bytes from the anchor on that all share
    sequence: list[int] = []
    owner: list[tuple[int, int]] = []  # context and window, or -1 for the shared symbol, or None
    for k, (raw, windows, lead) in enumerate(members):
        head = lead - same
        sequence += [b + 2 for b in raw[:head]] + [258] + [b + 2 for b in raw[lead + end:]] + [1]
        owner += [(k, i) if i < windows else (k, -2) for i in range(head)] + [(k, -1)] + [(k, -2)] * (len(raw) - lead - end + 1)
    order = suffix_order(sequence + [0])
    found: list[set[int]] = [set() for _ in members]

    def compare(a: tuple[int, int] | None, b: tuple[int, int]) -> None:
        if a is not None and members[a[0]][0][a[1]:a[1] + SPAN] == members[b[0]][0][b[1]:b[1] + SPAN]:
            found[a[0]].add(a[1])
            found[b[0]].add(b[1])

    last, shared = None, []
    for r in order[1:]:
        k, i = owner[r]
        if i >= 0:
            compare(last, (k, i))
            last = (k, i)
        elif i == -1:
            shared.append(k)
    # Windows that begin inside the shared bytes are in the order of what follows these.
    for back in range(same + end):
        last = None
        for k in shared:
            i = members[k][2] - same + back
            if 0 <= i < members[k][1]:
                compare(last, (k, i))
                last = (k, i)
    return found


def _runs(windows: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    out: list[list[int]] = []
    for w in windows:
        if out and w == out[-1][1] + 1:
            out[-1][1] = w
        else:
            out.append([w, w])
    return [tuple(x) for x in out]


def _ordered(core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their anchors: repeating windows (key, first, last) of each anchor's contexts."""
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "start", "windows", "lead", "repeated", "bytes")))

        out: list[tuple[int, int, int]] = []
        schema = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for _, group in groupby(rows(), key=lambda r: r[0]):
            # Equal rows come from copies of a text.
            members = list({(r[1], r[2]): r for r in group}.values())
            if len(members) < 2:
                continue
            for m, windows in zip(members, repeated_windows([(m[6], m[3], m[4], m[5]) for m in members], core)):
                if not m[5]:
                    out += [(m[1], m[2] + a, m[2] + b) for a, b in _runs(windows)]
            if len(out) > 5000:
                yield emit()
                out = []
        if out:
            yield emit()

    return run


def _split(rows: DataFrame, core: int) -> tuple[DataFrame, int]:
    """The same windows under longer anchors: one that ends ``more`` bytes further right for windows that reach so far, one that
    begins as far to the left for the others. Equal windows stay under equal anchors."""
    more = -(-(SPAN - core) // 2)
    turn = SPAN - core - more  # most bytes before the anchor of a window that has ``more`` bytes behind it
    first = F.greatest(F.col("lead") - turn, F.lit(0))

    def part(a: Column, n: Column, lead: Column, side: str) -> Column:
        raw = F.substring("bytes", a + 1, n - 1 + SPAN)
        return F.struct((F.col("start") + a).alias("start"), n.alias("windows"), lead.alias("lead"), raw.alias("bytes"),
                        F.xxhash64(F.substring(raw, lead + 1, F.lit(core + more)), F.lit(side)).alias("anchor"))

    n = F.least(F.col("windows"), F.col("lead") - turn)
    both = F.array(part(first, F.col("windows") - first, F.col("lead") - first, "right"), part(F.lit(0), n, F.col("lead") - more, "left"))
    return rows.select("place", "key", "repeated", F.explode(both).alias("p")).where("p.windows > 0").select("place", "key", "repeated", "p.*"), core + more


def _settle(rows: DataFrame, core: int) -> list[DataFrame]:
    """Repeating windows (key, first, last) under anchors of ``core`` bytes that have more than ``MOST`` contexts."""
    out = []
    while core < SPAN and not rows.isEmpty():
        rows, core = _split(rows, core)
        rows = stage(rows.withColumn("content", F.xxhash64("bytes", "lead")), "split")
        kinds = stage(rows.groupBy("anchor", "content").agg(
            F.min("place").alias("place"), (F.max("repeated") | (F.min("place") != F.max("place"))).alias("repeated")), "kinds")
        sure = rows.where("not repeated").join(kinds.where("repeated").select("anchor", "content"), ["anchor", "content"], "left_semi")
        out.append(sure.select("key", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last")))
        several = stage(kinds.groupBy("anchor").agg(F.count("*").alias("many"), F.min("repeated").alias("all")).where("many > 1 and not all").drop("all"), "several")
        rows = stage(rows.drop("repeated").join(kinds, ["anchor", "content", "place"]).join(several, "anchor").select(*_KNOWN, "bytes"), "split")
        out.append(_order(rows.where(F.col("many") <= MOST), core))
        rows = rows.where(F.col("many") > MOST)
    return out


def _order(rows: DataFrame, core: int) -> DataFrame:
    return rows.select("anchor", "key", "start", "windows", "lead", "repeated", "bytes").repartition("anchor").sortWithinPartitions(
        "anchor").mapInArrow(_ordered(core), "key long, first int, last int")


def spans_of(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans under runs of windows (first, last), merged."""
    out: list[list[int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + SPAN)
        else:
            out.append([first, last + SPAN])
    return [tuple(x) for x in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, windows in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "windows"))):
            raw, spans = text.encode(), spans_of([(w["first"], w["last"]) for w in windows])
            kept = b"".join(raw[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(raw)]))
            rows.append((key, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2)] if rows else
                                         [pa.array([], t) for t in [pa.int64()] * 3 + [pa.string()] * 2], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])


def _repeats(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """(key, text, windows): repeating windows of the texts that occur once; copied: keys of those that do not."""
    every = texts.mapInArrow(_contexts, _CONTEXT)
    # Staged on its own, so that both sides of the join come straight from an exchange and a hot anchor can be split.
    twice = stage(every.groupBy("anchor").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y").select("anchor"), "anchors")
    # Copies give equal rows. These meet in an exchange of their own: a join that had to leave them together could not be split.
    here = stage(every.join(twice, "anchor", "left_semi").repartition("anchor", "content", "place").distinct(), "contexts")
    # A context's extent can differ between places of one content hash only if the content differs.
    kinds = here.groupBy("anchor", "content").agg(
        F.min(F.struct("place", "key", "start", "windows", "lead")).alias("rep"), (F.min("place") != F.max("place")).alias("repeated"), F.max("key").alias("any_key"))
    # A context of a copied text stands at several places, too.
    kinds = kinds.join(copied.select(F.col("key").alias("any_key"), F.lit(True).alias("copied")), "any_key", "left").select(
        "anchor", "content", "rep", (F.col("repeated") | F.col("copied").isNotNull()).alias("repeated"))
    kinds = stage(kinds, "kinds")
    # Where every context repeats as a whole, there is nothing left to find.
    several = stage(kinds.groupBy("anchor").agg(F.count("*").alias("many"), F.min("repeated").alias("all")).where("many > 1 and not all").drop("all"), "several")
    sure = here.join(kinds.where("repeated").select("anchor", "content"), ["anchor", "content"], "left_semi").select(
        "key", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1).alias("last"))
    shown = kinds.select("anchor", "rep.*", "repeated").join(several, "anchor")
    wanted = shown.groupBy("key").agg(F.collect_set(F.struct(*(c for c in _KNOWN if c != "key"))).alias("wanted"))

    keyed = texts.mapInArrow(_keyed, "key long, text string")
    candidates = stage(keyed.join(here.select("key").distinct(), "key", "left_semi"), "candidates")
    snippets = stage(candidates.join(wanted, "key").mapInArrow(_snippets, _SNIPPET), "snippets")
    found = [sure, _order(snippets.where(F.col("many") <= MOST), GRAM), *_settle(snippets.where(F.col("many") > MOST), GRAM)]
    found = stage(reduce(DataFrame.unionAll, found), "windows")
    once = found.join(copied, "key", "left_anti").groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    return candidates.join(once, "key")


def dedup(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where something is removed, the kept text."""
    texts = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    base = stage(texts.mapInArrow(_base, "doc_id long, key long, n_bytes long, sha string"), "base")
    body = texts.select("text").where(F.octet_length("text") >= SPAN)
    copied = stage(base.where(F.col("n_bytes") >= SPAN).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copied")
    cut = stage(_repeats(body, copied).mapInArrow(_cut, "key long, n_removed long, n_spans long, kept_sha256 string, kept string").dropDuplicates(["key"]), "cut")
    rows = base.join(copied.withColumn("copy", F.lit(True)), "key", "left").join(cut, "key", "left")
    gone = F.col("copy").isNotNull()
    return rows.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")
