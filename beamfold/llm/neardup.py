"""MinHash near-dedup with sequential Bayesian verification.

A text's set holds the hashes of its word shingles. Equal sets form one class (64-bit set hash). Signatures of min-hashes are
cut into bands; classes that share a band meet in a bucket. Candidate pairs compare their signatures batch by batch; after
each batch, a pair goes as soon as the posterior probability (uniform prior) that its similarity reaches the threshold is
below ``miss``. Survivors are verified on their full sets. Components of the verified links give the groups.

Buckets never emit all pairs of a large group. First every entry of a bucket meets only the smallest one, which joins close
copies into components. Of the buckets that still span components, those of at most ``SMALL`` entries give their pairs of
different components as rows. Larger ones are cut into blocks of bounded size whose tiles are compared inside tasks, first on
signatures, then on full sets; a tile gives a spanning forest of its components only, so what comes out grows with the
entries. No pair of different components in a bucket is left out.

Defined cases: a null or empty text or one without words has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; rows are told apart by a number, so a doc_id may repeat or be null. Of a group ``unique`` leaves exactly
one row, that of the smallest doc_id (null last), then of the smallest row hash; ``groups`` has doc_ids only, so equal rows of one
doc_id both show as kept. An empty table gives no rows; other columns are kept by ``unique`` and ignored by ``groups``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from beamfold.llm import words as W
from beamfold.llm.catalog import column, query, table
from beamfold.llm.components import components
from beamfold.session import stage


SMALL, BLOCK_SETS, BLOCK_SHINGLES = 24, 512, 400_000


@dataclass(frozen=True)
class Rule:
    """Shingle length, similarity num / den, and the chances of a miss by the bands and by each look of the verification."""
    words: int = 5
    num: int = 80
    den: int = 100
    band_rows: int = 6
    band_miss: float = 1e-5
    miss: float = 1e-6
    batch: int = 24

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log1p(-(self.num / self.den) ** self.band_rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows


def shingle_sets(block: W.Block, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = W.words(block, W.NOT_SPACE)
    gram, at = W.grams(w, n)
    counts = np.maximum(w.counts - n + 1, 0)
    ends = np.cumsum(counts)
    short = {}
    for k in range(1, n):
        if ((w.counts == k)).any():
            h, i = W.grams(w, k)
            short |= {int(t): h[j:j + 1] for j, t in enumerate(w.text[i]) if w.counts[t] == k}
    return [short[r] if r in short else np.unique(gram[ends[r] - counts[r]:ends[r]]) for r in range(block.rows)]


def set_key(u: np.ndarray) -> int:
    return int(W.mix(np.array([W.mix(u).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)).view(np.int64)[0])


def signature(u: np.ndarray, factors: np.ndarray) -> bytes:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), 1024):
        np.minimum(low, np.multiply.outer(factors, u[i:i + 1024]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4").tobytes()


def _sign(rule: Rule, full: bool):
    """row, tie, doc_id, n_shingles, key, signature; or, if full, key, signature and the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = W.series(3, rule.hashes) | np.uint64(1)
        for batch in batches:
            for block in W.blocks(batch.column("text")):  # a block at a time: the sets are larger than the texts
                sets = shingle_sets(block, rule.words)
                signs = pa.array([signature(u, factors) if len(u) else None for u in sets], pa.binary())
                keys = pa.array([set_key(u) for u in sets], pa.int64())
                if full:
                    yield pa.RecordBatch.from_arrays([keys, signs, pa.array([u.astype("<u8").tobytes() for u in sets], pa.binary())], ["key", "signature", "shingles"])
                else:
                    ids = [batch.column(c).slice(block.first, block.rows) for c in ("row", "tie", "doc_id")]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([len(u) for u in sets], pa.int64()), keys, signs], ["row", "tie", "doc_id", "n_shingles", "key", "signature"])

    return run


@cache
def _least_matches(looks: tuple[int, ...], t: float, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes, the fewest matches at which P(similarity >= t) is at least miss: a posterior
    Beta(m + 1, n - m + 1) lies above t with the probability that a binomial (n + 1, t) is at most m."""
    out = []
    for n in looks:
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _looks(rule: Rule) -> tuple[tuple[int, ...], tuple[int, ...]]:
    looks = tuple(range(rule.batch, rule.hashes, rule.batch)) + (rule.hashes,)
    return looks, _least_matches(looks, rule.num / rule.den, rule.miss)


def _plausible(x: np.ndarray, y: np.ndarray, rule: Rule) -> np.ndarray:
    """Places of the signature pairs (rows of x and y) that no look rules out."""
    live, matches, at = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in zip(*_looks(rule)):
        matches += (x[live, at:n] == y[live, at:n]).sum(1)
        keep = matches >= least
        live, matches, at = live[keep], matches[keep], n
    return live


def _bayes(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, rule.hashes) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).take(pa.array(_plausible(x, y, rule)))

    return run


def _exact(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                links.append(rule.den * both >= rule.num * (len(x) // 8 + len(y) // 8 - both))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The links among pairs (a, b) of keys; only pairs that pass the sequential test meet on their full sets."""
    def beside(p: DataFrame, column: str, *names: str) -> DataFrame:
        for side, name in zip("ab", names):
            p = p.join(sets.select(F.col("key").alias(side), F.col(column).alias(name)), side)
        return p.select("a", "b", *names)

    looked = stage(beside(pairs, "signature", "sa", "sb").mapInArrow(_bayes(rule), "a long, b long"), "looked")
    return stage(beside(looked, "shingles", "xa", "xb").mapInArrow(_exact(rule), "a long, b long"), "verified")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by incidence matrices over a bounded number of shingles at a time."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = [np.concatenate(x) for x in (a, b)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    both = np.intersect1d(*flat)
    place = []
    for f, o in zip(flat, owner):
        at = np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0))
        known = both[at] == f if len(both) else np.zeros(len(f), bool)
        order = np.argsort(at[known], kind="stable")
        place.append((at[known][order], o[known][order]))
    for start in range(0, len(both), columns):
        m = []
        for (at, o), x in zip(place, (a, b)):
            i, j = np.searchsorted(at, [start, start + columns])
            dense = np.zeros((len(x), columns), np.float32)
            dense[o[i:j], at[i:j] - start] = 1
            m.append(dense)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _tile(rule: Rule):
    """Links between two blocks of a bucket, as a spanning forest of the tile's components."""
    import pandas as pd

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        factors = W.series(3, rule.hashes) | np.uint64(1)
        # Entries of one component stand for each other: a link inside it says nothing new.
        keys, comps = tile["key"].to_numpy(), tile["comp"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in tile["shingles"]]
        signs = np.stack([np.frombuffer(signature(x, factors), "<u4") for x in sets])
        ends = tile["side"].to_numpy()
        left, right = (np.flatnonzero(ends == 0), np.flatnonzero(ends == 1)) if (ends == 1).any() else (np.arange(len(ends)), np.arange(len(ends)))
        found: list[tuple[int, int]] = []
        root = {c: c for c in comps.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        size = np.array([len(x) for x in sets])
        both = None
        for i, k in enumerate(left):
            others = right[comps[right] != comps[k]]
            others = others[_plausible(np.broadcast_to(signs[k], (len(others), rule.hashes)), signs[others], rule)]
            if not len(others):
                continue
            both = shared_counts([sets[x] for x in left], [sets[x] for x in right]) if both is None else both
            meet = both[i][np.searchsorted(right, others)]
            for o in others[rule.den * meet >= rule.num * (size[k] + size[others] - meet)].tolist():
                x, y = top(int(comps[k])), top(int(comps[o]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append((int(keys[k]), int(keys[o])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _with_comp(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links; only links between components are looked at."""
    at = links
    for side in "ab":
        at = at.join(labels.select(F.col("key").alias(side), F.col("comp").alias(f"c{side}")), side, "left")
    moved = components(at.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    onto = moved.select(F.col("key").alias("comp"), F.col("comp").alias("to"))
    old = labels.join(onto, "comp", "left").select("key", F.coalesce("to", "comp").alias("comp"))
    return stage(old.unionAll(moved.join(labels, "key", "left_anti")), "components")


def _links(entries: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Components (key, comp) of all links between entries (band, key) that share a band."""
    # Each entry against the smallest of its bucket: this settles the buckets of close copies in one pass.
    least = entries.groupBy("band").agg(F.min("key").alias("a"))
    stars = entries.join(least, "band").where("key <> a").select("a", F.col("key").alias("b")).distinct()
    labels = components(verified(stars, sets, rule))

    # Buckets that still span components: all pairs of different components, in small buckets as rows, in large ones by tiles.
    sizes = sets.select("key", (F.octet_length("shingles") / 8).cast("long").alias("n")).dropDuplicates(["key"])
    state = _with_comp(entries, labels)
    spans = state.join(sizes, "key").groupBy("band").agg(
        F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.sum("n").alias("n")).where("x <> y")
    state = stage(state.join(spans.select("band", "m", "n"), "band"), "open")
    small = state.where(F.col("m") <= SMALL).select("band", "key", "comp")
    other = small.select("band", F.col("key").alias("b"), F.col("comp").alias("cb"))
    pairs = small.join(other, "band").where("key < b and comp <> cb").select(F.col("key").alias("a"), "b").distinct()
    labels = _merged(labels, verified(pairs, sets, rule))

    # A large bucket is cut into blocks of bounded size; a tile holds two of them, so an entry goes to as many tiles as there are blocks.
    large = _with_comp(state.where(F.col("m") > SMALL).select("band", "key", "m", "n"), labels)
    still = large.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("band")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    cut = large.join(still, "band", "left_semi").withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    tiles = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "key", "comp", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), (F.col("i") > F.col("j")).cast("int").alias("side"))
    links = tiles.join(sets.select("key", "shingles"), "key").groupBy("band", "p", "q").applyInPandas(_tile(rule), "a long, b long")
    return _merged(labels, stage(links.distinct(), "tiles"))


def _decided(texts: DataFrame, rule: Rule) -> DataFrame:
    """texts: (row, tie, doc_id, text), written. Each row's doc_id, n_shingles, component_id and stands: it stands for its group."""
    signed = stage(texts.mapInArrow(_sign(rule, False), "row long, tie long, doc_id long, n_shingles long, key long, signature binary"), "signed")
    width = 4 * rule.band_rows
    rows = signed.where("signature is not null").select("key", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(rule.bands - 1)),
        lambda b: F.xxhash64(b, F.substr("signature", b * width + 1, F.lit(width))))).alias("band"))
    shared = rows.groupBy("band").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("band")
    state = stage(rows.join(shared, "band", "left_semi").distinct(), "entries")

    classes = signed.where("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "tie", "row")).alias("first"))
    wanted = classes.join(state.select("key").distinct(), "key", "left_semi").select("first.row")
    sets = stage(texts.join(wanted, "row", "left_semi").mapInArrow(_sign(rule, True), "key long, signature binary, shingles binary").where("signature is not null"), "sets")
    lead = _with_comp(classes, _links(state, sets, rule))
    top = lead.groupBy("comp").agg(F.min("first").alias("top"))
    named = lead.join(top, "comp").select("key", F.col("top.doc_id").alias("component_id"), F.col("top.row").alias("top"))
    found = signed.select("row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    return found.select("row", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                        (F.col("key").isNull() | (F.col("row") == F.col("top"))).alias("stands"))


def groups(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of the group) and kept (it is that document)."""
    texts = documents.selectExpr("monotonically_increasing_id() row", "xxhash64(text) tie", "cast(doc_id as long) doc_id", "text")
    return _decided(stage(texts, "numbered"), rule).drop("row", "stands").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without those that another one stands for, all their columns."""
    plain = [column(f.name) for f in documents.schema if isinstance(f.dataType, T.AtomicType)]
    number = "row"
    while number in documents.columns:
        number += "_"
    numbered = stage(documents.withColumn(number, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(number).alias("row"), F.xxhash64(*plain).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = _decided(texts, rule).where("not stands").select(F.col("row").alias(number))
    return numbered.join(stage(gone, "gone"), number, "left_anti").select(*map(column, documents.columns))


@query("op1_minhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), Rule(words=3, num=85))
