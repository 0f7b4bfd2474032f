import random
import struct
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beamfold.llm import collocations, merkle, packing, ranks, tokens
from tests.llm import plain
from tests.llm.test_operators import docs, got, none, rows, same  # noqa: F401

PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("shards,slot_bits", [(3, 16), (2, 6)])  # with 64 slots nearly every phrase shares one
def test_collocations(docs, shards, slot_bits):  # noqa: F811
    rng = random.Random(4)
    prose = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choice(["New York", "new YORK city", "la  la\tla", "a b", "b a", "x.", "é", "Ä ä", "tick, tock"]) for _ in range(n)))
             for n in (0, 1, 2, 5, 30, 200, 900, 40)]
    spark = docs.sparkSession
    table = docs.select("lang", "text", "key", "n_words").union(spark.createDataFrame([(*r, "k", 1) for r in prose], "lang string, text string, key string, n long"))
    wanted = plain.collocations([(r.lang, r.text) for r in table.collect()], 4, 5, 40)
    assert {len(w[2].split(" ")) for w in wanted} >= {2, 3, 5} and any(w[1] == 40 for w in wanted)
    same(got(collocations.collocations(table, 4, 5, 40, shards, slot_bits), *PHRASE), wanted)
    if shards == 2:
        twice = table.union(table)
        same(got(collocations.collocations(twice, 8, 3, 10, shards), *PHRASE), plain.collocations([(r.lang, r.text) for r in twice.collect()], 8, 3, 10))
        assert collocations.collocations(table.limit(0), shards=2, longest=2).count() == 0
        with pytest.raises(ValueError):
            collocations.count_phrases(table, shards=60)


def test_scores_pass_64_bits(spark):
    big = spark.createDataFrame([(10**11, 10**13, 10**6, 3)], "a long, n long, l long, r long")
    c = lambda x: f"cast({x} as decimal(16,0))"
    row = big.selectExpr(f"(cast(1000 as decimal(4,0)) * {c('a')} * {c('n')}) div ({c('l')} * {c('r')} * cast(1000000 as decimal(7,0))) as s").first()
    assert row.s == 1000 * 10**11 * 10**13 // (10**6 * 3 * 10**6)


def test_proofs(docs, none, spark):  # noqa: F811
    full = docs.select("doc_id", "source", "lang", "n_chars", "text", "key", F.lit(1).alias("tree"), F.lit(2).alias("place"))
    many = spark.range(700).select("id", F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))), F.lit("en"), F.lit(None).cast("long"), F.concat(F.lit("Text "), "id"), F.lit("k"), F.lit(1), F.lit(2))
    some = full.where("doc_id < 20")
    cases = [full, full.unionAll(many), many.toDF(*full.columns), some.unionAll(some).withColumn("doc_id", F.lit(None).cast("long")), full.limit(1), full.where("source is null").limit(17), none]
    for case in cases:
        table = [tuple(r) for r in case.select(*merkle.COLUMNS).collect()]
        wanted = plain.merkle(table)
        same(got(merkle.manifest(case), *PROOF), wanted)
    assert any(not w[-1] for w in plain.merkle([tuple(r) for r in many.toDF(*full.columns).select(*merkle.COLUMNS).collect()]))


def test_places_within_groups_over_many_tasks(spark):
    df = spark.range(500).selectExpr("if(id % 3 = 0, 'a', concat('g', id % 7)) g", "cast(id div 2 as long) v")
    wanted, count = [], defaultdict(int)
    for g, v in sorted((r.g, r.v) for r in df.collect()):
        wanted.append((g, v, count[g]))
        count[g] += 1
    same(got(ranks.places(df.repartition(9), "g", ["v"], "t"), "g", "v", "place"), wanted)


def test_sum_of_squares_places_like_the_plain_rule():
    rng = random.Random(1)
    for length in (8, 16, 50):
        sizes = [rng.randint(1, length - 1) for _ in range(300)]
        packer = packing.Packer(length)
        for size, level in zip(sizes, plain.sum_of_squares(sizes, length)):
            assert packer.level(size) == level
            packer.add(size, bytes(4 * size))
        packer.close()
        filled = [sum(len(p[3]) for p in w) // 4 for w in packer.full]
        assert sum(filled) == sum(sizes) and all(n == length or n & (n - 1) == 0 for n in filled)
        assert sum(n != length for n in filled) <= length.bit_length()


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(docs, rows, none, spark, tmp_path, length):  # noqa: F811
    path = tokens.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    packing.write(docs.unionAll(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))), path, str(tmp_path / "p"), length)
    pieces = packing.read_pieces(spark, str(tmp_path / "p")).withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids) and p.crc == zlib.crc32(p.ids)
    for i, text in [*rows, (None, rows[3][1])]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and {p.doc_tokens for p in own} == {len(ids)}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        n = sum(p.length for p in own)
        assert n == length or n < length and n & (n - 1) == 0
    packing.write(none, path, str(tmp_path / "e"), length)
    assert packing.read_pieces(spark, str(tmp_path / "e")).count() == 0
