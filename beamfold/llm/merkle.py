"""Merkle manifest of a table: leaf, subroot per source, root, and for every row a proof that folds back to the root.

H is lowercase hex sha256 over concatenated inputs, digests as hex text. A leaf is H over the five columns of a row, each ``-``
if null, else its UTF-8 byte count, ``:`` and its value. Leaves of a source ascend by doc_id (null first, then by leaf); while
several nodes remain, every 16 consecutive ones become their H. Subroots, ordered by source (null first), give the root
likewise. Inside this module digests are 32 bytes, and a node's children stand side by side in one binary, its ``run``.

Proofs come from pointer jumping. Every inner node points to its parent and holds one segment step: its place among the parent's
children and their run. A self-join gives each node its ancestor's pointer and appends the ancestor's steps, so that the distance
doubles, until every pointer has passed the root. Leaves take the path of their parent in one last join: 16 leaves share it, so
the jumps move a sixteenth of the rows. At distance d up to 16**d nodes share an ancestor; ancestors are repeated under salts
(``_salts``), so that no key has more than 16 of them until 4096 salts are in use.

Null columns are defined above; a null text stays null when tampered with. Repeated rows have equal leaves, each with a place of
its own. A lone leaf is its source's subroot, a lone subroot the root; without siblings a proof is H of nothing. Columns beside
the five are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.llm.catalog import query, table
from beamfold.llm.ranks import places
from beamfold.session import stage

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A source's key is "" for null, else "=" and the source, which keeps the order of bytes; the tree over the subroots has its own.
TOP = "^"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(text: str | Column = "text") -> Column:
    """Digest of a row; ``text`` may stand in for its text."""
    return _digest(F.concat(*(_field(F.col(c)) for c in COLUMNS[:-1]), _field(F.col(text) if isinstance(text, str) else text)))


def tampered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _siblings(step: Column) -> Column:
    """Digests of a step's run without the node's own."""
    run, at = step["run"], step["pos"] * 32
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 33, F.lit(32 * FAN)))


def _folded(digest: Column, step: Column) -> Column:
    """Digest of the parent, if this digest stood at the step's place."""
    run, at = step["run"], step["pos"] * 32
    return _digest(_hex(F.concat(F.substring(run, F.lit(1), at), digest, F.substring(run, at + 33, F.lit(32 * FAN)))))


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Levels of every tree above ``nodes`` (tree, place, digest): tables of (tree, level, place, run, digest), each with a
    sixteenth of the rows below. A tree ends where one node remains."""
    out: list[DataFrame] = []
    most = nodes.agg(F.max("place")).first()[0] or 0
    while most:
        below, most = out[-1] if out else nodes, most // FAN
        children = F.sort_array(F.collect_list(F.struct("place", "digest")))
        run = F.aggregate("children", F.unhex(F.lit("")), lambda a, c: F.concat(a, c["digest"]))
        level = below.groupBy("tree", F.expr(f"place div {FAN}").alias("parent")).agg(children.alias("children")).where(
            "parent > 0 or size(children) > 1").select("tree", F.lit(len(out) + 1).alias("level"), F.col("parent").alias("place"), run.alias("run"))
        out.append(stage(level.withColumn("digest", _digest(_hex(F.col("run")))), name))
    return out


def _step(pos: str, top: bool) -> Column:
    return F.array(F.struct(F.expr(pos).cast("int").alias("pos"), "run", F.lit(top).alias("top")))


def _inner_steps(levels: list[DataFrame], top: bool) -> list[DataFrame]:
    """Nodes of all levels but the last, each with its parent and the step to it; leaves are left out."""
    return [
        parents.withColumn("pos", F.explode(F.expr("sequence(0, length(run) div 32 - 1)"))).select(
            "tree", (F.col("level") - 1).alias("level"), F.expr(f"place * {FAN} + pos").alias("place"),
            F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"), _step("pos", top).alias("steps"))
        for parents in levels[1:]]


def _salts(distance: int) -> int:
    """Salts for a join over this distance; with them an ancestor has at most 16 nodes a key, until 4096 are in use."""
    return min(FAN ** (distance - 1), 4096)


def _jump(nodes: DataFrame, distance: int) -> DataFrame:
    """Every node takes over its ancestor's pointer, and the steps from there on."""
    n = _salts(distance)
    done = nodes.where("up_level is null")
    mine = nodes.where("up_level is not null").withColumn("salt", F.pmod(F.hash("tree", "place"), F.lit(n)))
    # Only what has nodes that far below it is repeated under every salt.
    above = nodes.where((F.col("tree") == TOP) | (F.col("level") > distance))
    above = above.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.struct(
        "up_tree", "up_level", "up_place", "steps").alias("on"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"))
    joined = mine.join(above, ["up_tree", "up_level", "up_place", "salt"]).select(
        "tree", "level", "place", "on.up_tree", "on.up_level", "on.up_place", F.concat("steps", "on.steps").alias("steps"))
    return stage(joined.unionByName(done), "jumps")


def proofs(documents: DataFrame) -> DataFrame:
    """(doc_id, source, digest, changed, subroot, root, steps, siblings): the proof of every row, as steps of (pos, run, top) from its
    leaf to the root and as the hex text of all siblings; ``changed`` is the digest of the row as tampered with, if it is."""
    return _folding(documents).select("doc_id", "source", "digest", "changed", "subroot", "root", "steps", "siblings")


def _folding(documents: DataFrame) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = stage(documents.select("doc_id", "source", key.alias("tree"), leaf().alias("digest"), F.when(hit, leaf(tampered(F.col("text")))).alias("changed")), "leaves")
    leaves = places(leaves, "tree", ["doc_id", "digest"], "leaves")
    levels = _levels(leaves, "levels")

    zeros = [t.where("place = 0").select("tree", F.lit(k).alias("level"), "digest") for k, t in enumerate([leaves, *levels])]
    subroots = zeros[0]
    for z in zeros[1:]:
        subroots = subroots.unionAll(z)
    subroots = subroots.groupBy("tree").agg(F.max_by(F.struct("level", "digest"), "level").alias("s")).select("tree", "s.*", F.lit(TOP).alias("all"))
    subroots = stage(places(subroots, "all", ["tree"], "subroots"), "subroots")
    tops = _levels(subroots.select(F.col("all").alias("tree"), "place", "digest"), "tops")

    if tops:
        first = tops[0].select("run", F.col("place").alias("up_place"))
        ends = subroots.withColumn("up_place", F.expr(f"place div {FAN}")).join(first, "up_place").select(
            "tree", "level", F.lit(0).cast("long").alias("place"), F.lit(TOP).alias("up_tree"), F.lit(1).alias("up_level"), "up_place", _step(f"place % {FAN}", True).alias("steps"))
        root = tops[-1].select("tree", "level", "place")
    else:
        ends, root = None, subroots.select("tree", "level", F.lit(0).cast("long").alias("place"))
    steps = "array<struct<pos:int,run:binary,top:boolean>>"
    nodes = root.select("tree", "level", "place", F.lit(None).cast("string").alias("up_tree"), F.lit(None).cast("int").alias("up_level"),
                        F.lit(None).cast("long").alias("up_place"), F.array().cast(steps).alias("steps"))
    for more in [*_inner_steps(levels, False), *([ends] if ends is not None else []), *_inner_steps(tops, True)]:
        nodes = nodes.unionByName(more)
    nodes, distance, height = stage(nodes, "jumps"), 1, max(len(levels) - 1, 0) + len(tops)
    while distance < height:
        nodes, distance = _jump(nodes, distance), 2 * distance

    # A lone leaf is a node itself; any other leaf hangs below a node of level 1.
    own = levels[0].select("tree", F.col("place").alias("parent"), "run").join(
        nodes.where("level = 1").select("tree", F.col("place").alias("parent"), "steps"), ["tree", "parent"]) if levels else None
    lone = nodes.where(f"level = 0 and tree <> '{TOP}'").select("tree", F.col("place").alias("parent"), F.lit(None).cast("binary").alias("run"), "steps")
    paths = lone if own is None else own.unionByName(lone)
    last = F.coalesce(F.try_element_at("steps", F.lit(-1))["run"], F.col("run"))
    crossing = F.try_element_at(F.filter("steps", lambda s: s["top"]), F.lit(1))
    paths = paths.select(
        "tree", "parent", "run", "steps", _digest(_hex(last)).alias("root_"),
        F.substring(crossing["run"], crossing["pos"] * 32 + 1, F.lit(32)).alias("subroot_"),
        F.array_join(F.transform("steps", lambda s: _hex(_siblings(s))), "").alias("rest"))
    found = leaves.withColumn("parent", F.expr(f"place div {FAN}")).join(paths, ["tree", "parent"])
    step = F.struct((F.col("place") % FAN).cast("int").alias("pos"), "run", F.lit(False).alias("top"))
    found = found.withColumn("steps", F.when(F.col("run").isNull(), F.col("steps")).otherwise(F.concat(F.array(step), "steps")))
    own_hex = F.when(F.col("run").isNull(), F.lit("")).otherwise(_hex(_siblings(step)))
    root = F.coalesce("root_", "digest")
    return found.withColumns({"root": root, "subroot": F.coalesce("subroot_", root), "siblings": F.concat(own_hex, "rest")})


def manifest(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    folded = _hex(F.aggregate("steps", F.coalesce("changed", "digest"), _folded))
    root = _hex(F.col("root"))
    return proofs(documents).select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2("siblings", 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(depth: int = 7) -> str:
    """The manifest in SQL, for trees of at most FAN**depth leaves."""
    table = [0] * 256
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 * (c & 1))
        table[b] = c
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    head = " || ".join(field(c) for c in COLUMNS[:-1])
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: xor(a >> 8, CAST(table_[(xor(a, b) & 255) + 1] AS BIGINT))))"""
    ctes = [
        f"crc AS (SELECT {table} AS table_)",
        f"""rows_ AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({head} || {field('text')}) AS leaf,
      CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(lower)}) END AS changed FROM documents, crc)""",
        """s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, leaf AS digest FROM rows_)"""]

    def levels(prefix: str, key: str) -> None:
        """A tree with one node left goes on as it is."""
        for k in range(depth + 1):
            ctes.append(f"{prefix}n{k} AS (SELECT *, max(place) OVER (PARTITION BY {key}) AS most FROM {prefix}{k})")
            ctes.append(f"""{prefix}{k + 1} AS (SELECT {key}, place // {FAN} AS place,
      CASE WHEN max(most) = 0 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM {prefix}n{k} GROUP BY {key}, place // {FAN})""")

    levels("s", "source")
    ctes.append(f"t0 AS (SELECT 1 AS top, source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM s{depth})")
    levels("t", "top")
    # Siblings before and after each row, level by level.
    ctes.append("""path0 AS (SELECT s0.id, s0.doc_id, s0.source, s0.leaf, coalesce(s0.changed, s0.leaf) AS folded, s0.place AS pos, t0.place AS top_pos, t0.digest AS subroot, '' AS proof
      FROM s0 JOIN t0 ON s0.source IS NOT DISTINCT FROM t0.source)""")
    step = 0
    for prefix, same, pos in (("s", "p.source IS NOT DISTINCT FROM n.source", "pos"), ("t", "true", "top_pos")):
        for k in range(depth):
            ctes.append(f"""near{step} AS (SELECT p.id, max(n.most) AS most, coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place < p.{pos}), '') AS l,
      coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place > p.{pos}), '') AS r
      FROM path{step} p JOIN {prefix}n{k} n ON {same} AND n.place // {FAN} = p.{pos} // {FAN} GROUP BY p.id)""")
            ctes.append(f"""path{step + 1} AS (SELECT p.* REPLACE (p.{pos} // {FAN} AS {pos}, p.proof || n.l || n.r AS proof,
      CASE WHEN n.most = 0 THEN p.folded ELSE sha256(n.l || p.folded || n.r) END AS folded) FROM path{step} p JOIN near{step} n USING (id))""")
            step += 1
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM path{step}, (SELECT digest AS root FROM t{depth})"""


@query("op12_merkle_manifest", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
