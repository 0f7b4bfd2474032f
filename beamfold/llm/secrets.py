"""Secret scans with multipart credential linking, in DataFrame functions only.

Exact kinds: ``assign`` (a named value), ``access`` (an access key identifier), ``hex`` (a long hexadecimal run). They are
always reported. Weak kinds are reported only when their counterparts stand in the same scope, ``SCOPE`` code points around
their start: a ``user`` needs a secret (assign, hex or token), a bare ``token`` an identifier (access or user), an
``endpoint`` both.

Positions come from what stands between the matches: the lengths of the gaps and matches, summed in order. The scope is an
interval join: parts are summed up per text, class and cell of SCOPE code points (smallest and largest start), and each weak
part looks at three cells, so that a text full of parts costs no pairs. Parts depend on the text alone, so equal texts are
linked once. Nothing but lengths and positions is written on the way; a text's matches are the only rows of one group.

Defined cases: a null or empty text has no matches (empty string of spans); equal rows each get a row; other columns are
kept by ``redacted`` and ignored by ``scan``; an empty table gives no rows. Spans are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beamfold.llm.catalog import column, query, table
from beamfold.session import stage

SCOPE = 200
MASK = "[REDACTED]"

# Patterns of the exact kinds. Letters of the names match in either case.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"

USER = r"""(?i:user_?name|user|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
TOKEN = r"[A-Za-z0-9+/]+"
ENDPOINT = r"https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+(?::[0-9]+)?|[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]+"

#: Kind, pattern, group that must have the least length, least length, class (I identifier, S secret, E endpoint), weak.
KINDS = (("assign", ASSIGN, 1, 6, "S", False), ("access", ACCESS, 0, 20, "I", False), ("hex", HEX, 0, 24, "S", False),
         ("user", USER, 1, 3, "I", True), ("token", TOKEN, 0, 40, "S", True), ("endpoint", ENDPOINT, 0, 7, "E", True))
#: Classes a weak kind needs beside it.
NEEDS = {"user": ("S",), "token": ("I",), "endpoint": ("I", "S")}


def _least(pattern: str, group: int, least: int) -> str:
    """The pattern with its open end replaced by a least length: cheap to test before places are worked out."""
    if group:
        return pattern[:-2] + "{%d,})" % least
    return pattern[:-1] + "{%d,}" % (least - pattern.index("["))  # what stands before the class counts, too


#: Texts without any of these hold no exact kind and no secret or identifier, so nothing to report.
ANCHOR = "|".join(_least(p, g, n) for k, p, g, n, c, _ in KINDS if c != "E")


def _matches(text: Column, number: int) -> Column:
    """(kind number, gaps, lengths, good) of one kind: all leftmost matches, good or not, so that places add up."""
    kind, pattern, group, least, _, _ = KINDS[number]
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.transform(judged, lambda x: F.length(x) >= least)
    if kind == "token":
        good = F.transform(judged, lambda x: (F.length(x) >= least) & x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]"))
    here = text.rlike(_least(pattern, group, least) if kind != "endpoint" else pattern)
    return F.when(here, F.struct(F.lit(number).alias("kind"), lengths(F.split(text, pattern, -1)).alias("gaps"), lengths(whole).alias("lengths"), good.alias("good")))


def _read(texts: DataFrame) -> DataFrame:
    """(doc_id, key, found): key is the text's hash where it has an anchor, else null."""
    text = F.coalesce("text", F.lit(""))
    marked = texts.select("doc_id", text.alias("text")).withColumn("anchored", text.rlike(ANCHOR))
    found = F.filter(F.array(*(_matches(F.col("text"), k) for k in range(len(KINDS)))), lambda m: m.isNotNull())
    return marked.select("doc_id", F.when(F.col("anchored"), F.md5("text")).alias("key"), F.when(F.col("anchored"), found).alias("found"))


def _parts(read: DataFrame) -> DataFrame:
    """(key, kind, start, end) of every good match of each distinct text."""
    once = read.where("key is not null").groupBy("key").agg(F.first("found").alias("found"))
    each = once.select("key", F.explode("found").alias("m")).select("key", "m.kind", F.posexplode(F.arrays_zip("m.gaps", "m.lengths", "m.good")).alias("i", "x"))
    so_far = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("key", "kind", "x.lengths", "x.good", F.sum(F.col("x.gaps") + F.coalesce("x.lengths", F.lit(0))).over(so_far).alias("end"))
    return placed.where("good").select("key", "kind", (F.col("end") - F.col("lengths")).alias("start"), "end")


def _pick(kind: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), kind + 1)


def _reported(parts: DataFrame, scope: int) -> DataFrame:
    """Exact parts, and the weak ones whose counterparts stand within the scope."""
    classed = parts.withColumns({"class": _pick(F.col("kind"), [k[4] for k in KINDS]), "weak": _pick(F.col("kind"), [k[5] for k in KINDS])})
    cell = F.floor(F.col("start") / scope)
    cells = classed.where("class <> 'E'").groupBy("key", "class", cell.alias("c")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    sides = cells.select("key", F.col("class").alias("other"), "low", "high", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("cell"))
    weak = classed.where("weak").select("key", "kind", "start", "end", cell.alias("cell"))
    near = weak.join(sides, ["key", "cell"]).where((F.col("high") >= F.col("start") - scope) & (F.col("low") <= F.col("start") + scope))
    beside = near.groupBy("key", "kind", "start", "end").agg(F.max(F.col("other") == "I").alias("i"), F.max(F.col("other") == "S").alias("s"))
    met = F.lit(False)
    for number, (kind, *_) in enumerate(KINDS):
        if kind in NEEDS:
            need = F.col("kind") == number
            for c in NEEDS[kind]:
                need &= F.col(c.lower())
            met |= need
    return classed.where("not weak").select("key", "kind", "start", "end").unionAll(beside.where(met).select("key", "kind", "start", "end"))


def _per_text(spans: DataFrame) -> DataFrame:
    """Per key the sorted spans (start, kind, end, covered: where everything before it ends)."""
    before = Window.partitionBy("key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    each = spans.withColumn("covered", F.coalesce(F.max("end").over(before), F.lit(0)))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "covered"))).alias("spans"))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", _pick(s["kind"], [k[0] for k in KINDS]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id and ``spans``, an array of (start, kind number, end, covered), null where there are none."""
    read = stage(_read(documents.selectExpr("cast(doc_id as long) doc_id", "text")), "parts")
    found = _per_text(_reported(_parts(read), scope))
    some = read.where("key is not null").select("doc_id", "key").join(found, "key", "left").select("doc_id", "spans")
    return read.where("key is null").select("doc_id", F.lit(None).cast(some.schema["spans"].dataType).alias("spans")).unionAll(some)


def redacted(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The documents, every reported span replaced by ``MASK``; n_chars, if there is one, follows. Texts without an anchor are not shuffled."""
    text = F.coalesce("text", F.lit(""))
    found = stage(_per_text(_reported(_parts(stage(_read(documents.selectExpr("cast(doc_id as long) doc_id", "text")), "parts")), scope)), "spans")
    rows = documents.select(F.struct(*map(column, documents.columns)).alias("_row"), text.rlike(ANCHOR).alias("_anchored"), text.alias("_text"))
    hit = rows.where("_anchored").withColumn("key", F.md5("_text")).join(found, "key", "left")
    pieces = F.transform("spans", lambda s: F.when(s["start"] >= s["covered"], F.concat(
        F.substr("_text", (s["covered"] + 1).cast("int"), (s["start"] - s["covered"]).cast("int")), F.lit(MASK))).otherwise(F.lit("")))
    rest = F.substr("_text", (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.length("_text"))
    new = F.when(F.col("spans").isNull(), F.col("_row.text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    row = F.col("_row").withField("text", new)
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.when(F.col("spans").isNull(), F.col("_row.n_chars")).otherwise(F.length(new).cast(documents.schema["n_chars"].dataType)))
    return rows.where("not _anchored").select("_row.*").unionAll(hit.select(row.alias("_row")).select("_row.*"))


def digests(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    found = scan(documents, scope).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,covered:bigint>>")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(3)),
        F.sha2(_named(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def _plain(pattern: str) -> str:
    """The pattern without the inline flag: each letter of the names as a class of both cases."""
    names, tail = pattern[4:].split(")", 1)
    return "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names) + ")" + tail


def _sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = []
    for number, (kind, pattern, group, least, cls, weak) in enumerate(KINDS):
        p = quote(_plain(pattern) if pattern.startswith("(?i:") else pattern)
        good = f"length(v) >= {least}" + (" AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')" if kind == "token" else "")
        kinds.append(
            f"SELECT k, {number} AS kind, '{cls}' AS cls, {weak} AS weak, i, length(g) AS gap, length(h) AS len, {good} AS good FROM (SELECT k, unnest(h) AS h, unnest(v) AS v, unnest(g[1:len(h)]) AS g, generate_subscripts(h, 1) AS i "
            f"FROM (SELECT k, regexp_extract_all(text, {p}) AS h, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS g FROM d))")
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(kinds)}),
p AS (SELECT * FROM (SELECT k, kind, cls, weak, good, sum(gap + len) OVER (PARTITION BY k, kind ORDER BY i) - len AS s, sum(gap + len) OVER (PARTITION BY k, kind ORDER BY i) AS e FROM m) WHERE good),
r AS (SELECT k, kind, s, e FROM p WHERE NOT weak UNION ALL
  SELECT k, kind, s, e FROM p w WHERE weak
    AND (kind NOT IN (3, 5) OR EXISTS (SELECT 1 FROM p o WHERE o.k = w.k AND o.cls = 'S' AND abs(o.s - w.s) <= {SCOPE}))
    AND (kind NOT IN (4, 5) OR EXISTS (SELECT 1 FROM p o WHERE o.k = w.k AND o.cls = 'I' AND abs(o.s - w.s) <= {SCOPE}))),
n AS (SELECT k, kind, s, e, {names}[kind + 1] || ':' || s || ':' || e AS t FROM r),
a AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(t, ',' ORDER BY s, kind, e) AS spans FROM n GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (k)
"""


@query("op5_secret_scans", _sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
