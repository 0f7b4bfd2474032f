"""Chat formatting: tool calls linked to their results, put in order of dependence, validated, written as canonical JSON.

Calls (call_id, conv_id, turn, name, arguments, after) and results (call_id, turn, content) meet in a hash join by identifier. A call
may name one other call it comes after; its depth is the number of calls before it, found by doubling: each round a call takes
over the ancestor of its ancestor, so a chain of n calls takes log2(n) rounds and no conversation is gathered in one task.
Arguments are checked against a schema per tool (type, required, minimum, maximum, minLength, maxLength, enum, no other
keys). The JSON has sorted keys, no spaces and plain letters.

Defined cases, by status: ``ok``; ``no_result``; ``orphan_result`` (a result without a call, depth null); ``bad_json`` (arguments
that are no object, or that JSON does not define or text cannot hold: a repeated key, NaN or an infinite number, half of a surrogate
pair, more levels than the parser takes, a number of more digits than it takes); ``message`` (a turn that is neither, as it is);
``unknown_tool``; ``invalid`` (with the reasons in ``problems``); ``missing_dependency`` (depth 0); ``cycle`` (depth null). The
first that applies of cycle, missing_dependency, bad_json, unknown_tool, invalid, no_result counts. ``links`` gives a row for
every distinct call with every distinct result of its identifier, so nothing but wholly equal rows is merged and ``repeats`` is
0; what comes after an identifier of several calls counts the calls before the smallest (turn, conv_id, after) of them.
``linked`` is the short view: of equal identifiers the smallest call and result, ``repeats`` counts the others. A null identifier
links with nothing and is left out; an empty text is an empty string, a null content is null in the JSON; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from beamfold.llm.catalog import query, table
from beamfold.session import stage

#: Schemas of the tools that the query's turns stand for.
SCHEMAS = {
    "answer": {"query": {"type": "string", "minLength": 1, "required": True}, "n_words": {"type": "integer", "minimum": 1, "maximum": 60, "required": True}},
    "explain": {"query": {"type": "string", "minLength": 100, "required": True}, "n_words": {"type": "integer", "minimum": 20, "required": True}},
}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def problems(arguments: dict, schema: dict) -> list[str]:
    """What is wrong with arguments, sorted."""
    found = [f"{k}:unknown" for k in arguments.keys() - schema.keys()]
    for key, rule in schema.items():
        if key not in arguments:
            found += [f"{key}:required"] if rule.get("required") else []
            continue
        value = arguments[key]
        if not isinstance(value, _TYPES[rule["type"]]) or isinstance(value, bool) and rule["type"] != "boolean":
            found.append(f"{key}:type")
            continue
        size = len(value) if isinstance(value, (str, list)) else None
        for name, bad in (("minimum", lambda m: value < m), ("maximum", lambda m: value > m), ("minLength", lambda m: size < m), ("maxLength", lambda m: size > m), ("enum", lambda m: value not in m)):
            if name in rule and bad(rule[name]):
                found.append(f"{key}:{name}")
    return sorted(found)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _refuse(constant: str) -> None:
    raise ValueError(constant)


def _finite(number: str) -> float:
    value = float(number)
    return value if math.isfinite(value) else _refuse(number)


def _unique(pairs: list[tuple[str, object]]) -> dict:
    return dict(pairs) if len({k for k, _ in pairs}) == len(pairs) else _refuse("repeated key")


def parsed(text: str | None) -> dict | None:
    """Arguments, or None where they are not an object that can be written as JSON again."""
    try:
        value = json.loads(text or "", object_pairs_hook=_unique, parse_constant=_refuse, parse_float=_finite)
        canonical(value).encode()
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def depths(calls: DataFrame) -> DataFrame:
    """(call_id, depth, missing): depth null in a cycle or behind one; missing: the call named before it does not exist."""
    ids = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("known"))
    # Calls that come after none, the most of them, take no part in the joins: they would all have the key null.
    free = calls.where("after is null").select("call_id", F.lit(None).cast(calls.schema["after"].dataType).alias("above"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("missing"))
    bound = calls.where("after is not null").select("call_id", "after").join(ids, "after", "left").select(
        "call_id", F.when(F.col("known"), F.col("after")).alias("above"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), F.col("known").isNull().alias("missing"))
    state = stage(free.unionAll(bound), "depths")
    reach, total = 1, None
    while not (open_ := state.where("above is not null")).isEmpty():
        total = total or open_.count()
        if reach > 2 * total:
            break
        up = state.select(F.col("call_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        moved = open_.join(up, "above").select("call_id", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), "missing")
        state = stage(state.where("above is null").unionAll(moved), "depths")
        reach *= 2
    return state.select("call_id", F.when(F.col("above").isNull(), F.col("depth")).alias("depth"), "missing")


def _written(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["message"]:
                    out.append(("message", "", canonical({"content": r["content"], "id": r["call_id"], "role": r["name"]})))
                    continue
                if not r["called"]:
                    out.append(("orphan_result", "", canonical({"id": r["call_id"], "result": r["content"]})))
                    continue
                arguments = parsed(r["arguments"])
                schema = schemas.get(r["name"])
                wrong = problems(arguments, schema) if arguments is not None and schema is not None else []
                status = ("cycle" if r["depth"] is None else "missing_dependency" if r["missing"] else "bad_json" if arguments is None
                          else "unknown_tool" if schema is None else "invalid" if wrong else "ok" if r["answered"] else "no_result")
                out.append((status, ",".join(wrong), canonical({"arguments": arguments, "id": r["call_id"], "name": r["name"], "result": r["content"]})))
            columns = [pa.array(list(c), pa.string()) for c in zip(*out)] or [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("call_id", "conv_id", "turn", "depth", "repeats")), *columns],
                                             ["call_id", "conv_id", "turn", "depth", "repeats", "status", "problems", "json"])

    return run


_COLUMNS = "call_id string, conv_id long, turn long, depth long, repeats long, status string, problems string, json string"


def _judged(rows: DataFrame, schemas: dict) -> DataFrame:
    rows = rows.select("call_id", F.col("conv_id").cast("long"), F.col("turn").cast("long"), "depth", "repeats", "name", "arguments", "content",
                       *(F.coalesce(c, F.lit(False)).alias(c) for c in ("called", "answered", "missing")),
                       F.col("message") if "message" in rows.columns else F.lit(False).alias("message"))
    return rows.mapInArrow(_written(schemas), _COLUMNS)


def linked(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per identifier: conv_id, turn, depth, status, problems, json."""
    first = lambda df, *names: df.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct(*names)).alias("x"), F.count("*").alias("n")).select("call_id", "n", "x.*")
    one = stage(first(calls, "turn", "conv_id", "name", "arguments", "after").withColumn("called", F.lit(True)), "calls")
    answers = first(results, "turn", "content").select("call_id", "content", F.col("n").alias("n_results"), F.lit(True).alias("answered"))
    rows = one.join(depths(one), "call_id").join(answers.hint("shuffle_hash"), "call_id", "full")
    return _judged(rows.withColumn("repeats", F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0)) + F.greatest(F.coalesce("n_results", F.lit(0)) - 1, F.lit(0))), schemas)


def links(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per distinct call and distinct result of an identifier, in the columns of ``linked``."""
    every = stage(calls.where("call_id is not null").select("call_id", "turn", "conv_id", "name", "arguments", "after").distinct(), "calls")
    one = every.groupBy("call_id").agg(F.min(F.struct("turn", "conv_id", "after")).alias("x")).select("call_id", "x.after")
    above = depths(one).select(F.col("call_id").alias("after"), F.col("depth").alias("above"), F.lit(True).alias("known"))
    call = ["call_id", "conv_id", "turn", "name", "arguments"]
    free = every.where("after is null").select(*call, F.lit(0).cast("long").alias("depth"), F.lit(False).alias("missing"))
    bound = every.where("after is not null").join(above, "after", "left").select(
        *call, F.when(F.col("known"), F.col("above") + 1).otherwise(0).cast("long").alias("depth"), F.col("known").isNull().alias("missing"))
    placed = free.unionAll(bound).withColumn("called", F.lit(True))
    answers = results.where("call_id is not null").select("call_id", "turn", "content").distinct().select("call_id", "content", F.lit(True).alias("answered"))
    return _judged(placed.join(answers.hint("shuffle_hash"), "call_id", "full").withColumn("repeats", F.lit(0).cast("long")), schemas)


def messages(turns: DataFrame) -> DataFrame:
    """Turns (call_id, conv_id, turn, role, content) that call and answer nothing, each distinct one, in the columns of ``linked``."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = turns.select("call_id", "conv_id", "turn", F.col("role").alias("name"), "content").distinct().select(
        "*", null("long").alias("depth"), F.lit(0).cast("long").alias("repeats"), null("string").alias("arguments"), F.lit(True).alias("message"),
        *(F.lit(False).alias(c) for c in ("called", "answered", "missing")))
    return _judged(rows, {})


_ID = "concat_ws('-', conv_id, {})"


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """User turns as calls, each after the user turn two turns earlier if there is one; assistant turns as results of the turn
    before them; turns of another role or none, which are neither."""
    turns = conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "coalesce(text, '') text").where("conv_id is not null and turn is not null")
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    user = turns.where("role = 'user'")
    earlier = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("follows")).distinct()
    calls = user.join(earlier, ["conv_id", "turn"], "left").select(
        F.expr(_ID.format("turn")).alias("call_id"), "conv_id", "turn", F.when(n_words <= 40, "answer").otherwise("explain").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), n_words.alias("n_words"))).alias("arguments"),
        F.when(F.col("follows"), F.expr(_ID.format("turn - 2"))).alias("after"))
    results = turns.where("role = 'assistant'").select(F.expr(_ID.format("turn - 1")).alias("call_id"), "turn", F.col("text").alias("content"))
    others = turns.where("role is null or role not in ('user', 'assistant')").select(F.expr(_ID.format("turn")).alias("call_id"), "conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, others


SQL_LINKED = r"""
WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text AS query, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words FROM t WHERE role = 'user'),
n AS (SELECT *, CASE WHEN n_words <= 40 THEN 'answer' ELSE 'explain' END AS name FROM c),
u AS (SELECT DISTINCT conv_id, turn FROM n),
d AS (SELECT conv_id, turn, 0::BIGINT AS depth FROM u n WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.conv_id = n.conv_id AND o.turn = n.turn - 2)
  UNION ALL SELECT n.conv_id, n.turn, d.depth + 1 FROM d JOIN u n ON n.conv_id = d.conv_id AND n.turn = d.turn + 2),
r AS (SELECT conv_id || '-' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'assistant'),
j AS (SELECT coalesce(n.call_id, r.call_id) AS call_id, n.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered, n.conv_id, n.turn, d.depth, name, query, n_words, content,
    concat_ws(',', CASE WHEN name = 'answer' AND n_words < 1 OR name = 'explain' AND n_words < 20 THEN 'n_words:minimum' END,
      CASE WHEN length(query) < CASE name WHEN 'answer' THEN 1 ELSE 100 END THEN 'query:minLength' END) AS p
  FROM n JOIN d USING (conv_id, turn) FULL JOIN r ON n.call_id = r.call_id)
SELECT call_id, conv_id, turn, depth, 0::BIGINT AS repeats,
  CASE WHEN NOT called THEN 'orphan_result' WHEN p <> '' THEN 'invalid' WHEN answered THEN 'ok' ELSE 'no_result' END AS status,
  CASE WHEN called THEN p ELSE '' END AS problems,
  CASE WHEN called THEN json_object('arguments', json_object('n_words', n_words, 'query', query), 'id', call_id, 'name', name, 'result', content)
    ELSE json_object('id', call_id, 'result', content) END::VARCHAR AS json
FROM j
UNION ALL SELECT conv_id || '-' || turn, conv_id, turn, NULL, 0, 'message', '', json_object('content', text, 'id', conv_id || '-' || turn, 'role', role)::VARCHAR
FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


@query("op8_tool_call_linking", SQL_LINKED)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = turns_as_calls(table(spark, sf_dir, "conversations"))
    return links(calls, results).unionAll(messages(others))
