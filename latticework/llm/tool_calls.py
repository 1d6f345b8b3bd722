"""Chat formatting: link tool calls to their results, in DataFrame operations only.

Calls and results are hash-joined by identifier, ordered by what they wait for,
checked against argument schemas, and written as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, numbered


def json_string(text: Column) -> Column:
    """A JSON string literal in canonical form: shortest escapes, no escaped solidus
    or letters beyond ASCII, other control characters as \\u00xx in lower case."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escape in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(escape))
    rest = [c for c in range(32) if c not in (8, 9, 10, 12, 13)]
    escaped = out
    for c in rest:
        escaped = F.replace(escaped, F.lit(chr(c)), F.lit(f"\\u{c:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), escaped).otherwise(out), F.lit('"'))


def json_object(members: dict[str, Column]) -> Column:
    """A JSON object with its keys in code-point order; members that are null are null."""
    parts: list[Column] = []
    for k, key in enumerate(sorted(members)):
        parts += [F.lit(("," if k else "{") + '"' + key + '":'), F.coalesce(members[key], F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def depths(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, ring) of (conv_id, call_id, parent_id), each (conv_id, call_id) once: calls without
    a known parent have depth 0; calls in a circle, or waiting for one, have none, and `ring` marks those in it.

    Pointers double each round, so the longest chain takes a logarithmic number of rounds. Only calls
    that still wait are joined. Very many calls may wait for one: it is once on the other side, and
    adaptive execution splits such a join.
    """
    key = F.struct(F.col("conv_id").alias("c"), F.col("call_id").alias("k"))
    nodes = nodes.select(key.alias("at"), F.when(F.col("parent_id").isNotNull(), F.struct(F.col("conv_id").alias("c"), F.col("parent_id").alias("k"))).alias("up"))
    nodes = cut(nodes.select(F.to_json("at", {"ignoreNullFields": "false"}).alias("at"), F.to_json("up", {"ignoreNullFields": "false"}).alias("up")))
    known = nodes.select(F.col("at").alias("up"), F.lit(True).alias("known"))
    waiting = cut(nodes.where("up is not null").join(known, "up").select("at", "up", F.lit(1).cast("long").alias("depth")))
    done = nodes.join(waiting.select("at"), "at", "left_anti").select("at", F.lit(0).cast("long").alias("depth"), F.lit(False).alias("ring"))
    total, rounds = nodes.count(), 0
    left = waiting.count()
    while left and 2**rounds <= 2 * total:
        settled = cut(done.select(F.col("at").alias("up"), F.col("depth").alias("below")))
        above = waiting.select(F.col("at").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        ready = cut(waiting.join(settled, "up").select("at", (F.col("depth") + F.col("below")).alias("depth"), F.lit(False).alias("ring")))
        waiting = cut(waiting.join(above, "up").select("at", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth")))
        done = settled.select(F.col("up").alias("at"), F.col("below").alias("depth"), F.lit(False).alias("ring")).unionByName(ready)
        left, rounds = waiting.count(), rounds + 1
    # After more steps than there are calls every pointer is in a circle, and each call of one is pointed to.
    rings = waiting.select(F.col("up").alias("at")).distinct().withColumn("ring", F.lit(True))
    stuck = waiting.select("at").join(rings, "at", "left").select("at", F.lit(None).cast("long").alias("depth"), F.coalesce("ring", F.lit(False)).alias("ring"))
    return done.unionByName(stuck)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """One row per call and per result without a call: (conv_id, call_id, name, depth, position, status, valid, calls, results, record).

    `calls` has conv_id, turn, call_id, name, parent_id (the call of the same conversation that it
    waits for, or null) and arguments (map<string,string>); `results` has conv_id, call_id, turn and
    content. `schemas` gives each tool's arguments and types: 'string', 'integer', 'number',
    'boolean', 'null', 'enum:red|green', or 'array:' and one of the first five for a JSON array of
    such; required unless the type ends in '?'.

    A call is known by its conversation and id; a null conversation is one of its own. A call whose id
    is null gets one from its turn. `calls` and `results` count the rows with that id: of several
    calls the one of the least turn (then name, then arguments) counts, of several results that of the
    least turn (then content). status is 'linked', 'unanswered', 'circular' (the call waits for itself
    through others), 'blocked' (it waits for a circular one) or 'orphan' (a result without a call;
    a result whose id is null is one per conversation). valid says whether the tool is known, all
    required arguments are there and of their type, and no other is. position numbers a
    conversation's rows in topological order (depth, turn, call_id; those without a depth last). record
    is the call with its result as JSON with sorted keys and no blanks. Texts go through whole. Empty
    tables give no rows. Other columns are ignored.

    Sums over an id are combined before they are shuffled, positions come from one global range
    sort, and joins are plain ones: a conversation or call with very many rows is in no single task.
    """
    conv = F.col("conv_id").cast("string").alias("__conv")
    known = F.coalesce(F.col("call_id").cast("string"), F.concat(F.lit("turn:"), F.coalesce(F.col("turn").cast("string"), F.lit("null"))))
    last = F.lit(2**63 - 1)
    rank = F.struct(
        F.coalesce(F.col("turn").cast("long"), last).alias("turn"), F.col("name").isNull().alias("unnamed"), F.col("name").cast("string").alias("name"),
        F.col("arguments").isNull().alias("bare"), F.array_sort(F.map_entries("arguments")).alias("entries"), F.col("parent_id").cast("string").alias("parent_id"),
    )
    own = calls.select("conv_id", conv, known.alias("call_id"), rank.alias("call")).groupBy("__conv", "call_id").agg(F.first("conv_id").alias("conv_id"), F.min("call").alias("call"), F.count(F.lit(1)).alias("calls"))
    own = cut(own)
    answer = F.struct(F.coalesce(F.col("turn").cast("long"), last).alias("turn"), F.col("content").isNull().alias("silent"), F.col("content").cast("string").alias("content"))
    answers = results.select("conv_id", conv, F.col("call_id").cast("string").alias("call_id"), answer.alias("answer")).groupBy("__conv", "call_id").agg(F.first("conv_id").alias("__conv_id"), F.min("answer").alias("answer"), F.count(F.lit(1)).alias("results"))
    answers = answers.withColumnsRenamed({"__conv": "__rconv", "call_id": "__rcall"})
    both = own.join(answers, F.col("__conv").eqNullSafe(F.col("__rconv")) & F.col("call_id").eqNullSafe(F.col("__rcall")), "full")
    orphan = F.col("call").isNull()
    both = both.select(F.when(orphan, F.col("__conv_id")).otherwise(F.col("conv_id")).alias("conv_id"), F.coalesce("__conv", "__rconv").alias("__conv"), F.coalesce("call_id", "__rcall").alias("call_id"), "call", "answer", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("results", F.lit(0)).alias("results"))
    at = F.to_json(F.struct(F.col("__conv").alias("c"), F.col("call_id").alias("k")), {"ignoreNullFields": "false"})
    deep = depths(own.select(F.col("__conv").alias("conv_id"), "call_id", F.col("call.parent_id").alias("parent_id")))
    joined = both.withColumn("at", at).join(deep, "at", "left").drop("at")
    status = F.when(orphan, "orphan").when(F.col("ring"), "circular").when(F.col("depth").isNull(), "blocked").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    joined = joined.select("*", F.col("call.name").alias("name"), F.map_from_entries("call.entries").alias("arguments"), status.alias("status"))
    valid, encoded = F.lit(False), F.lit("{}")
    for name, schema in schemas.items():
        is_it = F.col("name") == name
        valid = F.when(is_it, fits(F.col("arguments"), schema)).otherwise(valid)
        encoded = F.when(is_it, json_object({k: as_json(F.col("arguments")[k], kind) for k, kind in schema.items()})).otherwise(encoded)
    members = {"arguments": F.when(valid, encoded).otherwise(F.lit("null")), "call_id": json_string(F.col("call_id")), "name": json_string(F.col("name")), "result": json_string(F.col("answer.content")), "status": json_string(F.col("status"))}
    turn = F.coalesce(F.col("call.turn"), F.col("answer.turn"))
    rows = joined.select("conv_id", "__conv", turn.alias("__turn"), "call_id", "name", "depth", "status", F.coalesce(valid, F.lit(False)).alias("valid"), "calls", "results", json_object(members).alias("record"))
    placed = numbered(rows, F.col("__conv"), F.coalesce("depth", last), F.col("__turn"), F.col("call_id"))
    first = placed.groupBy("__conv").agg(F.min("__at").alias("__first")).withColumnRenamed("__conv", "__fconv")
    placed = placed.join(first, F.col("__conv").eqNullSafe(F.col("__fconv")))
    return placed.select("conv_id", "call_id", "name", "depth", (F.col("__at") - F.col("__first") + 1).alias("position"), "status", "valid", "calls", "results", "record")


PATTERNS = {"integer": r"-?(0|[1-9][0-9]*)", "number": r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?", "boolean": r"(true|false)", "null": r"null"}
#: A JSON string without blanks around it.
STRING = r'"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'


def pattern(kind: str) -> str | None:
    """What a value of this type must match whole; None: anything."""
    if kind.startswith("array:"):
        one = STRING if kind[6:] == "string" else PATTERNS[kind[6:]]
        return rf"^\[({one}(,{one})*)?\]$"
    return None if kind == "string" or kind.startswith("enum:") else f"^{PATTERNS[kind]}$"


def is_a(value: Column, kind: str) -> Column:
    if kind.startswith("enum:"):
        return F.coalesce(value.isin(kind[5:].split("|")), F.lit(False))
    found = pattern(kind)
    return value.isNotNull() if found is None else F.coalesce(value.rlike(found), F.lit(False))


def fits(arguments: Column, schema: dict[str, str]) -> Column:
    ok = F.coalesce(F.size(F.array_except(F.map_keys(arguments), F.array(*[F.lit(k) for k in schema]))) == 0, F.lit(not any(not t.endswith("?") for t in schema.values())))
    for key, kind in schema.items():
        value = arguments[key]
        right = is_a(value, kind.removesuffix("?"))
        ok = ok & (right | value.isNull() if kind.endswith("?") else right)
    return F.coalesce(ok, F.lit(False))


def as_json(value: Column, kind: str) -> Column:
    return json_string(value) if kind.startswith(("string", "enum:")) else value


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user or system turn as a call to the tool of its role with its text, waiting for
    the conversation's call two turns before; every assistant turn as the result of the turn
    before it. Null text is an absent argument or result."""
    asked = F.coalesce(F.col("role") != "assistant", F.lit(True))
    arguments = F.map_filter(F.map_from_arrays(F.array(F.lit("text"), F.lit("turn")), F.array("text", F.col("turn").cast("string"))), lambda _, v: v.isNotNull())
    calls = conversations.where(asked).select("conv_id", "turn", F.col("turn").cast("string").alias("call_id"), F.col("role").alias("name"), (F.col("turn") - 2).cast("string").alias("parent_id"), arguments.alias("arguments"))
    results = conversations.where(~asked).select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


SCHEMAS = {"user": {"text": "string", "turn": "integer"}, "system": {"text": "string", "turn": "integer"}}


def format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(*turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEMAS)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role AS name, text, turn::VARCHAR AS call_id,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS LAST, text NULLS LAST) AS n, count(*) OVER (PARTITION BY conv_id, turn) AS calls
  FROM conversations WHERE coalesce(role <> 'assistant', true)),
o AS (SELECT * FROM c WHERE n = 1),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS results, min(turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn - 1),
g AS (SELECT o.*, o.turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM o),
d AS (SELECT g.*, (row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1)::BIGINT AS depth FROM g),
j AS (SELECT d.conv_id, d.call_id, d.name, d.text, d.turn, d.depth, d.calls, coalesce(r.results, 0) AS results, r.content, CASE WHEN r.results IS NULL THEN 'unanswered' ELSE 'linked' END AS status
      FROM d LEFT JOIN r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.turn = r.turn
      UNION ALL SELECT r.conv_id, r.turn::VARCHAR, NULL, NULL, r.said, NULL, 0, r.results, r.content, 'orphan' FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.turn = r.turn)),
v AS (SELECT *, coalesce(name IN ('user', 'system') AND text IS NOT NULL, false) AS valid FROM j)
SELECT conv_id, call_id, name, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, turn, call_id)::BIGINT AS position, status, valid, calls::BIGINT AS calls, results::BIGINT AS results,
       '{"arguments":' || CASE WHEN valid THEN '{"text":' || to_json(text)::VARCHAR || ',"turn":' || call_id || '}' ELSE 'null' END
       || ',"call_id":"' || call_id || '","name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS record
FROM v
"""
