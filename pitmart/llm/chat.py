"""Tool-call linking in conversations, in DataFrame functions only.

Calls and results are joined by identifier, calls are put in topological order by the calls they depend on, arguments
are checked against schemas, and each exchange is written as canonical JSON: keys in order, no blanks.

Messages: an assistant message that is a JSON object with `id` and `name` is a call, with the object `arguments` and
`after`, the identifier or identifiers of the calls it depends on; a tool message that is one with `id` is its result.
Any other user message is a call of the tool `chat.reply` with the arguments `text` and `turn` and the identifier
<conv_id>-<turn>, answered by an assistant message of the next turn; it follows the call two turns before, if there is
one.  System messages are neither.

Arguments keep their JSON types: they are checked by type and written back as they are, 3 as 3 and "3" as "3".

Defined results: rows without conv_id or turn are left out; a null text is empty; text that is no valid JSON is a plain
message; arguments that are no object are an error; several results of one identifier count as the first by turn and
content; repeated calls are repeated rows, each linked, with one depth: that of the earliest turn and all of their
dependencies; a result without a call and a call without a result are rows too; a dependency that is no call of the
conversation or not of an earlier turn is an error of the call and adds no depth; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitmart.llm.common import discard, materialize, table, tidy

#: tool -> argument -> (type, required); types: string, text (not empty), integer, number, boolean.
SCHEMAS: Mapping[str, Mapping[str, tuple[str, bool]]] = {"chat.reply": {"text": ("text", True), "turn": ("integer", True)}}
#: Patterns of the types' names in Spark.
_TYPES = {"string": "^STRING$", "text": "^STRING$", "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$"}
_ARGUMENTS = "map<string,variant>"


def calls_and_results(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls: conv_id, turn, call_id, name, arguments, after: identifiers depended on, implied: whether they are not the
    message's own words), (results: conv_id, turn, call_id, content)."""
    m = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("v", F.when(F.col("text").startswith("{") & F.col("role").isin("assistant", "tool"), F.try_parse_json("text")))
    got = lambda path, kind: F.try_variant_get("v", path, kind)
    tool_id = got("$.id", "string")
    own = lambda t: F.concat_ws("-", F.col("conv_id"), t)
    explicit = tool_id.isNotNull() & got("$.name", "string").isNotNull() & (F.col("role") == "assistant")
    answer = tool_id.isNotNull() & (F.col("role") == "tool")
    m = m.withColumn("kind", F.when(explicit, "call").when(answer, "result").when(F.col("role") == "user", "asked").when(F.col("role") == "assistant", "replied"))
    explicit = F.col("kind") == "call"
    listed = F.array_distinct(F.filter(F.coalesce(got("$.after", "array<string>"), F.array(got("$.after", "string"))), lambda x: x.isNotNull()))
    stand_in = F.create_map(F.lit("text"), F.col("text").cast("variant"), F.lit("turn"), F.col("turn").cast("variant"))
    calls = m.where("kind in ('call', 'asked')").select(
        "conv_id", "turn",
        F.when(explicit, tool_id).otherwise(own(F.col("turn"))).alias("call_id"),
        F.when(explicit, got("$.name", "string")).otherwise("chat.reply").alias("name"),
        F.when(explicit, got("$.arguments", _ARGUMENTS)).otherwise(stand_in).alias("arguments"),
        F.when(explicit, listed).otherwise(F.array(own(F.col("turn") - 2))).alias("after"),
        (~explicit).alias("implied"),
    )
    content = F.coalesce(got("$.content", "string"), F.to_json(got("$.content", "variant")), F.lit(""))
    results = m.where("kind in ('result', 'replied')").select(
        "conv_id", "turn",
        F.when(F.col("kind") == "result", tool_id).otherwise(own(F.col("turn") - 1)).alias("call_id"),
        F.when(F.col("kind") == "result", content).otherwise(F.col("text")).alias("content"),
    )
    return calls, results


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Sorted messages for a call's arguments."""
    whens = None
    for tool, schema in schemas.items():
        found = [F.when(~F.map_contains_key(arguments, a), F.lit(f"missing {a}")) for a, (_, needed) in schema.items() if needed]
        for a, (kind, _) in schema.items():
            value = F.element_at(arguments, a)
            right = F.coalesce(F.schema_of_variant(value), F.lit("")).rlike(_TYPES[kind])
            if kind == "text":
                right &= F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")) != ""
            found.append(F.when(F.map_contains_key(arguments, a) & ~right, F.lit(f"not {kind}: {a}")))
        extra = F.transform(F.filter(F.map_keys(arguments), lambda k: ~k.isin(list(schema))), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.when(arguments.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.array_sort(F.concat(F.array_compact(F.array(*found)).cast("array<string>"), extra)))
        whens = F.when(name == tool, errors) if whens is None else whens.when(name == tool, errors)
    unknown = F.array(F.concat(F.lit("unknown tool "), name))
    return unknown if whens is None else whens.otherwise(unknown)


@tidy
def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, wrong): calls on the longest chain of dependencies behind an identifier, and messages for
    its dependencies that are no earlier call.  By doubling: each round replaces the calls that lie 2^k steps behind by
    what lies as far behind those, so a chain of n calls takes log2(n) rounds and one row a call."""
    ids = materialize(calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn")))
    known = ids.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("to"), F.col("turn").alias("to_turn"))
    wanted = calls.select("conv_id", "call_id", "implied", F.explode("after").alias("after")).groupBy("conv_id", "call_id", "after").agg(F.min("implied").alias("implied"))
    edges = wanted.join(ids, ["conv_id", "call_id"]).join(known, (F.col("conv_id") == F.col("_conv")) & (F.col("after") == F.col("to")), "left")
    edges = materialize(edges.select("conv_id", "call_id", "implied", "after", (F.col("to_turn") < F.col("turn")).alias("earlier")))
    message = F.concat(F.when(F.col("earlier").isNull(), F.lit("unknown dependency ")).otherwise("dependency not earlier: "), F.col("after"))
    wrong = edges.where("not implied and not coalesce(earlier, false)").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set(message)).alias("wrong"))
    first = edges.where("earlier").select("conv_id", "call_id", F.col("after").alias("to"), F.lit(1).cast("long").alias("steps"))
    now = materialize(first.unionByName(ids.join(first.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(None).cast("string").alias("to"), F.lit(0).cast("long").alias("steps"))))
    while not now.where("to is not null").isEmpty():
        behind = now.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_call"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        further = now.where("to is not null").join(behind, (F.col("conv_id") == F.col("_conv")) & (F.col("to") == F.col("_call")))
        further = further.select("conv_id", "call_id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"))
        new = materialize(now.where("to is null").unionByName(further).groupBy("conv_id", "call_id", "to").agg(F.max("steps").alias("steps")))
        discard(now)
        now = new
    return now.select("conv_id", "call_id", F.col("steps").alias("depth")).join(wrong, ["conv_id", "call_id"], "left")


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """(conv_id, turn, call_id, depth, has_call, has_result, errors, json) for each call and each result without one."""
    first = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    first = first.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("r.turn").alias("r_turn"), F.col("r.content").alias("content"))
    deep = depths(calls).select(F.col("conv_id").alias("d_conv"), F.col("call_id").alias("d_call"), "depth", "wrong")
    known = calls.join(deep, (F.col("conv_id") == F.col("d_conv")) & (F.col("call_id") == F.col("d_call"))).drop("d_conv", "d_call")
    both = known.join(first, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full_outer")
    has_call, has_result = F.col("name").isNotNull(), F.col("r_conv").isNotNull()
    late = F.when(has_call & has_result & (F.col("r_turn") <= F.col("turn")), F.array(F.lit("result before call"))).otherwise(F.array().cast("array<string>"))
    wrong = F.coalesce("wrong", F.array().cast("array<string>"))
    errors = F.when(has_call, F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), wrong, late)).otherwise(F.array(F.lit("result without call")))
    ordered = F.map_from_entries(F.transform(F.array_sort(F.map_keys("arguments")), lambda k: F.struct(k, F.element_at("arguments", k))))
    json = F.to_json(F.struct(ordered.alias("arguments"), F.coalesce("call_id", "r_call").alias("id"), F.col("name"), F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("call_id", "r_call").alias("call_id"),
        F.coalesce("depth", F.lit(0)).alias("depth"), has_call.alias("has_call"), has_result.alias("has_result"), F.array_join(errors, ";").alias("errors"), json.alias("json"),
    )


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*calls_and_results(table(spark, sf_dir, "conversations")))


ORACLE_SQL = """
WITH m AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text FROM m WHERE role = 'user'),
turns AS (SELECT DISTINCT conv_id, turn FROM calls),
marked AS (SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM turns),
deep AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM marked),
results AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, min(text) AS content FROM m WHERE role = 'assistant' GROUP BY ALL)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
  coalesce(d.depth, 0) AS depth, c.conv_id IS NOT NULL AS has_call, r.conv_id IS NOT NULL AS has_result,
  CASE WHEN c.conv_id IS NULL THEN 'result without call' WHEN c.text = '' THEN 'not text: text' ELSE '' END AS errors,
  CASE WHEN c.conv_id IS NULL THEN '{"arguments":null,"id":"' || r.call_id || '","name":null,"result":' || CAST(to_json(r.content) AS VARCHAR) || '}'
  ELSE '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"chat.reply","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' END AS json
FROM calls c JOIN deep d ON c.conv_id = d.conv_id AND c.turn = d.turn FULL OUTER JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""
