"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Everything is DataFrame expressions. Calls (conv_id, id, name, arguments, after) meet results (conv_id, id, content)
in a full hash join on the identifier; `after` names the calls whose results a call needs. A call's level is 0
without such needs, else one more than the highest level among them: (level, id) is a topological order.

Levels. A call with one need points at that need; pointers are doubled, so a chain of n calls takes log2(n) rounds,
each a join on the one key (conv_id, id) written to the shared folder. What then remains are calls with several
needs; they take a round for each further level of such calls above each other.

Arguments are checked against a schema per tool name: types, required names, and ranges (of a number's value, of a
string's length in code points). Canonical JSON has its keys in ascending order, no white space, and each argument in
its schema's type; what doesn't fit its type stays a string.

Cases, each defined here and tested:

* a null conv_id or identifier links with nothing: such a call has a null level, no results and isn't valid;
* of several results of one call the least content is taken (null last), and the number of them is given;
* calls repeated under one identifier stay apart, share the result, the level and the needs of all of them together;
* results that name no call are rows of their own, one per conversation and identifier, with status 'unmatched';
* a need is unmet if there is no call of that name in the conversation, or none of its results;
* calls in a cycle, or behind one, have a null level and aren't valid; a call that needs itself is a cycle;
* a null argument counts as missing, null arguments as none, a null `after` as empty;
* an empty or very long text is a value like any other; extra columns, of whatever name, are ignored;
* an empty table of calls gives the unmatched results alone; two empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written


class Field(NamedTuple):
    """An argument's type (string, bigint, double or boolean), and the range of its value or length."""

    kind: str
    required: bool = True
    least: int | None = None
    most: int | None = None


#: Tool -> argument -> what it has to be.
Schemas = dict[str, dict[str, Field]]
CHAT_SCHEMAS: Schemas = {
    "configure": {"instruction": Field("string", least=1, most=300), "n_words": Field("bigint", least=3)},
    "ask": {"question": Field("string", least=1, most=300), "n_words": Field("bigint", least=3, most=45), "end": Field("string", False)},
}
KEY = ["conv_id", "id"]
LINKED, UNANSWERED, UNMATCHED = "linked", "unanswered", "unmatched"


def quoted(text: Column) -> Column:
    """A string as a JSON string; null as null."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted list of 'unknown tool', 'missing:x', 'type:x', 'range:x' and 'unknown:x'."""
    none = F.array().cast("array<string>")
    case = F.when(F.lit(False), none)
    for tool, fields in sorted(schemas.items()):
        found = []
        for x, field in sorted(fields.items()):
            given = F.element_at(arguments, F.lit(x))
            value = given.try_cast(field.kind)
            size = F.length(value) if field.kind == "string" else value
            outside = [size < field.least] * (field.least is not None) + [size > field.most] * (field.most is not None)
            error = F.when(given.isNull(), F.lit(f"missing:{x}") if field.required else F.lit(None)).when(value.isNull(), F.lit(f"type:{x}"))
            found.append(error.when(reduce(Column.__or__, outside), F.lit(f"range:{x}")) if outside else error)
        known = F.array(*map(F.lit, sorted(fields))) if fields else none
        unknown = F.transform(F.array_except(F.map_keys(arguments), known), lambda x: F.concat(F.lit("unknown:"), x))
        case = case.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*found)) if found else none, unknown)))
    return case.otherwise(F.array(F.lit("unknown tool")))


def canonical(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Arguments as JSON: ascending keys, values in the types of the tool's schema."""
    kinds = [F.lit(x) for tool, fields in sorted(schemas.items()) for field, f in sorted(fields.items()) if f.kind != "string" for x in (f"{tool}\n{field}", f.kind)]
    known = F.create_map(*kinds) if kinds else F.create_map().cast("map<string,string>")

    def value(entry: Column) -> Column:
        kind = F.element_at(known, F.concat_ws("\n", name, entry["key"]))
        typed = F.lit(None).cast("string")
        for k in ("bigint", "double", "boolean"):
            number = F.to_json(F.array(entry["value"].try_cast(k)))
            number = F.when(entry["value"].try_cast(k).isNotNull(), F.substring(number, F.lit(2), F.length(number) - 2))
            typed = F.when(kind == k, number).otherwise(typed)
        return F.concat(quoted(entry["key"]), F.lit(":"), F.coalesce(typed, quoted(entry["value"])))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(arguments)), value), ","), F.lit("}"))


def needs_of(calls: DataFrame) -> DataFrame:
    """(conv_id, id, needs), distinct and without nulls."""
    return calls.select(*KEY, F.explode("after").alias("needs")).dropna().distinct()


def doubled(chain: DataFrame, label: str) -> DataFrame:
    """(conv_id, id, top, steps, open) from (conv_id, id, top, steps = 1) for calls with one need each.

    `top` is the first call above that isn't in `chain`, `steps` how far up it is. What stays open is in a cycle or
    behind one: as long as any other call is open, every round closes some.
    """
    jump, before = written(chain.withColumn("open", F.lit(True)), label), None
    while (left := jump.filter("open").count()) and left != before:
        up = jump.select("conv_id", F.col("id").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        joined = jump.filter("open").join(up, ["conv_id", "top"], "left")
        moved = joined.select(*KEY, F.coalesce("_top", "top").alias("top"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_top").isNotNull().alias("open"))
        jump, before = written(moved.unionByName(jump.filter("NOT open")), label), left
    return jump


def levels(calls: DataFrame, label: str = "call-levels") -> DataFrame:
    """(conv_id, id, level) of the calls' distinct identifiers; the level is null in or behind a cycle."""
    nodes = calls.select(*KEY).dropna().distinct()
    edges = needs_of(calls).join(nodes.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi")
    above = written(edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("needs").alias("top")), label)
    chain = doubled(above.filter("n = 1").select(*KEY, "top", F.lit(1).alias("steps")), label)
    several = above.filter("n > 1").select(*KEY)
    solved = [several.limit(0).withColumn("level", F.lit(0))]
    if not several.isEmpty():
        # Each need of a call with several: the first call above it that is a start or has several needs itself.
        over = chain.select("conv_id", F.col("id").alias("needs"), "top", "steps", "open")
        many = edges.join(several, KEY, "left_semi").join(over, ["conv_id", "needs"], "left")
        many = many.select(*KEY, F.coalesce("top", "needs").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("open", F.lit(False)).alias("open"))
        waits = several.select("conv_id", F.col("id").alias("top"), F.lit(True).alias("_waits"))
        many = many.join(waits, ["conv_id", "top"], "left").withColumn("level", F.when(~F.col("open") & F.col("_waits").isNull(), F.col("steps")))
        many = written(many.select(*KEY, "top", "steps", "level"), label)
        while True:
            ready = many.groupBy(*KEY).agg(F.max("level").alias("level"), F.every(F.col("level").isNotNull()).alias("known")).filter("known")
            ready = written(ready.select(*KEY, "level"), label)
            if ready.isEmpty():
                break
            solved.append(ready)
            found = ready.select("conv_id", F.col("id").alias("top"), F.col("level").alias("_level"))
            rest = many.join(ready, KEY, "left_anti").join(found, ["conv_id", "top"], "left")
            many = written(rest.select(*KEY, "top", "steps", F.coalesce("level", F.col("_level") + F.col("steps")).alias("level")), label)
    branched = reduce(DataFrame.unionByName, solved)
    top = branched.select("conv_id", F.col("id").alias("top"), F.col("level").alias("_level"), F.lit(True).alias("_solved"))
    tops = chain.join(several.select("conv_id", F.col("id").alias("top"), F.lit(True).alias("_several")), ["conv_id", "top"], "left").join(top, ["conv_id", "top"], "left")
    chained = tops.select(*KEY, F.when(~F.col("open") & (F.col("_several").isNull() | F.col("_solved").isNotNull()), F.col("steps") + F.coalesce("_level", F.lit(0))).alias("level"))
    starts = nodes.join(above, KEY, "left_anti").withColumn("level", F.lit(0))
    cycles = several.join(branched, KEY, "left_anti").withColumn("level", F.lit(None).cast("int"))
    return written(starts.unionByName(chained).unionByName(branched).unionByName(cycles), label)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Per call, and per identifier of unmatched results: conv_id, id, name, status, level, n_results, unmet, errors,
    valid, json."""
    calls = calls.select(*KEY, "name", "arguments", "after")
    answers = results.groupBy(*KEY).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    none = F.array().cast("array<string>")
    linked = calls.withColumn("_call", F.lit(True)).join(answers, KEY, "full").join(levels(calls), KEY, "left")
    # Needs without a result; a result of no call doesn't count.
    answered = answers.select("conv_id", F.col("id").alias("needs")).join(calls.select("conv_id", F.col("id").alias("needs")).distinct(), ["conv_id", "needs"], "left_semi")
    unmet = needs_of(calls).join(answered, ["conv_id", "needs"], "left_anti").groupBy(*KEY).agg(F.array_sort(F.collect_set("needs")).alias("unmet"))
    linked = linked.join(unmet, KEY, "left")
    is_call, arguments = F.col("_call").isNotNull(), F.coalesce("arguments", F.create_map().cast("map<string,string>"))
    linked = linked.withColumns(
        {
            "n_results": F.coalesce("n_results", F.lit(0)).cast("long"),
            "status": F.when(~is_call, UNMATCHED).when(F.col("n_results").isNull(), UNANSWERED).otherwise(LINKED),
            "unmet": F.coalesce("unmet", none),
            "errors": F.when(is_call, argument_errors(F.col("name"), arguments, schemas)).otherwise(none),
        }
    ).withColumn("valid", (F.col("status") == LINKED) & (F.size("errors") == 0) & (F.size("unmet") == 0) & F.col("level").isNotNull())
    fields = {
        "after": F.to_json(F.array_sort(F.coalesce("after", none))),
        "arguments": canonical(F.col("name"), arguments, schemas),
        "id": quoted(F.col("id")),
        "level": F.coalesce(F.col("level").cast("string"), F.lit("null")),
        "name": quoted(F.col("name")),
        "result": quoted(F.col("content")),
    }
    pieces = [p for i, (key, value) in enumerate(fields.items()) for p in (F.lit(f'{"," if i else "{"}"{key}":'), value)]
    return linked.select(*KEY, "name", "status", "level", "n_results", "unmet", "errors", "valid", F.concat(*pieces, F.lit("}")).alias("json"))


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: what user and system turns ask for, what all other turns answer.

    A call's identifier is its turn; an answer in turn t answers turn t - 1. A call right after an answer needs the
    call which that answer answers, one right after another call needs that call. Null texts are empty.
    """
    turns = conversations.select("conv_id", "turn", F.col("role").isin("user", "system").alias("is_call"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("is_call", F.coalesce("is_call", F.lit(False)))
    words = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("string")
    is_user = F.col("role") == "user"
    what = F.when(is_user, "question").otherwise("instruction")
    before = turns.dropna(subset=["conv_id", "turn"]).groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.every("is_call").alias("_call_before"))
    calls = turns.filter("is_call").join(before, ["conv_id", "turn"], "left")
    needed = F.when(F.col("_call_before"), F.col("turn") - 1).when(~F.col("_call_before"), F.col("turn") - 2)
    calls = calls.select(
        "conv_id",
        F.col("turn").cast("string").alias("id"),
        F.when(is_user, "ask").otherwise("configure").alias("name"),
        F.create_map(what, F.col("text"), F.lit("n_words"), words).alias("arguments"),
        F.array_compact(F.array(needed.cast("string"))).alias("after"),
    )
    results = turns.filter("NOT is_call").select("conv_id", (F.col("turn") - 1).cast("string").alias("id"), F.col("text").alias("content"))
    return calls, results


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = link_tool_calls(calls, results, CHAT_SCHEMAS)
    return found.select(*KEY, "name", "status", "level", "n_results", F.concat_ws(",", "unmet").alias("unmet"), F.concat_ws(",", "errors").alias("errors"), "valid", "json")


OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, coalesce(role IN ('user', 'system'), false) AS is_call, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM conversations),
b AS (SELECT conv_id, turn + 1 AS turn, bool_and(is_call) AS call_before FROM t GROUP BY 1, 2),
c AS (SELECT t.*, CASE WHEN call_before THEN t.turn - 1 WHEN NOT call_before THEN t.turn - 2 END AS need FROM t LEFT JOIN b ON b.conv_id = t.conv_id AND b.turn = t.turn WHERE is_call),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS k FROM t WHERE NOT is_call GROUP BY 1, 2),
nodes AS (SELECT DISTINCT conv_id, turn, need FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lv AS (
  SELECT conv_id, turn, 0 AS level FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.conv_id = x.conv_id AND y.turn = x.need)
  UNION ALL SELECT x.conv_id, x.turn, lv.level + 1 FROM nodes x JOIN lv ON lv.conv_id = x.conv_id AND lv.turn = x.need),
j AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.turn)::VARCHAR AS id, c.is_call, role, text, n, need, content, k
  FROM c FULL JOIN a ON a.conv_id = c.conv_id AND a.turn = c.turn),
e AS (
  SELECT j.*, lv.level, CASE role WHEN 'user' THEN 'ask' WHEN 'system' THEN 'configure' END AS name,
    CASE WHEN need IS NOT NULL AND j.conv_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a JOIN nodes USING (conv_id, turn) WHERE a.conv_id = j.conv_id AND a.turn = j.need) THEN need::VARCHAR ELSE '' END AS unmet,
    CASE WHEN is_call IS NULL THEN '' ELSE concat_ws(',', CASE WHEN role = 'system' AND length(text) NOT BETWEEN 1 AND 300 THEN 'range:instruction' END,
      CASE WHEN n < 3 OR role = 'user' AND n > 45 THEN 'range:n_words' END, CASE WHEN role = 'user' AND length(text) NOT BETWEEN 1 AND 300 THEN 'range:question' END) END AS errors
  FROM j LEFT JOIN lv ON lv.conv_id = j.conv_id AND lv.turn::VARCHAR = j.id)
SELECT conv_id, id, name, CASE WHEN is_call IS NULL THEN 'unmatched' WHEN k IS NULL THEN 'unanswered' ELSE 'linked' END AS status, level::INT AS level,
  coalesce(k, 0)::BIGINT AS n_results, unmet, errors, coalesce(is_call AND k IS NOT NULL AND unmet = '' AND errors = '' AND level IS NOT NULL, false) AS valid,
  '{"after":[' || coalesce('"' || need || '"', '') || '],"arguments":{'
  || CASE role WHEN 'user' THEN '"n_words":' || n || ',"question":' || to_json(text)::VARCHAR WHEN 'system' THEN '"instruction":' || to_json(text)::VARCHAR || ',"n_words":' || n ELSE '' END
  || '},"id":' || coalesce('"' || id || '"', 'null') || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS json
FROM e
"""
