"""Tool calls and their results in conversations: linked by identifier, ordered by their dependencies, validated, and written as canonical JSON.

All of it is DataFrame operations: hash joins on identifiers, arguments as variants, no Python on the executors. Nothing is
gathered by conversation, so a conversation may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import checkpoint, table, written

# JSON types of a schema, and the beginnings of the names that a variant's type has for them.
TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", "DECIMAL"],
    "boolean": ["BOOLEAN"],
    "array": ["ARRAY"],
    "object": ["OBJECT"],
    "null": ["VOID"],
}


def levels(calls: DataFrame) -> DataFrame:
    """(conv, id, level) for calls (conv, id, depends): the number of calls in the longest chain that a call depends on.

    Every call's level is above those of the calls it depends on, so levels are a topological order. Pairs that are 1, 2, 4, ... steps apart
    are joined from the pairs half as far apart; a level is then put together from the longest steps down. So a chain of n
    calls takes log n rounds. A call on a cycle, or behind one, has no level. Dependencies on unknown calls are left out.
    """
    known = calls.select("conv", "id").where("conv is not null and id is not null").distinct()
    edges = calls.select("conv", "id", F.explode("depends").alias("to")).where("to is not null").distinct()
    step = written(edges.join(known.withColumnRenamed("id", "to"), ["conv", "to"]).select("conv", "id", "to"), "steps")
    longest = known.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    steps = []
    while not step.isEmpty() and 1 << len(steps) <= longest:
        steps.append(step)
        step = written(step.join(step.select("conv", F.col("id").alias("to"), F.col("to").alias("far")), ["conv", "to"]).select("conv", "id", F.col("far").alias("to")).distinct(), "steps")
    endless = step if not step.isEmpty() else None
    reached = known.select("conv", "id", F.col("id").alias("at"), F.lit(0).cast("long").alias("level"))
    for k in range(len(steps) - 1, -1, -1):
        jump = steps[k].select("conv", F.col("id").alias("at"), "to")
        moved = reached.join(jump, ["conv", "at"]).select("conv", "id", F.col("to").alias("at"), (F.col("level") + (1 << k)).alias("level")).distinct()
        moved = written(moved, "levels")
        reached = written(moved.unionByName(reached.join(moved.select("conv", "id").distinct(), ["conv", "id"], "left_anti")), "levels")
    found = reached.select("conv", "id", "level").distinct()
    return found if endless is None else found.join(endless.select("conv", "id").distinct(), ["conv", "id"], "left_anti")


def problems(arguments: Column, parameters: Column) -> Column:
    """What is wrong with arguments (a variant) under parameters (array of name, type, required), as sorted texts.

    not an object; missing:<name>; type:<name>; unknown:<name>. A call of an unknown tool (null parameters) is no tool.
    """
    entries = F.try_variant_get(arguments, "$", "map<string,variant>") if hasattr(F, "try_variant_get") else arguments.try_cast("map<string,variant>")
    given = F.map_keys(entries)
    names = F.transform(parameters, lambda p: p["name"])
    kind = lambda p: F.schema_of_variant(entries[p["name"]])

    def wrong(p: Column) -> Column:
        fits = F.lit(False)
        for name, starts in TYPES.items():
            match = F.lit(False)
            for s in starts:
                match = match | kind(p).startswith(s)
            fits = fits | ((p["type"] == name) & match)
        return F.array_contains(given, p["name"]) & ~F.coalesce(fits, F.lit(False))

    label = lambda what: lambda n: F.concat(F.lit(what), n)
    missing = F.transform(F.filter(parameters, lambda p: p["required"] & ~F.array_contains(given, p["name"])), lambda p: F.concat(F.lit("missing:"), p["name"]))
    types = F.transform(F.filter(parameters, wrong), lambda p: F.concat(F.lit("type:"), p["name"]))
    unknown = F.transform(F.array_except(given, names), label("unknown:"))
    found = F.array_sort(F.concat(missing, types, unknown))
    return F.when(parameters.isNull(), F.array(F.lit("no tool"))).when(given.isNull(), F.array(F.lit("not an object"))).otherwise(found)


def link_tools(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call, and for each identifier that has results but no call.

    calls: conv, id, turn, name, arguments (JSON text), depends (array of ids). results: conv, id, turn, content.
    schemas: name, parameters (array of name, type, required), a row for each tool; repeated names: the first in order.
    Returns conv, id, turn, level, n_results, problems, json. Of calls that repeat an identifier in a conversation the one with the
    smallest (turn, name, arguments) counts; of several results the one with the smallest (turn, content), with their number in
    n_results. Null conversations and identifiers link with nothing. Text that is not JSON is no object. level is null on
    cycles. json has the keys in order, no blanks, and leaves out nulls. Other columns are not read; empty tables give no rows.
    """
    keys = ["conv", "id"]
    calls = calls.select("conv", "id", F.struct("turn", "name", "arguments", F.array_sort(F.array_distinct("depends")).alias("depends")).alias("call"))
    named, unnamed = calls.where("conv is not null and id is not null"), calls.where("conv is null or id is null")
    calls = checkpoint(named.groupBy(*keys).agg(F.min("call").alias("call")).unionByName(unnamed))
    answers = results.select("conv", "id", F.struct("turn", "content").alias("result"))
    known = answers.where("conv is not null and id is not null").groupBy(*keys).agg(F.min("result").alias("result"), F.count(F.lit(1)).alias("n_results"))
    answers = known.unionByName(answers.where("conv is null or id is null").withColumn("n_results", F.lit(1).cast("long")))
    order = levels(calls.select("conv", "id", "call.depends"))
    tools = schemas.groupBy("name").agg(F.min("parameters").alias("parameters"))
    rows = calls.join(order, keys, "left").join(answers, keys, "full_outer").join(tools, F.col("call.name") == F.col("name"), "left")
    arguments = F.try_parse_json("call.arguments")
    found = F.when(F.col("call").isNull(), F.array(F.lit("no call"))).otherwise(problems(arguments, F.col("parameters")))
    written = F.struct(arguments.alias("arguments"), F.col("call.depends").alias("depends"), F.col("id"), F.col("level"), F.col("call.name").alias("name"), F.col("result.content").alias("result"))
    return rows.select("conv", "id", F.coalesce("call.turn", "result.turn").alias("turn"), "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), found.alias("problems"), F.to_json(written).alias("json"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results out of plain turns: a user's turn, and a system's, is a call of the tool named by the role; it depends on the user's turn two before it.

    An assistant's turn is the result of the turn before it. The identifier of a turn is its number.
    """
    turns = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text").distinct()
    text = lambda shift: (F.col("turn") - shift).cast("string")
    asked = turns.where("role is not null and role <> 'assistant'")
    calls = asked.select("conv", text(0).alias("id"), "turn", F.col("role").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.array(text(2)).alias("depends"))
    results = turns.where("role = 'assistant'").select("conv", text(1).alias("id"), "turn", F.col("text").alias("content"))
    return calls, results


def turn_schemas(spark: SparkSession) -> DataFrame:
    fields = "array(named_struct('name', 'text', 'type', 'string', 'required', true), named_struct('name', 'turn', 'type', 'integer', 'required', true))"
    return spark.sql(f"select explode(array('user', 'system')) name, {fields} parameters")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = link_tools(calls, results, turn_schemas(spark))
    return linked.select(F.col("conv").alias("conv_id"), "turn", "id", "level", "n_results", F.concat_ws(",", "problems").alias("problems"), "json")


OP1_SQL = """
with recursive turns as (select distinct conv_id, turn, role, text from conversations),
c as (
  select conv_id, turn, role, text from (
    select *, row_number() over (partition by conv_id, turn order by role, '{' || case when text is null then '' else '"text":' || to_json(text)::varchar || ',' end) k
    from turns where role <> 'assistant' and conv_id is not null and turn is not null) where k = 1
), chain(conv_id, turn, level) as (
  select c.conv_id, c.turn, 0 from c left join c d on d.conv_id = c.conv_id and d.turn = c.turn - 2 where d.turn is null
  union all select c.conv_id, c.turn, chain.level + 1 from chain join c on c.conv_id = chain.conv_id and c.turn = chain.turn + 2
), r as (
  select conv_id, turn - 1 as at, min(text) as content, min(turn) as turn, count(*) as n from turns where role = 'assistant' and conv_id is not null and turn is not null group by all
), rows as (
  select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.turn, r.turn) turn, cast(coalesce(c.turn, r.at) as varchar) id, level, coalesce(n, 0) n_results,
    case when c.turn is null then 'no call' when role not in ('user', 'system') then 'no tool' when text is null then 'missing:text' else '' end problems,
    case when c.turn is null then null else '"arguments":{' || case when text is null then '' else '"text":' || to_json(text)::varchar || ',' end || '"turn":' || c.turn || '},"depends":["' || (c.turn - 2) || '"]' end a,
    case when level is null then null else '"level":' || level end l, case when c.turn is null then null else '"name":' || to_json(role)::varchar end nm, case when content is null then null else '"result":' || to_json(content)::varchar end rs
  from (c left join chain using (conv_id, turn)) full outer join r on c.conv_id = r.conv_id and c.turn = r.at
)
select conv_id, turn, id, level, n_results, problems, '{' || concat_ws(',', a, '"id":"' || id || '"', l, nm, rs) || '}' as json from rows
"""
