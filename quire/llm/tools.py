"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON.

Calls and results meet by identifier in a hash join. A call may come after one other call; its position is the length of
that chain, found by pointer doubling, so the number of joins grows with the logarithm of the longest chain and no task
holds a whole conversation. Arguments are parsed as variants, checked field by field against the schema of the call's
name, and written with sorted keys and no spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import settled, table

#: For each call name, its fields: (kind of value, whether it must be there).
Schemas = dict[str, dict[str, tuple[str, bool]]]

CHAT = {name: {"query": ("STRING", True), "turn": ("BIGINT", True)} for name in ("user", "system", "tool")}


def quoted_json(text: Column) -> Column:
    """A text as a JSON string, null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def validated(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """Whether arguments (a variant) have the fields that the schema of the name asks for, and no others."""
    result = F.lit(False)
    for known, fields in schemas.items():
        ok = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False))
        for field, (kind, needed) in fields.items():
            got = F.schema_of_variant(F.try_variant_get(arguments, f"$['{field}']", "variant"))
            absent = got.isNull() | (got == "VOID")
            ok &= (got == kind) | (absent & F.lit(not needed))
        names = F.json_object_keys(F.to_json(arguments))
        ok &= F.size(F.array_except(names, F.array(*[F.lit(f) for f in fields]))) == 0
        result = F.when(name == known, F.coalesce(ok, F.lit(False))).otherwise(result)
    return result


def positions(calls: DataFrame) -> DataFrame:
    """(id, position) of calls (id, after): 0 for the first of a chain; null on and behind a ring of calls."""
    ids = calls.select("id")
    parents = calls.where("after is not null").join(ids.select(F.col("id").alias("after")), "after", "left_semi")
    at = settled(ids.join(parents.select("id", F.col("after").alias("up")), "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("d")))
    rounds = max(1, at.count().bit_length())
    for _ in range(rounds + 1):
        open_ = at.where("up is not null")
        if open_.isEmpty():
            break
        above = at.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"))
        at = settled(at.join(above, "up", "left").select("id", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    return at.select("id", F.when(F.col("up").isNull(), F.col("d")).alias("position"))


def _json_of(fields: dict[str, Column]) -> Column:
    """One JSON object of keys, given in order, with values that are JSON texts."""
    parts = [F.concat(F.lit(("{" if i == 0 else ",") + f'"{k}":'), v) for i, (k, v) in enumerate(fields.items())]
    return F.concat(*parts, F.lit("}"))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """id, kind, name, position, valid, n_results, json: every call and every result, linked by identifier.

    ``calls`` has id, name, arguments (JSON text) and after (the id of the call it follows, or null); ``results`` has id
    and content. Kinds of rows:

    * ``call``, one per identifier, with the least of its results: of calls with one id the least (by name, arguments, after);
      ``n_results`` counts all results of the id;
    * ``conflict``: another call of an id that is taken, without position and results, never valid;
    * ``further``: another result of a call; ``orphan``: a result without a call. ``n_results`` counts its copies.

    Equal calls, and equal results of an id, are one. Arguments that aren't JSON are invalid and written as null;
    those of an unknown or null name are invalid but written. A call that follows an unknown one is first, one on or behind a ring
    has no position. Calls and results with a null id link with nothing and are left out. Other columns are ignored, texts
    may be of any length, and empty tables give no rows.
    """
    least = F.min(F.struct("name", "arguments", "after")).alias("c")
    one = settled(calls.where("id is not null").groupBy("id").agg(least).select("id", "c.name", "c.arguments", "c.after"))
    taken = one.select("id", F.struct("name", "arguments", "after").alias("c"))
    same = F.struct("name", "arguments", "after").eqNullSafe(F.col("c"))
    conflicts = calls.select("id", "name", "arguments", "after").distinct().join(taken, "id").where(~same).drop("c")
    given = settled(results.where("id is not null").groupBy("id", "content").agg(F.count(F.lit(1)).alias("n")))
    firsts = given.groupBy("id").agg(F.min("content").alias("content"), F.sum("n").alias("n_results"))

    def written(rows: DataFrame, kind: str) -> DataFrame:
        rows = rows.withColumn("v", F.try_parse_json("arguments"))
        arguments, place = F.coalesce(F.to_json("v"), F.lit("null")), F.coalesce(F.col("position").cast("string"), F.lit("null"))
        text = {"arguments": arguments, "id": quoted_json(F.col("id")), "name": quoted_json(F.col("name")), "position": place, "result": quoted_json(F.col("content"))}
        valid = validated(F.col("v"), F.col("name"), schemas) if kind == "call" else F.lit(False)
        return rows.select("id", F.lit(kind).alias("kind"), "name", "position", valid.alias("valid"), F.coalesce("n_results", F.lit(0)).alias("n_results"), _json_of(text).alias("json"))

    linked = written(one.join(positions(one), "id").join(firsts, "id", "left"), "call")
    nothing = conflicts.select("*", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("n_results"))
    known = one.select("id", F.lit(True).alias("known"))
    others = given.join(firsts.select("id", F.col("content").alias("first")), "id").join(known, "id", "left")
    others = others.where(F.col("known").isNull() | ~F.col("content").eqNullSafe(F.col("first")))
    kind = F.when(F.col("known"), "further").otherwise("orphan")
    text = {"id": quoted_json(F.col("id")), "kind": quoted_json(kind), "result": quoted_json(F.col("content"))}
    none = [F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("position", "long"), ("valid", "boolean"))]
    loose = others.select("id", kind.alias("kind"), *none, F.col("n").alias("n_results"), _json_of(text).alias("json"))
    return linked.unionByName(written(nothing, "conflict")).unionByName(loose)


def chat_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain chats: each turn of another role than the assistant's calls for the next turn.

    The call of turn t has the id ``conversation:t``, and follows that of the turn before, or else of the one before that.
    The assistant's turn t is a result of the call of turn t - 1.
    """
    rows = conversations.where("conv_id is not null and turn is not null")

    def name(shift: int) -> Column:
        return F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))

    asks = ~F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = rows.where(asks).select(
        name(0).alias("id"), F.col("role").alias("name"), name(1).alias("before"), name(2).alias("earlier"),
        F.concat(F.lit('{"query":'), quoted_json(F.col("text")), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}")).alias("arguments"),
    )
    known = calls.select("id").distinct()
    calls = calls.join(known.withColumnRenamed("id", "before").withColumn("b", F.lit(True)), "before", "left")
    calls = calls.select("id", "name", "arguments", F.when(F.col("b"), F.col("before")).otherwise(F.col("earlier")).alias("after"))
    return calls, rows.where(~asks).select(name(1).alias("id"), F.col("text").alias("content"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_calls(*chat_calls(table(spark, sf_dir, "conversations")), CHAT)


SQL = {
    "op3_tool_calls": """
with recursive asked as (
  select conv_id, turn, conv_id || ':' || turn id, role, text from conversations
  where conv_id is not null and turn is not null and role is distinct from 'assistant'),
args as (select *, '{"query":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"turn":' || turn || '}' arguments from asked),
calls as (
  select id, any_value(conv_id) conv_id, any_value(turn) turn, (min({'r': role, 'a': arguments})).r as name, (min({'r': role, 'a': arguments})).a as arguments
  from args group by id),
parents as (
  select c.id, coalesce(p.id, q.id) up from calls c
  left join calls p on p.conv_id = c.conv_id and p.turn = c.turn - 1
  left join calls q on q.conv_id = c.conv_id and q.turn = c.turn - 2),
depth as (
  select id, cast(0 as bigint) "position" from parents where up is null
  union all select p.id, d."position" + 1 from parents p join depth d on p.up = d.id),
given as (
  select conv_id || ':' || (turn - 1) id, text content, count(*) n from conversations
  where conv_id is not null and turn is not null and role = 'assistant' group by 1, 2),
results as (select id, min(content) content, cast(sum(n) as bigint) n from given group by 1),
conflicts as (
  select distinct a.id, a.role as name, a.arguments from args a join calls c using (id) where a.role is distinct from c.name or a.arguments is distinct from c.arguments)
select c.id, 'call' kind, c.name, d."position", c.name in ('user', 'system', 'tool') and not contains(c.arguments, '{"query":null,') valid, coalesce(r.n, 0) n_results,
  '{"arguments":' || c.arguments || ',"id":"' || c.id || '","name":"' || c.name || '","position":' || d."position" || ',"result":'
  || coalesce(cast(to_json(r.content) as varchar), 'null') || '}' json
from calls c join depth d using (id) left join results r using (id)
union all select id, 'conflict', name, null, false, 0, '{"arguments":' || arguments || ',"id":"' || id || '","name":"' || name || '","position":null,"result":null}' from conflicts
union all select g.id, case when c.id is null then 'orphan' else 'further' end, null, null, null, g.n,
  '{"id":"' || g.id || '","kind":"' || case when c.id is null then 'orphan' else 'further' end || '","result":' || coalesce(cast(to_json(g.content) as varchar), 'null') || '}'
from given g join results r using (id) left join calls c using (id) where c.id is null or g.content is distinct from r.content
"""
}
