"""Chat formatting: link tool calls with their results, order them, validate them, write canonical JSON.

DataFrame operations only.  Calls and results meet in a hash join on conversation
and identifier, so a long conversation is as many keys as it has calls and never
one group in one task.  Calls are ordered topologically: a call's rank is one more
than the greatest rank of the calls it depends on, found by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import materialize, release

#: Types a schema can ask for, and the variant types that satisfy them.
TYPES = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT.*",
    "array": r"^ARRAY.*",
}
RANK_TABLES = 16  # tables of ranks at most before they become one
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]  # tool -> parameter -> (type, required)


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages (conv_id, turn, role, text) that carry tool traffic as JSON.

    An assistant's text ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``
    makes calls; a text of role tool ``{"tool_call_id", "content"}`` makes a result.
    Other texts, null and malformed ones make neither.
    """
    shape = "struct<tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
    calls = messages.where(F.col("role") == "assistant").select("conv_id", "turn", F.posexplode(F.from_json("text", shape)["tool_calls"]).alias("pos", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"), "turn", "pos")
    answer = F.from_json("text", "struct<tool_call_id: string, content: string>")
    results = messages.where(F.col("role") == "tool").select("conv_id", answer["tool_call_id"].alias("call_id"), answer["content"].alias("content"), "turn")
    return calls, results.where(F.col("call_id").isNotNull())


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a plain conversation: every system and user turn is a call, every assistant turn the result of the turn before.

    A call depends on turn 0's, the conversation's opening, and on that of two turns
    before, so the rank of a conversation's last call is about half its length.  Rows
    without a conv_id, a turn or a known role make neither; a null text is an
    argument that is missing, or a null result.  Texts may be of any length; other
    columns are ignored.
    """
    name = F.when(F.col("role") == "system", "instruct").otherwise("reply")
    asked = turns.where(F.col("role").isin("system", "user") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    ident = lambda t: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    calls = asked.select(
        "conv_id", ident(F.col("turn")).alias("call_id"), name.alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn"))).alias("arguments"),
        F.when(F.col("turn") > 2, F.array(ident(F.lit(0)), ident(F.col("turn") - 2))).when(F.col("turn") > 0, F.array(ident(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        "turn", F.lit(0).alias("pos"),
    )
    said = turns.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return calls, said.select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"), "turn")


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted error strings of a call's arguments (a JSON text) against its tool's schema."""
    value = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.when(F.lit(True), F.array(F.lit("unknown tool")))
    for tool, params in schemas.items():
        found = []
        for p, (kind, required) in sorted(params.items()):
            kept = F.schema_of_variant(F.try_variant_get(value, f"$['{p}']", "variant"))
            there = F.array_contains(keys, p) & kept.isNotNull() & (kept != "VOID")
            found.append(F.when(there & ~kept.rlike(TYPES[kind]), F.lit(f"{p}: not {kind}")).when(~F.coalesce(there, F.lit(False)) & F.lit(required), F.lit(f"{p}: missing")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, params)).cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        errors = F.array_sort(F.concat(F.filter(F.array(*found, F.lit(None).cast("string")), lambda e: e.isNotNull()), extra))
        bad = F.coalesce(value.isNull() | ~F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT"), F.lit(True))
        out = F.when(name == tool, F.when(bad, F.array(F.lit("arguments: not an object"))).otherwise(errors)).otherwise(out)
    return out


def topological_ranks(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, rank) of calls with edges (conv_id, call_id, needs); calls without are rank 0 and not listed.

    A call's rank is the greatest of a floor and of ``rank(other) + steps`` over the
    calls that it waits for.  A call that waits for nothing is ranked by its floor; one
    that waits for one other stands for what that one waits for, so each round
    replaces it wherever it is waited for, and chains halve.  Rounds thus grow with the
    logarithm of a chain's length; a call that waits for several different ones is
    opened when they are ranked or come down to one.  Each round is a written table of
    at most as many rows as the one before.  The rounds end when one ranks no call:
    what is left lies on a cycle or behind one and gets no rank.
    """
    key, waits = ["conv_id", "call_id"], F.col("needs").isNotNull()
    edges = edges.distinct()
    roots = edges.select("conv_id", F.col("needs").alias("call_id")).distinct().join(edges, key, "left_anti")
    none = F.lit(None).cast(edges.schema["needs"].dataType)
    # a row for each call waited for, and a row without one that only holds the floor
    zero = lambda df: df.select(*key, none.alias("needs"), F.lit(0).alias("steps"), F.lit(0).alias("floor"))
    state = materialize(edges.select(*key, "needs", F.lit(1).alias("steps"), F.lit(0).alias("floor")).union(zero(edges.select(*key).distinct())).union(zero(roots)), "waits")
    parts, done = [], None
    while True:
        calls = state.groupBy(*key).agg(F.count("needs").alias("n"), F.max("floor").alias("floor"), F.max("needs").alias("needs"), F.max("steps").alias("steps"))
        ranked = materialize(calls.where("n = 0").select(*key, F.col("floor").alias("rank")), "ranks")
        if ranked.isEmpty():
            break
        parts.append(ranked)
        done = ranked if done is None else done.union(ranked)
        # all that is ranked by now: a call may come to wait for one that was ranked rounds ago
        stands = done.select("conv_id", F.col("call_id").alias("needs"), F.lit(0).cast("long").alias("thin"), F.col("rank").alias("f"), none.alias("further"), F.lit(0).alias("s"))
        stands = stands.union(calls.where("n = 1").select("conv_id", "call_id", "n", "floor", "needs", "steps"))
        step = state.join(ranked, key, "left_anti").join(stands, ["conv_id", "needs"], "left")
        floor = F.when(F.col("thin").isNotNull(), F.greatest("floor", F.col("f") + F.col("steps"))).otherwise(F.col("floor"))
        step = step.select(*key, F.when(F.col("thin").isNull(), F.col("needs")).otherwise(F.col("further")).alias("needs"), F.when(F.col("thin") == 1, F.col("steps") + F.col("s")).otherwise(F.col("steps")).alias("steps"), floor.alias("floor"))
        fresh = materialize(step.groupBy(*key, "needs").agg(F.max(F.when(waits, F.col("steps")).otherwise(0)).alias("steps"), F.max("floor").alias("floor")), "waits")
        release(state)
        state = fresh
        if len(parts) == RANK_TABLES:  # a union of a table a round would outgrow the planner
            done = materialize(done, "ranks")
            release(*parts)
            parts = [done]
    if done is None:
        return state.select(*key, F.col("floor").alias("rank")).where("false")
    return done.where("rank > 0")


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row a call, and one a result without a call: (conv_id, call_id, rank, turn, status, errors, line).

    status: ``linked``; ``unanswered`` (no result); ``invalid`` (errors says why);
    ``duplicate`` (a later call of a used identifier); ``cycle`` (no order exists);
    ``orphan`` (a result of no call).  The first of these that applies counts, in the order
    duplicate, cycle, invalid, unanswered.  Of several results of one call the
    earliest counts.  A call without an identifier is invalid; calls that are equal
    in identifier, turn and position are told as often as they occur.  What a call needs and no call provides is an error.
    line is canonical JSON: keys sorted at every depth, no spaces, values as
    parsed; an argument text that isn't JSON appears as a string.  A call with an
    answer has the key result, which is null where the content is; one without has
    not.  rank and turn order a conversation's lines.  Columns of calls (conv_id,
    call_id, name, arguments, depends_on, turn, pos) and results (conv_id, call_id,
    content, turn) beyond these are ignored; empty tables give an empty one.
    """
    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "name", "arguments", "depends_on", "turn", "pos")
    results = results.select(*key, "content", "turn")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    # the first call of an identifier, by aggregation: no window over a conversation
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "pos")).alias("at"))
    calls = calls.join(first, key, "left").withColumn("duplicate", ~F.coalesce((F.col("turn") == F.col("at.turn")) & (F.col("pos") == F.col("at.pos")), F.lit(False)) & named).drop("at")
    answer = results.groupBy(*key).agg(F.min_by(F.struct("content", F.col("turn").alias("t")), F.struct("turn", "content")).alias("answer"))
    needs = materialize(calls.where("not duplicate").select(*key, F.explode(F.array_distinct("depends_on")).alias("needs")), "needs")
    there = first.select("conv_id", F.col("call_id").alias("needs"))
    lost = needs.join(there, ["conv_id", "needs"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set(F.concat("needs", F.lit(": no such call")))).alias("lost"))
    known = needs.join(there, ["conv_id", "needs"], "left_semi")
    ranks = topological_ranks(known.select("conv_id", "call_id", "needs"))
    waits = known.select(*key).distinct().withColumn("waits", F.lit(True))
    joined = calls.join(answer, key, "left").join(ranks, key, "left").join(waits, key, "left").join(lost, key, "left")
    rank = F.coalesce("rank", F.when(F.col("waits").isNull(), 0)).cast("long")
    none = F.array().cast("array<string>")
    errors = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.coalesce("lost", none), F.when(named, none).otherwise(F.array(F.lit("id: missing"))))
    status = F.when(F.col("duplicate"), "duplicate").when(rank.isNull(), "cycle").when(F.size(errors) > 0, "invalid").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    parsed = F.coalesce(F.try_parse_json("arguments"), F.try_variant_get(F.try_parse_json(F.to_json(F.array("arguments"))), "$[0]", "variant"))
    told_call = [parsed.alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name")]
    nulls = {"ignoreNullFields": "false"}
    line = F.when(F.col("answer").isNull(), F.to_json(F.struct(*told_call), nulls)).otherwise(F.to_json(F.struct(*told_call, F.col("answer.content").alias("result")), nulls))
    told = joined.select(*key, rank.alias("rank"), "turn", status.alias("status"), errors.alias("errors"), line.alias("line"))
    orphan = results.join(first.select(*key), key, "left_anti").select(
        *key, F.lit(None).cast("long").alias("rank"), "turn", F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), nulls).alias("line"),
    )
    return told.unionByName(orphan)
