"""Tool-call linking for chat data: calls and results joined by identifier, put in
topological order, validated against schemas and serialised as canonical JSON.

Inputs are three tables. ``calls`` (conversation, call_id, tool, arguments, parents):
arguments is JSON text, parents the identifiers of calls that must come before.
``results`` (call_id, seq, content). ``schemas`` (tool, name, type, required):
the arguments of each tool; type is string, number, boolean, object or array.

* A result belongs to the calls with its identifier. Results are reduced to one row an
  identifier first (the first by seq, and how many there are; map-side), then hash-joined,
  so a hot identifier is never a group in one task. ``link`` shows this digest beside each call;
  ``result_messages`` gives every result as a row of its own, those of no call too; ``linked`` is both.
* ``level`` is the length of the longest chain of known parents (0: none). A parent that is also
  a parent of another parent decides nothing (the longest chain goes through the other) and goes first, so that
  turns which name all of their last few predecessors become plain chains. Calls with one parent
  are placed by pointer jumping, however long the chain; of the others, each round places
  the calls whose parents are all placed, one join and one aggregate over the edges, to the
  fixed point. Sorting a conversation by (level, call_id) is a topological order. Calls on a
  cycle, or after one, have no level and the problem 'cycle'.
* Arguments must be a JSON object with every required name, no name the schema doesn't
  have, and each value (null: absent) of its type; a tool without schema is 'unknown tool'.
* ``message`` is canonical JSON: keys in order of their code points, no white space, numbers
  and escapes in one way. Invalid JSON arguments are kept as a string.

DataFrame expressions only.

Rows: every row of ``calls`` gives one row; a null identifier links and orders nothing (level
0, no result); parents that are no call are ignored; equal rows stay. Empty tables are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custos.llm.decontaminate import small
from custos.llm.scratch import Scratch

# Pairs of parents are formed for calls with at most so many; of others all edges stay.
PAIRED_PARENTS = 8


def needed_edges(edge: DataFrame, need: DataFrame) -> DataFrame:
    """``edge`` (child, parent) without edges to a parent that is a parent of another parent; ``need`` (child, need) has
    the number of parents. Both are tables.

    Identifiers are ordered by length, then text, as numbers are, and an edge goes only if the other parent lies between its
    ends in that order. So each edge that goes is replaced by two shorter ones, and what is reachable, cycles included, stays as it
    is; without cycles the longest chains stay too, as none of them takes a short cut."""
    some = edge.join(need.where(F.col("need").between(2, PAIRED_PARENTS)).select("child"), "child", "left_semi")
    order = lambda c: F.struct(F.length(c), F.col(c))
    pair = some.join(some.withColumnRenamed("parent", "between"), "child").where(
        (order("parent") < order("between")) & (order("between") < order("child")))
    step = edge.select(F.col("child").alias("between"), "parent")
    short = pair.join(step, ["between", "parent"]).select("child", "parent").distinct()
    return edge.join(short, ["child", "parent"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of every identifier that can be placed; call_id and parents as in ``calls``."""
    with Scratch(calls.sparkSession) as s:
        known = calls.where("call_id is not null").select("call_id").distinct()
        edge = calls.select(F.col("call_id").alias("child"), F.explode("parents").alias("call_id")).where(
            "child is not null and call_id is not null").distinct()
        edge = s.table(edge.join(known, "call_id").select("child", F.col("call_id").alias("parent")))
        edge = s.table(needed_edges(edge, s.table(edge.groupBy("child").agg(F.count(F.lit(1)).alias("need")))))
        need = s.table(edge.groupBy("child").agg(F.count(F.lit(1)).alias("need")))
        # calls with one parent hang on it: pointer jumping gives each the first ancestor that doesn't, and how far
        # it is, in rounds that double the distance, so a conversation of thousands of turns takes a dozen rounds
        hang = s.table(edge.join(need.where("need = 1"), "child").select(
            "child", F.col("parent").alias("top"), F.lit(1).alias("far")))
        n = hang.count()
        for _ in range(n.bit_length() + 1):
            over = hang.select(F.col("child").alias("top"), F.col("top").alias("_top"), F.col("far").alias("_far"))
            step = s.table(hang.join(over, "top", "left").select(
                "child", F.coalesce("_top", "top").alias("top"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"),
                F.col("_top").isNotNull().alias("moved")))
            hang = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        # on a circle of such calls there is no such ancestor
        hang = s.table(hang.join(hang.select(F.col("child").alias("top")), "top", "left_anti"), keep=True)
        edge = edge.join(need.where("need > 1"), "child", "left_semi").join(
            hang.select(F.col("child").alias("parent"), "top", "far"), "parent", "left")
        edge = s.table(edge.select("child", F.coalesce("top", "parent").alias("parent"), F.coalesce("far", F.lit(0)).alias("far")))
        every, need = need, s.table(need.where("need > 1"))
        rounds = [s.table(known.join(every, F.col("call_id") == F.col("child"), "left_anti").select(
            "call_id", F.lit(0).alias("level")), keep=True)]
        reached = None  # parents placed so far and their greatest level, of calls that still wait
        while True:
            new = edge.join(rounds[-1].withColumnsRenamed({"call_id": "parent"}), "parent").select(
                "child", F.lit(1).alias("done"), (F.col("level") + F.col("far")).alias("level"))
            both = new if reached is None else new.unionByName(reached)
            now = s.table(both.groupBy("child").agg(F.sum("done").cast("int").alias("done"), F.max("level").alias("level"))
                          .join(need, "child"))
            placed = s.table(now.where("done = need").select(
                F.col("child").alias("call_id"), (F.col("level") + 1).alias("level")), keep=True)
            if placed.isEmpty():
                break
            rounds.append(placed)
            reached = now.where("done < need").select("child", "done", "level")
    placed = reduce(DataFrame.unionByName, rounds)
    return placed.unionByName(hang.join(placed.withColumnRenamed("call_id", "top"), "top").select(
        F.col("child").alias("call_id"), (F.col("level") + F.col("far")).alias("level")))


# what schema_of_variant says of values of each type
_KINDS = {"string": ["STRING"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"],
          "object": ["OBJECT"], "array": ["ARRAY"]}


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conversation, call_id, tool, level, n_results, valid, problems, message), one row for each call."""
    first = results.where("call_id is not null").groupBy(F.col("call_id").alias("_id")).agg(
        F.min(F.struct("seq", "content")).alias("first"), F.count(F.lit(1)).alias("n_results"))
    with Scratch(calls.sparkSession) as s:
        rules = small(s.table(schemas.groupBy(F.col("tool").alias("_tool")).agg(F.sort_array(F.collect_set(
            F.struct("name", "type", "required"))).alias("rules")), keep=True))
    order = levels(calls).select(F.col("call_id").alias("_id"), "level")
    c = calls.select("conversation", "call_id", "tool", "arguments")
    c = c.join(first.hint("shuffle_hash"), F.col("call_id") == F.col("_id"), "left").drop("_id")
    c = c.join(order.hint("shuffle_hash"), F.col("call_id") == F.col("_id"), "left").drop("_id")
    c = c.join(rules, F.col("tool") == F.col("_tool"), "left").drop("_tool")
    c = c.withColumns({"parsed": F.try_parse_json("arguments"),
                       "level": F.when(F.col("call_id").isNull(), 0).otherwise(F.col("level")),
                       "n_results": F.coalesce("n_results", F.lit(0))})
    c = c.withColumn("given", F.expr("try_cast(parsed as map<string, variant>)"))
    kinds = F.transform_values("given", lambda k, v: F.coalesce(_kind(v), F.lit("VOID")))
    c = c.withColumn("kinds", F.map_filter(kinds, lambda k, v: v != "VOID"))
    allowed = F.create_map(*[x for name, kind in _KINDS.items() for x in (F.lit(name), F.array(*map(F.lit, kind)))])
    named = lambda word, names: F.transform(names, lambda x: F.concat(F.lit(f"{word} "), x))
    rule = lambda keep: F.transform(F.filter("rules", keep), lambda r: r["name"])
    of = lambda r: F.try_element_at("kinds", r["name"])
    flag = lambda when, text: F.when(when, F.array(F.lit(text)))
    checked = F.concat(
        named("missing", rule(lambda r: r["required"] & of(r).isNull())),
        named("wrong type", rule(lambda r: of(r).isNotNull() & ~F.coalesce(
            F.array_contains(F.try_element_at(allowed, r["type"]), of(r)), F.lit(False)))),
        named("unexpected", F.array_sort(F.array_except(F.map_keys("given"), F.transform("rules", lambda r: r["name"])))))
    none = F.array().cast("array<string>")
    problems = F.concat(
        F.coalesce(flag(F.col("level").isNull(), "cycle"), none),
        F.coalesce(flag(F.col("kinds").isNull(), "arguments are no object"), none),
        F.coalesce(flag(F.col("rules").isNull(), "unknown tool"), none),
        F.coalesce(checked, none))
    message = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), _quoted(F.col("arguments")), F.lit("null")),
        F.lit(',"id":'), F.coalesce(_quoted(F.col("call_id")), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_quoted(F.col("first.content")), F.lit("null")),
        F.lit(',"tool":'), F.coalesce(_quoted(F.col("tool")), F.lit("null")), F.lit("}"))
    return c.select("conversation", "call_id", "tool", "level", "n_results", problems.alias("problems"),
                    message.alias("message")).withColumn("valid", F.size("problems") == 0)


def result_messages(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(call_id, seq, problems, message), one row for each row of ``results``; sorting by (call_id, seq) gives the
    results of a call in order. A result whose identifier is no call's has the problem 'no such call'."""
    # one row a call on the right, results on the left, so that the results of a hot identifier can be split
    known = calls.where("call_id is not null").select(F.col("call_id").alias("_id")).distinct()
    r = results.select("call_id", "seq", "content")
    both = r.where("call_id is not null").join(known.hint("shuffle_hash"), F.col("call_id") == F.col("_id"), "left").unionByName(
        r.where("call_id is null").withColumn("_id", F.lit(None).cast("string")))
    none = F.array().cast("array<string>")
    message = F.concat(
        F.lit('{"content":'), F.coalesce(_quoted(F.col("content")), F.lit("null")),
        F.lit(',"id":'), F.coalesce(_quoted(F.col("call_id")), F.lit("null")),
        F.lit(',"seq":'), F.coalesce(F.col("seq").cast("string"), F.lit("null")), F.lit("}"))
    return both.select("call_id", "seq", F.when(F.col("_id").isNull(), F.array(F.lit("no such call"))).otherwise(none).alias("problems"),
                       message.alias("message"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls and results as rows of one table: ``kind`` says which; a result has its call's identifier, its ``seq``, its own
    message and problems, and null in the columns that only a call has."""
    of_calls = link(calls, results, schemas).withColumns({"kind": F.lit("call"), "seq": F.lit(None).cast("bigint")})
    of_results = result_messages(calls, results).withColumns({"kind": F.lit("result"), "valid": F.size("problems") == 0})
    return of_calls.unionByName(of_results, allowMissingColumns=True)


def _quoted(text: Column) -> Column:
    """A string as a JSON value; null stays null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, schemas) of a table of turns (conv_id, turn, role, text).

    A system or user turn is a call of the tool of its role with its text and turn as arguments; the
    assistant turn after it is its result, and the call two turns before it is its parent.
    """
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where("role in ('system', 'user')").select(
        F.col("conv_id").alias("conversation"), F.when(known, ident(0)).alias("call_id"), F.col("role").alias("tool"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.when(known, F.array(ident(2), ident(1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    results = turns.where("role = 'assistant'").select(
        F.when(known, ident(1)).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    roles = turns.select("role").where("role in ('system', 'user')").distinct()
    schemas = roles.select(F.col("role").alias("tool"), F.explode(F.array(
        F.struct(F.lit("text").alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required")),
        F.struct(F.lit("turn").alias("name"), F.lit("number").alias("type"), F.lit(True).alias("required")))).alias("r")).select("tool", "r.*")
    return calls, results, schemas
