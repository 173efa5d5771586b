"""Mixing sources to target weights by hierarchical budgeting.

Documents lie in the leaves of a tree, such as domain > language > source. Every
node has a target weight among its siblings. A token budget is handed down level
by level. A node can use at most its capacity (the tokens below it times
``max_epochs``); what a node cannot use goes to its siblings in proportion to
their weights, and only what a whole subtree cannot use goes to its ancestor's
siblings: capacities are those of subtrees, so a parent never gets more than its
children can take. Among siblings this is water-filling: children sorted by
capacity over weight; those before the first that does not saturate get their
capacity, the others share the rest by weight (integers, rounded down).

In a leaf with T tokens and budget B every document is taken floor(B / T) times,
and the next epoch gives the longest prefix, in the epoch's own seeded order,
whose tokens fit the remainder. The order is by an md5 of seed, epoch and
doc_id. No leaf is sorted as a whole: leaves are cut into hash buckets of some
thousand documents, bucket sums (aggregated map-side) give the one bucket in
which the prefix ends, and only this bucket is ordered. Each leaf then keeps one
boundary; documents are compared with it without a shuffle.

DataFrame expressions only. Budgets and boundaries are one row a leaf,
broadcast if their count stays below a bound, shuffle-joined beyond it.

Rows: null in a level is a leaf of its own (weight by its null row, or the
default 1); null or wordless texts have no tokens and follow their leaf's full
epochs and prefix; rows that share a doc_id (or an equal text without doc_id)
are in or out together; a leaf without tokens gets no budget.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custos.llm.decontaminate import small
from custos.llm.scratch import Scratch, fresh

BUCKET_ROWS = 4096


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def budgets(leaves: DataFrame, levels: list[str], budget: int, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens, and one integer weight column w_<level> per level) with
    the leaf's ``budget``. A node's weight is the greatest its leaves state."""
    big = "decimal(38,0)"
    zero = F.lit(0).cast(big)
    given = None
    for depth, level in enumerate(levels):
        path, above = levels[:depth + 1], levels[:depth]
        child = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast(big).alias("cap"),
                                          F.max(f"w_{level}").cast(big).alias("w")).where("cap > 0 and w > 0")
        if given is None:
            child = child.withColumn("share", F.lit(budget).cast(big))
        else:
            same = reduce(Column.__and__, [child[c].eqNullSafe(given[f"_{c}"]) for c in above])
            child = child.join(given, same).drop(*[f"_{c}" for c in above])
        part = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = part.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), F.col(level).asc_nulls_first())
        child = child.withColumns({
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), zero).cast(big),
            "after": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(big)})
        child = child.withColumn("full", F.expr("cap * after <= (share - before) * w"))
        child = child.withColumns({
            "full_cap": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(part).cast(big),
            "open_w": F.sum(F.when(F.col("full"), zero).otherwise(F.col("w"))).over(part).cast(big)})
        got = F.expr("case when full then cap else cast(((share - full_cap) * w) div open_w as decimal(38,0)) end")
        given = child.select(*[F.col(c).alias(f"_{c}") for c in path], got.alias("share"))
    same = reduce(Column.__and__, [leaves[c].eqNullSafe(given[f"_{c}"]) for c in levels])
    return leaves.join(given, same, "left").select(
        *[leaves[c] for c in leaves.columns], F.coalesce("share", F.lit(0)).cast("bigint").alias("budget"))


def name_of(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))


def place_of(seed: str, epoch: Column, name: Column) -> Column:
    """Place of a document in an epoch: an md5 as 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), name))


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], tokens: int | None = None,
        percent: int = 100, max_epochs: int = 4, seed: str = "0") -> DataFrame:
    """Every row of ``docs`` that is taken at least once, with ``n_tokens``, ``copies`` (how
    often it is taken) and ``leaf_budget`` (under other names if the input has these).

    ``levels`` names the tree's levels from the top, each an expression over ``docs``;
    ``weights`` gives an integer expression over the levels for each. The budget is
    ``tokens``, or ``percent`` per cent of the tokens that there are.
    """
    names, path = fresh(docs, "n_tokens", "copies", "leaf_budget"), list(levels)
    with Scratch(docs.sparkSession) as s:
        slim = s.table(docs.select(*[x.alias(c) for c, x in levels.items()], n_words("text").alias("tokens"),
                                   name_of(F.col("doc_id"), F.col("text")).alias("name")))
        leaf = s.table(slim.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")).select(
            *path, "tokens", "n_docs", *[weights[c].cast("bigint").alias(f"w_{c}") for c in path]))
        have = leaf.agg(F.sum("tokens")).first()[0] or 0
        leaf = budgets(leaf, path, have * percent // 100 if tokens is None else tokens, max_epochs)
        leaf = s.table(leaf.select(
            *[F.col(c).alias(f"_{c}") for c in path], F.xxhash64(*path).alias("leaf"), "budget",
            F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0)).alias("whole"),
            F.coalesce(F.expr("budget % nullif(tokens, 0)"), F.lit(0)).alias("rest"),
            F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("buckets")))
        same = reduce(Column.__and__, [slim[c].eqNullSafe(leaf[f"_{c}"]) for c in path])
        # an 8-digit prefix of the place, cut into as many even ranges as the leaf has buckets
        bucket = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") * F.col("buckets") / F.lit(1 << 32))
        at = slim.join(small(leaf), same).withColumn("place", place_of(seed, F.col("whole"), F.col("name"))).select(
            "leaf", "rest", "place", "tokens", bucket.alias("bucket"))
        sums = at.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
        sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("leaf").orderBy("bucket")) - F.col("sum"))
        # the prefix ends in the first bucket that it doesn't hold whole ...
        last = s.table(sums.where("before + sum > rest").groupBy("leaf").agg(
            F.min(F.struct("bucket", "before")).alias("end")).select(
            F.col("leaf").alias("l"), F.col("end.bucket").alias("b"), F.col("end.before").alias("before")))
        # ... before the first document that doesn't fit; documents at equal places go together
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("place"))
        stop = at.join(small(last), (at["leaf"] == F.col("l")) & (at["bucket"] == F.col("b"))).withColumn(
            "upto", upto).where("upto > rest").groupBy("leaf").agg(F.min("place").alias("stop"))
        plan = s.table(leaf.join(stop, "leaf", "left").select(F.struct("*").alias("_plan")), keep=True)
    plan = small(plan)
    same = reduce(Column.__and__, [x.eqNullSafe(F.col(f"_plan._{c}")) for c, x in levels.items()])
    place = place_of(seed, F.col("_plan.whole"), name_of(docs["doc_id"], docs["text"]))
    part = F.when((F.col("_plan.rest") > 0) & (place < F.col("_plan.stop")), 1).otherwise(0)
    return docs.join(plan, same).withColumns({
        names[0]: n_words(docs["text"]), names[1]: F.col("_plan.whole") + part,
        names[2]: F.col("_plan.budget")}).where(F.col(names[1]) > 0).drop("_plan")
