"""Blast radius on any graph: strongly connected components, then one pass over the acyclic quotient.

Nodes on a common cycle reach the same nodes, so they share one sketch. ``components`` finds them; between components
the graph has no cycle, and each component's *level* is its longest path to a component without consumers. A sketch of all
that lies at or below a component is made level by level: a level reads its own edges (a folder a level) and the
sketches of the levels these lead to, and each sketch is written once, when it is final. Nothing is written again in a later round.

The number of a node's descendants is the estimate of the union of its component's consumers' sketches, plus the other members of its
component, which are counted, not estimated. A node never counts itself, on a cycle or not.

Rounds: levels take one round for each step of the longest path; parts of the graph that reach no cycle are placed in the same
rounds and need no search for components. For the rest, nodes off every cycle are trimmed round by round, runs of nodes with
one edge in and one out are contracted by pointer jumping (a cycle of n nodes takes log n rounds), and what is left is split by
forward-backward colouring: the greatest identifier that reaches a node is its colour, and the members of a colour that reach
the node it is named after are a component. Rounds of the colouring follow the diameter of the contracted graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custos.functions.tables import Workspace

# Up to so many nodes a sketch is a list and its estimate their number; it shows fewer only if two of them share their hash.
LIST_ROWS = 1000


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def levels(edges: DataFrame, w: Workspace) -> DataFrame:
    """(node, level) of the nodes from which no cycle is reached: the longest path to a node without edges out.
    ``edges`` (src, dst) is a table of distinct edges. A round joins the edges to the nodes placed in the round before; rows
    carried over are those of nodes that still wait for some of their edges. Every edge carries the number of edges of its source,
    so that no round joins (and no driver sends round) a table of these numbers."""
    need = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    last = w.table(edges.select(F.col("dst").alias("node")).distinct().join(need.select("node").hint("merge"), "node", "left_anti"))
    edges = w.table(edges.join(need.withColumnRenamed("node", "src").hint("merge"), "src"))
    rounds, waiting, level = [last.withColumn("level", F.lit(0))], None, 0
    while not last.isEmpty():
        level += 1
        done = edges.join(last.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(
            F.count(F.lit(1)).alias("done"), F.max("need").alias("need"))
        if waiting is not None:
            done = done.unionByName(waiting).groupBy("node").agg(F.sum("done").alias("done"), F.max("need").alias("need"))
        now = w.table(done)
        last, waiting = now.where("done = need").select("node"), now.where("done < need").select("node", "done", "need")
        rounds.append(last.withColumn("level", F.lit(level)))
    return _union(rounds[:-1]) if len(rounds) > 1 else rounds[0]


def _trimmed(edges: DataFrame, w: Workspace) -> DataFrame:
    """``edges`` without nodes that have no edge in or no edge out, again and again."""
    while True:
        kept = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(
            edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        n, kept = edges.count(), w.table(kept)
        if kept.count() == n:
            return kept
        edges = kept


def _contracted(edges: DataFrame, w: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chains, rings): runs of nodes with one edge in and one out become one edge. ``chains`` (node, head, tail) are
    the nodes of a run and its ends; ``rings`` (node, component) are runs closed in themselves."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("next"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("prev"))
    # next is the first node of a run's end found so far, least the smallest identifier on the way; the same backwards
    run = w.table(out.join(into, "node").where("n_out = 1 and n_in = 1").select(
        "node", F.col("next").alias("tail"), F.col("prev").alias("head"), F.col("node").alias("least")))
    n = run.count()
    for _ in range(max(1, n.bit_length())):
        ahead = run.select(F.col("node").alias("tail"), F.col("tail").alias("_tail"), F.col("least").alias("_least"))
        back = run.select(F.col("node").alias("head"), F.col("head").alias("_head"))
        run = w.table(run.join(ahead, "tail", "left").join(back, "head", "left").select(
            "node", F.coalesce("_tail", "tail").alias("tail"), F.coalesce("_head", "head").alias("head"),
            F.least("least", F.coalesce("_least", "least")).alias("least")))
    inner = run.select(F.col("node").alias("tail"))
    rings = w.table(run.join(inner, "tail", "left_semi").select("node", F.col("least").alias("component")))
    chains = w.table(run.join(inner, "tail", "left_anti").select("node", "head", "tail"))
    inside = run.select("node")
    rest = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(
        inside.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    short = chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return w.table(rest.unionByName(short).distinct()), chains, rings


def _spread(edges: DataFrame, start: DataFrame, w: Workspace) -> DataFrame:
    """(node, colour): the greatest colour that reaches each node; ``start`` (node, colour) has all nodes. A round pushes
    the colours that changed, and only changed rows are written."""
    tables, grown, turn = [start.withColumn("turn", F.lit(0))], start, 0
    while True:
        turn += 1
        new = edges.join(grown.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("colour"))
        have = _union(tables).join(new.select("node"), "node", "left_semi").groupBy("node").agg(F.max("colour").alias("was"))
        grown = w.table(new.join(have, "node").where("colour > was").select("node", "colour"))
        if grown.isEmpty():
            return w.table(_union(tables).groupBy("node").agg(F.max("colour").alias("colour")))
        tables.append(grown.withColumn("turn", F.lit(turn)))


def components(edges: DataFrame, w: Workspace) -> DataFrame:
    """(node, component) of the nodes on cycles; the component is its least node. ``edges``: distinct (src, dst), src <> dst."""
    edges, chains, rings = _contracted(_trimmed(edges, w), w)
    found: list[DataFrame] = []
    while True:
        edges = _trimmed(edges.where("src <> dst"), w)
        if edges.isEmpty():
            break
        nodes = edges.select(F.col("src").alias("node")).distinct()
        colour = _spread(edges, w.table(nodes.withColumn("colour", F.col("node"))), w)
        ends = [colour.select(F.col("node").alias(x), F.col("colour").alias(f"c_{x}")) for x in ("src", "dst")]
        same = w.table(edges.join(ends[0], "src").join(ends[1], "dst").where("c_src = c_dst").select("src", "dst"))
        # backwards from the node a colour is named after, inside the colour
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        inside = w.table(colour.where("node = colour"))
        parts, last = [inside], inside
        while True:
            reached = back.join(last.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour").distinct()
            last = w.table(reached.join(_union(parts).select("node"), "node", "left_anti"))
            if last.isEmpty():
                break
            parts.append(last)
        group = w.table(_union(parts))
        found.append(group)
        gone = group.select("node")
        edges = w.table(same.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(
            gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    none = rings.where(F.lit(False)).select("node", F.col("component").alias("colour"))
    group = w.table(_union(found) if found else none)
    # a run belongs to the component of its ends if both lie in the same one (or are the same node)
    head = group.select(F.col("node").alias("head"), F.col("colour").alias("c_head"))
    tail = group.select(F.col("node").alias("tail"), F.col("colour").alias("c_tail"))
    runs = w.table(chains.join(head, "head", "left").join(tail, "tail", "left").select(
        "node", "head", F.coalesce("c_head", "head").alias("c_head"), F.coalesce("c_tail", "tail").alias("c_tail")).where("c_head = c_tail"))
    closed = group.unionByName(runs.select("node", F.col("c_head").alias("colour"))).unionByName(
        runs.select(F.col("head").alias("node"), F.col("c_head").alias("colour"))).distinct()
    size = closed.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return closed.join(size, "colour").select("node", "component").unionByName(rings)


def blast_radius(edges: DataFrame, lg_config_k: int = 14) -> DataFrame:
    """(node, n): distinct descendants of every node that has any. ``edges`` (src, dst): any graph, repeats, loops and nulls
    allowed. Exact while a sketch is a list (up to about 1,500 nodes outside the own component), beyond with a relative standard
    error of 1.04 / sqrt(2 ** lg_config_k)."""
    return sketches(edges, lg_config_k, columns=("node", "n")).where("n > 0")


def sketches(edges: DataFrame, lg_config_k: int = 14, known: DataFrame | None = None,
             columns: tuple[str, ...] = ("node", "n", "sketch")) -> DataFrame:
    """(node, n, sketch) of every node: its number of descendants, and the sketch of all that lies at or below its component.

    ``known`` (node, sketch) are results for nodes whose edges aren't given (nor needed): only nodes with edges in ``edges`` are
    computed then, and those known end the paths that lead to them."""
    with Workspace(edges.sparkSession) as w:
        edges = w.table(edges.where("src <> dst").select("src", "dst").distinct())
        level = w.table(levels(edges, w))
        open_ = w.table(edges.join(level.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti"))
        # nodes that reach a cycle are left: only among these can components be
        left = open_.join(level.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst")
        if open_.isEmpty():
            member, quotient = None, edges
        else:
            member = w.table(components(w.table(left), w), keep=True)
            of = lambda x: member.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
            quotient = w.table(edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left").select(
                F.coalesce("c_src", "src").alias("src"), F.coalesce("c_dst", "dst").alias("dst")).where("src <> dst").distinct())
            alone = member.select(F.col("component").alias("node")).distinct().join(
                quotient.select(F.col("src").alias("node")).unionByName(quotient.select(F.col("dst").alias("node"))), "node", "left_anti")
            level = w.table(levels(quotient, w).unionByName(alone.withColumn("level", F.lit(0))))
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        if member is not None:
            nodes = nodes.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            nodes = nodes.withColumn("component", F.col("node"))
        own = nodes.groupBy("component").agg(F.hll_sketch_agg("node", lg_config_k).alias("own"), F.count(F.lit(1)).alias("size"))
        if known is not None:
            # a known node has no edge here, so it is a component of its own at level 0
            own = own.join(known.select(F.col("node").alias("component"), F.col("sketch").alias("_known")), "component", "left").select(
                "component", F.when(F.col("size") == 1, F.coalesce("_known", "own")).otherwise(F.col("own")).alias("own"), "size")
        tell = "sketch" in columns  # then the tables of the levels are the result: no sketch is moved or written again
        own = w.table(own.join(level.withColumnRenamed("node", "component").hint("merge"), "component"), "level", keep=tell)
        at = lambda x: level.select(F.col("node").alias(x), F.col("level").alias(f"{x}_level")).hint("merge")
        steps = w.table(quotient.join(at("src"), "src").join(at("dst"), "dst"), "src_level")
        # which levels lead to which: at most as many pairs as levels squared
        leads: dict[int, list[int]] = {}
        for a, b in steps.select("src_level", "dst_level").distinct().collect():
            leads.setdefault(a, []).append(b)
        done = {0: own.where("level = 0").select("component", "size", F.lit(0).cast("bigint").alias("below"), F.col("own").alias("sketch"))}
        for i in sorted(leads):
            below = _union([done[j].select(F.col("component").alias("dst"), "sketch") for j in leads[i]])
            under = steps.where(F.col("src_level") == i).join(below, "dst").groupBy(F.col("src").alias("component")).agg(
                F.hll_union_agg("sketch").alias("under"))
            done[i] = w.table(own.where(F.col("level") == i).join(under, "component").select(
                "component", "size", F.hll_sketch_estimate("under").alias("below"), F.hll_union("under", "own").alias("sketch")), keep=tell)
        count = {i: d.select("component", "size", (F.col("size") - 1 + F.col("below")).alias("n"), "sketch") for i, d in done.items()}
        # a node off every cycle is its component; one at level 0 has no edges
        found = [d.where((F.col("size") == 1) & F.lit(i > 0 or known is None)).select(F.col("component").alias("node"), "n", "sketch") for i, d in count.items()]
        if member is not None:
            shared = _union(list(count.values())).where("size > 1").hint("merge")
            found.append(member.join(shared, "component").select("node", "n", "sketch"))
        found = _union(found).select(*columns)
        return found if tell else w.table(found, keep=True)
