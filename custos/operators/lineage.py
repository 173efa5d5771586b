"""Lineage: reachability with hop degree, impact, blast radius and graph tables.

Reachability is a semi-naive breadth-first expansion written as DataFrame
joins: each hop joins the newest frontier to the edge table on
``frontier.node = edge.src``, removes (root, node) pairs already reached with
a left-anti join, and each job's result is checkpointed once (persisted, then
a reliable checkpoint in the cluster's shared ``spark.checkpoint.dir``, see
``cut_lineage``), so the plan never grows with the number of hops and a lost executor recomputes at
most one job. Breadth-first order means the first time a pair appears is its
minimum degree; cycles and self-loops terminate because nothing is re-added.
Hot hub nodes are handled by AQE's skew join split; every hop's distinct runs
with map-side partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.functions.joins import small_side
from custos.operators import condense
from custos.operators.assets import clean_assets, owners_dedup
from custos.session import cut_lineage, ensure_checkpoint_dir
from custos.sources.catalog import Catalog

DIRECTIONS = ("DOWNSTREAM", "UPSTREAM")


def _edges(cat: Catalog, direction: str) -> DataFrame:
    """Distinct edges as (direction, src, dst): DOWNSTREAM as stored, UPSTREAM
    reversed, BOTH the two tagged copies (disjoint graphs in one frame)."""
    d = direction.upper()
    if d not in DIRECTIONS + ("BOTH",):
        raise ValueError(f"direction must be UPSTREAM, DOWNSTREAM or BOTH, not {direction!r}")
    e = cat.lineage_edges.select("src", "dst").where(
        F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()
    down = e.select(F.lit("DOWNSTREAM").alias("direction"), "src", "dst")
    up = e.select(F.lit("UPSTREAM").alias("direction"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"DOWNSTREAM": down, "UPSTREAM": up, "BOTH": down.unionByName(up)}[d]


def _tag_roots(roots: DataFrame, direction: str) -> DataFrame:
    """(direction, root) for each requested root and traversal direction."""
    d = direction.upper()
    dirs = DIRECTIONS if d == "BOTH" else (d,)
    r = roots.select("root").distinct()
    return r.select(F.explode(F.array(*[F.lit(x) for x in dirs])).alias("direction"), "root")


HOPS_PER_JOB = 8
K = ["direction", "root", "node"]


def reachability(cat: Catalog, roots: DataFrame | None = None, direction: str = "DOWNSTREAM",
                 max_hops: int | None = None,
                 hops_per_job: int = HOPS_PER_JOB) -> DataFrame:
    """G1: (direction, root, node, degree) for every node reachable from each root.

    ``roots`` is a frame with a ``root`` column (asset ids); ``None`` means every
    asset with an edge is a root (the all-roots form needs a ``max_hops`` bound,
    because the closure can be far larger than the edge list). A rooted call may
    pass ``max_hops=None`` to run to the fixed point. The root itself is never
    part of its own result. ``direction`` BOTH traverses the two directions in
    the same jobs (the direction is part of every key).

    Each Spark job expands up to ``hops_per_job`` levels: every level is a join
    of the previous level to the edges, de-duplicated and anti-joined against
    all pairs already materialised. At the end of the job each new pair keeps
    its minimum degree; pairs first reached at the job's last level are the
    frontier of the next job (pairs reached earlier were already expanded
    inside the job). The result equals a hop-by-hop breadth-first search.
    """
    if roots is None and max_hops is None:
        raise ValueError("the all-roots form needs max_hops")
    spark = cat.spark
    ensure_checkpoint_dir(spark)
    # Every hop re-reads the edge list: materialise its distinct form once.
    edges = cut_lineage(_edges(cat, direction), "edges")
    if roots is None:
        frontier = edges.select("direction", F.col("src").alias("root"), F.col("src").alias("node")).distinct()
    else:
        frontier = _tag_roots(roots, direction).select("direction", "root", F.col("root").alias("node"))
    found: list[DataFrame] = []
    done = 0
    while max_hops is None or done < max_hops:
        k = hops_per_job if max_hops is None else min(hops_per_job, max_hops - done)
        seen = reduce(DataFrame.unionByName, [f.select(*K) for f in found]) if found else None
        level, levels = frontier.select(*K), []
        for i in range(1, k + 1):
            level = (level.join(edges.withColumnRenamed("src", "node"), ["direction", "node"], "inner")
                     .select("direction", "root", F.col("dst").alias("node"))
                     .where(F.col("root") != F.col("node"))
                     .distinct())
            if seen is not None:
                level = level.join(seen, K, "left_anti")
            levels.append(level.withColumn("degree", F.lit(done + i)))
        batch = cut_lineage(reduce(DataFrame.unionByName, levels)
                            .groupBy(*K).agg(F.min("degree").alias("degree")), "reach")
        done += k
        if batch.isEmpty():
            break
        found.append(batch)
        frontier = batch.where(F.col("degree") == done)
        if frontier.isEmpty():
            break
    if not found:
        return spark.createDataFrame([], "direction string, root bigint, node bigint, degree int")
    return reduce(DataFrame.unionByName, found)


def rooted_reachability(cat: Catalog, roots: DataFrame, direction: str = "DOWNSTREAM",
                        max_hops: int | None = None) -> DataFrame:
    """G1 for given roots: breadth-first from the roots over the edges alone, to the
    fixed point unless ``max_hops`` is given."""
    return reachability(cat, roots, direction, max_hops)


def lineage_nodes(cat: Catalog, reach: DataFrame, direction: str | None = None) -> DataFrame:
    """Reached nodes with shallow entity attributes (no owners)."""
    a = clean_assets(cat).select(
        F.col("asset_id").alias("node"), F.col("urn").alias("node_urn"),
        F.col("name").alias("node_name"), "platform", "deprecated")
    return reach.join(a, "node", "inner").select(
        "root", "node", "node_urn", "node_name", F.lit("DATASET").alias("entity_type"),
        "platform", "degree", "deprecated", "direction")


def lineage_root(cat: Catalog) -> DataFrame:
    """The asset to trace when none is named: first unowned asset, else the
    first asset (scan order = asset_id). A top-1 (TakeOrderedAndProject)."""
    a = clean_assets(cat).select("asset_id", "urn")
    owned = owners_dedup(cat).select("asset_id").distinct().withColumn("owned", F.lit(True))
    return (a.join(owned, "asset_id", "left")
            .select(F.col("asset_id").alias("root"), F.col("urn").alias("root_urn"),
                    F.coalesce("owned", F.lit(False)).alias("has_owner"))
            .orderBy("has_owner", "root").limit(1))


def blast_radius_hub(downstream: DataFrame) -> DataFrame:
    """The asset with the largest bounded blast radius (ties: lowest id), as a
    one-row ``root`` frame - a top-1, so no task holds more than its share."""
    return (downstream.orderBy(F.desc("downstream_count"), "asset_id").limit(1)
            .select(F.col("asset_id").alias("root")))


def lineage_totals(cat: Catalog, root: DataFrame, max_hops: int | None = None) -> DataFrame:
    """J7 input: upstream and downstream totals of the traced root (0 when it
    has no lineage at all)."""
    imp = lineage_impact(cat, max_hops, root)
    t = imp.groupBy("root").agg(
        F.count_if(F.col("direction") == "DOWNSTREAM").alias("downstream_total"),
        F.count_if(F.col("direction") == "UPSTREAM").alias("upstream_total"))
    return root.select("root").join(t, "root", "left").select(
        "root", F.coalesce("downstream_total", F.lit(0)).alias("downstream_total"),
        F.coalesce("upstream_total", F.lit(0)).alias("upstream_total"))


def lineage_from_root(cat: Catalog, direction: str = "DOWNSTREAM",
                      max_hops: int | None = None, root: DataFrame | None = None) -> DataFrame:
    """G1 for one root (default: W6's choice), to the fixed point unless bounded."""
    root = lineage_root(cat).select("root") if root is None else root
    reach = rooted_reachability(cat, root, direction, max_hops)
    return lineage_nodes(cat, reach, direction)


def lineage_impact(cat: Catalog, max_hops: int | None = None,
                   root: DataFrame | None = None) -> DataFrame:
    """Both directions for one root in one frame, with per-direction
    totals; the two directions are traversed in the same jobs."""
    root = lineage_root(cat).select("root") if root is None else root
    both = lineage_nodes(cat, rooted_reachability(cat, root, "BOTH", max_hops))
    # one row per root and direction: broadcast, so that no reached row is shuffled by its root
    totals = small_side(both.groupBy("root", "direction").agg(F.count(F.lit(1)).alias("direction_total")))
    return both.join(totals, ["root", "direction"], "inner")


def some_descendants(cat: Catalog, most: int, direction: str = "DOWNSTREAM", among: DataFrame | None = None) -> DataFrame:
    """(node, n): exactly min(``most``, distinct descendants) of every node that has any; of the nodes in ``among``
    alone if given, a frame (node, many) of all nodes with descendants in which ``many`` says that a node is known to have at least ``most``
    and nothing else is asked of it.

    Each level of a breadth-first search adds at least one node until the search is
    over, so a node has ``most`` descendants if and only if it has them within
    ``most`` hops; and no node needs to remember more than ``most`` of them. A round joins the edges
    to at most ``most`` rows a node; the ranked filter runs map-side too, so a hub is never gathered. The rounds end early
    when no node has found more: a node with fewer than ``most`` then has consumers with fewer only, whose rows
    are all they will ever have."""
    edges = _edges(cat, direction).where(F.col("src") != F.col("dst")).select("src", "dst")
    full = None
    if among is not None:
        asked = among.where(~F.col("many")).select(F.col("node").alias("src"))
        more = among.where("many").select(F.col("node").alias("dst"), "many")
        edges = cut_lineage(edges.join(asked.hint("merge"), "src", "left_semi").join(more.hint("merge"), "dst", "left"), "edges")
        # whoever leads to a node with that many has as many: the node itself, and what it reaches but for one
        full = edges.where("many").select(F.col("src").alias("node")).distinct()
        edges = edges.select("src", "dst")
    else:
        edges = cut_lineage(edges, "edges")
    few = Window.partitionBy("node").orderBy("found")
    keep = lambda df: cut_lineage(df.distinct().withColumn("rn", F.row_number().over(few))
                                  .where(F.col("rn") <= most).drop("rn"), "descendants")
    known = keep(edges.select(F.col("src").alias("node"), F.col("dst").alias("found")))
    n = known.count()
    for _ in range(most - 1):
        via = edges.join(known.select(F.col("node").alias("dst"), "found"), "dst").select(
            F.col("src").alias("node"), "found").where("node <> found")
        known = keep(known.unionByName(via))
        before, n = n, known.count()
        if n == before:
            break
    found = known.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    if full is None:
        return found
    return found.join(full.withColumn("full", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("full"), F.lit(most)).otherwise(F.col("n")).cast("bigint").alias("n"))


def descendant_sketches(cat: Catalog, direction: str = "DOWNSTREAM", max_hops: int | None = None,
                        lg_config_k: int = 14) -> DataFrame:
    """(node, n): distinct descendants of every node that has any, from sketches merged along edges.

    reach(u) = N(u) and the reach of every v in N(u), so a round is one join of the
    edges to the sketches that grew in the round before and one sketch union per
    node; it ends when none grows (or after ``max_hops``). A list has grown if its number has; past list mode
    the estimate may stay or fall although registers grew, so the registers themselves are compared. Work is
    proportional to edges times sketch size, never to reachable pairs. Estimates are exact up to about 1,500 descendants
    (the sketch is then a list) and have a relative standard error of 1.04 / sqrt(2 ** lg_config_k)
    beyond (0.8 % by default). A node on a cycle is not counted itself as long as the sketch is a list
    (then the list holds it if it would not grow by it); beyond, one is far below the error."""
    edges = cut_lineage(_edges(cat, direction).where(F.col("src") != F.col("dst")).select("src", "dst"), "edges")
    state = cut_lineage(edges.groupBy(F.col("src").alias("node")).agg(F.hll_sketch_agg("dst", lg_config_k).alias("sk"))
                        .withColumn("n", F.hll_sketch_estimate("sk")), "sketch")
    # DataSketches layout: curMin in byte 6, the mode in the low bits of byte 7 (2: registers, from byte 40)
    is_list = lambda sk: F.conv(F.hex(F.substring(sk, 8, 1)), 16, 10).cast("int").bitwiseAND(F.lit(3)) != 2
    held = lambda sk: F.concat(F.substring(sk, 7, 1), F.substring(sk, 41, 1 << 21))
    grown, hops = state, 1
    while max_hops is None or hops < max_hops:
        via = (edges.join(grown.select(F.col("node").alias("dst"), "sk"), "dst", "inner")
               .groupBy(F.col("src").alias("node")).agg(F.hll_union_agg("sk").alias("via")))
        both = state.join(via, "node", "left").withColumn(
            "new", F.when(F.col("via").isNull(), F.col("sk")).otherwise(F.hll_union("sk", "via")))
        both = cut_lineage(both.select("node", F.col("new").alias("sk"), F.hll_sketch_estimate("new").alias("n"),
                                       F.when(is_list("new"), F.hll_sketch_estimate("new") > F.col("n"))
                                       .otherwise(held("new") != held("sk")).alias("more")), "sketch")
        state, grown, hops = both.select("node", "sk", "n"), both.where("more").select("node", "sk"), hops + 1
        if grown.isEmpty():
            break
    self = edges.groupBy(F.col("src").alias("node")).agg(F.hll_sketch_agg("src", lg_config_k).alias("self"))
    itself = is_list("sk") & (F.hll_sketch_estimate(F.hll_union("sk", "self")) == F.col("n"))
    return state.join(self, "node").select("node", (F.col("n") - F.when(itself, 1).otherwise(0)).alias("n")).where("n > 0")


_RADIUS: dict = {}


def downstream_counts(cat: Catalog, max_hops: int | None = None, direction: str = "DOWNSTREAM",
                      threshold: int = fixed.DOWNSTREAM_THRESHOLD, lg_config_k: int = 14) -> DataFrame:
    """Blast radius of every asset at once, over the whole depth of the graph.

    ``downstream_count`` is exact below ``threshold`` and never below it otherwise, so that "has
    any" and "has at least ``threshold``" are exact for every graph; above, it is the
    number of ``condense.blast_radius``: one sketch a strongly connected component, made level by level
    over the acyclic quotient. With ``max_hops`` (only if the caller names it) it is
    the exact number within that many hops. Assets with no consumers are absent (callers
    left-join and coalesce to 0). Computed once per edge table and reused."""
    key = (id(cat.lineage_edges), direction.upper(), max_hops, threshold, lg_config_k)
    hit = _RADIUS.get(key)
    if hit is None:
        if max_hops is not None:
            counts = reachability(cat, None, direction, max_hops).groupBy(F.col("root").alias("asset_id")).agg(
                F.count(F.lit(1)).alias("downstream_count"))
        else:
            radius = condense.blast_radius(_edges(cat, direction).select("src", "dst"), lg_config_k)
            # a list never shows more than there are, so who has fewer than the threshold shows fewer; of these the exact number is found
            many = F.col("n") >= threshold if threshold <= condense.LIST_ROWS else F.lit(False)
            few = some_descendants(cat, threshold, direction, radius.select("node", many.alias("many"))).withColumnRenamed("n", "few")
            counts = radius.join(few.hint("merge"), "node", "left").select(
                F.col("node").alias("asset_id"), F.when(F.col("few") < threshold, F.col("few")).otherwise(
                    F.greatest(F.col("n"), F.lit(threshold))).cast("bigint").alias("downstream_count"))
        hit = (cat.lineage_edges, cut_lineage(counts, "radius"))
        _RADIUS[key] = hit
    return hit[1]


def lineage_graph(cat: Catalog, max_hops: int | None = None,
                  root: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Node table (id, column, severity, hop text) and star edge table
    (upstream -> root -> downstream) around one root."""
    root = lineage_root(cat).select("root") if root is None else root
    impact = lineage_impact(cat, max_hops, root)
    root_row = small_side(root.select("root").join(clean_assets(cat).select(
        F.col("asset_id").alias("root"), F.col("urn").alias("root_urn")), "root", "inner"))
    side = impact.select(
        F.col("node_urn").alias("id"),
        F.when(F.col("direction") == "UPSTREAM", 0).otherwise(2).alias("column"),
        F.coalesce("node_name", C.short_name("node_urn")).alias("name"),
        F.coalesce("platform", C.platform_from_urn("node_urn")).alias("platform"),
        C.asset_kind("entity_type", F.coalesce("platform", C.platform_from_urn("node_urn"))).alias("kind"),
        F.when(F.col("deprecated"), "high").otherwise("low").alias("severity"),
        F.when(F.col("deprecated"), F.lit(fixed.NODE_DEPRECATED_TEXT))
         .otherwise(C.template(fixed.NODE_HOP_TEXT, entity_type=F.lower("entity_type"),
                               degree=F.coalesce("degree", F.lit(1)))).alias("summary"),
        F.lit(False).alias("is_root"), "direction", "root")
    root_node = root_row.select(
        F.col("root_urn").alias("id"), F.lit(1).alias("column"),
        C.short_name("root_urn").alias("name"), C.platform_from_urn("root_urn").alias("platform"),
        F.lit("dataset").alias("kind"), F.lit("medium").alias("severity"),
        F.lit(fixed.ROOT_NODE_TEXT).alias("summary"),
        F.lit(True).alias("is_root"), F.lit(None).cast("string").alias("direction"), "root")
    nodes = side.unionByName(root_node)
    edges = impact.join(root_row, "root", "inner").select(
        F.when(F.col("direction") == "UPSTREAM", F.concat("node_urn", F.lit("->"), "root_urn"))
         .otherwise(F.concat("root_urn", F.lit("->"), "node_urn")).alias("id"),
        F.when(F.col("direction") == "UPSTREAM", F.col("node_urn")).otherwise(F.col("root_urn")).alias("source"),
        F.when(F.col("direction") == "UPSTREAM", F.col("root_urn")).otherwise(F.col("node_urn")).alias("target"))
    return nodes, edges


def lineage_neighbours(cat: Catalog, node: DataFrame | None = None) -> DataFrame:
    """One-hop neighbourhood of an inspected node: the edges touching it and
    the nodes at their ends (inspected node default: W6's root)."""
    node = lineage_root(cat).select(F.col("root").alias("node")) if node is None else node
    e = cat.lineage_edges.select("src", "dst").distinct()
    touching = (e.join(node, e.src == node.node, "left_semi")
                .unionByName(e.join(node, e.dst == node.node, "left_semi"))).distinct()
    ends = (touching.select(F.col("src").alias("asset_id"))
            .unionByName(touching.select(F.col("dst").alias("asset_id"))).distinct())
    a = clean_assets(cat).select("asset_id", "urn")
    return ends.join(a, "asset_id", "left").select("asset_id", "urn")


def downstream_counts_approx(cat: Catalog, max_hops: int | None = None,
                             direction: str = "DOWNSTREAM", lg_config_k: int = 12) -> DataFrame:
    """G3 from small sketches alone (1.6 % relative standard error)."""
    found = (condense.blast_radius(_edges(cat, direction).select("src", "dst"), lg_config_k) if max_hops is None
             else descendant_sketches(cat, direction, max_hops, lg_config_k))
    return found.select(
        F.col("node").alias("asset_id"), F.col("n").alias("downstream_count"))
