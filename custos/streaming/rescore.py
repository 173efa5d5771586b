"""Incremental rescore (X6): after a batch of changes only the assets it can affect are scored again.

A change of an asset's own metadata affects that asset. A changed lineage edge affects its source and all of the source's
ancestors, whose blast radius it may change; nobody else's. So the *affected* assets of a batch are the changed ones plus a
backward search from the sources of changed edges. For these alone

* descendants are found again, from the edges that leave them and the stored results of the nodes these lead to
  (``condense.sketches`` and ``few_descendants`` with known nodes): cycles are safe, as all of a cycle is affected or nothing of it;
* facts, findings and scores are computed from their rows of the child tables.

The score table is a log: a batch appends the rows of its affected assets (a removed asset as a tombstone), and a reader takes
the newest row of each asset. Rows written are therefore the affected assets, whatever the size of the catalogue. A batch's folders
count when its commit is there (``CommitLog``): a batch that fails half-way is invisible, and one that is run again under its
number is skipped, so replays double nothing. ``compact`` rewrites the newest rows as one folder.

After any batch the table equals a full recompute. Beyond about 1,500 descendants both show estimates, which may differ within their
error when the same nodes were united in another order.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custos.functions import columns as C
from custos.functions import fixed
from custos.functions.tables import CommitLog, Workspace
from custos.operators import condense, rules
from custos.sources.catalog import Catalog

# Tables with rows of single assets.
_CHILD_TABLES = ("assets", "ownership", "asset_tags", "schema_fields")
_SCORE = "asset_id bigint, urn string, name string, raw_total bigint, score bigint, risk_level string, n_findings bigint"
_FINDINGS = "findings array<struct<rule: string, severity: string, points: bigint, detail: string>>"
# The logs of the table, and their rows' key: scores; descendants counted, with their sketch; and a few descendants themselves.
# The last two are logs of their own, so that no join carries the sketches
_LOGS = {"scores": ("asset_id", f"{_SCORE}, {_FINDINGS}"), "radius": ("node", "node bigint, n bigint, sketch binary"),
         "few": ("node", "node bigint, few array<bigint>")}


def few_descendants(edges: DataFrame, most: int, w: Workspace, known: DataFrame | None = None) -> DataFrame:
    """(node, few): up to ``most`` descendants of every source in ``edges`` (distinct, src <> dst); all of them if there are fewer.
    ``known`` (node, few) has those of nodes without edges here. As in ``lineage.some_descendants``, each round reaches a hop
    further, and a node that has fewer than ``most`` after ``most`` hops has no more; no node remembers more than ``most``. A node
    that has as many is left alone: with it, its list gives as many to those that lead to it. The others ask only those
    whose list came in the round before, until nothing comes."""
    ranked = Window.partitionBy("node").orderBy("found")
    keep = lambda df: w.table(df.where("node <> found").distinct().withColumn("rn", F.row_number().over(ranked))
                              .where(F.col("rn") <= most).withColumn("have", F.max("rn").over(Window.partitionBy("node"))).drop("rn"))
    base = edges.select(F.col("src").alias("node"), F.col("dst").alias("found"))
    if known is not None:
        below = known.select(F.col("node").alias("dst"), F.explode("few").alias("found"))
        base = base.unionByName(edges.join(below, "dst").select(F.col("src").alias("node"), "found"))
    last, full = keep(base), []
    for _ in range(most - 1):
        full.append(last.where(F.col("have") >= most).select("node", "found"))
        short = last.where(F.col("have") < most).select("node", "found")
        edges = w.table(edges.join(short.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        via = edges.join(last.select(F.col("node").alias("dst"), "found"), "dst").select(F.col("src").alias("node"), "found")
        n, last = short.count(), keep(short.unionByName(via))
        if last.count() == n:
            break
    found = reduce(DataFrame.unionByName, full, last.select("node", "found"))
    return found.groupBy("node").agg(F.sort_array(F.collect_list("found")).alias("few"))  # at most ``most``


def ancestors(edges: DataFrame, start: DataFrame, w: Workspace) -> DataFrame:
    """(node): the nodes of ``start`` and all that reach them. A round joins the edges to the nodes found in the round before."""
    parts = [w.table(start.distinct())]
    while True:
        new = edges.join(parts[-1].withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node")).distinct()
        seen = parts[0]
        for p in parts[1:]:
            seen = seen.unionByName(p)
        new = w.table(new.join(seen, "node", "left_anti"))
        if new.isEmpty():
            return w.table(seen)
        parts.append(new)


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of the last batch for each key, removed ones too."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


class ScoreTable:
    """Scores and findings of every asset under ``root``, kept up to date batch by batch."""

    def __init__(self, spark: SparkSession, root: str, threshold: int = fixed.DOWNSTREAM_THRESHOLD, lg_config_k: int = 14):
        self.spark, self.root, self.threshold, self.lg_config_k = spark, root.rstrip("/"), threshold, lg_config_k
        self.log = CommitLog(spark, root)

    # -- reading ---------------------------------------------------------------

    def _rows(self, name: str, state: dict | None, ddl: str | None = None) -> DataFrame:
        """All rows of a log; with ``ddl`` these columns alone."""
        folders = (state or {}).get(name, [])
        ddl = f"{ddl or _LOGS[name][1]}, removed boolean, batch bigint"
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], ddl)

    def scores(self, findings: bool = True) -> DataFrame:
        """One row an asset: score, level, number of findings, and (unless ``findings`` is False) the findings (at most one a rule)."""
        rows = self._rows("scores", self.log.newest(), None if findings else _SCORE)
        return _newest(rows, "asset_id").where("not removed").drop("removed")

    def findings(self) -> DataFrame:
        return self.scores().select("asset_id", "urn", F.explode("findings").alias("f")).select("asset_id", "urn", "f.*")

    # -- writing ---------------------------------------------------------------

    def start(self, cat: Catalog) -> dict:
        """Score everything, as batch 0."""
        return self._write(cat, None, None, 0)

    def apply(self, cat: Catalog, changed: DataFrame, changed_edges: DataFrame | None = None, batch: int | None = None) -> dict:
        """Bring the table up to ``cat``, the catalogue after the batch. ``changed`` (asset_id) are assets whose own rows were
        added, changed or removed, ``changed_edges`` (src, dst) edges added or removed. Returns the numbers of rows written."""
        state = self.log.newest()
        if state is None:
            raise ValueError("start the table first")
        batch = state["number"] + 1 if batch is None else batch
        if batch <= state["number"]:
            return {"scores": 0, "radius": 0}  # in already
        if batch != state["number"] + 1:
            raise ValueError(f"batch {batch} cannot follow {state['number']}")
        return self._write(cat, changed, changed_edges, batch)

    def _write(self, cat: Catalog, changed: DataFrame | None, changed_edges: DataFrame | None, batch: int) -> dict:
        state = self.log.newest() if batch else {"number": -1}
        done = {"number": batch, **{name: list(state.get(name, [])) for name in _LOGS}}
        told = {"scores": 0, "radius": 0}
        with Workspace(self.spark) as w:
            affected = None if batch == 0 else w.table(changed.select("asset_id").where("asset_id is not null").distinct())
            if batch == 0 or changed_edges is not None:
                edges = w.table(cat.lineage_edges.where("src <> dst").select("src", "dst").distinct())
            if batch == 0:
                told["radius"] = self._radius(edges, {}, None, batch, done, w)
            elif changed_edges is not None:
                moved = w.table(ancestors(edges, changed_edges.where("src is not null").select(F.col("src").alias("node")), w))
                out = w.table(edges.join(moved.withColumnRenamed("node", "src"), "src", "left_semi"))
                ends = w.table(out.select(F.col("dst").alias("node")).distinct().join(moved, "node", "left_anti"))
                known = {name: _newest(self._rows(name, state).join(ends, "node", "left_semi"), "node").where("not removed") for name in ("radius", "few")}
                # nodes that lost their last edge
                gone = w.table(moved.join(out.select(F.col("src").alias("node")), "node", "left_anti"))
                told["radius"] = self._radius(out, known, gone, batch, done, w)
                affected = w.table(affected.unionByName(moved.withColumnRenamed("node", "asset_id")).distinct())
            n = _newest(self._rows("radius", done, "node bigint, n bigint"), "node").where("not removed").select("node", "n")
            few = _newest(self._rows("few", done).withColumn("few", F.size("few")), "node").where("not removed").select("node", "few")
            rows = self._scored(cat, affected, n.join(few, "node", "left"))
            if affected is not None:
                rows = affected.join(rows, "asset_id", "left").withColumn("removed", F.col("urn").isNull())
            told["scores"] = self._append(rows, "scores", batch, done)
            self.log.commit(done)
        return told

    def _radius(self, edges: DataFrame, known: dict[str, DataFrame], gone: DataFrame | None, batch: int, done: dict, w: Workspace) -> int:
        """Append what the sources of ``edges`` reach, and tombstones of the nodes in ``gone``; returns the number of nodes."""
        # nodes without consumers keep no row but that of their sketch, which is themselves
        rows = {"radius": condense.sketches(edges, self.lg_config_k, known.get("radius")), "few": few_descendants(edges, self.threshold, w, known.get("few"))}
        told = {}
        for name, found in rows.items():
            found = found.withColumn("removed", F.lit(False))
            if gone is not None:
                found = found.unionByName(gone.withColumn("removed", F.lit(True)), allowMissingColumns=True)
            told[name] = self._append(found, name, batch, done)
        return told["radius"]

    def _scored(self, cat: Catalog, affected: DataFrame | None, radius: DataFrame) -> DataFrame:
        # whether an asset has an owner is all that the rules ask of its owners, so its first entry stands for all of them
        owned = cat.ownership.where(C.clean_text("owner_urn").isNotNull()).groupBy("asset_id").agg(
            F.min(F.struct("pos", "ownership_type", "owner_urn")).alias("first")).select("asset_id", "first.*")
        cat = cat.with_tables(ownership=owned)
        if affected is not None:
            cat = cat.with_tables(**{t: getattr(cat, t).join(affected, "asset_id", "left_semi") for t in _CHILD_TABLES})
            radius = radius.join(affected.withColumnRenamed("asset_id", "node"), "node", "left_semi")
        few = F.coalesce("few", F.lit(0))
        down = radius.select(F.col("node").alias("asset_id"), F.when(few < self.threshold, few).otherwise(
            F.greatest(F.col("n"), F.lit(self.threshold))).cast("bigint").alias("downstream_count"))
        facts = rules.scored_facts(cat, down, self.threshold)
        every = rules.default_rules(self.threshold)
        found = F.filter(F.array(*[F.when(F.col(f"r_{r.key}"), F.struct(
            F.lit(r.key).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.points).cast("bigint").alias("points"),
            r.detail.alias("detail"))) for r in every]), lambda x: x.isNotNull())
        return facts.select("asset_id", "urn", F.col("display_name").alias("name"), "raw_total", "score", "risk_level", "n_findings", found.alias("findings"))

    def _append(self, rows: DataFrame, name: str, batch: int, done: dict) -> int:
        folder = f"{name}/{batch:08d}-{uuid.uuid4().hex[:8]}"
        if "removed" not in rows.columns:
            rows = rows.withColumn("removed", F.lit(False))
        columns = self._rows(name, None).drop("batch").columns
        rows.select(*columns, F.lit(batch).cast("bigint").alias("batch")).write.parquet(f"{self.root}/{folder}")
        done[name].append(folder)
        return self.spark.read.parquet(f"{self.root}/{folder}").count()

    def compact(self) -> None:
        """One folder with the newest rows; older folders stay for readers that have begun, and no longer count."""
        state = self.log.newest()
        done = {"number": state["number"] + 1, **{name: [] for name in _LOGS}}
        for name, (key, _) in _LOGS.items():
            self._append(_newest(self._rows(name, state), key).where("not removed").drop("removed"), name, done["number"], done)
        self.log.commit(done)


def rescore_on_touched(table: ScoreTable, catalog_now, urn_of: DataFrame):
    """A callback for ``incremental.incremental_scan(on_touched=...)``: the entities a micro-batch touched are scored again.
    ``catalog_now()`` gives the catalogue after the batch, ``urn_of`` (asset_id, urn) the assets' identifiers."""
    def apply(touched: DataFrame) -> None:
        table.apply(catalog_now(), touched.join(urn_of, touched["entity_urn"] == urn_of["urn"]).select("asset_id"))
    return apply
