"""Scan history as validity intervals (slowly changing rows, type 2) for any number of scans.

A history has one row for each (key, values) that was seen without a break: ``valid_from`` is the first scan that saw it,
``valid_to`` the scan that saw it no longer or otherwise (null: still valid). It replaces a snapshot for each scan: a table that does
not change grows by nothing, and the state as of any date is a filter.

* ``from_scans`` builds the history of a table of observations (one row a key and scan) at once: consecutive scans of a key
  with the same values are one interval (gaps and islands over the numbers of the scans).
* ``merge_scan`` adds one scan to a written history. Closed intervals never change, so they are appended, one folder a scan; open
  ones are kept by hash bucket, and a scan rewrites the buckets in which something opens or closes. Each scan's folders are
  written before its number is committed by an atomic rename, so that a scan that fails half-way is invisible, and one that is run
  again replaces its own folders: it loses and doubles nothing.
* ``as_of`` reads the rows valid at a date, ``as_of_join`` joins rows with dates of their own to what was valid then.

Keys are compared with nulls equal. A key that a scan has twice must have the same values: the least are kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from custos.functions.tables import CommitLog

BUCKETS = 16


def _one_each(rows: DataFrame, key: list[str], values: list[str], *more: str) -> DataFrame:
    """One row a key: the least values. A minimum of structs, so that repeats combine before the shuffle."""
    return rows.groupBy(*key, *more).agg(F.min(F.struct(*values)).alias("_v")).select(*key, *more, *[F.col(f"_v.{v}").alias(v) for v in values])


def from_scans(observed: DataFrame, scans: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, values, valid_from, valid_to) from ``observed`` (key, values, scan) and ``scans`` (scan), all scans there were,
    those that saw nothing included. A window holds one key's scans, never a whole table."""
    order = scans.select("scan").distinct().orderBy("scan").collect()  # one row a scan
    kind = scans.schema["scan"].dataType.simpleString()
    make = lambda rows, ddl: F.broadcast(scans.sparkSession.createDataFrame(rows, ddl))
    numbers = make([(r[0], i) for i, r in enumerate(order)], f"scan {kind}, _n int")
    begins = make([(i, r[0]) for i, r in enumerate(order)], f"_from int, valid_from {kind}")
    ends = make([(i, order[i + 1][0] if i + 1 < len(order) else None) for i in range(len(order))], f"_to int, valid_to {kind}")
    # only numbers of scans are shuffled and sorted, not scans; repeats combine before the shuffle, and of a key's rows of one scan,
    # which differ in their values, the first in order stays. All windows have one order, so that rows are sorted once
    rows = observed.join(numbers, "scan").select(*key, "_n", *values).distinct()
    # as many tasks as the session has, not as few as a small shuffle would be merged into: what a task sorts stays small
    rows = rows.repartition(int(scans.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    by_key = Window.partitionBy(*key).orderBy("_n", *values)
    rows = rows.withColumn("_was", F.lag("_n").over(by_key)).where("_was is null or _was <> _n").drop("_was")
    same = F.struct(*values)
    rows = rows.withColumn("_starts", ~(F.lag("_n").over(by_key) == F.col("_n") - 1) | ~F.lag(same).over(by_key).eqNullSafe(same))
    rows = rows.withColumn("_island", F.sum(F.coalesce(F.col("_starts"), F.lit(True)).cast("int")).over(by_key))
    runs = rows.groupBy(*key, "_island", *values).agg(F.min("_n").alias("_from"), F.max("_n").alias("_to"))
    return runs.join(begins, "_from").join(ends, "_to").select(*key, *values, "valid_from", "valid_to")


def valid_at(when: Column) -> Column:
    return (F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when))


def as_of(history: DataFrame, when) -> DataFrame:
    """The rows valid at ``when``, without their interval."""
    return history.where(valid_at(F.lit(when))).drop("valid_from", "valid_to")


def as_of_join(rows: DataFrame, history: DataFrame, key: list[str], at: str, how: str = "left") -> DataFrame:
    """``rows`` with the values of their key as they were at the time in their column ``at``. An equi-join on the key with
    the interval as a residual condition: one key's intervals don't overlap, so a row meets one at most."""
    h = history.withColumnsRenamed({k: f"_k_{k}" for k in key})
    cond = [rows[k].eqNullSafe(h[f"_k_{k}"]) for k in key]
    both = rows.join(h, [*cond, h["valid_from"] <= rows[at], h["valid_to"].isNull() | (h["valid_to"] > rows[at])], how)
    return both.drop(*[f"_k_{k}" for k in key], "valid_from", "valid_to")


def changes(history: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, at, change, before, after): every change of a key between scans: ``added`` when it is first seen or again after a
    break, ``removed`` when a break begins, ``changed`` when one interval follows another at once. What the first scan saw was
    there before, so it is no change."""
    first = history.select(F.min("valid_from")).scalar()
    value = F.struct(*values)
    by_key = Window.partitionBy(*key).orderBy("valid_from")
    h = history.select(*key, "valid_from", "valid_to", value.alias("after"), F.lag("valid_to").over(by_key).alias("_ended"),
                       F.lag(value).over(by_key).alias("before"), F.lead("valid_from").over(by_key).alias("_next"))
    met = F.col("_ended") == F.col("valid_from")
    opened = h.where(F.col("valid_from") > first).select(
        *key, F.col("valid_from").alias("at"), F.when(met, "changed").otherwise("added").alias("change"),
        F.when(met, F.col("before")).alias("before"), "after")
    gone = h.where(F.col("valid_to").isNotNull() & ~F.col("valid_to").eqNullSafe(F.col("_next"))).select(
        *key, F.col("valid_to").alias("at"), F.lit("removed").alias("change"), F.col("after").alias("before"),
        F.lit(None).cast(history.select(value.alias("v")).schema["v"].dataType).alias("after"))
    return opened.unionByName(gone)


# --- a written history, one scan after the other ------------------------------------------------

@dataclass(frozen=True)
class HistoryTable:
    """A history under ``root``: ``closed/<scan>`` folders, ``open/<bucket>/<version>`` folders, and one state file a commit that
    names the version of each bucket and the closed folders that count. Columns: key, values, valid_from, valid_to."""

    spark: SparkSession
    root: str
    key: tuple[str, ...]
    values: tuple[str, ...]
    schema: str  # DDL of key and values
    time: str = "string"  # type of the scan's time
    buckets: int = BUCKETS

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.root)

    def state(self) -> dict:
        """The newest commit: {"number", "scan", "open": {bucket: folder}, "closed": [folder, ...]}."""
        return self.log.newest() or {"number": 0, "scan": None, "open": {}, "closed": []}

    def _commit(self, state: dict) -> None:
        self.log.commit(state)

    def _read(self, folders: list[str]) -> DataFrame:
        ddl = f"{self.schema}, valid_from {self.time}, valid_to {self.time}"
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, state: dict | None = None) -> DataFrame:
        state = state or self.state()
        return self._read([*state["closed"], *state["open"].values()])

    def merge_scan(self, snapshot: DataFrame, scan) -> dict:
        """Add a later scan's rows (key, values). Returns what was written: rows opened and closed, buckets rewritten."""
        state = self.state()
        if state["scan"] is not None and scan <= state["scan"]:
            if scan == state["scan"]:
                return {"opened": 0, "closed": 0, "buckets": 0}  # this scan is in already
            raise ValueError(f"scan {scan!r} is older than {state['scan']!r}")
        tag = uuid.uuid4().hex[:8]
        k, v = list(self.key), list(self.values)
        bucket = F.pmod(F.xxhash64(*k), F.lit(self.buckets)).cast("int")
        old = self._read(list(state["open"].values())).withColumn("_old", F.struct(*v, "valid_from")).drop(*v, "valid_from", "valid_to")
        new = _one_each(snapshot, k, v).select(*k, F.struct(*v).alias("_new"))
        o = old.withColumnsRenamed({c: f"_k_{c}" for c in k})
        both = new.join(o, [new[c].eqNullSafe(o[f"_k_{c}"]) for c in k], "full_outer").select(
            *[F.when(F.col("_new").isNotNull(), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c) for c in k], "_new", "_old")
        stays = F.col("_old").isNotNull() & F.col("_new").eqNullSafe(F.struct(*[F.col("_old")[c].alias(c) for c in v]))
        both = both.withColumns({"bucket": bucket, "_stays": F.coalesce(stays, F.lit(False))})
        work = f"_work/{state['number'] + 1:08d}-{tag}"
        both.where("not _stays").write.parquet(f"{self.root}/{work}")  # what opens or closes: all that later steps need
        moved = self.spark.read.schema(both.schema).parquet(f"{self.root}/{work}")
        touched = [r[0] for r in moved.select("bucket").distinct().collect()]  # a row a bucket
        done = {"number": state["number"] + 1, "scan": scan, "open": dict(state["open"]), "closed": list(state["closed"])}
        time = F.lit(scan).cast(self.time)
        closed = moved.where("_old is not null").select(*k, *[F.col("_old")[c].alias(c) for c in v], F.col("_old.valid_from").alias("valid_from"), time.alias("valid_to"))
        opened = moved.where("_new is not null").select(*k, *[F.col("_new")[c].alias(c) for c in v], time.alias("valid_from"), F.lit(None).cast(self.time).alias("valid_to"), "bucket")
        counts = moved.agg(F.count_if(F.col("_new").isNotNull()), F.count_if(F.col("_old").isNotNull())).first()
        if counts[1]:
            folder = f"closed/{done['number']:08d}-{tag}"
            closed.write.parquet(f"{self.root}/{folder}")
            done["closed"].append(folder)
        if touched:
            before = self._read([state["open"][str(b)] for b in touched if str(b) in state["open"]])
            gone = moved.where("_old is not null").select(*[F.col(c).alias(f"_k_{c}") for c in k])
            stay = before.join(gone, [before[c].eqNullSafe(gone[f"_k_{c}"]) for c in k], "left_anti").withColumn("bucket", bucket)
            base = f"open/{done['number']:08d}-{tag}"
            stay.unionByName(opened).write.partitionBy("bucket").parquet(f"{self.root}/{base}")
            for b in touched:
                folder = f"{base}/bucket={b}"
                done["open"].pop(str(b), None)
                if self.log.fs().exists(self.log.path(folder)):
                    done["open"][str(b)] = folder
        self._commit(done)
        self.log.fs().delete(self.log.path(work), True)
        return {"opened": counts[0], "closed": counts[1], "buckets": len(touched)}


def risk_by_scan(history: DataFrame, scans: DataFrame, levels: list[str]) -> DataFrame:
    """Findings valid at each scan, by severity. Every interval counts +1 at its beginning and -1 at its end; running sums over
    the scans of a level (one row a scan) give the number, so no interval is repeated for each scan it spans."""
    steps = history.select(F.col("valid_from").alias("scan"), "severity", F.lit(1).alias("d")).unionByName(
        history.where("valid_to is not null").select(F.col("valid_to").alias("scan"), "severity", F.lit(-1).alias("d")))
    steps = steps.groupBy("scan", "severity").agg(F.sum("d").alias("d"))
    every = scans.select("scan").distinct().withColumn("severity", F.explode(F.array(*map(F.lit, levels))))
    run = Window.partitionBy("severity").orderBy("scan").rowsBetween(Window.unboundedPreceding, 0)
    valid = every.join(steps, ["scan", "severity"], "left").withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(run))
    return valid.groupBy("scan").pivot("severity", levels).agg(F.sum("n").cast("bigint"))
