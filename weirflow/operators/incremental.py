"""Problem 4: processing only new or changed records.

What was processed is kept as disjoint intervals of sequence numbers. A run subtracts them from the
range available to it and processes the gaps, whether they lie at the end or, through late commits
or runs that failed, in the middle; output and merged intervals are committed together.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import wire
from weirflow.operators.scan import positions, running
from weirflow.sources.tables import folder, stored

DAY_US = 86_400_000_000
BEGINNING = -(1 << 62)


def merge(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint intervals (keys, lo, hi; both ends included) that cover the same whole numbers; empty ones (hi < lo) vanish."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        intervals.where("lo <= hi")
        .withColumn("reach", before)
        .withColumn("island", F.sum(F.when(F.col("reach") >= F.col("lo") - 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("island")
    )


def subtract(available: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """The gaps: intervals of `available` without those of `processed`, disjoint, in long form and without pairing intervals.

    Either side may overlap itself or be empty.
    """
    edges = lambda df, a, p: df.where("lo <= hi").select(
        *keys, F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(a).alias("a"), F.lit(p).alias("p")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-p).alias("p"))))
    )
    # By keys at once: the sums, the windows and the merge below then need no further shuffle.
    steps = edges(available, 1, 0).unionByName(edges(processed, 0, 1)).repartition(*keys).groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return merge(
        steps.withColumn("open", (F.sum("a").over(so_far) > 0) & (F.sum("p").over(so_far) <= 0))
        .withColumn("next", F.lead("at").over(order))
        .where("open and next is not null")
        .select(*keys, F.col("at").alias("lo"), (F.col("next") - 1).alias("hi")),
        keys,
    )


def gaps(runs: DataFrame) -> DataFrame:
    """The interval of sequence numbers that each succeeded run processes: run_no, topic, lo, hi.

    `runs` has run_no, topic, at (the last number visible to the run) and outcome. Up to `at`
    everything is available; the intervals of the topic's earlier succeeded runs, merged, are what
    lies up to the latest of them. Failed and abandoned runs commit nothing, so their part stays a gap
    for the next succeeded run. Of runs at one moment the smallest run_no processes.
    """
    # Runs are a control table: one row per run of a topic, in order of time.
    before = Window.partitionBy("topic").orderBy("at", "run_no").rowsBetween(Window.unboundedPreceding, -1)
    done = runs.where("outcome = 'succeeded' and at is not null and topic is not null")
    return (
        done.withColumn("lo", F.coalesce(F.max("at").over(before), F.lit(BEGINNING)) + 1)
        .withColumn("hi", F.col("at"))
        .where("lo <= hi")
        .select("run_no", "topic", "lo", "hi")
    )


def locate(points: DataFrame, intervals: DataFrame, key: str, value: str, carry: list[str], block: int = DAY_US) -> DataFrame:
    """Each point with `lo`, `hi` and the `carry` columns of the disjoint interval of its key that holds it; others vanish.

    One sorted pass per (key, block of numbers) instead of a range join, so a key with most of the
    points is spread over its blocks; an interval that began in an earlier block is carried in.
    """
    cell = F.struct("lo", "hi", *carry)
    ends = intervals.select(key, F.floor(F.greatest(F.col("lo"), F.lit(BEGINNING // 2)) / block).alias("block"), F.col("lo").alias("at"), F.lit(0).alias("tag"), cell.alias("cell"))
    rows = ends.unionByName(
        points.withColumn("block", F.floor(F.col(value) / block)).withColumn("at", F.col(value)).withColumn("tag", F.lit(1)).where("at is not null"),
        allowMissingColumns=True,
    )
    held = running(rows, [key], "block", ["at", "tag"], "cell", "held")
    return (
        held.where((F.col("tag") == 1) & (F.col("held.hi") >= F.col("at")))
        .withColumns({c: F.col(f"held.{c}") for c in ["lo", "hi", *carry]})
        .drop("held", "cell", "tag", "at", "block")
    )


def landed(outbox: DataFrame) -> DataFrame:
    """Versions (id, updated_us), once each however often they landed: topic, landed_us and again_us (first and last landing), published, retry_us."""
    return (
        outbox.select(
            "id",
            "topic",
            wire.us_of(F.col("updated_at")).alias("updated_us"),
            wire.us_of(F.col("loaded_at")).alias("landed_us"),
            F.col("published_at").isNotNull().alias("published"),
            wire.us_of(F.col("retry_at")).alias("retry_us"),
        )
        .where("id is not null and updated_us is not null and landed_us is not null")
        .groupBy("id", "updated_us")
        .agg(F.min("landed_us").alias("landed_us"), F.max("landed_us").alias("again_us"), F.min("topic").alias("topic"), F.max("published").alias("published"), F.max("retry_us").alias("retry_us"))
    )


def _ended(versions: DataFrame, block: int) -> DataFrame:
    """Versions with ended_us, the moment from which they are no longer current: a newer one has landed. One that lands after a newer one never is."""
    cut = versions.withColumn("block", F.floor(F.col("updated_us") / block))
    return running(cut, ["id"], "block", ["updated_us"], "landed_us", "ended_us", combine=F.min, backwards=True, inclusive=False).drop("block")


def _inside(points: DataFrame, intervals: DataFrame, key: str, value: str) -> DataFrame:
    """Points that lie in the disjoint intervals of their key, for keys that are bounded in size; else see locate."""
    ends = intervals.select(key, F.col("lo").alias("at"), F.lit(0).alias("tag"), F.col("hi").alias("reach"))
    rows = ends.unionByName(points.withColumns({"at": F.col(value), "tag": F.lit(1)}), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy("at", "tag").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("reach", F.max("reach").over(before)).where("tag = 1 and reach >= at").drop("at", "tag", "reach")


SLICE = 1 << 16  # numbers of the log whose intervals are kept together
EPOCHS = 2  # commits in which the history of the runs is processed


def landings(outbox: DataFrame, runs: DataFrame, bounds: list[int], block: int = DAY_US) -> DataFrame:
    """Moments at which a number of the log becomes available to a run: epoch, n, slice, run_no and hi (the run's moment), id, updated_us, published, ended_us.

    The log has topics one after another, within a topic the versions in the order in which they were
    made; `n` is a version's place in it. A version that lands late has its place among those that
    landed before it, so it leaves a gap until then. It is available to the first succeeded run at or
    after its landing, or after its retry_at if that is later, and once more after its last landing if
    that lies in a later epoch (number of `bounds` before it).
    """
    log = positions(landed(outbox).where("topic is not null"), ["topic", "updated_us", "id"], "n")
    versions = _ended(log, block)
    ready = lambda at: F.when(F.col("published"), F.col(at)).otherwise(F.greatest(F.col(at), F.col("retry_us")))
    epoch = lambda at: sum(((at > b).cast("int") for b in bounds), F.lit(0))
    moment = lambda at: F.struct(ready(at).alias("ready_us"), epoch(ready(at)).alias("epoch"))
    again = F.when(epoch(ready("again_us")) > epoch(ready("landed_us")), moment("again_us"))
    points = versions.select("topic", "n", "id", "updated_us", "published", "ended_us", F.inline(F.array_compact(F.array(moment("landed_us"), again))))
    at = runs.select("run_no", "topic", wire.us_of(F.col("began_at")).alias("at"), "outcome")
    found = locate(stored(points, "landings"), gaps(at), "topic", "ready_us", ["run_no"], block)
    return found.select("epoch", F.floor(F.col("n") / SLICE).alias("slice"), "n", "run_no", "hi", "id", "updated_us", "published", "ended_us")


def due(outbox: DataFrame, runs: DataFrame, epochs: int = EPOCHS, ledger: Ledger | None = None) -> DataFrame:
    """What each succeeded run must process: run_no, outbox_id, updated_us.

    The history of the runs is processed in `epochs` steps, one after another in time. Each step reads
    from the ledger which numbers of the log (see landings) were processed before, subtracts them from
    those that became available since, and processes the gaps: a version that lands late lies in
    one, a version that landed again doesn't. A version in a gap goes to the first run that
    sees it, unless it is published or no longer current by then. Output and merged intervals are
    committed together, so a step that fails is done again from the same gaps.
    Rows without id, topic or one of the times updated_at and loaded_at, and runs without topic or
    began_at, are left out; other columns and repeated rows change nothing; an empty table gives an
    empty result. A new ledger is made in the shared folder unless one is given.
    """
    spark = outbox.sparkSession
    ledger = ledger or Ledger(spark, folder(spark, "ledger"))
    moments = runs.where("outcome = 'succeeded'").agg(F.percentile_approx(wire.us_of(F.col("began_at")), [i / epochs for i in range(1, epochs)] or [1.0], 1000)).take(1)[0][0]
    bounds = sorted(set(moments or []))[: epochs - 1]
    seen = stored(landings(outbox, runs, bounds), "seen")
    for epoch in range(len(bounds) + 1):
        now = seen.where(F.col("epoch") == epoch)
        available = now.select("slice", F.col("n").alias("lo"), F.col("n").alias("hi"))
        left = stored(subtract(available, ledger.processed(INTERVALS), ["slice"]), "gaps")
        taken = _inside(now.withColumnRenamed("hi", "run_us"), left, "slice", "n")
        taken = taken.where(~F.col("published") & (F.col("ended_us").isNull() | (F.col("run_us") < F.col("ended_us"))))
        ledger.commit(taken.select("run_no", F.col("id").alias("outbox_id"), "updated_us"), left, ["slice"])
    return ledger.output()


INTERVALS = "slice bigint, lo bigint, hi bigint"


class Ledger:
    """Processed intervals and output of a job, committed together under one folder.

    Every commit writes its part of the output and the merged intervals into a folder of their own,
    then names both in a manifest that is put in place by one rename. A run that dies before that
    leaves nothing that a reader sees; the next run finds the same gap and does it again. The file
    system's rename must be atomic and must not replace an existing file, as on HDFS.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        root = self._Path(f"{self.path}/manifests")
        if not self._fs.exists(root):
            return {"version": 0, "parts": [], "ledger": None}
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "parts": [], "ledger": None}
        stream = self._fs.open(self._Path(f"{self.path}/manifests/{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def processed(self, schema: str) -> DataFrame:
        at = self._manifest()["ledger"]
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def output(self) -> DataFrame | None:
        parts = self._manifest()["parts"]
        return self.spark.read.parquet(*parts) if parts else None

    def commit(self, output: DataFrame, intervals: DataFrame, keys: list[str]) -> int:
        """Add `output` and `intervals`; the new version. Another commit in between makes this one fail, and leaves its files unseen."""
        was = self._manifest()
        version, tag = was["version"] + 1, uuid.uuid4().hex
        part, ledger = f"{self.path}/parts/{version}-{tag}", f"{self.path}/ledgers/{version}-{tag}"
        output.write.parquet(part)
        merge(self.processed(intervals._jdf.schema().toDDL()).unionByName(intervals), keys).write.parquet(ledger)
        text = json.dumps({"version": version, "parts": [*was["parts"], part], "ledger": ledger})
        draft, final = self._Path(f"{self.path}/drafts/{tag}.json"), self._Path(f"{self.path}/manifests/{version}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} was committed by another run")
        return version
