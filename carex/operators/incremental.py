"""Processing only new or changed records (problem 4).

High watermark on the monotonic batch number. A run takes an upper bound when it starts and reads the rows whose
batch lies above the watermark of the last successful run and at or below its own bound. Its output, the state of all
keys after it, and the new watermark lie in one folder that appears by one rename on the file system of the folder
(any that Hadoop knows), so a run that breaks off leaves no trace and is repeated whole.

`replay_runs` drives the runner through the successful runs of a log; `changes_by_run` computes the same for a whole
history at once, as a backfill: a broken run moves no watermark, so each row belongs to the first successful run whose
bound reaches it. Per resource and run one row survives a map-side combined aggregate; the window that follows sees at
most one row for each run of a resource, so no resource is hot.

Null and edge cases: a row without batch_no is never seen. A row without resource_id counts for the id inside its
document (a document wrapped in a JSON string included); without either it belongs to no resource and is left out.
Rows are ordered by updated_at (created_at if null, earliest if both are null), then id. Documents are compared as
JSON values; what cannot be read is compared as text; a null document is the state "deleted". Unreadable means
that the text holds no JSON value or an object with a repeated key. Ties and repeated rows are settled by id.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from carex.session import materialise, work_folder


def document_state(name: str) -> Column:
    """A digest of column `name`, equal for equal JSON values: keys sorted, numbers and escapes in one form."""
    return F.expr(
        f"case when {name} is null then 'deleted' else coalesce(concat('j', md5(to_json(try_parse_json({name})))), concat('t', md5({name}))) end"
    )


def _resource_key() -> Column:
    """resource_id, or the id inside the document, wrapped or not."""
    return F.expr(
        "coalesce(resource_id, get_json_object(resource, '$.id'),"
        " get_json_object(try_variant_get(try_parse_json(resource), '$', 'string'), '$.id'))"
    )


def keyed_versions(resources: DataFrame) -> DataFrame:
    """Narrow rows: key, batch_no, the order of versions, a digest of the state."""
    return resources.select(
        _resource_key().alias("key"),
        "batch_no",
        F.struct(F.coalesce("updated_at", "created_at").alias("at"), F.col("id").alias("id")).alias("version"),
        document_state("resource").alias("state"),
    ).where("key is not null and batch_no is not null")


def run_bounds(runs: DataFrame) -> DataFrame:
    """Successful runs with the half-open range of batches that each adds: (low, high].

    A run that sees no new batch has an empty range.
    """
    ok = runs.where("run_status = 'succeeded' and run_no is not null and last_batch is not null")
    before = W.orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)
    return ok.select("run_no", F.max("last_batch").over(before).alias("low"), F.col("last_batch").alias("high"))


def changes_by_run(resources: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_no, resource_id): what is new or changed for each successful run, compared with the one before."""
    steps = run_bounds(runs).where("low is null or high > low").select("run_no", F.coalesce("low", F.lit(-(1 << 31))).alias("low"), "high")
    # The batches are few and each lies in one range: they are looked up, not the rows.
    batches = resources.select("batch_no").where("batch_no is not null").distinct()
    reached = batches.join(steps, (F.col("batch_no") > F.col("low")) & (F.col("batch_no") <= F.col("high"))).select("batch_no", "run_no")
    seen = keyed_versions(resources).join(reached, "batch_no")
    per_run = seen.groupBy("key", "run_no").agg(F.max(F.struct("version", "state")).alias("best"))
    so_far = W.partitionBy("key").orderBy("run_no").rowsBetween(W.unboundedPreceding, 0)
    running = per_run.select("key", "run_no", F.max("best").over(so_far).alias("best"))
    lagged = running.select(
        "key",
        "run_no",
        F.col("best.state").alias("state"),
        F.lag("best.state").over(W.partitionBy("key").orderBy("run_no")).alias("previous"),
    )
    return lagged.where("previous is null or previous <> state").select("run_no", F.col("key").alias("resource_id"))


class IncrementalRunner:
    """Runs a transformation over new batches only, exactly once.

    `folder` (a URI of any file system that Hadoop knows) holds one sub-folder for each committed run and nothing else
    that counts: the output is written to a hidden name and appears, with its watermark inside, by one rename that
    fails where the name exists. A run that dies leaves only a hidden folder, which readers and the next run ignore;
    of two runs that start from one watermark only one commits.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path())
        self._done: list[dict] | None = None

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _commits(self) -> list[dict]:
        if self._done is None:
            out = []
            for status in self._fs.listStatus(self._path()):
                if (name := status.getPath().getName()).startswith("run-"):
                    stream = self._fs.open(self._path(name, "watermark.json"))
                    text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                    stream.close()
                    out.append(json.loads(text) | {"path": f"{self.folder}/{name}/data"})
            self._done = sorted(out, key=lambda c: c["high"])
        return self._done

    def watermark(self):
        """The bound of the last successful run; None before the first."""
        done = self._commits()
        return done[-1]["high"] if done else None

    def _commit(self, hidden: str, mark: dict) -> None:
        """The atomic step: the folder with output and watermark takes its final name."""
        stream = self._fs.create(self._path(hidden, "watermark.json"))
        stream.write(json.dumps(mark).encode())
        stream.close()
        name = f"run-{mark['high']:012d}"
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        self._context.rename(self._path(hidden), self._path(name), options)
        if self._done is not None:
            self._done.append(mark | {"path": f"{self.folder}/{name}/data"})

    def run(self, source: DataFrame, transform: Callable[..., DataFrame], sequence: str = "batch_no", upper=None, keyed: bool = False):
        """One run. The upper bound is fixed before any row is read; returns the committed watermark or None.

        keyed: transform takes the new rows and the state after the last run (None before the first), and gives the
        state after this one with a boolean `changed`; its changed rows are the output of the run.
        """
        self._done = None
        low = self.watermark()
        high = upper if upper is not None else source.agg(F.max(sequence)).first()[0]
        if high is None or (low is not None and high <= low):
            return None
        rows = source.where(F.col(sequence) <= high)
        if low is not None:
            rows = rows.where(F.col(sequence) > low)
        hidden = f".pending-{uuid.uuid4().hex}"
        out = transform(rows, self.state()) if keyed else transform(rows)
        out.write.partitionBy(*(["changed"] if keyed else [])).parquet(f"{self.folder}/{hidden}/data")
        self._commit(hidden, {"low": low, "high": high, "keyed": keyed, "schema": out.schema.json() if keyed else None})
        if keyed:
            for c in self._commits()[:-1]:  # no run reads an older state again
                self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{c['path']}/changed=false"), True)
        return high

    def state(self) -> DataFrame | None:
        """The state of all keys after the last run."""
        done = self._commits()
        return _read(self.spark, done[-1]) if done else None

    def result(self) -> DataFrame:
        """All committed output."""
        done = self._commits()
        if not done or not done[-1]["keyed"]:
            return self.spark.read.parquet(*[c["path"] for c in done])
        parts = [f"{c['path']}/changed=true" for c in done]
        there = [p for p in parts if self._fs.exists(self._jvm.org.apache.hadoop.fs.Path(p))]
        schema = _schema(done[-1])
        kept = schema.__class__([f for f in schema if f.name != "changed"])
        return self.spark.read.schema(kept).parquet(*there) if there else self.spark.createDataFrame([], kept)


def _schema(commit: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(commit["schema"]))


def _read(spark: SparkSession, commit: dict) -> DataFrame:
    return spark.read.schema(_schema(commit)).parquet(commit["path"])


def newest_states(run_no: int) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """The keyed step of problem 4: (key, best, run_no, changed) after a run over rows of `keyed_versions`.

    best is the greatest version of a key so far with its state; a key has changed if its state differs from before.
    """

    def step(rows: DataFrame, state: DataFrame | None) -> DataFrame:
        new = rows.groupBy("key").agg(F.max(F.struct("version", "state")).alias("new"))
        if state is None:
            return new.select("key", F.col("new").alias("best"), F.lit(run_no).alias("run_no"), F.lit(True).alias("changed"))
        both = state.select("key", F.col("best").alias("old")).join(new, "key", "full")
        best = F.greatest("old", "new")
        return both.select(
            "key", best.alias("best"), F.lit(run_no).alias("run_no"), (F.col("old").isNull() | (F.col("old.state") != best["state"])).alias("changed")
        )

    return step


def replay_runs(resources: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """(run_no, resource_id) as `changes_by_run`, from the runner: each successful run of the log reads its batches only.

    The log is the driver's own: it starts each run. Rows are narrowed once and laid out by batch, as an append-only
    source is; a batch of any size is split over files.
    """
    spark = resources.sparkSession
    source = materialise(keyed_versions(resources).hint("rebalance", "batch_no"), by=["batch_no"])
    runner = IncrementalRunner(spark, folder or work_folder(spark))
    for r in run_bounds(runs).orderBy("run_no").toLocalIterator():
        runner.run(source, newest_states(r.run_no), upper=r.high, keyed=True)
    if runner.watermark() is None:
        return spark.createDataFrame([], "run_no int, resource_id string")
    return runner.result().select("run_no", F.col("key").alias("resource_id"))
