import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carex.operators.incremental import IncrementalRunner, changes_by_run, keyed_versions, newest_states, replay_runs

STORE = "id long, resource_id string, resource string, created_at timestamp_ntz, updated_at timestamp_ntz, batch_no int, key string, state string, run_no int"
RUNS = "run_no int, run_status string, last_batch int, id string"


def brute(rows, runs):
    def state(x):
        if x is None:
            return "deleted"
        try:
            return json.dumps(json.loads(x), sort_keys=True)
        except ValueError:
            return "t" + x

    def key(r):
        if r[1] is not None or r[2] is None:
            return r[1]
        try:
            v = json.loads(r[2])
            return (json.loads(v) if isinstance(v, str) else v).get("id")
        except (ValueError, AttributeError):
            return None

    before, out = {}, set()
    for run in sorted(runs, key=lambda r: r[0]):
        if run[1] != "succeeded":
            continue
        now = {}
        for r in rows:
            if r[5] is not None and r[5] <= run[2] and key(r) is not None:
                at = (r[4] or r[3] or datetime.min, r[0])
                if key(r) not in now or at > now[key(r)][0]:
                    now[key(r)] = (at, state(r[2]))
        out |= {(run[0], k) for k, (_, s) in now.items() if before.get(k) != s}
        before = {k: s for k, (_, s) in now.items()}
    return out


def test_replay_equals_brute_force(spark):
    rng = random.Random(3)
    docs = ['{"a":1,"id":"r1"}', '{ "id": "r1", "a": 1.0 }', '{"a":2,"id":"r2"}', None, '{"a":', json.dumps('{"id":"r3"}'), "{}", "", "null"]
    rows = []
    for i in range(300):
        t = datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 20))
        rows.append((i, rng.choice(["r1", "r2", "r3", None]), rng.choice(docs), rng.choice([t, None]), rng.choice([t, None]), rng.choice([*range(1, 12), None]), "k", "s", 1))
    runs = [(k, rng.choice(["succeeded", "failed"]), b, "z") for k, b in enumerate((2, 3, 3, 5, 8, 11))]
    for replay in (changes_by_run, replay_runs):
        got = {tuple(r) for r in replay(spark.createDataFrame(rows, STORE), spark.createDataFrame(runs, RUNS)).collect()}
        assert got == brute(rows, runs)


def test_no_runs_and_no_rows(spark):
    rows, runs = spark.createDataFrame([], STORE), spark.createDataFrame([(1, "failed", 3, "z")], RUNS)
    for replay in (changes_by_run, replay_runs):
        assert replay(rows, runs).count() == 0
        assert replay(rows, spark.createDataFrame([(1, "succeeded", 3, "z")], RUNS)).count() == 0


def test_runner_survives_a_failure_without_skips_or_repeats(spark, tmp_path):
    runner = IncrementalRunner(spark, str(tmp_path / "out"))
    source = spark.createDataFrame([(b, f"v{b}") for b in range(1, 7)], "batch_no int, v string")
    assert runner.run(source.where("batch_no <= 2"), lambda d: d) == 2

    def broken(d):
        return d.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))

    with pytest.raises(Exception, match="lost"):
        runner.run(source.where("batch_no <= 4"), broken)
    assert runner.watermark() == 2
    assert runner.run(source, lambda d: d, upper=5) == 5
    assert runner.run(source, lambda d: d, upper=5) is None
    assert runner.run(source, lambda d: d) == 6
    assert sorted(r.batch_no for r in runner.result().collect()) == [1, 2, 3, 4, 5, 6]


def test_runner_breaks_off_between_write_and_commit(spark, tmp_path, monkeypatch):
    """On a file system that is not the local one; the state of a run that broke off is not seen by the next."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./data", f"file://{tmp_path}")
    rows = [(i, f"r{i % 3}", json.dumps({"v": i}), None, datetime(2024, 1, 1) + timedelta(hours=i), 1 + i // 2, "k", "s", 1) for i in range(8)]
    source = keyed_versions(spark.createDataFrame(rows, STORE))
    runner = IncrementalRunner(spark, "viewfs://store/data/runs")
    assert runner.run(source, newest_states(1), upper=1, keyed=True) == 1
    commit = IncrementalRunner._commit
    monkeypatch.setattr(IncrementalRunner, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died before the rename")))
    with pytest.raises(RuntimeError, match="before the rename"):
        runner.run(source, newest_states(2), upper=3, keyed=True)
    monkeypatch.setattr(IncrementalRunner, "_commit", commit)
    again = IncrementalRunner(spark, "viewfs://store/data/runs")
    assert again.watermark() == 1 and again.state().count() == 2
    assert again.run(source, newest_states(3), upper=4, keyed=True) == 4
    got = {(r.run_no, r.key) for r in again.result().collect()}
    assert got == brute(rows, [(1, "succeeded", 1), (3, "succeeded", 4)])
    rival = IncrementalRunner(spark, "viewfs://store/data/runs")
    monkeypatch.setattr(rival, "watermark", lambda: 1)  # started before the last commit
    with pytest.raises(Exception, match="(?i)exist"):
        rival.run(source, newest_states(4), upper=4, keyed=True)
