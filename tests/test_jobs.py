"""The job processor: claims of several processors, replays, cured errors, archives and logs."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from framelake.streaming import jobs as J


def put(folder, *jobs):
    folder.mkdir(exist_ok=True)
    for k, name in jobs:
        (folder / f"{len(list(folder.iterdir()))}-{k}.json").write_text(json.dumps({"job_id": k, "acquisition": name}))


def works(d):
    return d.select("job_id", F.lit(True).alias("ok"))


def states(spark, out, stages=2):
    return {r.job_id: r.state for r in J.job_states(J.manifest(spark, out), stages).collect()}


def test_two_processors_work_each_job_once(spark, tmp_path):
    put(tmp_path / "jobs", *((k, f"a{k}") for k in range(12)))
    out, claims = str(tmp_path / "manifest"), str(tmp_path / "claims")
    # Both read every file before either has worked on one.
    meet = threading.Barrier(2, timeout=60)
    met = set()

    def motion(d):
        me = threading.get_ident()
        if me not in met:
            met.add(me)
            meet.wait()
        return works(d)

    stages = [("motion", motion, True), ("nmf", works, True)]
    running = [J.process(J.watch(spark, str(tmp_path / "jobs"), 2), out, str(tmp_path / f"cp{k}"), stages, claims=claims) for k in range(2)]
    for r in running:
        r.awaitTermination()
    entries = J.manifest(spark, out)
    assert entries.groupBy("job_id", "stage").count().where("count <> 1").count() == 0 and entries.count() == 24
    assert entries.select("owner").distinct().count() == 2
    assert set(states(spark, out).values()) == {"done"} and len(states(spark, out)) == 12


def test_claims(spark, tmp_path):
    claims = str(tmp_path / "claims")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.extend((k, f) for f in J.claim(spark, claims, ["x", "y", "z"], f"p{k}"))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(f for _, f in won) == ["x", "y", "z"]
    owner = {f: f"p{k}" for k, f in won}
    # The owner keeps what it has, after a restart too; others get it once it is released.
    assert J.claim(spark, claims, ["x"], owner["x"]) == ["x"] and J.claim(spark, claims, ["x"], "other") == []
    mine = sum(v == owner["x"] for v in owner.values())
    assert J.release(spark, claims, owner["x"]) == mine and J.claim(spark, claims, ["x"], "other") == ["x"]
    # A claim that was never named is free after a while.
    empty = tmp_path / "claims" / J.hashlib.sha256(b"w").hexdigest()
    empty.touch()
    assert J.claim(spark, claims, ["w"], "p") == [] and J.claim(spark, claims, ["w"], "p", grace=-1.0) == ["w"]


def test_an_error_is_cured_by_a_later_run(spark, tmp_path):
    put(tmp_path / "jobs", (1, "bad"), (2, "good"))
    out, cp = str(tmp_path / "manifest"), str(tmp_path / "cp")

    def motion(healthy):
        return lambda d: d.select("job_id", (F.lit(healthy) | (F.col("acquisition") != "bad")).alias("ok"))

    def run(healthy):
        stages = [("motion", motion(healthy), True), ("nmf", works, False)]
        J.process(J.watch(spark, str(tmp_path / "jobs"), 5), out, cp, stages).awaitTermination()
        return states(spark, out)

    assert run(False) == {1: "error", 2: "done"}
    put(tmp_path / "jobs", (1, "bad"))
    assert run(True) == {1: "done", 2: "done"}
    entries = J.manifest(spark, out)
    assert entries.where("job_id = 2").count() == 2 and entries.where("job_id = 1 and stage = 'nmf'").count() == 1


def test_a_replayed_batch_looks_at_its_own_attempt(spark, tmp_path):
    out = str(tmp_path / "manifest")
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], J.JOB)
    seen = []

    def stages(ok):
        def nmf(d):
            seen.append(sorted(r.job_id for r in d.collect()))
            return works(d)

        return [("motion", lambda d: d.select("job_id", (F.lit(ok) | (F.col("job_id") == 2)).alias("ok")), True), ("nmf", nmf, True)]

    J.run_batch(jobs, 7, out, stages(False))
    J.run_batch(jobs, 7, out, stages(True))
    # Job 1 failed in the first run of the batch and goes through in the second; job 2 is not worked on again.
    assert seen == [[2], [1]] and states(spark, out) == {1: "done", 2: "done"}
    # A later failure counts again.
    J.record(spark.createDataFrame([(2, "error", "lost")], "job_id long, state string, message string"), "nmf", 9, out)
    assert states(spark, out) == {1: "done", 2: "error"}


def test_archive_and_manifest_by_stage(spark, tmp_path):
    put(tmp_path / "jobs", (1, "a"), (17, "b"))
    out, cp, old = str(tmp_path / "manifest"), str(tmp_path / "cp"), tmp_path / "archive"
    run = lambda: J.process(J.watch(spark, str(tmp_path / "jobs"), archive=str(old)), out, cp, [("motion", works, True)]).awaitTermination()
    run()
    put(tmp_path / "jobs", (3, "c"))
    run()
    assert states(spark, out, 1) == {1: "done", 17: "done", 3: "done"} and len(list(old.rglob("*.json"))) >= 2
    plan = J.manifest(spark, out).where("stage = 'motion' and slot in (1)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stage" in plan and "slot" in plan.split("PartitionFilters")[1].split("]")[0]


def test_log(spark, tmp_path):
    out = str(tmp_path / "manifest")
    J.run_batch(spark.createDataFrame([(1, "a")], J.JOB), 0, out, [("motion", works, True)])
    lines = J.log_lines(J.manifest(spark, out))
    assert J.append_log(lines, str(tmp_path / "log")) and J.append_log(lines, str(tmp_path / "log"))
    assert all(r.value.count("\t") == 6 for r in spark.read.text(str(tmp_path / "log")).collect()) and spark.read.text(str(tmp_path / "log")).count() == 2
    (tmp_path / "file").write_text("no folder")
    with pytest.warns(UserWarning, match="log not written"):
        assert not J.append_log(lines, str(tmp_path / "file" / "log"), wait=0.01)
