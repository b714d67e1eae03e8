"""Kernels on synthetic truth, sources by round trip, streaming by replay."""

import json

import numpy as np
import pytest

from framelake.operators import baseline as B
from framelake.operators import movie as M
from framelake.operators import registration as R
from framelake.operators import segmentation as G
from framelake.sources import tiff
from framelake.streaming import jobs as J


def blobs(h=64, w=64, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return sum(a * np.exp(-((y - r) ** 2 + (x - c) ** 2) / 18) for a, r, c in zip(rng.uniform(50, 100, 12), rng.uniform(12, h - 12, 12), rng.uniform(12, w - 12, 12)))


def test_subpixel_shift():
    ref = blobs()
    for dy, dx in ((1.3, -2.4), (0.0, 0.5), (-3.0, 2.2)):
        moved = R.warp(ref, dy, dx, 0.0)
        got = R.subpixel_shift(ref, moved)
        assert abs(got[0] - dy) < 0.06 and abs(got[1] - dx) < 0.06


def test_compose_is_warping_twice():
    y, x = np.mgrid[:64, :64] / 63
    ref = 50 * np.sin(7 * x + 1) * np.cos(6 * y)
    first, second = (np.sin(3 * x), np.cos(2 * y)), (y * x, -0.8 * y)
    twice = R.warp(np.nan_to_num(R.warp(ref, *first)), *second)
    once = R.warp(ref, *R.compose(first, second))
    assert np.nanmax(np.abs(twice - once)[6:-6, 6:-6]) < 0.5


def test_line_displacement():
    ref = blobs() + 10
    lines = R.line_basis(64, 4) @ np.array([0.5, -1.0, 1.2, 0.3, -0.6])
    y, x = np.mgrid[:64, :64].astype(float)
    frame = R.sample(ref, y, x - lines[:, None], 10.0)
    _, dx, r = R.line_displacement(ref, frame)
    assert r > 0.98 and np.abs(dx - lines)[8:-8].mean() < 0.35


def test_correct_motion(spark):
    ref = blobs(32, 32, 3)
    moves = [(0, 0), (1, -1), (-1, 2), (0, 1)]
    rows = [(0, k, R.flat(R.warp(ref, dy, dx, 0.0))) for k, (dy, dx) in enumerate(moves)]
    frames = spark.createDataFrame(rows, "movie long, frame long, values array<double>")
    for strategy in R.STRATEGIES:
        fixed = R.correct_motion(frames, 32, 32, strategy).collect()
        assert len(fixed) == 4 and all(len(r["values"]) == 1024 for r in fixed)
    reference = spark.createDataFrame([(0, R.flat(np.sqrt(ref)))], "movie long, reference array<double>")
    got = {r.frame: (r.dy, r.dx) for r in R.frame_shifts(frames, reference, 32).collect()}
    assert all(abs(got[k][0] - dy) < 0.2 and abs(got[k][1] - dx) < 0.2 for k, (dy, dx) in enumerate(moves))


def test_two_cells(spark):
    rng = np.random.default_rng(0)
    h = w = 10
    act = rng.poisson(2.0, (2, 400)).astype(float)
    mov = rng.normal(0, 0.6, (h, w, 400))
    mov[2:5, 2:5] += act[0]
    mov[6:9, 5:9] += act[1]
    series = mov.transpose(1, 0, 2).reshape(h * w, 400)
    r = np.corrcoef(series)
    pairs = spark.createDataFrame([(int(i), int(j), float(r[i, j])) for i in range(100) for j in range(i, 100)], "px_i int, px_j int, r double")
    seeds = spark.createDataFrame([(3 + 3 * h,), (7 + 7 * h,)], "px int")
    near = G.seed_neighbourhoods(pairs, seeds, 21, h, w)
    found = G.region_of(G.cluster_seeds(near, h, 2), h, w).toPandas()
    for seed, cell in ((33, np.s_[2:5, 2:5]), (77, np.s_[6:9, 5:9])):
        truth = np.zeros((h, w), bool)
        truth[cell] = True
        got = np.zeros((h, w), bool)
        px = found.loc[found.seed == seed, "px"].to_numpy()
        got[px % h, px // h] = True
        assert (got & truth).sum() / (got | truth).sum() > 0.8


def test_robust_fits(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(-1, 1, 600)
    truth = 100 + 5 * x + 20 * np.exp(-x)
    y = truth + rng.normal(0, 1, 600) + (rng.random(600) < 0.08) * 60
    assert np.abs(B.baseline(y) / truth - 1).max() < 0.02
    n = rng.normal(10, 2, 500)
    rows = [(1, k, float(0.7 * v + 3 + e), float(v)) for k, (v, e) in enumerate(zip(n, rng.normal(0, 0.1, 500) + (rng.random(500) < 0.1) * 8))]
    got = B.neuropil_coefficients(spark.createDataFrame(rows, "roi_id int, frame int, raw double, neuropil double")).first()
    assert abs(got.slope - 0.7) < 0.1


def test_line_shift_recovers_comb(spark):
    rng = np.random.default_rng(4)
    base = np.repeat(rng.normal(size=(8, 16)), 2, axis=0)
    for s in (-2, 0, 3):
        img = base.copy()
        img[1::2, 2:14] = np.roll(img[1::2, 2:14], -s, axis=1)
        rows = [(r, c, float(img[r, c])) for r in range(16) for c in range(16)]
        scores = M.line_shift_scores(spark.createDataFrame(rows, "row_ int, col_ int, mean double"), 16, 16).collect()
        assert len(scores) == 7 and max(scores, key=lambda r: r.score)["shift"] == s


def test_constant_pixel_is_null(spark):
    cov = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 1, 2.0)], "px_i int, px_j int, cov double")
    got = {(r.px_i, r.px_j): r.r for r in M.pixel_correlation(cov).collect()}
    assert got == {(0, 0): None, (0, 1): None, (1, 1): 1.0}


def test_tiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    stacks = {f"a{k}.tif": [rng.integers(-32768, 32767, (5, 7)).astype(np.int16) for _ in range(n)] for k, n in enumerate((3, 2))}
    for name, images in stacks.items():
        (tmp_path / name).write_bytes(tiff.stack_bytes(images))
    rows = tiff.number_files(tiff.read_stacks(spark, str(tmp_path))).orderBy("frame").collect()
    assert [(r.movie, r.frame, r.frame_in_movie) for r in rows] == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 3, 0), (1, 4, 1)]
    for r in rows:
        want = stacks[r.path.rpartition("/")[2]][r.frame_in_movie]
        assert (np.array(r["values"]).reshape(7, 5).T == want).all()
    some = tiff.read_stacks(spark, str(tmp_path), [2, 0]).collect()
    assert sorted((r.path[-6:-4], r.frame_in_movie) for r in some) == [("a0", 0), ("a0", 2), ("a1", 0)]


def test_pixel_major_store_prunes(spark, tmp_path):
    rows = [(f, p, float(f * 10 + p)) for f in range(4) for p in range(6)]
    tiff.write_pixel_major(spark.createDataFrame(rows, "frame long, px int, v double"), str(tmp_path / "px"))
    assert sorted((r.frame, r.v) for r in tiff.read_pixels(spark, str(tmp_path / "px"), [3], 1, 2).collect()) == [(1, 13.0), (2, 23.0)]
    got = spark.read.parquet(str(tmp_path / "px")).where("px = 3")
    assert got.first().series == [3.0, 13.0, 23.0, 33.0]
    assert "PushedFilters: [IsNotNull(px), EqualTo(px,3)]" in got._jdf.queryExecution().toString()


def test_jobs_once(spark, tmp_path):
    inbox, out = tmp_path / "jobs", str(tmp_path / "manifest")
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.json").write_text(json.dumps({"job_id": k, "acquisition": f"a{k}"}))
    from pyspark.sql import functions as F

    stages = [("motion", lambda d: d.select("job_id", F.col("job_id") != 1), True), ("nmf", lambda d: d.select("job_id", F.lit(True)), True)]
    stages = [(n, (lambda f: lambda d: f(d).toDF("job_id", "ok"))(f), m) for n, f, m in stages]
    for _ in range(2):
        J.process(J.watch(spark, str(inbox)), out, str(tmp_path / "cp"), stages).awaitTermination()
    entries = J.manifest(spark, out)
    assert entries.where("state = 'done'").groupBy("job_id", "stage").count().where("count > 1").count() == 0
    assert {r.job_id: r.state for r in J.job_states(entries, 2).collect()} == {0: "done", 1: "error", 2: "done"}


def test_jobs_that_raise_or_are_stopped(spark, tmp_path):
    from pyspark.sql import functions as F

    inbox, out = tmp_path / "jobs", str(tmp_path / "manifest")
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.json").write_text(json.dumps({"job_id": k, "acquisition": f"a{k}"}))

    def motion(jobs):
        if jobs.where("job_id = 1").count():
            raise ValueError("no such file")
        if jobs.where("job_id = 2").count():
            (tmp_path / "stop").touch()
        return jobs.select("job_id", F.lit(True).alias("ok"))

    stages = [("motion", motion, True), ("nmf", lambda d: d.select("job_id", F.lit(True).alias("ok")), False)]
    J.process(J.watch(spark, str(inbox)), out, str(tmp_path / "cp"), stages, stop=str(tmp_path / "stop")).awaitTermination()
    entries = J.manifest(spark, out)
    states = {r.job_id: r.state for r in J.job_states(entries, 2).collect()}
    assert states[1] in ("error", "jobs") and states[2] == "jobs" and states[0] in ("done", "jobs")
    assert states[1] != "error" or "no such file" in entries.where("job_id = 1 and state = 'error'").first().message
    lines = [r.line for r in J.log_lines(entries).collect()]
    assert len(lines) == entries.count() and all(line.count("\t") == 5 for line in lines)
    jobs = spark.createDataFrame([(k, f"a{k}") for k in range(3)], J.JOB)
    assert {r.job_id for r in J.again(jobs, entries, 2).collect()} == {k for k, s in states.items() if s == "jobs"}
