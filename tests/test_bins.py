"""Streamed bins against bins of the whole recording, under disorder, replays and restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import movie as M
from framelake.operators import nonrigid as N
from framelake.sources import views as V
from framelake.streaming import bins as B


def recording(lengths, pixels=10, seed=0):
    rng = np.random.default_rng(seed)
    return [("r", m, z, f, rng.normal(size=pixels).tolist()) for m, z in enumerate(lengths) for f in range(z)]


def by_hand(rows, lengths, n, mean=True):
    values = {(m, f): np.array(v) for _, m, _, f, v in rows}
    out, k = {}, 0
    for m, z in enumerate(lengths):
        for b in range(z // n):
            total = sum(values[m, b * n + i] for i in range(n))
            for px, v in enumerate(total / n if mean else total):
                out[k, px] = v
            k += 1
    return out


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, B.FRAMES).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, n, how="avg", most=1):
    B.store_bins(B.watch(spark, f"{folder}/in", most), n, f"{folder}/store", f"{folder}/checkpoint", how, tile=4).awaitTermination()
    return {(r.bin, r.px): r.v for r in B.read_bins(spark, f"{folder}/store", 4).collect()}


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_disorder_replays_and_restarts(spark, tmp_path):
    lengths, n = [9, 3, 8, 1, 13], 4
    rows = recording(lengths)
    folder, rng = str(tmp_path), np.random.default_rng(1)
    # A first run sees odd frames only, so nothing is full: all but the start waits.
    deliver(spark, [r for r in rows if r[3] % 2], f"{folder}/in")
    assert run(spark, folder, n) == {}
    # A replay of these, and the first movie's rest: its two bins leave, the partial one is dropped.
    deliver(spark, [r for r in rows if r[3] % 2 and r[1] < 3], f"{folder}/in")
    deliver(spark, [rows[k] for k in rng.permutation(9)], f"{folder}/in")
    assert {k for k, _ in run(spark, folder, n)} == {0, 1}
    deliver(spark, [rows[k] for k in rng.permutation(len(rows))], f"{folder}/in")
    deliver(spark, rows, f"{folder}/in")
    assert same(run(spark, folder, n), by_hand(rows, lengths, n))
    # Nothing new: another start changes nothing.
    assert same(run(spark, folder, n), by_hand(rows, lengths, n))


def test_a_batch_that_fails_leaves_no_trace(spark, tmp_path):
    lengths, n = [6, 7], 3
    rows = recording(lengths, seed=2)
    folder = str(tmp_path)
    deliver(spark, rows[:5], f"{folder}/in")
    run(spark, folder, n, "sum")
    # A frame of another size fails its batch; once that file is mended the stream goes on from its checkpoint.
    deliver(spark, [(*rows[5][:4], [1.0] * 7)], f"{folder}/in")
    with pytest.raises(Exception):
        run(spark, folder, n, "sum")
    bad = max((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: p.stat().st_mtime_ns)
    deliver(spark, rows[5:6], f"{folder}/mended")
    good = next((tmp_path / "mended").glob("*.parquet"))
    for mark in (tmp_path / "in").glob(".*.crc"):
        mark.unlink()
    bad.write_bytes(good.read_bytes())
    deliver(spark, rows[6:], f"{folder}/in")
    assert same(run(spark, folder, n, "sum"), by_hand(rows, lengths, n, mean=False))


def test_equals_the_bins_of_the_whole(spark, tmp_path):
    sf, n = "/root/testdata/sf0.001", 8
    frames = V.frames(spark, sf)
    B.with_lengths(frames, "all").repartition(4).write.parquet(f"{tmp_path}/in")
    B.store_bins(B.watch(spark, f"{tmp_path}/in", 2), n, f"{tmp_path}/store", f"{tmp_path}/checkpoint", tile=24).awaitTermination()
    got = {(r.bin, r.px): r.v for r in B.read_bins(spark, f"{tmp_path}/store", 24).collect()}
    whole = M.bin_frames(V.movie(spark, sf), n, "avg").withColumn("bin", F.col("bin") + F.col("movie") * (V.FILE_FRAMES // n))
    assert same(got, {(r.bin, r.px): r.v for r in whole.collect()})


def test_correction_with_its_store(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = np.cumsum(np.cumsum(rng.normal(size=(16, 16)), 0), 1)
    base = (base - base.min() + 1).T.reshape(-1)
    rows = [(m, m * 6 + f, f, (base + rng.normal(0, 0.01, 256)).tolist()) for m in range(2) for f in range(6)]
    frames = spark.createDataFrame(rows, "movie long, frame long, frame_in_movie long, values array<double>")
    got = B.correct_into_store(frames, "r", 16, 16, 0, str(tmp_path), 4)
    fixed = N.correct_recording(frames, 16, 16, 0, **N.RECORDING_STRATEGIES["lines_affine"]).join(frames.select("movie", "frame", "frame_in_movie"), ["movie", "frame"])
    want = M.bin_frames(V.explode_pixels(fixed, 16), 4, "avg")
    want = {(r.movie + r.bin, r.px): r.v for r in want.collect() if r.v is not None}
    got = {(r.bin, r.px): r.v for r in got.collect() if r.v is not None and not np.isnan(r.v)}
    assert len(got) > 300 and got.keys() <= want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
