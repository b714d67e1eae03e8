"""Whole-movie registration, splines, clusters and the kernel queries, against synthetic truth and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import baseline as B
from framelake.operators import catalog as C
from framelake.operators import extraction as X
from framelake.operators import images as I
from framelake.operators import movie as M
from framelake.operators import nonrigid as N
from framelake.operators import registration as R
from framelake.operators import segmentation as G
from framelake.operators import tiles as T
from framelake.plans import kernels
from framelake.sources import tiff

SF = "/root/testdata/sf0.001"


def texture(h=64, w=64, seed=3):
    rng = np.random.default_rng(seed)
    return 10 + 40 * I.blur(rng.normal(size=(h, w)), 2.5)


def test_blur_by_definition():
    picture = np.random.default_rng(0).normal(size=(9, 12))
    got = I.blur(picture, 1.0)
    k = np.exp(-0.5 * np.arange(-3, 4) ** 2.0)
    k /= k.sum()
    padded = np.pad(picture, 3, mode="edge")
    want = [[sum(k[a] * k[b] * padded[r + a, c + b] for a in range(7) for b in range(7)) for c in range(12)] for r in range(9)]
    assert np.allclose(got, want)


def test_cubic_keeps_samples_and_quadratics():
    y, x = np.mgrid[:12, :12].astype(float)
    picture = 2 + y * x + 0.5 * y**2
    at = np.array([3.25, 7.5]), np.array([4.75, 6.125])
    assert np.allclose(I.cubic(picture, *at), 2 + at[0] * at[1] + 0.5 * at[0] ** 2)
    assert np.allclose(I.cubic(picture, y, x), picture)
    assert np.isnan(I.cubic(picture, np.array([-0.1]), np.array([3.0]))).all()


@pytest.mark.parametrize("degree", [0, 1, 2, 3, 4])
def test_spline_basis(degree):
    knots = np.concatenate((np.zeros(degree), np.linspace(0, 10, 6), np.full(degree, 10.0)))
    x = np.linspace(0, 10, 41)
    basis = I.spline_basis(x, knots, degree)
    assert np.allclose(basis.sum(axis=1), 1) and (basis >= -1e-12).all() and ((basis > 1e-12).sum(axis=1) <= degree + 1).all()
    assert (I.spline_basis(np.array([-1.0, 11.0]), knots, degree) == 0).all()
    assert np.allclose(I.spline_basis(np.array([-1.0]), knots, degree, "constant"), basis[:1])


def test_spline_fit_and_slope():
    knots = np.concatenate((np.zeros(3), np.linspace(0, 10, 9), np.full(3, 10.0)))
    x = np.linspace(0, 10, 201)
    weights = I.spline_fit(x, x**3 - 4 * x, knots, 3)
    assert np.allclose(I.spline_basis(x, knots, 3) @ weights, x**3 - 4 * x, atol=1e-6)
    inner, slopes = I.spline_slope(knots, weights, 3)
    assert np.allclose(I.spline_basis(x, inner, 2) @ slopes, 3 * x**2 - 4, atol=1e-5)
    noisy = np.sin(x) + np.random.default_rng(1).normal(0, 0.2, len(x))
    rough = [np.abs(np.diff(I.spline_fit(x, noisy, knots, 3, s), 2)).sum() for s in (0.0, 1.0, 1e6)]
    assert rough[0] > rough[1] > rough[2] and rough[2] < 1e-2


def test_nearest_positive():
    matrix = np.random.default_rng(2).normal(size=(6, 6))
    near = I.nearest_positive(matrix)
    np.linalg.cholesky(near)
    even = (matrix + matrix.T) / 2
    below = np.minimum(np.linalg.eigvalsh(even), 0)
    assert np.isclose(np.linalg.norm(near - even), np.linalg.norm(below), rtol=1e-6)
    same = even @ even + np.eye(6)
    assert np.allclose(I.nearest_positive(same), same)


def test_equalise_spreads_and_keeps_order():
    y, x = np.mgrid[:64, :64] / 63
    dim = 0.4 + 0.1 * (x + y) / 2
    out = I.equalise(dim, 4, clip=1.0)
    assert out.min() >= 0 and out.max() <= 1 and np.ptp(out) > 3 * np.ptp(dim)
    assert np.allclose(I.equalise(np.full((8, 8), 0.3), 2), I.equalise(np.full((8, 8), 0.3), 2)[0, 0])


def test_affine_recovers_a_small_turn():
    ref = texture()
    turn = np.radians(2.0)
    matrix = np.array([[np.cos(turn), -np.sin(turn), 1.0], [np.sin(turn), np.cos(turn), -0.5]])
    inverse = np.linalg.inv(np.vstack((matrix, [0, 0, 1])))[:2]
    y, x = np.mgrid[:64, :64].astype(float)
    field = N.affine_displacement(inverse, 64, 64)
    moved = np.nan_to_num(I.cubic(ref, y + field[0], x + field[1]), nan=ref.mean())
    got = N.affine_displacement(N.affine_register(ref, moved), 64, 64)
    want = N.affine_displacement(matrix, 64, 64)
    error = np.hypot(got[0] - want[0], got[1] - want[1])[8:-8, 8:-8]
    assert error.mean() < 0.5, error.mean()


def test_demons_reduces_the_difference():
    ref = texture(seed=5)
    y, x = np.mgrid[:64, :64].astype(float)
    moved = I.cubic(ref, y + 1.5 * np.sin(x / 10), x + 1.2 * np.cos(y / 12), ref.mean())
    fixed = R.warp(moved, *N.demons(ref, moved, 3.0))
    inner = np.s_[8:-8, 8:-8]
    assert np.nanmean(np.abs(fixed - ref)[inner]) < 0.4 * np.abs(moved - ref)[inner].mean()


def test_scan_lines_warm_start(spark):
    ref = texture(32, 32) + 20
    y, x = np.mgrid[:32, :32].astype(float)
    rows = []
    for k in range(4):
        d = 0.5 * k * np.sin(np.linspace(0, 3, 32))
        rows.append((0, k, R.flat(R.sample(ref, y, x - d[:, None], float(ref.mean())) ** 2)))
    frames = spark.createDataFrame(rows, "movie long, frame long, values array<double>")
    reference = spark.createDataFrame([(0, R.flat(ref))], "movie long, reference array<double>")
    got = {r.frame: r for r in N.scan_line_shifts(frames, reference, 32).collect()}
    assert all(r.ok and r.r > 0.97 for r in got.values())
    d = 1.5 * np.sin(np.linspace(0, 3, 32))
    assert np.abs(np.array(got[3].dx) - d)[4:-4].mean() < 0.4


def test_recursive_mean_counts_every_frame(spark):
    ref = texture(16, 16)
    rows = [(m, k, R.flat(np.roll(ref, (k % 3, -k % 2), (0, 1)))) for m, n in ((0, 7), (1, 1)) for k in range(n)]
    frames = spark.createDataFrame(rows, "movie long, frame long, values array<double>")
    got = {r.movie: r for r in N.recursive_mean(frames, 16).collect()}
    assert {m: r.n for m, r in got.items()} == {0: 7, 1: 1}
    assert np.allclose(R.image(got[0].image, 16), ref)
    assert N.recursive_mean(frames.limit(0), 16).count() == 0


def test_control_points(spark):
    matrix = np.array([[0.7, 0.1, 3.0], [-0.2, 0.9, 1.0]])
    points = [(1, float(y), float(x), *map(float, matrix @ [y, x, 1])) for y, x in ((0, 0), (10, 0), (0, 10), (9, 11))] + [(2, 0.0, 0.0, 1.0, 1.0)]
    got = {r.movie: r.matrix for r in N.control_point_affine(spark.createDataFrame(points, "movie int, y double, x double, y2 double, x2 double")).collect()}
    assert np.allclose(got[1], matrix.ravel()) and got[2] is None


def test_recording_onto_reference_movie(spark):
    ref = texture(32, 32, 7) + 20
    y, x = np.mgrid[:32, :32].astype(float)
    rows = [(m, 3 * m + k, R.flat(I.cubic(ref, y + m * 1.0, x - m * 2.0, float(ref.mean())))) for m in (0, 1) for k in range(3)]
    frames = spark.createDataFrame(rows, "movie long, frame long, values array<double>")
    for name, options in N.RECORDING_STRATEGIES.items():
        fixed = N.correct_recording(frames, 32, 32, 0, **options).where("movie = 1").collect()
        assert len(fixed) == 3
        for r in fixed:
            off = np.abs(R.image([np.nan if v is None else v for v in r["values"]], 32) - ref)[6:-6, 6:-6]
            assert np.nanmean(off) < 0.35 * np.abs(np.roll(ref, (-1, 2), (0, 1)) - ref).mean(), name


def test_split_and_background(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 300))
    series = np.array([a + 0.3 * rng.normal(size=300) for _ in range(5)] + [b + 0.3 * rng.normal(size=300) for _ in range(3)])
    r = np.corrcoef(series)
    pairs = spark.createDataFrame([(0, i, j, float(r[i, j])) for i in range(8) for j in range(i, 8)], "seed int, px_i int, px_j int, r double")
    clusters = spark.createDataFrame([(0, p, 2) for p in range(8)] + [(0, 9, 4)], "seed int, px int, cluster int")
    got = {x.px: x.cluster for x in G.split_cluster(clusters, pairs, 2).collect()}
    assert got == {**{p: 2 for p in range(5)}, **{p: 5 for p in range(5, 8)}, 9: 4}
    features = spark.createDataFrame([(0, 0, 1, [0.0, 0.0]), (0, 1, 2, [3.0, 4.0]), (0, 2, 3, [1.0, -1.0]), (0, 3, 3, [-1.0, 1.0])], "seed int, px int, cluster int, vector array<double>")
    assert G.background_cluster(features).collect() == [(0, 3)]


def test_count_cuts():
    assert G.count_cuts(np.concatenate(([0.01, 0.05], np.linspace(0.8, 0.98, 18)))) == 2
    assert G.count_cuts(np.linspace(0.1, 1, 20) + 0.001 * np.sin(np.arange(20))) == 1


def test_polygon_by_brute_force(spark):
    corners = [(0.5, 0.5), (6.5, 2.5), (3.5, 3.2), (6.2, 6.5), (1.2, 5.1)]
    grid = spark.range(64).select((F.col("id") % 8).alias("r"), F.expr("id div 8").alias("c"))
    got = {(x.r, x.c) for x in grid.where(G.inside_polygon(F.col("r"), F.col("c"), corners)).collect()}

    def winding(r, c):
        turns = [np.arctan2(r1 - r, c1 - c) - np.arctan2(r0 - r, c0 - c) for (r0, c0), (r1, c1) in zip(corners, corners[1:] + corners[:1])]
        return abs(sum((t + np.pi) % (2 * np.pi) - np.pi for t in turns)) > np.pi

    assert got == {(r, c) for r, c in itertools.product(range(8), range(8)) if winding(r, c)}


def test_unknown_header_fails(spark):
    meta = spark.createDataFrame([(1, {"other": 1.0})], "id int, fields map<string,double>")
    with pytest.raises(Exception, match="unknown scanner header"):
        C.scanner_layout(meta).collect()
    old = spark.createDataFrame([(1, {"acq.numberOfChannelsSave": 2.0})], "id int, fields map<string,double>")
    assert C.scanner_layout(old, 0.1).collect() == [(1, False, 2, 1, 0, 0.1)]


def test_deconvolution_solves_its_problem():
    """Against the best of many projected-gradient steps on the events themselves."""
    rng = np.random.default_rng(4)
    events = (rng.random(60) < 0.1) * rng.uniform(1, 3, 60)
    decay, penalty = 0.8, 0.1
    grow = np.tril(decay ** np.maximum(np.arange(60)[:, None] - np.arange(60)[None], 0))
    y = grow @ events + rng.normal(0, 0.2, 60)
    got = X.deconvolve(y, decay, penalty)
    s = np.zeros(60)
    rate = 1 / np.linalg.norm(grow, 2) ** 2
    for _ in range(40000):
        s = np.maximum(s - rate * (grow.T @ (grow @ s - y) + penalty), 0)
    cost = [0.5 * np.sum((grow @ e - y) ** 2) + penalty * e.sum() for e in (s, got[1])]
    assert cost[1] <= cost[0] + 1e-3 and np.allclose(grow @ got[1], got[0])
    assert [len(a) for a in X.deconvolve(np.zeros(0), 0.5, 0.0)] == [0, 0]


def test_footprints_and_traces(spark):
    rng = np.random.default_rng(8)
    act = rng.exponential(1.0, (4, 40))
    masks = [np.zeros((8, 8)) for _ in range(4)]
    for m, (r, c) in zip(masks, ((0, 0), (0, 4), (4, 0), (4, 4))):
        m[r + 1 : r + 3, c + 1 : c + 3] = rng.uniform(0.5, 1, (2, 2))
    rows = [(f, r + 8 * c, float(sum(m[r, c] * a[f] for m, a in zip(masks, act)))) for f in range(40) for r in range(8) for c in range(8)]
    movie = spark.createDataFrame(rows, "frame long, px int, v double")
    weights = X.footprints(movie, 1, 4, 8, 8)
    got = X.footprint_traces(movie, weights).toPandas()
    for patch, k in ((0, 0), (2, 1), (1, 2), (3, 3)):
        f = got[got.patch == patch].sort_values("frame")["f"].to_numpy()
        assert len(f) == 40 and np.corrcoef(f, act[k])[0, 1] > 0.999


def test_source_results_add_up(spark):
    """Background and sources explain the movie's mean; traces have a decay and events for every source and frame."""
    rng = np.random.default_rng(8)
    act = rng.gamma(0.4, 3, (2, 60))
    rows = [(f, r + 4 * c, 5.0 + float(act[c // 2, f])) for f in range(60) for r in range(4) for c in range(4)]
    movie = spark.createDataFrame(rows, "frame long, px int, v double")
    found = X.source_results(movie, 2, 4, 4, 4)
    weights, background = found["sources"].toPandas(), found["background"].toPandas().set_index("px")["b"]
    traces = found["traces"].toPandas()
    mean = traces.groupby("roi_id")["f"].mean()
    own = weights.assign(m=[w * mean[f"{p}-{c}"] for p, c, w in weights[["patch", "component", "weight"]].itertuples(index=False)]).groupby("px")["m"].sum()
    want = movie.groupBy("px").avg("v").toPandas().set_index("px")["avg(v)"]
    assert all(abs(background[px] + own.get(px, 0.0) - want[px]) < 1e-9 for px in want.index)
    assert len(traces) == 2 * 60 and (traces["event"] >= 0).all() and found["models"].count() == 2
    totals = spark.createDataFrame([(0, 0, 30, 60), (0, 1, 20, 60), (1, 0, 60, 90), (1, 1, 50, 90)], "block int, slice int, slice_frames long, valid_frames long")
    fewer = X.source_results(movie, 2, 4, 4, 4, totals=totals)["traces"].select("frame").distinct().collect()
    assert {r.frame for r in fewer} == {*range(20), *range(30, 60)}
    assert X.minimal_sync(spark.createDataFrame([(0, 4), (1, 6)], "movie int, z long")).first().asDict() == {"slice_frames": 10, "valid_frames": 10}


def test_replicates_find_the_better_clusters():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (12, 2)) for c in ((0, 0), (5, 5), (0.0, 5), (5, 0), (2.5, 2.5))])
    cost = lambda own: sum(np.abs(points[own == c] - np.median(points[own == c], axis=0)).sum() for c in np.unique(own))
    one, ten = G.l1_clusters(points, 5, replicates=1), G.l1_clusters(points, 5)
    assert cost(ten) <= cost(one) and len(np.unique(ten)) == 5


def test_stores(spark, tmp_path):
    bins = spark.createDataFrame([(b, p, float(b)) for b in range(3) for p in range(2)], "bin long, px int, v double")
    for _ in range(2):
        tiff.append_bins(bins, str(tmp_path / "bins"))
    assert sorted(r.bin for r in spark.read.parquet(str(tmp_path / "bins")).select("bin").distinct().collect()) == list(range(6))
    # A batch that is tried again replaces itself and keeps its numbers.
    for _ in range(2):
        tiff.append_bins(bins, str(tmp_path / "more"), "a")
        tiff.append_bins(bins, str(tmp_path / "more"), "b")
    assert sorted((r.batch, r.bin) for r in spark.read.parquet(str(tmp_path / "more")).where("px = 0").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)]
    tiff.write_covariance(spark.createDataFrame([(0, 1, 2.0)], "px_i int, px_j int, cov double"), str(tmp_path / "cov"), neighbourhood=3, bin=8)
    assert spark.read.parquet(str(tmp_path / "cov/settings")).first().asDict() == {"neighbourhood": 3, "bin": 8}
    for v in (1, 2, 2):
        tiff.write_snapshot(spark.range(v), str(tmp_path / "snap"), v)
    assert spark.read.parquet(str(tmp_path / "snap")).where("version = 2").count() == 2


def test_headers(spark, tmp_path):
    text = "SI4.fastZEnable = true\nSI4.stackNumSlices = 4\nSI4.fastZDiscardFlybackFrames = 1\nSI4.channelsSave = [1;2]\nSI4.scanFramePeriod = 0.05\nSI4.name = 'x'\n"
    # Behind the pixels, and past the first hundred thousand bytes.
    data = tiff.stack_bytes([np.zeros((300, 400), np.int16), np.ones((2, 3), np.int16)], "note = none\n" * 20_000 + text)
    (tmp_path / "a.tif").write_bytes(data)
    got = C.scanner_layout(tiff.read_headers(spark, str(tmp_path / "*.tif"))).first()
    assert (got.stack, got.channels, got.slices, got.flyback, got.period) == (True, 2, 4, 1, 0.05)


def test_stacks_give_what_single_frames_give():
    rng = np.random.default_rng(3)
    ref = np.stack([I.blur(rng.random((12, 10)) * 50, 1.0) for _ in range(5)])
    frames = np.stack([R.warp(r, dy, dx, float(r.mean())) for r, (dy, dx) in zip(ref, [(0, 0), (0.7, -0.4), (1.2, 0.3), (-0.6, 0.9), (0.2, 0.1)], strict=True)])
    frames[4, :, 3] = np.nan
    frames[0] = 1.0
    found = R.line_displacements(ref, frames)
    for k in range(5):
        assert all(np.allclose(a[k], b, atol=1e-9) for a, b in zip(found, R.line_displacement(ref[k], frames[k]), strict=True))
    whole = np.nan_to_num(frames)
    matrices = N.affine_registers(ref, whole, 40)
    assert all(np.allclose(m, N.affine_register(a, b, 40)) for m, a, b in zip(matrices, ref, whole, strict=True))
    fields, field = N.affine_displacement(matrices, 12, 10), N.affine_displacement(matrices[2], 12, 10)
    assert np.allclose(fields[0][2], field[0]) and np.allclose(fields[1][2], field[1])
    moved = R.compose(fields, fields)
    assert np.allclose(moved[0][2], R.compose(field, field)[0])
    shifted = N.demons(ref, whole, 1.0)
    assert all(np.allclose(shifted[0][k], N.demons(ref[k], whole[k], 1.0)[0]) for k in range(5))


def test_small_frames_meet_a_kernel_in_bounded_stacks(spark):
    rows = [(0, k, [float(k)] * (64 if k < 1500 else 48)) for k in range(1600)]
    frames = spark.createDataFrame(rows, "movie int, frame int, values array<double>").coalesce(1)
    found = R.per_stack(frames, lambda v: (v[:, 0], np.full(len(v), v.size), v[:, :2]), ["values"], "first double, size long, two array<double>").orderBy("frame").collect()
    assert [r.first for r in found] == [float(k) for k in range(1600)] and found[7].two == [7.0, 7.0]
    assert found[0].size == R.STACK_PIXELS and max(r.size for r in found) <= R.STACK_PIXELS and found[-1].size == 100 * 48


@pytest.mark.parametrize("nonrigid", [False, True])
def test_small_movies_are_registered_by_all_cores(spark, nonrigid):
    rng = np.random.default_rng(3)
    frames = spark.createDataFrame([(m, m, rng.random(64).tolist()) for m in range(96)], "movie long, frame long, values array<double>")
    fields = N.movie_fields(N.mean_images(frames), 0, 8, 8, nonrigid, 1.0, rounds=2)
    parts = fields.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in parts) == 96
    assert len(parts) == 8 and max(r["count"] for r in parts) <= 32  # all were in one task


def test_mean_images_do_not_depend_on_the_order_of_frames(spark):
    rng = np.random.default_rng(4)
    values = 1 + rng.random((50, 64))
    frames = spark.createDataFrame([(0, k, values[k].tolist()) for k in range(50)], "movie long, frame long, values array<double>")

    def pictures(images, name):
        return [images(frames.coalesce(1).sortWithinPartitions(order)).first()[name] for order in (F.asc("frame"), F.desc("frame"))]

    (a, b), (c, d) = pictures(N.mean_images, "image"), pictures(R.reference_images, "reference")
    assert a == b and c == d  # their last digits differed, which can send a registration elsewhere
    assert np.allclose(a, values.mean(axis=0), rtol=1e-9, atol=0) and np.allclose(c, np.sqrt(values).mean(axis=0), rtol=1e-9, atol=0)
    small = N.mean_images(frames.withColumn("values", F.transform("values", lambda v: v * 1e-12))).first()["image"]
    assert np.allclose(small, values.mean(axis=0) * 1e-12, rtol=1e-9, atol=0)


def test_pair_correlations_do_not_shuffle_pairs(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(40, 6))
    movie = spark.createDataFrame([(t, p, float(data[t, p])) for t in range(40) for p in range(6) if (t, p) != (7, 2)], "frame int, px int, v double")
    lists = [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 3), (2, 5)]
    found = G.movie_correlations(movie, spark.createDataFrame(lists, "seed int, px int"))
    got = sorted(tuple(r) for r in found.collect())
    want = sorted((s, i, j) for s, i in lists for z, j in lists if s == z and i <= j)
    assert [r[:3] for r in got] == want
    for _, i, j, r in got:
        there = np.array([t for t in range(40) if 2 not in (i, j) or t != 7])
        assert abs(r - np.corrcoef(data[there, i], data[there, j])[0, 1]) < 1e-9
    plan = found._jdf.queryExecution().analyzed().toString()
    assert not any("Join" in line and "frame" in line for line in plan.splitlines())  # pairs were joined frame by frame


def test_discovery_keeps_file_numbers_of_more_than_three_digits(spark, tmp_path):
    folder = tmp_path / "AM100" / "240101"
    folder.mkdir(parents=True)
    names = ["AM100_run001_002.tif", "AM100_run001_1000.tif", "AM100_run001_12345.tif"]
    for name in [*names, "AM100_run001_12.tif", "AM100_Slice01_File1000.tif"]:
        (folder / name).write_bytes(b"x")
    found = C.discover(spark, str(tmp_path)).orderBy("name").select("name", "movie").collect()
    assert [tuple(r) for r in found] == [(n, k) for k, n in enumerate(names)]


def test_catalog_is_saved_and_loaded(spark, tmp_path):
    files = spark.createDataFrame([("s", f"/x/run_{k:03d}.tif") for k in (2, 1, 10)], "session string, path string")
    rows = C.initialise_sessions(files)
    assert sorted((r.acquisition, r.movie, r.output) for r in rows.collect()) == [("run", k, f"run_Slice01_Channel01_File{k + 1:03d}.tif") for k in range(3)]
    for _ in range(2):
        C.write_catalog(rows, str(tmp_path / "c"), "run")
    C.write_catalog(rows.limit(1), str(tmp_path / "c"), "other")
    assert C.read_catalog(spark, str(tmp_path / "c"), "run").count() == 3 and C.read_catalog(spark, str(tmp_path / "c")).count() == 4


def test_own_extensions(spark):
    from pyspark.sql import functions as F

    C.register_namer("plain", lambda a, s, c, m: F.format_string("%s-%d", a, m))
    C.register_initialiser("one", lambda files: files.withColumns({"acquisition": F.lit("a"), "movie": F.lit(4)}))
    R.register_strategy("still", lambda f, r, h, w: f.select("movie", "frame", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx")))
    files = spark.createDataFrame([("s", "p")], "session string, path string")
    assert C.initialise_sessions(files, "one", "plain").first().output == "a-5"
    frames = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0, 4.0])], "movie long, frame long, values array<double>")
    try:
        assert R.correct_motion(frames, 2, 2, "still").first()["values"] == [1.0, 2.0, 3.0, 4.0]
    finally:
        del R.STRATEGIES["still"]


@pytest.mark.parametrize("strategy", ["full_frame", "segment_consensus", "within_frame"])
def test_movies_are_brought_onto_the_reference_movie(spark, strategy):
    rng = np.random.default_rng(11)
    y, x = np.mgrid[:48, :48].astype(float)
    spots = rng.uniform(10, 38, (25, 2))
    scene = lambda dy, dx: 10 + 100 * sum(np.exp(-((y - a - dy) ** 2 + (x - b - dx) ** 2) / 8) for a, b in spots)
    drift = {0: (0.0, 0.0), 1: (2.0, -1.5)}
    rows = [(m, 4 * m + k, R.flat(scene(dy + rng.uniform(-0.5, 0.5), dx + rng.uniform(-0.5, 0.5)))) for m, (dy, dx) in drift.items() for k in range(4)]
    frames = spark.createDataFrame(rows, "movie long, frame long, values array<double>")
    means = {}
    for reference in (None, 0):
        fixed = R.correct_motion(frames, 48, 48, strategy, reference).collect()
        stacks = {m: np.array([R.image([np.nan if v is None else v for v in r["values"]], 48) for r in fixed if r.movie == m]).mean(axis=0)[8:40, 8:40] for m in drift}
        means[reference] = np.corrcoef(stacks[0].ravel(), stacks[1].ravel())[0, 1]
    assert means[0] > 0.995 and means[0] > means[None]


def test_group_percentile_and_running_percentile_against_brute_force(spark, monkeypatch):
    from framelake.functions import compat
    from framelake.operators import traces as W

    rng = np.random.default_rng(4)
    rows = [(g, k, None if rng.random() < 0.1 else float(rng.integers(0, 30))) for g, n in ((1, 40), (2, 1), (3, 17)) for k in range(n)] + [(4, 0, None), (5, 0, float("nan")), (5, 1, 2.0)]
    df = spark.createDataFrame(rows, "g int, k int, v double")
    for percent in (0.0, 10.0, 37.0, 100.0):
        got = {r.g: r.p for r in compat.group_percentile(df, ["g"], "v", percent, "p").collect()}
        for g in range(1, 6):
            v = sorted(x for a, _, x in rows if a == g and x is not None and x == x)
            place = min(max(len(v) * percent / 100 + 0.5, 1), len(v))
            low = int(place)
            want = v[low - 1] + (place - low) * (v[min(low, len(v) - 1)] - v[low - 1]) if v else None
            assert (got[g] is None) == (want is None) and (want is None or abs(got[g] - want) < 1e-12)
    monkeypatch.setattr(W, "BLOCK", 16)
    trace = {r: rng.normal(size=n) for r, n in ((0, 100), (1, 23), (2, 10), (3, 64))}
    df = spark.createDataFrame([(r, k, float(v)) for r, t in trace.items() for k, v in enumerate(t)], "roi_id long, frame long, f double")
    for length, percent in ((5, 30), (8, 10), (11, 100)):
        got = {(r.roi_id, r.frame): r.running for r in W.running_percentile(df, length, percent).collect()}
        nth = min(-(-length * percent // 100), length - 1)
        want = {}
        for r, t in trace.items():
            if len(t) > 2 * length:
                raw = lambda k: np.sort(t[k - length // 2 : k - length // 2 + length])[nth]  # noqa: B023, E731
                want |= {(r, k): raw(min(max(k, length), len(t) - length - 1)) for k in range(len(t))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_debleached_trace_is_level(spark):
    k = np.arange(600)
    y = 50 + 30 * np.exp(-np.linspace(-1, 1, 600)) + np.random.default_rng(0).normal(0, 0.5, 600)
    df = spark.createDataFrame([(0, int(i), float(v), float(v)) for i, v in zip(k, y)], "roi_id int, frame long, raw double, neuropil double")
    out = B.debleached(df, "raw", "neuropil").toPandas().sort_values("frame")["raw"].to_numpy()
    assert abs(np.polyfit(k, out, 1)[0]) < 2e-3 and abs(out.std() - 0.5) < 0.5


def test_files_are_numbered_without_a_self_join(spark):
    rows = [(p, k) for p, n in (("b", 2), ("a", 3), ("c", 1)) for k in range(n)]
    got = tiff.number_files(spark.createDataFrame(rows, "path string, frame_in_movie long"))
    assert sorted((r.movie, r.frame) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (2, 5)]


@pytest.mark.parametrize("side, neighbourhood", [(3, 5), (4, 3), (16, 2)])
def test_tiled_covariance_equals_the_native_one(spark, side, neighbourhood):
    rng = np.random.default_rng(9)
    h, w = 10, 7
    rows = [(m, b, p, float(rng.normal() + p % 3 * b)) for m, n in ((0, 6), (1, 4)) for b in range(n) for p in range(h * w) if (m, p) != (1, 20) and rng.random() > 0.05]
    rows = [(m, b, p, None if k % 37 == 0 else v) for k, (m, b, p, v) in enumerate(rows)]
    bins = spark.createDataFrame(rows, "movie long, bin long, px int, v double")
    got, want = ({(r.px_i, r.px_j): r["cov"] for r in f(bins).collect()} for f in (lambda b: T.pixel_covariance(b, neighbourhood, h, w, side, 2), lambda b: M.pixel_covariance(b, neighbourhood, h, w)))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert T.pixel_covariance(bins.limit(0), neighbourhood, h, w, side).count() == 0


@pytest.mark.parametrize("name", sorted(kernels.queries()))
def test_kernel_query_runs(spark, name):
    df = kernels.queries()[name](spark, SF)
    first, again = (sorted(map(repr, df.collect())) for _ in range(2))
    assert first and first == again
