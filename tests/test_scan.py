"""Scan motion and scattering against synthetic truth and brute force."""

import numpy as np
import pytest

from framelake.operators import images as I
from framelake.operators import nonrigid as N
from framelake.operators import registration as R
from framelake.operators import scan as S

H, W = 48, 40


def template(rng, h=H + 16, w=W + 16):
    picture = I.blur(rng.normal(size=(h, w)), 2.0)
    return (picture - picture.min()) / np.ptp(picture) + 0.2


def jitter(rng, timing, most=2.0):
    walk = np.cumsum(rng.normal(size=(2, timing.knots)), axis=1)
    walk = np.array([np.convolve(np.pad(w, 3, mode="edge"), np.ones(7) / 7, "valid") for w in walk])
    walk -= walk.mean(axis=1, keepdims=True)
    return walk / np.abs(walk).max() * most


def record(picture, knots, timing):
    rows, cols = np.mgrid[:H, :W].astype(float)
    return R.sample(picture, rows + 8 + timing.spread(knots[0]), cols + 8 + timing.spread(knots[1]))


def test_spread_and_its_transpose():
    rng = np.random.default_rng(0)
    for both in (False, True):
        timing = S.Timing(7, 5, 2, both)
        # Time by hand: pixels in reading order, a knot at the ends of equal intervals.
        design = np.zeros((35, timing.knots))
        for y in range(7):
            for x in range(5):
                at = (y * 5 + (4 - x if both and y % 2 else x) + 0.5) / 35 * timing.intervals
                k = min(int(at), timing.intervals - 1)
                design[y * 5 + x, [k, k + 1]] = 1 - (at - k), at - k
        knots, values, weights = rng.normal(size=timing.knots), rng.normal(size=(7, 5)), rng.random((7, 5))
        assert np.allclose(timing.spread(knots).ravel(), design @ knots)
        assert np.allclose(timing.gather(values), design.T @ values.ravel())
        assert np.allclose(timing.normal(weights), design.T @ (weights.ravel()[:, None] * design))


def test_splat_by_brute_force():
    rng = np.random.default_rng(1)
    values, rows, cols = rng.normal(size=60), rng.uniform(-1, 9, 60), rng.uniform(-1, 6, 60)
    rows[:3], cols[:3] = [0, 8, 3.5], [0, 5, 5]
    total, weight = np.zeros((9, 6)), np.zeros((9, 6))
    for v, r, c in zip(values, rows, cols):
        if 0 <= r <= 8 and 0 <= c <= 5:
            for y in range(9):
                for x in range(6):
                    w = max(0, 1 - abs(r - y)) * max(0, 1 - abs(c - x))
                    total[y, x] += w * v
                    weight[y, x] += w
    got = S.splat(values, rows, cols, (9, 6))
    assert np.allclose(got[0], total) and np.allclose(got[1], weight)
    # Scattering without motion gives the frame itself, and a constant frame stays constant under any.
    timing = S.Timing(H, W)
    frame = rng.random((H, W))
    assert np.allclose(S.corrected(frame, np.zeros((2, timing.knots)), timing), frame)
    assert np.allclose(S.corrected(np.full((H, W), 3.0), jitter(rng, timing), timing), 3.0)


def test_holes_are_filled_ring_by_ring():
    total, weight = np.zeros((5, 5)), np.zeros((5, 5))
    total[0, 0], weight[0, 0] = 6.0, 2.0
    assert (S.fill_holes(total, weight) == 3.0).all()
    one = S.fill_holes(total, weight, 1)
    assert np.isfinite(one).sum() == 4 and np.isnan(one[2, 2])
    assert np.isnan(S.fill_holes(np.zeros((2, 2)), np.zeros((2, 2)))).all()


@pytest.mark.parametrize("both", [False, True])
def test_known_jitter_is_recovered(both):
    rng = np.random.default_rng(2)
    for _ in range(3):
        picture, timing = template(rng), S.Timing(H, W, 4, both)
        knots = jitter(rng, timing)
        frame = record(picture, knots, timing)
        reference = picture[8 : 8 + H, 8 : 8 + W]
        got, r = S.scan_motion(reference, frame, timing)
        assert r > 0.99
        off = np.abs(np.array([timing.spread(g) - timing.spread(k) for g, k in zip(got, knots)]))[:, 4:-4, 4:-4]
        assert off.mean() < 0.3
        fixed = S.corrected(frame, got, timing)
        inner = np.s_[4:-4, 4:-4]
        assert np.abs(fixed - reference)[inner].mean() < 0.3 * np.abs(frame - reference)[inner].mean()


def test_a_bad_start_is_halved_not_followed():
    rng = np.random.default_rng(3)
    picture, timing = template(rng), S.Timing(H, W, 4)
    frame = record(picture, jitter(rng, timing, 1.0), timing)
    reference = picture[8 : 8 + H, 8 : 8 + W]
    start = np.full((2, timing.knots), 3.0)
    rows, cols = np.mgrid[:H, :W].astype(float)
    seen = R.sample(reference, rows + 3, cols + 3)
    ok = np.isfinite(seen)
    before = np.corrcoef(seen[ok], frame[ok])[0, 1]
    assert S.scan_motion(reference, frame, timing, start)[1] >= before
    # A frame of nothing has no motion to find and ends at once.
    assert S.scan_motion(reference, np.zeros((H, W)), timing)[1] == -1.0


def test_frames_of_a_movie(spark):
    rng = np.random.default_rng(4)
    picture, timing = template(rng), S.Timing(H, W, 4)
    base = jitter(rng, timing)
    truth = [base * (1 + 0.05 * k) for k in range(5)]
    frames = [record(picture, k, timing) ** 2 for k in truth] + [rng.random((H, W))]
    rows = [(0, k, R.flat(f)) for k, f in enumerate(frames)] + [(1, 9, R.flat(frames[0]))]
    table = spark.createDataFrame(rows, "movie long, frame long, values array<double>").repartition(3)
    reference = picture[8 : 8 + H, 8 : 8 + W]
    refs = spark.createDataFrame([(m, R.flat(reference)) for m in (0, 1)], "movie long, reference array<double>")
    motions = S.scan_motions(table, refs, H, W, 4)
    found = {(r.movie, r.frame): r for r in motions.collect()}
    assert all(found[0, k].ok for k in range(5)) and not found[0, 5].ok and found[1, 9].ok
    fixed = {(r.movie, r.frame): R.image(r["values"], H) for r in S.apply_scan_motions(table, motions, H, W, 4).collect()}
    for k in range(5):
        assert np.abs(np.sqrt(fixed[0, k]) - reference)[4:-4, 4:-4].mean() < 0.3 * np.abs(np.sqrt(frames[k]) - reference)[4:-4, 4:-4].mean()
    assert np.allclose(fixed[0, 5], frames[5])


def test_strips_come_from_within():
    picture = np.arange(100.0).reshape(10, 10)
    got = I.interior_strips(picture, 2)
    rows = [2, 3, 2, 3, 4, 5, 6, 7, 6, 7]
    assert (got == picture[np.ix_(rows, rows)]).all() and (I.interior_strips(picture, 0) == picture).all()


def test_an_artificial_border_does_not_move_the_interior_field():
    rng = np.random.default_rng(6)
    base = template(rng, 128, 128)
    y, x = np.mgrid[:128, :128].astype(float)
    moved = I.cubic(base, y + 2.0 * np.sin(x / 20), x + 1.5 * np.cos(y / 24), base.mean())
    dark = moved.copy()
    dark[:5], dark[-5:], dark[:, :5], dark[:, -5:] = 0, 0, 0, 0
    inner = np.s_[20:-20, 20:-20]
    clean, bordered, bare = (N.demons(base, p, margin=m) for p, m in ((moved, 0.05), (dark, 0.05), (dark, 0.0)))
    shift = [np.hypot(*(a - b for a, b in zip(clean, f)))[inner] for f in (bordered, bare)]
    assert shift[0].mean() < 0.05 and shift[0].mean() < 0.5 * shift[1].mean()
    # The field is the known one, at two pixels of motion, which one level of small steps does not reach as well.
    want = (-2.0 * np.sin(x / 20), -1.5 * np.cos(y / 24))
    off = np.hypot(*(f - w for f, w in zip(bordered, want)))[inner]
    assert off.mean() < 0.6 and off.mean() <= np.hypot(*(f - w for f, w in zip(N.demons(base, dark, levels=1), want)))[inner].mean() + 0.02


def test_peaks_beyond_the_radius_are_not_taken():
    rng = np.random.default_rng(8)
    base = template(rng, 64, 64)
    frame = np.roll(base, (20, 0), axis=(0, 1))
    assert abs(R.subpixel_shift(base, frame, 10)[0] + 20) < 0.2
    got = R.subpixel_shift(base, frame, 10, 10.0)
    assert np.hypot(*got) < 12
    assert R.subpixel_shift(base, np.roll(base, 3, axis=0), 10, 10.0)[0] == R.subpixel_shift(base, np.roll(base, 3, axis=0), 10)[0]


def test_fine_lines_follow_a_fine_warp():
    rng = np.random.default_rng(9)
    picture = template(rng, 112, 112)
    rows, cols = np.mgrid[:96, :96].astype(float)
    bend = 1.5 * np.sin(np.arange(96) / 96 * 6 * np.pi)
    frame = R.sample(picture, rows + 8 + bend[:, None], cols + 8 + 0.5 * bend[:, None])
    reference = picture[8:104, 8:104]
    coarse, fine = R.line_displacement(reference, frame), R.line_displacement(reference, frame, 16, damping=1.0, radius=10.0)
    assert fine[2] > coarse[2]
    # The frame is read at its place less the bend, as lines move together.
    assert np.abs(fine[0][8:-8] + np.interp(np.arange(96) - fine[0], np.arange(96), bend)[8:-8]).mean() < 0.4


def test_luminance_by_definition(spark):
    rng = np.random.default_rng(10)
    frame = rng.random((24, 18)) + 0.5
    frame[:, 9:] *= 20
    table = spark.createDataFrame([(0, 0, R.flat(frame))], "movie long, frame long, values array<double>")
    got = R.image(R.flattened_frames(table, 24).first()["values"], 24)
    assert np.allclose(got, frame / I.blur(frame, 2)) and abs(got[:, :5].mean() / got[:, -5:].mean() - 1) < 0.2
