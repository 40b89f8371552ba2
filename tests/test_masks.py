"""Mask jobs against small plain rasters."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskloom.functions import rasters as RF
from maskloom.operators import components as C, masks as M, morphology as mo, raster_kernels as RK, refinement as rf, runs as RR, spatial


def to_pixels(spark, arrays):
    rows = [(k, a.shape[1], a.shape[0], int(x), int(y)) for k, a in arrays.items() for y, x in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, "mask_id long, w int, h int, x int, y int")


def frames_of(spark, arrays):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0]) for k, a in arrays.items()], "mask_id long, w int, h int")


def to_arrays(df, arrays):
    out = {k: np.zeros_like(a) for k, a in arrays.items()}
    for r in df.collect():
        assert not out[r.mask_id][r.y, r.x], "pixel listed twice"
        out[r.mask_id][r.y, r.x] = True
    return out


def same(df, want):
    got = to_arrays(df, want)
    for k in want:
        assert (got[k] == want[k]).all(), k


def flood(a):
    label = np.full(a.shape, -1)
    for y, x in zip(*np.nonzero(a)):
        if label[y, x] >= 0:
            continue
        first, todo = y * a.shape[1] + x, deque([(y, x)])
        label[y, x] = first
        while todo:
            j, i = todo.popleft()
            for q, p in ((j, i + 1), (j, i - 1), (j + 1, i), (j - 1, i)):
                if 0 <= q < a.shape[0] and 0 <= p < a.shape[1] and a[q, p] and label[q, p] < 0:
                    label[q, p] = first
                    todo.append((q, p))
    return label


def dilate(a, r):
    out = np.zeros_like(a)
    for y, x in zip(*np.nonzero(a)):
        out[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1] = True
    return out


def erode(a, r):
    return ~dilate(~a, r)


def drop_small(a, n):
    lab = flood(a)
    out = a.copy()
    for k in np.unique(lab[lab >= 0]):
        if (lab == k).sum() < n:
            out[lab == k] = False
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    ring = np.zeros((9, 11), bool)
    ring[1:8, 2:9] = True
    ring[3:5, 4:6] = False
    snake = np.zeros((12, 14), bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    full = np.ones((6, 5), bool)
    dot = np.zeros((5, 5), bool)
    dot[0, 4] = True
    return {1: ring, 2: snake, 3: full, 4: dot, 5: np.zeros((4, 6), bool), 6: rng.random((20, 17)) > 0.45,
            7: rng.random((13, 23)) > 0.6}


@pytest.mark.parametrize("tile", [128, 3, 5])
def test_components(spark, arrays, tile):
    got = {k: np.full(a.shape, -1) for k, a in arrays.items()}
    for r in C.labelled(to_pixels(spark, arrays), tile).collect():
        w = arrays[r.mask_id].shape[1]
        got[r.mask_id][r.y, r.x] = (r.label // C.ROW) * w + r.label % C.ROW
    for k, a in arrays.items():
        assert (got[k] == flood(a)).all(), k


@pytest.mark.parametrize("r", [1, 2, 4])
def test_morphology(spark, arrays, r):
    px = to_pixels(spark, arrays)
    same(mo.dilated(px, r), {k: dilate(a, r) for k, a in arrays.items()})
    same(mo.eroded(px, r), {k: erode(a, r) for k, a in arrays.items()})
    same(mo.eroded(px, F.lit(r) + F.col("w") * 0), {k: erode(a, r) for k, a in arrays.items()})
    same(mo.closed(px, r), {k: erode(dilate(a, r), r) for k, a in arrays.items()})
    same(mo.opened(px, r), {k: dilate(erode(a, r), r) for k, a in arrays.items()})


def test_morphology_order(arrays):
    for a in arrays.values():
        assert (erode(a, 1) <= a).all() and (a <= dilate(a, 1)).all()
        assert (a <= erode(dilate(a, 1), 1)).all() and (dilate(erode(a, 1), 1) <= a).all()


def test_small_and_holes(spark, arrays):
    px = to_pixels(spark, arrays)
    same(C.without_small(px, 5), {k: drop_small(a, 5) for k, a in arrays.items()})
    same(C.filled_holes(frames_of(spark, arrays), px, 5), {k: ~drop_small(~a, 5) for k, a in arrays.items()})


def touching(a, points):
    lab = flood(a)
    ids = set()
    for x, y in points:
        i, j = int(np.floor(x + 0.5)), int(np.floor(y + 0.5))
        if 0 <= i < a.shape[1] and 0 <= j < a.shape[0] and lab[j, i] >= 0:
            ids.add(lab[j, i])
    if not ids and (lab >= 0).any():
        names, n = np.unique(lab[lab >= 0], return_counts=True)
        ids = {names[n == n.max()].max()}
    return np.isin(lab, list(ids)) & a


def test_touching_points(spark, arrays):
    points = {1: [(2, 1)], 2: [(0.4, 5.4), (99, 99)], 4: [(0, 0)], 6: [(3, 3), (10, 12)], 7: [(-5, 0)]}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in points.items() for x, y in ps], "mask_id long, px double, py double")
    want = {k: touching(a, points[k]) if k in points else a for k, a in arrays.items()}
    same(C.touching_points(to_pixels(spark, arrays), df), want)


def strip(a, m):
    h, w = a.shape
    return {"top": np.s_[:min(m, h), :], "bottom": np.s_[max(0, h - m):, :], "left": np.s_[:, :min(m, w)], "right": np.s_[:, max(0, w - m):]}


def snap(a):
    h, w = a.shape
    share = a.mean()
    if not a.any() or share < 0.45:
        return a
    m = max(3, int(np.floor(min(w, h) * 0.02 + 0.5)))
    ys, xs = np.nonzero(a)
    near = {"top": ys.min() <= m, "bottom": ys.max() + 1 >= h - m, "left": xs.min() <= m, "right": xs.max() + 1 >= w - m}
    cov = {k: a[s].mean() for k, s in strip(a, m).items()}
    pick = [k for k, c in cov.items() if c >= 0.65 or (share >= 0.7 and c >= 0.65 * 0.75) or (near[k] and c >= 0.4)]
    if not (len(pick) >= 3 or (len(pick) >= 2 and share >= 0.65) or np.mean(list(cov.values())) >= 0.65):
        return a
    out = a.copy()
    for k in pick:
        out[strip(a, m)[k]] = True
    return erode(dilate(out, 1), 1)


def test_snapping(spark):
    rng = np.random.default_rng(8)
    arrays = {i: rng.random((12 + i, 30 - i)) > p for i, p in enumerate([0.1, 0.3, 0.35, 0.4, 0.5, 0.6])}
    block = np.zeros((40, 40), bool)
    block[1:39, 2:30] = True
    arrays[10] = block
    same(rf.snapped_to_edges(to_pixels(spark, arrays)), {k: snap(a) for k, a in arrays.items()})


def blur(v, sigma):
    k = np.array(RF.kernel(sigma))
    r = len(k) // 2

    def run(a):
        padded = np.pad(a.astype(float), ((0, 0), (r, r)), "edge")
        return sum(padded[:, i:i + a.shape[1]] * k[i] for i in range(len(k))).astype(np.float32)

    return run(run(v).T).T


def upsample(v, W, H):
    h, w = v.shape
    sy, sx = np.arange(H) / H * h, np.arange(W) / W * w
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (sy - y0)[:, None], (sx - x0)[None]
    v = v.astype(float)
    top = v[y0][:, x0] * (1 - fx) + v[y0][:, x1] * fx
    low = v[y1][:, x0] * (1 - fx) + v[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def test_refinement(spark):
    rng = np.random.default_rng(5)
    W, H = 60, 44
    rows, want, pts = [], {}, []
    for k in range(8):
        v = rng.normal(0.4 if k % 2 else 1.2, 1.2, (10, 12)).astype(np.float32)
        rows.append((k, 12, 10, [float(t) for t in v.ravel()], W, H))
        a = upsample(blur(v, 1.0), W, H) > 1.0
        if k != 3:
            p = [(float(rng.integers(W)), float(rng.integers(H)))]
            pts += [(k, *q) for q in p]
            a = touching(a, p) if a.any() else a
        a = ~drop_small(~drop_small(a, 100), 200)
        a = erode(erode(dilate(a, 3), 3), 1)
        want[k] = snap(a)
    r = spark.createDataFrame(rows, "mask_id long, w int, h int, v array<float>, out_w int, out_h int")
    p = spark.createDataFrame(pts, "mask_id long, px double, py double")
    assert any(a.any() for a in want.values())
    same(rf.refined_masks(r, p), want)


def test_text_regions(spark):
    w, h, iw, ih = 96, 64, 480, 320
    v = np.full((h, w), 0.1, np.float32)
    v[10:22, 8:40] = 0.9       # a word
    v[10:22, 50:80] = 0.55     # too unsure
    v[40:43, 5:90] = 0.95      # too thin
    v[48:60, 60:90] = 0.8
    v[50:52, 65:80] = 0.2      # a hole lowers the box mean
    maps = spark.createDataFrame([(1, w, h, [float(t) for t in v.ravel()], iw, ih)],
                                 "mask_id long, w int, h int, v array<float>, image_w int, image_h int")
    got = {r.reading_position: r for r in rf.text_regions(maps).collect()}

    def expected(x0, y0, bw, bh):
        x, y, w2, h2 = x0 * 5.0, y0 * 5.0, bw * 5.0, bh * 5.0
        d = w2 * h2 * 1.5 / (2 * (w2 + h2))
        gx, gy = max(0, x - d), max(0, y - d)
        return gx, gy, min(iw - gx, w2 + 2 * d), min(ih - gy, h2 + 2 * d)

    assert len(got) == 2
    for pos, spec in ((1, (8, 10, 32, 12)), (2, (60, 48, 30, 12))):
        assert np.allclose([got[pos][c] for c in "xywh"], expected(*spec))
        assert len(got[pos].polygon) == 4
    assert abs(got[1].confidence - 0.9) < 1e-6
    assert abs(got[2].confidence - (0.8 * 330 + 0.2 * 30) / 360) < 1e-6


def test_raster_measures(spark):
    v = np.array([[2, -2, 0.5], [1.5, 1.0, -0.5]], np.float32)
    df = spark.createDataFrame([(1, 3, 2, [float(t) for t in v.ravel()])], "mask_id long, w int, h int, v array<float>")
    r = M.raster_scores(df).first()
    pos = v > 0
    flips = (pos[:, 1:] != pos[:, :-1]).sum() + (pos[1:] != pos[:-1]).sum()
    assert (r.flips, r.positives) == (flips, pos.sum())
    assert r.stability == (v > 1).sum() / (v > -1).sum() and r.coverage == pos.mean()
    assert r.compactness == 1 - min(1, flips / (pos.sum() * 4))


def run_arrays(df, arrays):
    """Runs as rasters; runs must be maximal and inside the frame."""
    out, ends = {k: np.zeros_like(a) for k, a in arrays.items()}, set()
    for r in df.collect():
        line = out[r.mask_id][r.y]
        assert (r.w, r.h) == arrays[r.mask_id].shape[::-1] and 0 <= r.x0 <= r.x1 < r.w
        assert not line[max(r.x0 - 1, 0):r.x1 + 2].any(), "runs overlap or touch"
        line[r.x0:r.x1 + 1] = True
        ends.add((r.mask_id, r.y, r.x0))
    return out


def same_runs(df, want):
    got = run_arrays(df, want)
    for k in want:
        assert (got[k] == want[k]).all(), k


def test_runs_and_their_complement(spark, arrays):
    runs = RR.runs_of_pixels(to_pixels(spark, arrays))
    same_runs(runs, arrays)
    same(RR.pixels_of_runs(runs), arrays)
    same_runs(RR.complement(frames_of(spark, arrays), runs), {k: ~a for k, a in arrays.items()})
    same_runs(RR.united_runs(runs, RR.complement(frames_of(spark, arrays), runs)), {k: np.ones_like(a) for k, a in arrays.items()})
    rows = [(k, a.shape[1], a.shape[0], [float(v) for v in a.ravel()]) for k, a in arrays.items()]
    same_runs(RR.runs_of_rasters(spark.createDataFrame(rows, "mask_id long, w int, h int, v array<float>"), 0.5), arrays)


@pytest.mark.parametrize("r", [1, 2, 4])
def test_run_morphology(spark, arrays, r):
    runs = RR.runs_of_pixels(to_pixels(spark, arrays))
    same_runs(RR.dilated(runs, r), {k: dilate(a, r) for k, a in arrays.items()})
    same_runs(RR.eroded(runs, r), {k: erode(a, r) for k, a in arrays.items()})
    same_runs(RR.closed(runs, F.lit(r) + F.col("w") * 0), {k: erode(dilate(a, r), r) for k, a in arrays.items()})
    same_runs(RR.opened(runs, r), {k: dilate(erode(a, r), r) for k, a in arrays.items()})


@pytest.mark.parametrize("band", [64, 1, 3])
def test_run_components(spark, arrays, band):
    runs = RR.runs_of_pixels(to_pixels(spark, arrays))
    got = {k: np.full(a.shape, -1) for k, a in arrays.items()}
    for r in RR.labelled(runs, band).collect():
        got[r.mask_id][r.y, r.x0:r.x1 + 1] = (r.label // C.ROW) * r.w + r.label % C.ROW
    for k, a in arrays.items():
        assert (got[k] == flood(a)).all(), k
    same_runs(RR.without_small(runs, 5, band), {k: drop_small(a, 5) for k, a in arrays.items()})
    same_runs(RR.filled_holes(frames_of(spark, arrays), runs, 5, band), {k: ~drop_small(~a, 5) for k, a in arrays.items()})


def test_run_measures(spark, arrays):
    runs, px = RR.runs_of_pixels(to_pixels(spark, arrays)), to_pixels(spark, arrays)
    rows = lambda df: sorted(map(tuple, df.collect()))
    frames = frames_of(spark, arrays)
    assert rows(RR.run_boxes(frames, runs)) == rows(M.mask_boxes(frames, px))
    assert rows(RR.edge_coverage(runs)) == rows(M.edge_coverage(px))


def test_large_frame_has_no_row_per_pixel(spark):
    """A 2048 x 2048 frame: a disc with a hole and specks; every table has a row per line and run at most."""
    n = 2048
    y, x = np.mgrid[:n, :n]
    d2 = (y - 1000) ** 2 + (x - 900) ** 2
    a = (d2 < 800 ** 2) & (d2 >= 12 ** 2)
    a[5:9, 5:9] = True
    lines = [(1, n, n, int(r), int(s), int(e) - 1) for r in range(n) for s, e in zip(*[np.flatnonzero(np.diff(np.pad(a[r], 1).astype(np.int8)) == v) for v in (1, -1)])]
    runs = spark.createDataFrame(lines, "mask_id long, w int, h int, y int, x0 int, x1 int")
    frame = spark.createDataFrame([(1, n, n)], "mask_id long, w int, h int")
    assert RR.complement(frame, runs).count() < 3 * n
    out = rf.smoothed_runs(frame, runs, 100, 1000, 3, 1)
    rows = out.collect()
    assert len(rows) < 2 * n
    got = np.zeros((n, n), bool)
    for r in rows:
        got[r.y, r.x0:r.x1 + 1] = True

    def grow(b, r):  # plain square dilation by shifts
        for axis in (0, 1):
            b = np.logical_or.reduce([np.roll(np.pad(b, r), k, axis)[r:-r, r:-r] for k in range(-r, r + 1)])
        return b

    whole = d2 < 800 ** 2
    closed = ~grow(~grow(whole, 3), 3)
    assert (got == ~grow(~closed, 1)).all()


def plain_scores(v, offset):
    pos = v > 0
    flips = (pos[:, 1:] != pos[:, :-1]).sum() + (pos[1:] != pos[:-1]).sum()
    loose = (v > -offset).sum()
    return ((v > offset).sum() / loose if loose else 0.0, flips, pos.sum(), pos.mean(), 1 - min(1, flips / (pos.sum() * 4)) if pos.any() else 0.0)


def test_kernels_on_large_and_odd_rasters(spark):
    """256 x 256 beside other sizes in one batch; no size, too short an array, nulls inside."""
    rng = np.random.default_rng(9)
    arrays = {1: rng.normal(0, 1.5, (256, 256)), 2: rng.normal(0, 1.5, (256, 256)), 3: rng.normal(0, 1.5, (7, 31)), 4: np.full((3, 2), -1.0), 5: np.ones((1, 1))}
    arrays = {k: a.astype(np.float32) for k, a in arrays.items()}
    rows = [(k, a.shape[1], a.shape[0], [float(t) for t in a.ravel()], 300 if k < 3 else 40, 200 if k < 3 else 10, f"m{k}") for k, a in arrays.items()]
    odd = [(10, 2, 2, [1.0, None, 3.0], 4, 4, "m"), (11, 0, 5, [], 3, 3, "m"), (12, None, 3, None, 3, 3, None), (13, 2, 1, None, 3, 3, "m")]
    df = spark.createDataFrame(rows + odd, "mask_id long, w int, h int, v array<float>, out_w int, out_h int, name string").coalesce(1)

    scores = {r.mask_id: r for r in RK.raster_scores(df, 1.0).collect()}
    for k, a in arrays.items():
        r = scores[k]
        assert np.allclose((r.stability, r.flips, r.positives, r.coverage, r.compactness), plain_scores(a, 1.0)) and r.name == f"m{k}"
    assert (scores[10].positives, scores[10].flips, scores[13].positives) == (2, 2, 0)
    assert scores[11].positives is None and scores[12].stability is None and len(scores) == 9

    blurs = {r.mask_id: r.v for r in RK.blurred(df, 1.0).collect()}
    for k, a in arrays.items():
        assert (np.array(blurs[k], np.float32) == blur(a, 1.0).ravel()).all()

    bits = {r.mask_id: r for r in RK.packed(df, 0.25).collect()}
    for k, a in arrays.items():
        assert (np.unpackbits(np.frombuffer(bits[k].bits, np.uint8))[:a.size] == (a.ravel() > 0.25)).all() and bits[k].n_set == (a > 0.25).sum()
    probed = RK.packed(df.filter("mask_id = 3"), 0.25).select(F.explode(F.sequence(F.lit(0), F.lit(216))).alias("i"), "bits").select("i", RF.bit_at(F.col("bits"), F.col("i")).alias("on"))
    assert {r.i: r.on for r in probed.collect()} == dict(enumerate((arrays[3].ravel() > 0.25).tolist()))

    known = df.filter("mask_id < 10")
    want = {k: upsample(a, 300, 200) > 1.0 if k < 3 else upsample(a, 40, 10) > 1.0 for k, a in arrays.items()}
    same_runs(RK.upsampled_runs(known, 1.0), want)
    same(rf.upsampled_pixels(known, 1.0), want)
    assert {r.mask_id for r in RK.upsampled_runs(df, -5.0).collect()} == {1, 2, 3, 4, 5, 10}


def test_bit_hits_agree_with_pixel_rows(spark):
    rng = np.random.default_rng(11)
    arrays = {k: rng.random((5 + k, 9)) > 0.5 for k in range(4)}
    hits = spark.createDataFrame([(int(rng.integers(0, 6)), float(rng.uniform(-1, 40)), float(rng.uniform(-1, 30)), 0.0, 0.0, 36.0, 24.0) for _ in range(200)],
                                 "mask_id long, px double, py double, x double, y double, w double, h double").withColumn("id", F.monotonically_increasing_id()).cache()
    rows = [(k, a.shape[1], a.shape[0], [float(t) for t in a.ravel()]) for k, a in arrays.items()]
    packed = RK.packed(spark.createDataFrame(rows, "mask_id long, w int, h int, v array<float>"), 0.5)
    masks = packed.select("mask_id", F.col("w").alias("mask_w"), F.col("h").alias("mask_h"), "bits")
    pixels = to_pixels(spark, arrays).withColumn("alpha", F.lit(255))
    for missing in (False, True):
        got = {r.id: r.pixel_hit for r in spatial.bit_hits(hits, masks, missing).collect()}
        want = {r.id: r.pixel_hit for r in spatial.pixel_hits(hits, masks.drop("bits"), pixels, missing).collect()}
        assert got == want and len(got) == 200


def test_box_sums_from_summed_lines(spark):
    rng = np.random.default_rng(13)
    arrays = {k: rng.normal(0, 1, (6 + k, 11)) for k in range(3)}
    df = spark.createDataFrame([(k, 11, 6 + k, [float(t) for t in a.ravel()]) for k, a in arrays.items()] + [(9, 2, 2, [1.0, None, 2.0])],
                               "mask_id long, w int, h int, v array<double>")
    lines = {(r.mask_id, r.y): r.sums for r in RK.summed_lines(df).collect()}
    assert len(lines) == 6 + 7 + 8 + 2 and lines[(9, 1)] == [0.0, 3.0, 3.0]
    for k, a in arrays.items():
        for _ in range(20):
            y0, x0 = int(rng.integers(0, a.shape[0])), int(rng.integers(0, 11))
            y1, x1 = int(rng.integers(y0, a.shape[0])), int(rng.integers(x0, 11))
            above = lines[(k, y0 - 1)] if y0 else [0.0] * 12
            low = lines[(k, y1)]
            assert np.isclose(low[x1 + 1] - low[x0] - above[x1 + 1] + above[x0], a[y0:y1 + 1, x0:x1 + 1].sum())


def test_reference_points_of_a_crowded_user_hand_on_two_rows_a_task(spark, tmp_path):
    from maskloom.plans.mask_queries import reference_points

    (spark.range(4000).selectExpr("cast(CASE WHEN id < 3900 THEN 1 ELSE id % 7 END AS bigint) AS user_id", "(id * 7919) % 4000 AS event_id",
                                  "cast(id AS double) AS value").write.parquet(str(tmp_path / "events.parquet")))
    out = reference_points(spark, str(tmp_path))
    rows = [(1 if i < 3900 else i % 7, i * 7919 % 4000, float(i)) for i in range(4000)]
    want = [(u, v, float(e % 97)) for u, e, v in rows if u % 3 == 0 and e % 4 == 0]
    for u in {u for u, *_ in rows if u % 3}:
        a, b = sorted((e, v) for w, e, v in rows if w == u)[:2]
        want.append((u, (a[1] + b[1]) / 2, (a[0] % 97 + b[0] % 97) / 2))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan


def test_hits_without_a_mask_may_stay_unanswered(spark):
    hits = spark.createDataFrame([(1, 7, 0.5, 0.5, 0.0, 0.0, 8.0, 8.0), (2, 8, 0.5, 0.5, 0.0, 0.0, 8.0, 8.0)],
                                 "region_id long, mask_id long, px double, py double, x double, y double, w double, h double")
    masks = spark.createDataFrame([(7, 8, 8, bytearray(b"\xff" * 8))], "mask_id long, mask_w int, mask_h int, bits binary")
    got = {k: {r.region_id: r.pixel_hit for r in spatial.bit_hits(hits, masks, k).collect()} for k in (None, True, False)}
    assert got == {None: {1: True, 2: None}, True: {1: True, 2: True}, False: {1: True, 2: False}}
