"""Masks on the vectors of ``embeddings``, read as 8 x 8 rasters; thresholds are scaled to their values."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from maskloom.functions import rasters as RF
from maskloom.operators import components, masks as M, morphology, raster_kernels, refinement, runs as row_runs
from maskloom.plans.registry import query, rounded, rounded_sql
from maskloom.sources.adapters import PIXELS_SQL, table, view, view_sql

_PX = f"{view_sql('rasters')}, {PIXELS_SQL}, ids AS (SELECT vec_id AS mask_id FROM embeddings)"
_SET = f"{_PX}, p AS (SELECT mask_id, x, y FROM pixels WHERE v > 0.05::DOUBLE)"
_SOLID = f"{_PX}, p AS (SELECT mask_id, x, y FROM pixels WHERE v > -0.05::DOUBLE)"


def _rasters(spark, sf):
    return view(spark, sf, "rasters")


def _set(spark, sf, limit=0.05):
    return M.thresholded(_rasters(spark, sf), limit).select(*M.PIXEL)


def _solid(spark, sf):
    return _set(spark, sf, -0.05)


def _xy(df):
    return df.select("mask_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("set_pixels", f"{_SET} SELECT * FROM p")
def set_pixels(spark, sf):
    return _xy(_set(spark, sf))


@query("mask_boxes", f"""{_PX}, p AS (SELECT mask_id, x, y FROM pixels WHERE v > 0.3::DOUBLE),
g AS (SELECT mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM p GROUP BY mask_id)
SELECT i.mask_id, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 - x0 + 1, 0) AS w, coalesce(y1 - y0 + 1, 0) AS h,
  coalesce(n, 0) AS area FROM ids i LEFT JOIN g ON g.mask_id = i.mask_id""")
def mask_boxes(spark, sf):
    return M.mask_boxes(_rasters(spark, sf), _set(spark, sf, 0.3))


@query("packed_masks", f"""{_PX}, b AS (SELECT mask_id, y, sum(CASE WHEN v > 0.05::DOUBLE THEN 1 << cast(7 - x AS int) ELSE 0 END)::BIGINT AS byte FROM pixels GROUP BY 1, 2)
SELECT b.mask_id, y, byte, n_set FROM b JOIN (SELECT mask_id, count(*) FILTER (v > 0.05::DOUBLE) AS n_set FROM pixels GROUP BY 1) n ON n.mask_id = b.mask_id""")
def packed_masks(spark, sf):
    """A line of these rasters is one byte."""
    packed = raster_kernels.packed(_rasters(spark, sf), 0.05)
    y = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")
    return packed.select("mask_id", y, "bits", F.col("n_set").cast("long").alias("n_set")).select(
        "mask_id", F.col("y").cast("long").alias("y"), F.conv(F.hex(F.substring("bits", F.col("y") + 1, F.lit(1))), 16, 10).cast("long").alias("byte"), "n_set")


_SCORES = """flips AS (SELECT mask_id,
  sum(CASE WHEN (v > 0) <> (lag(v) OVER (PARTITION BY mask_id, y ORDER BY x) > 0) THEN 1 ELSE 0 END) AS fx FROM (
    SELECT * FROM pixels) GROUP BY mask_id),
steps AS (SELECT mask_id, (v > 0) <> (lag(v) OVER (PARTITION BY mask_id, y ORDER BY x) > 0) AS fx,
  (v > 0) <> (lag(v) OVER (PARTITION BY mask_id, x ORDER BY y) > 0) AS fy, v FROM pixels),
m AS (SELECT mask_id, count(*) FILTER (fx) + count(*) FILTER (fy) AS flips, count(*) FILTER (v > 0) AS positives,
  count(*) FILTER (v > 0.05::DOUBLE) AS strict, count(*) FILTER (v > -0.05::DOUBLE) AS loose, count(*) AS n FROM steps GROUP BY mask_id),
scores AS (SELECT mask_id, flips, positives, CASE WHEN loose > 0 THEN strict / loose ELSE 0 END AS stability, positives / n AS coverage,
  CASE WHEN positives > 0 THEN 1 - least(1.0::DOUBLE, flips / (positives * 4)) ELSE 0 END AS compactness FROM m)"""
_SCORES = _SCORES[_SCORES.index("steps AS"):]


@query("raster_scores", f"""{_PX}, {_SCORES}
SELECT mask_id, flips, positives, {rounded_sql('stability')} AS stability, {rounded_sql('coverage')} AS coverage,
  {rounded_sql('compactness')} AS compactness FROM scores""")
def raster_scores(spark, sf):
    s = M.raster_scores(_rasters(spark, sf), 0.05)
    return s.select("mask_id", F.col("flips").cast("long").alias("flips"), F.col("positives").cast("long").alias("positives"),
                    *[rounded(F.col(c)).alias(c) for c in ("stability", "coverage", "compactness")])


_PROMPT_POINTS = """pts AS (SELECT DISTINCT vec_id // 3 AS prompt_id, cast((vec_id // 3) * 37 % 1024 AS double) AS x,
  cast((vec_id // 3) * 91 % 1024 AS double) AS y FROM embeddings WHERE (vec_id // 3) % 5 <> 0
  UNION ALL SELECT DISTINCT vec_id // 3, cast((vec_id // 3) * 53 % 1024 AS double), 512.0::DOUBLE FROM embeddings WHERE (vec_id // 3) % 4 = 0)"""


def _candidates(spark, sf):
    return _rasters(spark, sf).select(
        F.floor(F.col("mask_id") / 3).alias("prompt_id"), (F.col("mask_id") % 3).alias("index"),
        (F.lit(0.5) + (F.col("label") % 10) / 20).alias("iou"), "w", "h", "v")


def _points(spark, sf):
    p = _candidates(spark, sf).select("prompt_id").distinct()
    a = p.filter("prompt_id % 5 <> 0").selectExpr(
        "prompt_id", "cast(prompt_id * 37 % 1024 AS double) AS x", "cast(prompt_id * 91 % 1024 AS double) AS y", "1 AS label")
    b = p.filter("prompt_id % 4 = 0").selectExpr(
        "prompt_id", "cast(prompt_id * 53 % 1024 AS double) AS x", "cast(512 AS double) AS y", "1 AS label")
    return a.unionByName(b)


_COVERS = f"""cand AS (SELECT vec_id AS mask_id, vec_id // 3 AS prompt_id, vec_id % 3 AS index,
  0.5::DOUBLE + (label % 10) / 20 AS iou, embedding FROM embeddings), {_PROMPT_POINTS},
cov AS (SELECT c.prompt_id, c.index, bool_and(embedding[cast(
  greatest(0, least(7, floor(y / 1024 * 8 + 0.5::DOUBLE))) * 8 + greatest(0, least(7, floor(x / 1024 * 8 + 0.5::DOUBLE))) AS int) + 1] > 0) AS covers
  FROM cand c JOIN pts p ON p.prompt_id = c.prompt_id GROUP BY c.prompt_id, c.index)"""


@query("covered_prompts", f"WITH {_COVERS} SELECT * FROM cov")
def covered_prompts(spark, sf):
    return M.covers_points(_candidates(spark, sf), _points(spark, sf))


@query("selected_candidates", f"""{_PX}, {_SCORES}, {_COVERS},
j AS (SELECT c.prompt_id, c.index, c.iou, s.stability, s.compactness, coalesce(v.covers, TRUE) AS covers,
  c.iou * (1 + s.stability * 0.4::DOUBLE + s.compactness * 0.4::DOUBLE) * CASE WHEN s.coverage > 0.001::DOUBLE THEN 1 ELSE 0.5::DOUBLE END AS quality,
  c.iou >= 0.65::DOUBLE AND s.stability >= 0.5::DOUBLE AND s.compactness >= 0.5::DOUBLE AS passes
  FROM cand c JOIN scores s ON s.mask_id = c.mask_id LEFT JOIN cov v ON v.prompt_id = c.prompt_id AND v.index = c.index)
SELECT prompt_id, index, {rounded_sql('quality')} AS quality, covers, passes FROM j
QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY covers DESC, passes DESC, quality DESC, index) = 1""")
def selected_candidates(spark, sf):
    best = M.selected_candidates(_candidates(spark, sf), _points(spark, sf), 0.05, min_stability=0.5, min_compactness=0.5)
    return best.select("prompt_id", "index", rounded(F.col("quality")).alias("quality"), "covers", "passes")


@query("reference_points", """WITH p AS (SELECT user_id AS prompt_id, value AS x, cast(event_id % 97 AS double) AS y,
  CASE WHEN user_id % 3 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END ELSE cast(row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS int) END AS label
  FROM events),
u AS (SELECT prompt_id, bool_or(label = 1) AS pos, count(*) FILTER (label IN (2, 3)) AS n,
  max(x) FILTER (label = 2) AS x2, max(y) FILTER (label = 2) AS y2, max(x) FILTER (label = 3) AS x3, max(y) FILTER (label = 3) AS y3 FROM p GROUP BY 1)
SELECT prompt_id, x, y FROM p WHERE label = 1
UNION ALL SELECT prompt_id, (x2 + x3) / 2, (y2 + y3) / 2 FROM u WHERE NOT pos AND n = 2 AND x2 IS NOT NULL AND x3 IS NOT NULL""")
def reference_points(spark, sf):
    # The first two events of a user stand for the corners of a dragged box. A task hands on two rows of a user at most; later events
    # of such users are neither positive points nor corners.
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("prompt_id"), "event_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    clicks = F.coalesce(F.col("prompt_id") % 3 == 0, F.lit(False))
    placed = e.filter(~clicks).withColumn("nth", F.row_number().over(Window.partitionBy("prompt_id").orderBy("event_id")))
    pts = e.filter(clicks).withColumn("label", F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).unionByName(
        placed.filter("nth <= 2").withColumn("label", F.col("nth") + 1).drop("nth")).drop("event_id")
    return M.reference_points(pts)


@query("edge_coverage", f"""{_SOLID}, c AS (SELECT mask_id, count(*) AS area, count(*) FILTER (y < 3) AS t, count(*) FILTER (y >= 5) AS b,
  count(*) FILTER (x < 3) AS l, count(*) FILTER (x >= 5) AS r FROM p GROUP BY mask_id)
SELECT mask_id, area / 64 AS area_share, {rounded_sql('t / 24')} AS top, {rounded_sql('b / 24')} AS bottom,
  {rounded_sql('l / 24')} AS left_side, {rounded_sql('r / 24')} AS right_side FROM c""")
def edge_coverage(spark, sf):
    s = M.edge_coverage(_solid(spark, sf))
    return s.select("mask_id", "area_share", rounded(F.col("top")).alias("top"), rounded(F.col("bottom")).alias("bottom"),
                    rounded(F.col("left")).alias("left_side"), rounded(F.col("right")).alias("right_side"))


@query("mask_union", f"""{_SET} SELECT mask_id, x, y FROM p UNION SELECT mask_id, 7 - x, y FROM p""")
def mask_union(spark, sf):
    p = _set(spark, sf)
    return _xy(M.union_masks(p, p.withColumn("x", 7 - F.col("x"))))


@query("mask_inverse", f"""{_SET} SELECT mask_id, x, y FROM pixels EXCEPT SELECT mask_id, x, y FROM p""")
def mask_inverse(spark, sf):
    return _xy(M.inverted(_rasters(spark, sf), _set(spark, sf)))


@query("dilated_masks", f"""{_SET} SELECT f.mask_id, f.x, f.y FROM pixels f WHERE EXISTS (SELECT 1 FROM p
  WHERE p.mask_id = f.mask_id AND p.x BETWEEN f.x - 1 AND f.x + 1 AND p.y BETWEEN f.y - 1 AND f.y + 1)""")
def dilated_masks(spark, sf):
    return _xy(morphology.dilated(_set(spark, sf), 1))


def _eroded_sql(source: str, frame: str = "pixels") -> str:
    return f"""SELECT f.mask_id, f.x, f.y FROM {frame} f WHERE NOT EXISTS (SELECT 1 FROM {frame} q
  LEFT JOIN {source} s ON s.mask_id = q.mask_id AND s.x = q.x AND s.y = q.y WHERE s.x IS NULL
  AND q.mask_id = f.mask_id AND q.x BETWEEN f.x - 1 AND f.x + 1 AND q.y BETWEEN f.y - 1 AND f.y + 1)"""


def _dilated_sql(source: str, frame: str = "pixels") -> str:
    return f"""SELECT DISTINCT f.mask_id, f.x, f.y FROM {frame} f JOIN {source} s ON s.mask_id = f.mask_id
  AND s.x BETWEEN f.x - 1 AND f.x + 1 AND s.y BETWEEN f.y - 1 AND f.y + 1"""


@query("eroded_masks", f"{_SOLID} {_eroded_sql('p')}")
def eroded_masks(spark, sf):
    return _xy(morphology.eroded(_solid(spark, sf), 1))


@query("closed_masks", f"{_SET}, d AS ({_dilated_sql('p')}) {_eroded_sql('d')}")
def closed_masks(spark, sf):
    return _xy(morphology.closed(_set(spark, sf), 1))


@query("opened_masks", f"{_SOLID}, e AS ({_eroded_sql('p')}) {_dilated_sql('e')}")
def opened_masks(spark, sf):
    return _xy(morphology.opened(_solid(spark, sf), 1))


def _closure_sql(source: str, out: str, w: int = 8) -> str:
    """Label = smallest index that reaches a pixel over set neighbours."""
    return f"""reach_{out}(mask_id, x, y, src) AS (SELECT mask_id, x, y, y * {w} + x FROM {source}
  UNION SELECT s.mask_id, s.x, s.y, r.src FROM reach_{out} r JOIN {source} s ON s.mask_id = r.mask_id
    AND abs(s.x - r.x) + abs(s.y - r.y) = 1),
{out} AS (SELECT mask_id, x, y, min(src) AS label FROM reach_{out} GROUP BY mask_id, x, y)"""


def _smooth_sql(source: str, frame: str, w: int, speck: int, hole: int) -> str:
    """CTEs that end in ``smooth``: drop specks, fill holes, close by 1, erode by 1."""
    return f"""{_closure_sql(source, 'sa', w)},
s1 AS (SELECT a.mask_id, a.x, a.y FROM sa a JOIN (SELECT mask_id, label FROM sa GROUP BY 1, 2 HAVING count(*) >= {speck}) g
  ON g.mask_id = a.mask_id AND g.label = a.label),
s2 AS (SELECT mask_id, x, y FROM {frame} EXCEPT SELECT mask_id, x, y FROM s1),
{_closure_sql('s2', 'sb', w)},
s3 AS (SELECT mask_id, x, y FROM s1 UNION ALL SELECT b.mask_id, b.x, b.y FROM sb b
  JOIN (SELECT mask_id, label FROM sb GROUP BY 1, 2 HAVING count(*) < {hole}) g ON g.mask_id = b.mask_id AND g.label = b.label),
s4 AS ({_dilated_sql('s3', frame)}), s5 AS ({_eroded_sql('s4', frame)}), smooth AS ({_eroded_sql('s5', frame)})"""


def _snap_sql(source: str, frame: str, w: int, h: int) -> str:
    """CTEs that end in ``snapped``; frames up to 150 pixels have a margin of 3."""
    area = w * h
    return f"""k AS (SELECT mask_id, count(*) / {area} AS share, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
  count(*) FILTER (y < 3) / {3 * w} AS t, count(*) FILTER (y >= {h - 3}) / {3 * w} AS b,
  count(*) FILTER (x < 3) / {3 * h} AS l, count(*) FILTER (x >= {w - 3}) / {3 * h} AS r FROM {source} GROUP BY mask_id),
e AS (SELECT mask_id, share, t, b, l, r,
  t >= 0.65::DOUBLE OR (share >= 0.7::DOUBLE AND t >= 0.65::DOUBLE * 0.75::DOUBLE) OR (y0 <= 3 AND t >= 0.4::DOUBLE) AS ft,
  b >= 0.65::DOUBLE OR (share >= 0.7::DOUBLE AND b >= 0.65::DOUBLE * 0.75::DOUBLE) OR (y1 + 1 >= {h - 3} AND b >= 0.4::DOUBLE) AS fb,
  l >= 0.65::DOUBLE OR (share >= 0.7::DOUBLE AND l >= 0.65::DOUBLE * 0.75::DOUBLE) OR (x0 <= 3 AND l >= 0.4::DOUBLE) AS fl,
  r >= 0.65::DOUBLE OR (share >= 0.7::DOUBLE AND r >= 0.65::DOUBLE * 0.75::DOUBLE) OR (x1 + 1 >= {w - 3} AND r >= 0.4::DOUBLE) AS fr FROM k),
d AS (SELECT * FROM (SELECT *, ft::INT + fb::INT + fl::INT + fr::INT AS n FROM e) WHERE share >= 0.45::DOUBLE
  AND (n >= 3 OR (n >= 2 AND share >= 0.65::DOUBLE) OR (t + b + l + r) / 4 >= 0.65::DOUBLE)),
u AS (SELECT s.mask_id, s.x, s.y FROM {source} s JOIN d ON d.mask_id = s.mask_id
  UNION SELECT f.mask_id, f.x, f.y FROM {frame} f JOIN d ON d.mask_id = f.mask_id
    WHERE (ft AND f.y < 3) OR (fb AND f.y >= {h - 3}) OR (fl AND f.x < 3) OR (fr AND f.x >= {w - 3})),
uframe AS (SELECT f.mask_id, f.x, f.y FROM {frame} f JOIN d ON d.mask_id = f.mask_id),
ud AS ({_dilated_sql('u', 'uframe')}),
snapped AS ({_eroded_sql('ud', 'uframe')} UNION ALL SELECT s.mask_id, s.x, s.y FROM {source} s WHERE s.mask_id NOT IN (SELECT mask_id FROM d))"""


_LABELS = f"{_SET}, {_closure_sql('p', 'lab')}"


@query("component_labels", f"{_LABELS} SELECT mask_id, x, y, label FROM lab")
def component_labels(spark, sf):
    lab = components.labelled(_set(spark, sf))
    return _xy_label(lab)


def _xy_label(lab):
    first = F.floor(F.col("label") / components.ROW) * 8 + F.col("label") % components.ROW
    return lab.select("mask_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), first.alias("label"))


@query("component_labels_tiled", f"{_LABELS} SELECT mask_id, x, y, label FROM lab")
def component_labels_tiled(spark, sf):
    """The same labels through tiles of 3 x 3 pixels and the merge across their borders."""
    return _xy_label(components.labelled(_set(spark, sf), tile=3))


@query("largest_component_share", f"""{_LABELS}, c AS (SELECT mask_id, label, count(*) AS n FROM lab GROUP BY 1, 2),
s AS (SELECT mask_id, max(n) / sum(n) AS share, count(*) AS components FROM c GROUP BY 1)
SELECT i.mask_id, {rounded_sql('coalesce(share, 0)')} AS share, coalesce(components, 0) AS components FROM ids i LEFT JOIN s ON s.mask_id = i.mask_id""")
def largest_component_share(spark, sf):
    out = components.largest_share(_rasters(spark, sf), components.labelled(_set(spark, sf)))
    return out.withColumn("share", rounded(F.col("share")))


@query("without_small_components", f"""{_LABELS}, big AS (SELECT mask_id, label FROM lab GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT l.mask_id, l.x, l.y FROM lab l JOIN big b ON b.mask_id = l.mask_id AND b.label = l.label""")
def without_small_components(spark, sf):
    return _xy(components.without_small(_set(spark, sf), 4))


@query("filled_holes", f"""{_SOLID}, bg AS (SELECT mask_id, x, y FROM pixels EXCEPT SELECT mask_id, x, y FROM p),
{_closure_sql('bg', 'hol')}, small AS (SELECT mask_id, label FROM hol GROUP BY 1, 2 HAVING count(*) < 3)
SELECT mask_id, x, y FROM p UNION ALL SELECT h.mask_id, h.x, h.y FROM hol h JOIN small s ON s.mask_id = h.mask_id AND s.label = h.label""")
def filled_holes(spark, sf):
    return _xy(components.filled_holes(_rasters(spark, sf), _solid(spark, sf), 3))


def _runs_sql(source: str) -> str:
    """Runs of the pixels of ``source``: in a run, x and its rank in the line differ by one number."""
    return f"""SELECT mask_id, y, min(x) AS x0, max(x) AS x1 FROM (
  SELECT mask_id, x, y, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM ({source})) GROUP BY mask_id, y, g"""


def _lines(runs):
    return runs.select("mask_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


def _solid_runs(spark, sf):
    return row_runs.runs_of_rasters(_rasters(spark, sf), -0.05)


@query("mask_runs", f"{_SOLID} {_runs_sql('p')}")
def mask_runs(spark, sf):
    return _lines(_solid_runs(spark, sf))


@query("background_runs", f"{_SOLID} {_runs_sql('SELECT mask_id, x, y FROM pixels EXCEPT SELECT mask_id, x, y FROM p')}")
def background_runs(spark, sf):
    return _lines(row_runs.complement(_rasters(spark, sf), _solid_runs(spark, sf)))


@query("closed_runs", f"{_SET}, d AS ({_dilated_sql('p')}) {_runs_sql(_eroded_sql('d'))}")
def closed_runs(spark, sf):
    return _lines(row_runs.closed(row_runs.runs_of_rasters(_rasters(spark, sf), 0.05), 1))


@query("opened_runs", f"{_SOLID}, e AS ({_eroded_sql('p')}) {_runs_sql(_dilated_sql('e'))}")
def opened_runs(spark, sf):
    return _lines(row_runs.opened(_solid_runs(spark, sf), 1))


@query("run_components", f"""{_LABELS}, c AS (SELECT mask_id, label, count(*) AS area FROM lab GROUP BY 1, 2)
SELECT mask_id, label, area FROM c""")
def run_components(spark, sf):
    """Components of row runs through bands of three lines and the merge across them."""
    runs = row_runs.runs_of_rasters(_rasters(spark, sf), 0.05)
    first = F.floor(F.col("label") / components.ROW) * 8 + F.col("label") % components.ROW
    return row_runs.component_sizes(row_runs.labelled(runs, band=3)).select("mask_id", first.alias("label"), "area")


@query("components_at_points", f"""{_LABELS}, pts AS (SELECT mask_id, mask_id % 8 AS x, (mask_id // 8) % 8 AS y FROM ids WHERE mask_id % 10 <> 0),
hit AS (SELECT l.mask_id, l.label FROM lab l JOIN pts t ON t.mask_id = l.mask_id AND t.x = l.x AND t.y = l.y),
big AS (SELECT mask_id, label FROM lab WHERE mask_id IN (SELECT mask_id FROM pts) AND mask_id NOT IN (SELECT mask_id FROM hit)
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY mask_id ORDER BY count(*) DESC, label DESC) = 1),
k AS (SELECT * FROM hit UNION ALL SELECT * FROM big)
SELECT l.mask_id, l.x, l.y FROM lab l WHERE mask_id NOT IN (SELECT mask_id FROM pts)
  OR EXISTS (SELECT 1 FROM k WHERE k.mask_id = l.mask_id AND k.label = l.label)""")
def components_at_points(spark, sf):
    pts = _rasters(spark, sf).filter("mask_id % 10 <> 0").select(
        "mask_id", ((F.col("mask_id") % 8) + F.lit(0.25)).alias("px"), ((F.floor(F.col("mask_id") / 8) % 8) - F.lit(0.5)).alias("py"))
    return _xy(components.touching_points(_set(spark, sf), pts))


# The normalized Gaussian weights for sigma 1 in single precision, worked out apart from the code under test.
_GAUSS = [0.004433047957718372, 0.05400558188557625, 0.24203623831272125, 0.3990502655506134, 0.24203623831272125, 0.05400558188557625, 0.004433047957718372]


def _blur_sql() -> str:
    """Lines, then columns, as lists of eight values; a pixel sees its own line or column only."""
    r = len(_GAUSS) // 2

    def weighted(at: str) -> str:
        return " + ".join(f"(a[cast(greatest(least({at} + ({i - r}), 7), 0) AS int) + 1])::DOUBLE * {w!r}::DOUBLE" for i, w in enumerate(_GAUSS))

    return f"""across AS (SELECT mask_id, y, list(v ORDER BY x) AS a FROM pixels GROUP BY mask_id, y),
h AS (SELECT mask_id, g.x, y, cast({weighted('g.x')} AS FLOAT) AS v FROM across, range(8) AS g(x)),
down AS (SELECT mask_id, x, list(v ORDER BY y) AS a FROM h GROUP BY mask_id, x),
blur AS (SELECT mask_id, x, g.y, cast({weighted('g.y')} AS FLOAT) AS v FROM down, range(8) AS g(y))"""


@query("blurred_rasters", f"""WITH pixels AS (SELECT mask_id, i % 8 AS x, i // 8 AS y, v::DOUBLE AS v FROM (
  SELECT vec_id AS mask_id, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)), {_blur_sql()}
SELECT mask_id, x, y, {rounded_sql('v::DOUBLE')} AS v FROM blur""")
def blurred_rasters(spark, sf):
    out = M.raster_pixels(refinement.blurred(_rasters(spark, sf)))
    return out.select(
        "mask_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), rounded(F.col("v")).alias("v"))


@query("upsampled_masks", f"""{_PX}, g AS (SELECT e.vec_id AS mask_id, x, y, e.embedding AS a, x / 20 * 8 AS sx, y / 12 * 8 AS sy
  FROM embeddings e, range(20) AS gx(x), range(12) AS gy(y)),
c AS (SELECT mask_id, x, y, a, cast(floor(sx) AS int) AS x0, cast(least(floor(sx) + 1, 7) AS int) AS x1, cast(floor(sy) AS int) AS y0,
  cast(least(floor(sy) + 1, 7) AS int) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM g)
SELECT mask_id, x, y FROM c WHERE (a[y0 * 8 + x0 + 1]::DOUBLE * (1 - fx) + a[y0 * 8 + x1 + 1]::DOUBLE * fx) * (1 - fy)
  + (a[y1 * 8 + x0 + 1]::DOUBLE * (1 - fx) + a[y1 * 8 + x1 + 1]::DOUBLE * fx) * fy > 0.04::DOUBLE""")
def upsampled_masks(spark, sf):
    r = _rasters(spark, sf).withColumns({"out_w": F.lit(20), "out_h": F.lit(12)})
    return _xy(refinement.upsampled_pixels(r, 0.04))


@query("pixel_channels", f"""{_PX}, c AS (SELECT mask_id, x, y, floor(abs(v) * 500) AS r, floor(abs(v) * 300) AS g, floor(abs(v) * 100) AS b FROM pixels)
SELECT mask_id, x, y, cast(floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5::DOUBLE) AS bigint) AS grey,
  {rounded_sql('(r / 255 - 0.485::DOUBLE) / 0.229::DOUBLE')} AS red, {rounded_sql('(g / 255 - 0.456::DOUBLE) / 0.224::DOUBLE')} AS green,
  {rounded_sql('(b / 255 - 0.406::DOUBLE) / 0.225::DOUBLE')} AS blue, CASE WHEN g > 0 THEN 255 ELSE 0 END AS alpha FROM c""")
def pixel_channels(spark, sf):
    v = F.abs(F.col("v").cast("double"))
    p = _rasters(spark, sf).select("mask_id", F.posexplode("v").alias("i", "v")).select(
        "mask_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"),
        F.floor(v * 500).alias("r"), F.floor(v * 300).alias("g"), F.floor(v * 100).alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return p.select("mask_id", "x", "y", RF.luminance(r, g, b).alias("grey"), rounded(RF.normalized_channel(r, 0)).alias("red"),
                    rounded(RF.normalized_channel(g, 1)).alias("green"), rounded(RF.normalized_channel(b, 2)).alias("blue"),
                    RF.opacity(g).alias("alpha"))


@query("snapped_masks", f"{_SOLID}, {_snap_sql('p', 'pixels', 8, 8)} SELECT * FROM snapped")
def snapped_masks(spark, sf):
    return _xy(refinement.snapped_to_edges(_solid(spark, sf)))


@query("smoothed_masks", f"{_SOLID}, {_smooth_sql('p', 'pixels', 8, 4, 3)} SELECT * FROM smooth")
def smoothed_masks(spark, sf):
    return _xy(refinement.smoothed(_rasters(spark, sf), _solid(spark, sf), 4, 3, 1))


_FW, _FH = 14, 10
_REFINED = f"""{_PX}, {_blur_sql()},
ba AS (SELECT mask_id, list(v ORDER BY y, x) AS a FROM blur GROUP BY mask_id),
frame AS (SELECT mask_id, x, y FROM ids, range({_FW}) AS gx(x), range({_FH}) AS gy(y)),
c AS (SELECT f.mask_id, f.x, f.y, a, cast(floor(f.x / {_FW} * 8) AS int) AS ix0, cast(least(floor(f.x / {_FW} * 8) + 1, 7) AS int) AS ix1,
  cast(floor(f.y / {_FH} * 8) AS int) AS iy0, cast(least(floor(f.y / {_FH} * 8) + 1, 7) AS int) AS iy1,
  f.x / {_FW} * 8 - floor(f.x / {_FW} * 8) AS fx, f.y / {_FH} * 8 - floor(f.y / {_FH} * 8) AS fy
  FROM frame f JOIN ba ON ba.mask_id = f.mask_id),
up AS (SELECT mask_id, x, y FROM c WHERE (a[iy0 * 8 + ix0 + 1]::DOUBLE * (1 - fx) + a[iy0 * 8 + ix1 + 1]::DOUBLE * fx) * (1 - fy)
  + (a[iy1 * 8 + ix0 + 1]::DOUBLE * (1 - fx) + a[iy1 * 8 + ix1 + 1]::DOUBLE * fx) * fy > -0.01::DOUBLE),
{_closure_sql('up', 'lab', _FW)},
pts AS (SELECT mask_id, mask_id % {_FW} AS x, mask_id * 7 % {_FH} AS y FROM ids WHERE mask_id % 5 <> 0),
hit AS (SELECT l.mask_id, l.label FROM lab l JOIN pts t ON t.mask_id = l.mask_id AND t.x = l.x AND t.y = l.y),
big AS (SELECT mask_id, label FROM lab WHERE mask_id IN (SELECT mask_id FROM pts) AND mask_id NOT IN (SELECT mask_id FROM hit)
  GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY mask_id ORDER BY count(*) DESC, label DESC) = 1),
kk AS (SELECT * FROM hit UNION ALL SELECT * FROM big),
chosen AS (SELECT l.mask_id, l.x, l.y FROM lab l WHERE mask_id NOT IN (SELECT mask_id FROM pts)
  OR EXISTS (SELECT 1 FROM kk WHERE kk.mask_id = l.mask_id AND kk.label = l.label)),
{_smooth_sql('chosen', 'frame', _FW, 6, 5)},
{_snap_sql('smooth', 'frame', _FW, _FH)},
g AS (SELECT mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM snapped GROUP BY mask_id)
SELECT i.mask_id, coalesce(x0, 0) AS x, coalesce(y0, 0) AS y, coalesce(x1 - x0 + 1, 0) AS w, coalesce(y1 - y0 + 1, 0) AS h,
  coalesce(n, 0) AS area FROM ids i LEFT JOIN g ON g.mask_id = i.mask_id"""


@query("refined_masks", _REFINED)
def refined_masks(spark, sf):
    """Whole refinement, with limits scaled to the small output frame."""
    r = _rasters(spark, sf).withColumns({"out_w": F.lit(_FW), "out_h": F.lit(_FH)})
    pts = r.filter("mask_id % 5 <> 0").select(
        "mask_id", (F.col("mask_id") % _FW).cast("double").alias("px"), (F.col("mask_id") * 7 % _FH).cast("double").alias("py"))
    runs = refinement.refined_runs(r, pts, limit=-0.01, limits=lambda w, h: {"speck": 6, "hole": 5, "closing": 1})
    return row_runs.run_boxes(r.select("mask_id"), runs)


@query("refined_masks_large")
def refined_masks_large(spark, sf):
    """Refinement into larger frames of differing size, with the limits derived from them."""
    r = _rasters(spark, sf).withColumns({
        "out_w": F.lit(40) + (F.col("label") % 3).cast("int") * 8, "out_h": F.lit(32)})
    pts = r.filter("mask_id % 5 <> 0").select(
        "mask_id", (F.col("mask_id") % F.col("out_w")).cast("double").alias("px"), (F.col("mask_id") * 7 % 32).cast("double").alias("py"))
    return row_runs.run_boxes(r.select("mask_id"), refinement.refined_runs(r, pts, limit=0.01))


_TEXT = f"""{_PX}, q AS (SELECT mask_id, x, y, v * 2 + 0.45::DOUBLE AS pr FROM pixels), p AS (SELECT * FROM q WHERE pr > 0.5::DOUBLE),
{_closure_sql('p', 'lab')},
f AS (SELECT l.mask_id, l.label, count(*) AS n, avg(p.pr) AS mask_mean, min(l.x) AS x0, max(l.x) AS x1, min(l.y) AS y0, max(l.y) AS y1
  FROM lab l JOIN p ON p.mask_id = l.mask_id AND p.x = l.x AND p.y = l.y GROUP BY 1, 2),
s AS (SELECT * FROM f WHERE n >= 3 AND x1 > x0 AND y1 > y0),
bm AS (SELECT s.mask_id, s.label, avg(q.pr) AS box_mean FROM s JOIN q ON q.mask_id = s.mask_id AND q.x BETWEEN s.x0 AND s.x1
  AND q.y BETWEEN s.y0 AND s.y1 GROUP BY 1, 2),
o AS (SELECT s.mask_id, s.label, least(box_mean, mask_mean) AS confidence, x0 * 80.0::DOUBLE AS qx, y0 * 60.0::DOUBLE AS qy,
  (x1 - x0 + 1) * 80.0::DOUBLE AS bw, (y1 - y0 + 1) * 60.0::DOUBLE AS bh FROM s JOIN bm ON bm.mask_id = s.mask_id AND bm.label = s.label
  WHERE box_mean >= 0.5::DOUBLE AND mask_mean >= 0.6::DOUBLE),
d AS (SELECT *, bw * bh * 1.5::DOUBLE / (2 * (bw + bh)) AS d FROM o),
g AS (SELECT mask_id, label, confidence, greatest(0::DOUBLE, qx - d) AS x, greatest(0::DOUBLE, qy - d) AS y,
  least(640 - greatest(0::DOUBLE, qx - d), bw + 2 * d) AS w, least(480 - greatest(0::DOUBLE, qy - d), bh + 2 * d) AS h FROM d)
SELECT mask_id, row_number() OVER (PARTITION BY mask_id ORDER BY floor(y / 10), floor(x / 64), x, y, label) AS reading_position,
  {", ".join(f"{rounded_sql(c, 4)} AS {c}" for c in ("x", "y", "w", "h", "confidence"))} FROM g"""


@query("text_boxes", _TEXT)
def text_boxes(spark, sf):
    """Vectors scaled to probabilities stand for detector output; the size floors are scaled along."""
    maps = _rasters(spark, sf).select(
        "mask_id", "w", "h", F.transform("v", lambda p: p.cast("double") * 2 + F.lit(0.45)).alias("v"),
        F.lit(640).alias("image_w"), F.lit(480).alias("image_h"))
    out = refinement.text_regions(maps, floors=(2, 3))
    return out.select(F.col("document_id").alias("mask_id"), "reading_position",
                      *[rounded(F.col(c), 4).alias(c) for c in ("x", "y", "w", "h", "confidence")])
