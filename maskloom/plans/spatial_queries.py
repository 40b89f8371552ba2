"""Boxes: suppression, hits, selections, order, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import boxes as B
from maskloom.operators import ordering, raster_kernels, spatial, suppression
from maskloom.plans.registry import query, rounded, rounded_sql
from maskloom.session import fresh_dir
from maskloom.sources import layouts
from maskloom.sources.adapters import table, view, view_sql

_IOU = """CASE WHEN {a}.w*{a}.h + {b}.w*{b}.h
  - greatest(0.0::DOUBLE, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))
  * greatest(0.0::DOUBLE, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)) > 0
 THEN (greatest(0.0::DOUBLE, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))
  * greatest(0.0::DOUBLE, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))
  / ({a}.w*{a}.h + {b}.w*{b}.h
  - greatest(0.0::DOUBLE, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))
  * greatest(0.0::DOUBLE, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))
 ELSE 0.0::DOUBLE END"""


def iou_sql(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b)


def suppression_sql(source: str, t: float) -> str:
    """Recursive statement that visits the boxes of each document one rank at a time."""
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, region_id) AS rk FROM {source}),
walk AS (
  SELECT document_id, rk, [{{'region_id': region_id, 'x': x, 'y': y, 'w': w, 'h': h, 'score': score}}] AS kept
  FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.document_id, r.rk,
    CASE WHEN len(list_filter(k.kept, lambda p: {iou_sql('p', 'r')} > {t})) > 0 THEN k.kept
    ELSE list_append(k.kept, {{'region_id': r.region_id, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'score': r.score}}) END
  FROM walk k JOIN ranked r ON r.document_id = k.document_id AND r.rk = k.rk + 1),
survivors AS (
  SELECT document_id, k.region_id AS region_id, k.x AS x, k.y AS y, k.w AS w, k.h AS h, k.score AS score FROM (
    SELECT document_id, unnest(kept) AS k FROM walk
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY rk DESC) = 1))"""


_SURVIVORS = suppression_sql("regions", 0.5)


@query("surviving_regions", f"{view_sql('regions')}, {_SURVIVORS} SELECT document_id, region_id, score FROM survivors")
def surviving_regions(spark, sf):
    boxes = view(spark, sf, "regions").select(*suppression.BOX_COLUMNS)
    return suppression.surviving_boxes(boxes, 0.5).select("document_id", "region_id", "score")


@query("surviving_regions_per_document", f"""{view_sql('regions')}, {_SURVIVORS}
SELECT r.document_id, cast(count(*) AS bigint) AS regions, cast(count(s.region_id) AS bigint) AS surviving
FROM regions r LEFT JOIN survivors s ON r.document_id = s.document_id AND r.region_id = s.region_id
GROUP BY r.document_id""")
def surviving_regions_per_document(spark, sf):
    boxes = view(spark, sf, "regions").select(*suppression.BOX_COLUMNS)
    kept = suppression.surviving_boxes(boxes, 0.5)
    before = boxes.groupBy("document_id").agg(F.count("*").alias("regions"))
    after = kept.groupBy("document_id").agg(F.count("*").alias("surviving"))
    return before.join(after, "document_id", "left").select(
        "document_id", "regions", F.coalesce("surviving", F.lit(0)).alias("surviving")
    )


_AUTO = """auto AS (SELECT * FROM regions WHERE score >= 0.93 AND stability >= 0.95
  AND w * h / 160000.0 BETWEEN 0.005 AND 0.60)"""


@query("auto_segments", f"""{view_sql('regions')}, {_AUTO}, {suppression_sql('auto', 0.3)}
SELECT document_id, region_id, score FROM survivors""")
def auto_segments(spark, sf):
    from maskloom.operators.masks import passes_quality

    regions = view(spark, sf, "regions").withColumn("area", F.col("w") * F.col("h"))
    good = regions.filter(
        passes_quality("score", "stability", "area", F.lit(160000.0), min_score=0.93, min_stability=0.95)
    )
    return suppression.surviving_boxes(good.select(*suppression.BOX_COLUMNS), 0.3).select(
        "document_id", "region_id", "score"
    )


@query("suppressed_by", f"""{view_sql('regions')}, {_SURVIVORS},
pairs AS (SELECT r.document_id, r.region_id, s.region_id AS keeper_id, {iou_sql('r', 's')} AS iou, s.score AS ks
  FROM regions r JOIN survivors s ON r.document_id = s.document_id
  WHERE NOT EXISTS (SELECT 1 FROM survivors q WHERE q.document_id = r.document_id AND q.region_id = r.region_id))
SELECT document_id, region_id, keeper_id, {rounded_sql('iou')} AS iou FROM pairs WHERE iou > 0.5
QUALIFY row_number() OVER (PARTITION BY document_id, region_id ORDER BY ks DESC, keeper_id) = 1""")
def suppressed_by(spark, sf):
    boxes = view(spark, sf, "regions").select(*suppression.BOX_COLUMNS)
    kept = suppression.surviving_boxes(boxes, 0.5)
    return suppression.pair_with_keeper(boxes, kept, 0.5).withColumn("iou", rounded(F.col("iou")))


@query("iou_with_leader", f"""{view_sql('regions')},
lead AS (SELECT * FROM regions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, region_id) = 1)
SELECT r.document_id, r.region_id, l.region_id AS leader_id, {rounded_sql(iou_sql('r', 'l'))} AS iou
FROM regions r JOIN lead l ON r.document_id = l.document_id""")
def iou_with_leader(spark, sf):
    return spatial.iou_with_leader(view(spark, sf, "regions")).withColumn("iou", rounded(F.col("iou")))


_HITS = """hits AS (SELECT r.*, p.px, p.py FROM regions r JOIN points p ON r.document_id = p.document_id
  WHERE r.type <> 'text' AND p.px BETWEEN r.x AND r.x + r.w AND p.py BETWEEN r.y AND r.y + r.h)"""


@query("point_hits", f"{view_sql('regions', 'points')}, {_HITS} SELECT document_id, region_id, px, py FROM hits")
def point_hits(spark, sf):
    hits = spatial.point_hits(view(spark, sf, "regions"), view(spark, sf, "points"))
    return hits.select("document_id", "region_id", "px", "py")


# Every region borrows the raster of one vector; some numbers have none, as a mask not yet loaded.
_MASK_OF = "cast(split_part(region_id, '-', 3) AS bigint) % 600"
_PIXEL_HITS = f"""{_HITS}, masked AS (SELECT *, {_MASK_OF} AS mask_id FROM hits),
tested AS (SELECT m.*, e.vec_id IS NULL AS missing,
  cast(floor((px - x) * (8 / w)) AS bigint) AS dx, cast(floor((py - y) * (8 / h)) AS bigint) AS dy, e.embedding
  FROM masked m LEFT JOIN embeddings e ON e.vec_id = m.mask_id),
decided AS (SELECT *, CASE WHEN missing THEN FALSE WHEN dx > 7 OR dy > 7 THEN FALSE
  ELSE embedding[dy * 8 + dx + 1] > 0.05::FLOAT END AS pixel_hit FROM tested)"""


def _pixel_hits(spark, sf, missing_mask=False):
    hits = spatial.point_hits(view(spark, sf, "regions"), view(spark, sf, "points"))
    hits = hits.withColumn("mask_id", F.expr(_MASK_OF))
    packed = raster_kernels.packed(view(spark, sf, "rasters").select("mask_id", "w", "h", "v"), 0.05000000074505806)  # 0.05 in single precision
    masks = packed.select("mask_id", F.col("w").alias("mask_w"), F.col("h").alias("mask_h"), "bits")
    return spatial.bit_hits(hits, masks, missing_mask)


@query("pixel_hits", f"""{view_sql('regions', 'points')}, {_PIXEL_HITS}
SELECT document_id, region_id, pixel_hit OR missing AS over_mask, pixel_hit FROM decided""")
def pixel_hits(spark, sf):
    tested = _pixel_hits(spark, sf, missing_mask=None)
    return tested.select("document_id", "region_id", F.coalesce("pixel_hit", F.lit(False)).alias("pixel_hit"),
                         F.coalesce("pixel_hit", F.lit(True)).alias("over_mask"))


@query("best_hit", f"""{view_sql('regions', 'points')}, {_PIXEL_HITS},
scored AS (SELECT document_id, px, py, region_id,
  CASE WHEN pixel_hit THEN 1000000.0::DOUBLE ELSE 0.0::DOUBLE END
  + 1000000.0::DOUBLE / CASE WHEN w * h = 0 THEN 1.0::DOUBLE ELSE w * h END AS score FROM decided)
SELECT document_id, region_id, round(score, 4) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY document_id, px, py ORDER BY score DESC, region_id) = 1""")
def best_hit(spark, sf):
    best = spatial.best_hit(_pixel_hits(spark, sf), ["document_id", "px", "py"])
    return best.select("document_id", "region_id", F.round("score", 4).alias("score"))


@query("regions_in_window", f"""{view_sql('regions', 'marquees')}
SELECT r.document_id, r.region_id FROM regions r JOIN marquees m ON r.document_id = m.document_id
WHERE NOT (m.x + m.w < r.x OR m.x > r.x + r.w OR m.y + m.h < r.y OR m.y > r.y + r.h)""")
def regions_in_window(spark, sf):
    return spatial.regions_in_window(view(spark, sf, "regions"), view(spark, sf, "marquees"))


@query("regions_in_stored_window", f"""{view_sql('regions')}
SELECT document_id, region_id FROM regions WHERE x <= 62 AND x + w >= 50 AND y <= 48 AND y + h >= 40""")
def regions_in_stored_window(spark, sf):
    """One window over a region table written along a space-filling curve."""
    path = fresh_dir(spark, "regions-by-place")
    layouts.write_regions(view(spark, sf, "regions").select("document_id", "region_id", "x", "y", "w", "h"), path)
    return layouts.regions_in_frame_window(spark, path, 50.0, 40.0, 12.0, 8.0).select("document_id", "region_id")


@query("regions_mostly_in_window", f"""{view_sql('regions', 'marquees')},
o AS (SELECT r.document_id, r.region_id, r.w * r.h AS a,
  least(r.x + r.w, m.x + m.w) - greatest(r.x, m.x) AS dx, least(r.y + r.h, m.y + m.h) - greatest(r.y, m.y) AS dy
  FROM regions r JOIN marquees m ON r.document_id = m.document_id WHERE r.type <> 'text' AND r.w > 0 AND r.h > 0)
SELECT document_id, region_id, {rounded_sql('dx * dy / a')} AS ratio FROM o WHERE dx > 0 AND dy > 0 AND dx * dy / a >= 0.5""")
def regions_mostly_in_window(spark, sf):
    out = spatial.regions_mostly_in_window(view(spark, sf, "regions"), view(spark, sf, "marquees"))
    return out.withColumn("ratio", rounded(F.col("ratio")))


@query("distance_from_selected", f"""{view_sql('regions')},
c AS (SELECT document_id, region_id, x + w / 2 AS cx, y + h / 2 AS cy,
  row_number() OVER (PARTITION BY document_id ORDER BY score DESC, region_id) AS rk FROM regions),
d AS (SELECT o.document_id, o.region_id, sqrt((o.cx - s.cx) * (o.cx - s.cx) + (o.cy - s.cy) * (o.cy - s.cy)) AS distance
  FROM c o JOIN c s ON o.document_id = s.document_id AND s.rk = 1 WHERE o.rk > 1)
SELECT document_id, region_id, round(distance, 6) AS distance,
  round(CASE WHEN max(distance) OVER (PARTITION BY document_id) > 0
    THEN distance / max(distance) OVER (PARTITION BY document_id) END, 6) AS share,
  round(CASE WHEN max(distance) OVER (PARTITION BY document_id) > 0
    THEN distance / max(distance) OVER (PARTITION BY document_id) END * 200, 4) AS delay_ms
FROM d""")
def distance_from_selected(spark, sf):
    regions = view(spark, sf, "regions")
    lead = F.min_by("region_id", F.struct((-F.col("score")).alias("o"), F.col("region_id")))
    chosen = regions.groupBy("document_id").agg(lead.alias("region_id"))
    out = spatial.distance_from_selected(regions, chosen)
    return out.select("document_id", "region_id", F.round("distance", 6).alias("distance"),
                      F.round("share", 6).alias("share"), F.round("delay_ms", 4).alias("delay_ms"))


# Clipping ancestors: the marquee of the document and that of the customer's box.
_CANDIDATES = """cands AS (SELECT region_id AS element_id, document_id, x, y, w, h FROM regions),
clips AS (SELECT c.element_id, m.x, m.y, m.w * 2 AS w, m.h * 2 AS h FROM cands c JOIN marquees m
  ON m.document_id = c.document_id
  UNION ALL SELECT c.element_id, p.px - 40, p.py - 40, 160.0::DOUBLE, 160.0::DOUBLE FROM cands c JOIN points p
  ON p.document_id = c.document_id WHERE p.px > 100)"""


@query("clip_visibility", f"""{view_sql('regions', 'marquees', 'points')}, {_CANDIDATES},
t AS (SELECT c.element_id, bool_and(c.w * c.h <= 0 OR
  greatest(0.0::DOUBLE, least(c.x + c.w, a.x + a.w) - greatest(c.x, a.x))
  * greatest(0.0::DOUBLE, least(c.y + c.h, a.y + a.h) - greatest(c.y, a.y)) / (c.w * c.h) >= 0.5) AS visible
  FROM cands c JOIN clips a ON a.element_id = c.element_id GROUP BY c.element_id)
SELECT c.element_id, coalesce(t.visible, TRUE) AS visible FROM cands c LEFT JOIN t ON t.element_id = c.element_id""")
def clip_visibility(spark, sf):
    regions = view(spark, sf, "regions")
    cands = regions.select(F.col("region_id").alias("element_id"), "document_id", "x", "y", "w", "h")
    ids = cands.select("element_id", "document_id")
    m = view(spark, sf, "marquees").select("document_id", "x", "y", (F.col("w") * 2).alias("w"), (F.col("h") * 2).alias("h"))
    p = view(spark, sf, "points").filter("px > 100").select(
        "document_id", (F.col("px") - 40).alias("x"), (F.col("py") - 40).alias("y"),
        F.lit(160.0).alias("w"), F.lit(160.0).alias("h"))
    clips = ids.join(m, "document_id").unionByName(ids.join(p, "document_id")).drop("document_id")
    return spatial.clip_visibility(cands, clips).select("element_id", "visible")


@query("reading_order", f"""{view_sql('regions')}
SELECT document_id, region_id, row_number() OVER (PARTITION BY document_id
  ORDER BY floor(y / 10), floor(x / 64), x, y, region_id) AS reading_position FROM regions""")
def reading_order(spark, sf):
    return ordering.reading_order(view(spark, sf, "regions")).select("document_id", "region_id", "reading_position")


@query("layer_order", f"""{view_sql('regions')}
SELECT document_id, region_id, row_number() OVER (PARTITION BY document_id ORDER BY y, region_id) AS layer_position
FROM regions""")
def layer_order(spark, sf):
    return ordering.top_to_bottom(view(spark, sf, "regions")).select("document_id", "region_id", "layer_position")


@query("palette_colours", f"""{view_sql('regions')}
SELECT document_id, region_id, (row_number() OVER (PARTITION BY document_id ORDER BY found_at, region_id) - 1) % 8 AS colour
FROM regions WHERE type <> 'text' AND w > 0 AND h > 0""")
def palette_colours(spark, sf):
    shown = view(spark, sf, "regions").filter("type <> 'text' AND w > 0 AND h > 0")
    out = ordering.palette_index(shown, [F.col("found_at"), F.col("region_id")])
    return out.select("document_id", "region_id", "colour")


@query("point_grid", """WITH frames AS (SELECT c_custkey AS document_id, 400 + c_custkey % 1600 AS width,
  300 + c_nationkey * 31 AS height FROM customer)
SELECT document_id, cast(i AS bigint) AS cell, round((i % 8 + 1) * (width / 9), 6) AS px,
  round((i // 8 + 1) * (height / 9), 6) AS py, cast(i // 8 AS bigint) AS batch, cast(8 AS bigint) AS batches,
  round((i + 1) / 64, 6) AS progress FROM frames, range(64) AS g(i)""")
def point_grid(spark, sf):
    frames = table(spark, sf, "customer").selectExpr(
        "c_custkey AS document_id", "400 + c_custkey % 1600 AS width", "300 + c_nationkey * 31 AS height")
    grid = ordering.point_batches(ordering.point_grid(frames), F.lit(64))
    return grid.select("document_id", F.col("cell").cast("long").alias("cell"), F.round("px", 6).alias("px"),
                       F.round("py", 6).alias("py"), "batch", "batches", F.round("progress", 6).alias("progress"))


@query("window_grid", f"""{view_sql('marquees')}
SELECT document_id, cast(i AS bigint) AS cell, x + w * ((i % 3 + 1) / 4) AS px, y + h * ((i // 3 + 1) / 4) AS py
FROM marquees, range(9) AS g(i)""")
def window_grid(spark, sf):
    return ordering.box_grid(view(spark, sf, "marquees")).select(
        "document_id", F.col("cell").cast("long").alias("cell"), "px", "py")


_GROWTH = "(r.w * r.h * 1.5::DOUBLE / (2 * (r.w + r.h)))"


@query("box_measures", f"""{view_sql('regions', 'captured')},
m AS (SELECT r.region_id, r.x + r.w / 2 AS cx, r.y + r.h / 2 AS cy,
  r.x * (1024::DOUBLE / c.width) AS model_x, r.w * (1024::DOUBLE / c.width) AS model_w,
  r.y * (1024::DOUBLE / c.height) AS model_y, r.h * (1024::DOUBLE / c.height) AS model_h,
  greatest(0::DOUBLE, r.x - {_GROWTH}) AS grown_x, greatest(0::DOUBLE, r.y - {_GROWTH}) AS grown_y,
  least(c.width - greatest(0::DOUBLE, r.x - {_GROWTH}), r.w + 2 * {_GROWTH}) AS grown_w,
  least(c.height - greatest(0::DOUBLE, r.y - {_GROWTH}), r.h + 2 * {_GROWTH}) AS grown_h
  FROM regions r JOIN captured c ON c.document_id = r.document_id)
SELECT region_id, cx, cy, {", ".join(f"{rounded_sql(p + '_' + q)} AS {p}_{q}" for p in ("model", "grown") for q in "xywh")}
FROM m""")
def box_measures(spark, sf):
    r = view(spark, sf, "regions")
    frames = view(spark, sf, "captured").select("document_id", "width", "height")
    b = B.box("x", "y", "w", "h")
    model = B.scale_box(b, F.lit(float(B.SEGMENTER_SIDE)) / F.col("width"), F.lit(float(B.SEGMENTER_SIDE)) / F.col("height"))
    grown = B.grow(b, F.col("width"), F.col("height"))
    return r.join(frames, "document_id").select(
        "region_id", B.centroid(b)["x"].alias("cx"), B.centroid(b)["y"].alias("cy"),
        *[rounded(model[c]).alias(f"model_{c}") for c in "xywh"],
        *[rounded(grown[c]).alias(f"grown_{c}") for c in "xywh"],
    )


@query("detector_input_size", f"""{view_sql('captured')}
SELECT document_id,
  cast(ceil(floor(width * least(960.0::DOUBLE / greatest(width, height), 1.0::DOUBLE) + 0.5::DOUBLE) / 32) * 32 AS bigint) AS model_w,
  cast(ceil(floor(height * least(960.0::DOUBLE / greatest(width, height), 1.0::DOUBLE) + 0.5::DOUBLE) / 32) * 32 AS bigint) AS model_h
FROM captured""")
def detector_input_size(spark, sf):
    size = B.detector_input_size(F.col("width"), F.col("height"))
    return view(spark, sf, "captured").select("document_id", size["w"].alias("model_w"), size["h"].alias("model_h"))


@query("polygon_measures", f"""{view_sql('regions')},
p AS (SELECT region_id, x, y, w, h, CASE WHEN type = 'manual' THEN -1 ELSE 1 END AS turn FROM regions),
m AS (SELECT region_id, turn * w * h AS signed_area, 2 * (w + h) AS perimeter FROM p)
SELECT region_id, round(signed_area, 4) AS signed_area, round(perimeter, 4) AS perimeter, signed_area < 0 AS hole,
  abs(signed_area) < 10 AND perimeter < 10 AS noise FROM m""")
def polygon_measures(spark, sf):
    corners = B.corners(B.box("x", "y", "w", "h"))
    outline = F.when(F.col("type") == "manual", F.reverse(corners)).otherwise(corners)
    return view(spark, sf, "regions").withColumn("polygon", outline).select(
        "region_id", F.round(B.signed_area(F.col("polygon")), 4).alias("signed_area"),
        F.round(B.perimeter(F.col("polygon")), 4).alias("perimeter"),
        B.is_hole(F.col("polygon")).alias("hole"), B.is_noise_contour(F.col("polygon")).alias("noise"))
