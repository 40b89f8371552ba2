"""Views that give the given Parquet tables the shape of the domain tables.

Each view is a list of ``(column, expression)`` over one table. Most expressions read the same
in Spark SQL and in ANSI SQL; where they differ, the pair ``(spark, ansi)`` is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Expr = str | tuple[str, str]

VIEWS: dict[str, tuple[str, list[tuple[str, Expr]]]] = {
    # Detected regions: about four per document.
    "regions": ("lineitem", [
        ("document_id", "l_orderkey"),
        ("region_id", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                      "cast(round(l_extendedprice * 100) AS bigint))"),
        ("found_at", "l_shipdate"),
        ("type", "CASE l_linenumber % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'object' ELSE 'manual' END"),
        ("x", "cast(l_partkey % 120 AS double)"),
        ("y", "cast(l_suppkey % 90 AS double)"),
        ("w", "cast(40 AS double) + l_quantity"),
        ("h", "cast(30 + l_partkey % 50 AS double)"),
        ("score", "cast(1 AS double) - l_discount"),
        ("stability", "cast(1 AS double) - l_tax"),
        ("mask_ok", "l_returnflag <> 'R'"),
    ]),
    # One pointer position per document.
    "points": ("orders", [
        ("document_id", "o_orderkey"),
        ("px", "cast(o_custkey % 200 AS double)"),
        ("py", "cast(o_orderkey % 150 AS double)"),
    ]),
    # One dragged selection window per document.
    "marquees": ("orders", [
        ("document_id", "o_orderkey"),
        ("x", "cast(o_custkey % 60 AS double)"),
        ("y", "cast(o_orderkey % 60 AS double)"),
        ("w", "cast(60 AS double)"),
        ("h", "cast(50 AS double)"),
    ]),
    # Captured documents.
    "captured": ("orders", [
        ("document_id", "o_orderkey"),
        ("owner", "o_custkey"),
        ("status", "CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'O' THEN 'awaiting_edits' ELSE 'ready' END"),
        ("captured_at", "o_orderdate"),
        ("width", "cast(400 + o_custkey % 1600 AS int)"),
        ("height", "cast(300 + o_orderkey % 1200 AS int)"),
        ("original_asset_id", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 2 END"),
        ("working_asset_id", "CASE WHEN o_custkey % 3 = 0 THEN o_orderkey * 2 + 1 ELSE NULL END"),
        ("name", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('shot-', cast(o_orderkey AS varchar(20))) END"),
    ]),
    # Score rasters: 64 values read as an 8 x 8 grid.
    "rasters": ("embeddings", [
        ("mask_id", "vec_id"),
        ("w", "8"),
        ("h", "8"),
        ("label", "label"),
        ("v", "embedding"),
    ]),
    # Edit actions of one user form one history.
    "actions": ("events", [
        ("key", "user_id"),
        ("at", "ts"),
        ("seq", "event_id"),
        ("action", "CASE WHEN event_type = 'error' THEN 'undo' ELSE 'add' END"),
        ("image_path", "concat('state/', cast(event_id AS varchar(20)), '.png')"),
    ]),
    # Capture requests with all the faults the validation knows.
    "requests": ("orders", [
        ("request_id", "o_orderkey"),
        ("requested_at", "o_orderdate"),
        ("source_url", "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE "
                       "concat('https://www.Site', o_custkey % 50, '.example.com/p/', o_orderkey) END"),
        ("capture_mode", "CASE o_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'invalid' WHEN 2 THEN '' "
                         "WHEN 3 THEN 'direct_asset' ELSE 'screenshot' END"),
        ("source", "CASE o_orderkey % 6 WHEN 0 THEN 'upload' WHEN 1 THEN NULL WHEN 2 THEN 'bogus' ELSE 'extension' END"),
        ("state", "CASE o_custkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'invalid_status' WHEN 2 THEN NULL ELSE 'loading' END"),
        ("image_width", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE cast(100 + o_custkey % 900 AS int) END"),
        ("image_height", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(100 + o_orderkey % 900 AS int) END"),
    ]),
    # Image addresses of every kind the guard distinguishes.
    "links": ("orders", [
        ("link_id", "o_orderkey"),
        ("page_url", "concat('https://img', o_custkey % 3, '.example.com/page')"),
        ("image_url", "CASE o_orderkey % 19 WHEN 0 THEN 'http://localhost:8080/i.png' "
                      "WHEN 1 THEN concat('http://10.', o_custkey % 256, '.0.1/i.png') "
                      "WHEN 2 THEN concat('https://192.168.', o_custkey % 256, '.9/i.png') "
                      "WHEN 3 THEN concat('http://172.', o_custkey % 40, '.0.1/i.png') "
                      "WHEN 4 THEN 'file:///etc/passwd' WHEN 5 THEN concat('ftp://host', o_custkey, '/i.png') "
                      "WHEN 6 THEN 'not a url' WHEN 7 THEN 'http://169.254.169.254/latest/' "
                      "WHEN 8 THEN concat('HTTPS://WWW.Site', o_custkey % 9, '.Example.com:8443/a?b=c') "
                      "WHEN 9 THEN 'http://' WHEN 10 THEN concat('//img', o_custkey % 4, '.example.com/x.png') "
                      "WHEN 11 THEN '/img/1.png' WHEN 12 THEN 'http://[::1]/x.png' "
                      "WHEN 13 THEN concat('http://user:pw@host', o_custkey, '.example.org/a') WHEN 14 THEN NULL "
                      "WHEN 15 THEN concat('https://img', o_custkey % 4, '.example.com:443/x.png') "
                      "WHEN 16 THEN concat('https://drive.google.com/f/', o_custkey) "
                      "WHEN 17 THEN concat('chrome://page/', o_custkey) "
                      "ELSE concat('https://www.img', o_custkey % 30, '.example.com/x.png') END"),
    ]),
    # Inline images: some carry a PNG header whose size follows from the text, some are broken.
    "inline": ("documents", [
        ("doc_id", "doc_id"),
        ("payload", (
            "replace(base64(concat(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(n_chars % 2000 + 1), 8, '0'), "
            "lpad(hex(doc_id % 1000 + 1), 8, '0'))), encode(text, 'UTF-8'))), '\\r\\n', '')",
            "to_base64(unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(to_hex(n_chars % 2000 + 1), 8, '0'), "
            "lpad(to_hex(doc_id % 1000 + 1), 8, '0'))) || encode(text))",
        )),
        ("plain", ("replace(base64(encode(text, 'UTF-8')), '\\r\\n', '')", "to_base64(encode(text))")),
        ("words", "replace(text, ',', ' ')"),
    ]),
    # Logged probes of image addresses.
    "heads": ("orders", [
        ("url", "CASE WHEN o_orderkey % 13 = 0 THEN concat('https://docs.google.com/', o_orderkey) "
                "ELSE concat('https://cdn', o_custkey % 20, '.example.com/', o_orderkey) END"),
        ("status", "CASE o_custkey % 6 WHEN 0 THEN 404 WHEN 1 THEN 405 WHEN 2 THEN 204 ELSE 200 END"),
        ("content_type", "CASE o_orderkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL ELSE 'image/png; q=1' END"),
        ("error", "CASE o_orderkey % 9 WHEN 0 THEN 'AbortError' WHEN 1 THEN 'TypeError' ELSE NULL END"),
    ]),
    "gets": ("orders", [
        ("url", "CASE WHEN o_orderkey % 13 = 0 THEN concat('https://docs.google.com/', o_orderkey) "
                "ELSE concat('https://cdn', o_custkey % 20, '.example.com/', o_orderkey) END"),
        ("status", "CASE o_custkey % 5 WHEN 0 THEN 206 WHEN 1 THEN 500 ELSE 200 END"),
        ("content_type", "CASE o_custkey % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN NULL ELSE 'image/jpeg' END"),
        ("error", "CASE o_custkey % 8 WHEN 0 THEN 'Failed to fetch' ELSE NULL END"),
    ]),
    # Elements found on pages.
    "elements": ("lineitem", [
        ("element_id", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                       "cast(round(l_extendedprice * 100) AS bigint))"),
        ("tag", "CASE l_linenumber % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'picture' ELSE 'background' END"),
        ("own_clone", "l_partkey % 17 = 0"),
        ("x", "cast(l_partkey % 700 AS double) + cast(0.25 AS double)"),
        ("y", "cast(l_suppkey % 500 AS double) + cast(0.5 AS double)"),
        ("w", "l_quantity * 5 + cast(0.5 AS double)"),
        ("h", "cast(l_partkey % 301 AS double)"),
        ("display", "CASE WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'none' ELSE 'block' END"),
        ("visibility", "CASE WHEN l_linestatus = 'F' AND l_linenumber = 4 THEN 'hidden' ELSE 'visible' END"),
        ("opacity", "CASE WHEN l_suppkey % 23 = 0 THEN '0' ELSE '1' END"),
        ("image_url", "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '/local.png' "
                      "WHEN 2 THEN concat('https://page.example.com/', l_suppkey, '.png') "
                      "ELSE concat('https://cdn', l_suppkey % 7, '.example.com/', l_partkey) END"),
        ("page_url", "'https://page.example.com/index.html'"),
        ("accessible", "CASE l_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END"),
        ("natural_width", "cast(l_partkey % 4 * 300 AS int)"),
        ("natural_height", "cast(l_partkey % 5 * 200 AS int)"),
        ("transform", "CASE l_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'matrix(1, 0, 0, 1, 0, 0)' "
                      "WHEN 2 THEN concat('matrix(1, 0, 0, 1, ', l_partkey, ', 12)') "
                      "WHEN 3 THEN 'matrix(0.7, 0.7, -0.7, 0.7, 0, 0)' WHEN 4 THEN 'matrix(2, 0, 0, 2, 0, 0)' "
                      "ELSE 'matrix3d(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)' END"),
        ("background_image", "CASE l_suppkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'linear-gradient(red, blue)' "
                             "WHEN 2 THEN 'radial-gradient(red, blue)' "
                             "WHEN 3 THEN concat('url(\"https://cdn.example.com/', l_partkey, '.jpg\")') "
                             "WHEN 4 THEN concat('url(bg/', l_partkey, '.png)') ELSE 'url()' END"),
    ]),
    # Stored assets: an original for most documents, a working copy for some.
    "assets": ("orders", [
        ("asset_id", "o_orderkey * 2"),
        ("document_id", "o_orderkey"),
        ("kind", "'original'"),
        ("storage_uri", "CASE WHEN o_orderkey % 3 = 0 THEN concat('file:///data/uploads/', o_orderkey, '/original.png') "
                        "WHEN o_orderkey % 3 = 1 THEN concat('priv/static/uploads/', o_orderkey, '/original.png') "
                        "ELSE concat('elsewhere/', o_orderkey, '/original.png') END"),
        ("width", "cast(400 + o_custkey % 1600 AS int)"),
        ("height", "cast(300 + o_orderkey % 1200 AS int)"),
    ]),
    "working_assets": ("orders", [
        ("asset_id", "o_orderkey * 2 + 1"),
        ("document_id", "o_orderkey"),
        ("kind", "'working'"),
        ("storage_uri", "concat('priv/static/uploads/', o_orderkey, '/working.png')"),
        ("width", "cast(400 + o_custkey % 1600 AS int)"),
        ("height", "cast(300 + o_orderkey % 1200 AS int)"),
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(
        *[f"{e if isinstance(e, str) else e[0]} AS `{c}`" for c, e in columns]
    )


def view_sql(*names: str) -> str:
    """``WITH`` clause (without trailing comma) that defines the views for an ANSI engine."""
    parts = []
    for name in names:
        source, columns = VIEWS[name]
        body = ", ".join(f'{e if isinstance(e, str) else e[1]} AS "{c}"' for c, e in columns)
        parts.append(f"{name} AS (SELECT {body} FROM {source})")
    return "WITH RECURSIVE " + ", ".join(parts)


PIXELS_SQL = (
    "pixels AS (SELECT mask_id, cast(i % 8 AS bigint) AS x, cast(i // 8 AS bigint) AS y, "
    "cast(v[i + 1] AS double) AS v FROM rasters, range(64) AS r(i))"
)
