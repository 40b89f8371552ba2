"""Literal cases for validation, guards and payloads."""

import base64
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from maskloom.functions import images as I, texts, urls
from maskloom.operators import intake, validation
from maskloom.sources.image_files import read_image_files

PIXEL_PNG = ("data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize("url, want", [
    ("http://localhost:8080/image.png", "blocked_host"),
    ("http://LOCALHOST/image.png", "blocked_host"),
    ("http://127.0.0.1/image.png", "blocked_host"),
    ("http://0.0.0.0/image.png", "blocked_host"),
    ("http://[::1]/image.png", "blocked_host"),
    ("http://169.254.169.254/latest/meta-data/", "blocked_host"),
    ("http://192.168.1.1/image.png", "private_network"),
    ("http://10.0.0.1/image.png", "private_network"),
    ("http://10.example.com/image.png", "private_network"),
    ("http://172.16.0.1/image.png", "private_network"),
    ("http://172.20.0.1/image.png", "private_network"),
    ("http://172.31.0.1/image.png", "private_network"),
    ("http://172.16x.example.com/image.png", "private_network"),
    ("http://172.15.0.1/image.png", None),
    ("http://172.32.0.1/image.png", None),
    ("file:///etc/passwd", "invalid_url_scheme"),
    ("ftp://example.com/image.png", "invalid_url_scheme"),
    ("not a url", "invalid_url_scheme"),
    ("https://", "invalid_url"),
    ("HTTPS://example.com/a b.png", None),
])
def test_fetch_refusal(spark, url, want):
    assert one(spark, urls.fetch_refusal(F.col("u")), u=url) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.nytimes.com/article", "nytimes.com"),
    ("https://example.com:8080/path", "example.com"),
    ("https://user:pw@www.Example.com/", "example.com"),
    ("no address", None),
    (None, None),
])
def test_domain(spark, url, want):
    assert one(spark, urls.domain(F.col("u")), u=url) == want


@pytest.mark.parametrize("data, want", [
    (PIXEL_PNG, None),
    ("data:image/png;base64,invalid!!!", "invalid_base64"),
    ("data:image/png;base64,this is not valid base64!!!", "invalid_base64"),
    ("data:image/png;base64,SGVsbG8", "invalid_base64"),
    ("not a data url at all", "invalid_data_url"),
    ("data:text/plain;base64,SGVsbG8gV29ybGQ=", "unsupported_content_type"),
    ("data:application/json;base64,eyJrZXkiOiJ2YWx1ZSJ9", "unsupported_content_type"),
    ("data:image/jpeg;base64,ZmFrZSBqcGVnIGRhdGE=", "identify_failed"),
    ("data:image/webp;base64,ZmFrZSB3ZWJwIGRhdGE=", "identify_failed"),
    ("data:image/gif;base64,ZmFrZSBnaWYgZGF0YQ==", "identify_failed"),
])
def test_inline_image(spark, data, want):
    df = spark.createDataFrame([(data,)], "image_data string")
    row = intake.inline_assets(df).first()
    assert row.refusal == want
    assert df.select(intake.base64_refusal(F.col("image_data"))).first()[0] == want
    if want is None:
        assert (row["size"].w, row["size"].h) == (1, 1) and len(row.sha256) == 64


def _headers():
    vp8x = b"RIFF" + b"\0\0\0\0" + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    vp8 = b"RIFF" + b"\0\0\0\0" + b"WEBPVP8 " + struct.pack("<I", 10) + b"\0\0\0" + b"\x9d\x01\x2a" + struct.pack("<HH", 320, 240)
    bits = (640 - 1) | ((480 - 1) << 14)
    vp8l = b"RIFF" + b"\0\0\0\0" + b"WEBPVP8L" + struct.pack("<I", 10) + b"\x2f" + struct.pack("<I", bits) + b"\0" * 8
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"x" * 14 + b"\xff\xc2" + struct.pack(">HBHH", 11, 8, 77, 55) + b"\0" * 8
    return {
        "gif": (b"GIF89a" + struct.pack("<HH", 12, 34), (12, 34)), "vp8x": (vp8x, (300, 200)), "vp8": (vp8, (320, 240)),
        "vp8l": (vp8l, (640, 480)), "jpeg": (jpeg, (55, 77)), "none": (b"short", (None, None)),
    }


def test_image_size(spark):
    known = _headers()
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in known.items()], "k string, c binary")
    got = {r.k: (r.s.w, r.s.h) for r in df.select("k", I.image_size(F.col("c"), jpeg=True).alias("s")).collect()}
    assert got == {k: v[1] for k, v in known.items()}


def test_size_limit(spark):
    limits = spark.range(1).select(
        F.lit(I.MAX_ASSET_BYTES).alias("a"), F.lit(I.MAX_UPLOAD_BYTES).alias("u")).first()
    assert (limits.a, limits.u) == (52428800, 50000000)
    df = spark.createDataFrame([("a.PNG", 50000000, 1), ("a.gif", 50000001, 2), ("b", 1, 1)], "n string, s long, f int")
    got = [r[0] for r in df.select(I.upload_refusals(F.col("n"), F.col("s"), F.col("f"))).collect()]
    assert got == [[], ["too_large", "not_accepted", "too_many_files"], ["not_accepted"]]
    assert one(spark, I.upload_message(F.col("c")), c="too_large").startswith("File is too large")


def test_document_validation(spark):
    rows = [("https://example.com", "screenshot", None, "loading"), ("https://example.com", "invalid", None, None),
            (None, None, None, None), (None, "direct_asset", "upload", "ready"), ("https://e.com", "screenshot", None, "invalid_status")]
    df = spark.createDataFrame(rows, "source_url string, capture_mode string, source string, status string")
    got = [{e.field: e.message for e in r.errors} for r in validation.checked(df, validation.document_errors()).collect()]
    assert got == [{}, {"capture_mode": "is invalid"}, {"capture_mode": "can't be blank", "source_url": "can't be blank"},
                   {}, {"status": "is invalid"}]


def test_names(spark):
    df = spark.createDataFrame([("shot-20240101-1000",), ("shot-20240101-7b",), ("shot-20240101-",), ("shot-20240101-x",)], "n string")
    got = [r[0] for r in df.select(texts.sequence_number(F.col("n"), F.lit("shot-20240101-"))).collect()]
    assert got == [1000, 7, 0, 0]
    day = spark.sql("SELECT DATE'2024-01-01' AS d").select(
        texts.document_name(F.col("d"), F.lit(7)), texts.document_name(F.col("d"), F.lit(1234))).first()
    assert tuple(day) == ("shot-20240101-007", "shot-20240101-1234")


def test_background_url(spark):
    cases = {'url("https://a/b.png")': "https://a/b.png", "url('x.png')": "x.png", "url(y.png)": "y.png", "none": None,
             'linear-gradient(red, url("z"))': None, "url()": None}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert [r[0] for r in df.select(intake.background_url(F.col("c"))).collect()] == list(cases.values())


def test_half_up_rounding(spark):
    from maskloom.functions.boxes import round_half_up

    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,)], "v double")
    assert [r[0] for r in df.select(round_half_up(F.col("v"))).collect()] == [3, -2, 2]


def _png(w, h):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(7, 5))
    (tmp_path / "b.jpg").write_bytes(_headers()["jpeg"][0])
    (tmp_path / "big.webp").write_bytes(b"x" * 500)
    got = {r.path.rsplit("/", 1)[1]: r for r in read_image_files(spark, str(tmp_path), max_bytes=400).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].content_type) == (7, 5, "image/png")
    assert (got["b.jpg"].width, got["b.jpg"].height) == (55, 77)
    assert got["big.webp"].refusal == "file_too_large" and got["big.webp"].sha256 is None


def test_mask_payload(spark):
    raw = base64.b64encode(b"hello").decode()
    df = spark.createDataFrame([(raw,), (I.MASK_PREFIX + raw,), ("data:image/jpeg;base64," + raw,), (None,)], "m string")
    got = [r[0] and bytes(r[0]) for r in df.select(I.mask_bytes(F.col("m"))).collect()]
    assert got == [b"hello", b"hello", None, None]


def test_packet_escapes(spark):
    got = one(spark, texts.xmp_packet(F.col("s"), "tool"), s="""a&b<c>"d'""")
    assert "<dc:source>a&amp;b&lt;c&gt;&quot;d&apos;</dc:source>" in got and "<xmp:CreatorTool>tool<" in got
    assert "<dc:source></dc:source>" in one(spark, texts.xmp_packet(F.col("s")), s=None)


def test_candidates_inside_clips(spark):
    cols = ("element_id string, x double, y double, w double, h double, display string, visibility string, opacity string, "
            "image_url string, natural_width int, natural_height int, own_clone boolean, background_image string")
    rows = [("a", 0.0, 0.0, 200.0, 200.0, "block", "visible", "1", "u", 0, 10, False, "none"),
            ("b", 0.0, 0.0, 99.0, 200.0, "block", "visible", "1", "u", 5, 5, False, "none"),
            ("c", 0.0, 0.0, 200.0, 200.0, "block", "visible", "1", "u", 5, 5, True, "none")]
    e = spark.createDataFrame(rows, cols)
    none = e.limit(0)
    got = intake.candidate_set(e, e.filter("element_id = 'a'"), none).collect()
    assert sorted((r.element_id, r.kind, r.natural_width) for r in got) == [("a", "img", None), ("a", "picture", None)]
    clips = spark.createDataFrame([("a", 0.0, 0.0, 200.0, 99.0)], "element_id string, x double, y double, w double, h double")
    assert intake.candidate_set(e, none, none, clips).count() == 0


def test_append_and_lookup(spark, tmp_path):
    from maskloom.sources import captures

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, kind string")
    captures.append_rows(rows, str(tmp_path / "t"), ["kind"])
    captures.append_rows(rows, str(tmp_path / "t"), ["kind"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    docs = spark.createDataFrame([(1, "ready", "x.org"), (2, "error", "x.org")], "id long, status string, source_domain string")
    captures.write_documents(docs, str(tmp_path / "d"))
    found = captures.documents_where(spark, str(tmp_path / "d"), status="ready", source_domain="x.org")
    assert [r.id for r in found.collect()] == [1]
    assert "PartitionFilters: [isnotnull(status" in found._jdf.queryExecution().toString()


def test_jpeg_on_both_intake_paths_and_strict_line_ends(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC0001108012C01900301220002110103110100") + b"x"
    plain = base64.b64encode(jpeg).decode()
    inline = intake.inline_assets(spark.createDataFrame(
        [(1, "data:image/jpeg;base64," + plain), (2, "data:image/jpeg;base64," + plain + "\n")], "id int, image_data string"))
    got = {r.id: (r.refusal, r["size"].w, r["size"].h) for r in inline.collect()}
    assert got == {1: (None, 400, 300), 2: ("invalid_base64", None, None)}
    fetched = intake.fetched_assets(spark.createDataFrame(
        [("https://img.example.com/a.jpg", 200, None, "image/jpeg", bytearray(jpeg))],
        "image_url string, http_status int, error string, content_type_header string, content binary")).first()
    assert (fetched.refusal, fetched["size"].w, fetched["size"].h) == (None, 400, 300)


def test_a_gif_of_few_bytes_is_known_by_its_signature(spark):
    rows = [(f"https://img.example.com/{k}.gif", 200, None, "image/gif", None if c is None else bytearray(c)) for k, c in {
        0: b"GIF89a", 1: b"GIF89aA", 2: b"GIF89aAB", 3: b"GIF87aABC", 4: b"GIF89aABCD", 5: b"GIF89", 6: None}.items()]
    out = intake.fetched_assets(spark.createDataFrame(
        rows, "image_url string, http_status int, error string, content_type_header string, content binary")).collect()
    assert [(r.refusal, r["size"].w, r["size"].h) for r in sorted(out, key=lambda r: r.image_url)] == [
        (None, 0, 0), (None, 0x41, 0), (None, 0x4241, 0), (None, 0x4241, 0x43), (None, 0x4241, 0x4443),
        ("identify_failed", None, None), ("identify_failed", None, None)]


def test_only_jpegs_whose_walk_leaves_the_head_go_to_python(spark):
    def jpeg(before, frame=True, tail=100_000):
        segments = b"".join(b"\xff\xe1" + struct.pack(">H", n) + b"x" * (n - 2) for n in before)
        return b"\xff\xd8" + segments + (b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 300, 400) if frame else b"\xff\xd9") + b"t" * tail

    cases = {"near": jpeg([16]), "far": jpeg([60_000, 60_000, 30]), "none": jpeg([60_000], frame=False), "cut": jpeg([60_000])[:-100_005],
             "broken": b"\xff\xd8" + b"\0" * 9000, "many": jpeg([4] * (I.JPEG_SEGMENTS + 9))}
    cases |= {f"short{n}": jpeg([16], tail=9)[:n] for n in range(2, 40)}
    cases |= {f"edge{n}": jpeg([n], tail=3000) for n in range(I.JPEG_HEAD - 16, I.JPEG_HEAD + 4)}
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in cases.items()], "k string, c binary")
    out = df.select("k", I.image_size(F.col("c"), jpeg=True).alias("s"))
    assert {r.k: (r.s.w, r.s.h) for r in out.collect()} == {
        k: (None, None) if k in ("none", "cut", "broken") or k[:5] == "short" and len(cases[k]) < 29 else (400, 300) for k in cases}


def test_intake_batches_number_names_on_and_use_the_fetch_log(spark):
    from maskloom.session import fresh_dir
    from maskloom.sources.captures import CAPTURE
    from maskloom.streaming import jobs

    png = bytes.fromhex("89504E470D0A1A0A0000000D494844520000000A00000014") + b"rest"
    data = "data:image/png;base64," + base64.b64encode(png).decode()

    def capture(i, **values):
        row = {f.name: None for f in CAPTURE}
        row.update(request_id=i, requested_at=None if i == 9 else datetime(2024, 5, 6, 7),
                   source_url="https://a.example.com/", capture_mode="direct_asset", **values)
        return tuple(row[f.name] for f in CAPTURE)

    text = [((1.0, 2.0, 3.0, 4.0), None, None, "sale")]
    masks = [((1.0, 2.0, 3.0, 4.0), "???", 0.5, 1.0, None), ((1.0, 2.0, 3.0, 4.0), "AAAA", None, 1.0, None)]
    batches = [[capture(1, image_data=data, text_regions=text, segment_regions=masks), capture(2, image_data="nonsense", text_regions=text)],
               [capture(3, image_url="https://img.example.com/a.png"), capture(4, image_url="https://img.example.com/b.png"), capture(9)]]
    log = spark.createDataFrame([("https://img.example.com/a.png", 200, None, "image/png", bytearray(png))],
                                "image_url string, http_status int, error string, content_type_header string, content binary")
    out = fresh_dir(spark, "intake-test")
    for n, rows in enumerate(batches):
        jobs.intake_batch(spark.createDataFrame(rows, CAPTURE), n, out, log)
    docs = {r.request_id: (r.name, r.status, r.refusal, r.original_asset_id) for r in spark.read.parquet(f"{out}/documents").collect()}
    assert docs == {
        1: ("shot-20240506-001", "ready", None, "1-original"), 2: ("shot-20240506-002", "error", "invalid_data_url", None),
        3: ("shot-20240506-003", "ready", None, "3-original"), 4: ("shot-20240506-004", "error", "not_fetched", None),
        9: (None, "ready", None, None)}
    assets = {r.asset_id: (r.storage_uri, r.width, r.height) for r in spark.read.parquet(f"{out}/assets").collect()}
    assert assets == {"1-original": ("priv/static/uploads/shot-20240506-001/original.png", 10, 20),
                      "3-original": ("priv/static/uploads/shot-20240506-003/original.png", 10, 20)}
    found = sorted((r.region_id, r.type, r.z_index, r.mask_path) for r in spark.read.parquet(f"{out}/regions").collect())
    assert found == [("1-segment-1", "object", 1002, "priv/static/uploads/shot-20240506-001/masks/segment_2.png"), ("1-text-0", "text", 1, None)]
    # Two log rows for one address: one document; without a log a fetch is still to come.
    twice = log.unionByName(log.withColumn("http_status", F.lit(500)))
    for name, fetches, want in (("twice", twice, {3: ("ready", None), 4: ("error", "not_fetched"), 9: ("ready", None)}),
                                ("none", None, {3: ("loading", None), 4: ("loading", None), 9: ("ready", None)})):
        place = fresh_dir(spark, f"intake-{name}")
        jobs.intake_batch(spark.createDataFrame(batches[1], CAPTURE), 0, place, fetches)
        rows = spark.read.parquet(f"{place}/documents").collect()
        assert len(rows) == 3 and {r.request_id: (r.status, r.refusal) for r in rows} == want
        states = sorted((r.request_id, r.step, r.status) for r in spark.read.parquet(f"{place}/states").collect())
        assert states == sorted([(i, 0, "loading") for i in want] + [(i, 1, v[0]) for i, v in want.items() if v[0] != "loading"])
