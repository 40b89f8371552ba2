"""Tables on disk: layout along a curve, stored sketches, upload folders."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from maskloom.operators import intake, maintenance
from maskloom.session import fresh_dir
from maskloom.sources import image_files, layouts


def test_morton_key_interleaves_bits(spark):
    df = spark.createDataFrame([(0.0, 0.0), (17.0, 0.0), (0.0, 17.0), (16.0 * 5, 16.0 * 3), (-40.0, 1e9), (None, 33.0)], "x double, y double")
    keys = [r.k for r in df.select(layouts.morton_key(F.col("x"), F.col("y")).alias("k")).collect()]

    def plain(i, j):
        return sum(((i >> b & 1) << 2 * b) | ((j >> b & 1) << 2 * b + 1) for b in range(16))

    assert keys == [plain(0, 0), plain(1, 0), plain(0, 1), plain(5, 3), plain(0, 65535), plain(0, 2)]


def test_a_window_skips_row_groups(spark):
    rng = np.random.default_rng(2)
    n = 60_000
    rows = [(i % 50, f"r{i}", float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(zip(
        rng.uniform(0, 4000, n), rng.uniform(0, 4000, n), rng.uniform(1, 40, n), rng.uniform(1, 40, n)))]
    df = spark.createDataFrame(rows, "document_id long, region_id string, x double, y double, w double, h double")
    path = fresh_dir(spark, "regions")
    layouts.write_regions(df, path, files=8, row_group=64 << 10)
    window = (1000.0, 1000.0, 200.0, 150.0)
    got = layouts.regions_in_frame_window(spark, path, *window)
    want = df.filter((F.col("x") <= 1200) & (F.col("x") + F.col("w") >= 1000) & (F.col("y") <= 1150) & (F.col("y") + F.col("h") >= 1000))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == df.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert all(f"{c}" in plan.split("PushedFilters:")[1].split("]")[0] for c in ("right", "bottom"))
    groups = met = 0
    for file in sorted({r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}):
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            met += stats["x"].min <= 1200 and stats["right"].max >= 1000 and stats["y"].min <= 1150 and stats["bottom"].max >= 1000
    assert groups >= 8 and met <= 0.4 * groups


def test_summaries_of_stored_sketches(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if v < 0.7 else "b", 1_700_000_000 + int(s), None if v > 0.99 else float(x)) for v, s, x in zip(
        rng.random(30_000), rng.integers(0, 40 * 3600, 30_000), rng.lognormal(0, 2, 30_000))]
    log = spark.createDataFrame(rows, "tag string, s long, value double").withColumn("at", F.timestamp_seconds("s"))
    path = fresh_dir(spark, "sketches")
    maintenance.metric_sketches(log, ["tag"]).write.parquet(path)
    stored = spark.read.parquet(path)
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for low, high in ((0, 40), (5, 11)):
        hours = stored.filter(F.col("hour").between(F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600 + low * 3600)),
                                                    F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600 + high * 3600))))
        for r in maintenance.summary_of_sketches(hours, ["tag"], asked).collect():
            own = np.array([v for t, s, v in rows if t == r.tag and v is not None and low <= s // 3600 - 1_700_000_000 // 3600 <= high])
            assert (r.n, r.lowest, r.highest) == (len(own), own.min(), own.max()) and np.isclose(r.total, own.sum()) and np.isclose(r["mean"], own.mean())
            for c, p in asked.items():
                assert (own < r[c]).mean() - 0.01 <= p <= (own <= r[c]).mean() + 0.01
    assert maintenance.summary_of_sketches(stored.limit(0), ["tag"], asked).count() == 0


def test_upload_folders_of_a_real_root(spark, tmp_path):
    ids = [f"{i:08x}-0000-4000-8000-{i:012x}" for i in range(5)]
    for i, folder in enumerate([*ids, "shot-20240501-001"]):
        (tmp_path / folder).mkdir()
        for k in range(i % 2 + 1):
            (tmp_path / folder / f"{k}.png").write_bytes(b"x" * (k + 1))
    (tmp_path / ids[0] / ".hidden").write_bytes(b"")
    there = image_files.upload_folders(spark, str(tmp_path))
    assert {(r.folder, r["files"], r.bytes) for r in there.collect()} == {
        (f, i % 2 + 1, 1 + 2 * (i % 2)) for i, f in enumerate([*ids, "shot-20240501-001"])}
    documents = spark.createDataFrame([(ids[0],), (ids[3],)], "id string")
    assert {r.folder for r in intake.orphan_folders(there, documents).collect()} == {ids[1], ids[2], ids[4]}
    some = image_files.upload_files(spark, str(tmp_path), [ids[1], ids[2]])
    assert {(r.folder, r.file) for r in some.select("folder", "file").collect()} == {(ids[1], "0.png"), (ids[1], "1.png"), (ids[2], "0.png")}
    listing = some.select("folder", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in listing.split("ReadSchema")[-1]
    assert some.filter("file = '1.png'").first().content == bytearray(b"xx")


def test_upload_files_are_written_once_and_listed_in_few_tasks(spark, tmp_path):
    files = spark.range(600).selectExpr("concat('f-', id % 300) AS folder", "concat(id, '.json') AS file", "concat('text ', id) AS content")
    for root in (str(tmp_path / "plain"), f"file:{tmp_path}/uri", f"file://{tmp_path}/uri"):
        image_files.write_upload_files(files, root)
    for root in ("plain", "uri"):
        found = sorted(p.relative_to(tmp_path / root).as_posix() for p in (tmp_path / root).rglob("*") if p.is_file())
        assert found == sorted(f"f-{i % 300}/{i}.json" for i in range(600))
        assert (tmp_path / root / "f-7" / "307.json").read_text() == "text 307"
    spark.sparkContext.setJobGroup("listing", "listing")
    there = image_files.upload_folders(spark, str(tmp_path / "plain"))
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(s.numTasks for s in stages) <= image_files.LISTING * spark.sparkContext.defaultParallelism
    assert {(r["files"], r.bytes > 0) for r in there.collect()} == {(2, True)} and there.count() == 300


def test_upload_folders_are_counted_in_tasks_as_the_reader_sees_them(spark, tmp_path, monkeypatch):
    """Odd names, depths and empty files count as they do for Spark's reader, and no list of files comes to the driver."""
    from pyarrow import fs

    for name in ("a/1.png", "a/2.png", "a/.hidden", "a/_h=1", "a/x._COPYING_", "a/_metadata", ".off/1", "_off/1", "_o=n/1", "_metadata/1", "e._COPYING_/1",
                 "b/deep/x/1", "c/x/2", "b/.deep/1", "folder=z/1", "z/1", "plain.txt", "_r=oot", "per%20cent/1", "sp ace/1", "br[a]ck/1", "d/q=1/r=2/f", "em/none"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "em/none" else b"x" * len(name))
    (tmp_path / "empty").mkdir()
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    (tmp_path / "again").symlink_to(tmp_path / "a")
    read, roots = image_files.upload_files, [str(tmp_path), f"file:{tmp_path}/", f"file://{tmp_path}/b", str(tmp_path / "empty")]
    want = [set(map(tuple, read(spark, root).groupBy("folder").agg(F.count("*"), F.sum("length")).collect())) for root in roots]
    assert len(want[0]) == 11 and ("x", 2, 15) in want[0] and ("z", 2, 13) in want[0]

    def listed(*_):
        raise AssertionError("the reader lists the files on the driver")

    monkeypatch.setattr(image_files, "upload_files", listed)
    monkeypatch.setattr(image_files, "AT_ONCE", 2)
    assert [set(map(tuple, image_files.upload_folders(spark, root).collect())) for root in roots] == want
    # A store that is not a local one.
    store, sums = fs.SubTreeFileSystem("/", fs.LocalFileSystem()), {}
    for batch in image_files._root_entries(store, str(tmp_path)):
        for folder, n, size in zip(*(c.to_pylist() for c in image_files._counted(store, str(tmp_path), batch).columns)):
            was = sums.get(folder, (0, 0))
            sums[folder] = was[0] + n, was[1] + size
    assert {(f, *of) for f, of in sums.items()} == want[0]
    monkeypatch.undo()
    some = image_files.upload_folders(spark, f"{tmp_path}/[bc]")  # a pattern is left to the reader
    assert {r.folder for r in some.collect()} == {"x"}
    with pytest.raises(AnalysisException):
        image_files.upload_folders(spark, str(tmp_path / "nowhere"))
