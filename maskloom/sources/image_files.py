"""Image files from a path."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.functions import images as I
from maskloom.session import fresh_dir

#: Tasks a core that list the folders of an upload root, entries of the root in one file of their table, and in one batch.
LISTING, ENTRIES, AT_ONCE = 8, 100_000, 10_000


def read_image_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = I.MAX_ASSET_BYTES) -> DataFrame:
    """Files with fingerprint, size in pixels and MIME type; ``refusal`` names those that are too large.

    The content of refused files is never read: the length filter reaches the scan.
    """
    def scan():
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)

    fine = scan().filter(F.col("length") <= max_bytes)
    size = I.image_size(F.col("content"), jpeg=True)
    read = fine.select("path", "length", "content", size.alias("size")).select(
        "path", "length", I.mime_of_name(F.col("path")).alias("content_type"), I.fingerprint(F.col("content")).alias("sha256"),
        F.col("size.w").alias("width"), F.col("size.h").alias("height"), F.lit(None).cast("string").alias("refusal"))
    large = scan().select("path", "length").filter(F.col("length") > max_bytes).select(
        "path", "length", I.mime_of_name(F.col("path")).alias("content_type"), F.lit(None).cast("string").alias("sha256"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit("file_too_large").alias("refusal"))
    return read.unionByName(large)


def upload_files(spark: SparkSession, root: str, folders: list[str] | None = None) -> DataFrame:
    """Files below the folders of an upload root: ``folder``, ``file``, ``path``, ``length``, ``modified`` and ``content``.

    Spark lists folders in parallel where there are many, on any store it can read; in ``LISTING`` tasks a core, as one task a folder would
    cost more than the folder. With ``folders`` only those are listed, such as
    the folders of a few documents. ``content`` is read where a query asks for it, so listing reads no file.
    """
    most = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(most)
    spark.conf.set(most, min(int(before), LISTING * spark.sparkContext.defaultParallelism))
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").option(
            "ignoreMissingFiles", "true").load([f"{root}/{f}" for f in folders] if folders is not None else root)
    finally:
        spark.conf.set(most, before)
    below = F.element_at(F.split("path", F.lit("/")), F.lit(-2))
    return found.select(
        F.regexp_replace(below, "^folder=", "").alias("folder"), F.element_at(F.split("path", F.lit("/")), F.lit(-1)).alias("file"),
        "path", "length", F.col("modificationTime").alias("modified"), "content")


def write_upload_files(files: DataFrame, root: str) -> None:
    """One file ``<root>/<folder>/<file>`` with ``content`` for each row, on a store that PyArrow knows and all executors reach.

    Tasks write the files in place, as uploads are; a repeated task writes its files again, so names must not repeat in a folder. Spark's
    file sinks move each file twice, and on a local store start a process for the rights of each.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(root)
        for batch in batches:
            made = set()
            for folder, file, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if folder not in made:
                    store.create_dir(f"{top}/{folder}")
                    made.add(folder)
                with store.open_output_stream(f"{top}/{folder}/{file}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    files.select("folder", "file", F.col("content").cast("binary")).mapInArrow(put, "written long").agg(F.sum("written")).collect()


def _store(root: str):
    """The PyArrow store of a root, and the root's path in it."""
    from pyarrow import fs

    local = root.startswith(("/", "file:"))
    return (fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(root)


def _listable(spark: SparkSession, root: str) -> str | None:
    """The root as tasks can list it; none where it is a pattern, no folder, or in a store that only Spark reads."""
    from pyarrow import fs

    if set(root) & set("*?[]{}\\"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    where = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    try:
        store, top = _store(where)
        return where if store.get_file_info(top).type == fs.FileType.Directory else None
    except (OSError, pa.ArrowException):
        return None


def _entries(store, folder: str) -> Iterator[tuple[str, int | None]]:
    """Name and length of what Spark's readers see in a folder: no hidden names, no empty files. A folder has no length; one that is gone has no entries."""
    from pyarrow import fs

    def unseen(name: str, is_folder: bool) -> bool:
        if not is_folder:
            return name.startswith((".", "_")) or name.endswith("._COPYING_")
        hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
        return hidden and not name.startswith(("_common_metadata", "_metadata"))

    if isinstance(store, fs.LocalFileSystem):  # one entry at a time, however many there are
        try:
            with os.scandir(folder) as found:
                for e in found:
                    is_folder = e.is_dir()
                    if unseen(e.name, is_folder):
                        continue
                    try:
                        size = None if is_folder else e.stat().st_size
                    except FileNotFoundError:
                        continue
                    if is_folder or size:
                        yield e.name, size
        except (FileNotFoundError, NotADirectoryError):
            pass
        return
    for e in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        is_folder = e.type == fs.FileType.Directory
        if (is_folder or e.size) and not unseen(e.base_name, is_folder):
            yield e.base_name, None if is_folder else e.size


def _root_entries(store, top: str) -> Iterator[pa.RecordBatch]:
    """Entries of a root. Names are bytes, as a file system need not keep to UTF-8."""
    names, lengths = [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lengths, pa.int64())], names=["name", "length"])

    for name, length in _entries(store, top):
        names.append(os.fsencode(name))
        lengths.append(length)
        if len(names) == AT_ONCE:
            yield batch()
            names, lengths = [], []
    yield batch()


def _counted(store, top: str, entries: pa.RecordBatch) -> pa.RecordBatch:
    """Files and bytes by folder, below entries of the root at ``top``; a file counts for the folder it lies in, at any depth."""
    sums: dict[str, list[int]] = {}

    def add(folder: str, length: int) -> None:
        name = os.fsencode(os.path.basename(folder)).decode(errors="replace").removeprefix("folder=")
        of = sums.setdefault(name, [0, 0])
        of[0] += 1
        of[1] += length

    for name, length in zip(*(entries.column(i).to_pylist() for i in range(2))):
        if length is not None:
            add(top, length)
            continue
        todo = [f"{top}/{os.fsdecode(name)}"]
        while todo:
            folder = todo.pop()
            for below, size in _entries(store, folder):
                if size is None:
                    todo.append(f"{folder}/{below}")
                else:
                    add(folder, size)
    columns = [list(sums), [n for n, _ in sums.values()], [b for _, b in sums.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["folder", "files", "bytes"])


def upload_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders of an upload root that hold files, with how many and how many bytes.

    On a store that PyArrow knows, tasks list the folders: the entries of the root are written to a table, from which the folders are
    dealt out, and only sums leave a task. The driver holds no list. A local or shared root is read entry by entry; of another store, one task
    holds the entries of one folder. Where only Spark can read, its reader lists the files, and the driver holds that list.
    """
    where = _listable(spark, root)
    if where is None:
        return upload_files(spark, root).groupBy("folder").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    table, schema = fresh_dir(spark, "upload-entries"), "name binary, length long"

    def entries(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _root_entries(*_store(where))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(where)
        for batch in batches:
            yield _counted(store, top, batch)

    spark.range(0, 1, 1, 1).mapInArrow(entries, schema).write.option("maxRecordsPerFile", ENTRIES).parquet(table)
    dealt = spark.read.schema(schema).parquet(table).repartition(LISTING * spark.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(counted, "folder string, files long, bytes long").groupBy("folder").agg(
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
