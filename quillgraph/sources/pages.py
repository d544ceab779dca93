"""A sink that writes one file a page, under the page's own name."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillgraph.state import written

#: Tasks a core that write or read pages, at most.
WRITE_TASKS = READ_TASKS = 4
#: Bytes of pages, and names in a listing, that a task holds before it passes them on.
READ_BYTES, LISTED = 1 << 24, 10_000


def unique_paths(pages: DataFrame, key: str) -> DataFrame:
    """Pages (key, path, body) with paths of their own: of pages with one path the first by key keeps it, the k-th gets ``~k`` before the ending.

    A slug has no ``~``, so no other page has such a path.
    """
    k = F.row_number().over(Window.partitionBy("path").orderBy(key))
    stem, ending = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    return pages.withColumn("_k", k).withColumn("path", F.when(F.col("_k") == 1, F.col("path")).otherwise(F.concat(stem, F.lit("~"), F.col("_k").cast("string"), ending))).drop("_k")


def _opened(uri: str):
    """The file system of a URI, and the folder in it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    return store, root.rstrip("/")


class _PageWriter(DataSourceArrowWriter):
    """Each task writes its pages into a hidden folder of the attempt, and moves them to their own names: a task that runs again writes the same."""

    def __init__(self, target: str):
        self.target = target
        self.hidden = f".{uuid.uuid4().hex}"

    def write(self, batches: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, root = _opened(self.target)
        # Tasks make their files in folders of their own: in the pages' one they would wait for each other twice a page.
        hidden = f"{root}/{self.hidden}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(hidden, recursive=True)
        made = set()
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
                if posixpath.normpath(path) != path or path.startswith(("/", "..")):
                    raise ValueError(f"a page's path stays in its folder: {path!r}")
                folder, name = posixpath.split(f"{root}/{path}")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{hidden}/page", compression=None) as out:
                    out.write((body or "").encode())
                store.move(f"{hidden}/page", f"{folder}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _opened(self.target)
        if store.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.hidden}")

    abort = commit


class PageSource(DataSource):
    """``df.write.format("pages").mode("append").save(uri)`` of rows (path, body)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PageWriter(self.options["path"])


def write_pages(pages: DataFrame, uri: str) -> None:
    """Writes pages (path, body; every path once) below a URI that executors reach, such as ``file:///shared/wiki`` or ``hdfs://...``."""
    spark = pages.sparkSession
    spark.dataSource.register(PageSource)
    # A page costs a file however short it is, so pages are dealt by their number, not by their bytes.
    dealt = pages.select("path", "body").repartition(WRITE_TASKS * spark.sparkContext.defaultParallelism)
    dealt.write.format("pages").mode("append").save(uri)


def _children(batches: Iterator, uri: str) -> Iterator:
    """path, folder (whether it is one) of what lies in the folders given; hidden names aren't pages."""
    import os

    import pyarrow as pa
    from pyarrow import fs

    store, root = _opened(uri)

    def entries(path: str) -> Iterator:
        at = f"{root}/{path}"
        if isinstance(store, fs.LocalFileSystem):  # name by name
            with os.scandir(at) as found:
                yield from ((x.name, x.is_dir()) for x in found)
        else:
            yield from ((x.base_name, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(at)))

    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            for name, folder in entries(path):
                if not name.startswith("."):
                    rows.append({"path": posixpath.join(path, name), "folder": folder})
                if len(rows) == LISTED:
                    yield pa.RecordBatch.from_pylist(rows)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows)


def list_pages(spark: SparkSession, uri: str) -> DataFrame:
    """path (below the URI) of all pages, found a level of folders at a time by tasks: the list never passes through the driver."""
    folders, found = spark.createDataFrame([("",)], "path string"), None
    while found is None or not folders.isEmpty():
        below = written(folders.mapInArrow(partial(_children, uri=uri), "path string, folder boolean"), "listing")
        files, folders = below.where("NOT folder").select("path"), below.where("folder").select("path")
        found = files if found is None else found.union(files)
    return found


def _bodies(batches: Iterator, uri: str) -> Iterator:
    import pyarrow as pa

    store, root = _opened(uri)

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "body"])

    for batch in batches:
        paths, bodies, held = [], [], 0
        for path in batch.column("path").to_pylist():
            with store.open_input_stream(f"{root}/{path}", compression=None) as page:
                bodies.append(page.read())
            paths.append(path)
            held += len(bodies[-1])
            if held >= READ_BYTES:
                yield rows()
                paths, bodies, held = [], [], 0
        yield rows()


def read_pages(spark: SparkSession, uri: str, paths: DataFrame | None = None) -> DataFrame:
    """path (below the URI), body of the pages of ``paths`` (path), which whoever wrote them has, or of all that are found.

    Tasks open the files, each many, one after the other; a page of ``paths`` that isn't there is an error.
    """
    paths = list_pages(spark, uri) if paths is None else paths.select("path")
    dealt = paths.repartition(READ_TASKS * spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(partial(_bodies, uri=uri), "path string, body binary").withColumn("body", F.col("body").cast("string"))
