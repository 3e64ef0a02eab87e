"""Folder that the driver and all executors share, and tables written there.

``spark.checkpoint.dir`` names the folder.  Only where it is unset and the
session is local (tests, a laptop) is a local folder made and set; a cluster
without the setting is an error, as its machines would each write to their own.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # the folder of each local session without the setting
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError(f"{_KEY} is unset: tables between stages need a folder that the driver and all executors share")
        found = _LOCAL.get(context.applicationId)
        if found is None:
            found = _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="touchgrid-")
            context.setCheckpointDir(found)
    return found.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_GROUP_BYTES = 8 << 20
PART_BYTES = 64 << 20
MOST_PARTITIONS = 1 << 16
_UNKNOWN_BYTES = 1 << 56  # estimates of frames without statistics are at least that high


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session hand rows to Python by bytes and not by 10,000 rows: texts may be long."""
    conf = df.sparkSession.conf
    found = conf.get(_BATCH)
    if not found.isdigit() or int(found) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def others(docs: DataFrame) -> list[str]:
    """The columns beside doc_id and text, which operators carry in a struct of their own."""
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def carried(docs: DataFrame) -> DataFrame:
    """doc_id (long), text, text_hash and ``rest``: the other columns, whatever they are called."""
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others(docs)))
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"), rest.alias("rest"))


def restored(df: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from a frame with doc_id, text and ``rest``, in their order and types; ``new`` replaces some."""
    out = [new[c] if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns]
    return df.select(*(x.cast(docs.schema[c].dataType).alias(c) for x, c in zip(out, docs.columns, strict=True)))


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one; writers create it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _cleaned(spark: SparkSession):
    """Exchanges of what runs inside are removed when it ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs a re-read and no re-computation.
    The exchanges of the write are of no use afterwards and are removed with it.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    with _cleaned(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` or ``map_written`` that nothing reads any more."""
    for df in tables:
        fs, root = _fs(df.stored_in)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


def input_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: what the number of partitions and buckets goes by."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(docs: DataFrame, size: int = PART_BYTES) -> int:
    """The session's number of shuffle partitions, or more where the texts hold more parts of ``size`` bytes.

    Goes by the optimiser's estimate, which needs no scan for a table of files;
    frames that it knows nothing of are measured.
    """
    found = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if found >= _UNKNOWN_BYTES:
        found = input_bytes(docs)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-found // size), MOST_PARTITIONS))


def release() -> None:
    """Hands a worker's free memory back: workers live on, and the next stage may need little."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def without_collector(make: Callable) -> Callable:
    """``make`` with the cycle collector off: it would walk millions of words, none of which is in a cycle."""

    def run(batches):
        on = gc.isenabled()
        gc.disable()
        try:
            yield from make(batches)
        finally:
            if on:
                gc.enable()

    return run


def map_written(df: DataFrame, make: Callable, schema: str, name: str) -> DataFrame:
    """``df.mapInArrow(make, schema)`` as a table in the shared folder, written where it is made.

    The rows do not go back to the JVM; each task writes one Parquet file and
    hands on its name, and only named files are read, so what a failed attempt
    leaves is never seen.  The driver gets a name a task.
    """
    spark = df.sparkSession
    folder, types = new_dir(spark, name), T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def run(batches):
        file = writer = None
        held, size = [], 0
        for made in make(batches):
            if made.num_rows:
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made.columns, arrow, strict=True)], schema=arrow))
                size += made.nbytes
            if size >= _GROUP_BYTES:
                file, writer = _append(file, writer, held)
                held, size = [], 0
        if held:
            file, writer = _append(file, writer, held)
        held.clear()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([file.close()])], ["path"])
        release()

    def _append(file, writer, held):
        if writer is None:
            file = SharedFile(folder, "part", ".parquet")
            writer = pq.ParquetWriter(file.stream, arrow, compression="zstd")
        writer.write_table(pa.Table.from_batches(held, arrow))
        return file, writer

    with _cleaned(spark):
        paths = [r[0] for r in df.mapInArrow(run, "path string").collect()]
    out = spark.read.schema(types).parquet(*paths) if paths else spark.createDataFrame([], types)
    out.stored_in = folder
    return out


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class SharedFile:
    """A file in the shared folder that appears only when it is whole.

    Each attempt of a task writes under a name of its own, so a retried or a
    speculative attempt never meets another's bytes; the caller passes the name
    on in its rows, and Spark keeps the rows of one attempt only.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.fs, root = _fs(folder)
        self.fs.create_dir(root, recursive=True)
        leaf = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path = f"{folder}/{leaf}"
        self._final, self._draft = f"{root}/{leaf}", f"{root}/.{leaf}.draft"
        self.stream = self.fs.open_output_stream(self._draft)
        self.size = 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.stream.close()
        self.fs.move(self._draft, self._final)
        return self.path


def open_shared(path: str):
    """A random-access reader of a shared file (``seek``, ``read``, ``read_at``)."""
    fs, root = _fs(path)
    return fs.open_input_file(root)
