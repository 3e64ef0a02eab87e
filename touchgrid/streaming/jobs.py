"""Streams as jobs: a table of their status, a ledger of their batches, and the latency of their stages.

A job is a streaming query with an id.  Its status is a small file in the job
folder that is replaced as a whole; ``jobs`` reads all of them as a table.  Each
batch is entered in a ledger once its rows are written, so a batch that comes
again after a crash - before or after its entry - leaves no double row.  A
listener keeps what each batch cost, and ``latencies`` runs a moving average
over that table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.frame_source import _fs

STATUS = "id string, name string, status string, error string, started double, ended double, batches long, rows long"
PROGRESS = "id string, batch_id long, rows long, at double, stage string, ms double"


class Folder:
    """Small JSON files of a folder; each appears or changes as a whole."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.root = _fs(uri)
        self.fs.create_dir(self.root, recursive=True)

    def put(self, name: str, value: dict) -> None:
        draft = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(value).encode())
        self.fs.move(draft, f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}").type == pafs.FileType.File

    def get(self, name: str) -> dict:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            return json.loads(f.read())

    def names(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))

    def table(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(self.uri) if self.names() else spark.createDataFrame([], schema)


class Job:
    """One stream into the folder ``at``: rows in at/out, state in at/checkpoint, ledger in at/ledger, status in at/jobs."""

    def __init__(self, at: str, name: str, id: str | None = None):
        self.at, self.name, self.id = at, name, id or uuid.uuid4().hex[:8]
        self.ledger, self.status = Folder(f"{at}/ledger"), Folder(f"{at}/jobs")
        self.started = time.time()
        self._say("processing")

    def _say(self, status: str, error: str | None = None) -> None:
        entries = [self.ledger.get(n) for n in self.ledger.names()]
        ended = None if status == "processing" else time.time()
        self.status.put(f"{self.id}.json", {"id": self.id, "name": self.name, "status": status, "error": error, "started": self.started, "ended": ended, "batches": len(entries), "rows": sum(e["rows"] for e in entries)})

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The sink of the stream: a batch that the ledger has is left alone, one half written is written anew."""
        entry = f"{batch_id:012d}.json"
        if self.ledger.has(entry):
            return
        out = f"{self.at}/out/batch={batch_id}"
        batch.write.mode("overwrite").parquet(out)
        self.ledger.put(entry, {"batch_id": batch_id, "rows": batch.sparkSession.read.schema(batch.schema).parquet(out).count(), "job": self.id})
        self._say("processing")

    def run(self, stream: DataFrame, write: Callable | None = None, mode: str = "append") -> str:
        """Runs the stream over all that is there; returns ``completed`` or ``failed``, which the table says as well."""
        query = stream.writeStream.queryName(f"{self.name}-{self.id}").outputMode(mode).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).foreachBatch(write or self.write).start()
        try:
            query.awaitTermination()
        except Exception as e:  # the job's end is a row of the table, whatever it was
            self._say("failed", str(e)[:2000])
            return "failed"
        self._say("completed")
        return "completed"

    def rows(self, spark: SparkSession, schema) -> DataFrame:
        """What the batches of the ledger wrote, and nothing else."""
        done = [self.ledger.get(n)["batch_id"] for n in self.ledger.names()]
        paths = [f"{self.at}/out/batch={i}" for i in done]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def jobs(spark: SparkSession, at: str) -> DataFrame:
    """The table of jobs of a folder."""
    return Folder(f"{at}/jobs").table(spark, STATUS)


class StageLatency(StreamingQueryListener):
    """Writes a file per batch of every query of the session: the milliseconds of each stage."""

    def __init__(self, at: str):
        self.folder = Folder(f"{at}/progress")

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.keep(str(p.id), p.batchId, p.numInputRows, dict(p.durationMs))

    def keep(self, id: str, batch_id: int, rows: int, stages: dict) -> None:
        self.folder.put(f"{id}-{batch_id:012d}.json", {"id": id, "batch_id": batch_id, "rows": rows, "at": time.time(), "stages": {k: float(v) for k, v in stages.items()}})

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, batch_id, rows, at, stage, ms): a row a batch and stage."""
        raw = self.folder.table(spark, "id string, batch_id long, rows long, at double, stages map<string, double>")
        return raw.select("id", "batch_id", "rows", "at", F.explode("stages").alias("stage", "ms"))


def latencies(progress: DataFrame, keep: float = 0.9) -> DataFrame:
    """``progress`` with ``smoothed``: keep * before + (1 - keep) * ms of each query and stage over its batches, from 0.

    As a closed form over a running window, so the table may be of any length:
    smoothed_n = (1 - keep) * sum of keep^(n - i) * ms_i.
    """
    w = W.partitionBy("id", "stage").orderBy("batch_id")
    held = F.collect_list("ms").over(w.rowsBetween(-399, 0))  # keep^400 is nothing beside a double's digits for keep up to 0.9
    n = F.size("held")
    sums = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s * keep + (1 - keep) * F.get("held", i))
    return progress.withColumn("held", held).withColumn("smoothed", sums).drop("held")
