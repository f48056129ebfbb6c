"""A sink that hands events over in batches with a tally, as a data source of Spark's own kind."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MOST_EVENTS = 500
TALLY = ("accepted", "duplicate", "rejected")


@dataclass
class Delivered(WriterCommitMessage):
    """What one task has staged: (file, events, accepted, duplicate, rejected) of each batch."""

    batches: list[tuple[str, int, int, int, int]] = field(default_factory=list)


def _storage(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if "://" not in path else fs.FileSystem.from_uri(path)


class BatchWriter(DataSourceWriter):
    """Rows of a task in batches of `size`; an attempt stages its files under a name of its own, and commit() makes those of the attempts that count visible."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.job = path, size, uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Delivered:
        storage, root = _storage(self.path)
        task, out, rows = TaskContext.get(), Delivered(), []
        stage = f"{root}/_staging/{self.job}"
        storage.create_dir(stage, recursive=True)

        def put() -> None:
            tally = [sum(r.get("status") == kind for r in rows) for kind in TALLY]
            sent = [{k: v for k, v in r.items() if k != "status"} for r in rows if r.get("status") == "accepted"]
            name = f"{self.job}-{task.partitionId():06d}-{len(out.batches):06d}-{task.taskAttemptId()}.json"
            with storage.open_output_stream(f"{stage}/{name}", compression=None) as f:
                f.write(json.dumps({"events": sent}, default=str).encode())
            out.batches.append((name, len(rows), *tally))
            rows.clear()

        for row in iterator:
            rows.append(row.asDict(True))
            if len(rows) == self.size:
                put()
        if rows:
            put()
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        storage, root = _storage(self.path)
        storage.create_dir(f"{root}/batches", recursive=True)
        done = [b for m in messages if m is not None for b in m.batches]
        for name, *_ in done:
            storage.move(f"{root}/_staging/{self.job}/{name}", f"{root}/batches/{name}")
        storage.create_dir(f"{root}/tallies", recursive=True)
        with storage.open_output_stream(f"{root}/tallies/{self.job}.json", compression=None) as f:
            for name, n, *tally in done:
                f.write((json.dumps({"batch": name, "events": n, **dict(zip(TALLY, tally, strict=True))}) + "\n").encode())
        self._clear(storage, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_storage(self.path))

    def _clear(self, storage: fs.FileSystem, root: str) -> None:
        """What attempts that don't count have left."""
        if storage.get_file_info(f"{root}/_staging/{self.job}").type == fs.FileType.Directory:
            storage.delete_dir(f"{root}/_staging/{self.job}")


class EventBatches(DataSource):
    """`df.write.format("event_batches").mode("append").option("batch_size", 500).save(path)`. (K-05)

    df has a status (accepted, duplicate or rejected) and the fields of an event. A task's rows
    go in batches of at most 500, each a JSON file {"events": [...]} of its accepted rows in
    path/batches; path/tallies has a line a batch with its events by status. Both appear once
    all tasks have ended: of a task that is tried again one attempt counts, and if the write
    fails nothing is seen. `path` is one that the driver and all executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "event_batches"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(self.options["path"], max(1, min(MOST_EVENTS, int(self.options.get("batch_size", MOST_EVENTS)))))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventBatches)
