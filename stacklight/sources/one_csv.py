"""One ordered CSV file from many tasks: ``df.write.format("one_csv").mode("overwrite").save(path)``.

Each task writes its partition beside the target; the commit joins the parts in the order of partitions
behind a byte-order mark and the header, and renames the file, so it is there whole or not at
all. A failed job removes its parts. Rows keep their order if df is sorted. Driver and tasks must share the path.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: First bytes of the file.
MARK = b"\xef\xbb\xbf"


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        os.makedirs(self.parts)  # by the driver alone: a task that is late finds no folder and fails

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        task = TaskContext.get()
        path = os.path.join(self.parts, f"{task.partitionId():08d}-{task.taskAttemptId()}")
        with open(path, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            for batch in iterator:
                out.writerows(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        return _Part(task.partitionId(), path)

    def commit(self, messages: list[_Part | None]) -> None:
        header = io.StringIO(newline="")
        csv.writer(header).writerow(self.names)
        with open(f"{self.path}.tmp", "wb") as f:
            f.write(MARK + header.getvalue().encode())
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with open(m.path, "rb") as part:
                    shutil.copyfileobj(part, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self.path}.tmp", self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[_Part | None]) -> None:
        gone = f"{self.parts}-gone"
        os.rename(self.parts, gone)  # tasks that still run can't add to it
        shutil.rmtree(gone, ignore_errors=True)
        if os.path.exists(f"{self.path}.tmp"):
            os.remove(f"{self.path}.tmp")


class OneCsv(DataSource):
    """A sink of plain columns; lists, maps and structs are for the caller to turn into text."""

    @classmethod
    def name(cls) -> str:
        return "one_csv"

    def writer(self, schema, overwrite: bool) -> _Writer:
        path = self.options.get("path")
        if not path:
            raise ValueError("one_csv needs a path")
        if os.path.exists(path) and not overwrite:
            raise FileExistsError(path)
        return _Writer(path, schema.names)


def save(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(OneCsv)
    rows.write.format("one_csv").mode("overwrite").save(path)
