"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An id list of at most so many rows (8 bytes each, about 40 bytes a row once hashed) may be broadcast.
BROADCAST_ROWS = 500_000
#: Bytes of rows, about, that go to a Python worker at once, and the setting that says so: Spark's 64 MB are a buffer in the JVM and another in the worker, twice in an executor of two cores.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: What empties the caches that a worker keeps from task to task.
WORKER_CACHES: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where a session on one machine names none (tests, a laptop) is a temporary one made
    and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stacklight-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: it is computed once, and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def let_go(*frames: DataFrame) -> None:
    """Delete what kept() wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "kept_path", None)
        if isinstance(path, str):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def utf8(text: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def joined_on_id(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """docs semi- or anti-joined with a list of ids (one column).

    The list is broadcast only when a count shows that it has at most BROADCAST_ROWS rows;
    otherwise both sides are shuffled by id.
    """
    ids = ids.select(id_col).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, id_col, how)


def give_back(caches: bool = True) -> None:
    """Return memory that nothing uses any more to the system; Arrow and malloc keep it otherwise."""
    if caches:
        for empty in WORKER_CACHES:
            empty()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def released(work: Callable[[Iterator], Iterator], caches: bool = True) -> Callable[[Iterator], Iterator]:
    """work, which gives its memory back when its task is over; with `caches` other operators' caches, too, as workers go on to other operators' tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if caches:
            give_back()
        try:
            yield from work(batches)
        finally:
            give_back(caches)

    return run


def mapped(rows: DataFrame, work: Callable[[Iterator], Iterator], schema, caches: bool = True) -> DataFrame:
    """rows.mapInArrow(work, schema) in batches of about BATCH_BYTES, unless the session has a setting of its own; memory is given back after each task."""
    conf = rows.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return rows.mapInArrow(released(work, caches), schema)


def byte_column(column: pa.Array | pa.ChunkedArray) -> tuple:
    """(offsets, bytes) of a binary or text Arrow column as numpy views; nulls are empty."""
    import numpy as np

    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):  # combine_chunks may return one with a single chunk
        array = array.chunk(0) if array.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)) if len(array) else np.zeros(1, np.int32)
    data = np.frombuffer(array.buffers()[2], np.uint8) if len(array) and array.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return offsets.astype(np.int64) - lo, data[lo:hi]


def binary_array(offsets, data) -> pa.Array:
    """A large binary Arrow array over numpy offsets and bytes, without copies."""
    import numpy as np

    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def in_slices(batches, column: int, most: int = 1 << 20):
    """The batches cut into runs of rows whose `column` has about `most` bytes; a longer single value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = byte_column(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(offsets.searchsorted(offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def whole_groups(batches, keys: int):
    """Tables of whole runs of equal leading `keys` columns in sorted batches, many small runs at a time; a run is never cut."""
    import numpy as np

    rest, open_key = [], None  # a run that goes on, in pieces that are put together once
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        last = [table.column(k)[-1].as_py() for k in range(keys)]
        same = np.ones(table.num_rows, bool)
        for k in range(keys):
            same &= table.column(k).to_numpy() == last[k]
        cut = table.num_rows - int(same.sum())
        if rest and (cut or last != open_key):
            cut += sum(t.num_rows for t in rest)
            table, rest = pa.concat_tables([*rest, table]).combine_chunks(), []
        if cut:
            yield table.slice(0, cut)
        if cut < table.num_rows:
            rest.append(table.slice(cut))
        open_key = last
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


def each_group(batches, keys: int):
    """The runs of equal leading `keys` columns in sorted batches, one table each."""
    import numpy as np

    for table in whole_groups(batches, keys):
        columns = [table.column(k).to_numpy() for k in range(keys)]
        fresh = np.zeros(table.num_rows, bool)
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        edges = np.flatnonzero(fresh).tolist()
        for first, last in zip(edges, [*edges[1:], table.num_rows], strict=True):
            yield table.slice(first, last - first)
