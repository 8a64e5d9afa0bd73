"""Shared plumbing: the shared folder, written stage tables, input columns, Arrow access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Where it is unset, a local session (one machine, as in tests) gets a
    temporary folder that goes with the process; on a cluster that is an error, since no other machine could read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="lexspan-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        path = f"file://{path}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


_written: dict[str, SparkSession] = {}


def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and with it the way to reach the folder
            return


atexit.register(_remove_written)


BATCH_BYTES = 4 << 20  # of an Arrow batch for a Python worker, about; Spark's own limit is 64 MB


@contextmanager
def small_batches(spark: SparkSession):
    """Within it Spark hands rows to Python workers in batches of about BATCH_BYTES: a batch is held by the executor, outside its heap,
    and by the worker, whose kernels take windows of a few MB anyway.  The session's own limit holds where it is lower, and after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    lower = str(own).isdigit() and int(own) <= BATCH_BYTES
    if not lower:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if not lower:
            spark.conf.set(key, own)


def give_back() -> None:
    """Memory that this process has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidy(run):
    """run, an Arrow function, which gives back what it freed when its task ends.  Spark keeps workers for later stages, which would
    find this memory taken."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def stage_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Results are lazy and read these tables late, so they stay until the driver's process ends and are removed then."""
    spark = df.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/lexspan/{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(f"{home}/{name}", partitionBy=partition_by, compression="zstd")
    _written[home] = spark
    return spark.read.schema(df.schema).parquet(f"{home}/{name}")


HEAVY = 10_000


def heavy_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows.join(facts, keys, how) where facts has one row for each key, and weight counts the rows of that key.

    Keys that hold more than 1 / HEAVY of all weight, at most HEAVY by that, are joined by broadcast, so that a hot key
    is never one task's; the others are joined by shuffle.  Where all keys are of one kind there is one join: each broadcast costs the
    driver a thread and a copy.  rows and facts are read several times: stage them first.  how: inner or left.
    """
    total, least, most = facts.agg(F.coalesce(F.sum(weight), F.lit(0)), F.min(weight), F.max(weight)).first()
    if most is None or most * HEAVY <= total:
        return rows.join(facts, keys, how)
    if least * HEAVY > total:
        return rows.join(F.broadcast(facts), keys, how)
    heavy = facts.where(F.col(weight) * HEAVY > total)
    light = facts.where(F.col(weight) * HEAVY <= total)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def fresh_names(df: DataFrame, names: list[str]) -> list[str]:
    """names, each with as many underscores before it as keep it apart from df's columns (which match in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_groups(batches, keys: int):
    """Yields record batches that hold one value of the first keys columns each; input is sorted by them."""
    held: list[pa.RecordBatch] = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        change = np.zeros(n, bool)
        for c in range(keys):
            col = batch.column(c)
            change[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if held and held[-1].column(c)[-1] != col[0]:
                change[0] = True
        starts = np.flatnonzero(change).tolist()
        if not starts or starts[0] > 0:
            held.append(batch.slice(0, starts[0] if starts else n))
        for a, b in zip(starts, [*starts[1:], n]):
            if held:
                yield joined()
            held = [batch.slice(a, b - a)]
    if held:
        yield joined()


def utf8_column(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, data, valid) of an Arrow string column, without making Python strings.

    offsets has one entry more than rows and counts bytes in data; a null row is empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    n = len(col)
    if off is None or n == 0:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), np.zeros(n, bool)
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    valid = np.asarray(col.is_valid())
    return offsets - offsets[0], raw, valid


def row_windows(offsets: np.ndarray, target: int):
    """Consecutive row ranges [a, b) of about target bytes each, a row never split."""
    n = len(offsets) - 1
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + target, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
