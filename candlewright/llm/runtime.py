"""What the corpus operators share: scratch tables, Arrow batches, hot-safe joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.plans.shared import shared_dir
from candlewright.plans.ship import ship

#: Bytes of text that the array code works on at once (one longer text is worked on alone).
SLICE_BYTES = 2_000_000


class Scratch:
    """Tables written to the shared folder, to cut lineage or to use a costly result twice.

    A table outlives the executor that wrote it. ``drop`` frees one that is no longer read, and the shuffle files of plans that
    are done; ``clear`` frees all that this application has written, once their results have been read.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.roots.append(self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.option("compression", "zstd").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.scratch_path = where
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if getattr(df, "scratch_path", None):
                _delete(self.spark, df.scratch_path)
        self.spark._jvm.System.gc()  # shuffle files go when the driver's garbage is collected; left to itself, it may keep those of a whole query


def _delete(spark: SparkSession, where: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(where)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> None:
    """Deletes every scratch folder of this application (archives too). Results that were not read or written elsewhere are lost."""
    while Scratch.roots:
        _delete(spark, Scratch.roots.pop())


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to be no column's name."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters are in their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Entries of an array that stands for a row's repeats.
_RUN = 4096


def repeated(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as its column ``count`` (1 or more) says, numbered from 1 by ``name``; no array is longer than a few thousand entries
    (a count of n makes n / _RUN, then _RUN)."""
    run, = fresh([*df.columns, name], "run")
    n = F.col(quoted(count))
    runs = df.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _RUN))))
    each = F.sequence(F.col(run) * _RUN + 1, F.least(n, (F.col(run) + 1) * _RUN))
    return runs.withColumn(name, F.explode(each)).drop(run)


def small(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has no more than ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


#: Bytes of an Arrow batch, about; a longer text is a batch of its own.
BATCH_BYTES = 16_000_000


def batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow, whatever the columns are called; the step sees its rows cut to BATCH_BYTES, so that its lists and results stay small."""
    ship(df.sparkSession)
    names = df.columns

    def bounded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(piece for part in parts for piece in _cut(pa.RecordBatch.from_arrays(part.columns, names)))

    # mapInArrow takes a name with a dot for a field of a struct
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(bounded, schema)


@contextmanager
def handed(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand Python at most so many rows at once; a batch is held several times, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if part.nbytes <= BATCH_BYTES or part.num_rows < 2:
        yield part
        return
    half = part.num_rows // 2
    yield from _cut(part.slice(0, half))
    yield from _cut(part.slice(half))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) runs of rows whose texts together stay under ``limit`` bytes, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, stop
        at = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Bits in each part of a bitmap, as Spark's bitmap functions build them.
_PART = 32768


def bitmap(values: DataFrame, name: str, bits: int) -> bytes:
    """A packed bitmap of ``bits`` bits (a power of two) with the low bits of each value set; ``has`` asks it.

    It is built in parts by key and gathered: its size is fixed, whatever the number of values.
    """
    import numpy as np

    bit = F.col(name).bitwiseAND(F.lit(bits - 1)) + 1
    parts = (
        values.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
        .toLocalIterator()
    )
    out = np.zeros(max(bits, _PART) // 8, dtype=np.uint8)
    for r in parts:
        at = (r.part - 1) * _PART // 8
        out[at : at + _PART // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)[: _PART // 8]
    return out.tobytes()


def has(packed: bytes, values, bits: int):
    """For each 64-bit value: are its low bits set in the bitmap?"""
    import numpy as np

    low = values & np.uint64(bits - 1)
    table = np.frombuffer(packed, dtype=np.uint8)
    return table[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


#: Bits of the map of keys for each of them, and at most (16 MB).
_BITS_PER_KEY, _KEY_BITS = 16, 1 << 27


def likely(table: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of the table whose columns ``names`` may be among those of ``keys``: all that are, and by chance a few more.

    For a table that is to be joined with keys too many to broadcast and mostly meets none: only what is left is shuffled. The
    keys are asked through a bitmap of fixed size; the rest of a row does not go to Python.
    """
    import numpy as np

    ship(table.sparkSession)
    bits = 1 << min(_KEY_BITS.bit_length() - 1, max(20, (_BITS_PER_KEY * keys.count()).bit_length()))
    packed = table.sparkSession.sparkContext.broadcast(bitmap(keys.select(F.xxhash64(*names).alias("key")), "key", bits))

    def may(hashes: pd.Series) -> pd.Series:
        return pd.Series(has(packed.value, hashes.to_numpy(dtype=np.int64).view(np.uint64), bits))

    return table.where(F.pandas_udf(may, "boolean")(F.xxhash64(*names)))


def running(df: DataFrame, order: list, amount: str, name: str, scratch: Scratch) -> DataFrame:
    """The rows with ``name``: the sum of the whole column ``amount`` (long) over all rows before, in the order given.

    Rows are range-sorted, each task sums its own range as a stream, and the ranges' totals (a row a task) are added in front.
    Equal rows come in any order. The result is read from a table in the shared folder.
    """
    import numpy as np
    from pyspark.sql.types import LongType, StructField, StructType

    part, of, ahead_ = fresh([*df.columns, name], "part", "part_of", "ahead")
    fields = [*df.schema.fields, StructField(name, LongType()), StructField(part, LongType())]

    def add_up(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, done = TaskContext.get().partitionId(), 0
        for batch in parts:
            each = column(batch, amount).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = done + np.cumsum(each)
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ends - each, pa.int64()), pa.array(np.full(len(each), mine, dtype=np.int64))],
                [*batch.schema.names, name, part],
            )

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = scratch.table(batches(ranged, add_up, StructType(fields)), name)
    before, ahead = [], 0
    for r in sorted(local.groupBy(part).agg(F.sum(quoted(amount)).alias("total")).collect(), key=lambda r: r[part]):
        before.append((r[part], ahead))
        ahead += r["total"]
    totals = df.sparkSession.createDataFrame(before, f"`{of}` long, `{ahead_}` long")
    return local.join(F.broadcast(totals), F.col(part) == F.col(of)).select(*own(df), (F.col(name) + F.col(ahead_)).alias(name))
