"""What the operators share: inputs, written cuts of the lineage, bounded filters."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at once; one longer text is held alone.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch, where the session leaves Spark's default: texts are long.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, and get small batches. A cluster whose
    machines don't have it installed gets it by ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without one, local mode makes its own."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    global _own
    if _own is None:
        _own = tempfile.TemporaryDirectory(prefix="cuts-")
    return f"file://{_own.name}"


_own: tempfile.TemporaryDirectory | None = None
_written: list[tuple[SparkSession, str]] = []


#: Shuffle partitions whose narrow rows go to one file, but two files a core.
NARROW = 8


def cut(df: DataFrame, name: str = "cut", narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: later stages neither
    recompute it nor depend on an executor's disk. Removed when Python exits. Rows of
    a few numbers that cost little to make are ``narrow``: partitions sized for texts
    would make tiny files of them."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // NARROW, 2 * spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # No marker file: only this driver reads the folder, and each file costs a local store a process.
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with it
            return


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row."""
    at = batch.schema.get_field_index(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0), np.int64)
    total, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def arrow_map(df: DataFrame, schema: str, column: str, work: Callable[[pa.RecordBatch], dict | None], most: int = SLICE_BYTES) -> DataFrame:
    """Map slices of batches to columns; ``work`` gets a slice and returns arrays by name."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                got = work(part)
                if got is not None:
                    yield pa.RecordBatch.from_pydict(got)

    return df.mapInArrow(run, schema)


def spread(text: Column) -> Column:
    """A long over its whole range from the first 60 bits of a string's MD5: a hash
    that other SQL engines have too."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") - (1 << 59)) * 16


def fetch(df: DataFrame) -> dict[str, np.ndarray]:
    """Columns of a small result, by Arrow whatever the session says: rows as
    Python objects would take the driver many times the memory."""
    got = df.toArrow()
    return {c: got.column(c).to_numpy() for c in got.column_names}


def bits_of(df: DataFrame, column: str, bits: int = 1 << 24, hashes: int = 2) -> np.ndarray:
    """A Bloom filter over a long column, of fixed size (bits / 8 bytes) whatever the
    rows: a pre-filter that lets some rows pass too many, never too few. Its words
    are OR-ed on the executors; at most bits / 64 rows of them reach the driver."""
    slots = F.array(*[F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(bits)) for i in range(hashes)])
    rows = (
        df.select(F.explode(slots).alias("b"))
        .groupBy(F.expr("b div 64").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v"))
    )
    got = fetch(rows)
    out = np.zeros(bits // 64, np.int64)
    out[got["w"]] = got["v"]
    return out


def in_bits(filter_: np.ndarray, column: Column, hashes: int = 2) -> Column:
    """Column of booleans: whether the filter may hold the value."""
    ship_bits = filter_.view(np.uint8)

    @F.pandas_udf("boolean")
    def may(*slots):
        ok = np.ones(len(slots[0]), bool)
        for s in slots:
            s = s.to_numpy(np.int64)
            ok &= (ship_bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
        import pandas as pd

        return pd.Series(ok)

    return may(*[F.pmod(F.xxhash64(F.lit(i), column), F.lit(len(filter_) * 64)) for i in range(hashes)])


def running(df: DataFrame, weight: str, order: list[str], group: list[str] | None = None, rows: int = 50_000, least: int = 4) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over the rows that stand before a row in
    its group, in the order of the columns ``order`` (the first is a long spread
    over its whole range or hashed; the rest break ties).

    No group is gathered in one task. Its rows are cut into buckets by quantiles of
    the first column, sums over buckets give each bucket's offset, and a window runs
    inside a bucket only. Needs a df that yields the same rows each time it is read.
    """
    from pyspark.sql import Window

    group = group or []
    n = df.count()
    parts = max(least, -(-n // rows))
    shift = F.expr(f"cast(floor((cast(`{order[0]}` as double) / 18446744073709551616.0 + 0.5) * {parts}) as int)")
    df = df.withColumn("_b", shift)
    sums = df.groupBy(*group, "_b").agg(F.sum(weight).alias("_s"))
    offsets = sums.withColumn(
        "_o",
        F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_s")
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_i", inside)
    on = [df[c].eqNullSafe(offsets[c]) for c in [*group, "_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = df.join(offsets, cond, "left")
    for c in [*group, "_b"]:
        out = out.drop(offsets[c])
    return out.withColumn("before", F.expr("_i + _o")).drop("_i", "_o", "_b")
