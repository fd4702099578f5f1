"""What the operators of this subpackage share: tables, the shared folder, materialised steps."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter, whatever it is of.
FILTER_BITS = 1 << 24
#: What goes to Python at once while a step is written: so many rows, and so many bytes (one longer row goes alone).
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A session in local mode that names none (tests) gets a temporary folder, once; on a cluster the setting is a must,
    as executors can't read each other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarry_')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialise(df: DataFrame, step: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: its lineage ends there.

    A lost executor costs only the tasks that ran on it, as every copy of the step lies in shared storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{step}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _BATCH}
    for k, most in _BATCH.items():
        own = spark.conf.get(k)
        spark.conf.set(k, str(min(int(own), most) if own.isdigit() and int(own) > 0 else most))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def discard(*steps: DataFrame) -> None:
    """Deletes materialised steps that nothing reads any more."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.quarry_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_key(id_: Column, text: Column) -> Column:
    """128 bits that tell rows of different id or text apart, null from empty too."""
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(id_.cast("string"), F.lit("\x02")), F.coalesce(text.cast("string"), F.lit("\x02")))))


def apart(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with, for columns of an operator's own beside theirs."""
    taken = [c.lower() for f in frames for c in f.columns]
    prefix = "__"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return prefix


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filter_of(hashes: DataFrame) -> np.ndarray:
    """A filter of ``hashes(h)`` in bytes: it lets them all through, and others as it fills. At most ``FILTER_BITS / 64`` rows reach the driver."""
    place = hashes.select(F.pmod("h", F.lit(FILTER_BITS)).alias("at"))
    words = place.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def slices(batches, rows: int = 512):
    """Batches in parts of so many rows, for what makes much of a row or holds whole texts: neither side then holds much at once. What a worker no longer needs goes back before it waits for its next task."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (``uint64``) a filter lets through."""
    at = hashes & np.uint64(FILTER_BITS - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def marked(df: DataFrame, column: str, bits: np.ndarray, name: str) -> DataFrame:
    """``df`` with ``name``: whether the filter lets the hash in ``column`` (long) through.

    The filter is a broadcast table of ``FILTER_BITS / 4096`` rows, so rows and their texts stay out of Python.
    """
    own = apart(df)
    part, words = own + "part", own + "words"
    parts = pa.ListArray.from_arrays(np.arange(0, FILTER_BITS // 64 + 1, 64, dtype=np.int32), bits.view(np.int64))
    table_ = df.sparkSession.createDataFrame(pa.table({part: pa.array(np.arange(len(parts))), words: parts}))
    at = F.pmod(F.col(column), F.lit(FILTER_BITS))
    # Shifts by a column and places in an array take ints.
    word = F.get(words, F.shiftright(at, 6).bitwiseAND(63).cast("int"))
    bit = F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    both = df.withColumn(part, F.shiftright(at, 12)).join(F.broadcast(table_), part, "left")
    return both.select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))
