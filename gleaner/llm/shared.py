"""What the operators of this folder share: scratch tables, worker paths, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes: space and \t \n \v \f \r.
SPACE_BYTES = (0x20, *range(0x09, 0x0E))
#: The same as a Java and RE2 class, for SQL expressions.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Python workers find this package; Arrow batches stay small with long texts."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where it names none, a folder in the warehouse, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts lineage and survives lost executors. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    jvm.System.gc()  # Spark removes a finished job's shuffle files when the driver collects its garbage; an operator of many jobs shouldn't wait for that
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the machine; workers outlive tasks, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, one after another, and the n + 1 places where texts begin. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has columns of that name already."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


#: Bits of the bitmap that ``divided`` broadcasts, as CELLS / 64 numbers: 1 MB whatever the data's size.
CELLS = 1 << 22


def divided(df: DataFrame, hashed: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose hash isn't in the column key of keys for certain, and the other rows, most of which have theirs there.

    No row of df moves: only a bitmap of fixed size is broadcast. So a join with
    keys moves the second part only, however large df is.
    """
    cell = F.col(key).bitwiseAND(CELLS - 1)
    word, bits = fresh(df, "__word", "__bits")
    place = lambda c: c.bitwiseAND(63).cast("int")
    words = keys.groupBy(F.shiftright(cell, 6).alias(word)).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(cell))).alias(bits))
    own = hashed.bitwiseAND(CELLS - 1)
    met = df.join(F.broadcast(written(words)), F.shiftright(own, 6) == F.col(word), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(bits), place(own)).bitwiseAND(1) == 1, F.lit(False))
    return met.where(~hit).select(*map(quoted, df.columns)), met.where(hit).select(*map(quoted, df.columns))


def quoted(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
