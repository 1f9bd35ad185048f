"""What the operators of this package share: shared scratch tables, byte-exact word splitting, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one process."""
    found = spark.conf.get(CHECKPOINT, None) or _own.get(app := spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        found = _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder. They cut lineage, outlive lost executors, and are reread column by column."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str = "part") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "part") -> DataFrame:
        """df, written once and read back."""
        to = self.path(name)
        df.write.option("compression", "zstd").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, df: DataFrame) -> None:
        """Deletes the files behind a table of cut() that is no longer needed."""
        jvm = self.spark._jvm
        for d in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f.startswith(self.root.split(":", 1)[0]) and self.root.rsplit("/", 1)[1] in f}:
            path = jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str = "text"):
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """df dealt over as many tasks as the session shuffles into, at least; for heavy work per row on few files."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols) if cols else df.repartition(n)


#: Rows of 64 bits that mark keys, at most: what is broadcast has a bound, whatever the number of keys.
MARKS = 1 << 18


def _tagged(df: DataFrame, keys: DataFrame, col: str, how: str) -> DataFrame:
    """df with __marked: whether a key has the mark of the row's col. An inner join leaves out rows far from any mark, a left one has null there."""
    row = lambda: F.pmod(F.xxhash64(col), F.lit(MARKS))
    bit = lambda: F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{col}`), 40), 64) as int))")
    marks = keys.groupBy(row().alias("__row")).agg(F.bit_or(bit()).alias("__bits"))
    return df.withColumn("__row", row()).join(F.broadcast(marks), "__row", how).withColumn("__marked", F.col("__bits").bitwiseAND(bit()) != 0).drop("__row", "__bits")


def marked(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows of df whose col is in keys, and some others: those whose hash has a key's mark. To shuffle less before an exact join."""
    return _tagged(df, keys, col, "inner").filter("__marked").drop("__marked")


def parted(df: DataFrame, keys: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(marked(df, keys, col), all other rows of df). The others are in no key, so that an exact anti join has to shuffle the first alone. Nulls match nulls."""
    tagged = _tagged(df, keys, col, "left").withColumn("__marked", F.coalesce("__marked", F.lit(False)))
    return tagged.filter("__marked").drop("__marked"), tagged.filter("not __marked").drop("__marked")


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that what a task makes of long texts is handed on piecemeal."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def utf8_rows(batch: pa.RecordBatch, name: str):
    """The UTF-8 bytes of a string column, row by row, without decoding. Null is empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    for value in col:
        yield value.as_py() or b""
