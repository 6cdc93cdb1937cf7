"""What the corpus operators share: staged tables, text buffers, slices of bounded bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskline.session import scratch_path, ship_package

#: Text bytes that one NumPy pass works on; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(SLICE_BYTES),
            "spark.sql.parquet.columnarReaderBatchSize": "256"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors and keep what a task holds of a table of texts small in bytes, not only in
    rows: Arrow batches, and the batches that the Parquet reader decodes (4096 rows unless told, each column in one array
    that doubles as it grows, so that texts of a few KB fill a heap with arrays of 16 and 32 MB)."""
    ship_package(spark)
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and read it back: lineage ends
    there, so a lost executor costs a re-read and two readers do not compute it twice. Nothing reads the
    write's shuffle files again, so they go with it and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that :func:`staged` wrote and nothing will read again."""
    for df in tables:
        if df is not None and getattr(df, "_staged", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df._staged)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            df._staged = None


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and its n+1 offsets into them; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """The batch's rows in runs of at most ``most`` text bytes (a longer text alone)."""
    column = batch.column(batch.schema.get_field_index(text))
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, n in enumerate(length):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


class BitTable:
    """A bit for the leading bits of every 64-bit hash in a set: what lacks its bit is not in the set.

    The table has about 16 bits a member between 2**16 and 2**26 in all (8 MB), so it may go to every task
    whatever the set's size; a fuller table lets more through to the join that decides."""

    LEAST, MOST = 16, 26

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, hashes: DataFrame, column: str) -> "BitTable":
        bits = min(cls.MOST, max(cls.LEAST, (16 * max(1, hashes.count())).bit_length()))
        bit = F.shiftrightunsigned(column, 64 - bits)
        rows = hashes.select(F.shiftrightunsigned(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy(
            "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set")).collect()  # 2**MOST / 64 rows at most
        words = np.zeros(1 << (bits - 6), np.int64)
        for r in rows:
            words[r["word"]] = r["set"]
        return cls(bits, words.view(np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - self.bits)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)) == 1


def having(df: DataFrame, hash_column: str, table: BitTable) -> DataFrame:
    """The rows whose hash may be in the table's set; only the hashes go to Python."""
    from pyspark.sql.pandas.functions import arrow_udf

    sent = df.sparkSession.sparkContext.broadcast(table)

    @arrow_udf("boolean")
    def passes(hashes: pa.Array) -> pa.Array:
        return pa.array(sent.value.holds(hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    return df.where(passes(F.col(hash_column)))
