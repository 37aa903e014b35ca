"""K-mer counts over files that keep arriving."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import counters
from ..sources import sequences


#: What the reader of whole files returns, of which only the path is read.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def read_stream(spark: SparkSession, path: str, schema: str = "read_id bigint, seq string", files_per_batch: int | None = None) -> DataFrame:
    """Reads of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def stream_counts(reads: DataFrame, k: int, mode: str = "max", nvalues: int = counters.NVALUES) -> DataFrame:
    """A streaming counter (code, value); the state store holds a count for each k-mer, at most 4**k."""
    return counters.count(reads, k, mode, nvalues)


def merge_batches(reads: DataFrame, k: int, path: str, checkpoint: str, mode: str = "max", nvalues: int = counters.NVALUES) -> StreamingQuery:
    """Writes each batch's counter to path/batch=<id>; a batch that is run again replaces its own folder.

    `load_batches` sums the batches, so no state is kept between them.
    """

    def write(batch: DataFrame, number: int) -> None:
        counters.count(batch, k, mode, 1 << 62).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_fastq(spark: SparkSession, folder: str, k: int, path: str, checkpoint: str, mode: str = "max", nvalues: int = counters.NVALUES, files_per_batch: int = 64) -> StreamingQuery:
    """Like `merge_batches`, over the FASTQ files (.gz too) that appear in a folder.

    The stream has the files' names, files_per_batch at a time; each batch reads its own files,
    whose records are counted in lines and so need whole files.
    """
    names = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def write(batch: DataFrame, number: int) -> None:
        files = [row.path for row in batch.collect()]
        if files:
            reads = sequences.read_fastq(spark, files, dirty=True)
            counters.count(reads, k, mode, 1 << 62).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_batches(spark: SparkSession, path: str, nvalues: int = counters.NVALUES) -> DataFrame:
    return spark.read.parquet(path).groupBy("code").agg(counters.saturated(F.sum("value"), nvalues).alias("value"))
