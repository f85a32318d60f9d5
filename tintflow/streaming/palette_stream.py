"""Histograms that grow with a stream, and a palette for each state of them. Sums of moments merge, so the state is the cells: bins^3 an image at most."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.binning import UIntBinner
from ..operators import histogram, wu


def streaming_moments(pixels: DataFrame, binner: UIntBinner = UIntBinner()) -> DataFrame:
    """The cells' moments of a streaming pixel table; to be written in complete or update mode."""
    return histogram.moments(pixels, binner)


def write_palettes(pixels: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, binner: UIntBinner = UIntBinner(), **trigger) -> StreamingQuery:
    """Calls sink(palette, batch) with the palettes of all that has come so far, after each micro-batch."""

    def palettes(cells: DataFrame, batch: int) -> None:
        sink(wu.palette_of(wu.find_boxes(cells, k, binner.bins)), batch)

    return streaming_moments(pixels, binner).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(palettes).start()


def read_table_as_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream: a file of that name, or a folder of files."""
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)


def final_moments(pixels: DataFrame, folder: str, binner: UIntBinner = UIntBinner()) -> DataFrame:
    """The cells' moments when a stream that ends has been read: each micro-batch writes the whole state beside the last one, in a folder that all machines share."""
    last: list[str] = []

    def keep(cells: DataFrame, batch: int) -> None:
        cells.write.mode("overwrite").parquet(path := f"{folder}/state/{batch}")
        last[:] = [path]

    cells = streaming_moments(pixels, binner)
    cells.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    spark = pixels.sparkSession
    return spark.read.parquet(last[0]) if last else spark.createDataFrame([], cells.schema)
