"""Index upkeep as a stream: new deliveries of source files update a stored index."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import extraction as X
from quern.operators.sync import replaced
from quern.sources.stores import COMPONENT, names_in, read_text, write_text

FILE = "path string, language string, content string, file_hash string, indexed_at timestamp_ntz"
#: An index is kept in so many parts by the hash of the file, a batch rewrites the parts it touches.
PARTS = 64


def read_files(spark: SparkSession, folder: str, per_trigger: int = 8) -> DataFrame:
    """A stream of FILE rows from parquet files arriving in a folder."""
    return spark.readStream.schema(FILE).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def components_of(files: DataFrame) -> DataFrame:
    return X.with_ids(X.raw_components(files)).select(*(f.split()[0] for f in COMPONENT.split(", ")))


def apply_batch(old: DataFrame, files: DataFrame) -> DataFrame:
    """The components after a batch: those of its files exchanged for the newest delivery's."""
    newest = files.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("language", "content"), F.struct("indexed_at", "file_hash")).alias("f"))
    newest = newest.select("path", "f.language", "f.content")
    return replaced(old, components_of(newest), newest)


def _part(file: str):
    return F.pmod(F.xxhash64(file), F.lit(PARTS)).cast("int")


def _manifest(spark: SparkSession, index: str) -> tuple[int, dict[str, str]]:
    """(number, folder of each part) of the newest manifest; -2 and nothing where there is no index."""
    numbers = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in names_in(spark, index) if n.startswith("manifest-") and n.endswith(".json")]
    if not numbers:
        return -2, {}
    return max(numbers), json.loads(read_text(spark, f"{index}/manifest-{max(numbers)}.json"))


def _read_parts(spark: SparkSession, index: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(COMPONENT).parquet(*(f"{index}/{f}" for f in folders)) if folders else spark.createDataFrame([], COMPONENT)


def _write_parts(components: DataFrame, index: str, number: int, known: dict[str, str]) -> None:
    """Writes components' parts as generation `number`; the manifest that names them comes last."""
    spark = components.sparkSession
    data = f"data/generation={number}"
    components.withColumn("part", _part("file")).repartition(PARTS, "part").write.mode("overwrite").partitionBy("part").parquet(f"{index}/{data}")
    written = {n.removeprefix("part="): f"{data}/{n}" for n in names_in(spark, f"{index}/{data}") if n.startswith("part=")}
    write_text(spark, f"{index}/manifest-{number}.json", json.dumps({**known, **written}))


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """COMPONENT rows of a kept index as its newest manifest names them; a reader never sees half a batch."""
    return _read_parts(spark, index, sorted(_manifest(spark, index)[1].values()))


def start_index(components: DataFrame, index: str) -> None:
    """A kept index from components extracted before, as a first generation."""
    _write_parts(components.select(*(f.split()[0] for f in COMPONENT.split(", "))), index, -1, {})


def maintain(stream: DataFrame, index: str, checkpoint: str):
    """Starts the upkeep of the index at a path, which may exist already (start_index).

    A batch reads and rewrites only the parts its files fall into, as a new
    generation; then a manifest names the parts that are valid. A batch that
    is run again after a failure rewrites its own generation, and one that has
    its manifest already is passed over, so every batch takes effect once.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        last, folders = _manifest(spark, index)
        if last >= number:
            return
        batch = batch.persist()
        # At most PARTS numbers.
        touched = [str(r["part"]) for r in batch.where("path IS NOT NULL").select(_part("path").alias("part")).distinct().collect()]
        old = _read_parts(spark, index, [folders[p] for p in touched if p in folders])
        _write_parts(apply_batch(old, batch), index, number, {p: f for p, f in folders.items() if p not in touched})
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(files: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, language, files): deliveries per window of a FILE stream, late rows allowed for a while."""
    at = files.withColumn("at", F.col("indexed_at").cast("timestamp")).withWatermark("at", late)
    counts = at.groupBy(F.window("at", window), "language").agg(F.count(F.lit(1)).alias("files"))
    return counts.select(F.col("window.start").alias("start"), "language", "files")
