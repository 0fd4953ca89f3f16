"""Validation of micro-batches, with late rows written to the side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.scalars import micros
from tabwise.operators import quality
from tabwise.plans import durations
from tabwise.plans.specs import DatasetSpec


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if exists else None


def validator(spec: DatasetSpec, out: str, delay: str = "1h") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function writing ``report``, ``late``, ``rows`` and ``progress`` below ``out``.

    Rows older than the latest time of earlier batches minus ``delay`` are late. Every output of a batch
    overwrites its own ``batch_id`` folder, so a repeated batch after a failure changes nothing. ``progress`` holds the
    latest time so far, so that a batch reads what the one before it wrote, and no more.
    """
    slack = durations.micros(delay)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _written(spark, f"{out}/progress/batch_id={batch_id - 1}")
        if earlier is None and (every := _written(spark, f"{out}/progress")) is not None:  # numbers were left out
            earlier = every.where(F.col("batch_id") < batch_id)
        bound = earlier.agg(F.max("latest_us")).first()[0] if earlier is not None else None
        late = F.lit(False) if bound is None else micros(spec.time_key) < F.lit(bound - slack)
        marked = batch.withColumn("__late", F.coalesce(late, F.lit(False))).persist()
        place = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        try:
            on_time = marked.where(~F.col("__late")).drop("__late")
            place(marked.where("__late").drop("__late"), "late")
            place(quality.validate(on_time, spec), "report")
            place(on_time, "rows")
            latest = F.greatest(F.max(micros(spec.time_key)), F.lit(bound).cast("long"))
            place(on_time.agg(latest.alias("latest_us")), "progress")
        finally:
            marked.unpersist()

    return handle


def validate_stream(stream: DataFrame, spec: DatasetSpec, out: str, checkpoint: str, delay: str = "1h"):
    return (
        stream.writeStream.foreachBatch(validator(spec, out, delay))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
