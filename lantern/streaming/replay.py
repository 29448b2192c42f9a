"""A finite table run through a stream: the way to hold every stream against its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def delivered(rows: DataFrame, order: str, files: int, folder: str) -> None:
    """The rows as so many deliveries in folder, in the order of a column; rows of equal order stay together."""
    cut = rows.groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    # shares of the rows by ranges of the order: at most `files` bounds come back
    bounds = cut.agg(F.expr(f"percentile_approx({order}, array({', '.join(str((i + 1) / files) for i in range(files))}), 10000)").alias("b")).first()["b"] or []
    low = None
    for high in [*bounds[:-1], None]:
        part = rows
        if low is not None:
            part = part.filter(F.col(order) > F.lit(low))
        if high is not None:
            part = part.filter(F.col(order) <= F.lit(high))
        part.coalesce(1).write.mode("append").parquet(folder)
        low = high if high is not None else low


def replayed(rows: DataFrame, order: str, through: Callable[[DataFrame], DataFrame], files: int = 3) -> DataFrame:
    """What a stream makes of the rows, delivered in so many files, a batch each; all of it is in the shared folder."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    delivered(rows, order, files, f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    return finished(through(stream), folder)


def finished(stream: DataFrame, folder: str) -> DataFrame:
    """Everything that a stream over finite files writes."""
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
