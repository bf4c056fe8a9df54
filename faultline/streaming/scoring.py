"""Score sensor rows as they arrive, and follow the stored predictions over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators import monitor
from faultline.plans.models import batch_score
from faultline.sources.models import load_model


def score_stream(
    source: DataFrame, model_path: str, table_path: str, checkpoint: str, name: str = "stream", once: bool = True,
) -> StreamingQuery:
    """Run the batch job on every micro-batch.

    The micro-batch number is the batch id, and storing a batch id again replaces that
    batch: a micro-batch repeated after a failure leaves no duplicates. The model is loaded
    once, when the stream starts.
    """
    model = load_model(model_path)

    def store(rows: DataFrame, epoch: int) -> None:
        batch_score(rows, model, table_path, f"{name}-{epoch:012d}")

    writer = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def trend_stream(predictions: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Trends of a prediction stream; a period is final once the watermark has passed it.

    Watermarks need a zoned timestamp: the stored local time is read in the session's
    zone, and the periods are given as local time again.
    """
    zoned = predictions.withColumn("created_at", F.col("created_at").cast("timestamp"))
    trends = monitor.prediction_trends(zoned.withWatermark("created_at", late), every)
    return trends.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "period_end")})
