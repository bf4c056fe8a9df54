import tempfile

from pyspark.sql import functions as F

from faultline import fixtures
from faultline.operators import monitor, scoring
from faultline.sources import models as store_model
from faultline.streaming import scoring as streaming


def test_trends_of_a_stream_equal_those_of_the_table(spark, sf):
    root = tempfile.mkdtemp(prefix="run-")
    table = fixtures.predictions(spark, sf)
    table.repartition(3).write.parquet(root + "/in")
    stream = spark.readStream.schema(table.schema).parquet(root + "/in")
    run = (streaming.trend_stream(stream, late="3650 days").writeStream.outputMode("complete").format("memory")
           .queryName("trends").option("checkpointLocation", root + "/state").trigger(availableNow=True).start())
    run.awaitTermination()
    have = sorted(tuple(r) for r in spark.table("trends").collect())
    assert have == sorted(tuple(r) for r in monitor.prediction_trends(table).collect())


def test_two_arrivals_are_two_batches(spark, sf):
    import __spark_entry__ as driver
    from faultline.plans import queries
    from faultline.sources import predictions as store

    root = tempfile.mkdtemp(prefix="run-")
    rows = fixtures.sensor_raw(spark, sf, key=True, wide=True).withColumn("n", F.crc32("row_key") % 2)
    path = root + "/model"
    features = list(queries.MODEL_FEATURES)
    store_model.save_model(scoring.train_boosted(
        queries._complete(spark, sf), features, params=scoring.BoostParams(rounds=2, depth=3)), path)
    model = path
    for part in (0, 1):
        rows.filter(F.col("n") == part).drop("n").coalesce(1).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema(rows.drop("n").schema).parquet(root + "/in")
        streaming.score_stream(stream, model, root + "/out", root + "/state").awaitTermination()
    stored = store.read_predictions(spark, root + "/out")
    assert stored.select("batch_id").distinct().count() == 2
    assert stored.select("row_key").distinct().count() == stored.count() == rows.count()
    assert stored.agg(F.max("prediction_id")).collect()[0][0] == rows.count()
    assert "score_stream" in driver.queries()
