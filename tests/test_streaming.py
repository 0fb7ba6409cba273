from pyspark.sql import functions as F

from aeolis.plans.queries import synoptic_bucket
from aeolis.streaming.windows import synoptic_counts

from .conftest import SF


def test_synoptic_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = synoptic_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    run.stop()
    got = {(str(r["slot"]), r["event_type"], r["n"]) for r in spark.table("slots").collect()}
    assert got == {(str(r["slot"]), r["event_type"], r["n"]) for r in synoptic_bucket(spark, SF).withColumn("slot", F.col("slot").cast("timestamp")).collect()}
