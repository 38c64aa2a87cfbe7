"""Fitted features and row-local steps on a stream give what they give on a table."""

import pytest

from tabwright import TableError
from tabwright.plans.ml_prep import MLConfig, prepare_ml
from tabwright.streaming.apply import clean_stream, transform_stream

STEPS = [
    {"op": "normalize_text", "columns": ["event_type"], "case": "upper"},
    {"op": "range", "columns": ["value"], "max": 50, "action": "drop"},
]


@pytest.fixture
def events(spark, data, tmp_path):
    frame = spark.read.parquet(f"{data}/events.parquet").select("event_id", "event_type", "value")
    folder = str(tmp_path / "events")
    frame.repartition(3).write.parquet(folder)
    return frame, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(spark, stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_fitted_features(spark, events):
    frame, stream = events
    fitted = prepare_ml(frame, MLConfig("event_id", ["value"], ["event_type"], max_categories=3), row_id="event_id").fitted
    assert fitted.categories[0].rare
    got = {r["event_id"]: r["features"] for r in drain(spark, transform_stream(stream, fitted), "features_out").collect()}
    assert got == {r["event_id"]: r["features"] for r in fitted.transform(frame).collect()}


def test_row_local_steps(spark, events):
    frame, stream = events
    got = drain(spark, clean_stream(stream, {"steps": STEPS}, "event_id"), "clean_out")
    assert got.count() == frame.filter("value <= 50").count()
    assert all(r[0].isupper() for r in got.select("event_type").distinct().collect())
    for step in ({"op": "drop_duplicates"}, {"op": "fill_missing", "columns": ["value"]}, {"op": "cast", "columns": ["value"]}):
        with pytest.raises(TableError, match="whole table"):
            clean_stream(stream, {"steps": [step]}, "event_id")
