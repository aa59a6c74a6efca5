import uuid

from pyspark.sql import functions as F

from threadmill.runtime import read_table
from threadmill.streaming import live


def test_streams_agree_with_batches(spark, sf, tmp_path):
    raw = read_table(spark, sf, "raw_comment")
    stream = live.stream_comments(spark, f"{sf}/raw_comment.parquet*", raw.schema)
    name = lambda: f"{tmp_path}/{uuid.uuid4().hex}"
    counts = live.run_to_end(live.live_category_counts(stream), name(), "complete")
    assert counts.agg(F.sum("n")).first()[0] == raw.where("created_utc is not null").count()
    sessions = live.run_to_end(live.live_sessions(stream), name(), "append")
    assert sessions.columns == ["session_window", "author", "n"]
    first = live.run_to_end(live.live_first_delivery(stream, "4000 days"), name(), "append")
    assert first.count() == raw.select("id").distinct().count()
