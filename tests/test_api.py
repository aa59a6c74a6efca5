from threadmill.sources.api import fetch_by_ids, fetch_pages, resume_points

SCHEMA = "id string, subreddit string, created_utc long"


def test_pages_resume_and_borders(spark):
    def make():
        rows = [{"id": f"{s}{i}", "subreddit": s, "created_utc": 10 + i // 3} for s in "ab" for i in range(250)]
        return lambda sub, after, before: [r for r in rows if r["subreddit"] == sub and after <= r["created_utc"] < before][:40]

    slices = spark.createDataFrame([("a", 0, 10_000), ("b", 0, 50)], "subreddit string, after long, before long")
    got = fetch_pages(slices, make, SCHEMA)
    counts = {r.subreddit: r["count"] for r in got.groupBy("subreddit").count().collect()}
    assert counts == {"a": 250, "b": 120}
    assert fetch_pages(slices, make, SCHEMA, limit=55).count() == 110
    later = {r.subreddit: r.after for r in resume_points(slices, got).collect()}
    assert later == {"a": 93, "b": 49}


def test_by_ids_skips_failing_batches(spark):
    def make():
        def client(ids):
            if "bad" in ids:
                raise RuntimeError
            return [{"id": i, "subreddit": "s", "created_utc": 1} for i in ids if i != "gone"]

        return client

    ids = spark.createDataFrame([("x",), ("gone",), ("x",), (None,)], "id string").coalesce(1)
    assert [r.id for r in fetch_by_ids(ids, make, SCHEMA, wait=0).collect()] == ["x"]
    assert fetch_by_ids(ids.unionAll(spark.createDataFrame([("bad",)], "id string")).coalesce(1), make, SCHEMA, wait=0).count() <= 1
