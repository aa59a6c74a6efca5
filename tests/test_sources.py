import json

import pyarrow as pa
import pytest

from threadmill.functions import answers, comment, text
from threadmill.sources import readers, writers
from threadmill.sources.zstd_dump import ZstdDump, stream_lines
from pyspark.sql import functions as F

COMMENT = {"id": "c1", "subreddit": "s", "author": "a", "body": "some text", "score": 3, "created_utc": 10, "edited": 1700000000.0,
           "_meta": {"removal_type": "removed"}, "extra_field": [1]}


def test_ndjson_skips_bad_lines_and_keeps_odd_types(spark, tmp_path):
    lines = [json.dumps(COMMENT), "", "  ", "{broken", json.dumps(COMMENT | {"id": "c2", "score": "many", "edited": False}), "[1]"]
    (tmp_path / "x.ndjson").write_text("\n".join(lines))
    got = {r.id: r for r in readers.read_ndjson(spark, str(tmp_path)).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"]._meta.removal_type == "removed"
    truth = readers.read_ndjson(spark, str(tmp_path)).select("id", comment.truthy(F.col("edited")).alias("e")).collect()
    assert {r.id: r.e for r in truth} == {"c1": True, "c2": False}


def test_zstd_source_carries_lines_over_chunks(spark, tmp_path):
    lines = [json.dumps(COMMENT | {"id": f"c{i}"}) for i in range(500)]
    for name in "ab":
        with pa.output_stream(str(tmp_path / f"{name}.zst"), compression="zstd") as f:
            f.write("\n".join(lines).encode())
    assert len(list(stream_lines(str(tmp_path / "a.zst"), 1000))) == 500
    spark.dataSource.register(ZstdDump)
    got = spark.read.format("zstd_ndjson").load(str(tmp_path / "*.zst"))
    assert got.count() == 1000 and got.rdd.getNumPartitions() == 2


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path), "a int").collect()


def test_small_files(spark, tmp_path):
    (tmp_path / "titles.json").write_text('{"p1": "One", "p2": "Two"}')
    got = {r.link_id: r.value for r in readers.read_side_table(spark, str(tmp_path / "titles.json"), "link_id", "string").collect()}
    assert got == {"p1": "One", "p2": "Two"}
    assert readers.read_side_table(spark, str(tmp_path / "none.json"), "k", "struct<a: int>").collect() == []
    (tmp_path / "rules.txt").write_text("\n 1. Be kind \n")
    assert readers.read_whole_text(spark, str(tmp_path / "rules.txt")).first().text == "1. Be kind"
    assert readers.read_whole_text(spark, str(tmp_path / "none.txt")).first().text == ""
    (tmp_path / "a_test_ids.txt").write_text("x1\n\n# no\nx2 \n")
    ids = readers.read_ids(spark, str(tmp_path / "*_test_ids.txt"), comments=True).collect()
    assert {tuple(r) for r in ids} == {("a", "x1"), ("a", "x2")}
    (tmp_path / "c.json").write_text('{"subreddits": [], "seen": ["a"], "unseen": ["b"]}')
    assert readers.read_config(spark, str(tmp_path / "c.json")) == ["a", "b"]
    assert readers.order_list(["a", "b", "c"], ["c", "z"], ["b"]) == ["c", "a"]


def test_extracted_and_csv(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "s.json").write_text(json.dumps({"removed": [COMMENT], "approved": [COMMENT, COMMENT]}, indent=1))
    got = readers.read_extracted(spark, str(tmp_path / "e"), "id string, score bigint").groupBy("category").count().collect()
    assert {(r.category, r["count"]) for r in got} == {("removed", 1), ("approved", 2)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.csv").write_text('body,subreddit,removed,context\n"two\nlines ""q""",s,True,\nb,s,False,ctx\n')
    rows = readers.read_labelled_csv(spark, str(tmp_path / "m")).orderBy("idx").collect()
    assert [(r.idx, r.label, r.parent_body) for r in rows] == [(0, "removed", ""), (1, "approved", "ctx")] and rows[0].body == 'two\nlines "q"'
    (tmp_path / "bad.csv").write_text("body,subreddit,removed,context\nx,s,maybe,\n")
    with pytest.raises(Exception, match="bad label"):
        readers.read_labelled_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_predictions_metrics_and_logs(spark, tmp_path):
    d = tmp_path / "runs" / "sub1"
    d.mkdir(parents=True)
    (d / "m1.jsonl").write_text('{"id": "1", "label": "removed", "prediction": "True"}\n')
    (d / "m2.jsonl").write_text('{"id": "2", "label": "removed", "prediction": "True"}\n')
    (d / "m1.json").write_text('{"model": "x", "subreddit": "S", "condition": "c"}')
    got = {r.id: (r.model, r.subreddit, r.method) for r in readers.read_predictions(spark, str(tmp_path / "runs")).collect()}
    assert got == {"1": ("x", "S", "c"), "2": (None, "sub1", None)}
    assert [r.stem for r in readers.discover(spark, str(tmp_path / "runs"), "*.jsonl").collect()] == ["m1", "m2"]
    (tmp_path / "r4_news_metrics.json").write_text('{"f1": 0.5, "n": 3}')
    (tmp_path / "r4_bad_metrics.json").write_text("oops")
    m = readers.read_metrics(spark, str(tmp_path / "*_metrics.json"), "f1 double, n long").collect()
    assert [tuple(r) for r in m] == [("news", 0.5, 3)]
    (tmp_path / "t.log").write_text("noise\n{'loss': 1.5, 'epoch': 0.1}\n{'eval_loss': 2.0}\n{'loss': 1.0, 'step': 70}\n")
    points = readers.read_loss_log(spark, str(tmp_path / "t.log")).collect()
    assert sorted((r.step, r.loss) for r in points) == [(10, 1.5), (70, 1.0)]
    (tmp_path / "meta.json").write_text(json.dumps({"log_history": [{"step": 1, "loss": 2.0}, {"step": 2, "eval_loss": 1.0}]}))
    assert readers.read_train_meta(spark, str(tmp_path / "meta.json")).count() == 2


def test_private_columns_do_not_leave(spark, tmp_path):
    df = spark.createDataFrame([("1", "someone", "flair", "x")], "id string, author string, author_flair_text string, body string")
    assert writers.public(df).columns == ["id", "body"]
    writers.write_once(df, str(tmp_path / "o"))
    writers.write_once(df.unionAll(df), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), (" 　\n",), ("A bc. D!",)], "t string")
    t = F.col("t")
    got = df.select(*[c.alias(n) for n, c in text.text_features(t).items()], text.word_count(t).alias("w")).collect()
    for r in got[:3]:
        assert (r.caps_ratio, r.sentence_count, r.paragraph_count, r.w, r.avg_word_length) == (0.0, 0, 1, 0, 0.0)
    assert (got[3].caps_ratio, got[3].sentence_count, got[3].w) == (0.5, 3, 3)
    profane = spark.createDataFrame([("Botß was damned stupid, dumbß",)], "t string").select(text.profanity_count(t)).first()[0]
    assert profane == 3


def test_answers(spark):
    cases = {"True.": ("True", "True", "True", "unparseable"), "I say False": ("False", "unparseable", "False", "unparseable"),
             "x FINAL: no\nFINAL: *True*": ("unparseable", "unparseable", "True", "unparseable"), "": ("unparseable", "unparseable", None, "unparseable"),
             "true and false": ("unparseable", "True", "True", "unparseable"), "neither": ("unparseable", "unparseable", None, "unparseable")}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    t = F.col("t")
    got = df.select("t", answers.parse_first_word(t), answers.parse_prefix(t), answers.parse_final(t), answers.parse_exact(t)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == cases
