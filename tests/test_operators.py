import hashlib
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, spark_rows, sql_rows
from threadmill.functions import draws
from threadmill.operators import dedup, enrich, evaluate, history, lookups, ordered, resample, sampling, scoring
from threadmill.plans import ORACLES, QUERIES


def comments(spark, n=300, seed=2, skewed=False):
    rng = random.Random(seed)
    who = lambda: rng.choice(["hot", "hot", None, "a0", "a1"]) if skewed else f"a{rng.randrange(8)}"
    rows = [(i, who(), rng.randrange(400_000), f"t{rng.randrange(5)}", rng.choice([None, 1, -3, 9])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, author string, created_utc long, link_id string, score long"), rows


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))


@pytest.mark.parametrize("hot", [10**6, 60])
def test_history_against_a_loop(spark, hot):
    """With 60, the author of half of the rows and the missing one are cut into days."""
    df, rows = comments(spark, skewed=True)
    got = {r.row_id: r for r in history.author_history(df, hot=hot).collect()}
    assert len(got) == len(rows)
    past = defaultdict(list)
    for i, author, t, link, score in sorted(rows, key=lambda r: (r[2], r[0])):
        before = past[author]
        r = got[i]
        assert r.n_prior == len(before) and r.is_first == (not before)
        assert r.vel_24h == sum(x[0] > t - 86_400 for x in before)
        assert r.unique_threads == len({x[1] for x in before})
        assert r.max_in_thread == max((sum(y[1] == x[1] for y in before) for x in before), default=0)
        assert r.avg_score == half_up(sum(x[2] for x in before) / len(before) if before else 0.0)
        assert r.days_active == half_up((t - before[0][0]) / 86_400 if before else 0.0)
        before.append((t, link, 1 if score is None else score))


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df, rows = comments(spark, 500)
    df = df.withColumn("g", F.lit("x"))
    one = {r.row_id: r.split for r in sampling.random_split(df, "g", "row_id").collect()}
    assert sum(s == "train" for s in one.values()) == 400
    for parts in (1, 4, 16):
        assert {r.row_id: r.split for r in sampling.random_split(df.repartition(parts), "g", "row_id").collect()} == one
    by_author = sampling.author_split(df, "g").collect()
    assert not {r.author for r in by_author if r.split == "test"} & {r.author for r in by_author if r.split == "train"}
    assert sum(r.split == "test" for r in by_author) >= 100


def test_balance_and_shortfall(spark):
    df = spark.createDataFrame([(i, "x", "removed" if i < 7 else "approved") for i in range(50)], "id long, g string, label string")
    got = sampling.cap_and_balance(df, "g", "label", "id", cap=20).groupBy("label").count().collect()
    assert {(r.label, r["count"]) for r in got} == {("removed", 7), ("approved", 7)}
    assert sampling.stratified_sample(df, "label", "id", 5).count() == 10
    with pytest.raises(Exception, match="too few rows"):
        sampling.stratified_sample(df, "label", "id", 8).collect()


def test_spam_needs_copies_and_authors(spark):
    rows = [(f" buy now {'' if i % 2 else ' '}", f"a{i % 2}", "c") for i in range(5)] + [("alone", "a", "c")] * 9 + [("rare", f"b{i}", "c") for i in range(4)]
    df = spark.createDataFrame(rows, "body string, author string, category string")
    left = {r.body.strip() for r in dedup.remove_spam(df, ["category"]).collect()}
    assert left == {"alone", "rare"}


def test_failed_batches_become_rows(spark):
    def make():
        def score(pdf):
            raise RuntimeError("down")

        return score

    df = spark.createDataFrame([(str(i), "text") for i in range(10)], "id string, prompt string")
    got = scoring.score_prompts(df, make).collect()
    assert len(got) == 10 and all(r.error.startswith("ERROR") and r.raw is None for r in got)
    fine = scoring.score_prompts(df, scoring.length_rule(5), per_minute=1e9).collect()
    assert {r.raw for r in fine} == {"True"}


def test_rolling_loss_window(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(1, 13)], "run string, step long, loss double")
    got = {r.step: r.rolling for r in history.rolling_loss(df).collect()}
    assert got[1] == 1.0 and got[12] == pytest.approx(sum(range(7, 13)) / 6)
    short = {r.step: r.rolling for r in history.rolling_loss(df.where("step <= 10")).collect()}
    assert short[10] == 10.0


def test_registered_with_the_values_of_the_reference(spark, sf, tmp_path):
    from threadmill.plans import QUERIES

    runs = QUERIES["bootstrap_rows_full"](spark, sf).select("run").distinct().count()
    assert runs == 2000
    text = "  " + " ".join(f"w{i}" for i in range(600))
    rows = [(1, text, text), (2, None, "a b")]
    spark.createDataFrame(rows, "sample_id long, body string, parent_body string").write.parquet(str(tmp_path / "demo_sample.parquet"))
    got = {r.sample_id: r for r in QUERIES["text_left_words_full"](spark, str(tmp_path)).collect()}
    assert (got[1].head.split(), got[1].parent_head.split()) == (text.split()[:512], text.split()[:256])
    assert got[2].head is None and got[2].parent_head == "a b"
    assert QUERIES["sample_reservoir_full"](spark, sf).count() > QUERIES["sample_reservoir"](spark, sf).count()


def test_counted_resamples_are_those_of_the_sql(spark, sf):
    """2,000 resamples by the SQL of five, without a row made for each draw."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def written():
        """Rows that each stage wrote to a shuffle."""
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    got = spark_rows(QUERIES["bootstrap_rows_full"](spark, sf))
    sql = ORACLES["bootstrap_rows"]
    assert sql.count("range(1, 6)") == 1 and len(got[1]) > 2000
    assert got == sql_rows(connect(sf), sql.replace("range(1, 6)", "range(1, 2001)"))
    assert 0 < max(n for stage, n in written().items() if stage not in before) < 20_000


@pytest.mark.parametrize(("held", "kinds"), [(10**9, 3), (0, 3), (2500, 7)])
def test_counted_resamples_of_pieces(spark, monkeypatch, held, kinds):
    """Groups of many pieces, of one row and without a name, in one turn or several, against drawn rows."""
    monkeypatch.setattr(resample, "PIECE", 4)
    monkeypatch.setattr(resample, "STEP", 16)
    monkeypatch.setattr(resample, "HELD", held)
    rng = random.Random(3)
    rows = [(i, g, rng.randrange(kinds + 1)) for g, n in (("hot", 150), ("b", 13), (None, 9), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, k int")
    got = resample.bootstrap_counts(df, ["g"], "id", 30, {f"k{k}": F.col("k") == k for k in range(kinds)}, seed=7).collect()
    assert len(got) == 4 * 30
    for row in got:
        own = [k for _, g, k in rows if g == row.g]
        drawn = [own[int(hashlib.md5(f"7|{row.run}|{i}".encode()).hexdigest()[:13], 16) % len(own)] for i in range(1, len(own) + 1)]
        assert list(row)[2:] == [drawn.count(k) for k in range(kinds)]


def test_draws_are_md5():
    for runs, positions in ((range(1, 10), range(1, 10)), (range(95, 100), range(10, 40)), (range(1998, 2001), range(1234567, 1234590))):
        got = draws.md5_draws(42, np.array(runs), np.array(positions))
        want = [[int(hashlib.md5(f"42|{r}|{i}".encode()).hexdigest()[:13], 16) for i in positions] for r in runs]
        assert got.tolist() == want
    assert [list(map(int, (s[0], s[-1]))) for s in draws.spans(1, 105, 50)] == [[1, 9], [10, 59], [60, 99], [100, 105]]


def test_running_totals_of_a_group_with_half_of_the_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot", "hot", None, "b"]), rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, g string, x double")
    for down in (False, True):
        cut = ordered.even_buckets(df, ["g"], "x", down=down)
        order = [F.desc("x") if down else F.col("x")]
        got = {r.i: r for r in ordered.running_totals(cut, ["g"], order, {"r": F.lit(1), "s": F.col("i")}).collect()}
        for g in ("hot", None, "b"):
            own = sorted((r for r in rows if r[1] == g), key=lambda r: -r[2] if down else r[2])
            total = 0
            for k, (i, _, _) in enumerate(own, 1):
                total += i
                assert (got[i].r, got[i].s, got[i].r_all) == (k, total, len(own))
    empty = ordered.running_totals(ordered.even_buckets(df.limit(0), ["g"], "x"), ["g"], ["x"], {"r": F.lit(1)})
    assert empty.collect() == []


def test_pairs_take_the_last_of_repeated_ids(spark):
    shape = "id string, at long, label string, prediction string"
    a = spark.createDataFrame([("x", 1, "removed", "False"), ("x", 2, "removed", "True"), ("y", 1, "approved", "True"), (None, 1, "removed", "True")], shape)
    b = spark.createDataFrame([("x", 5, "removed", "True"), ("x", 9, "removed", "False"), (None, 1, "removed", "True")], shape)
    got = evaluate.paired(a, b, "at").collect()
    assert [(r.id, r.pred_a, r.pred_b) for r in got] == [("x", "True", "False")]


def test_oldest_activity_takes_posts_first(spark):
    rows = [("a", 5, "oldest_comment"), ("a", 9, "oldest_post"), ("b", 3, "oldest_comment"), ("b", 8, "comment_author_created_utc"),
            ("c", 7, None), ("c", 9, "elsewhere"), ("d", 0, "oldest_post"), ("[deleted]", 4, "oldest_post")]
    df = spark.createDataFrame(rows, "author string, account_created_utc long, source string")
    got = {r.author: (r.account_created_utc, r.source) for r in lookups.oldest_activity(df).collect()}
    assert got == {"a": (9, "oldest_post"), "b": (8, "comment_author_created_utc"), "c": (9, "elsewhere")}


def test_flair_and_edits(spark):
    rows = [(" ", "false", True), ("none", "1700000000.0", None), (None, "false", False), (" x ", None, None)]
    df = spark.createDataFrame(rows, "author_flair_text string, edited string, is_edited boolean").withColumns(
        {"parent_id": F.lit("t3_a"), "body": F.lit("b"), "parent_body": F.lit(""), "is_submitter": F.lit(None).cast("boolean")}
    )
    got = enrich.enrich_context(df).collect()
    assert [r.has_author_flair for r in got] == [False, True, False, True]
    assert [r.is_edited_bool for r in got] == [True, True, False, False]
    assert [r.author_flair_clean for r in got] == ["", "none", "none", "x"]


def test_spam_of_missing_authors_and_groups(spark):
    rows = [(i, None if i % 2 else "a", None, "buy now") for i in range(6)] + [(9, "a", None, "fine")]
    df = spark.createDataFrame(rows, "row_id long, author string, category string, body string")
    assert [r.row_id for r in dedup.remove_spam(df, ["category"]).collect()] == [9]


def test_author_features_rules_and_missing_values(spark):
    base = spark.createDataFrame([("a", "Sub", ""), ("b", "none", "t"), (None, None, "t")], "id string, subreddit string, post_title string")
    known = spark.createDataFrame([("a", 3, 1, 2.5, 2, 0.5, False, 2)], "id string, n_prior long, vel_24h long, avg_score double, "
                                  "unique_threads long, days_active double, is_first boolean, max_in_thread long")  # fmt: skip
    rules = spark.createDataFrame([("sub", "1. Be kind")], "subreddit string, rules_text string")
    rows = lookups.attach_rules(lookups.attach_author_features(base, known), rules)
    got = {r.id: r for r in rows.collect()}
    assert got["a"].author_features_found and got["a"].author_n_prior == 3 and got["a"].rules_text == "1. Be kind"
    for i in ("b", None):
        assert not got[i].author_features_found and got[i].author_is_first and got[i].author_avg_score == 0.0 and got[i].rules_text == ""
