import random

import numpy as np

from threadmill.llm.abuse import Reader, abuse_rates, best_threshold, fit, fold_token, predict, score_abuse, train_on_reviews


def corpus(n=500, seed=0):
    rng = random.Random(seed)
    nice = "the kettle on the shelf was painted by our nurse last winter and it works fine with some luck".split()
    bad = ["you are a stupid grumbit", "shut up you filthy grumbit", "only a zonk like you", "people like you are zonk trash"]
    texts, labels = [], []
    for i in range(n):
        body = rng.sample(nice, 12)
        y = int(i % 4 == 0)
        if y:
            body.insert(rng.randrange(12), rng.choice(bad))
        elif i % 4 == 1:
            body.insert(rng.randrange(12), '"' + rng.choice(bad) + '" is what someone wrote and I reported it')
        texts.append(" ".join(body))
        labels.append(y)
    return texts, labels


def test_spellings_fold():
    assert fold_token("uuuseless") == "useless" and fold_token("d1rty") == "dirty" and fold_token("p@rasite") == "parasite"
    assert fold_token("m***n") == fold_token("m*n") and fold_token("1234") == "<n>"
    reader = Reader()
    assert reader.tokens("a z o n k !") == ["azonk", "!"]
    assert reader.tokens("zo​nk zоnk")[0] == reader.tokens("zonk zonk")[1]


def test_held_out_accuracy_and_quotes():
    texts, labels = corpus()
    model = fit(texts, labels, steps=500)
    fresh, truth = corpus(300, seed=9)
    reader = Reader()
    score = predict(model, reader(fresh), reader)
    flagged = score >= model.thresholds[""]
    truth = np.array(truth, bool)
    assert (flagged & truth).sum() / truth.sum() > 0.9 and (flagged & truth).sum() / max(1, flagged.sum()) > 0.9


def test_same_model_twice_and_blocks():
    texts, labels = corpus(200)
    a, b = fit(texts, labels, steps=500), fit(texts, labels, steps=500)
    reader = Reader()
    encoded = reader(texts)
    assert np.allclose(predict(a, encoded, reader), predict(b, encoded, reader, block=7), atol=1e-5)


def test_texts_that_say_little_are_not_abuse():
    texts, labels = corpus()
    model = fit(texts, labels, steps=500)
    reader = Reader()
    assert (predict(model, reader(["[deleted]", "good bot", "", "ok", "same here"]), reader) < 0.4).all()


def test_threshold_and_degenerate_samples():
    assert 0.3 < best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) < 0.7
    assert best_threshold(np.array([0.9]), np.array([0])) == 0.5
    for texts, labels in (([], []), (["only one kind"], [1]), (["a", "b"], [0, 0])):
        model = fit(texts, labels, steps=500)
        reader = Reader()
        assert (predict(model, reader(["anything at all"]), reader) < 0.5).all()


def test_table(spark):
    texts, labels = corpus(120)
    rows = [(i, t, ["A", "a ", None][i % 3]) for i, t in enumerate(texts)] + [(900, None, "A"), (901, "", "b"), (0, texts[0], "A")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "sample_id long, body string, subreddit string, score double")
    votes = [(i, "abusive" if y else "clean", "r") for i, y in enumerate(labels)] + [(1, "unsure", "r"), (None, "abusive", "r"), (5000, "clean", "r")]
    reviews = spark.createDataFrame(votes, "sample_id long, verdict string, reviewer string")
    scored = score_abuse(df, train_on_reviews(df, reviews, steps=500)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 and not r.abusive for r in scored if r.id in (900, 901))
    right = sum(r.abusive == bool(labels[r.id]) for r in scored if r.id < 120)
    assert right > 0.9 * 121
    rates = {r.source: r for r in abuse_rates(score_abuse(df, train_on_reviews(df, reviews, steps=500))).collect()}
    assert set(rates) == {"a", "b", None} and rates["b"].n_abusive == 0
    blank = train_on_reviews(df, reviews.limit(0), steps=500)
    assert not any(r.abusive for r in score_abuse(df, blank).collect())
    assert score_abuse(df.limit(0), blank).collect() == []
