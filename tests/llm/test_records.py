import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm.components import connected_components
from threadmill.llm.records import collapsed_records, same_records

SCHEMA = "sample_id long, body string"
LONG = "the quick brown fox jumps over the lazy dog"


def groups(df):
    return {r.id: r.first_id for r in df.collect()}


def test_formatting_and_field_order(spark):
    rows = [
        (5, LONG), (3, LONG.upper() + "!!"), (9, "  > " + LONG.replace(" ", "\r\n")), (4, LONG + " again"),
        (20, "Goal: paint the old shed\nBudget: two hundred coins"),
        (12, "**budget:** two hundred coins | GOAL: paint the old shed"),
        (14, "goal paint the old shed budget two hundred coins"),
        (30, None), (31, ""), (32, "too short"), (None, LONG), (33, "\n | ; : "),
    ]
    got = groups(same_records(spark.createDataFrame(rows, SCHEMA)))
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 20: 12, 12: 12, 14: 12}


def test_hot_key_over_many_partitions(spark):
    rows = [(i, LONG) for i in range(4000)] + [(i + 10_000, f"{LONG} number {i % 700}") for i in range(2100)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    got = groups(same_records(df))
    assert all(got[i] == 0 for i in range(4000))
    assert all(got[10_000 + i] == 10_000 + i % 700 for i in range(2100))
    copies = {r.first_id: r.copies for r in collapsed_records(df).collect()}
    assert copies[0] == 4000 and copies[10_000] == 3 and len(copies) == 701


def test_empty_repeated_rows_and_clashing_columns(spark):
    assert same_records(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, LONG, "x", 1), (7, LONG, "y", 2), (8, LONG.title(), "z", 3)]
    df = spark.createDataFrame(rows, "sample_id long, body string, key string, id long")
    assert sorted(tuple(r) for r in same_records(df).collect()) == [(7, 7), (7, 7), (8, 7)]


def test_very_long_text(spark):
    text = "word and more " * 60_000
    got = groups(same_records(spark.createDataFrame([(1, text), (2, text.upper())], SCHEMA)))
    assert got == {1: 1, 2: 1}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components_against_union_find(spark, links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame(links, "u long, v long")
    assert {r.node: r.root for r in connected_components(df).collect()} == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 2000)}


def test_whole_table_against_plain_python(spark, sf):
    rows = spark.read.parquet(f"{sf}/demo_sample.parquet").select("sample_id", "body").collect()
    flat = lambda t: "".join(re.findall(r"[^\W_]+", t.lower().replace("ß", "ss")))
    by_key = defaultdict(list)
    for i, t in rows:
        if t and len(flat(t)) >= 20:
            by_key[flat(t)].append(i)
    got = groups(same_records(spark.read.parquet(f"{sf}/demo_sample.parquet")))
    assert all(len({got[i] for i in ids}) == 1 for ids in by_key.values())


@pytest.fixture(scope="module", autouse=True)
def _quiet(spark):
    spark.sparkContext.setLogLevel("ERROR")
