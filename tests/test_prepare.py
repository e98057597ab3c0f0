"""First rows and row numbers in key order."""

import random

import pytest
from pyspark.sql import functions as F

from neartag.operators import learn, prepare
from neartag.plans.staging import Staging


def rows(kind):
    rng = random.Random(5)
    keys = {"long": [rng.randrange(40) for _ in range(300)], "string": [rng.choice(["a", "b", "zz", "ä", ""]) + str(rng.randrange(9)) for _ in range(300)],
            "double": [rng.random() for _ in range(300)]}[kind]
    keys = [None if rng.random() < 0.1 else k for k in keys]
    return [(k, i % 50) for i, k in enumerate(keys)]


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_first_rows_by_key(spark, kind):
    given = rows(kind)
    df = spark.createDataFrame(given, f"k {kind}, v long").repartition(5)
    ordered = sorted((r[0] for r in given), key=lambda k: (k is not None, k))
    for n in (10, 120, 299, 5000):
        got = [tuple(r) for r in prepare.take_first(df, n, "k").collect()]
        assert sorted(map(str, (r[0] for r in got))) == sorted(map(str, ordered[:n]))
        left = list(given)
        for r in got:
            left.remove(r)  # rows of the table, each at most as often as it is there
    assert prepare.take_first(df, 0, "k").count() == 300


def test_the_nth_key_in_few_steps(spark):
    keys = spark.range(1000).select(F.col("id").alias("k"))
    assert prepare.nth_key(keys, 700, few=10) == (699, 699)
    same = spark.range(100).select(F.lit(7).cast("long").alias("k"))
    assert prepare.nth_key(same, 60) == (7, 0)


def test_first_rows_neither_write_nor_shuffle_the_table(spark):
    df = spark.range(500).select("id", F.lit("text").alias("text"))
    plan = prepare.take_first(df, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "parquet" not in plan.lower()


def test_labels_are_numbered_without_one_window(spark):
    data = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i % 9 + 1))) for i in range(60)], "id long, tags string")
    got = {(r.label, r.label_id) for r in learn.label_matrix(data, staging=Staging(spark)).collect()}
    assert got == {(f"t{j}", j) for j in range(9)}  # the most frequent first
    plan = learn.label_matrix(data)._jdf.queryExecution().analyzed().toString()
    assert "total" not in [w for line in plan.splitlines() if "Window" in line for w in line.split()]
