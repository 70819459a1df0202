import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import profile, ranking


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    # One group holds more than half of all rows; one has a null key, one only nulls, one a single value.
    keys = ["hot"] * 400 + [None] * 30 + [f"g{r.randrange(9)}" for _ in range(200)]
    out = [(k, r.choice([r.randrange(20), r.randrange(10**6)]), i, r.random() < 0.5) for i, k in enumerate(keys)]
    return out + [("nulls", None, 1000, True), ("nulls", None, 1001, False), ("one", 7, 1002, True)]


def test_ranks(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long, id long, flag boolean").repartition(3)
    got = {r.id: (r.a, r.b) for r in ranking.ranks(df, ["g"], ["v", "id"], {"a": F.col("flag"), "b": F.col("id") > 50}).collect()}
    order = sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2]))
    want, seen = {}, {}
    for g, _, i, flag in order:
        a, b = seen.get(g, (0, 0))
        a, b = a + flag, b + (i > 50)
        seen[g] = a, b
        want[i] = (a if flag else None, b if i > 50 else None)
    assert got == want
    assert ranking.ranks(df.limit(0), ["g"], ["v", "id"], {"a": F.col("flag")}).count() == 0


def test_numbered(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long, id long, flag boolean").repartition(5)
    got = {r.id: r.n for r in ranking.numbered(df.where("v is not null"), [F.desc("v"), "id"], "n").collect()}
    order = sorted((r for r in rows if r[1] is not None), key=lambda x: (-x[1], x[2]))
    assert got == {r[2]: k for k, r in enumerate(order, 1)}


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long, id long, flag boolean").repartition(4)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r[0]: r for r in ranking.exact_quantiles(df, ["g"], "v", fractions).collect()}
    groups = {}
    for g, v, *_ in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g].n == len(v) and np.allclose([got[g][f"q{i}"] for i in range(5)], np.quantile(v, fractions), rtol=1e-12)
    whole = ranking.exact_quantiles(df, [], "v", [0.5]).first()
    assert whole.q0 == np.median([r[1] for r in rows if r[1] is not None])
    assert ranking.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_profile_keeps_groups_without_values(spark, rows):
    df = spark.createDataFrame(rows, "g string, v long, id long, flag boolean")
    got = {r.g: r for r in profile.profile(df, ["g"], "v").collect()}
    assert (got["nulls"].n, got["nulls"].median, got["nulls"].mean, got["nulls"].sd) == (0, None, None, None)
    assert (got["one"].n, got["one"].median, got["one"].sd) == (1, 7.0, None) and got[None].n == 30
