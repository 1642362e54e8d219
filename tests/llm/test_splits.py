import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloka.llm import splits

COLS = "row_id long, platform string, author string, url string, keys int, rep int, group_id string"


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    tops = defaultdict(list)
    for x in list(up):
        tops[find(x)].append(x)
    return {x: min(v) for v in tops.values() for x in v}


@pytest.mark.parametrize("small, rest", [(200_000, 0), (3, 0), (3, 100), (200_000, 20_000)])
def test_contraction_against_brute_force(spark, monkeypatch, small, rest):
    monkeypatch.setattr(splits, "SMALL", small)
    monkeypatch.setattr(splits, "REST", rest)
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)]
    got = {r["vertex"]: r["top"] for r in splits.contract(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute([p for p in pairs if p[0] != p[1]])
    assert got == want


def test_no_edges(spark):
    assert splits.contract(spark.createDataFrame([], "u long, v long")).count() == 0
    assert splits.contract(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


ROWS = [
    (1, "tiktok", "Ana.x", "https://www.vidka.example/@ANA.x/video/1?a=b#c", 0, 0, ""),
    (2, "tiktok", " @ana.X ", None, 0, 0, ""),
    (3, "x", "ana.x", None, 0, 0, ""),  # another platform
    (4, "tiktok", "https://m.vidka.example/@bob", "vidka.example/@ana.x/video/9", 0, 0, ""),  # renamed
    (5, "tiktok", "BOB", "", 0, 0, ""),
    (6, "instagram", "unknown", "https://fotogrid.example/p/Ab/", 0, 0, ""),
    (7, "instagram", "[deleted]", "http://WWW.fotogrid.example/p/Ab?x=1", 0, 0, ""),
    (8, "instagram", None, "http://fotogrid.example/p/ab", 0, 0, ""),  # codes keep their case
    (9, None, "-", "-", 0, 0, ""),
    (10, "gmaps", None, "https://petarasa.example/place/P1", 0, 0, ""),
    (11, "", None, "petarasa.example/place/P1/", 0, 0, ""),
    (12, "tiktok", "ana_x", None, 0, 0, ""),
    (12, "tiktok", "ana_x", None, 0, 0, ""),
    (None, "tiktok", "ana.x", None, 0, 0, ""),
]


def test_groups(spark):
    got = {r["row_id"]: (r["group_id"], r["size"]) for r in splits.groups(spark.createDataFrame(ROWS, COLS)).collect()}
    assert got == {1: (1, 4), 2: (1, 4), 4: (1, 4), 5: (1, 4), 3: (3, 1), 6: (6, 2), 7: (6, 2), 8: (8, 1), 9: (9, 1), 10: (10, 2), 11: (10, 2), 12: (12, 1)}
    assert splits.found(spark.createDataFrame([], COLS)).count() == 0


def test_hot_account_and_splits(spark, monkeypatch):
    import sparkloka.runtime as runtime

    monkeypatch.setattr(runtime, "ONE_TASK_ROWS", 100)
    rows = [(i, "tiktok", "hot" if i % 3 == 0 else f"u{i // 4}", None, 0, 0, "") for i in range(3000)]
    g = splits.groups(spark.createDataFrame(rows, COLS))
    out = splits.assign(g)
    assert out.count() == 3000
    assert out.groupBy("group_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    n = {r["split"]: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02
    assert out.filter("row_id = 0").first()["split"] == "train"
    assert splits.assign(g.limit(0)).count() == 0
