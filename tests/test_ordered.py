import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.operators.datasets import hashed_rank


def _rows(spark, dense, n=300, keys=3):
    rnd = random.Random(5)
    data = []
    for key in range(keys):
        count = n if key == 0 else 7  # one key holds most rows
        at = 0
        for _ in range(count):
            data.append((key, at, rnd.random()))
            at += 1 if dense else rnd.randint(1, 9)
    rnd.shuffle(data)
    return spark.createDataFrame(data, "k int, at int, v double").repartition(5)


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_neighbors_across_blocks_equal_plain_windows(spark):
    df = _rows(spark, dense=False)
    w = Window.partitionBy("k").orderBy("at")
    want = df.withColumns(
        {"p": F.lag("v").over(w), "n": F.lead("v").over(w), "f": F.first("v").over(w)}
    )
    for width in (1, 4, 16, 100000):
        got = ordered.with_neighbors(
            df, ["k"], "at", prev={"p": "v"}, next={"n": "v"}, first={"f": "v"}, width=width
        )
        assert _sorted(got) == _sorted(want)


def test_dense_neighbors_equal_plain_windows(spark):
    df = _rows(spark, dense=True)
    w = Window.partitionBy("k").orderBy("at")
    want = df.withColumns({"p": F.lag("v").over(w), "n": F.lead("v").over(w)})
    for width in (1, 7, 300):
        got = ordered.with_dense_neighbors(
            df, ["k"], "at", prev={"p": "v"}, next={"n": "v"}, width=width
        )
        assert _sorted(got) == _sorted(want)


def test_carry_forward_equals_plain_window(spark):
    df = _rows(spark, dense=False)
    value = F.when(F.col("v") > 0.8, F.col("v"))
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("c", F.last(value, ignorenulls=True).over(w))
    for width in (3, 50, 10**6):
        assert _sorted(
            ordered.carry_forward(df, ["k"], "at", value, "c", width=width)
        ) == _sorted(want)


def test_first_at_or_after(spark):
    rnd = random.Random(3)
    points = [(k, rnd.randint(0, 500), i) for i, k in enumerate([0] * 80 + [1] * 5)]
    probes = [(k, rnd.randint(0, 600)) for k in [0] * 60 + [1] * 10 + [2]]
    p = spark.createDataFrame(points, "k int, t int, s int")
    q = spark.createDataFrame(probes, "k int, t int")
    want = []
    for k, t in probes:
        later = sorted((pt, s) for pk, pt, s in points if pk == k and pt >= t)
        want.append((k, t, later[0][1] if later else None))
    for width in (10, 1000):
        got = ordered.first_at_or_after(q, p, "k", "t", "s", "n", width=width)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_exact_medians(spark):
    rnd = random.Random(9)
    groups = {
        "skewed": [1e9, 1e-9, 1.0] * 40 + [5.0] * 200,
        "even": [4.0, 1.0, 3.0, 2.0],
        "one": [7.0],
        "wide": [rnd.gauss(0, 10) ** 3 for _ in range(501)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["v_median"] for r in ordered.exact_medians(df, ["g"], ["v"]).collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    # brackets that are too large are narrowed until they are not, or cannot be
    for most in (0, 3):
        got = {r["g"]: r["v_median"] for r in ordered.exact_medians(df, ["g"], ["v"], most=most).collect()}
        assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    more = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "g string, v double")
    out = ordered.exact_medians(more, ["g"], ["v"], also=[F.count("*").alias("n")]).collect()
    assert {(r["g"], r["v_median"], r["n"]) for r in out} == {(None, 2.0, 2), ("x", None, 1)}


def test_a_far_outlier_leaves_the_bracket_small(spark):
    values = [float(i % 50_000) for i in range(60_000)] + [1e12, -1e12]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    got = ordered.exact_medians(df, ["g"], ["v"])
    assert got.first()["v_median"] == statistics.median(values)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4
    brackets = ordered._entries(["v"], "_b_")
    middle = [0.5 - 2 / ordered.SKETCH_PARTS, 0.5 + 2 / ordered.SKETCH_PARTS]
    cut = df.agg(F.percentile_approx("v", middle, ordered.SKETCH_PARTS).alias("c")).first()["c"]
    held = df.withColumn("_b_v", F.struct(F.lit(cut[0]).alias("lo"), F.lit(cut[1]).alias("hi")))
    inside = held.select(F.inline(brackets)).filter("value IS NOT NULL").count()
    assert inside <= 6 * len(values) / ordered.SKETCH_PARTS + 2


def test_hashed_rank(spark):
    df = spark.range(2000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = [(r["h"], r["rank"]) for r in hashed_rank(df, "h").collect()]
    assert [r for _, r in sorted(got)] == list(range(1, 2001))


def test_broadcast_only_below_the_limit(spark):
    from tidemark.functions.skew import by_size

    small = spark.range(10).withColumn("a", F.array_repeat(F.lit(1.0), 5))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(by_size(small, 10)) and not hinted(by_size(small, 9))
    assert hinted(by_size(small, 50, F.size("a"))) and not hinted(by_size(small, 49, F.size("a")))
