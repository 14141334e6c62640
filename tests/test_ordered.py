import random

from pyspark.sql import functions as F

from quire.operators import ordered


def frame(spark, n=600, keys=3):
    random.seed(1)
    rows = [(i, random.choice(["hot"] * 5 + [f"k{k}" for k in range(keys)]), random.randint(0, 500), random.random() < 0.3) for i in range(n)] + [(9001, None, 5, True), (9002, "hot", None, True)]
    return rows, spark.createDataFrame(rows, "id int, key string, t int, hit boolean").withColumn("start", F.lit("clash"))


def test_last_before(spark):
    rows, df = frame(spark)
    rows = [r for r in rows if r[1] and r[2] is not None]
    want = {}
    for i, k, t, _ in rows:
        best = max(((u, j) for j, m, u, h in rows if m == k and u < t and h), default=None)
        want[i] = best[1] if best else None
    for bucket in (1, 37, 10_000):
        assert {r.id: r.v for r in ordered.last_before(df, "key", "t", F.col("hit"), "id", bucket, "v").collect()} == want
    assert ordered.last_before(df.limit(0), "key", "t", F.col("hit"), "id", 7, "v").count() == 0


def test_sessions(spark):
    rows, df = frame(spark, 120)
    for gap in (0, 3, 20):
        want = []
        for key in {r[1] for r in rows if r[1]}:
            times = sorted(r[2] for r in rows if r[1] == key and r[2] is not None)
            runs = [[times[0]]]
            for t in times[1:]:
                if t - runs[-1][-1] > gap:
                    runs.append([])
                runs[-1].append(t)
            want += [(key, r[0], r[-1], len(r)) for r in runs]
        for bucket in (1, 13, 1000):
            assert sorted(tuple(r) for r in ordered.sessions(df, "key", "t", gap, bucket).collect()) == sorted(want)


def test_numbered(spark):
    rows, df = frame(spark)
    got = ordered.numbered(df.repartition(7), "key", ["t", "id"], "k").collect()
    assert len(got) == len(rows)
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [r.id for r in sorted((r for r in got if r.key == key), key=lambda r: r.k)] == [r[0] for r in own]
