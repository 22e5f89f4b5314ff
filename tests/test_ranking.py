import random

from pyspark.sql import functions as F

from nestlake.operators.ranking import running_sums
from nestlake.plans.scenarios import pairs


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(40)]), rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, at int, v int")
    got = {r.id: (r.n, r.s) for r in running_sums(df, [F.col("at"), F.desc("id")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    n = s = 0
    for i, _, v in sorted(rows, key=lambda r: (r[1], -r[0])):
        n, s = n + 1, s + (v or 0)
        assert got[i] == (n, s)
    assert running_sums(df.where("false"), [F.col("at")], {"n": F.lit(1)}).count() == 0


def test_nearest_neighbours_with_ties(spark):
    """Half of all entries at one moment: the nearest of each against sorting all pairs."""
    rng = random.Random(9)
    e = [(f"w{i}", i, 1000 + (0 if rng.random() < 0.5 else rng.randrange(-30, 30))) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(e, "work_id string, id long, s long").select("work_id", "id", F.timestamp_seconds("s").alias("t"))
    for k, w in ((1, 5), (4, 7), (200, 100), (3, 0)):
        want = set()
        for a, _, t in e[:40]:
            near = sorted((abs(u - t), u > t, i, b) for b, i, u in e if b != a and abs(u - t) <= w)
            want |= {(a, x[3]) for x in near[:k]}
        hit = df.where(F.col("work_id").isin([x[0] for x in e[:40]]))
        got = [tuple(r) for r in pairs(hit, df, w * 10**6, k).collect()]
        assert len(got) == len(want) and set(got) == want
