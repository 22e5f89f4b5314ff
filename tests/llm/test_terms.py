import random
from collections import Counter, defaultdict

from nestlake.llm import terms


def brute(rows):
    occ, rec = Counter(), defaultdict(set)
    for record, _, term in {r for r in rows if r[0] is not None and r[2] is not None}:
        occ[term] += 1
        rec[term].add(record)
    return {t: (occ[t], len(rec[t])) for t in occ}


def test_against_brute_force(spark, monkeypatch):
    """A third of all rows is one term, a third one record; nulls, empty terms, repeated rows; extra columns."""
    monkeypatch.setattr(terms, "HEAVY_ONE_IN", 40)
    rng = random.Random(2)
    rows = [(rng.randrange(300), k, rng.choice(["hot"] * 30 + [f"t{rng.randrange(200)}" for _ in range(60)])) for k in range(3000)]
    rows += [(7, 5000 + k, f"u{k % 150}") for k in range(1500)] + [(1, 9000, None), (None, 9001, "x"), (2, 9002, ""), (3, None, "n")] + rows[:200]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows], "record long, item long, term string, slot string, hits int")
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df).collect()}
    assert got == brute(rows)


def test_bands_and_empty(spark):
    df = spark.createDataFrame([(r, r, "all") for r in range(20)] + [(1, 50, "one"), (1, 51, "three"), (2, 52, "three"), (3, 53, "three"), (4, 54, "three")], "record long, item long, term string")
    got = {r.term: r.band for r in terms.banded(terms.term_counts(df), 40).collect()}
    assert got == {"all": "common", "one": "rare", "three": None}
    assert terms.term_counts(df.where("false")).count() == 0
