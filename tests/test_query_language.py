import itertools

import pytest
from depot import CASES, HEAD, NEIGHBOURS, grow, tables

from nestlake.operators import hierarchy
from nestlake.plans.compiler import Nodes, nodes
from nestlake.plans.parser import QueryError, check, complete, parse, parse_global
from nestlake.plans.patterns import identity, matches, parse_pattern
from nestlake.plans.search import Store
from nestlake.runtime import cut

OBJECTS = "id long, org string, work_id string, is_entry boolean, object_id string, object_type string, object_subtype string, recursion_level int, size long, hashes string, t timestamp, result string, entropy double"


FOREST = grow()


@pytest.fixture(scope="module")
def store(spark):
    o, r = tables(FOREST)
    n = cut(nodes(spark.createDataFrame(o + o[:3], OBJECTS), spark.createDataFrame(r, "parent long, child long, props string")))
    s = Store(n)
    s._closure = cut(s.closure())
    return s


def test_search_against_walk(store):
    """All queries in a few jobs: their results are unioned under their number."""
    out, idle = None, []
    for k, (q, _) in enumerate(CASES):
        df = store.matching(q).selectExpr(f"{k} AS k", "object_id")
        out = df if out is None else out.unionAll(df)
        if k % 25 == 24 or k == len(CASES) - 1:
            got = {}
            for x in out.collect():
                got.setdefault(x.k, []).append(x.object_id)
            for j in range(k - k % 25, k + 1):
                q, holds = CASES[j]
                want = sorted(x.name for x in FOREST if holds(x))
                assert sorted(got.get(j, [])) == want, q
                idle += [q] * (not want)
            out = None
    assert len(idle) == 2, idle  # the two that are meant to select nothing


def test_plan_of_a_scan(spark, tmp_path):
    """A row condition reaches the scan, only the columns in use are read, and no link is joined."""
    o, r = tables(FOREST)
    spark.createDataFrame(o + o[:3], OBJECTS).write.parquet(f"{tmp_path}/o")
    spark.createDataFrame(r, "parent long, child long, props string").write.parquet(f"{tmp_path}/r")
    s = Store(Nodes(spark.read.parquet(f"{tmp_path}/o"), spark.read.parquet(f"{tmp_path}/r")))
    plan = s.matching('object_type == "Zip" && size > 2000').select("id", "work_id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "EqualTo(object_type,Zip)" in plan and "GreaterThan(size,2000)" in plan and "result" not in plan
    assert "Join" in s.matching('@has_name("x") && size > 2000').select("id")._jdf.queryExecution().executedPlan().toString()
    got = {x.object_id for x in s.matching('size > 2000 && (object_type == "Zip" && @count_children() > 0)').collect()}
    assert got == {x.name for x in FOREST if x.kind == "Zip" and x.size > 2000 and x.kids}


def test_neighbours_against_walk(spark, store):
    works = sorted({x.work for x in FOREST})
    pairs = spark.createDataFrame([(a, b) for a in works[:4] for b in works], "local string, neighbour string")
    for q, holds in NEIGHBOURS:
        want = {(a, x.work) for a in works[:4] for x in FOREST if holds([y for y in FOREST if y.work == a], x)}
        assert {tuple(r) for r in store.global_matches(HEAD + q, pairs).select("local", "neighbour").collect()} == want, q


def test_tree_counts_against_walk(spark):
    """Random forests: counts of the plan against a walk in Python."""
    import random

    rng = random.Random(5)
    parent = {i: (rng.randrange(1, i) if i > 1 and rng.random() < 0.8 else None) for i in range(1, 60)}
    size = {i: rng.randrange(5) for i in parent}
    o = [{"id": i, "org": "o", "work_id": "w", "is_entry": p is None, "object_id": str(i), "object_type": "T", "object_subtype": None, "recursion_level": 1, "size": size[i], "hashes": "{}", "t": None, "result": "{}", "entropy": None} for i, p in parent.items()]
    s = Store(cut(nodes(spark.createDataFrame(o, OBJECTS), spark.createDataFrame([{"parent": p, "child": i, "props": "{}"} for i, p in parent.items()], "parent long, child long, props string"))))

    def up(i):
        while parent[i] is not None:
            i = parent[i]
            yield i

    big = {i for i in size if size[i] > 2}
    cases = {
        "@count_ancestors(size>2, 2) == 1": {i for i in parent if len(big & set(itertools.islice(up(i), 2))) == 1},
        "@count_descendants(size>2) >= 2": {i for i in parent if sum(i in up(j) for j in big) >= 2},
        "@count_siblings(size>2) == 1": {i for i, p in parent.items() if p is not None and len({j for j in big if parent[j] == p and j != i}) == 1},
        "not @has_child(size>2) and not @is_leaf()": {i for i in parent if i in parent.values() and not any(parent[j] == i for j in big)},
        "@count_conditions(size>2, is_entry, @has_parent(size>2)) == 2": {i for i, p in parent.items() if (i in big) + (p is None) + (p in big) == 2},
    }
    for q, expected in cases.items():
        assert {int(r.object_id) for r in s.matching(q).collect()} == expected, q


@pytest.mark.parametrize("text", ["size >", "size > \"a\"", "object_type > \"a\"", "@nope()", "size == ${x}", "${x}=1; ${x}=2; size==1", '${x}="a"; size==${x}', "(size==1", '@date_since("2001-02-30")',
                                  '@date_since("2001-02-03 10:61:00")', '"\\ud800"', "@match_pattern(a?)", "@match_pattern(aabb{5-2}ccdd)", "", "${x}=LOCAL.size; size in ${x}"])
def test_errors(text):
    assert isinstance(check(text), QueryError)


def test_settings():
    s = parse_global("MATCHES:<50%;TIME_WINDOW:1 day 2 hours;MAX_NEIGHBORS:7; true").settings
    assert (s.relation, s.number, s.percent, s.window_us, s.max_neighbors) == ("less", 50, True, 26 * 3600 * 10**6, 7)
    for bad in ("TIME_WINDOW:1 day; true", "MATCHES:>1; true", "MATCHES:>1;MATCHES:>1;TIME_WINDOW:1 day; true", "MATCHES:>100%;TIME_WINDOW:1 day; true"):
        assert check(bad, True)


def test_completion():
    assert "and" in complete("size > 1 ")
    assert "number" in complete("size > ")


def test_patterns():
    assert identity("deadbeef") == identity(parse("@match_pattern(deadbeef)").body.args[0].text)
    assert parse('@match_pattern("invoice")').body.args[0].text == b"invoice".hex()
    assert matches(b"xx\xde\xad\xbe\xefyy", "deadbeef") and not matches(b"\xde\xad", "dead", "1")
    assert matches(b"aab-ccdd", "6161*63636464")
    assert matches(b"\x01\x02\x03zz\x04\x05", "0102{1-5}0405") and not matches(b"\x01\x02\x04\x05", "0102{1-5}0405")
    assert matches(b"abXef", "6162!(63|64)6566") and not matches(b"abcef", "6162!(63|64)6566")
    assert matches(b"abcdEND", "454e44", "EOF-3") and not matches(b"ENDabc", "454e44", "EOF-3")
    for bad in ("aa", "a", "!(aa|bbcc)ddee", "aabb{9-1}ccdd"):
        with pytest.raises(ValueError):
            parse_pattern(bad)


def test_cycles_are_no_problem_for_closure(spark):
    f = hierarchy.build_forest(spark.createDataFrame([(1,), (2,), (3,), (3,)], "node long"), spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "parent long, child long"))
    assert {(r.node, r.kind) for r in f.circular.collect()} == {(1, "cycle"), (2, "cycle"), (3, "below_cycle")}
    assert f.reached.count() == 0


def test_terminal(store):
    from nestlake.__main__ import answer

    assert answer(store, ":check size > 1") == "ok" and "at" in answer(store, ":check size >") and answer(store, ":global size > 1") != "ok"
    zips = [x for x in FOREST if x.kind == "Zip"]
    assert answer(store, ':count object_type == "Zip"') == f"{len(zips)} objects in {len({x.work for x in zips})} works"
    assert set(answer(store, 'object_type == "Zip"', 1000).split("\n")) == {f"{x.work}\t{x.name}" for x in zips}
    assert "^" in answer(store, "size >") and "number" in answer(store, ":complete size > ") and answer(store, ":quit") is None and "Physical" in answer(store, ":explain size > 1")


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from nestlake.runtime import scratch, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    kept = cut(spark.range(3))
    before = len(list(folder.iterdir()))
    with scratch():
        assert cut(spark.range(5)).count() == 5 and len(list(folder.iterdir())) == before + 1
    assert len(list(folder.iterdir())) == before and kept.count() == 3
