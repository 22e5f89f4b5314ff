import random
from datetime import datetime, timedelta

import pytest

from nestlake.plans import scenarios
from nestlake.plans.compiler import nodes, shared
from nestlake.plans.parser import parse_global
from nestlake.plans.scenario_queries import _W, QUERIES
from nestlake.plans.scenarios import entries, matched_pairs, pairs
from nestlake.plans.search import Store
from nestlake.plans.search_queries import store
from nestlake.runtime import cut

HEAD = "MATCHES:>0;TIME_WINDOW:3 days;"
#: One for each finding on disk: its nodes were repeated for every local work in whose window they lie.
TEXTS = {
    "selector_column": "${x}=LOCAL.filter(not is_entry).size; size in ${x} && size > 0",
    "selector_object_meta": "${x}=LOCAL.get_object_meta($_perf); @match_object_meta($_perf in ${x})",
    "selector_symbols": "${x}=LOCAL.get_symbols(); @has_symbol(in ${x})",
    "selector_names": "${x}=LOCAL.get_names(); @has_name(in ${x})",
    "selector_relation_meta": "${x}=LOCAL.get_relation_meta($index); @match_relation_meta($index in ${x})",
}
D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", TEXTS)
def test_no_node_is_repeated_for_a_pair(spark, monkeypatch, name):
    s = store(spark, D)
    e = entries(s)
    hit = e.join(s.search_works('@is_root() && object_type == "Email"'), "work_id", "left_semi")
    expected = {tuple(r) for r in s.global_matches(parse_global(HEAD + TEXTS[name]), pairs(hit, e, _W, None)).collect()}
    monkeypatch.setattr(Store, "global_matches", None)
    got = [tuple(r) for r in QUERIES[name](spark, D).collect()]
    assert len(got) == len(set(got)) and set(got) == expected != set()


SCHEMA = "id long, org string, work_id string, is_entry boolean, object_id string, object_type string, object_subtype string, recursion_level int, size long, hashes string, t timestamp, result string, entropy double"


def made(spark, rows):
    """Store of rows (work, t, is_entry, symbols)."""
    o = [{"id": i, "org": "o", "work_id": w, "is_entry": first, "object_id": str(i), "object_type": "A", "object_subtype": None, "recursion_level": 1, "size": i, "hashes": "{}", "t": t,
          "result": '{"ok": {"symbols": [%s]}}' % ", ".join(f'"{x}"' for x in sy), "entropy": None} for i, (w, t, first, sy) in enumerate(rows)]
    return Store(cut(nodes(spark.createDataFrame(o, SCHEMA), spark.createDataFrame([(None, x["id"], "{}") for x in o], "parent long, child long, props string"))))


@pytest.mark.parametrize(("bits", "many"), [(256, 0), (3, 0), (70, 0), (256, 10**9)])
def test_heavy_and_light_values(spark, monkeypatch, bits, many):
    """Values as bits in two words, as both kinds, and as none."""
    rng = random.Random(bits)
    start, rows, facts = datetime(2024, 1, 1), [], {}
    for w in range(50):
        t = start + timedelta(hours=rng.choice([0, 72, 71, 73]) + rng.randrange(100), microseconds=rng.choice([0, 1]))
        each = [[f"s{min(rng.randrange(100), rng.randrange(100))}" for _ in range(rng.randrange(4))] for _ in range(2)]
        facts[f"w{w}"] = (t, {x for y in each for x in y})
        rows += [(f"w{w}", t, k == 0, y) for k, y in enumerate(each)]
    monkeypatch.setattr(scenarios, "BITS", bits)
    monkeypatch.setattr(scenarios, "MANY", many)
    s = made(spark, rows)
    e = entries(s)
    q = parse_global(HEAD + TEXTS["selector_symbols"])
    got = [tuple(r) for r in matched_pairs(s, q, e.where("work_id < 'w3'"), e, _W).collect()]
    want = {(a, b) for a, (t, x) in facts.items() for b, (u, y) in facts.items() if a < "w3" and a != b and abs(u - t) <= timedelta(days=3) and x & y}
    assert len(got) == len(set(got)) and set(got) == want != set()


def test_what_asks_for_more_is_left_to_pairs(spark):
    x = "${x}=LOCAL.get_symbols(); ${y}=LOCAL.size; "
    ask = lambda text: shared(parse_global(HEAD + x + text).body, {"x", "y"})
    for text in ("@has_symbol(not in ${x})", "not @has_symbol(in ${x})", "@has_symbol(in ${x}) || is_entry", "@has_symbol(in ${x}) && size in ${y}", "@has_child(@has_symbol(in ${x}))", "is_entry"):
        assert ask(text) is None, text
    test, name, rest = ask("is_entry && @has_child(size > 1) && @has_symbol(in ${x})")
    assert name == "x" and len(rest) == 2
    t = datetime(2024, 1, 1)
    s = made(spark, [("a", t, True, ["p"]), ("b", t, True, ["p"]), ("c", t, True, ["q"])])
    e = entries(s)
    got = {tuple(r) for r in matched_pairs(s, parse_global(HEAD + "${x}=LOCAL.get_symbols(); @has_symbol(not in ${x})"), e, e, _W).collect()}
    assert got == {("a", "c"), ("b", "c"), ("c", "a"), ("c", "b")}


def test_entry_without_time_does_not_hide_its_work(spark):
    t = datetime(2024, 1, 1)
    s = made(spark, [("a", None, True, ["p"]), ("a", t, True, ["p"]), ("b", t, True, ["p"]), ("c", None, True, ["p"])])
    e = entries(s)
    got = {tuple(r) for r in matched_pairs(s, parse_global(HEAD + TEXTS["selector_symbols"]), e, e, _W).collect()}
    assert got == {("a", "b"), ("b", "a")}
