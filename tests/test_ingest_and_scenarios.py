import io
import json
import random
import zipfile
from datetime import datetime, timedelta

from depot import grow, tables

from nestlake.operators.ingest import dissect, passwords_of
from nestlake.plans.compiler import nodes
from nestlake.plans.scenarios import Registry, Scenario, compatible, evaluate, results
from nestlake.plans.search import Store
from nestlake.runtime import cut
from nestlake.streaming.works import dissect_stream, scenario_stream, windowed_counts

SUBMITTED = "work_id string, org string, t timestamp, content binary, props string"


def nested_zip(depth, body=b"password: pw1\n"):
    for k in range(depth):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"level{k}.zip" if k else "note.txt", body)
        body = out.getvalue()
    return body


def test_dissect_levels_and_depth(spark):
    df = spark.createDataFrame([("w1", "o", datetime(2020, 1, 1), nested_zip(4), '{"name": "a.zip"}'), ("w2", "o", datetime(2020, 1, 1), b"", "{}"), ("w3", "o", datetime(2020, 1, 1), b"PK\x03\x04broken", "{}"), ("w4", "o", datetime(2020, 1, 1), None, "{}")], SUBMITTED)
    objects, rels = dissect(df)
    got = {r.id: r for r in objects.collect()}
    assert got["w1:0/0/0/0/0"].object_type == "Text" and got["w1:0/0/0/0/0"].recursion_level == 5 and got["w1:0"].is_entry and not got["w1:0/0"].is_entry
    assert got["w2:0"].object_type == "EMPTY" and got["w4:0"].object_type == "SKIPPED" and "error" in json.loads(got["w3:0"].result)
    assert len(got["w1:0"].hashes["sha512"]) == 128 and got["w2:0"].entropy == 0
    assert {r.child: r.parent for r in rels.collect()}["w1:0/0/0"] == "w1:0/0"
    shallow, _ = dissect(df.where("work_id = 'w1'"), 2)
    last = {r.recursion_level: json.loads(r.result) for r in shallow.collect()}
    assert set(last) == {1, 2} and last[2]["ok"]["symbols"] == ["TOODEEP"]
    s = Store(nodes(objects, rels))
    assert [r.object_id for r in s.matching('@has_ancestor(@has_name("a.zip")) && object_type == "Text"').collect()] == [got["w1:0/0/0/0/0"].object_id]
    assert passwords_of(objects).count() == 0
    assert dissect(df.where("false"))[0].count() == 0


def random_store(spark, n=60, seed=4):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    o, facts = [], []
    for i in range(n):
        t = start + timedelta(hours=rng.choice([0, 0, 5, 24]) + rng.randrange(200))
        facts.append((f"w{i}", t, rng.random() < 0.4, rng.random() < 0.5, i))
        o.append({"id": i, "org": "o", "work_id": f"w{i}", "is_entry": True, "object_id": str(i), "object_type": "A" if facts[-1][3] else "B", "object_subtype": None, "recursion_level": 1, "size": int(facts[-1][2]), "hashes": "{}", "t": t, "result": "{}", "entropy": None})
    schema = "id long, org string, work_id string, is_entry boolean, object_id string, object_type string, object_subtype string, recursion_level int, size long, hashes string, t timestamp, result string, entropy double"
    return Store(cut(nodes(spark.createDataFrame(o, schema), spark.createDataFrame([{"parent": None, "child": x["id"], "props": "{}"} for x in o], "parent long, child long, props string")))), facts


def brute(facts, relation, number, percent, hours, most):
    out = set()
    for w, t, _, local, i in facts:
        if not local:
            continue
        near = sorted((abs((u - t).total_seconds()), u > t, j, m) for v, u, m, _, j in facts if v != w and abs((u - t).total_seconds()) <= hours * 3600)[:most]
        n, total = sum(x[3] for x in near), len(near)
        level = int(number / 100 * total) if percent else number
        if {"more": n > level, "less": n <= max(level - 1, 0), "none": n == 0}[relation]:
            out.add(w)
    return out


def test_contexts_against_one_by_one(spark):
    store, facts = random_store(spark)
    cases = [(">2", ("more", 2, False)), ("<3", ("less", 3, False)), (">40%", ("more", 40, True)), ("<60%", ("less", 60, True)), ("NONE", ("none", 0, False)), ("<0", ("less", 0, False))]
    scenarios, expected = [], {}
    for k, (text, args) in enumerate(cases):
        for most in (None, 3):
            name = f"s{k}-{most}"
            limit = f"MAX_NEIGHBORS:{most};" if most else ""
            scenarios.append(Scenario(name, "act", "me", 'object_type == "A"', f"MATCHES:{text};TIME_WINDOW:12 hours;{limit} size == 1"))
            expected[name] = brute(facts, *args, 12, most)
    got: dict = {s.name: set() for s in scenarios}
    for r in evaluate(store, scenarios).collect():
        got[r.scenario].add(r.work_id)
    assert got == expected
    fired = evaluate(store, [Scenario("plain", "act", "me", "size == 1")])
    res = {r.work_id: r.actions for r in results(fired, store.nodes).collect()}
    assert len(res) == 60 and all(bool(a) == facts[int(w[1:])][2] for w, a in res.items())


def test_registry():
    r = Registry()
    r.add(Scenario("b", "x", "me", "@match_pattern(deadbeef)"))
    r.add(Scenario("a", "x", "me", "size > 1", "MATCHES:>1;TIME_WINDOW:1 day; @has_child(@match_pattern(*:00112233))"))
    assert [s.name for s in r.list()] == ["a", "b"] and [p.text for p in r.patterns()] == ["00112233", "deadbeef"]
    for bad in (Scenario("a", "x", "me", "true"), Scenario("", "x", "me", "true"), Scenario("c", "x", "me", "size >"), Scenario("c", "x", "me", "true", "size > 1"), Scenario("c", "x", "me", "true", compatible_with=">=2.0.0")):
        try:
            r.add(bad)
            raise AssertionError(bad)
        except ValueError:
            pass
    assert r.delete("a") and not r.delete("a") and compatible("^1.2") and not compatible("~1.2")


def test_streams(spark, tmp_path):
    forest = grow()
    o, r = tables(forest)
    schema = "id long, org string, work_id string, is_entry boolean, object_id string, object_type string, object_subtype string, recursion_level int, size long, hashes string, t timestamp, result string, entropy double"
    objects, rels = spark.createDataFrame(o, schema), spark.createDataFrame(r, "parent long, child long, props string")
    spark.createDataFrame([(f"delivery-{k}",) for k in range(5)], "work_id string").write.parquet(f"{tmp_path}/done")
    done = spark.readStream.schema("work_id string").parquet(f"{tmp_path}/done")
    q = scenario_stream(done, lambda: (objects, rels), lambda: [Scenario("z", "act", "me", 'is_entry && object_type == "PE"')], f"{tmp_path}/out", f"{tmp_path}/c1")
    q.awaitTermination(120)
    assert {x.work_id for x in spark.read.parquet(f"{tmp_path}/out").collect()} == {x.work for x in forest if x.parent is None and x.kind == "PE" and x.work in [f"delivery-{k}" for k in range(5)]} != set()
    spark.createDataFrame([("w1", "o", datetime(2020, 1, 1), nested_zip(2), "{}")], SUBMITTED).write.parquet(f"{tmp_path}/sub")
    q = dissect_stream(spark.readStream.schema(SUBMITTED).parquet(f"{tmp_path}/sub"), f"{tmp_path}/graph", f"{tmp_path}/c2")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/graph/objects").count() == 3
    spark.createDataFrame([(datetime(2024, 1, 1, h, m), "click", 1.0) for h in range(3) for m in (1, 2)], "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/ev")
    w = windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/ev"))
    q = w.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [x.n for x in spark.sql("SELECT n FROM windows ORDER BY start").collect()] == [2, 2, 2]


def test_what_dissection_can_be_told(spark):
    """Limits, signatures, pages, recursion of a submission, and members handed down."""
    from nestlake.processors import Limits

    rows = [("w1", "o", datetime(2020, 1, 1), nested_zip(2), '{"_global": {"case": 7}}', None, None), ("w2", "o", datetime(2020, 1, 1), nested_zip(2), "{}", None, 2),
            ("w3", "o", datetime(2020, 1, 1), b"https://h.example/a", "{}", "URL", None), ("w4", "o", datetime(2020, 1, 1), b"https://h.example/none", "not json", "URL", None)]
    df = spark.createDataFrame(rows, SUBMITTED + ", object_type string, max_recursion int")
    pages = spark.createDataFrame([("https://h.example/a", bytearray(b"<html><body><p>evil words</p></body></html>")), (None, None)], "url string, content binary")
    objects, rels = dissect(df, limits={"ZIP": Limits(children=0)}, pages=pages, signatures={"bad": ("6576696c20776f726473", "*")})
    assert objects.where("work_id = 'w1'").count() == 1  # no children are allowed
    objects, rels = dissect(df, pages=pages, patterns=[("6576696c", "*")], signatures={"bad": ("6576696c20776f726473", "*")})
    o = {}
    for r in objects.collect():
        o.setdefault(r.work_id, []).append(r)
    assert len(o["w1"]) == 3 and len(o["w2"]) == 2 and any("TOODEEP" in r.result for r in o["w2"])
    assert {r.props for r in rels.where("work_id = 'w1' AND parent IS NOT NULL").collect()} and all('"case": 7' in r.props for r in rels.where("work_id = 'w1' AND parent IS NOT NULL").collect())
    page = [r for r in o["w3"] if r.object_type == "HTML"]
    assert len(page) == 1 and "INFECTED" in page[0].result and '"bad"' in page[0].result and "Pattern." in page[0].result
    assert len([r for r in o["w4"] if r.object_type != "Domain"]) == 1 and "NOT_FETCHED" in o["w4"][0].result + o["w4"][-1].result


def test_registry_is_stored(spark, tmp_path):
    r = Registry()
    r.add(Scenario("b", "x", "me", "size > 1", None, "text"))
    r.add(Scenario("a", "y", "me", "true", "MATCHES:>1;TIME_WINDOW:1 day; true"))
    r.save(spark, f"{tmp_path}/s")
    assert Registry.load(spark, f"{tmp_path}/s").list() == r.list()
    r.delete("a")
    r.save(spark, f"{tmp_path}/s")
    assert [s.name for s in Registry.load(spark, f"{tmp_path}/s").list()] == ["b"]
    Registry().save(spark, f"{tmp_path}/s")
    assert Registry.load(spark, f"{tmp_path}/s").list() == []
