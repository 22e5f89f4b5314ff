import json

import pytest

from nestlake.operators import nested as N
from nestlake.operators.nested_queries import LNK


def brute(text):
    """Rows of one record by plain recursion."""
    try:
        o = json.loads(text)
    except (TypeError, ValueError):
        return set()

    def obj(x):
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return None
        return x if isinstance(x, dict) else None

    def items(x):
        if isinstance(x, str):
            try:
                x = json.loads(x)
            except ValueError:
                return []
        return x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def get(x, *path):
        for p in path:
            x = obj(x)
            x = x.get(p) if x is not None else None
        return x

    m, out = get(o, "ok", "object_metadata"), set()
    if obj(m) is None:
        return out
    for flat, x in (("link_info", get(m, "link_info")), ("volume_id", get(m, "link_info", "volume_id")), ("network_link", get(m, "link_info", "common_network_relative_link"))):
        if obj(x) is not None:
            out.add((flat, -1, -1, -1))
    for i, x in enumerate(items(get(m, "link_target_id_list", "id_list", "item_id_list"))):
        if obj(x) is not None:
            out.add(("shell_item", i, -1, -1))
    for i, x in enumerate(items(get(m, "extra_data"))):
        if obj(x) is None:
            continue
        out.add(("extra_block", i, -1, -1))
        for j, y in enumerate(items(get(x, "PropertyStoreDataBlock", "property_store", "serialized_property_storage"))):
            if obj(y) is None:
                continue
            out.add(("property_storage", i, j, -1))
            for k, z in enumerate(items(get(y, "serialized_property_value"))):
                if obj(z) is not None:
                    out.add(("property_value", i, j, k))
    return out


STORE = {"PropertyStoreDataBlock": {"property_store": json.dumps({"serialized_property_storage": [None, {"serialized_property_value": [{"IntegerName": {"id": 3}}, None, {}]}, {"serialized_property_value": {"StringName": {"name": "n"}}}]})}}
RECORDS = [
    None, "", "{", "[]", "3", '{"error": "x"}', '{"ok": {"object_metadata": null}}',
    json.dumps({"ok": {"object_metadata": {"link_info": {"volume_id": {}, "common_network_relative_link": "{}"}, "extra_data": [None, STORE, {}, {"TrackerDataBlock": {"machine_id": "m", "droid": ["a", "b"]}}]}}}),
    json.dumps({"ok": {"object_metadata": json.dumps({"link_info": json.dumps({"volume_id": {"volume_label": "é"}}), "extra_data": STORE, "link_target_id_list": {"id_list": {"item_id_list": [{}, None, "x", {"UriShellItem": {"uri": "u"}}, 5]}}})}}),
    json.dumps({"ok": {"object_metadata": {"link_info": [1], "extra_data": "no json", "other": "x" * 200_000}}}),
]


def test_positions_against_recursion(spark):
    df = spark.createDataFrame([(i, r, i) for i, r in enumerate(RECORDS)] + [(None, RECORDS[7], 0)], "rec long, j string, flat int")
    got: dict = {}
    for r in N.flatten(df, LNK, "rec", "j").collect():
        got.setdefault(r.rec, set()).add((r.flat, r.i, r.j, r.k))
    for i, r in enumerate(RECORDS):
        assert got.get(i, set()) == brute(r), r and r[:80]
    assert got[None] == brute(RECORDS[7])


def test_variants_and_typed_tables(spark):
    rows = N.flatten(spark.createDataFrame([(1, RECORDS[7]), (2, RECORDS[8])], "rec long, j string"), LNK, "rec", "j")
    kinds = {(r.rec, r.flat, r.i, r.j, r.k): r.variant for r in rows.collect()}
    assert kinds[(1, "extra_block", 2, -1, -1)] == "empty" and kinds[(1, "extra_block", 3, -1, -1)] == "TrackerDataBlock"
    assert kinds[(1, "property_value", 1, 1, 0)] == "IntegerName" and kinds[(2, "property_value", 0, 2, 0)] == "StringName"
    assert kinds[(2, "volume_id", -1, -1, -1)] == "labelled"
    t = N.subtype_table(rows, LNK, "rec", "extra_block", "TrackerDataBlock").collect()
    assert [(r.rec, r.i, r.machine_id, r.droid) for r in t] == [(1, 3, "m", ["a", "b"])]
    links = {(r.flat, r.i, r.j): (r.parent_flat, r.parent_i) for r in rows.where("rec = 1").collect()}
    assert links[("property_storage", 1, 1)] == ("extra_block", 1) and links[("volume_id", -1, -1)] == ("link_info", -1)


def test_empty(spark):
    assert N.flatten(spark.createDataFrame([], "rec long, j string"), LNK, "rec", "j").count() == 0


def test_flat_tables_hold_all_members(spark, tmp_path):
    from nestlake.operators.nested_queries import QUERIES

    volume = {"volume_id_size": 1, "volume_label": "L", "volume_label_unicode": "Łódź", "later": [1, {"a": 2}]}
    value = {"value_size": 3, "StringName": {"name": "n", "value": {"x": 1}}}
    blocks = [{"PropertyStoreDataBlock": {"property_store": {"serialized_property_storage": [{"serialized_property_value": [value]}]}}}]
    shell = {"id_list": {"item_id_list": [{"UriShellItem": {"uri": "u"}}]}}
    result = {"ok": {"object_metadata": {"link_info": {"volume_id": volume}, "link_target_id_list": shell, "extra_data": blocks}}}
    spark.sql("SELECT 1L AS lnk_id, current_timestamp() AS loaded_at").crossJoin(spark.createDataFrame([(json.dumps(result),)], "result string")).write.parquet(f"{tmp_path}/lnk_files.parquet")
    rows = {q: QUERIES[q](spark, str(tmp_path)).collect() for q in ("p4_volumes", "p4_property_value_stringname")}
    (v,) = rows["p4_volumes"]
    assert v.volume_label_unicode == "Łódź" and json.loads(v.members) == volume
    assert json.loads(rows["p4_property_value_stringname"][0].value) == {"x": 1}
    assert len(QUERIES) == 1 + 2 * len({e.target for e in LNK.edges}) + len(LNK.typed)  # p4_found, all states whole and by columns, all typed variants


def test_records_that_nest_in_themselves(spark):
    """Trees of any depth, one list in another, against a walk in Python."""
    import random

    from nestlake.operators import nested as N

    rng = random.Random(2)

    def tree(depth):
        x = {"name": rng.choice("abc")}
        if depth and rng.random() < 0.9:
            x["kids"] = [tree(depth - 1) if rng.random() < 0.8 else rng.choice([None, 3]) for _ in range(rng.randrange(3))]
        if depth and rng.random() < 0.5:
            x["twin"] = tree(depth - 1)
        return x

    records = [(i, {"top": tree(7)}) for i in range(12)]
    a = N.Automaton(("top",), (N.Edge("record", ("kids",), "node", "i"), N.Edge("record", ("twin",), "node"), N.Edge("node", ("kids",), "node", "i"), N.Edge("node", ("twin",), "node")),
                    {"node": (N.Rule("leaf", {"name": "text"}, exact=True),)}, {}, {})
    want = []

    def walk(i, x, place, flat):
        for k, y in [*enumerate(x.get("kids", [])), (-1, x.get("twin"))]:
            if isinstance(y, dict):
                want.append((i, tuple(place + [k]), tuple(place), flat, "leaf" if set(y) == {"name"} else "other"))
                walk(i, y, place + [k], "node")

    for i, r in records:
        walk(i, r["top"], [], "record")
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records] + [(None, "nonsense")], "id long, j string")
    got = [(r.id, tuple(r.place), tuple(r.parent_place), r.parent_flat, r.variant) for r in N.flatten_deep(df, a, "id", "j").collect()]
    assert sorted(got) == sorted(want) and max(len(p) for _, p, *_ in want) > 4
    with pytest.raises(ValueError):
        a.levels()
