"""Problem 4 over lnk_files.result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.operators import nested as N
from nestlake.runtime import table

_BLOCK = {"block_size": "bigint", "block_signature": "bigint"}
_BLOCKS = {
    "ConsoleDataBlock": {"fill_attributes": "array<string>", "font_size": "bigint"},
    "ConsoleFEDataBlock": {}, "DarwinDataBlock": {}, "EnvironmentVariableDataBlock": {}, "KnownFolderDataBlock": {},
    "PropertyStoreDataBlock": {"property_store": "variant"}, "ShimDataBlock": {}, "SpecialFolderDataBlock": {},
    "TrackerDataBlock": {"machine_id": "string", "droid": "array<string>"},
    "Unsupported": {"data": "array<bigint>"},
}
_ITEMS = {
    "RootFolderItem": {"class_type": "string", "sort_index": "bigint", "shell_folder_id": "string"},
    "VolumeShellItem": {"path": "string"},
    "FileEntryShellItem": {"primary_name": "string", "file_size": "bigint"},
    "UriShellItem": {"uri": "string"},
}

LNK = N.Automaton(
    start=("ok", "object_metadata"),
    edges=(
        N.Edge("record", ("link_info",), "link_info"),
        N.Edge("record", ("link_target_id_list", "id_list", "item_id_list"), "shell_item", "i"),
        N.Edge("record", ("extra_data",), "extra_block", "i"),
        N.Edge("link_info", ("volume_id",), "volume_id"),
        N.Edge("link_info", ("common_network_relative_link",), "network_link"),
        N.Edge("extra_block", ("PropertyStoreDataBlock", "property_store", "serialized_property_storage"), "property_storage", "j"),
        N.Edge("property_storage", ("serialized_property_value",), "property_value", "k"),
    ),
    rules={
        "link_info": (N.Rule("local_and_network", {"volume_id": "object", "common_network_relative_link": "object"}),
                      N.Rule("local", {"volume_id": "object"}), N.Rule("network", {"common_network_relative_link": "object"})),
        "volume_id": (N.Rule("empty", {}, exact=True), N.Rule("labelled_codepage", {"volume_label": "text", "volume_label_codepage": "any"}),
                      N.Rule("labelled", {"volume_label": "text"})),
        "network_link": (N.Rule("empty", {}, exact=True), N.Rule("device", {"net_name": "text", "device_name": "text"}), N.Rule("share", {"net_name": "text"})),
        "shell_item": (N.Rule("empty", {}, exact=True), *(N.Rule(x, {x: "object"}) for x in _ITEMS)),
        "extra_block": (N.Rule("empty", {}, exact=True), *(N.Rule(x, {x: "object"}) for x in _BLOCKS)),
        "property_storage": (N.Rule("empty", {}, exact=True), N.Rule("values", {"serialized_property_value": "array"})),
        "property_value": (N.Rule("empty", {}, exact=True), N.Rule("StringName", {"StringName": "object"}), N.Rule("IntegerName", {"IntegerName": "object"})),
    },
    common={
        "link_info": {"link_info_size": "bigint", "link_info_header_size": "bigint", "link_info_flags": "array<string>", "local_base_path": "string"},
        "volume_id": {"volume_id_size": "bigint", "drive_type": "string", "drive_serial_number": "bigint", "volume_label_offset": "bigint",
                      "volume_label_unicode": "string"},
        "network_link": {"common_network_relative_link_size": "bigint", "net_name": "string", "network_provider_type": "string"},
        "shell_item": {}, "extra_block": _BLOCK,
        "property_storage": {"storage_size": "bigint", "version": "bigint", "format_id": "string"},
        "property_value": {"value_size": "bigint", "reserved": "bigint"},
    },
    typed={("extra_block", n): ((n,), _BLOCK | m) for n, m in _BLOCKS.items()}
    | {("shell_item", n): ((n,), m) for n, m in _ITEMS.items()}
    | {("volume_id", "labelled_codepage"): ((), {"volume_label": "string", "volume_label_codepage": "bigint"}), ("volume_id", "labelled"): ((), {"volume_label": "string"}),
       ("network_link", "device"): ((), {"device_name": "string"}),
       ("property_value", "StringName"): (("StringName",), {"name": "string", "value": "variant"}), ("property_value", "IntegerName"): (("IntegerName",), {"id": "bigint", "value": "variant"})},
)


def _records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: a record sent again counts once (the last arrival)."""
    return table(spark, d, "lnk_files").groupBy("lnk_id").agg(F.max_by("result", "loaded_at").alias("result"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The repeated records' rows merge in the final distinct, which shuffles positions instead of whole texts."""
    rows = N.flatten(table(spark, d, "lnk_files"), LNK, "lnk_id", "result")
    return rows.select("lnk_id", "flat", "i", "j", "k").distinct()


def _plain(t: DataFrame) -> DataFrame:
    """Members of any type as JSON text and lists as text with commas, which every sink can hold."""
    return t.select(*[F.to_json(c).alias(c) if kind == "variant" else F.array_join(c, ",").alias(c) if kind.startswith("array") else c for c, kind in t.dtypes])


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return N.flatten(_records(spark, d), LNK, "lnk_id", "result")


def _supertype(flat: str, *without: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _plain(N.supertype_table(_rows(spark, d), LNK, "lnk_id", flat).drop(*without))


def _subtype(flat: str, variant: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _plain(N.subtype_table(_rows(spark, d), LNK, "lnk_id", flat, variant))


p4_trackers = _subtype("extra_block", "TrackerDataBlock")


#: One query for each flat table: all variants of a state, with the object whole and with its columns only (whose values
#: SQL can state), then the typed members of each variant.
_SUPERTYPES = {"p4_links": "link_info", "p4_volumes": "volume_id", "p4_networks": "network_link", "p4_shell_items": "shell_item",
               "p4_extra_blocks": "extra_block", "p4_property_storages": "property_storage", "p4_property_values": "property_value"}
QUERIES = {"p4_found": p4_found, "p4_trackers": p4_trackers} | {q: _supertype(flat) for q, flat in _SUPERTYPES.items()} | {
    f"{q}_columns": _supertype(flat, "members") for q, flat in _SUPERTYPES.items()} | {
    f"p4_{flat}_{variant}".lower(): _subtype(flat, variant) for flat, variant in LNK.typed if variant != "TrackerDataBlock"}


def _o(j: str) -> str:
    """DuckDB: the object in j, read from text if need be."""
    return (f"(CASE json_type({j}) WHEN 'OBJECT' THEN {j} WHEN 'VARCHAR' THEN CASE WHEN json_valid({j} ->> '$') THEN "
            f"CASE WHEN json_type(CAST({j} ->> '$' AS JSON)) = 'OBJECT' THEN CAST({j} ->> '$' AS JSON) END END END)")


def _l(j: str) -> str:
    return f"(CASE json_type({j}) WHEN 'ARRAY' THEN CAST({j} AS JSON[]) ELSE CASE WHEN {_o(j)} IS NOT NULL THEN [{_o(j)}] END END)"


_BASE = f"""
WITH r AS MATERIALIZED (SELECT DISTINCT lnk_id, CAST(result AS JSON) AS r FROM lnk_files WHERE json_valid(result)),
m AS MATERIALIZED (SELECT lnk_id, {_o("r->'$.ok.object_metadata'")} AS m FROM r),
li AS MATERIALIZED (SELECT lnk_id, {_o("m->'$.link_info'")} AS o FROM m),
il AS (SELECT lnk_id, {_o("m->'$.link_target_id_list'")} AS a FROM m),
il2 AS (SELECT lnk_id, {_o("a->'$.id_list'")} AS a FROM il),
il3 AS (SELECT lnk_id, {_l("a->'$.item_id_list'")} AS l FROM il2),
si AS (SELECT lnk_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS i FROM il3),
xl AS (SELECT lnk_id, {_l("m->'$.extra_data'")} AS l FROM m),
xb AS MATERIALIZED (SELECT lnk_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM xl),
xo AS MATERIALIZED (SELECT lnk_id, i, {_o("x")} AS o FROM xb),
ps AS (SELECT lnk_id, i, {_o("o->'$.PropertyStoreDataBlock'")} AS o FROM xo),
pt AS (SELECT lnk_id, i, {_o("o->'$.property_store'")} AS o FROM ps),
pl AS (SELECT lnk_id, i, {_l("o->'$.serialized_property_storage'")} AS l FROM pt),
pg AS (SELECT lnk_id, i, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS j FROM pl),
po AS MATERIALIZED (SELECT lnk_id, i, j, {_o("x")} AS o FROM pg),
vl AS (SELECT lnk_id, i, j, {_l("o->'$.serialized_property_value'")} AS l FROM po),
vx AS (SELECT lnk_id, i, j, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS k FROM vl)
"""

SQL = {
    "p4_found": _BASE + f"""
SELECT lnk_id, flat, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k FROM (
SELECT lnk_id, 'link_info' AS flat, -1 AS i, -1 AS j, -1 AS k FROM li WHERE o IS NOT NULL
UNION SELECT lnk_id, 'volume_id', -1, -1, -1 FROM li WHERE {_o("o->'$.volume_id'")} IS NOT NULL
UNION SELECT lnk_id, 'network_link', -1, -1, -1 FROM li WHERE {_o("o->'$.common_network_relative_link'")} IS NOT NULL
UNION SELECT lnk_id, 'shell_item', i, -1, -1 FROM si WHERE {_o("o")} IS NOT NULL
UNION SELECT lnk_id, 'extra_block', i, -1, -1 FROM xo WHERE o IS NOT NULL
UNION SELECT lnk_id, 'property_storage', i, j, -1 FROM po WHERE o IS NOT NULL
UNION SELECT lnk_id, 'property_value', i, j, k FROM vx WHERE {_o("x")} IS NOT NULL)""",
}

#: Rows of each flat table: positions, parent, object.
_OF = {
    "link_info": "SELECT lnk_id, -1 AS i, -1 AS j, -1 AS k, 'record' AS pf, -1 AS pi, -1 AS pj, -1 AS pk, o FROM li",
    "volume_id": f"""SELECT lnk_id, -1 AS i, -1 AS j, -1 AS k, 'link_info' AS pf, -1 AS pi, -1 AS pj, -1 AS pk, {_o("o->'$.volume_id'")} AS o FROM li""",
    "network_link": f"""SELECT lnk_id, -1 AS i, -1 AS j, -1 AS k, 'link_info' AS pf, -1 AS pi, -1 AS pj, -1 AS pk, {_o("o->'$.common_network_relative_link'")} AS o FROM li""",
    "shell_item": f"SELECT lnk_id, i, -1 AS j, -1 AS k, 'record' AS pf, -1 AS pi, -1 AS pj, -1 AS pk, {_o('o')} AS o FROM si",
    "extra_block": "SELECT lnk_id, i, -1 AS j, -1 AS k, 'record' AS pf, -1 AS pi, -1 AS pj, -1 AS pk, o FROM xo",
    "property_storage": "SELECT lnk_id, i, j, -1 AS k, 'extra_block' AS pf, i AS pi, -1 AS pj, -1 AS pk, o FROM po",
    "property_value": f"SELECT lnk_id, i, j, k, 'property_storage' AS pf, i AS pi, j AS pj, -1 AS pk, {_o('x')} AS o FROM vx",
}
_KIND = {"object": lambda x: _o(x) + " IS NOT NULL", "array": lambda x: f"json_type({x}) = 'ARRAY'", "any": lambda x: f"coalesce(json_type({x}), 'NULL') <> 'NULL'",
         "text": lambda x: f"coalesce(json_type({x}), 'NULL') NOT IN ('NULL', 'OBJECT', 'ARRAY')"}
_SQL_TYPES = {"bigint": lambda x: f"TRY_CAST({x[0]}->>'{x[1]}' AS BIGINT)", "string": lambda x: f"{x[0]}->>'{x[1]}'",
              "array<string>": lambda x: f"array_to_string(CAST({x[0]}->'{x[1]}' AS VARCHAR[]), ',')", "array<bigint>": lambda x: f"array_to_string(CAST({x[0]}->'{x[1]}' AS VARCHAR[]), ',')"}


def _variant(flat: str) -> str:
    out = "CASE"
    for rule in LNK.rules[flat]:
        tests = [_KIND[kind](f"o->'$.{m}'") for m, kind in rule.has.items()] + ([f"len(json_keys(o)) = {len(rule.has)}"] if rule.exact else [])
        out += f" WHEN {' AND '.join(tests)} THEN '{rule.variant}'"
    return out + " ELSE 'other' END"


def _columns(node: str, members: dict[str, str]) -> str:
    return "".join(f", {_SQL_TYPES[t]((node, '$.' + m))} AS {m}" for m, t in members.items())


def _inner(flat: str) -> str:
    """The object that holds the common members: the wrapped one, if there is any."""
    wraps = [p[0] for (f, _), (p, _) in LNK.typed.items() if f == flat and p]
    return "coalesce(" + ", ".join([_o(f"o->'$.{w}'") for w in wraps] + ["o"]) + ")" if wraps else "o"


def _table(flat: str, more: str, where: str = "true") -> str:
    at = "".join(f"CAST({x} AS INTEGER) AS {x}, " for x in "ijk")
    return _BASE + f", t AS ({_OF[flat]}), v AS (SELECT *, {_variant(flat)} AS variant, {_inner(flat)} AS n FROM t WHERE o IS NOT NULL) SELECT DISTINCT lnk_id, {at[:-2]}{more} FROM v WHERE {where}"


SQL |= {f"{q}_columns": _table(flat, ", pf AS parent_flat, CAST(pi AS INTEGER) AS parent_i, CAST(pj AS INTEGER) AS parent_j, CAST(pk AS INTEGER) AS parent_k, variant" + _columns("n", LNK.common[flat]))
        for q, flat in _SUPERTYPES.items()}
SQL |= {("p4_trackers" if variant == "TrackerDataBlock" else f"p4_{flat}_{variant}".lower()): _table(flat, _columns(_o(f"o->'$.{path[0]}'") if path else "o", members), f"variant = '{variant}'")
        for (flat, variant), (path, members) in LNK.typed.items() if "variant" not in members.values()}
