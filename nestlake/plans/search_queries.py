"""Queries for every operator of the object query language over objects and rels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.plans.compiler import Nodes, names, symbols
from nestlake.plans.search import Store
from nestlake.runtime import table

def store(spark: SparkSession, d: str) -> Store:
    """The stored tables as they are now; nothing is read before a query is planned."""
    return Store(Nodes(table(spark, d, "objects"), table(spark, d, "rels").select("parent", "child", "props")))


BASE = """
WITH RECURSIVE o1 AS (SELECT DISTINCT * FROM objects), r1 AS (SELECT child, max(parent) AS parent, coalesce(max_by(props, parent), max(props)) AS props FROM rels GROUP BY child),
n AS (SELECT o1.*, r1.parent, CAST(props AS JSON) AS p, CAST(result AS JSON) AS j, CAST(result AS JSON)->'$.ok.object_metadata' AS m,
  coalesce(CAST(CAST(result AS JSON)->'$.ok.symbols' AS VARCHAR[]), []) AS sy, CAST(result AS JSON)->>'$.error' AS er,
  list_filter(list_concat([CAST(props AS JSON)->>'$.name'], coalesce(CAST(CAST(props AS JSON)->'$.names' AS VARCHAR[]), [])), lambda x: x IS NOT NULL) AS nm,
  CAST(hashes AS JSON)->>'$.md5' AS md5
  FROM o1 LEFT JOIN r1 ON r1.child = o1.id),
w AS (SELECT n.id, n.work_id, [n.id] AS ids FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
      UNION ALL SELECT n.id, n.work_id, list_append(w.ids, n.id) FROM w JOIN n ON n.parent = w.id),
cl AS (SELECT a.id AS anc, x.id AS des, x.depth FROM (SELECT id, work_id, ids[i] AS up, len(ids) - i AS depth FROM (SELECT *, unnest(range(1, len(ids))) AS i FROM w)) x JOIN n a ON a.id = x.up AND a.work_id = x.work_id)
"""


def _kids(cond: str) -> str:
    return f"(SELECT count(*) FROM n c WHERE c.parent = n.id AND c.work_id = n.work_id AND {cond})"


def _sibs(cond: str) -> str:
    return f"(SELECT count(*) FROM n c WHERE c.parent = n.parent AND c.id <> n.id AND c.work_id = n.work_id AND {cond})"


def _desc(cond: str, depth: int = 1000) -> str:
    return f"(SELECT count(*) FROM cl JOIN n c ON c.id = cl.des WHERE cl.anc = n.id AND cl.depth <= {depth} AND {cond})"


def _anc(cond: str, depth: int = 1000) -> str:
    return f"(SELECT count(*) FROM cl JOIN n c ON c.id = cl.anc WHERE cl.des = n.id AND cl.depth <= {depth} AND {cond})"


_PERF = "CAST(m->>'$._perf' AS DOUBLE)"
_VER = "(m->>'$._backend_version')"
#: name -> (query, SQL condition on n)
CASES: dict[str, tuple[str, str]] = {
    "scan_type": ('object_type == "Zip"', "object_type = 'Zip'"),
    "bool_ident": ("is_entry != true", "is_entry <> true"),
    "str_eq_ne": ('object_subtype != "PNG" && org <> "iskston"', "object_subtype <> 'PNG' AND org <> 'iskston'"),
    "str_ident_ident": ("object_type != object_subtype", "object_type <> object_subtype"),
    "num_compare": ("size >= 50000 && entropy < 5.5", "size >= 50000 AND entropy < 5.5"),
    "num_ident_ident": ("size < recursion_level", "size < recursion_level"),
    "in_list": ('object_type in ("Zip", "7z", "Rar")', "object_type IN ('Zip', '7z', 'Rar')"),
    "not_in_list": ("recursion_level not in (1, 2, 3)", "recursion_level NOT IN (1, 2, 3)"),
    "and_or_not": ('object_type == "PDF" or object_type == "Email" and not size > 3000', "object_type = 'PDF' OR object_type = 'Email' AND NOT size > 3000"),
    "bool_literal": ("is_entry && true", "is_entry"),
    "variables": ('${t}="Zip"; ${n}=20000; object_type == ${t} && size > ${n}', "object_type = 'Zip' AND size > 20000"),
    "get_hash": ('@get_hash("md5") == "b590f1546152d0b5e03cbe8b5320b95c" || @get_hash("none") == "x"', "md5 = 'b590f1546152d0b5e03cbe8b5320b95c'"),
    "has_symbol_eq": ('@has_symbol("HAS_MACROS")', "list_contains(sy, 'HAS_MACROS')"),
    "has_symbol_regex": ('@has_symbol(regex("^(IN|CO)"))', "len(list_filter(sy, lambda s: regexp_matches(s, '^(IN|CO)'))) > 0"),
    "has_symbol_iregex": ('@has_symbol(iregex("macro"))', "len(list_filter(sy, lambda s: regexp_matches(s, '(?i)macro'))) > 0"),
    "has_symbol_in": ('@has_symbol(in("OCR", starts_with("TOO")))', "len(list_filter(sy, lambda s: s = 'OCR' OR starts_with(s, 'TOO'))) > 0"),
    "has_name_eq": ('@has_name("docs/cour.txt")', "list_contains(nm, 'docs/cour.txt')"),
    "has_name_regex": (r'@has_name(regex(r"\.(exe|dll)$"))', r"len(list_filter(nm, lambda s: regexp_matches(s, '\.(exe|dll)$'))) > 0"),
    "has_name_iregex": ('@has_name(iregex("COUR"))', "len(list_filter(nm, lambda s: regexp_matches(s, '(?i)COUR'))) > 0"),
    "has_name_starts_with": ('@has_name(starts_with("src/"))', "len(list_filter(nm, lambda s: starts_with(s, 'src/'))) > 0"),
    "has_error": ("@has_error()", "er IS NOT NULL"),
    "has_error_text": ('@has_error(iregex("HEADER")) || @has_error("method is not supported")', "regexp_matches(er, '(?i)HEADER') OR er = 'method is not supported'"),
    "date_since": ('@date_since("2024-06-01 12:00:00")', "t >= TIMESTAMP '2024-06-01 12:00:00'"),
    "date_range_day": ('@date_range("2024-03-01", "2024-03-31")', "t >= TIMESTAMP '2024-03-01' AND t < TIMESTAMP '2024-04-01'"),
    "date_range_second": ('@date_range("2024-03-01 10:00:00", "2024-04-02 11:30:00")', "t >= TIMESTAMP '2024-03-01 10:00:00' AND t < TIMESTAMP '2024-04-02 11:30:01'"),
    "has_object_meta": ("@has_object_meta($_perf)", "(m->'$._perf') IS NOT NULL"),
    "match_meta_eq": ('@match_object_meta($_backend_version == "1.6.0")', f"{_VER} = '1.6.0'"),
    "match_meta_ne": ('@match_object_meta($_backend_version != "1.6.0")', f"coalesce({_VER}, '') <> '1.6.0'"),
    "match_meta_cmp": ("@match_object_meta($_perf >= 7.5)", f"{_PERF} >= 7.5"),
    "match_meta_regex": (r'@match_object_meta($_backend_version regex("^1\\.[0-4]\\."))', rf"regexp_matches({_VER}, '^1\.[0-4]\.')"),
    "match_meta_starts_with": ('@match_object_meta($_backend_version starts_with("1.7"))', f"starts_with({_VER}, '1.7')"),
    "match_meta_in": ('@match_object_meta($_backend_version in ("1.6.0", starts_with("1.2")))', f"{_VER} = '1.6.0' OR starts_with({_VER}, '1.2')"),
    "match_meta_len": ("@match_object_meta($_backend_version.len() == 5)", f"length({_VER}) = 5"),
    "match_meta_path_path": ("@match_object_meta($_perf >= $_perf) && not @match_object_meta($_perf == $_backend_version)", f"{_PERF} >= {_PERF}"),
    "has_relation_meta": ("@has_relation_meta($names)", "len(CAST((p->'$.names') AS JSON[])) > 0"),
    "match_relation_meta": ("@match_relation_meta($index > 10)", "CAST(p->>'$.index' AS INTEGER) > 10"),
    "match_relation_meta_ne": ("@match_relation_meta($index != 3)", "coalesce(CAST(p->>'$.index' AS INTEGER), -1) <> 3"),
    "match_relation_meta_array": (r'@match_relation_meta($names[0] regex("e"))', "regexp_matches((p->>'$.names[0]'), 'e')"),
    "has_child": ('@has_child(object_type == "Zip")', _kids("c.object_type = 'Zip'") + " > 0"),
    "count_children": ("@count_children(size > 10000) >= 3", _kids("c.size > 10000") + " >= 3"),
    "count_children_all": ("@count_children() == 2", _kids("true") + " = 2"),
    "has_parent": ('@has_parent(object_type == "Email")', "EXISTS (SELECT 1 FROM n c WHERE c.id = n.parent AND c.work_id = n.work_id AND c.object_type = 'Email')"),
    "has_root": ("@has_root(size > 1000000)", "EXISTS (SELECT 1 FROM n c WHERE c.is_entry AND c.work_id = n.work_id AND c.size > 1000000)"),
    "has_sibling": ('@has_sibling(object_type == "7z")', _sibs("c.object_type = '7z'") + " > 0"),
    "count_siblings": ("@count_siblings(size > 5000) > 4", _sibs("c.size > 5000") + " > 4"),
    "has_descendant": ('@has_descendant(object_type == "Rar")', _desc("c.object_type = 'Rar'") + " > 0"),
    "has_descendant_depth": ('@has_descendant(object_type == "Text" && size > 20000, 2)', _desc("c.object_type = 'Text' AND c.size > 20000", 2) + " > 0"),
    "has_ancestor": ("@has_ancestor(entropy > 7)", _anc("c.entropy > 7") + " > 0"),
    "count_descendants": ("@count_descendants() > 30", _desc("true") + " > 30"),
    "count_ancestors": ('@count_ancestors(object_type == "Zip", 3) >= 2', _anc("c.object_type = 'Zip'", 3) + " >= 2"),
    "is_root": ("@is_root()", "is_entry"),
    "is_leaf": ("@is_leaf()", _kids("true") + " = 0"),
    "count_conditions": ('@count_conditions(size > 30000, entropy > 6, @has_symbol("OCR"), is_entry) >= 2',
                         "(CASE WHEN size > 30000 THEN 1 ELSE 0 END + CASE WHEN entropy > 6 THEN 1 ELSE 0 END + CASE WHEN list_contains(sy, 'OCR') THEN 1 ELSE 0 END + CASE WHEN is_entry THEN 1 ELSE 0 END) >= 2"),
    "function_equals_bool": ('@has_symbol("OCR") == false && @is_leaf() != true', f"NOT list_contains(sy, 'OCR') AND {_kids('true')} <> 0"),
    "nested_trees": ('@has_child(object_type == "Zip" && @has_child(object_type == "PDF")) || not @has_parent(@count_children() < 5)',
                     f"EXISTS (SELECT 1 FROM n z WHERE z.parent = n.id AND z.work_id = n.work_id AND z.object_type = 'Zip' AND EXISTS (SELECT 1 FROM n q WHERE q.parent = z.id AND q.work_id = z.work_id AND q.object_type = 'PDF'))"
                     " OR NOT EXISTS (SELECT 1 FROM n z WHERE z.id = n.parent AND z.work_id = n.work_id AND (SELECT count(*) FROM n q WHERE q.parent = z.id AND q.work_id = z.work_id) < 5)"),
}


def _case(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: store(spark, d).matching(text).select("id", "work_id")


def search_works_distinct(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).search_works('object_type == "PE"')


def search_limit(spark: SparkSession, d: str) -> DataFrame:
    """Top-k by key: the limit is the feature."""
    return store(spark, d).search_works('object_type == "PE"', 10)


def count_objects(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).count("size > 10000")


def closure_table(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).closure()


def work_graph_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole trees of the works that hold an executable."""
    s = store(spark, d)
    g = s.work_graph(s.search_works('object_type == "PE" && size > 100000'))
    return g.select("id", "work_id", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", F.array_join("path", "/").alias("path"))


def relation_names(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).nodes.select("id", F.explode(names()).alias("name")).distinct()


def symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    return store(spark, d).source.rows(None, False).select(F.explode(symbols()).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable] = {k: _case(q) for k, (q, _) in CASES.items()}
QUERIES |= {"search_works_distinct": search_works_distinct, "search_limit": search_limit, "count_objects": count_objects,
            "closure_table": closure_table, "work_graph_rows": work_graph_rows, "relation_names": relation_names, "symbol_counts": symbol_counts}
SQL = {k: BASE + f"SELECT id, work_id FROM n WHERE {c}" for k, (_, c) in CASES.items()}
SQL |= {
    "search_works_distinct": BASE + "SELECT DISTINCT work_id FROM n WHERE object_type = 'PE'",
    "search_limit": BASE + "SELECT DISTINCT work_id FROM n WHERE object_type = 'PE' ORDER BY work_id LIMIT 10",
    "count_objects": BASE + "SELECT count(*) AS objects, count(DISTINCT work_id) AS works FROM n WHERE size > 10000",
    "closure_table": BASE + "SELECT ids[i] AS anc, id AS \"desc\", CAST(len(ids) - i AS INTEGER) AS depth FROM (SELECT *, unnest(range(1, len(ids))) AS i FROM w)",
    "work_graph_rows": BASE + """, wk AS (SELECT DISTINCT work_id FROM n WHERE object_type = 'PE' AND size > 100000), k AS (SELECT * FROM n WHERE work_id IN (SELECT work_id FROM wk)),
v AS (SELECT id, work_id, parent, 1 AS depth, CAST(id AS VARCHAR) AS path FROM k WHERE parent IS NULL
      UNION ALL SELECT k.id, k.work_id, k.parent, v.depth + 1, v.path || '/' || CAST(k.id AS VARCHAR) FROM v JOIN k ON k.parent = v.id)
SELECT id, work_id, coalesce(parent, -1) AS parent, depth, path FROM v""",
    "relation_names": BASE + "SELECT DISTINCT id, unnest(nm) AS name FROM n",
    "symbol_counts": BASE + "SELECT s AS symbol, count(*) AS n FROM (SELECT unnest(sy) AS s FROM n) GROUP BY s",
}
