"""Scenario and selector queries over objects, rels and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestlake.operators.ranking import window_sums
from nestlake.plans.parser import parse_global
from nestlake.plans.scenarios import Scenario, entries, evaluate, matched_pairs, neighbour_counts
from nestlake.plans.search_queries import BASE, store
from nestlake.runtime import table

LOCAL = '@is_root() && object_type == "Zip"'
_W = 3 * 86_400 * 10**6


def _one(name: str, matches: str, body: str = '@has_symbol("ENCRYPTED")', window: str = "3 days", more: str = ""):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = Scenario(name, "alert", "tests", LOCAL, f"MATCHES:{matches};TIME_WINDOW:{window};{more} {body}")
        return evaluate(store(spark, d), [s]).select("work_id", "scenario", "action")
    return run


def scenario_local(spark: SparkSession, d: str) -> DataFrame:
    return evaluate(store(spark, d), [Scenario("local", "alert", "tests", LOCAL)]).select("work_id", "scenario", "action")


def _selected(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Pairs of a work with a mail at the root and its neighbours of three days that share a value."""
        s = store(spark, d)
        e = entries(s)
        hit = e.join(s.search_works('@is_root() && object_type == "Email"'), "work_id", "left_semi")
        return matched_pairs(s, parse_global(f"MATCHES:>0;TIME_WINDOW:3 days;{text}"), hit, e, _W)
    return run


def neighbours_near(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of every entry within three days and how many hold an encrypted object."""
    s = store(spark, d)
    e = entries(s)
    return neighbour_counts(s, parse_global('MATCHES:>0;TIME_WINDOW:3 days;@has_symbol("ENCRYPTED")'), e, e)


def events_window(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with at least three errors of any user within the hour around them: window sums on a plain table."""
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    errors = e.where("event_type = 'error'").select("at", F.col("event_id").alias("id"))
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("key"), "at")
    found = window_sums(bought, errors, 3_600_000_000, {"errors": F.lit(1)})
    return found.where("errors >= 3").select(F.col("key").alias("event_id"), "errors")


QUERIES = {
    "scenario_local": scenario_local, "scenario_more_than": _one("more", ">2"), "scenario_more_than_pct": _one("more_pct", ">40%"), "scenario_less_than": _one("less", "<2"),
    "scenario_less_than_pct": _one("less_pct", "<30%"), "scenario_none": _one("none", "NONE", window="1 day"),
    "scenario_max_neighbors": _one("max", ">0", more="MAX_NEIGHBORS:2;"), "neighbours_near": neighbours_near,
    "selector_column": _selected("${x}=LOCAL.filter(not is_entry).size; size in ${x} && size > 0"), "selector_symbols": _selected("${x}=LOCAL.get_symbols(); @has_symbol(in ${x})"),
    "selector_names": _selected("${x}=LOCAL.get_names(); @has_name(in ${x})"), "selector_object_meta": _selected("${x}=LOCAL.get_object_meta($_perf); @match_object_meta($_perf in ${x})"),
    "selector_relation_meta": _selected("${x}=LOCAL.get_relation_meta($index); @match_relation_meta($index in ${x})"), "selector_not_in": _selected("${x}=LOCAL.object_type; is_entry && object_type not in ${x}"),
    "events_window": events_window,
}

_E = BASE + """, e AS (SELECT work_id, min(t) AS t, min_by(id, (t, id)) AS id FROM n WHERE is_entry GROUP BY work_id),
en AS (SELECT DISTINCT work_id FROM n WHERE list_contains(sy, 'ENCRYPTED')),
lo AS (SELECT e.* FROM e WHERE work_id IN (SELECT work_id FROM n WHERE is_entry AND object_type = 'Zip')),
"""


def _scenario(name: str, cond: str, days: int = 3, most: int | None = None) -> str:
    limit = f"WHERE rk <= {most}" if most else ""
    return _E + f"""
pr AS (SELECT l.work_id AS lw, b.work_id AS bw, row_number() OVER (PARTITION BY l.work_id ORDER BY abs(epoch_us(b.t) - epoch_us(l.t)), b.t > l.t, b.id) AS rk
       FROM lo l JOIN e b ON b.work_id <> l.work_id AND abs(epoch_us(b.t) - epoch_us(l.t)) <= {days * 86400 * 10**6}),
ct AS (SELECT lw, count(*) AS total, count(*) FILTER (WHERE bw IN (SELECT work_id FROM en)) AS k FROM pr {limit} GROUP BY lw),
al AS (SELECT lo.work_id, coalesce(total, 0) AS total, coalesce(k, 0) AS k FROM lo LEFT JOIN ct ON lw = lo.work_id)
SELECT work_id, '{name}' AS scenario, 'alert' AS action FROM al WHERE {cond}"""


def _selector(value: str, test: str) -> str:
    return _E + f"""
em AS (SELECT e.* FROM e WHERE work_id IN (SELECT work_id FROM n WHERE is_entry AND object_type = 'Email')),
pr AS (SELECT l.work_id AS lw, b.work_id AS bw FROM em l JOIN e b ON b.work_id <> l.work_id AND abs(epoch_us(b.t) - epoch_us(l.t)) <= {_W}),
sv AS (SELECT DISTINCT work_id AS lw, v FROM ({value}) WHERE v IS NOT NULL)
SELECT DISTINCT pr.lw AS local, pr.bw AS neighbour FROM pr JOIN n ON n.work_id = pr.bw WHERE {test}"""


SQL = {
    "scenario_local": _E + "z AS (SELECT 1) SELECT work_id, 'local' AS scenario, 'alert' AS action FROM lo",
    "scenario_more_than": _scenario("more", "k > 2"), "scenario_more_than_pct": _scenario("more_pct", "k > floor(0.4 * total)"), "scenario_less_than": _scenario("less", "k <= 1"),
    "scenario_less_than_pct": _scenario("less_pct", "k <= greatest(floor(0.3 * total) - 1, 0)"), "scenario_none": _scenario("none", "k = 0", 1), "scenario_max_neighbors": _scenario("max", "k > 0", 3, 2),
    "neighbours_near": _E + f"""z AS (SELECT l.work_id, count(b.work_id) AS total, count(b.work_id) FILTER (WHERE b.work_id IN (SELECT work_id FROM en)) AS n
      FROM e l LEFT JOIN e b ON b.work_id <> l.work_id AND abs(epoch_us(b.t) - epoch_us(l.t)) <= {_W} GROUP BY l.work_id) SELECT * FROM z""",
    "selector_column": _selector("SELECT work_id, size AS v FROM n WHERE NOT is_entry", "n.size > 0 AND EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND sv.v = n.size)"),
    "selector_symbols": _selector("SELECT work_id, unnest(sy) AS v FROM n", "EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND list_contains(n.sy, sv.v))"),
    "selector_names": _selector("SELECT work_id, unnest(nm) AS v FROM n", "EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND list_contains(n.nm, sv.v))"),
    "selector_object_meta": _selector("SELECT work_id, CAST(m->>'$._perf' AS DOUBLE) AS v FROM n", "EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND sv.v = CAST(n.m->>'$._perf' AS DOUBLE))"),
    "selector_relation_meta": _selector("SELECT work_id, p->>'$.index' AS v FROM n", "EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND sv.v = (n.p->>'$.index'))"),
    "selector_not_in": _selector("SELECT work_id, object_type AS v FROM n", "n.is_entry AND NOT EXISTS (SELECT 1 FROM sv WHERE sv.lw = pr.lw AND sv.v = n.object_type)"),
    "events_window": "SELECT * FROM (SELECT p.event_id, count(*) AS errors FROM events p JOIN events e ON e.event_type = 'error' AND abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 3600000000 WHERE p.event_type = 'purchase' GROUP BY 1) WHERE errors >= 3",
}
