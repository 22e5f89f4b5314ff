"""Stored scenarios: a local query on a work, and optionally a global query on the works near it in time.

All works and all scenarios are evaluated in one plan. Each local query yields the works it matches. Without context
the action fires. With one, the neighbours are the other works' entries within the time window, nearest first (a
neighbour before the work precedes one after it at the same distance, then the smaller id), up to max_neighbors; the
number n of neighbours that the global query matches is held against the threshold over the N neighbours.

Two plans give the counts:
 * without max_neighbors and selectors, a neighbour's match does not depend on the local work, so N and n are
   differences of running counts along the time order at both ends of the window (``operators.ranking``): linear in the
   entries, however wide the window is and however many entries share a moment, and no pair of works is ever formed;
 * with max_neighbors, entries are numbered along the time order, and a work is paired only with the max_neighbors
   entries before and after its own place, found by an equi-join on the number;
 * with selectors and no max_neighbors the answer depends on every pair within the window, so all are formed, by an
   equi-join on time buckets with the exact distance as residual.

``matched_pairs`` gives the pairs themselves. Where the global query asks no more of a selector than a value in common,
no node is repeated for each local work: works meet by their values. Values that so many works hold that their pairs
would outweigh the values themselves are bits of a work, and pairs within the window are tested on them as they are
formed, each once and with nothing shuffled behind; by all other values pairs are found with an equi-join.

Deviations from a one-by-one evaluation: true distances decide the order everywhere; ties are broken as above.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nestlake.operators.ranking import running_sums, window_sums
from nestlake.plans import ast as A
from nestlake.plans.parser import QueryError, parse, parse_global
from nestlake.plans.search import Store
from nestlake.runtime import cut

LANGUAGE_VERSION = (1, 3, 0)
#: Most values that become bits of a work, and from which share of all value rows on the pairs of one value count as many.
BITS, MANY = 256, 1 / 16


@dataclass(frozen=True)
class Scenario:
    name: str
    action: str
    creator: str
    local_query: str
    global_query: str | None = None
    description: str = ""
    compatible_with: str = ">=1.0.0"


class Registry:
    """Scenarios by name: validated when added, listed in order."""

    def __init__(self) -> None:
        self._all: dict[str, Scenario] = {}

    def add(self, s: Scenario, replace: str | None = None) -> None:
        problems = validate(s)
        if s.name in self._all and s.name != replace:
            problems.append("name is in use")
        if problems:
            raise ValueError("; ".join(problems))
        if replace is not None:
            self._all.pop(replace, None)
        self._all[s.name] = s

    def delete(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def get(self, name: str) -> Scenario | None:
        return self._all.get(name)

    def list(self) -> list[Scenario]:
        return [self._all[n] for n in sorted(self._all)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write all scenarios as one table; the version under ``path`` is replaced as a whole."""
        rows = [tuple(getattr(s, f.name) for f in fields(Scenario)) for s in self.list()]
        spark.createDataFrame(rows, ", ".join(f"{f.name} string" for f in fields(Scenario))).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """Scenarios as they are stored now; a stored one that is not valid any more is an error."""
        out = cls()
        for r in spark.read.parquet(path).orderBy("name").collect():  # one row for each scenario
            out.add(Scenario(**r.asDict()))
        return out

    def patterns(self) -> list[A.Pattern]:
        """All byte patterns of compatible scenarios, sorted and without repetition: what a scanner has to look for."""
        found: set = set()
        for s in self.list():
            if compatible(s.compatible_with):
                for q in [parse(s.local_query)] + ([parse_global(s.global_query)] if s.global_query else []):
                    _patterns((q.body, tuple(q.variables.values())), found)
        return sorted(found, key=lambda p: (p.text, p.offset))


def _patterns(x: object, found: set) -> None:
    if isinstance(x, A.Pattern):
        found.add(x)
    elif isinstance(x, (tuple, list)):
        for y in x:
            _patterns(y, found)
    elif hasattr(x, "__dataclass_fields__"):
        for name in x.__dataclass_fields__:
            _patterns(getattr(x, name), found)


def compatible(requirement: str) -> bool:
    """Comma-separated comparisons with the language version; a bare or ^ version allows later ones of the same major."""
    for part in requirement.split(","):
        m = re.fullmatch(r"\s*(>=|<=|>|<|=|\^|~)?\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?\s*", part)
        if not m:
            return False
        v = tuple(int(x or 0) for x in m.groups()[1:])
        now, op = LANGUAGE_VERSION, m[1] or "^"
        ok = {">=": now >= v, "<=": now <= v, ">": now > v, "<": now < v, "=": now == v, "^": now >= v and now[0] == v[0], "~": now >= v and now[:2] == v[:2]}[op]
        if not ok:
            return False
    return True


def validate(s: Scenario) -> list[str]:
    out = [f"{k} is empty" for k in ("name", "creator", "action") if not getattr(s, k).strip()]
    if not compatible(s.compatible_with):
        out.append("not compatible with this version")
    for kind, text, parser in (("local query", s.local_query, parse), ("global query", s.global_query, parse_global)):
        if text is not None:
            try:
                parser(text)
            except QueryError as e:
                out.append(f"{kind}: {e}")
    return out


def entries(store: Store) -> DataFrame:
    """(work_id, id, t): the first entry of each work; one without a time only where no entry has one."""
    e = store.source.rows(F.col("is_entry"), False).groupBy("work_id").agg(F.min(F.struct(F.col("t").isNull().alias("unknown"), "t", "id")).alias("e"))
    return e.select("work_id", "e.id", F.col("e.t").cast("timestamp").alias("t"))



def evaluate(store: Store, scenarios: list[Scenario], works: DataFrame | None = None) -> DataFrame:
    """(work_id, scenario, ctime, action) of the scenarios that fire; ``works`` (work_id) limits the works looked at."""
    all_entries = cut(entries(store))
    parts = []
    for s in scenarios:
        if not compatible(s.compatible_with) or validate(s):
            continue  # skipped, as an invalid one cannot have been stored
        local = store.matching(s.local_query).select("work_id").distinct()
        if works is not None:
            local = local.join(works, "work_id", "left_semi")
        hit = all_entries.join(local, "work_id", "left_semi")
        if s.global_query:
            hit = decide(store, parse_global(s.global_query), hit, all_entries)
        parts.append(hit.select("work_id", F.lit(s.name).alias("scenario"), (F.unix_micros("t") / 1e6).alias("ctime"), F.lit(s.action).alias("action")))
    if not parts:
        return store.source.objects.sparkSession.createDataFrame([], "work_id string, scenario string, ctime double, action string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decide(store: Store, q: A.Query, hit: DataFrame, all_entries: DataFrame) -> DataFrame:
    """The works of ``hit`` for which the context condition holds."""
    s = q.settings
    counts = neighbour_counts(store, q, hit, all_entries)
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    level = F.floor(F.lit(float(s.number)) / 100.0 * total) if s.percent else F.lit(s.number)
    if s.relation == "more":
        ok = n > level
    elif s.relation == "less":
        ok = n <= F.greatest(level - 1, F.lit(0))
    else:
        ok = n == 0
    return hit.join(counts, "work_id", "left").where(ok).select(*hit.columns)


def neighbour_counts(store: Store, q: A.Query, hit: DataFrame, all_entries: DataFrame) -> DataFrame:
    """(work_id, total, n): neighbours, and those that the global query matches."""
    selects = any(isinstance(v, A.Selector) for v in q.variables.values())
    if q.settings.max_neighbors is None and not selects:
        return _by_frames(store, q, hit, all_entries)
    return _by_pairs(store, q, hit, all_entries)


def _by_frames(store: Store, q: A.Query, hit: DataFrame, all_entries: DataFrame) -> DataFrame:
    c = store.compiler(q)
    match = c.select(q.body).select("work_id").distinct().withColumn("m", F.lit(1))
    e = all_entries.join(match, "work_id", "left").join(hit.select("work_id", F.lit(True).alias("own")), "work_id", "left")
    e = e.select("work_id", "id", F.unix_micros("t").alias("us"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("own", F.lit(False)).alias("own"))
    own = e.where("own").select(F.col("work_id").alias("key"), F.col("us").alias("at"))
    sums = window_sums(own, e.select(F.col("us").alias("at"), "id", "m"), q.settings.window_us, {"total": F.lit(1), "n": F.col("m")})
    return e.where("own").join(sums, F.col("work_id") == F.col("key")).select("work_id", (F.col("total") - 1).alias("total"), (F.col("n") - F.col("m")).alias("n"))


def pairs(hit: DataFrame, all_entries: DataFrame, window_us: int, max_neighbors: int | None) -> DataFrame:
    """(local, neighbour) within the window, the nearest max_neighbors of each."""
    if max_neighbors is not None:
        return _nearest(hit, all_entries, window_us, max_neighbors)
    w = max(window_us, 1)
    a = hit.select(F.col("work_id").alias("local"), F.unix_micros("t").alias("at"))
    a = a.select("*", F.floor(F.col("at") / w).alias("home")).select("local", "at", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1)).alias("bucket"))
    b = all_entries.select(F.col("work_id").alias("neighbour"), "id", F.unix_micros("t").alias("us"), F.floor(F.unix_micros("t") / w).alias("bucket"))
    dt = F.abs(F.col("us") - F.col("at"))
    p = a.join(b, "bucket").where((dt <= window_us) & (F.col("local") != F.col("neighbour"))).select("local", "neighbour", "id", dt.alias("dt"), (F.col("us") > F.col("at")).alias("after"))
    return p.select("local", "neighbour")


def matched_pairs(store: Store, q: A.Query, hit: DataFrame, all_entries: DataFrame, window_us: int) -> DataFrame:
    """(local, neighbour) within the window for which the global query matches the neighbour."""
    all_entries, n = cut(all_entries, F.count(F.lit(1)).alias("rows"))
    hit, m = cut(hit, F.count(F.lit(1)).alias("rows"))
    values = store.shared_values(q, hit.select(F.col("work_id").alias("local")))
    if values is None:
        return store.global_matches(q, pairs(hit, all_entries, window_us, None))
    a = hit.select(F.col("work_id").alias("local"), F.unix_micros("t").alias("at"))
    b = all_entries.select(F.col("work_id").alias("neighbour"), F.unix_micros("t").alias("us"))
    near = _bucketed(a, b, window_us, 1)
    near = near[0].groupBy("bucket").count().join(near[1].groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").agg(F.sum(F.col("count").cast("double") * F.col("n"))).first()[0]
    share = (near or 0.0) / max(m["rows"] * n["rows"], 1)  # of all pairs of works, those that may lie within the window
    a, na = cut(values[0].join(a, "local").distinct(), F.count(F.lit(1)).alias("rows"))
    b, nb = cut(values[1].join(a.select("value").distinct(), "value", "left_semi").join(b, "neighbour").distinct(), F.count(F.lit(1)).alias("rows"))
    held = a.groupBy("value").agg(F.count(F.lit(1)).alias("l")).join(b.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value")
    weight = F.col("l").cast("double") * F.col("n") * share
    heavy = held.select("value", weight.alias("weight")).where(F.col("weight") >= MANY * (na["rows"] + nb["rows"])).orderBy(F.desc("weight"), "value").limit(BITS)
    heavy, k = cut(heavy.select("value", (F.row_number().over(Window.orderBy("value")) - 1).alias("bit")), F.count(F.lit(1)).alias("rows"))
    words = range(-(-k["rows"] // 64))

    def bits(x: DataFrame, who: str, at: str) -> DataFrame:
        """Of each work, the heavy values that it holds."""
        each = [F.when(F.col("bit").between(64 * j, 64 * j + 63), F.expr(f"shiftleft(1L, bit - {64 * j})")) for j in words]
        return x.join(heavy, "value").groupBy(who, at).agg(*[F.coalesce(F.bit_or(c), F.lit(0).cast("long")).alias(f"{who}{j}") for j, c in enumerate(each)])

    if not words:
        return _near(a, b, window_us, 1, "value").select("local", "neighbour").distinct()
    own, other = bits(a, "local", "at"), bits(b, "neighbour", "us")
    meet = F.lit(False)
    for j in words:
        meet = meet | (F.col(f"local{j}").bitwiseAND(F.col(f"neighbour{j}")) != 0)
    light = lambda x, has, *by: x.join(heavy, "value", "left_anti").join(has, [*by], "left")
    rest = _near(light(a, own, "local", "at"), light(b, other, "neighbour", "us"), window_us, 1, "value").where(~F.coalesce(meet, F.lit(False)))
    return _near(own, other, window_us, 4).where(meet).select("local", "neighbour").unionByName(rest.select("local", "neighbour").distinct())


def _bucketed(a: DataFrame, b: DataFrame, window_us: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Both with time buckets of a part of the window; a stands in all those that the window around it may reach."""
    w = max(-(-window_us // parts), 1)
    home = F.floor(F.col("at") / w)
    return a.select("*", F.explode(F.sequence(home - parts, home + parts)).alias("bucket")), b.withColumn("bucket", F.floor(F.col("us") / w))


def _near(a: DataFrame, b: DataFrame, window_us: int, parts: int, *by: str) -> DataFrame:
    """a(local, at, ...) and b(neighbour, us, ...) of another work within the window, equal in ``by``."""
    a, b = _bucketed(a, b, window_us, parts)
    return a.join(b, ["bucket", *by]).where((F.abs(F.col("us") - F.col("at")) <= window_us) & (F.col("local") != F.col("neighbour")))


def _nearest(hit: DataFrame, all_entries: DataFrame, window_us: int, k: int) -> DataFrame:
    """Candidates are the k entries on either side; among entries of one moment the smaller id is the nearer one, so each
    side has its own numbering."""
    one = {"place": F.lit(1)}
    e = all_entries.select(F.col("work_id").alias("neighbour"), "id", F.unix_micros("t").alias("us"))
    back = cut(running_sums(e, [F.col("us"), F.desc("id")], one))
    ahead = running_sums(e, [F.col("us"), F.col("id")], one)
    upto = back.groupBy(F.col("us").alias("at")).agg(F.max("place").alias("upto"))
    a = hit.select(F.col("work_id").alias("local"), F.unix_micros("t").alias("at")).join(upto, "at")
    place = lambda lo, hi: a.select("local", "at", F.explode(F.sequence(F.col("upto") + lo, F.col("upto") + hi)).alias("place"))
    near = place(-k, 0).join(back, "place").unionByName(place(1, max(k, 1)).join(ahead, "place"))  # the work itself is among those before
    dt = F.abs(F.col("us") - F.col("at"))
    near = near.where((dt <= window_us) & (F.col("local") != F.col("neighbour")))
    rank = F.row_number().over(Window.partitionBy("local").orderBy(dt, F.col("us") > F.col("at"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("local", "neighbour")


def _by_pairs(store: Store, q: A.Query, hit: DataFrame, all_entries: DataFrame) -> DataFrame:
    p = cut(pairs(hit, all_entries, q.settings.window_us, q.settings.max_neighbors))
    matched = store.global_matches(q, p).withColumn("m", F.lit(1))
    return p.join(matched, ["local", "neighbour"], "left").groupBy(F.col("local").alias("work_id")).agg(F.count(F.lit(1)).alias("total"), F.count("m").alias("n"))


def results(fired: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row for each evaluated work (work_id, t), also where nothing fired: actions in order of the scenarios' names."""
    each = fired.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("scenario", "ctime", "action"))).alias("actions"))
    empty = F.array().cast("array<struct<scenario:string,ctime:double,action:string>>")
    return evaluated.select("work_id").distinct().join(each, "work_id", "left").select("work_id", F.current_timestamp().alias("t"), F.coalesce("actions", empty).alias("actions"))


def latest_actions(stored: DataFrame, work_id: str, limit: int = 1, most: int = 100) -> DataFrame:
    """The last results of a work, newest first."""
    return stored.where(F.col("work_id") == work_id).orderBy(F.desc("t")).limit(min(limit, most))
