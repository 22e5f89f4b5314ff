"""Dissection of submitted content, level by level, into node and edge tables.

Every round applies the processors to all objects of a level in Arrow batches, explodes the children and types, hashes
and measures them for the next round; a round's result is written to the shared folder, so nothing is processed twice.
Objects of a level are spread over the cluster whatever work or type they belong to, so one huge work is no hot spot.
Ids are texts (work id and path of child numbers), so they do not depend on the order of processing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestlake.plans.patterns import Scanner, tags
from nestlake.processors.base import LIMITS, Job, Limits, run
from nestlake.runtime import cut
from nestlake.sources.content import detect_type, entropy, hashes

MAX_RECURSION = 24
_CHILDREN = "array<struct<content:binary,force_type:string,symbols:array<string>,props:string>>"
_OUT = f"id string, result string, children {_CHILDREN}"


def _processor(limits: dict[str, Limits], tags: dict[str, tuple[str, str]], signatures: dict[str, tuple[str, str]]):
    """One level: scan, process, and hand down what children inherit."""
    scanner = Scanner(tags | {f"\0{name}": p for name, p in signatures.items()})

    def one(r) -> tuple:
        given = set(r.given) if r.given is not None else set()
        found = scanner.tags_of(r.content) if r.content is not None and len(r.content) else []
        given |= {t for t in found if t[0] != "\0"} | ({"INFECTED"} if any(t[0] == "\0" for t in found) else set())
        if r.content is None or not len(r.content) or r.level >= r.deepest:
            given |= {"TOODEEP"} if r.content is not None and len(r.content) and r.level >= r.deepest else set()
            return r.id, json.dumps({"ok": {"symbols": sorted(given), "object_metadata": {}}}), []
        kind = r.object_type.partition("/")[0]
        words = tuple(r.passwords) if r.passwords is not None else ()
        got = run(Job(r.content, kind, tuple(sorted(given)), words, limits.get(kind, LIMITS.get(kind, Limits())), r.page))
        if got.error is not None:
            return r.id, json.dumps({"error": got.error}), []
        meta = got.metadata | ({"infections": [t[1:] for t in found if t[0] == "\0"]} if "INFECTED" in given else {})
        try:
            shared = json.loads(r.props or "{}").get("_global")
        except (ValueError, AttributeError):
            shared = None
        kids = [{"content": c.content, "force_type": c.force_type, "symbols": c.symbols, "props": json.dumps(c.relation | ({"_global": shared} if shared is not None else {}))} for c in got.children]
        return r.id, json.dumps({"ok": {"symbols": sorted({*given, *got.symbols}), "object_metadata": meta}}), kids

    def process(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(r) for r in b.itertuples(index=False)], columns=["id", "result", "children"])

    return process


def _typed(df: DataFrame) -> DataFrame:
    """Type, subtype, hashes, size and entropy of content; a child without content is SKIPPED."""
    kind = F.coalesce(F.when(F.col("content").isNull(), F.lit("SKIPPED")).when(F.length("content") == 0, F.lit("EMPTY")), F.col("force_type"), detect_type("content"))
    df = df.withColumn("kind", kind)
    cut_at = F.instr("kind", "/")
    return df.select("*", F.split_part("kind", F.lit("/"), F.lit(1)).alias("object_type"), F.when(cut_at > 0, F.expr("substring(kind, instr(kind, '/') + 1)")).alias("object_subtype"),
                     F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("size"), hashes("content").alias("hashes"), entropy("content").alias("entropy")).drop("kind", "force_type")


def dissect(submitted: DataFrame, max_recursion: int = MAX_RECURSION, limits: dict[str, Limits] | None = None, patterns: Iterable[tuple[str, str]] = (),
            signatures: dict[str, tuple[str, str]] | None = None, pages: DataFrame | None = None, pattern_tag: str = "Pattern.") -> tuple[DataFrame, DataFrame]:
    """submitted(work_id, org, t, content, props[, object_type][, passwords array<string>][, max_recursion int]) ->
    (objects, rels).

    ``limits``: by object type, in place of the general ones. ``patterns`` (text, offset) are looked for in all content
    and leave the tags that ``@match_pattern`` reads; ``signatures``, name -> (text, offset), make a content INFECTED.
    ``pages`` (url string, content binary) are what addresses lead to, joined to the URL objects of a level. A member
    ``_global`` of the props is handed down to all descendants.
    """
    deepest = max(1, min(max_recursion, MAX_RECURSION))
    process = _processor(limits or {}, tags(patterns, pattern_tag), signatures or {})
    s = submitted
    if "max_recursion" not in s.columns:
        s = s.withColumn("max_recursion", F.lit(deepest))
    s = s.withColumn("max_recursion", F.greatest(F.least(F.coalesce("max_recursion", F.lit(deepest)), F.lit(deepest)), F.lit(1)))
    if "object_type" not in s.columns:
        s = s.withColumn("object_type", F.lit(None).cast("string"))
    if "passwords" not in s.columns:
        s = s.withColumn("passwords", F.lit(None).cast("array<string>"))
    level = _typed(s.select("work_id", "org", "t", F.concat("work_id", F.lit(":0")).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), "content", "props", "passwords", "max_recursion",
                            F.array().cast("array<string>").alias("given"), F.col("object_type").alias("force_type")))
    objects, rels = [], []
    while True:
        level, seen = cut(level, F.count(F.lit(1)).alias("n"))
        if not seen["n"]:
            break
        job = level.select("id", "content", "object_type", "level", "given", "passwords", "props", F.col("max_recursion").alias("deepest"))
        done = cut(_with_pages(job, pages).mapInPandas(process, _OUT))
        facts = level.drop("content").join(done.select("id", "result"), "id")
        objects.append(facts.select("id", "org", "work_id", F.col("parent").isNull().alias("is_entry"), F.coalesce(F.col("hashes")["sha256"], F.lit("0" * 64)).alias("object_id"), "object_type", "object_subtype",
                                    F.col("level").alias("recursion_level"), "size", "hashes", "t", "result", "entropy"))
        rels.append(level.select("parent", F.col("id").alias("child"), "props", "work_id"))
        kids = done.select(F.col("id").alias("parent"), F.posexplode("children").alias("k", "c"))
        up = level.select(F.col("id").alias("parent"), "work_id", "org", "t", "passwords", "max_recursion", F.col("level").alias("above"))
        level = _typed(kids.join(up, "parent").select("work_id", "org", "t", F.concat_ws("/", "parent", "k").alias("id"), "parent", (F.col("above") + 1).alias("level"),
                                                      F.col("c.content").alias("content"), F.col("c.props").alias("props"), "passwords", "max_recursion", F.col("c.symbols").alias("given"), F.col("c.force_type").alias("force_type")))
    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if not objects:
        empty = "id string, org string, work_id string, is_entry boolean, object_id string, object_type string, object_subtype string, recursion_level int, size long, hashes map<string,string>, t timestamp, result string, entropy double"
        spark = submitted.sparkSession
        return spark.createDataFrame([], empty), spark.createDataFrame([], "parent string, child string, props string, work_id string")
    return all_of(objects), all_of(rels)


def _with_pages(job: DataFrame, pages: DataFrame | None) -> DataFrame:
    """The fetched page of each URL object, if there is one; of several pages of an address the smallest counts."""
    if pages is None:
        return job.withColumn("page", F.lit(None).cast("binary"))
    one = pages.groupBy(F.trim("url").alias("__url")).agg(F.min("content").alias("page"))
    address = F.when(F.lower("object_type") == "url", F.trim(F.decode("content", "UTF-8")))
    return job.withColumn("__at", address).join(one, F.col("__at") == F.col("__url"), "left").drop("__at", "__url")


def passwords_of(objects: DataFrame) -> DataFrame:
    """(work_id, passwords) of works worth a second pass: something stayed encrypted and some text named passwords."""
    r = F.try_parse_json("result")
    facts = objects.select("work_id", F.coalesce(F.try_variant_get(r, "$.ok.symbols", "array<string>"), F.array().cast("array<string>")).alias("s"),
                           F.coalesce(F.try_variant_get(r, "$.ok.object_metadata.possible_passwords", "array<string>"), F.array().cast("array<string>")).alias("p"))
    secret = F.array_contains("s", "ENCRYPTED") & ~F.array_contains("s", "DECRYPTED")
    works = facts.groupBy("work_id").agg(F.bool_or(secret).alias("secret"))
    words = facts.select("work_id", F.explode("p").alias("w")).distinct().groupBy("work_id").agg(F.array_sort(F.collect_list("w")).alias("passwords"))
    return works.where("secret").join(words, "work_id").select("work_id", "passwords")


def dissect_again(submitted: DataFrame, max_recursion: int = MAX_RECURSION, **more) -> tuple[DataFrame, DataFrame]:
    """As dissect; works whose props say _can_reprocess are dissected once more with the passwords found in them, and
    that second result replaces their first."""
    objects, rels = dissect(submitted, max_recursion, **more)
    allowed = submitted.where(F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$._can_reprocess", "boolean"), F.lit(False)))
    again = cut(allowed.join(passwords_of(objects), "work_id"))
    o2, r2 = dissect(again, max_recursion, **more)
    works = again.select("work_id").distinct()
    return objects.join(works, "work_id", "left_anti").unionByName(o2), rels.join(works, "work_id", "left_anti").unionByName(r2)
