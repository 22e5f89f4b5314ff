"""Queries from a terminal: ``python -m nestlake FOLDER`` reads one query a line over FOLDER/objects.parquet and
FOLDER/rels.parquet. Lines that start with a colon are commands:

    :check QUERY      error with its position, or ok          :complete TEXT    what may follow
    :global QUERY     check of a query over neighbours         :explain QUERY    the plan
    :count QUERY      objects and works                        :quit
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession

from nestlake.plans.compiler import Nodes
from nestlake.plans.parser import QueryError, check, complete
from nestlake.plans.search import Store
from nestlake.runtime import table


def answer(store: Store, line: str, limit: int = 20) -> str | None:
    """What a line gives; None ends the session."""
    command, _, text = line[1:].partition(" ") if line.startswith(":") else ("", "", line)
    if command == "quit":
        return None
    if command in ("check", "global"):
        return str(check(text, command == "global") or "ok")
    if command == "complete":
        return ", ".join(complete(text))
    if command not in ("", "explain", "count"):
        return f"no command {command}"
    try:
        if command == "explain":
            return store.explain(text)
        if command == "count":
            r = store.count(text).first()
            return f"{r['objects']} objects in {r['works']} works"
        return "\n".join(f"{r['work_id']}\t{r['object_id']}" for r in store.search_objects(text, limit).collect())
    except QueryError as e:
        return f"{text}\n{' ' * e.position}^ {e}"


def main(folder: str, lines: Iterable[str]) -> None:
    spark = SparkSession.builder.appName("nestlake").getOrCreate()
    store = Store(Nodes(table(spark, folder, "objects"), table(spark, folder, "rels").select("parent", "child", "props")))
    for line in lines:
        if line.strip():
            out = answer(store, line.strip())
            if out is None:
                break
            print(out)


if __name__ == "__main__":
    main(sys.argv[1], sys.stdin)
