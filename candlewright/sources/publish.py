"""Write, audit, publish: readers see whole versions only, and only what was checked.

A version is written to a folder of its own, read back and audited there, and then named by a manifest of the next number; readers take the highest
manifest. A manifest is written aside and renamed, so it is there whole or not at all, and of two writers with one number the second fails. A writer that dies before that leaves an unnamed
folder and the version before in force. Where a store's rename isn't atomic, that last step is as safe as the store's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators.tokens import previews


class AuditFailed(ValueError):
    """The audit found broken rules; ``preview`` has the first rows of each."""

    def __init__(self, counts: dict[str, int], preview: list):
        super().__init__(f"not published: {counts}; for example {[r.asDict() for r in preview]}")
        self.counts, self.preview = counts, preview


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> dict[int, dict]:
    """number: manifest, of all versions that can be read."""
    place, fs = _place(spark, f"{folder}/manifests")
    if not fs.exists(place):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(place)]
    return {int(n[:-5]): json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifests/{n}", wholetext=True).collect())) for n in names if n.endswith(".json") and n[:-5].isdigit()}


def read_published(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{known[max(known) if version is None else version]['data']}")


def _commit(spark: SparkSession, folder: str, number: int, manifest: dict) -> None:
    aside, fs = _place(spark, f"{folder}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(json.dumps(manifest).encode())
    out.close()
    final, _ = _place(spark, f"{folder}/manifests/{number:09d}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise FileExistsError(f"version {number} of {folder} has been published by another writer")


def publish(rows: DataFrame, folder: str, audit: Callable[[DataFrame], DataFrame], keep: int = 2, each: int = 5, dry_run: bool = False) -> int | None:
    """Publishes rows if ``audit`` of what was written has no row; the number of the version. audit: stored rows to rows with ``violation``.

    A dry run audits as well and publishes nothing. ``keep`` versions stay; of older ones the manifest goes first, then the data.
    """
    spark = rows.sparkSession
    data = f"data/{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{folder}/{data}")
    stored = spark.read.parquet(f"{folder}/{data}")
    found = audit(stored)
    counts = {r["violation"]: r["count"] for r in found.groupBy("violation").count().collect()}  # a handful of rules
    preview = previews(found, each).collect() if counts else []
    if counts or dry_run:
        place, fs = _place(spark, f"{folder}/{data}")
        fs.delete(place, True)
        if counts:
            raise AuditFailed(counts, preview)
        return None
    known = versions(spark, folder)
    number = max(known, default=0) + 1
    _commit(spark, folder, number, {"data": data, "rows": stored.count()})
    for old in sorted([*known, number])[: -max(keep, 1)]:
        for path in (f"{folder}/manifests/{old:09d}.json", f"{folder}/{known[old]['data']}"):
            place, fs = _place(spark, path)
            fs.delete(place, True)
    return number
