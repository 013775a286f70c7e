"""Cross-site boilerplate lines: a HyperLogLog sketch of sites per line hash, exact counts near the threshold.

Sketches are built before the shuffle and merged after it, so a line that stands in every document costs one
row a task. Estimates within ``near`` of the threshold are settled by an exact distinct count; lines that
stand on ``min_sites`` sites or more are cut from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Boilerplate lines that travel in the plan; beyond it they are joined.
IN_PLAN = 50_000
BLANKS = " \t\r\f\x0b"


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select(F.col("source").cast("string").alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("site is not null").select("site", F.trim("line", F.lit(BLANKS)).alias("line")).where("line <> ''").select("site", F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = 10, near: float = 0.5, lg_k: int = 10) -> DataFrame:
    """``h`` of the lines that stand on at least ``min_sites`` distinct sites (values of ``source``)."""
    lines = _lines(docs)
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sites")).select("h", F.hll_sketch_estimate("sites").alias("n"))
    lo, hi = min_sites * (1 - near), min_sites * (1 + near)
    found = C.cut(sketched.where(F.col("n") >= F.lit(lo)))
    close = found.where(F.col("n") < F.lit(hi)).select("h")
    if close.count() <= IN_PLAN:
        close = F.broadcast(close)
    exact = lines.join(close, "h", "left_semi").distinct().groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    return C.cut(found.where(F.col("n") >= F.lit(hi)).select("h").unionByName(exact))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, near: float = 0.5, lg_k: int = 10, count: str | None = "n_removed_lines") -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and their number in ``count`` if that is given.

    Lines end at ``\\n`` and are compared without blanks at their ends; blank lines are never cut. A null source
    is no site, but its documents are cleaned too. A null text stays null with 0 removed; a text of
    boilerplate alone becomes empty. Rows, their other columns and their number stay as they are, except
    that ``n_chars``, where there is one, follows the text.
    """
    bad = boilerplate(docs, min_sites, near, lg_k)
    if bad.count() <= IN_PLAN:
        keys = [r.h for r in bad.collect()]
        kept = F.filter(F.split("text", "\n"), lambda x: ~_hash(x).isin(keys)) if keys else F.split("text", "\n")
        out = docs.withColumn("_dw_kept", kept)
        if count:
            out = out.withColumn(count, F.coalesce(F.size(F.split("text", "\n")) - F.size("_dw_kept"), F.lit(0)))
        out = out.withColumn("text", F.array_join("_dw_kept", "\n")).drop("_dw_kept")
    else:
        key = [F.xxhash64("text").alias("_dw_k"), F.length("text").alias("_dw_n")]
        each = docs.where("text is not null").select(*key, F.posexplode(F.split("text", "\n")).alias("_dw_at", "line")).distinct()
        cuts = each.withColumn("h", _hash(F.col("line"))).join(bad, "h", "left_semi").groupBy("_dw_k", "_dw_n").agg(F.collect_set("_dw_at").alias("_dw_cut"))
        out = docs.select("*", *key).join(cuts, ["_dw_k", "_dw_n"], "left")
        if count:
            out = out.withColumn(count, F.when(F.col("_dw_cut").isNull(), 0).otherwise(F.size("_dw_cut")))
        kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_dw_cut", i))
        out = out.withColumn("text", F.when(F.col("_dw_cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_dw_k", "_dw_n", "_dw_cut")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
