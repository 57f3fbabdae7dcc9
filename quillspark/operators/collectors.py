"""What is done with matching rows: sorted pages, counts, facets, histograms, filters, several at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Null placement of the sort orders.
ORDERS: dict[str, Callable[[Column], Column]] = {
    "natural": lambda c: c.desc_nulls_last(),
    "reverse": lambda c: c.asc_nulls_first(),
    "reverse_none_lower": lambda c: c.asc_nulls_last(),
    "natural_none_higher": lambda c: c.desc_nulls_first(),
}


def order_by(df: DataFrame, keys: list[tuple[str | Column, str]], limit: int, offset: int = 0, id_col: str = "_node_id") -> DataFrame:
    """A page sorted by several keys, ties by id."""
    sort = [ORDERS[way](F.col(k) if isinstance(k, str) else k) for k, way in keys] + [F.col(id_col).asc()]
    out = df.orderBy(*sort)
    return (out.offset(offset) if offset else out).limit(limit)


def tweak_score(found: DataFrame, docs: DataFrame, score: Callable[[Column], Column] | Column, id_col: str = "_node_id") -> DataFrame:
    """found (id, score) with a new score from the old one and the document's columns."""
    rows = docs.join(found, id_col)
    return rows.select(id_col, (score if isinstance(score, Column) else score(F.col("score"))).alias("score"))


def count(df: DataFrame) -> int:
    return df.count()


def doc_set(found: DataFrame, id_col: str = "_node_id") -> DataFrame:
    return found.select(id_col)


def filtered(df: DataFrame, test: Column) -> DataFrame:
    return df.where(test)


def multi(df: DataFrame, collectors: dict[str, Callable[[DataFrame], object]]) -> dict[str, object]:
    """Several collectors over one materialised set of matches."""
    kept = df.persist()
    try:
        return {name: f(kept) for name, f in collectors.items()}
    finally:
        kept.unpersist()


def histogram(df: DataFrame, field: str, least: float, width: float, buckets: int) -> DataFrame:
    """bucket (from 0), count; every bucket is there, values outside of all are left out."""
    at = F.floor((F.col(field) - F.lit(least)) / F.lit(width))
    counts = df.where((at >= 0) & (at < buckets)).groupBy(at.cast("int").alias("bucket")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"))


def facets(df: DataFrame, field: str, roots: list[str], id_col: str = "_node_id") -> DataFrame:
    """root, facet (a direct child of it), count of documents; field is a path or an array of paths."""
    paths = F.explode(F.col(field)) if df.schema[field].dataType.typeName() == "array" else F.col(field)
    rows = df.select(F.col(id_col).alias("id"), paths.alias("path"))
    depth = lambda r: len([p for p in r.split("/") if p])
    found = [F.when(F.col("path").startswith(r.rstrip("/") + "/"), F.struct(F.lit(r).alias("root"), F.concat(F.lit("/"), F.array_join(F.slice(F.split(F.col("path"), "/"), 2, depth(r) + 1), "/")).alias("facet"))) for r in roots]
    rows = rows.select("id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.root", "f.facet")
    return rows.distinct().groupBy("root", "facet").agg(F.count("*").alias("count"))


def top_facets(counts: DataFrame, root: str, k: int) -> DataFrame:
    return counts.where(F.col("root") == root).orderBy(F.desc("count"), "facet").limit(k)
