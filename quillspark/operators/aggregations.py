"""Nested bucket and metric aggregations in the Elasticsearch request shape.

Each bucket level is one grouped aggregation that also computes all metrics right under it; the level
below runs only over the buckets that were kept (a broadcast join of at most BUCKETS keys). `level`
functions return DataFrames, `aggregate` assembles the response from those bounded rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

BUCKETS = 65_000
METRICS = {"avg", "value_count", "min", "max", "sum", "stats", "extended_stats", "percentiles", "cardinality"}
BUCKET_KINDS = {"terms", "range", "histogram", "date_histogram", "filter"}
DEFAULT_PERCENTS = [float(p) for p in (1, 5, 25, 50, 75, 95, 99)]
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


class AggregationError(ValueError):
    pass


def interval_ms(text: str) -> int:
    m = re.fullmatch(r"([+-]?\d+)(ms|s|m|h|d)", text)
    if not m:
        raise AggregationError(f"{text!r} isn't an interval in ms, s, m, h or d")
    return int(m.group(1)) * _UNITS[m.group(2)]


def column(df: DataFrame, field: str) -> Column:
    """A column, or a path inside a JSON string column."""
    if field in df.columns:
        return F.col(field)
    name, _, path = field.partition(".")
    if name not in df.columns:
        raise AggregationError(f"unknown field {field!r}")
    from quillspark.functions.text import json_path

    return F.get_json_object(F.col(name), json_path(path))


def _is_array(df: DataFrame, field: str) -> bool:
    return field in df.columns and isinstance(df.schema[field].dataType, ArrayType)


def _number(df: DataFrame, field: str, missing: Any = None) -> Column:
    c = column(df, field)
    kind = df.schema[field].dataType if field in df.columns else StringType()
    if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
        c = F.unix_micros(c.cast("timestamp")) / 1000
    c = c.try_cast("double") if isinstance(kind, StringType) else c.cast("double")
    return c if missing is None else F.coalesce(c, F.lit(float(missing)))


# ---- metrics: columns of a grouped aggregation, and what a row of them means ----

Metric = tuple[dict[str, Column], Callable[[Row], Any]]


def metric(df: DataFrame, name: str, kind: str, spec: dict, exact: bool) -> Metric:
    field, missing = spec.get("field"), spec.get("missing")
    if not field:
        raise AggregationError(f"{kind} needs field")
    p = f"{name}\u0001"
    if kind in ("percentiles", "cardinality") and _is_array(df, field):
        raise AggregationError(f"{kind} of a multi-valued field needs its own request: explode it first")
    if kind == "cardinality":
        c = column(df, field)
        c = c if missing is None else F.coalesce(c, F.lit(missing))
        return {p: F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.005)}, lambda r: {"value": float(r[p])}
    if kind == "percentiles":
        percents = [float(x) for x in spec.get("percents") or DEFAULT_PERCENTS]
        if any(not 0 <= x <= 100 for x in percents):
            raise AggregationError("percents lie between 0 and 100")
        c, at = _number(df, field, missing), F.array(*(F.lit(x / 100) for x in percents))
        keyed = spec.get("keyed", True)

        def values(r: Row) -> dict:
            got = r[p] if r[p] is not None else [math.nan] * len(percents)
            return {"values": {str(x): v for x, v in zip(percents, got)} if keyed else [{"key": x, "value": v} for x, v in zip(percents, got)]}

        return {p: F.percentile(c, at) if exact else F.percentile_approx(c, at, 10_000)}, values
    if _is_array(df, field):
        c = F.transform(F.filter(F.coalesce(F.col(field), F.array().cast(df.schema[field].dataType)), lambda x: x.isNotNull()), lambda x: x.cast("double"))
        if missing is not None:
            c = F.when(F.size(c) == 0, F.array(F.lit(float(missing)))).otherwise(c)
        total = lambda f: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x)))
        parts = {"n": F.sum(F.size(c)), "s": total(lambda x: x), "q": total(lambda x: x * x), "lo": F.min(F.array_min(c)), "hi": F.max(F.array_max(c))}
    elif kind == "value_count" and missing is None:
        c = column(df, field)
        parts = {"n": F.count(c)}
    else:
        c = _number(df, field, missing)
        parts = {"n": F.count(c), "s": F.sum(c), "q": F.sum(c * c), "lo": F.min(c), "hi": F.max(c), "v": F.var_pop(c)}
    need = {"avg": "ns", "value_count": "n", "min": ["lo"], "max": ["hi"], "sum": "s", "stats": ["n", "s", "lo", "hi"], "extended_stats": ["n", "s", "q", "lo", "hi", "v"]}[kind]
    parts = {p + k: parts[k] for k in need if k in parts}

    def value(r: Row) -> dict:
        g = {k: r[p + k] for k in need if p + k in parts}
        n, s = g.get("n") or 0, g.get("s") or 0.0
        if kind == "avg":
            return {"value": s / n if n else None}
        if kind == "value_count":
            return {"value": float(n)}
        if kind in ("min", "max", "sum"):
            return {"value": s if kind == "sum" else next(iter(g.values()))}
        out = {"count": n, "sum": s, "min": g["lo"], "max": g["hi"], "avg": s / n if n else None}
        if kind == "stats":
            return out
        q, sigma = g.get("q") or 0.0, float(spec.get("sigma", 2.0))
        pop = None if n <= 1 else g["v"] if g.get("v") is not None else max(0.0, q / n - (s / n) ** 2)
        samp = pop * n / (n - 1) if pop is not None else None
        root = lambda x: None if x is None else math.sqrt(x)
        bound = lambda x, sign: None if x is None else s / n + sign * sigma * math.sqrt(x)
        bounds = {"upper": bound(pop, 1), "lower": bound(pop, -1), "upper_population": bound(pop, 1), "lower_population": bound(pop, -1), "upper_sampling": bound(samp, 1), "lower_sampling": bound(samp, -1)}
        return out | {"sum_of_squares": q if n else None, "variance": pop, "variance_population": pop, "variance_sampling": samp, "std_deviation": root(pop), "std_deviation_population": root(pop), "std_deviation_sampling": root(samp), "std_deviation_bounds": bounds}

    return parts, value


# ---- buckets: rows with a key column ----


def _ranges(spec: dict) -> list[tuple[str, float | None, float | None]]:
    """Given ranges sorted, gaps and both ends filled."""
    given = sorted(((r.get("key"), r.get("from"), r.get("to")) for r in spec.get("ranges") or []), key=lambda r: -math.inf if r[1] is None else r[1])
    if not given:
        raise AggregationError("range needs ranges")
    name = lambda a, b: f"{'*' if a is None else _text(a)}-{'*' if b is None else _text(b)}"
    out: list[tuple[str, float | None, float | None]] = []
    reached: float | None = None
    for k, (key, a, b) in enumerate(given):
        if k == 0 and a is not None:
            out.append((name(None, a), None, a))
        elif k and (reached is None or a is None or a < reached):
            raise AggregationError("ranges overlap")
        elif k and a > reached:
            out.append((name(reached, a), reached, a))
        out.append((key or name(a, b), a, b))
        reached = b
    if reached is not None:
        out.append((name(reached, None), reached, None))
    return out


def _text(x: float) -> str:
    return str(int(x)) if float(x) == int(x) else str(x)


def bucketed(df: DataFrame, kind: str, spec: dict, key: str, matcher: Callable | None) -> DataFrame:
    """df with the column key; rows outside every bucket are dropped, multi-valued rows come once a bucket."""
    if kind == "filter":
        query = spec.get("query", spec) if isinstance(spec, dict) else spec
        if matcher is None:
            from quillspark.operators.search import Searcher
            from quillspark.plans import ir, querystring

            node = query if isinstance(query, ir.Query) else querystring.parse(query, df.schema, [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]) if isinstance(query, str) else None
            searcher = Searcher(df, df.columns[0])
            node = ir.simplify(node if node is not None else searcher.parsed(query))
            columns = {n: searcher.leaf(n) for n in node.walk() if not n.children()}
            if any(v is None for k, v in columns.items() if not isinstance(k, (ir.All, ir.Empty))):
                raise AggregationError("a filter aggregation takes clauses that can be told from a row")
            test = searcher._combine(node, columns, None)[0]
        else:
            test = matcher(query)
        return df.where(test).withColumn(key, F.lit("filter"))
    field = spec.get("field")
    if not field:
        raise AggregationError(f"{kind} needs field")
    if kind == "terms":
        c = F.explode_outer(column(df, field)) if _is_array(df, field) else column(df, field)
        out = df.withColumn(key, c)
        if spec.get("missing") is not None:
            out = out.withColumn(key, F.coalesce(F.col(key), F.lit(spec["missing"]).cast(out.schema[key].dataType)))
        out = out.where(F.col(key).isNotNull())
        for name, keep in (("include", True), ("exclude", False)):
            if (want := spec.get(name)) is not None:
                test = F.col(key).cast("string").rlike(f"^(?:{want})$") if isinstance(want, str) else F.col(key).isin(list(want))
                out = out.where(test if keep else ~test)
        return out
    if kind == "range":
        rows = df.withColumn(key, F.explode(F.col(field))) if _is_array(df, field) else df
        c = F.col(key).cast("double") if _is_array(df, field) else _number(df, field)
        pick = None
        for k, (_, a, b) in enumerate(_ranges(spec)):
            test = F.lit(True)
            if a is not None:
                test = test & (c >= float(a))
            if b is not None:
                test = test & (c < float(b))
            pick = F.when(test & c.isNotNull(), F.lit(k)) if pick is None else pick.when(test & c.isNotNull(), F.lit(k))
        return rows.withColumn(key, pick).where(F.col(key).isNotNull())
    width, offset, bounds = _histogram(kind, spec)
    rows = df.withColumn(key, F.explode(F.col(field))) if _is_array(df, field) else df
    c = _number(rows, key) if _is_array(df, field) else _number(df, field, spec.get("missing"))
    if bounds.get("hard_bounds"):
        lo, hi = bounds["hard_bounds"]["min"], bounds["hard_bounds"]["max"]
        rows = rows.where((c >= float(lo)) & (c <= float(hi)))
    return rows.withColumn(key, F.floor((c - offset) / width) * width + offset).where(F.col(key).isNotNull())


def _histogram(kind: str, spec: dict) -> tuple[float, float, dict]:
    if kind == "date_histogram":
        if bad := {"interval", "calendar_interval", "format"} & set(spec):
            raise AggregationError(f"unsupported: {', '.join(sorted(bad))}")
        if "fixed_interval" not in spec:
            raise AggregationError("date_histogram needs fixed_interval")
        width, offset = float(interval_ms(spec["fixed_interval"])), float(interval_ms(spec["offset"]) if spec.get("offset") else 0)
    else:
        width, offset = float(spec.get("interval") or 0), float(spec.get("offset") or 0)
    if width <= 0:
        raise AggregationError("the interval must be positive")
    hard, more = spec.get("hard_bounds"), spec.get("extended_bounds")
    if more and spec.get("min_doc_count", 0) > 0:
        raise AggregationError("extended_bounds need min_doc_count 0")
    if hard and more and (more["min"] < hard["min"] or more["max"] > hard["max"]):
        raise AggregationError("extended_bounds lie inside hard_bounds")
    return width, offset, {"hard_bounds": hard, "extended_bounds": more}


def level(df: DataFrame, keys: list[str], metrics: dict[str, Metric]) -> DataFrame:
    """One row per combination of keys: doc_count and all metric columns."""
    columns = [F.count(F.lit(1)).alias("doc_count")] + [c.alias(a) for parts, _ in metrics.values() for a, c in parts.items()]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def terms_frame(df: DataFrame, spec: dict, metrics: dict[str, Metric] | None = None, parents: list[str] | None = None, key: str = "key") -> DataFrame:
    """Kept terms with doc_count, other (documents of the terms that were cut, per parent) and metrics; ordered cuts run in Spark."""
    parents, metrics = parents or [], metrics or {}
    least = spec.get("min_doc_count", 1)
    groups = level(bucketed(df, "terms", spec, key, None), [*parents, key], metrics)
    if least == 0 and not parents:  # all terms of the column
        every = bucketed(df, "terms", {k: v for k, v in spec.items() if k != "missing"}, key, None).select(key).distinct()
        groups = every.join(groups, key, "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
    groups = groups.where(F.col("doc_count") >= least)
    by, way = next(iter((spec.get("order") or {"_count": "desc"}).items()))
    if by == "_count":
        order = F.col("doc_count")
    elif by == "_key":
        order = F.col(key)
    else:
        name, _, part = by.partition(".")
        if name not in metrics:
            raise AggregationError(f"order by unknown metric {by!r}")
        aliases = list(metrics[name][0])
        short = {"count": "n", "sum": "s", "min": "lo", "max": "hi", "variance": "v"}.get(part)
        if part == "avg" or not part and {f"{name}\u0001n", f"{name}\u0001s"} <= set(aliases) and len(aliases) == 2:
            order = F.col(f"{name}\u0001s") / F.col(f"{name}\u0001n")
        elif part and short is None:
            order = F.element_at(F.col(aliases[0]), 1) if aliases else F.lit(None)
        else:
            order = F.col(f"{name}\u0001{short}" if part else aliases[0])
        order = F.coalesce(order.cast("double"), F.lit(-1.7976931348623157e308))
    sort = [order.asc() if way == "asc" else order.desc(), F.col(key).asc()]
    size = int(spec.get("size", 10))
    if parents:
        window = Window.partitionBy(*parents)
        ranked = groups.withColumns({"rank": F.row_number().over(window.orderBy(*sort)), "total": F.sum("doc_count").over(window)})
        kept = ranked.where(F.col("rank") <= size)
        return kept.withColumn("other", F.col("total") - F.sum("doc_count").over(window))
    kept = groups.orderBy(*sort).limit(size)
    total = groups.agg(F.sum("doc_count")).first()[0] or 0
    return kept.withColumns({"total": F.lit(int(total)).cast("long"), "rank": F.row_number().over(Window.orderBy(*sort))})  # at most size rows


def aggregate(df: DataFrame, request: dict, exact: bool = False, matcher: Callable | None = None) -> dict:
    """The response of a request. exact: exact percentiles and cardinalities instead of sketches."""
    return _run(df, request, [], exact, matcher).get((), _empty(df, request, exact))


def _split(df: DataFrame, request: dict, exact: bool) -> tuple[dict[str, Metric], dict[str, tuple[str, dict, dict]], dict[str, dict]]:
    metrics, buckets, hits = {}, {}, {}
    for name, body in request.items():
        sub = body.get("aggs") or body.get("aggregations") or {}
        kinds = [k for k in body if k not in ("aggs", "aggregations")]
        if len(kinds) != 1:
            raise AggregationError(f"{name!r} needs exactly one aggregation")
        kind = kinds[0]
        if kind in METRICS:
            metrics[name] = metric(df, name, kind, body[kind], exact)
        elif kind in BUCKET_KINDS:
            buckets[name] = kind, body[kind], sub
        elif kind == "top_hits":
            hits[name] = body[kind]
        else:
            raise AggregationError(f"unknown aggregation {kind!r}")
    return metrics, buckets, hits


def _empty(df: DataFrame, request: dict, exact: bool) -> dict:
    metrics, buckets, hits = _split(df, request, exact)

    class Nothing(dict):
        def __missing__(self, key):
            return None

    out: dict[str, Any] = {}
    for name, (parts, value) in metrics.items():
        out[name] = value(Nothing({k: 0 if k.endswith("\u0001n") else None for k in parts})) if not (len(parts) == 1 and next(iter(parts)).endswith("\u0001") and "cardinality" in request[name]) else {"value": 0.0}
    for name, (kind, spec, sub) in buckets.items():
        out[name] = {"doc_count": 0, **_empty(df, sub, exact)} if kind == "filter" else {"buckets": []} | ({"sum_other_doc_count": 0, "doc_count_error_upper_bound": 0} if kind == "terms" else {})
    return out | {name: {"hits": []} for name in hits}


def _run(df: DataFrame, request: dict, parents: list[str], exact: bool, matcher: Callable | None) -> dict[tuple, dict]:
    """Response by values of the parent keys."""
    metrics, buckets, hits = _split(df, request, exact)
    out: dict[tuple, dict] = {}
    if metrics or not parents:
        for r in level(df, parents, metrics).collect():
            out[tuple(r[k] for k in parents)] = {name: value(r) for name, (_, value) in metrics.items()}
    for name, spec in hits.items():
        for path, found in _top_hits(df, spec, parents).items():
            out.setdefault(path, {})[name] = {"hits": found}
    for name, (kind, spec, sub) in buckets.items():
        key = f"key{len(parents)}"
        inner, _, _ = _split(df, {k: v for k, v in sub.items() if next(x for x in v if x not in ("aggs", "aggregations")) in METRICS}, exact)
        rows = bucketed(df, kind, spec, key, matcher)
        if kind == "terms":
            grouped = terms_frame(df, spec, inner, parents, key).orderBy("rank").limit(BUCKETS + 1).collect()
        else:
            grouped = level(rows, [*parents, key], inner).limit(BUCKETS + 1).collect()
        if len(grouped) > BUCKETS:
            raise AggregationError(f"more than {BUCKETS} buckets")
        deeper = {k: v for k, v in sub.items() if k not in inner}
        below: dict[tuple, dict] = {}
        if deeper and grouped:
            kept = df.sparkSession.createDataFrame([tuple(r[k] for k in [*parents, key]) for r in grouped], rows.select(*parents, key).schema)
            below = _run(rows.join(F.broadcast(kept), [*parents, key], "left_semi"), deeper, [*parents, key], exact, matcher)
        by_parent: dict[tuple, list[Row]] = {}
        for r in grouped:
            by_parent.setdefault(tuple(r[k] for k in parents), []).append(r)
        for path in set(by_parent) | (set(out) if kind in ("range", "filter") else set()) or {()}:
            made = {r[key]: {"doc_count": r["doc_count"], **{m: v(r) for m, (_, v) in inner.items()}, **below.get((*path, r[key]), _empty(df, deeper, exact))} for r in by_parent.get(path, [])}
            out.setdefault(path, {})[name] = _assembled(df, kind, spec, made, by_parent.get(path, []), lambda sub=sub: {"doc_count": 0, **_empty(df, sub, exact)})
    return out


def _assembled(df: DataFrame, kind: str, spec: dict, made: dict, rows: list[Row], nothing: Callable[[], dict]) -> dict:
    if kind == "filter":
        return made.get("filter") or nothing()
    if kind == "terms":
        boolean = spec["field"] in df.columns and isinstance(df.schema[spec["field"]].dataType, BooleanType)
        kept = [{"key": int(k) if boolean else k, **({"key_as_string": str(k).lower()} if boolean else {}), **v} for k, v in made.items()]
        total = rows[0]["total"] if rows else 0
        return {"buckets": kept, "sum_other_doc_count": (total or 0) - sum(r["doc_count"] for r in rows), "doc_count_error_upper_bound": 0}
    if kind == "range":
        out = []
        for k, (name, a, b) in enumerate(_ranges(spec)):
            out.append({"key": name, **({"from": float(a)} if a is not None else {}), **({"to": float(b)} if b is not None else {}), **(made.get(k) or nothing())})
        return {"buckets": {b["key"]: {k: v for k, v in b.items() if k != "key"} for b in out} if spec.get("keyed") else out}
    width, offset, bounds = _histogram(kind, spec)
    least, keys = spec.get("min_doc_count", 0), sorted(made)
    if least == 0:
        ends = list(keys)
        if bounds["extended_bounds"]:
            ends += [math.floor((float(bounds["extended_bounds"][e]) - offset) / width) * width + offset for e in ("min", "max")]
        if ends:
            n = round((max(ends) - min(ends)) / width) + 1
            if n > BUCKETS:
                raise AggregationError(f"more than {BUCKETS} buckets")
            keys = [min(ends) + k * width for k in range(n)]
    out = []
    for k in keys:
        body = made.get(k) or nothing()
        if body["doc_count"] >= least:
            stamp = {"key_as_string": datetime.fromtimestamp(k / 1000, UTC).isoformat().replace("+00:00", "Z")} if kind == "date_histogram" else {}
            out.append({"key": k, **stamp, **body})
    return {"buckets": {str(b["key"]): b for b in out} if spec.get("keyed") else out}


def top_hits_frame(df: DataFrame, spec: dict, parents: list[str]) -> DataFrame:
    """The first rows of each bucket by the sort given, with rank and the wanted fields (globs allowed)."""
    if bad := {"_source", "fields", "script_fields", "highlight", "explain", "version"} & set(spec):
        raise AggregationError(f"unsupported: {', '.join(sorted(bad))}")
    sort = [next(iter(s.items())) for s in spec.get("sort") or []]
    order = [F.col(f).asc_nulls_last() if (w if isinstance(w, str) else w.get("order")) == "asc" else F.col(f).desc_nulls_last() for f, w in sort] or [F.lit(0)]
    start, size = int(spec.get("from", 0)), int(spec.get("size", 3))
    wanted = [p if isinstance(p, str) else p["field"] for p in spec.get("docvalue_fields") or []]
    names = [c for c in df.columns if c not in parents and any(re.fullmatch(re.escape(p).replace(r"\*", ".*"), c) for p in wanted)]
    if not parents:
        top = df.orderBy(*order).limit(start + size)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > start).select("rank", *dict.fromkeys([*names, *(f for f, _ in sort)]))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*parents).orderBy(*order)))
    return ranked.where((F.col("rank") > start) & (F.col("rank") <= start + size)).select(*parents, "rank", *dict.fromkeys([*names, *(f for f, _ in sort)]))


def _top_hits(df: DataFrame, spec: dict, parents: list[str]) -> dict[tuple, list[dict]]:
    out: dict[tuple, list[dict]] = {}
    sort = [next(iter(s)) for s in spec.get("sort") or []]
    for r in top_hits_frame(df, spec, parents).orderBy(*parents, "rank").collect():
        names = [c for c in r.asDict() if c not in parents and c != "rank"]
        out.setdefault(tuple(r[k] for k in parents), []).append({"sort": [r[f] for f in sort], "docvalue_fields": {n: r[n] for n in names if n not in sort or n in names}})
    return out


