"""Registered queries of the search and analytics engine over the test tables, with their SQL oracles."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import aggregations as aggs
from quillspark.operators import collectors, snippets
from quillspark.operators.search import Searcher, top_k
from quillspark.plans import ir, querystring
from quillspark.sources.index import Index
from quillspark.sources.storage import Storage
from quillspark.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> Searcher:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_node_id"), F.col("text").alias("body"), "lang", "source", "n_chars")
    return Searcher(docs, analyzers=dict(lang="raw", source="raw"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("_node_id", F.round("score", 6).alias("score"))


# ---- scored text queries ----

_BASE = r"""
WITH s AS (SELECT doc_id AS _node_id, lower(text) AS t, lang, source, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM s)"""


def _tf(leaf: tuple) -> str:
    kind, value = leaf
    if kind == "contains":  # values that don't overlap themselves
        return f"((length(t) - length(replace(t, '{value}', ''))) // {len(value)})"
    if kind == "term":
        return f"len(list_filter(ts, lambda x: x = '{value}'))"
    if kind == "starts":
        return f"len(list_filter(ts, lambda x: starts_with(x, '{value}')))"
    if kind == "phrase":
        a, b = value
        return f"len(list_filter(range(1, len(ts)), lambda i: ts[i] = '{a}' AND ts[i + 1] = '{b}'))"
    if kind == "phrase_prefix":
        a, b = value
        return f"len(list_filter(range(1, len(ts)), lambda i: ts[i] = '{a}' AND starts_with(ts[i + 1], '{b}')))"
    if kind == "between":
        a, b = value
        return f"len(list_filter(ts, lambda x: x >= '{a}' AND x < '{b}' AND strlen(x) < 40))"
    if kind == "regex":
        return f"len(regexp_extract_all(t, '{value}', 0, 's'))"
    raise ValueError(kind)


def _bm25(tf: str, idf: str) -> str:
    return f"({idf} * 2.2 * {tf} / ({tf} + 1.2 * (0.25 + 0.75 * len(ts) / a)))"


def _idf(df: str) -> str:
    return f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5))"


def _scored_sql(leaves: list[tuple], where: str, score: str, tail: str = "") -> str:
    """where and score use m0, m1, ... (whether a leaf matches) and s0, s1, ... (its BM25, 0 if not)."""
    m = _BASE + ", l AS (SELECT *, " + ", ".join(f"{_tf(x)} AS f{k}" for k, x in enumerate(leaves)) + " FROM s)"
    m += ", d AS (SELECT " + ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(leaves))) + " FROM l)"
    cols = ", ".join(f"f{k} > 0 AS m{k}, CASE WHEN f{k} > 0 THEN {_bm25(f'f{k}', _idf(f'd{k}'))} ELSE 0 END AS s{k}" for k in range(len(leaves)))
    return f"{m}, p AS (SELECT l.*, {cols} FROM l, st, d) SELECT _node_id, round({score}, 6) AS score FROM p WHERE {where} {tail}"


def _text_query(name: str, query, leaves: list[tuple] | None = None, where: str = "m0", score: str = "s0") -> None:
    @_add(name, _scored_sql(leaves, where, score) if leaves else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(documents(spark, sf_dir).run(query() if callable(query) else query))


_C = lambda v, **k: dict(type="contains", field="body", value=v, **k)
_text_query("contains", _C("tion"), [("contains", "tion")])
_text_query("starts_with", dict(type="startsWith", field="body", value="ver"), [("starts", "ver")])
_text_query("term", dict(type="term", field="body", value="the"), [("term", "the")])
_text_query("term_query", ir.Term("body", "und"), [("term", "und")])
_text_query("contains_split", dict(type="contains_split", field="body", value="tion heit"), [("contains", "tion"), ("contains", "heit")], "m0 OR m1", "s0 + s1")
_text_query("starts_with_split", dict(type="startsWith_split", field="body", value="ver une"), [("starts", "ver"), ("starts", "une")], "m0 OR m1", "s0 + s1")
_text_query("string_shortcut", "tion heit", [("contains", "tion"), ("contains", "heit")], "m0 OR m1", "s0 + s1")
_text_query("contains_phrase", dict(type="phrase", field="body", value="of the"))
_text_query("contains_strict_separators", _C("of the", strict_separators=True), [("contains", "of the")])
_text_query("term_set", ir.TermSet("body", ("und", "the", "avec")), [("term", "und"), ("term", "the"), ("term", "avec")], "m0 OR m1 OR m2", "s0 + s1 + s2")
_text_query("regex_contains", dict(type="regex", field="body", value="token = .[0-9a-f]+"), [("regex", "token = .[0-9a-f]+")])
_text_query("regex_gap", dict(type="contains", field="body", value="tion[a-z]*ing", regex=True), [("regex", "tion[a-z]*ing")])
_text_query("phrase_prefix_query", ir.PhrasePrefix("body", ("of", "th")), [("phrase_prefix", ("of", "th"))])
_text_query("boolean", dict(type="boolean", must=[_C("tion")], should=[_C("ing")], must_not=[_C("heit")]), [("contains", "tion"), ("contains", "ing"), ("contains", "heit")], "m0 AND NOT m2", "s0 + s1")
_text_query("boolean_should_only", dict(type="boolean", should=[_C("tion"), _C("heit"), _C("que")]), [("contains", "tion"), ("contains", "heit"), ("contains", "que")], "m0 OR m1 OR m2", "s0 + s1 + s2")
_text_query("boolean_min_should", ir.Bool(should=(ir.Term("body", "the"), ir.Term("body", "de"), ir.Term("body", "in")), min_should=2), [("term", "the"), ("term", "de"), ("term", "in")], "m0::int + m1::int + m2::int >= 2", "s0 + s1 + s2")
_text_query("boolean_all_should", ir.Bool(should=(ir.Term("body", "the"), ir.Term("body", "in")), min_should=2), [("term", "the"), ("term", "in")], "m0 AND m1", "s0 + s1")
_text_query("dis_max", dict(type="disjunction_max", queries=[_C("tion"), _C("heit")], tie_breaker=0.3), [("contains", "tion"), ("contains", "heit")], "m0 OR m1", "greatest(s0, s1) + 0.3 * (s0 + s1 - greatest(s0, s1))")
_text_query("boost", ir.Boost(ir.Term("body", "the"), 2.5), [("term", "the")], "m0", "2.5 * s0")
_text_query("const_score", ir.Const(ir.Term("body", "the"), 3.0), [("term", "the")], "m0", "3.0::double")
_text_query("filters", dict(**_C("tion"), filters=[dict(field="n_chars", op="between", value=[500, 5000]), dict(field="lang", op="in", value=["en", "fr"]), dict(field="source", op="ne", value="src0")]), [("contains", "tion")], "m0 AND n_chars BETWEEN 500 AND 5000 AND lang IN ('en', 'fr') AND source IS DISTINCT FROM 'src0'", "s0")
_text_query("filters_nested", dict(**_C("tion"), filters=[dict(op="should", clauses=[dict(field="n_chars", op="lt", value=500), dict(field="source", op="starts_with", value="src1")]), dict(op="must_not", clauses=[dict(field="lang", op="eq", value="de")])]), [("contains", "tion")], "m0 AND (n_chars < 500 OR starts_with(source, 'src1')) AND lang IS DISTINCT FROM 'de'", "s0")
_text_query("filters_comparisons", dict(**_C("tion"), filters=[dict(field="n_chars", op="gte", value=200), dict(field="n_chars", op="lte", value=9000), dict(field="n_chars", op="gt", value=100), dict(field="lang", op="not_in", value=["es"]), dict(field="lang", op="eq", value="en"), dict(field="body", op="contains", value="the")]), [("contains", "tion"), ("contains", "the")], "m0 AND m1 AND n_chars >= 200 AND n_chars <= 9000 AND n_chars > 100 AND (lang NOT IN ('es') OR lang IS NULL) AND lang = 'en'", "s0")
_text_query("fuzzy_contains", dict(type="fuzzy", field="body", value="mail example", distance=1))
_text_query("phrase_slop", ir.Phrase("body", ("of", "the"), 2))
_text_query("more_like_this", dict(type="more_like_this", fields=["body"], value="the tion of the tion and of schach schach", min_doc_frequency=2))
_text_query("regex_phrase", ir.RegexPhrase("body", ("th.*", "of")))
_sql["regex_phrase"] = _scored_sql([("phrase", ("th", "of"))], "m0", "s0").replace("ts[i] = 'th'", "starts_with(ts[i], 'th')")

_PHRASE_IDF = _scored_sql([("phrase", ("of", "the")), ("term", "of"), ("term", "the")], "m0", _bm25("f0", f"({_idf('d1')} + {_idf('d2')})"))
_text_query("phrase_query", ir.Phrase("body", ("of", "the")))
_sql["phrase_query"] = _PHRASE_IDF.replace("l.*,", "l.*, n, a, d1, d2,")
#: Up to two words between, or one swapped; words of 40 bytes or more aren't indexed.
_sql["phrase_slop"] = _BASE + f""", u AS (SELECT _node_id, unnest(us) AS token, generate_subscripts(us, 1) AS i FROM (SELECT _node_id, list_filter(ts, lambda x: strlen(x) < 40) AS us FROM s)),
w AS (SELECT _node_id, token, [lag(token) OVER o, lead(token) OVER o, lead(token, 2) OVER o, lead(token, 3) OVER o] AS near FROM u WINDOW o AS (PARTITION BY _node_id ORDER BY i)),
f AS (SELECT _node_id, count(*) FILTER (token = 'of' AND list_contains(near, 'the')) AS f0, count(*) FILTER (token = 'of') AS f1, count(*) FILTER (token = 'the') AS f2 FROM w GROUP BY _node_id),
d AS (SELECT count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM f)
SELECT _node_id, round({_bm25('f0', f"({_idf('d1')} + {_idf('d2')})")}, 6) AS score FROM f JOIN s USING (_node_id), st, d WHERE f0 > 0"""
_sql["contains_phrase"] = _scored_sql([("phrase", ("of", "the"))], "m0", "s0").replace("ts[i] = 'of'", "ends_with(ts[i], 'of')").replace("ts[i + 1] = 'the'", "starts_with(ts[i + 1], 'the')")


def _expanded_sql(test: str) -> str:
    return _BASE + f""", h AS (SELECT _node_id, len(any_value(ts)) AS dl, token, count(*) AS tf FROM (SELECT _node_id, ts, unnest(ts) AS token FROM s) WHERE {test} GROUP BY _node_id, token),
df AS (SELECT token, count(*) AS df FROM h GROUP BY token)
SELECT _node_id, round(sum({_idf('df')} * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM h JOIN df USING (token), st GROUP BY _node_id"""


_text_query("regex_term", ir.RegexTerm("body", "sch[a-z]+"))
_sql["regex_term"] = _expanded_sql("regexp_full_match(token, 'sch[a-z]+')")
_text_query("fuzzy_term", ir.FuzzyTerm("body", "their", 1, False))
_sql["fuzzy_term"] = _expanded_sql("levenshtein(token, 'their') <= 1")
_text_query("fuzzy_term_transpose", ir.FuzzyTerm("body", "tokne", 1, True))
_sql["fuzzy_term_transpose"] = _expanded_sql("damerau_levenshtein(token, 'tokne') <= 1")
_text_query("fuzzy_term_prefix", ir.FuzzyTerm("body", "token", 1, False, True))
_sql["fuzzy_term_prefix"] = _expanded_sql("least(levenshtein(token[:4], 'token'), levenshtein(token[:5], 'token'), levenshtein(token[:6], 'token')) <= 1")


#: Terms of the text that occur twice in it and in two documents, each weighing its frequency in the text times its idf, against the heaviest.
_sql["more_like_this"] = _BASE + f""", q(token, c) AS (VALUES ('the', 2), ('tion', 2), ('of', 2), ('schach', 2)),
h AS (SELECT _node_id, len(any_value(ts)) AS dl, token, count(*) AS tf FROM (SELECT _node_id, ts, unnest(ts) AS token FROM s) JOIN q USING (token) GROUP BY _node_id, token),
df AS (SELECT token, any_value(c) AS c, count(*) AS df FROM h JOIN q USING (token) GROUP BY token HAVING count(*) >= 2),
w AS (SELECT token, {_idf('df')} AS idf, c * {_idf('df')} AS weight FROM df, st),
m AS (SELECT token, idf, weight / max(weight) OVER () AS boost FROM w)
SELECT _node_id, round(sum(boost * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM h JOIN m USING (token), st GROUP BY _node_id"""
_text_query("phrase_prefix", dict(type="phrase_prefix", field="body", value="of the"))
_sql["phrase_prefix"] = _sql["contains_phrase"]
_text_query("parse", dict(type="parse", field="body", value="tion"), [("contains", "tion")])
_text_query("boolean_query_string", dict(type="query_string", value="the AND NOT und", fields=["body"]), [("term", "the"), ("term", "und")], "m0 AND NOT m1", "s0")
_text_query("range_terms", ir.Range("body", "ma", "mf", True, False), [("between", ("ma", "mf"))], "m0", "1.0::double")
_text_query("filter_contains_only", dict(type="boolean", must=[_C("tion")], should=[dict(type="term", field="body", value="the")], filters=[dict(field="source", op="in", value=["src1", "src2"])]), [("contains", "tion"), ("term", "the")], "m0 AND source IN ('src1', 'src2')", "s0 + s1")
_text_query("boost_nested", ir.Boost(ir.DisMax((ir.Term("body", "the"), ir.Boost(ir.Term("body", "und"), 3.0)), 0.0), 2.0), [("term", "the"), ("term", "und")], "m0 OR m1", "2 * greatest(s0, 3 * s1)")
_text_query("must_not_all", ir.Bool(must=(ir.Term("body", "the"),), must_not=(ir.All(),)), [("term", "the")], "false", "s0")
_text_query("should_with_all", ir.Bool(should=(ir.All(), ir.Term("body", "the"))), [("term", "the")], "true", "1 + s0")


@_add("empty_query", "SELECT doc_id AS _node_id, 0.0::double AS score FROM documents WHERE false")
def _empty(spark, sf_dir):
    return _rounded(documents(spark, sf_dir).run(ir.Empty()))


@_add("all_query", "SELECT doc_id AS _node_id, 1.0::double AS score FROM documents")
def _all(spark, sf_dir):
    return _rounded(documents(spark, sf_dir).run(ir.All()))


@_add("range_query", "SELECT doc_id AS _node_id, 1.0::double AS score FROM documents WHERE n_chars >= 300 AND n_chars < 900")
def _range(spark, sf_dir):
    return _rounded(documents(spark, sf_dir).run(ir.Range("n_chars", 300, 900, True, False)))


@_add("exists_json", "SELECT event_id AS _node_id, 1.0::double AS score FROM events WHERE json_extract(props, '$.k') IS NOT NULL OR json_extract(props, '$.page') IS NOT NULL")
def _exists(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_id", "_node_id")
    return _rounded(Searcher(rows, analyzers=dict(props="raw", event_type="raw")).run(ir.Const(ir.Bool(should=(ir.Exists("props.k"), ir.Exists("props.page"))), 1.0)))


def _parsed(name: str, source: str, leaves: list[tuple], where: str, score: str) -> None:
    @_add(name, _scored_sql(leaves, where, score))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = documents(spark, sf_dir)
        return _rounded(s.run(querystring.parse(source, s.docs.schema, ["body"])))


_parsed("query_string_and_not", "the AND in -und", [("term", "the"), ("term", "in"), ("term", "und")], "m0 AND m1 AND NOT m2", "s0 + s1")
_parsed("query_string_boost", "the^2 und", [("term", "the"), ("term", "und")], "m0 OR m1", "2 * s0 + s1")
_parsed("query_string_range", "+the +n_chars:[500 TO 2000]", [("term", "the")], "m0 AND n_chars BETWEEN 500 AND 2000", "s0 + 1")
_parsed("query_string_set", "+und +lang: IN [de fr]", [("term", "und")], "m0 AND lang IN ('de', 'fr')", "s0 + 1")


_parsed("query_string_phrase", '"of the"', [("phrase", ("of", "the")), ("term", "of"), ("term", "the")], "m0", _bm25("f0", f"({_idf('d1')} + {_idf('d2')})"))
_sql["query_string_phrase"] = _sql["query_string_phrase"].replace("l.*,", "l.*, n, a, d1, d2,")
_parsed("query_string_slop", '"of the"~2', [("term", "the")], "m0", "s0")
_sql["query_string_slop"] = _sql["phrase_slop"]
_parsed("query_string_prefix", '"of th"*', [("phrase_prefix", ("of", "th"))], "m0", "s0")
_parsed("query_string_exists", "+the +lang:*", [("term", "the")], "m0 AND lang IS NOT NULL", "s0 + 1")
_parsed("query_string_all", "*", [("term", "the")], "true", "1.0::double")
_parsed("query_string_group", "lang:(en de) AND the", [("term", "the")], "m0 AND lang IN ('en', 'de')", "s0 + 1")
_parsed("query_string_open_range", "+the +n_chars:>5000", [("term", "the")], "m0 AND n_chars > 5000", "s0 + 1")
_parsed("query_string_escape", r"of\-the", [("term", "the")], "m0", "s0")
_sql["query_string_escape"] = _sql["query_string_phrase"]
_parsed("query_string_regex", "body:/sch[a-z]+/", [("term", "the")], "m0", "s0")
_sql["query_string_regex"] = _sql["regex_term"]


@_add("query_string_lenient", _scored_sql([("term", "the"), ("term", "und")], "m0 AND m1", "s0 + s1"))
def _lenient(spark, sf_dir):
    s = documents(spark, sf_dir)
    query, _ = querystring.parse_lenient("the AND (und nosuch:x [a", s.docs.schema, ["body"])
    return _rounded(s.run(query))


# ---- results ----


@_add("top_k", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 20"))
def _top(spark, sf_dir):
    return _rounded(top_k(documents(spark, sf_dir).run(_C("tion")), 20))


@_add("top_k_offset", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 20 OFFSET 30"))
def _offset(spark, sf_dir):
    return _rounded(top_k(documents(spark, sf_dir).run(_C("tion")), 20, 30))


@_add("allowed_ids", _scored_sql([("contains", "tion")], "m0 AND _node_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "s0"))
def _allowed(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = documents(spark, sf_dir).run(_C("tion"))
    return _rounded(found.join(good.withColumnRenamed("doc_id", "_node_id"), "_node_id", "left_semi"))


@_add("sort_keys", "SELECT doc_id AS _node_id FROM documents ORDER BY lang ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id LIMIT 100")
def _sorted(spark, sf_dir):
    return collectors.order_by(documents(spark, sf_dir).docs, [("lang", "reverse"), ("n_chars", "natural")], 100).select("_node_id")


@_add("tweak_score", _scored_sql([("contains", "tion")], "m0", "s0 * ln(2 + n_chars)"))
def _tweaked(spark, sf_dir):
    s = documents(spark, sf_dir)
    return _rounded(collectors.tweak_score(s.run(_C("tion")), s.docs, F.col("score") * F.log(2 + F.col("n_chars"))))


@_add("match_count", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'tion')")
def _count(spark, sf_dir):
    return documents(spark, sf_dir).run(_C("tion"), need_score=False).agg(F.count("*").alias("n"))


@_add("sort_keys_none_last", "SELECT doc_id AS _node_id FROM documents ORDER BY lang ASC NULLS LAST, n_chars DESC NULLS FIRST, doc_id LIMIT 100")
def _sorted_other(spark, sf_dir):
    return collectors.order_by(documents(spark, sf_dir).docs, [("lang", "reverse_none_lower"), ("n_chars", "natural_none_higher")], 100).select("_node_id")


@_add("doc_set", "SELECT doc_id AS _node_id FROM documents WHERE contains(lower(text), 'tion')")
def _doc_set(spark, sf_dir):
    return collectors.doc_set(documents(spark, sf_dir).run(_C("tion"), need_score=False))


@_add("filter_collector", _scored_sql([("contains", "tion")], "m0 AND s0 > 0.3", "s0"))
def _filter_collector(spark, sf_dir):
    return _rounded(collectors.filtered(documents(spark, sf_dir).run(_C("tion")), F.col("score") > 0.3))


@_add("multi_collector", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 5").replace("AS score FROM p", "AS score, (SELECT count(*) FROM p WHERE m0)::bigint AS n FROM p"))
def _multi(spark, sf_dir):
    got = collectors.multi(documents(spark, sf_dir).run(_C("tion")), dict(n=collectors.count, top=lambda df: [tuple(r) for r in top_k(df, 5).collect()]))
    rows = [(i, round(score, 6), got["n"]) for i, score in got["top"]]
    return spark.createDataFrame(rows, "_node_id long, score double, n long")


@_add("top_facets", "SELECT '/' AS root, '/' || p_brand AS facet, count(*) AS count FROM part GROUP BY ALL ORDER BY count(*) DESC, facet LIMIT 5")
def _top_facets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_node_id"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("path"))
    return collectors.top_facets(collectors.facets(rows, "path", ["/"]), "/", 5)


@_add("stored_fields", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 20").replace("AS score FROM p", "AS score, lang, n_chars FROM p"))
def _stored(spark, sf_dir):
    return documents(spark, sf_dir).search(_C("tion"), limit=20, fields=["lang", "n_chars"]).withColumn("score", F.round("score", 6))


@_add("search_global_stats", _scored_sql([("contains", "tion")], "m0 AND _node_id % 2 = 0", "s0"))
def _global(spark, sf_dir):
    """One half's matches, scored with the statistics of both."""
    s = documents(spark, sf_dir)
    halves = [s.docs.where(F.pmod("_node_id", F.lit(2)) == k) for k in (0, 1)]
    stats = [Searcher(h, analyzers=s.analyzers).export_stats(_C("tion")) for h in halves]
    return _rounded(Searcher(halves[0], analyzers=s.analyzers, stats=stats[0].merge(stats[1])).run(_C("tion")))


@_add("facets", "SELECT '/' AS root, '/' || p_brand AS facet, count(*) AS count FROM part GROUP BY ALL UNION ALL SELECT '/' || p_brand, '/' || p_brand || '/' || p_type, count(*) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY ALL")
def _facets(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first = part.agg(F.min("p_brand")).first()[0]
    rows = part.select(F.col("p_partkey").alias("_node_id"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type").alias("path"))
    return collectors.facets(rows, "path", ["/", f"/{first}"])


@_add("histogram_collector", "SELECT b::int AS bucket, count(l_orderkey) AS count FROM range(10) r(b) LEFT JOIN lineitem ON floor((l_quantity - 0) / 5) = b GROUP BY b")
def _collected(spark, sf_dir):
    return collectors.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0, 5, 10)


@_add("highlights", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 50").replace("round(s0, 6) AS score", "f0::int AS marks"))
def _highlights(spark, sf_dir):
    found = documents(spark, sf_dir).search(_C("tion"), limit=50, highlights=True)
    return found.select("_node_id", F.size(F.col("highlights")["body"]).alias("marks"))


@_add("snippets")
def _snippets(spark, sf_dir):
    s = documents(spark, sf_dir)
    query = ir.Bool(should=(ir.Term("body", "the"), ir.Term("body", "of")))
    return snippets.snippets(s, top_k(s.run(query), 20), query, "body").select("_node_id", "snippet")


@_add("explain", _scored_sql([("term", "the")], "m0", "s0").replace("SELECT _node_id, round(s0, 6) AS score", "SELECT _node_id, round(s0, 6) AS score, f0::bigint AS tf, len(ts)::bigint AS dl"))
def _explained(spark, sf_dir):
    rows = documents(spark, sf_dir).explain(ir.Term("body", "the"))
    return rows.select("_node_id", F.round("score", 6).alias("score"), F.col("details")[0]["tf"].alias("tf"), F.col("details")[0]["dl"].alias("dl"))


@_add("global_stats", _BASE + " SELECT count(*)::bigint AS docs, sum(len(ts))::bigint AS tokens, count(*) FILTER (contains(t, 'tion'))::bigint AS df FROM s")
def _stats(spark, sf_dir):
    s = documents(spark, sf_dir)
    halves = [Searcher(s.docs.where(F.pmod("_node_id", F.lit(2)) == k), analyzers=s.analyzers).export_stats(_C("tion")) for k in (0, 1)]
    whole = halves[0].merge(halves[1])
    return spark.createDataFrame([(whole.docs, whole.tokens["body"], next(iter(whole.df.values())))], "docs long, tokens long, df long")


# ---- dictionaries ----

_DICTIONARY = _BASE + ", x AS (SELECT _node_id, lang, unnest(ts) AS token FROM s)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.explode(text.ANALYZERS["simple"].tokens("text")).alias("token"))


@_add("term_dictionary", _DICTIONARY + " SELECT token, count(DISTINCT _node_id) AS df, count(*) AS cf FROM x GROUP BY token")
def _dictionary(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("token", "doc_id").count().groupBy("token").agg(F.count("*").alias("df"), F.sum("count").alias("cf"))


for _name, _op, _set in (("dictionary_union", "union", "UNION"), ("dictionary_intersection", "intersect", "INTERSECT"), ("dictionary_difference", "subtract", "EXCEPT")):

    @_add(_name, _DICTIONARY + f" SELECT token FROM x WHERE lang = 'en' {_set} SELECT token FROM x WHERE lang = 'de'")
    def _sets(spark, sf_dir, op=_op):
        rows = _tokens(spark, sf_dir)
        a, b = (rows.where(F.col("lang") == x).select("token") for x in ("en", "de"))
        return getattr(a, op)(b).distinct()


@_add("dictionary_symmetric_difference", _DICTIONARY + " SELECT token FROM x WHERE lang IN ('en', 'de') GROUP BY token HAVING count(DISTINCT lang) = 1")
def _symmetric(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where(F.col("lang").isin("en", "de"))
    return rows.select("token", "lang").distinct().groupBy("token").count().where("count = 1").select("token")


@_add("dictionary_range", _DICTIONARY + " SELECT DISTINCT token FROM x WHERE token >= 'ma' AND token < 'mf'")
def _between(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token").distinct().where((F.col("token") >= "ma") & (F.col("token") < "mf"))


# ---- analyzers ----


@_add("tokenizer_simple", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'))::bigint AS n FROM documents")
def _simple(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.simple_tokens("text")).cast("long").alias("n"))


@_add("tokenizer_whitespace", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f]+'))::bigint AS n FROM documents")
def _white(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.whitespace_tokens("text")).cast("long").alias("n"))


@_add("tokenizer_regex", "SELECT doc_id, len(regexp_extract_all(text, '[a-z]+ing'))::bigint AS n FROM documents")
def _regex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.regex_tokens("[a-z]+ing")("text")).cast("long").alias("n"))


@_add("filter_stop_words", _DICTIONARY + " SELECT _node_id AS doc_id, count(*) AS n FROM x WHERE token NOT IN STOPPED GROUP BY _node_id".replace("STOPPED", str(tuple(text.STOP_WORDS["en"]))))
def _stopped(spark, sf_dir):
    tokens = text.stop_words(text.STOP_WORDS["en"])(text.ANALYZERS["simple"].tokens("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n")).where("n > 0")


@_add("filter_remove_long", _DICTIONARY + " SELECT _node_id AS doc_id, count(*) AS n FROM x WHERE strlen(token) < 8 GROUP BY _node_id")
def _short(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.remove_long(8)(text.ANALYZERS["simple"].tokens("text"))).cast("long").alias("n")).where("n > 0")


@_add("filter_alphanum_only", _DICTIONARY + " SELECT _node_id AS doc_id, count(*) AS n FROM x WHERE regexp_full_match(token, '[A-Za-z0-9]*') GROUP BY _node_id")
def _ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.alphanum_only(text.ANALYZERS["simple"].tokens("text"))).cast("long").alias("n")).where("n > 0")


@_add("filter_ascii_folding", _DICTIONARY + " SELECT DISTINCT replace(strip_accents(replace(token, 'ß', 'ss')), 'æ', 'ae') AS token FROM x")
def _folded(spark, sf_dir):
    return _tokens(spark, sf_dir).select(text.fold(F.col("token")).alias("token")).distinct()


@_add("tokenizer_raw", "SELECT doc_id, 1::bigint AS n, coalesce(text, '') AS token FROM documents")
def _raw(spark, sf_dir):
    tokens = text.raw_token(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), tokens[0].alias("token"))


@_add("tokenizer_empty", "SELECT doc_id, 0::bigint AS n FROM documents")
def _no_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.empty_tokens("text")).cast("long").alias("n"))


@_add("compound_words", "SELECT p_partkey, CASE WHEN regexp_full_match(w, '(?:eco|nomy|stan|dard|dium|me|art)+') THEN regexp_extract_all(w, 'nomy|stan|dard|dium|eco|art|me') ELSE [w] END AS parts FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS w FROM part)")
def _compound(spark, sf_dir):
    words = F.split(F.lower("p_type"), " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words).alias("w"))
    return rows.select("p_partkey", text.compound_words(["eco", "nomy", "stan", "dard", "dium", "me", "art"])(F.array("w")).alias("parts"))


@_add("wildcard", "SELECT p_partkey FROM part WHERE regexp_full_match(lower(p_type), 's.*a.*')")
def _wildcard(spark, sf_dir):
    pattern = text.wildcard_to_regex("s*a*")
    return table(spark, sf_dir, "part").where(F.lower("p_type").rlike(f"^(?:{pattern})$")).select("p_partkey")


@_add("camel_split")
def _camel(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.ANALYZERS["raw_code"].tokens("text")).alias("n"))


@_add("facet_tokens", "SELECT p_partkey, unnest(['/', '/' || p_brand, '/' || p_brand || '/' || p_type]) AS facet FROM part")
def _paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(text.facet_tokens(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type"))).alias("facet"))


# ---- aggregations ----


def _plain(df: DataFrame) -> DataFrame:
    """Metric columns with readable names."""
    return df.toDF(*(c.replace("\u0001", "_").rstrip("_") for c in df.columns))


@_add("agg_terms", "SELECT l_returnflag AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
def _terms(spark, sf_dir):
    return aggs.terms_frame(table(spark, sf_dir, "lineitem"), dict(field="l_returnflag")).select("key", "doc_count")


@_add("agg_terms_size_other", "WITH g AS (SELECT l_suppkey AS key, count(*) AS doc_count FROM lineitem GROUP BY 1), t AS (SELECT * FROM g ORDER BY doc_count DESC, key LIMIT 10) SELECT key, doc_count, (SELECT sum(doc_count) FROM g)::bigint AS total FROM t")
def _cut(spark, sf_dir):
    return aggs.terms_frame(table(spark, sf_dir, "lineitem"), dict(field="l_suppkey", size=10)).select("key", "doc_count", "total")


@_add("agg_terms_order_metric", "SELECT o_orderpriority AS key, count(*) AS doc_count, round(sum(o_totalprice) / count(o_totalprice), 4) AS price FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) / count(o_totalprice) DESC, key LIMIT 3")
def _ordered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    m = dict(price=aggs.metric(orders, "price", "avg", dict(field="o_totalprice"), True))
    out = _plain(aggs.terms_frame(orders, dict(field="o_orderpriority", size=3, order=dict(price="desc")), m))
    return out.select("key", "doc_count", F.round(F.col("price_s") / F.col("price_n"), 4).alias("price"))


@_add("agg_terms_include_exclude", "SELECT p_brand AS key, count(*) AS doc_count FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3].*') AND p_brand NOT IN ('Brand#11') GROUP BY 1")
def _included(spark, sf_dir):
    return aggs.terms_frame(table(spark, sf_dir, "part"), dict(field="p_brand", size=1000, include="Brand#[1-3].*", exclude=["Brand#11"])).select("key", "doc_count")


@_add("agg_terms_missing", "SELECT coalesce(lang, 'none') AS key, count(*) AS doc_count FROM documents GROUP BY 1")
def _missing(spark, sf_dir):
    return aggs.terms_frame(table(spark, sf_dir, "documents"), dict(field="lang", missing="none")).select("key", "doc_count")


@_add("agg_range", "SELECT CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 ELSE 3 END::int AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
def _ranged(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "lineitem"), "range", dict(field="l_quantity", ranges=[{"from": 10, "to": 20}, {"from": 20, "to": 30}]), "key", None)
    return aggs.level(rows, ["key"], {})


@_add("agg_histogram", "SELECT floor((l_extendedprice - 500) / 1000.0) * 1000.0 + 500 AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
def _histogram(spark, sf_dir):
    return aggs.level(aggs.bucketed(table(spark, sf_dir, "lineitem"), "histogram", dict(field="l_extendedprice", interval=1000, offset=500), "key", None), ["key"], {})


@_add("agg_histogram_hard_bounds", "SELECT floor(l_quantity / 5.0) * 5.0 AS key, count(*) AS doc_count FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 GROUP BY 1")
def _bounded(spark, sf_dir):
    return aggs.level(aggs.bucketed(table(spark, sf_dir, "lineitem"), "histogram", dict(field="l_quantity", interval=5, hard_bounds=dict(min=10, max=30)), "key", None), ["key"], {})


@_add("agg_date_histogram", "SELECT floor(epoch_us(ts) / 1000.0 / 3600000) * 3600000 AS key, count(*) AS doc_count FROM events GROUP BY 1")
def _dates(spark, sf_dir):
    return aggs.level(aggs.bucketed(table(spark, sf_dir, "events"), "date_histogram", dict(field="ts", fixed_interval="1h"), "key", None), ["key"], {})


@_add("agg_filter", "SELECT count(*) AS doc_count, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def _filtered(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "lineitem"), "filter", dict(query="l_quantity:[10 TO 20]"), "key", None)
    out = _plain(aggs.level(rows, [], dict(d=aggs.metric(rows, "d", "avg", dict(field="l_discount"), True))))
    return out.select("doc_count", F.round(F.col("d_s") / F.col("d_n"), 6).alias("discount"))


@_add("agg_stats", "SELECT l_linestatus AS key, count(*) AS doc_count, count(l_quantity) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def _stat(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "lineitem"), "terms", dict(field="l_linestatus"), "key", None)
    out = _plain(aggs.level(rows, ["key"], dict(q=aggs.metric(rows, "q", "stats", dict(field="l_quantity"), True))))
    return out.select("key", "doc_count", F.col("q_n").alias("n"), F.col("q_s").alias("s"), F.col("q_lo").alias("lo"), F.col("q_hi").alias("hi"))


@_add("agg_extended_stats", "SELECT l_linestatus AS key, round(sum(l_quantity * l_quantity), 2) AS squares, round(var_pop(l_quantity), 6) AS variance FROM lineitem GROUP BY 1")
def _extended(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "lineitem"), "terms", dict(field="l_linestatus"), "key", None)
    out = _plain(aggs.level(rows, ["key"], dict(q=aggs.metric(rows, "q", "extended_stats", dict(field="l_quantity"), True))))
    return out.select("key", F.round("q_q", 2).alias("squares"), F.round("q_v", 6).alias("variance"))


@_add("agg_metrics", "SELECT count(o_totalprice) AS n, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS a FROM orders")
def _metrics(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kinds = dict(c="value_count", s="sum", l="min", h="max", a="avg")
    out = _plain(aggs.level(orders, [], {k: aggs.metric(orders, k, kind, dict(field="o_totalprice"), True) for k, kind in kinds.items()}))
    return out.select(F.col("c_n").alias("n"), F.round("s_s", 2).alias("s"), F.col("l_lo").alias("lo"), F.col("h_hi").alias("hi"), F.round(F.col("a_s") / F.col("a_n"), 4).alias("a"))


@_add("agg_percentiles", "SELECT p AS percent, round(quantile_cont(o_totalprice, p / 100), 4) AS value FROM orders, (SELECT unnest(PERCENTS)::double AS p) GROUP BY p".replace("quantile_cont(o_totalprice, p / 100)", "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(o_totalprice, {p / 100})" for p in aggs.DEFAULT_PERCENTS) + " END").replace("PERCENTS", str(aggs.DEFAULT_PERCENTS)))
def _percentiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    out = _plain(aggs.level(orders, [], dict(p=aggs.metric(orders, "p", "percentiles", dict(field="o_totalprice"), True))))
    return out.select(F.explode(F.arrays_zip(F.array(*map(F.lit, aggs.DEFAULT_PERCENTS)).alias("percent"), F.col("p").alias("value"))).alias("x")).select("x.percent", F.round("x.value", 4).alias("value"))


@_add("agg_cardinality", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def _cardinality(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _plain(aggs.level(lines, [], dict(n=aggs.metric(lines, "n", "cardinality", dict(field="l_partkey"), True)))).select("n")


@_add("agg_top_hits", "SELECT o_orderpriority AS key, rank::int AS rank, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _hits(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "orders"), "terms", dict(field="o_orderpriority"), "key", None)
    spec = dict(size=3, sort=[dict(o_totalprice="desc"), dict(o_orderkey="asc")], docvalue_fields=["o_order*"])
    return aggs.top_hits_frame(rows, spec, ["key"]).select("key", "rank", "o_orderkey", "o_totalprice")


@_add("agg_nested", "WITH g AS (SELECT l_returnflag AS k0, l_suppkey AS k1, count(*) AS doc_count, round(avg(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL) SELECT k0, k1, doc_count, quantity FROM (SELECT *, row_number() OVER (PARTITION BY k0 ORDER BY doc_count DESC, k1) AS r FROM g) WHERE r <= 5")
def _nested(spark, sf_dir):
    rows = aggs.bucketed(table(spark, sf_dir, "lineitem"), "terms", dict(field="l_returnflag"), "k0", None)
    out = _plain(aggs.terms_frame(rows, dict(field="l_suppkey", size=5), dict(q=aggs.metric(rows, "q", "avg", dict(field="l_quantity"), True)), ["k0"], "k1"))
    return out.select("k0", "k1", "doc_count", F.round(F.col("q_s") / F.col("q_n"), 6).alias("quantity"))


@_add("agg_terms_multivalued", "SELECT key, count(*) AS doc_count FROM (SELECT l_orderkey, unnest(list_distinct(list(l_returnflag))) AS key FROM lineitem GROUP BY l_orderkey) GROUP BY key")
def _multivalued(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return aggs.terms_frame(rows, dict(field="flags")).select("key", "doc_count")


@_add("agg_terms_bool", "SELECT l_quantity > 25 AS key, count(*) AS doc_count FROM lineitem GROUP BY 1")
def _bools(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("many"))
    return aggs.terms_frame(rows, dict(field="many")).select("key", "doc_count")


@_add("agg_cardinality_text", "SELECT count(DISTINCT o_orderpriority) AS n FROM orders")
def _cardinality_text(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _plain(aggs.level(orders, [], dict(n=aggs.metric(orders, "n", "cardinality", dict(field="o_orderpriority"), True)))).select("n")


@_add("agg_default_sketches", "SELECT true AS cardinality_close, true AS median_close")
def _sketches(spark, sf_dir):
    """The default, approximate forms against the exact ones: distinct values within 5 %, the median's rank within 1 %."""
    got = aggs.aggregate(table(spark, sf_dir, "orders"), dict(n=dict(cardinality=dict(field="o_totalprice")), p=dict(percentiles=dict(field="o_totalprice", percents=[50]))))
    distinct, median = got["n"]["value"], next(iter(got["p"]["values"].values()))
    orders = table(spark, sf_dir, "orders")
    row = orders.agg(F.countDistinct("o_totalprice").alias("d"), F.avg((F.col("o_totalprice") <= float(median)).cast("double")).alias("r"))
    return row.select((F.abs(F.col("d") - float(distinct)) <= 0.05 * F.col("d")).alias("cardinality_close"), (F.abs(F.col("r") - 0.5) <= 0.01).alias("median_close"))


_TREE = "SELECT l_returnflag AS flag, count(*) AS doc_count, round(avg(l_quantity), 6) AS quantity, p.price, p.n FROM lineitem l JOIN (SELECT l_returnflag AS f, floor(l_extendedprice / 20000.0) * 20000.0 AS price, count(*) AS n FROM lineitem GROUP BY ALL) p ON p.f = l.l_returnflag GROUP BY ALL"


@_add("agg_tree", _TREE)
def _tree(spark, sf_dir):
    """The whole response of a nested request, a row for each inner bucket that holds something."""
    request = dict(flags=dict(terms=dict(field="l_returnflag"), aggs=dict(quantity=dict(stats=dict(field="l_quantity")), price=dict(histogram=dict(field="l_extendedprice", interval=20000)))))
    found = aggs.aggregate(table(spark, sf_dir, "lineitem"), request)["flags"]["buckets"]
    rows = [(f["key"], f["doc_count"], round(f["quantity"]["avg"], 6), float(p["key"]), p["doc_count"]) for f in found for p in f["price"]["buckets"] if p["doc_count"]]
    return spark.createDataFrame(rows, "flag string, doc_count long, quantity double, price double, n long")


# ---- streams ----


@_add("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _windows(spark, sf_dir):
    return ingest.window_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour").select("start", "event_type", "n")


@_add("event_sessions", "WITH o AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s")
def _sessions(spark, sf_dir):
    return ingest.session_counts(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes").select("user_id", "start", "n")


@_add("stream_event_windows", _sql["event_windows"])
def _streamed(spark, sf_dir):
    """The same counts from a stream that reads the table to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    name = f"windows_{uuid.uuid4().hex}"
    counts = ingest.window_counts(stream, "ts", ["event_type"], "1 hour")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("start", "event_type", "n")


# ---- the index ----


def _remove(spark: SparkSession, path: str) -> None:
    try:
        Storage(spark, path).delete()
    except Exception:  # the session has ended before us: its owner cleans the shared folder
        pass


def _path(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillspark-index-")
    path = f"{root.rstrip('/')}/index-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _new(spark: SparkSession, shards: int = 4) -> Index:
    return Index.create(spark, _path(spark), dict(fields=[dict(name="body", type="text"), dict(name="lang", type="string"), dict(name="n_chars", type="i64")], tokenizer="simple", shards=shards))


_plain_indexes: dict[tuple[str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all documents, built once in an application for the queries that only read it."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _plain_indexes:
        index = _new(spark)
        index.add_many(documents(spark, sf_dir).docs)
        index.commit()
        _plain_indexes[key] = index
    return _plain_indexes[key]


def _index_query(name: str, query, sql: str | None) -> None:
    @_add(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = index_of(spark, sf_dir)
        return _rounded(index.searcher().run(querystring.parse(query[0], index.schema, ["body"]) if isinstance(query, tuple) else query))


_index_query("index_contains", _C("tion"), _sql["contains"])
_index_query("index_starts_with", dict(type="startsWith", field="body", value="ver"), _sql["starts_with"])
_index_query("index_contains_split", dict(type="contains_split", field="body", value="tion heit"), _sql["contains_split"])
_index_query("index_contains_phrase", dict(type="phrase", field="body", value="of the"), _sql["contains_phrase"])
_index_query("index_whole_term", dict(type="term", field="body", value="the"), _sql["term"])
_index_query("index_term_query", ir.Term("body", "und"), _sql["term_query"])
_index_query("index_phrase_query", ir.Phrase("body", ("of", "the")), _sql["phrase_query"])
_index_query("index_phrase_prefix", ir.PhrasePrefix("body", ("of", "th")), _sql["phrase_prefix_query"])
_index_query("index_regex", dict(type="regex", field="body", value="token = .[0-9a-f]+"), _sql["regex_contains"])
_index_query("index_regex_gap", dict(type="contains", field="body", value="tion[a-z]*ing", regex=True), _sql["regex_gap"])
_index_query("index_regex_term", ir.RegexTerm("body", "sch[a-z]+"), _sql["regex_term"])
_index_query("index_fuzzy_term", ir.FuzzyTerm("body", "their", 1, False), _sql["fuzzy_term"])
_index_query("index_more_like_this", dict(type="more_like_this", fields=["body"], value="the tion of the tion and of schach schach", min_doc_frequency=2), _sql["more_like_this"])
_index_query("index_query_string", ("the AND in -und",), _sql["query_string_and_not"])
_index_query("index_dis_max", dict(type="disjunction_max", queries=[_C("tion"), _C("heit")], tie_breaker=0.3), _sql["dis_max"])
_index_query("index_filters", dict(**_C("tion"), filters=[dict(field="n_chars", op="between", value=[500, 5000]), dict(field="lang", op="in", value=["en", "fr"])]), _scored_sql([("contains", "tion")], "m0 AND n_chars BETWEEN 500 AND 5000 AND lang IN ('en', 'fr')", "s0"))


@_add("index_fuzzy", "SELECT true AS same, true AS found")
def _index_fuzzy(spark, sf_dir):
    """Typo-tolerant substrings from the tokens against those from the texts: the same documents and scores."""
    query = dict(type="fuzzy", field="body", value="thet", distance=1)
    a, b = _rounded(index_of(spark, sf_dir).searcher().run(query)), _rounded(documents(spark, sf_dir).run(query))
    rows = a.withColumn("n", F.lit(1)).unionByName(b.withColumn("n", F.lit(-1)))  # each side runs once: equal rows cancel out
    rows = rows.groupBy("_node_id", "score").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("int")).alias("m"))
    return rows.agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).select((F.col("n") == 0).alias("same"), (F.col("m") > 0).alias("found"))


@_add("index_fuzzy_contains")
def _index_fuzzy_contains(spark, sf_dir):
    return _rounded(index_of(spark, sf_dir).searcher().run(dict(type="fuzzy", field="body", value="mail example", distance=1)))


def _few(spark: SparkSession, sf_dir: str) -> tuple[Index, DataFrame]:
    return _new(spark, 2), documents(spark, sf_dir).docs.select("_node_id", "body", "lang", "n_chars")


@_add("index_merge_pending", "SELECT doc_id AS _node_id, lang FROM documents WHERE doc_id % 3 <> 2 AND doc_id <> 3")
def _merge_pending(spark, sf_dir):
    """What is buffered when segments are merged is committed after."""
    index, docs = _few(spark, sf_dir)
    index.add_many(docs.where("_node_id % 3 = 0"))
    index.commit()
    index.add_many(docs.where("_node_id % 3 = 1"))
    index.delete(3)
    index.merge()
    index.commit()
    return index.documents().select("_node_id", "lang")


@_add("index_duplicate_ids", _PHRASE_IDF.replace("l.*,", "l.*, n, a, d1, d2,").replace("FROM documents)", "FROM (SELECT * REPLACE (doc_id // 2 AS doc_id) FROM documents))", 1))
def _duplicate_ids(spark, sf_dir):
    """Rows that share an id match and score each by itself."""
    index, docs = _few(spark, sf_dir)
    index.add_many(docs.withColumn("_node_id", F.expr("_node_id div 2")))
    index.commit()
    return _rounded(index.searcher().run(ir.Phrase("body", ("of", "the"))))


@_add("index_update", "SELECT doc_id AS _node_id, CASE WHEN doc_id = 5 THEN 'xx' ELSE lang END AS lang FROM documents WHERE doc_id <> 6")
def _index_update(spark, sf_dir):
    index, docs = _few(spark, sf_dir)
    index.add_many(docs)
    index.commit()
    index.update(5, body="new", lang="xx", n_chars=3)
    index.run([("delete", 6), ("add", dict(_node_id=-1, body="gone again")), ("delete", -1)])
    index.commit()
    return index.documents().select("_node_id", "lang")


@_add("index_delete_term", "SELECT doc_id AS _node_id FROM documents WHERE lang IS DISTINCT FROM 'de'")
def _index_delete_term(spark, sf_dir):
    index, docs = _few(spark, sf_dir)
    index.add_many(docs)
    index.commit()
    index.delete_term("lang", "de")
    index.commit()
    return index.documents().select("_node_id")


@_add("index_rollback", "SELECT doc_id AS _node_id FROM documents WHERE doc_id % 2 = 0")
def _index_rollback(spark, sf_dir):
    index, docs = _few(spark, sf_dir)
    index.add_many(docs.where("_node_id % 2 = 0"))
    index.commit()
    index.add_many(docs.where("_node_id % 2 = 1"))
    index.delete_all()
    index.prepare_commit()
    index.rollback()
    index.commit()
    return Index.open(spark, index.path).documents().select("_node_id")


@_add("index_snapshot", "SELECT doc_id AS _node_id, n_chars FROM documents")
def _index_snapshot(spark, sf_dir):
    """A copy by snapshot, brought up to date by a delta."""
    index, docs = _few(spark, sf_dir)
    index.add_many(docs.where("_node_id % 2 = 0"))
    index.commit()
    copy, since = Index.import_snapshot_from(spark, index.path, _path(spark)), index.version
    index.add_many(docs.where("_node_id % 2 = 1"))
    index.commit()
    copy.apply_sharded_delta_from(index.export_sharded_delta_to(since, _path(spark)))
    return copy.documents().select("_node_id", "n_chars")


@_add("index_versions", "SELECT doc_id AS _node_id FROM documents WHERE doc_id % 2 = 0")
def _index_versions(spark, sf_dir):
    """A reader keeps the version that it opened."""
    index, docs = _few(spark, sf_dir)
    index.add_many(docs.where("_node_id % 2 = 0"))
    index.commit()
    reader = Index.open(spark, index.path)
    index.add_many(docs.where("_node_id % 2 = 1"))
    index.commit()
    return reader.documents().select("_node_id")


@_add("index_search", _scored_sql([("contains", "tion")], "m0", "s0", "ORDER BY s0 DESC, _node_id LIMIT 10").replace("AS score FROM p", "AS score, lang, f0::int AS marks FROM p"))
def _index_search(spark, sf_dir):
    """The ten best with stored fields and highlights."""
    top = index_of(spark, sf_dir).search(_C("tion"), fields=True, highlights=True)
    return top.select("_node_id", F.round("score", 6).alias("score"), "lang", F.size(F.col("highlights")["body"]).alias("marks"))


@_add("index_counts", "SELECT count(*) AS docs, 4::int AS shards, 1::bigint AS version FROM documents")
def _index_counts(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return spark.createDataFrame([(index.num_docs, index.num_shards, index.version)], "docs long, shards int, version long")


@_add("index_inspect_term", _BASE + " SELECT _node_id, len(list_filter(ts, lambda x: x = 'und'))::int AS tf, len(ts)::int AS dl FROM s WHERE list_contains(ts, 'und')")
def _inspect_term(spark, sf_dir):
    return index_of(spark, sf_dir).inspect_term("body", "und").select("_node_id", "tf", "dl")


def _built(spark: SparkSession, sf_dir: str) -> Index:
    """An index of the documents: two commits, deletes by id and by query, compacted."""
    index = _new(spark)
    docs = documents(spark, sf_dir).docs
    for half in (0, 1):
        index.add_many(docs.where(F.pmod("_node_id", F.lit(2)) == half))
        index.commit()
    index.delete(0)
    index.delete_by_query(dict(type="boolean", must=[_C("schach")]))
    index.commit()
    index.merge()
    return index


_LIVE = _BASE.replace("FROM documents)", "FROM documents WHERE NOT contains(lower(text), 'schach') AND doc_id <> 0)", 1)


@_add("index_term", _scored_sql([("term", "the")], "m0", "s0").replace(_BASE, _LIVE))
def _index_term(spark, sf_dir):
    return _rounded(_built(spark, sf_dir).searcher().run(ir.Term("body", "the")))


@_add("index_phrase", _sql["phrase_query"].replace(_BASE, _LIVE))
def _index_phrase(spark, sf_dir):
    return _rounded(_built(spark, sf_dir).searcher().run(ir.Phrase("body", ("of", "the"))))


@_add("index_boolean", _scored_sql([("term", "the"), ("term", "in"), ("contains", "heit")], "m0 AND NOT m2", "s0 + s1").replace(_BASE, _LIVE))
def _index_boolean(spark, sf_dir):
    return _rounded(_built(spark, sf_dir).searcher().run(ir.Bool(must=(ir.Term("body", "the"),), should=(ir.Term("body", "in"),), must_not=(ir.Contains("body", "heit"),))))


@_add("index_dictionary", _LIVE + ", x AS (SELECT _node_id, unnest(ts) AS token FROM s) SELECT token, count(DISTINCT _node_id) AS df, count(*) AS cf FROM x GROUP BY token")
def _index_dictionary(spark, sf_dir):
    return _built(spark, sf_dir).term_dictionary("body").select("token", "df", "cf")


@_add("index_documents", "SELECT doc_id AS _node_id, lang, n_chars FROM documents WHERE NOT contains(lower(text), 'schach') AND doc_id <> 0")
def _index_documents(spark, sf_dir):
    return _built(spark, sf_dir).documents().select("_node_id", "lang", "n_chars")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir).run(_C("the")), 10)
