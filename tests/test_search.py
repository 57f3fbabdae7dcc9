import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import bm25, text
from quillspark.operators import approximate, collectors, snippets
from quillspark.operators.search import Searcher, literals
from quillspark.plans import dsl, ir, querystring

ROWS = [
    (1, "Introduction to Python", "Python is a programming language, good for rapid web work.", 2000, 3.5, ["a"], '{"a": {"b": 3}, "d": "x"}'),
    (2, "Rust Systems", "Rust has memory safety. mutex_lock(struct device)", 2024, 9.1, ["b", "c"], '{"a": {"b": 7}}'),
    (3, "getElementById", "JavaScript sql9console HTMLParser is fine", 2030, 7.0, [], "{}"),
    (4, None, "machine learning with python and python", 2001, 1.0, None, None),
    (5, "Zürich", "aaaXaa über naïve café", None, None, ["a"], "broken"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "_node_id long, title string, body string, year long, rank double, tags array<string>, props string")


@pytest.fixture(scope="module")
def s(docs):
    return Searcher(docs, analyzers=dict(title="raw_code", props="raw"))


def found(s, q):
    return {r[0]: r["score"] for r in s.run(q).collect()}


def ids(s, q):
    return sorted(found(s, q))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("python web", [1, 4]),
        ("...", []),
        (dict(type="contains", field="body", value="ROG"), [1]),
        (dict(type="contains", field="body", value="memory safe"), [2]),
        (dict(type="contains", field="body", value="mory safety mut"), [2]),
        (dict(type="contains", field="body", value="mutex lock", strict_separators=True), []),
        (dict(type="contains", field="body", value="mutex_lock", strict_separators=True), [2]),
        (dict(type="term", field="body", value="pyth"), []),
        (dict(type="startsWith", field="body", value="pyth"), [1, 4]),
        (dict(type="startsWith", field="title", value="byid"), [3]),
        (dict(type="contains", field="title", value="tById"), [3]),
        (dict(type="term", field="title", value="getElement"), [3]),
        (dict(type="term", field="title", value="getElem"), []),
        (dict(type="regex", field="body", pattern="mutex.*device"), [2]),
        (dict(type="fuzzy", field="body", value="sql9consol"), [3]),
        (dict(type="contains", field="body", value="caf"), [5]),
        (dict(type="boolean", must_not=[dict(type="contains", field="body", value="x")]), []),
        (dict(type="boolean", must=[dict(type="contains", field="body", value="python")], must_not=[dict(type="contains", field="body", value="machine")]), [1]),
        (ir.Exists("tags"), [1, 2, 5]),
        (ir.Exists("props.a.b"), [1, 2]),
        (ir.Range("props.a.b", 4, None), [2]),
        (ir.TermSet("tags", ("a", "c")), [1, 2, 5]),
        (ir.Term("tags", "b"), [2]),
        (ir.Range("rank", 3.5, 9.1, False, True), [2, 3]),
        (ir.Phrase("body", ("rust", "safety"), 2), [2]),
        (ir.Phrase("body", ("rust", "safety"), 1), []),
        (ir.PhrasePrefix("body", ("memory", "saf")), [2]),
        (ir.RegexPhrase("body", ("mem.*", "saf.*")), [2]),
        (ir.FuzzyTerm("body", "pyhton", 1, True), [1, 4]),
        (ir.FuzzyTerm("body", "pyhton", 1, False), []),
        (ir.FuzzyTerm("body", "prog", 1, False, True), [1]),
        (ir.Bool(should=(ir.Empty(), ir.Term("body", "rust"))), [2]),
        (ir.Bool(must=(ir.All(),), must_not=(ir.Term("body", "rust"),)), [1, 3, 4, 5]),
    ],
)
def test_matches(s, query, want):
    assert ids(s, query) == want


def test_overlapping_matches_count(s):
    n, tokens = s.corpus("body")
    (score,) = found(s, dict(type="contains", field="body", value="aa")).values()
    length = 4
    assert score == pytest.approx(bm25.idf(n, 1) * 2.2 * 3 / (3 + 1.2 * (0.25 + 0.75 * length / (tokens["body"] / n))))


def test_scores_combine(s):
    a, b = dict(type="contains", field="title", value="python"), dict(type="contains", field="body", value="python")
    fa, fb = found(s, a), found(s, b)
    both = found(s, dict(type="boolean", should=[a, b]))
    best = found(s, dict(type="disjunction_max", queries=[a, b], tie_breaker=0.2))
    for i in both:
        x, y = fa.get(i, 0), fb.get(i, 0)
        assert both[i] == pytest.approx(x + y) and best[i] == pytest.approx(max(x, y) + 0.2 * min(x, y))
    assert found(s, ir.Boost(s.parsed(b), 3)) == pytest.approx({i: 3 * v for i, v in fb.items()})
    assert set(found(s, ir.Const(s.parsed(b), 2.0)).values()) == {2.0}
    filtered = found(s, dict(**b, filters=[dict(field="year", op="lt", value=2001)]))
    assert filtered == pytest.approx({1: fb[1]})


def test_filters(s):
    def keep(f):
        return ids(s, ir.Const(dsl.build_filter(f, s.docs.schema), 0.0))

    assert keep(dict(field="year", op="ne", value=2000)) == [2, 3, 4, 5]  # null isn't equal
    assert keep(dict(field="year", op="not_in", value=[2000, 2001])) == [2, 3, 5]
    assert keep(dict(field="year", op="between", value=[2001, 2024])) == [2, 4]
    assert keep(dict(field="tags", op="eq", value="a")) == [1, 5]
    assert keep(dict(field="title", op="starts_with", value="Sys")) == [2]
    assert keep(dict(op="must_not", clauses=[dict(field="year", op="gte", value=2024)])) == [1, 4, 5]
    for bad in (dict(field="nope", op="eq", value=1), dict(field="year", op="near", value=1), dict(field="year", op="in", value=[]), dict(field="year", op="between", value=[1]), dict(field="year", op="eq", value="x"), dict(op="must", clauses=[]), dict(field="year", op="eq")):
        with pytest.raises(ValueError):
            dsl.build_filter(bad, s.docs.schema)
    for bad in (dict(type="boolean"), dict(type="nope"), dict(type="contains", field="x", value="y"), dict(type="contains", field="body"), dict(type="disjunction_max"), dict(kind=1)):
        with pytest.raises(ValueError):
            dsl.build(bad, s.docs.schema)


def test_partitions_do_not_matter(docs):
    q = dict(type="boolean", should=[dict(type="contains", field="body", value="python"), dict(type="fuzzy", field="body", value="machine lerning")])
    assert found(Searcher(docs.coalesce(1)), q) == pytest.approx(found(Searcher(docs.repartition(5)), q))


def test_more_typos_find_no_less():
    r = random.Random(42)
    values = ["".join(r.choice("abcdefghij0123456789") for _ in range(r.randrange(6, 13))) for _ in range(40)]
    lines = [" ".join(r.sample(values, r.randrange(1, 6))) for _ in range(80)]
    for v in values[:20]:
        exact = [k for k, t in enumerate(lines) if v in t]
        plans = [approximate.FuzzyPlan(v, d) for d in (0, 1, 2)]
        hits = [{k for k, t in enumerate(lines) if p.find(t)[0]} for p in plans]
        assert set(exact) <= hits[0] <= hits[1] <= hits[2]
        for k in exact:
            assert plans[1].find(lines[k])[1] == 0  # nothing is missing where the value itself is


def test_slop_and_transpositions():
    assert approximate.damerau("pyhton", "python") == 1 and approximate.damerau("abc", "") == 3
    tokens = "a x b c".split()
    assert approximate.slop_count(tokens, ["a", "b"], 0) == 0 and approximate.slop_count(tokens, ["a", "b"], 1) == 1
    assert approximate.slop_count(["b", "a"], ["a", "b"], 1) == 0 and approximate.slop_count(["b", "a"], ["a", "b"], 2) == 1


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("python AND NOT machine", [1]),
        ('body:"memory safety" OR title:introduction', [1, 2]),
        ("year:[2001 TO 2030}", [2, 4]),
        ("year:>2020", [2, 3]),
        ("year:<=2000", [1]),
        ('body:"rust safety"~2', [2]),
        ("tags: IN [a c]", [1, 2, 5]),
        ("body:/pyth.*/", [1, 4]),
        ("title:*", [1, 2, 3, 5]),
        ("+python -machine", [1]),
        ('body:"mem"*', [2]),
        ("*", [1, 2, 3, 4, 5]),
        ("body:(python rust)", [1, 2, 4]),
        ("props.a.b:7", [2]),
        ("(rust OR machine) AND memory", [2]),
        (r"body:mutex\_lock", [2]),
    ],
)
def test_query_strings(s, source, want):
    assert ids(s, querystring.parse(source, s.docs.schema, ["title", "body"])) == want


def test_query_string_options(s):
    schema = s.docs.schema
    assert ids(s, querystring.parse("python web", schema, ["body"], conjunction=True)) == [1]
    assert isinstance(querystring.parse("pyhton", schema, ["body"], fuzzy=dict(body=(1, True, False))), ir.FuzzyTerm)
    assert querystring.parse("x", schema, ["body"], boosts=dict(body=2.0)) == ir.Boost(ir.Term("body", "x"), 2.0)
    for bad in ("nosuch:x", "(a", '"a', "year:x", "-a", "year:[1 2]", "body:/a"):
        with pytest.raises(querystring.ParseError):
            querystring.parse(bad, schema, ["body"])
        _, errors = querystring.parse_lenient(bad, schema, ["body"])
        assert errors
    query, errors = querystring.parse_lenient("foo:bar python [a", schema, ["body"])
    assert errors and ids(s, query) == [1, 4]


def test_highlights_and_snippets(s):
    row = s.search(dict(type="contains", field="body", value="caf"), highlights=True, fields=["body"]).first()
    raw = row["body"].encode()
    assert [raw[h["from"] : h["to"]].decode() for h in row["highlights"]["body"]] == ["caf"]
    assert approximate.highlight("aaa ba", ["aa", "aa"]) == [(0, 2)]
    top = s.search(ir.Term("body", "python"), 5)
    got = {r["_node_id"]: r["snippet"] for r in snippets.snippets(s, top, ir.Term("body", "python"), "body", 30).collect()}
    assert got[4] == "machine learning with <b>python</b>" or "<b>python</b>" in got[4]
    assert all(len(re.sub("</?b>", "", x)) <= 31 for x in got.values())
    assert snippets.to_html("a<b", [(0, 1)]) == "<b>a</b>&lt;b" and snippets.best_fragment("x", {}) == ("", [])


def test_allowed_ids_offset_and_order(s, docs):
    assert [r[0] for r in s.search("python", allowed_ids=[4]).collect()] == [4]
    every = [r[0] for r in s.search(ir.All(), 10).collect()]
    assert every == [1, 2, 3, 4, 5] and [r[0] for r in s.search(ir.All(), 2, 2).collect()] == [3, 4]
    order = lambda way: [r[0] for r in collectors.order_by(docs, [("year", way)], 10).collect()]
    assert order("natural") == [3, 2, 4, 1, 5] and order("reverse") == [5, 1, 4, 2, 3]
    assert order("reverse_none_lower") == [1, 4, 2, 3, 5] and order("natural_none_higher") == [5, 3, 2, 4, 1]
    assert collectors.multi(docs, dict(n=collectors.count, year=lambda d: d.agg(F.max("year")).first()[0])) == dict(n=5, year=2030)


def test_facets(spark):
    df = spark.createDataFrame([(1, ["/a/b", "/a/c"]), (2, ["/a/b/d"]), (3, ["/x"]), (4, None)], "_node_id long, f array<string>")
    got = {(r["root"], r["facet"]): r["count"] for r in collectors.facets(df, "f", ["/", "/a"]).collect()}
    assert got == {("/", "/a"): 2, ("/", "/x"): 1, ("/a", "/a/b"): 2, ("/a", "/a/c"): 1}


def test_analyzers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    camel = lambda x: one(text.ANALYZERS["raw_code"].tokens(F.lit(x)))
    assert camel("getElementById sql9console HTMLParser x") == ["getelement", "byid", "sql9", "console", "html", "parser", "x"]
    assert one(text.facet_tokens(F.lit("/a/b"))) == ["/", "/a", "/a/b"]
    assert one(text.ascii_folding(F.array(F.lit("Éßæ")))) == ["Essae"]
    assert one(text.compound_words(["dampf", "schiff"])(F.array(F.lit("dampfschiff"), F.lit("dampfer")))) == ["dampf", "schiff", "dampfer"]
    assert one(text.remove_long(4)(F.array(F.lit("éé"), F.lit("abc")))) == ["abc"]
    assert one(text.byte_offset(F.lit("éa"), F.lit(1))) == 2
    assert text.wildcard_to_regex("a*b") == "a.*b" and literals("mutex.*lock") == ["mute", "lock"] or literals("mutex.*lock") == ["mutex", "lock"]
    assert bm25._NORMS[:41] == list(range(41)) and bm25._NORMS[41] == 42 and len(bm25._NORMS) == 256


def test_statistics_merge(docs):
    q = dict(type="contains", field="body", value="python")
    whole = Searcher(docs)
    parts = [Searcher(docs.where(F.col("_node_id") % 2 == k)) for k in (0, 1)]
    stats = parts[0].export_stats(q).merge(parts[1].export_stats(q))
    assert bm25.Stats.from_json(stats.to_json()) == stats
    got = {}
    for p in parts:
        got |= found(Searcher(p.docs, stats=stats), q)
    assert got == pytest.approx(found(whole, q))


def test_simplification():
    a, b = ir.Term("f", "a"), ir.Term("f", "b")
    assert ir.simplify(ir.Bool(must=(a,))) == a
    assert ir.simplify(ir.Bool(must=(a, ir.Empty()))) == ir.Empty()
    assert ir.simplify(ir.Bool(must=(a,), must_not=(ir.All(),))) == ir.Empty()
    assert ir.simplify(ir.Bool(should=(a, b), min_should=2)) == ir.Bool((a, b), (), (), 0)
    assert ir.simplify(ir.Bool(should=(a,), min_should=2)) == ir.Empty()
    assert ir.simplify(ir.DisMax((a, ir.Empty()))) == a
