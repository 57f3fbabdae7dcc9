import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import aggregations as aggs

ROWS = [("cool", "a", 1, 0.01, True, [1, 2], "2019-01-01 00:00:00"), ("cool", "b", 3, 0.03, False, [5, 5], "2019-01-01 12:00:00"), ("nohit", "a", 5, 0.05, True, [], "2019-01-02 00:00:00"), ("cool", None, 7, None, None, None, "2019-01-04 06:00:00")]


@pytest.fixture(scope="module", params=[1, 3])
def df(spark, request):
    rows = spark.createDataFrame(ROWS, "text string, id string, score long, fraction double, flag boolean, many array<long>, ts string")
    return rows.withColumn("ts", F.to_timestamp("ts")).repartition(request.param)


def run(df, request, **k):
    return aggs.aggregate(df, request, exact=True, **k)


def test_terms(df):
    got = run(df, dict(t=dict(terms=dict(field="id"))))["t"]
    assert got == dict(buckets=[dict(key="a", doc_count=2), dict(key="b", doc_count=1)], sum_other_doc_count=0, doc_count_error_upper_bound=0)
    assert run(df, dict(t=dict(terms=dict(field="id", size=1))))["t"]["sum_other_doc_count"] == 1
    assert [b["key"] for b in run(df, dict(t=dict(terms=dict(field="id", missing="none", order=dict(_key="desc")))))["t"]["buckets"]] == ["none", "b", "a"]
    assert [b["key"] for b in run(df, dict(t=dict(terms=dict(field="id", order=dict(s="desc")), aggs=dict(s=dict(sum=dict(field="score"))))))["t"]["buckets"]] == ["a", "b"]
    assert [b["key"] for b in run(df, dict(t=dict(terms=dict(field="id", order={"s.max": "asc"}), aggs=dict(s=dict(stats=dict(field="score"))))))["t"]["buckets"]] == ["b", "a"]
    assert run(df, dict(t=dict(terms=dict(field="flag"))))["t"]["buckets"] == [dict(key=1, key_as_string="true", doc_count=2), dict(key=0, key_as_string="false", doc_count=1)]
    assert {b["key"]: b["doc_count"] for b in run(df, dict(t=dict(terms=dict(field="many"))))["t"]["buckets"]} == {1: 1, 2: 1, 5: 2}
    assert [b["key"] for b in run(df, dict(t=dict(terms=dict(field="text", exclude="no.*"))))["t"]["buckets"]] == ["cool"]
    assert [b["key"] for b in run(df, dict(t=dict(terms=dict(field="text", include=["nohit"]))))["t"]["buckets"]] == ["nohit"]


def test_metrics(df):
    got = run(df, {k: {k: dict(field="score")} for k in ("avg", "value_count", "min", "max", "sum", "stats")} | dict(none=dict(avg=dict(field="fraction", missing=1))))
    assert got["avg"]["value"] == 4 and got["value_count"]["value"] == 4 and got["min"]["value"] == 1 and got["max"]["value"] == 7 and got["sum"]["value"] == 16
    assert got["stats"] == dict(count=4, sum=16, min=1, max=7, avg=4) and got["none"]["value"] == pytest.approx(1.09 / 4)
    many = run(df, dict(m=dict(stats=dict(field="many"))))["m"]
    assert many == dict(count=4, sum=13, min=1, max=5, avg=3.25)
    x = run(df, dict(x=dict(extended_stats=dict(field="score"))))["x"]
    assert x["variance"] == pytest.approx(5) and x["variance_sampling"] == pytest.approx(20 / 3) and x["sum_of_squares"] == 84 and x["std_deviation_bounds"]["upper"] == pytest.approx(4 + 2 * math.sqrt(5))
    assert run(df.where("score = 1"), dict(x=dict(extended_stats=dict(field="score"))))["x"]["variance"] is None
    p = run(df, dict(p=dict(percentiles=dict(field="score", percents=[50, 100]))))["p"]
    assert p == dict(values={"50.0": 4.0, "100.0": 7.0})
    assert run(df, dict(p=dict(percentiles=dict(field="score", percents=[50], keyed=False))))["p"] == dict(values=[dict(key=50.0, value=4.0)])
    assert run(df, dict(c=dict(cardinality=dict(field="id"))))["c"]["value"] == 2
    assert aggs.aggregate(df, dict(c=dict(cardinality=dict(field="id", missing="z"))))["c"]["value"] == 3


def test_range_and_histogram(df):
    r = run(df, dict(r=dict(range=dict(field="score", ranges=[{"from": 3, "to": 5}, {"from": 6, "to": 20}]))))["r"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in r] == [("*-3", 1), ("3-5", 1), ("5-6", 1), ("6-20", 1), ("20-*", 0)]
    assert run(df, dict(r=dict(range=dict(field="score", keyed=True, ranges=[dict(key="low", to=4)]))))["r"]["buckets"]["low"]["doc_count"] == 2
    h = run(df, dict(h=dict(histogram=dict(field="score", interval=2))))["h"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in h] == [(0, 1), (2, 1), (4, 1), (6, 1)]
    h = run(df, dict(h=dict(histogram=dict(field="score", interval=3, offset=1, extended_bounds=dict(min=-4, max=12)))))["h"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in h] == [(-5, 0), (-2, 0), (1, 2), (4, 1), (7, 1), (10, 0)]
    h = run(df, dict(h=dict(histogram=dict(field="score", interval=2, hard_bounds=dict(min=3, max=6)))))["h"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in h] == [(2, 1), (4, 1)]
    d = run(df, dict(d=dict(date_histogram=dict(field="ts", fixed_interval="1d"))))["d"]["buckets"]
    assert [(b["key_as_string"], b["doc_count"]) for b in d] == [("2019-01-01T00:00:00Z", 2), ("2019-01-02T00:00:00Z", 1), ("2019-01-03T00:00:00Z", 0), ("2019-01-04T00:00:00Z", 1)]
    d = run(df, dict(d=dict(date_histogram=dict(field="ts", fixed_interval="1d", offset="-1h", min_doc_count=1))))["d"]["buckets"]
    assert len(d) == 3 and d[0]["key_as_string"] == "2018-12-31T23:00:00Z"


def test_nesting(df):
    got = run(df, dict(t=dict(terms=dict(field="text"), aggs=dict(i=dict(terms=dict(field="id"), aggs=dict(m=dict(max=dict(field="score")))), h=dict(histogram=dict(field="score", interval=5)), a=dict(avg=dict(field="score"))))))["t"]["buckets"]
    assert got[0]["key"] == "cool" and got[0]["a"]["value"] == pytest.approx(11 / 3)
    assert got[0]["i"]["buckets"] == [dict(key="a", doc_count=1, m=dict(value=1.0)), dict(key="b", doc_count=1, m=dict(value=3.0))]
    assert [(b["key"], b["doc_count"]) for b in got[0]["h"]["buckets"]] == [(0, 2), (5, 1)]
    f = run(df, dict(f=dict(filter=dict(query="score:[3 TO 5]"), aggs=dict(s=dict(sum=dict(field="score")), t=dict(terms=dict(field="text"))))))["f"]
    assert f["doc_count"] == 2 and f["s"]["value"] == 8 and len(f["t"]["buckets"]) == 2
    top = run(df, dict(t=dict(terms=dict(field="text"), aggs=dict(top=dict(top_hits=dict(size=1, sort=[dict(score="desc")], docvalue_fields=["i*"]))))))["t"]["buckets"]
    assert [b["top"]["hits"][0]["sort"] for b in top] == [[7], [5]] and top[1]["top"]["hits"][0]["docvalue_fields"]["id"] == "a"
    assert run(df, dict(top=dict(top_hits={"size": 2, "from": 1, "sort": [dict(score="asc")]})))["top"]["hits"][0]["sort"] == [3]


def test_empty_input(df):
    got = run(df.where("score > 100"), dict(t=dict(terms=dict(field="id")), h=dict(histogram=dict(field="score", interval=2)), s=dict(stats=dict(field="score")), f=dict(filter=dict(query="score:1")), c=dict(cardinality=dict(field="id"))))
    assert got["t"]["buckets"] == [] and got["h"]["buckets"] == [] and got["s"]["count"] == 0 and got["f"]["doc_count"] == 0 and got["c"]["value"] == 0


@pytest.mark.parametrize(
    "bad",
    [
        dict(x=dict(nope={})),
        dict(x=dict(terms={})),
        dict(x=dict(terms=dict(field="nosuch"))),
        dict(x=dict(range=dict(field="score", ranges=[{"from": 1, "to": 5}, {"from": 4, "to": 6}]))),
        dict(x=dict(histogram=dict(field="score", interval=0))),
        dict(x=dict(date_histogram=dict(field="ts", calendar_interval="1M"))),
        dict(x=dict(date_histogram=dict(field="ts", fixed_interval="1y"))),
        dict(x=dict(percentiles=dict(field="score", percents=[101]))),
        dict(x=dict(top_hits=dict(_source=True))),
        dict(x=dict(histogram=dict(field="score", interval=1, min_doc_count=1, extended_bounds=dict(min=0, max=1)))),
    ],
)
def test_errors(df, bad):
    with pytest.raises(aggs.AggregationError):
        run(df, bad)
