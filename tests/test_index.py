import pytest
from pyspark.sql import functions as F

from quillspark.plans import ir
from quillspark.sources.index import Index
from quillspark.streaming import ingest

CONFIG = dict(fields=[dict(name="title", type="text"), dict(name="body", type="text"), dict(name="year", type="i64"), dict(name="tag", type="string")], shards=2)
ROWS = [
    dict(_node_id=1, title="Introduction to Python", body="Python is good for web work", year=2000, tag="lang"),
    dict(_node_id=2, title="Rust", body="memory safety with rust and mutex_lock", year=2024, tag="lang"),
    dict(_node_id=3, title="getElementById", body="browser script", year=2030, tag="web"),
    dict(_node_id=4, title=None, body="machine learning with python", year=None, tag=None),
]


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    index = Index.create(spark, f"{tmp_path}/idx", CONFIG)
    index.add_many(ROWS)
    index.commit()
    return index


def test_create_open_search(spark, index):
    assert index.num_docs == 4 and index.num_shards == 2
    assert ids(index.search("python")) == [1, 4]
    again = Index.open(spark, index.path)
    assert ids(again.search(dict(type="startsWith", field="title", value="byid"))) == [3]
    assert ids(again.search(ir.RegexTerm("body", "pyt.*"))) == [1, 4]
    assert ids(again.search(ir.FuzzyTerm("body", "pyhton", 1))) == [1, 4]
    row = again.search(dict(type="contains", field="body", value="mutex_lock"), highlights=True).first()
    assert [(h["from"], h["to"]) for h in row["highlights"]["body"]] == [(28, 38)]
    with pytest.raises(ValueError):
        Index.create(spark, index.path, CONFIG)


def test_delete_update_and_stamps(index):
    index.delete(1)
    index.update(2, title="Go", body="channels")
    index.commit()
    assert index.num_docs == 3
    assert ids(index.search("python")) == [4] and ids(index.search("channels")) == [2] and ids(index.search("rust")) == []
    index.delete(7)
    index.add(7, body="python seven")  # a delete only affects what was there before it
    index.add(8, body="python eight")
    index.delete(8)
    index.commit()
    assert ids(index.search("python")) == [4, 7]
    index.delete_by_query(dict(type="contains", field="body", value="seven"))
    index.commit()
    assert ids(index.search("python")) == [4]
    index.merge()
    index.vacuum()
    assert ids(index.search("python")) == [4] and len(index.inspect_segments()) == 1
    index.add(9, body="python")
    index.rollback()
    index.commit()
    assert ids(index.search("python")) == [4]


def test_postings_agree_with_scan(index):
    rows = {(r["token"], r["_node_id"]): r["tf"] for r in index.postings("body").collect()}
    assert rows["python", 1] == 1 and rows["python", 4] == 1
    assert {r["token"]: r["df"] for r in index.term_dictionary("body").collect()}["python"] == 2
    plain = index.searcher()
    plain.index = None
    several = ir.Bool(should=(ir.Term("body", "python"), ir.Boost(ir.Term("body", "rust"), 2.0)))
    mixed = ir.Bool(must=(ir.Term("body", "python"),), should=(ir.Phrase("body", ("machine", "learning")),), must_not=(ir.Term("title", "rust"),))
    for q in (ir.RegexTerm("body", "py.*"), ir.FuzzyTerm("body", "pythn", 1, False), ir.Term("body", "python"), ir.Phrase("body", ("memory", "safety", "with")), ir.Phrase("body", ("safety", "memory")), several, mixed):
        assert dict(map(tuple, index.searcher().run(q).collect())) == pytest.approx(dict(map(tuple, plain.run(q).collect())))
    assert index.inspect_term("body", "python").count() == 2


def test_partial_merges(index):
    index.add(6, body="python six")
    index.commit()
    index.add(7, body="python seven")
    index.commit()
    assert index.merge_candidates() == [] and sorted(map(len, index.merge_candidates(least=2))) == [3]
    names = [s["name"] for s in index.inspect_segments()]
    index.delete(6)
    index.commit()
    index.merge(names[1:])
    assert len(index.inspect_segments()) == 2 and ids(index.search("python")) == [1, 4, 7] and index.manifest["tombstones"]
    index.merge()
    assert ids(index.search(ir.Term("body", "python"))) == [1, 4, 7] and not index.manifest["tombstones"]


def test_quantized_lengths(index):
    q = ir.Term("body", "python")
    exact = {r[0]: r["score"] for r in index.searcher().run(q).collect()}
    assert {r[0]: r["score"] for r in index.searcher(quantize_norm=True).run(q).collect()} == pytest.approx(exact)  # short texts are exact


def test_snapshots_and_deltas(spark, index, tmp_path):
    copy = Index.import_snapshot(spark, index.export_snapshot(), f"{tmp_path}/copy")
    assert ids(copy.documents()) == [1, 2, 3, 4] and copy.version_hash() == index.version_hash()
    other = Index.import_snapshot_from(spark, index.path, f"{tmp_path}/other")
    assert other.num_docs == 4
    since = index.version
    index.add(5, body="python five")
    index.delete(1)
    index.commit()
    copy.apply_sharded_delta(index.export_sharded_delta(since))
    assert ids(copy.search("python")) == [4, 5] and copy.version_hash() == index.version_hash()
    assert copy.validate() and copy.space_usage()["segments"] > 0
    with pytest.raises(ValueError):
        index.export_sharded_delta(99)


def test_global_statistics(spark, tmp_path, index):
    parts = []
    for k in (0, 1):
        p = Index.create(spark, f"{tmp_path}/p{k}", CONFIG)
        p.add_many([r for r in ROWS if r["_node_id"] % 2 == k])
        p.commit()
        parts.append(p)
    q = dict(type="contains", field="body", value="python")
    stats = Index.merge_stats(p.export_stats(q) for p in parts)
    got = {r[0]: r["score"] for p in parts for r in p.search_with_global_stats(q, stats).collect()}
    assert got == pytest.approx({r[0]: r["score"] for r in index.search(q).collect()})


def test_stream_ingest_is_exactly_once(spark, index, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(10, "python ten")], "_node_id long, body string").write.parquet(source)
    stream = spark.readStream.schema("_node_id long, body string").parquet(source)
    ingest.ingest(stream, index, f"{tmp_path}/cp").awaitTermination()
    assert ids(index.search("python")) == [1, 4, 10]
    version = index.version
    index.add(11, body="python again")
    assert index.commit(("ingest", 0)) == version  # the same batch once more


def test_event_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:20:00", "b")], "ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n"] for r in ingest.window_counts(rows, "ts", ["k"], "10 minutes").collect()) == [1, 2]
    assert sorted(r["n"] for r in ingest.session_counts(rows, "ts", ["k"], "5 minutes").collect()) == [1, 2]


def test_merge_leaves_what_is_buffered(spark, index):
    index.add(5, body="python five")
    index.delete(1)
    index.merge()
    assert ids(index.search("python")) == [1, 4]
    index.commit()
    assert ids(index.search("python")) == [4, 5] and ids(Index.open(spark, index.path).search("python")) == [4, 5]


def test_nothing_is_added_between_prepare_and_commit(index):
    index.add(5, body="python five")
    index.prepare_commit()
    for call in (lambda: index.add(6, body="python six"), lambda: index.delete(1), index.merge):
        with pytest.raises(ValueError):
            call()
    index.commit()
    index.add(6, body="python six")
    index.commit()
    assert ids(index.search("python")) == [1, 4, 5, 6]


def test_rows_that_repeat_an_id_match_once_each(spark, tmp_path):
    index = Index.create(spark, f"{tmp_path}/idx", CONFIG | dict(tokenizer="simple"))
    index.add_many([dict(_node_id=7, body="of the house"), dict(_node_id=7, body="out of the way"), dict(_node_id=8, body="the house of")])
    index.commit()
    for query in (ir.Phrase("body", ("of", "the")), ir.Term("body", "of"), ir.Contains("body", "f th"), ir.Contains("body", "th")):
        assert ids(index.search(query)) == sorted(r[0] for r in index.documents().collect() if index_matches(query, r))


def index_matches(query, row):
    text = row["body"]
    return "of the" in text if isinstance(query, ir.Phrase) or getattr(query, "value", "") == "f th" else str(query.value) in text


def test_of_two_writers_one_succeeds(spark, index):
    other = Index.open(spark, index.path)
    index.add(5, body="python five")
    other.add(6, body="python six")
    index.commit()
    with pytest.raises(ValueError, match="another writer"):
        other.commit()
    other.reload()
    other.commit()
    assert ids(Index.open(spark, index.path).search("python")) == [1, 4, 5, 6]
    index.store.write_new('{"version": 99, "cut o', "manifests", "99.json")  # a writer that didn't end
    assert Index.open(spark, index.path).version == other.version


def test_delta_needs_its_base_and_shards_have_versions(spark, index, tmp_path):
    copy = Index.import_snapshot(spark, index.export_snapshot(), f"{tmp_path}/copy")
    before = index.shard_versions()
    since = index.version
    index.add(5, body="python five")
    index.commit()
    changed = [a != b for a, b in zip(before, index.shard_versions())]
    assert sum(changed) == 1 and len(changed) == 2
    delta = index.export_sharded_delta(since)
    copy.apply_sharded_delta(delta)
    assert ids(copy.search("python")) == [1, 4, 5]
    with pytest.raises(ValueError, match="another version"):
        copy.apply_sharded_delta(delta)


TEXTS = ["the nation of nations", "station, Tion! tion", "mail.example and mail-exemple", "kmalloc(sizeof(x)) then kmalloc", "aaaa aa", "", None, "xtion end of_the-line", "token = 'abc' and Token"]


@pytest.mark.parametrize("query", [
    ir.Contains("body", "tion"), ir.Contains("body", "aa"), ir.Contains("body", "of the"), ir.Contains("body", "n of n"), ir.Contains("body", "tion", anchor=True), ir.Contains("body", "of th", anchor=True),
    ir.Contains("body", "the", anchor=True, exact=True), ir.PhrasePrefix("body", ("of", "th")), ir.RegexContains("body", "ti[a-z]+"), ir.RegexContains("body", "kmalloc.*sizeof"), ir.RegexContains("body", "token = .[a-z]+"),
    ir.Fuzzy("body", "mail example", 1), ir.Fuzzy("body", "stazion", 1), ir.Bool(must=(ir.Contains("body", "tion"),), must_not=(ir.Contains("body", "station"),)),
], ids=repr)
def test_tokens_give_what_texts_give(spark, tmp_path, query):
    from quillspark.operators.search import Searcher

    index = Index.create(spark, f"{tmp_path}/idx", CONFIG | dict(tokenizer="simple"))
    index.add_many([dict(_node_id=k, body=t) for k, t in enumerate(TEXTS)])
    index.commit()
    got = {r[0]: r[1] for r in index.searcher().run(query).collect()}
    want = {r[0]: r[1] for r in Searcher(index.documents(), analyzers=index.config.analyzers()).run(query).collect()}
    assert got == pytest.approx(want) and want


def moved(spark):
    """Bytes shuffled so far by all stages of the session."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_postings_are_written_without_a_shuffle(spark, index):
    name = index.manifest["segments"][0]["name"]
    index.store.delete("postings", name)
    before = moved(spark)
    index._write_postings(name)
    assert moved(spark) == before
    assert ids(Index.open(spark, index.path).search("python")) == [1, 4]


def test_blocks_hold_the_postings_of_many_documents(spark, tmp_path):
    from quillspark.sources.index import BLOCK, blocks_of

    index = Index.create(spark, f"{tmp_path}/idx", CONFIG | dict(tokenizer="simple"))
    index.add_many(spark.range(500).selectExpr("id AS _node_id", "concat('same of same w', id % 3) AS body").coalesce(1))
    index.commit()
    assert index.blocks("body").count() <= 5 * 2 and index.postings("body", "same").count() == 500
    rows = {r["token"]: (r["tf"], r["dl"], r["positions"]) for r in index.postings("body").where("_node_id = 4").collect()}
    assert rows == {"same": (2, 4, [0, 2]), "of": (1, 4, [1]), "w1": (1, 4, [3])}
    assert {r["token"]: (r["df"], r["cf"]) for r in index.term_dictionary("body").collect()}["same"] == (500, 1000)
    index.delete(4)
    index.commit()
    assert {r["token"]: (r["df"], r["cf"]) for r in index.term_dictionary("body").collect()}["same"] == (499, 998)
    docs = spark.createDataFrame([(k, 1, k, 3, t) for k, t in enumerate([["a", "b", "a"], [], ["b"], ["a", "c"]])], "_node_id long, _op long, _row long, dl int, tokens array<string>").coalesce(1)
    small = docs.mapInArrow(blocks_of(3), BLOCK).collect()  # parts of about three tokens
    assert len(small) > 3
    assert sorted((r["token"], i, p) for r in small for i, ps in zip(r["_node_id"], r["positions"]) for p in ps) == [("a", 0, 0), ("a", 0, 2), ("a", 3, 0), ("b", 0, 1), ("b", 2, 0), ("c", 3, 1)]


def test_postings_of_the_former_layout_are_read(spark, index, tmp_path):
    segment = index.manifest["segments"][0]
    index.postings().drop("seg").write.partitionBy("bucket").parquet(f"{tmp_path}/old")
    index.store.delete("postings", segment["name"])
    index.store.copy_in(f"{tmp_path}/old", "postings", segment["name"])
    del segment["blocks"]
    index.add(5, body="python five")
    index.commit()
    assert ids(index.search(ir.Term("body", "python"))) == [1, 4, 5] and ids(index.search(ir.RegexTerm("body", "pyt.*"))) == [1, 4, 5]


def test_typos_of_a_value_that_repeats_itself(spark, tmp_path):
    from quillspark.operators.search import Searcher

    index = Index.create(spark, f"{tmp_path}/idx", CONFIG | dict(tokenizer="simple"))
    index.add_many([dict(_node_id=k, body=t) for k, t in enumerate(["xaby", "xaxby", "aba", "b a"])])
    index.commit()
    query = ir.Fuzzy("body", "abab", 1)  # its second n-gram lies between two equal ones
    got = [{r[0]: r[1] for r in s.run(query).collect()} for s in (index.searcher(), Searcher(index.documents(), analyzers=index.config.analyzers()))]
    assert got[0] == pytest.approx(got[1]) and sorted(got[1]) == [0, 2]


def test_typo_search_compares_each_side_once(spark):
    from quillspark.plans import registry

    found = registry.queries()["index_fuzzy"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and found.first() == (True, True)


def test_deltas_between_paths_do_not_pass_the_driver(spark, index, tmp_path, monkeypatch):
    copy, other = (Index.import_snapshot_from(spark, index.path, f"{tmp_path}/{n}") for n in ("copy", "other"))
    since = index.version
    index.add(5, body="python five")
    index.delete(1)
    index.merge()
    index.commit()
    monkeypatch.setattr(Index, "_read_all", None)  # what brings files to the driver
    delta = index.export_sharded_delta_to(since, f"{tmp_path}/delta")
    copy.store.copy_in(f"{tmp_path}/delta/segments", "segments")  # an attempt that was cut off
    for one in (copy, other):
        one.apply_sharded_delta_from(delta)
        assert ids(one.search("python")) == [4, 5] and one.version_hash() == index.version_hash() and one.validate()
    with pytest.raises(ValueError, match="another version"):
        copy.apply_sharded_delta_from(delta)
    with pytest.raises(ValueError):
        index.export_sharded_delta_to(99, f"{tmp_path}/none")
    from quillspark.plans import registry

    assert registry.queries()["index_snapshot"](spark, "/root/testdata/sf0.001").count() == 200
