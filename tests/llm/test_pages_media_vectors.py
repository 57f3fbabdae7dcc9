import base64
import hashlib
import html
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import anisoq, mss, queries, warc, webp
from quillspark.llm.common import documents

# ---- WARC ----


def expected(rows):
    groups = defaultdict(list)
    for i, _, page in rows:
        groups[(page or "").encode()].append(i)
    out = []
    for i, _, page in rows:
        data = (page or "").encode()
        ids = [x for x in groups[data] if x is not None]
        top = max(ids) if ids else None
        same = len(groups[data]) > 1 and len(data) >= 1000 and i != top
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if same else "response", top if same else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_pages(spark):
    big, small = "<p>" + "x y " * 400, "<p>small"
    rows = [(1, "http://a", big), (2, None, big), (2, "http://a", big), (3, "u", small), (4, "u", small), (5, "u", None), (None, "u", ""), (None, "http://b\r\nc", big), (6, "é", "ü" * 500), (7, "é", "ü" * 500), (8, "long", "<div>" + "word " * 400_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("path", F.lit(1))


def test_bundles_round_trip(odd_pages, spark):
    pages = odd_pages.select("page_id", "url", "html")
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(odd_pages).collect()), key=str)
    assert got == expected([tuple(r) for r in pages.collect()])
    assert warc.round_trip(odd_pages.limit(0)).count() == 0


def test_table_round_trip(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in queries.op5_warc(spark, sf).collect()), key=str)
    assert got == expected(pages)


def test_records_are_found_by_their_frame(odd_pages, tmp_path):
    manifest, root = warc.write(odd_pages, f"{tmp_path}/w")
    store = fs.LocalFileSystem()
    for r in manifest.where("page_id in (3, 6, 8)").collect():
        reader = warc.BundleReader(store.open_input_file(r["path"]), store.get_file_info(r["path"]).size)
        headers, block = reader.read(r["frame"], r["at"], r["length"])
        assert headers["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>" and (headers["WARC-Type"] == "revisit" or hashlib.sha1(block).hexdigest() in headers["WARC-Payload-Digest"])
    payloads = {r["page_id"]: r["payload"] for r in warc.read(manifest, root).where("record_type = 'response' and page_id = 4").collect()}
    assert bytes(payloads[4]) == b"<p>small"
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"0" * 100)
        warc.BundleReader(store.open_input_file(f"{tmp_path}/bad"), 100)


# ---- main text ----


def article(page):
    body = page[page.index("<article>") + 9 :].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>?", "", q.replace("<br>", " "))).split()) for q in parts) if x)


def test_articles_of_the_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in queries.op8_main_text(spark, "/root/testdata/sf0.01").collect():
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two <a href=x>three</a> four", "one\ntwo three four"),
        ("<div><h1>Hi there</h1><p>a b c d e f g h i j</p><aside>zz</aside><p>k l m</p></div><div id='comments'><p>no no</p></div><footer>f</footer>", "Hi there\na b c d e f g h i j\nk l m"),
        ("<html><head><title>t</title></head><body><div class='cookie-notice'>We use cookies</div><header><a>Home</a></header><main><h2>Head</h2><p>Para <i>one</i>.</p><form>Sub<input></form><ul><li>x y<li>z</ul></main></body>", "Head\nPara one.\nx y\nz"),
        ("<article><p>a&nbsp;b &lt;c&gt; &#233;&#x41;</p><script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> --><p>d</article><p>after", "a b <c> éA\nd"),
        ("<div class='page no-sidebar has-comments'><p>body text here and more words</p></div>", "body text here and more words"),
        ("<div class='sidebar'><p>only this text there is</p></div>", "only this text there is"),
        ("<article><p>main text of some words</p></article><article class='comment'><p>a reader says so</p></article><ul class='comment-list'><li>another one</ul>", "main text of some words"),
        ("<div><p>first part of the text</p><div class='ad'>buy now this thing</div><div role='alert'>notice here</div><p>second part of the text</p></div>", "first part of the text\nsecond part of the text"),
        ("<body><nav>m e n u</nav><p>word " * 1 + "and <b>bold</b> text</p><p>unclosed <b>tag", "word and bold text\nunclosed tag"),
    ],
)
def test_pages(page, text):
    assert mss.extract(page) == text


def test_weights_and_regions():
    n = len(mss.KINDS)
    w = [dict(zip(mss.KINDS, mss.weights()[k * n : k * n + n])) for k in range(3)]
    assert w[0]["word"] > 0 and w[1]["word"] > 0 > w[2]["word"]
    assert all(x[k] < 0 for x in w for k in mss.KINDS if k not in ("word", "link"))
    r = np.random.default_rng(2)
    for _ in range(200):
        s = r.normal(size=12).tolist()
        a, b = mss.best_region(s)
        assert sum(s[a:b]) == pytest.approx(max([0.0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))]))


def test_text_is_that_of_the_best_of_all_regions():
    for page in mss.labelled_pages(30, seed=41):
        seq = mss.tokens(page)
        total = np.concatenate([[0], np.cumsum(np.array(mss.weights())[mss.kinds(seq)] * mss.amounts(seq))])
        gain = np.where(np.triu(np.ones((len(total), len(total)), bool), 1), total[None, :] - total[:, None], -np.inf)
        a, b = np.unravel_index(gain.argmax(), gain.shape)
        words = " ".join(t[2] for t, k in zip(seq[a:b], mss.kinds(seq)[a:b]) if t[2] and t[0] != mss.KINDS.index("aside") and k < 2 * len(mss.KINDS)).split()
        found = mss.extract(page).split()
        assert " ".join(words) in " ".join(found)  # whole blocks may add to the ends
        assert found == re.findall(r"\bg\d+", page)


def test_the_scan_decides(monkeypatch):
    pages = mss.labelled_pages(40, seed=8)
    before = [mss.extract(p) for p in pages]
    monkeypatch.setattr(mss, "best_region", lambda scores: (0, 1))
    assert all(mss.extract(p) != t for p, t in zip(pages, before))


def test_several_articles_and_none():
    words = "some words of an article that goes on for a while and then ends here".split()
    text, links = " ".join(words), "".join(f"<p><a href=x>link number {k}</a></p>" for k in range(100))
    two = f"<article><p>{text}</p></article><div>{links}</div><article><p>{text} {' '.join(words * 20)}</p></article>"
    assert "link" not in mss.extract(two) and mss.extract(two).endswith("ends here")
    assert mss.extract(f"<div>{links}</div><div><h1>{text}</h1><p>{text} <a href=x>with a link</a></p></div><div>{links}</div>") == f"{text}\n{text} with a link"


def test_deep_and_unclosed_nesting_takes_linear_time():
    began = time.perf_counter()
    n = 40_000
    for page in ("<div>" * n + "</span>" * n, "<p><table>" + "<b>" * n + "<p></p>" * n, "<li><b>" * n, "<a href='" * n):
        mss.tokens(page)
    assert time.perf_counter() - began < 20


def test_main_text_of_odd_rows(odd_pages):
    rows = mss.main_text(odd_pages).collect()
    assert len(rows) == odd_pages.count() and max(r["n_chars"] for r in rows) > 1_900_000
    assert mss.main_text(odd_pages.limit(0)).count() == 0


# ---- WebP ----


def test_every_transform_round_trips():
    r = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (20, 33)):
        for mode in range(14):
            image = np.repeat(r.integers(0, 256, (h, w // 2 + 1, 4), dtype=np.uint8), 2, axis=1)[:, :w]
            for transforms in ((), ("green",), ("predictor",), ("cross",), ("predictor", "cross", "green")):
                if mode and "predictor" not in transforms:
                    continue
                for cache, references in ((0, False), (0, True), (6, True)):
                    assert (webp.decode(webp.encode(image, transforms, cache, references, mode)) == image).all()
        for colours in (1, 2, 3, 4, 9, 16, 17, 200):
            palette = r.integers(0, 256, (colours, 4), dtype=np.uint8)
            image = palette[r.integers(0, colours, (h, w))]
            assert (webp.decode(webp.encode(image, ("palette",), 0, True)) == image).all()
            assert (webp.decode(webp.encode(image, ("palette", "predictor"), 3, True)) == image).all()


def _random_texts(n=60):
    r = np.random.default_rng(4)
    words = ["".join(r.choice(list("etaoinsrhldcumf"), r.integers(1, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words, r.integers(0, 3000))) for _ in range(n)]
    line = "\n".join(["a line of 191 characters".ljust(191, ".")] * 40)
    table = "\n".join(" ".join(f"{k + 7 * x:03d}" for x in range(143)) for k in range(40))
    pairs = [a + b + " " for a in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "aeiouyAEIOUY0123456789"]
    coloured = "".join(pairs[k % 20 * 50] if r.random() < 0.85 else pairs[k] for k in r.integers(0, len(pairs), 3000))
    return [*texts, coloured, "", "x", "ab" * 5000, line, table, "\u00e9\u4e2d\U0001f389" * 900, "abc" * 3000]


def test_files_are_the_same_alone_and_together_and_for_both_decoders():
    payloads = [webp.padded(t.encode()) for t in _random_texts()]
    media = webp.store_all(payloads)
    assert media == [webp.store(p) for p in payloads]
    files = [f for m in media for f in webp.split_files(m)]
    together = webp.decode_all(files)
    assert all((webp.decode(f) == a).all() for f, a in zip(files, together))
    assert b"".join(np.ascontiguousarray(a[..., :3]).tobytes() for a in together) == b"".join(payloads)
    assert sum(map(len, media)) < 0.75 * sum(map(len, payloads))


def test_stored_files_have_the_features_of_the_format(monkeypatch):
    seen = defaultdict(int)
    read, plain = webp._length_or_distance, webp._decoded

    def counted(*a):
        seen["reference"] += 1
        return read(*a)

    def decoded(bits, width, n, codes, which, shift, across, cache_bits):
        seen["cache"] += cache_bits > 0
        seen["codes of several widths"] += len({e & 15 for e in codes[0][0]}) > 2
        return plain(bits, width, n, codes, which, shift, across, cache_bits)

    monkeypatch.setattr(webp, "_length_or_distance", counted)
    monkeypatch.setattr(webp, "_decoded", decoded)
    for text in _random_texts():
        payload = webp.padded(text.encode())
        for f in webp.split_files(webp.store(payload)):
            bits, *_ = webp._opened(f)
            if bits.read(1):
                seen[("predictor", "cross", "green", "palette")[bits.read(2)]] += 1
            webp.decode(f)
    assert {"reference", "cache", "codes of several widths", "predictor", "palette"} <= {k for k, n in seen.items() if n}
    r = np.random.default_rng(1)
    green = r.integers(0, 256, (16, 192), dtype=np.uint8)
    for share, name in ((2, {"green", "cross"}), (1, {"cross"})):
        image = np.stack([(green.view(np.int8).astype(int) * share // 2 + r.integers(0, 3, green.shape)) & 255, green, green], -1).astype(np.uint8)
        ((transforms, _),) = webp.Images([image.ravel()]).choose()
        assert set(transforms) <= name and transforms
        assert webp.decode(webp.store(image.tobytes()))[..., :3].tobytes() == image.tobytes()


@pytest.mark.parametrize(("file", "pixel"), [("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", [255] * 4), ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", [0] * 4)])
def test_files_of_another_encoder(file, pixel):
    """The one-pixel images that web pages use to find out what a browser can show."""
    data = base64.b64decode(file)
    assert webp.decode(data).tolist() == [[pixel]] and webp.decode_all([data, data])[1].tolist() == [[pixel]]


def test_plane_distances_and_bad_files():
    assert webp._PLANE[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp._PLANE[-1] == (8, 7) and len(webp._PLANE) == 120
    good = webp.store(webp.padded(b"x"))
    for bad in (b"", b"RIFF", good[:30], good.replace(b"VP8L", b"VP8X")):
        with pytest.raises(ValueError):
            webp.decode(bad)
        with pytest.raises(ValueError):
            webp.decode_all([good, bad])
    long = webp.store(webp.padded(b"some text of several words " * 30))
    for k in range(20, len(long)):
        cut = long[:16] + (k - 20).to_bytes(4, "little") + long[20:k]
        for read in (webp.decode, lambda x: webp.decode_all([x])[0]):
            try:
                assert read(cut).shape == (2, 192, 4)
            except ValueError:
                continue


def test_media_of_odd_rows(odd, empty):
    rows = webp.round_trip(odd).collect()
    want = []
    for i, t in odd.select("doc_id", "text").collect():
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        want.append((str(i), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == sorted(want)
    same = [r for r in rows if r["doc_id"] in (0, 1)]
    assert len({(r["media_sha256"], r["feature"], r["media_bytes"]) for r in same}) == 1
    assert webp.round_trip(empty).count() == 0
    pixels = webp.decode_media(webp.encode_media(odd.where("doc_id = 0")).union(odd.limit(1).selectExpr("99L", "0L", "cast(null as binary)"))).collect()
    assert {r["doc_id"]: r["width"] for r in pixels} == {0: 192, 99: None}


def test_many_images_for_a_long_payload():
    payload = np.random.default_rng(1).integers(0, 256, 576 * (webp.ROWS + 5), dtype=np.uint8).tobytes()
    files = webp.split_files(webp.store(payload))
    assert len(files) == 2 and b"".join(webp.decode(f)[..., :3].tobytes() for f in files) == payload


# ---- nearest neighbours ----


def brute(rows, every=50, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            s = sorted((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good if i != q)
            out[q] = [(i, -c) for c, i in s[:k]]
    return out


def test_recall_against_brute_force(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = brute(rows), defaultdict(list)
    for r in sorted(queries.op10_nearest(spark, "/root/testdata/sf0.1").collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(dict(want[q])[i] == pytest.approx(s, abs=1e-12) for q in want for i, s in got[q] if i in dict(want[q]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [nan, 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [inf, 0.0, 0.0]), (8, []), (None, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("n", F.lit(2))
    got = defaultdict(list)
    for r in sorted(anisoq.nearest(df).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert got == {0: [1, 2, 50], 50: [0, 1, 2]}  # ties by id; fewer candidates than five
    assert anisoq.nearest(df.limit(0)).count() == 0


def test_every_dimension_is_searched_and_tiny_vectors_count(spark):
    r = np.random.default_rng(6)
    rows = [(k, r.normal(size=5 if k % 3 else 3).tolist()) for k in range(120)]
    rows += [(200 + k, (1e-200 * r.normal(size=5)).tolist()) for k in range(5)] + [(250, (1e200 * r.normal(size=3)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for row in sorted(anisoq.nearest(df).collect(), key=lambda row: row["rank"]):
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    units = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    for q in (0, 50, 100, 200, 250):
        near = sorted(((-float(units[q] @ x) / np.sqrt(units[q] @ units[q]) / np.sqrt(x @ x), i) for i, x in units.items() if i != q and len(x) == len(units[q])))[:5]
        assert [i for i, _ in got[q]] == [i for _, i in near] and [c for _, c in got[q]] == pytest.approx([-c for c, _ in near])


def test_nearest_among_many_copies_have_the_smallest_ids(spark):
    """A third of a block are copies of one vector and a third near copies: more than are reranked first."""
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    x[:500] = x[0]
    x[500:1000] = x[0] + r.normal(size=(500, 16)) * 1e-3
    ids = r.permutation(1500)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for row in sorted(anisoq.nearest(df).collect(), key=lambda row: row["rank"]):
        got.setdefault(row["query_id"], []).append(row["vec_id"])
    norms = np.sqrt((x * x).sum(axis=1))
    for q in np.flatnonzero(ids % 50 == 0):
        exact = anisoq.cosines(x[q], x, norms)
        assert got[ids[q]] == [ids[t] for t in np.lexsort((ids, -exact)) if t != q][:5]


def test_queries_are_not_copied_for_each_partition(spark):
    """What is shuffled depends on the rows, not on the number of shuffle partitions times the queries."""
    r = np.random.default_rng(7)
    x = r.normal(size=(4000, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(2)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    large = {"spark.sql.shuffle.partitions": "600", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for tables too large for a broadcast
    before, kept = written(), {key: spark.conf.get(key) for key in large}
    try:
        for key, value in large.items():
            spark.conf.set(key, value)
        assert anisoq.nearest(df).count() == 400
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert 0 < written() - before < 2 * x.nbytes


def test_several_groups_of_queries_and_blocks_give_exactly_the_nearest(spark, monkeypatch):
    """Queries in groups, rows in blocks and several comparisons a block; ids that repeat."""
    for name, value in (("GROUP", 16 * 8 * 20), ("ROWS", 64), ("QUERIES", 7), ("SAMPLE", 300), ("RERANK", 8)):
        monkeypatch.setattr(anisoq, name, value)
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 16))
    x[700:760] = x[0]
    ids = np.r_[np.arange(1490), 1400 + np.arange(10)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got, norms = defaultdict(list), np.sqrt((x * x).sum(axis=1))
    for row in sorted(anisoq.nearest(df, every=11).collect(), key=lambda row: row["rank"]):
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    queried = [q for q in range(1490) if ids[q] % 11 == 0]
    assert set(got) == {int(ids[q]) for q in queried}
    for q in queried:
        want = []
        for row in np.flatnonzero(ids == ids[q]):  # of a query that repeats, one is answered
            exact = anisoq.cosines(x[row], x, norms)
            want.append([(int(ids[t]), exact[t]) for t in np.lexsort((ids, -exact)) if ids[t] != ids[q]][:5])
        assert any([i for i, _ in w] == [i for i, _ in got[ids[q]]] and [c for _, c in w] == pytest.approx([c for _, c in got[ids[q]]], abs=1e-12) for w in want)


def test_anisotropic_loss_falls_along_the_vector():
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coder = anisoq.Quantiser(x)
    plain = anisoq.Quantiser.__new__(anisoq.Quantiser)
    plain.__dict__ = coder.__dict__ | {"extra": 0.0}

    def parallel(c):
        codes = c.encode(x)
        back = c.centres[np.arange(c.parts), codes].reshape(len(x), -1)
        return (((x - back) * x).sum(axis=1) ** 2).mean()

    assert parallel(coder) < parallel(plain)
    q = x[:7]
    codes = coder.encode(x)
    back = coder.centres[np.arange(coder.parts), codes].reshape(len(x), -1)
    assert anisoq.scan(coder.packed(x), coder.tables(q)) == pytest.approx(q @ back.T, abs=1e-4)


# ---- pipeline ----


def test_pipeline_keeps_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    known = corpus_pipeline.language(spark, docs, sf_dir)
    assert known.columns == docs.columns and known.count() >= docs.count() - 2
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = corpus_pipeline.near_duplicates(spark, known, sf_dir)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in left.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "packing"]
