import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quillspark.llm import bpe, packing, queries

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", " ", "  ", "\n", "the", "ing", "'s", "'", "<|endoftext|>", "<|end", "1", "23", "é", "ß", "日本", "🎉", "!", "...", " \t", " ", "é", "\x00", "\x1c", "Σ", "İ"]


def texts(n, longest=40, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(longest))) for _ in range(n)]


def test_encoder_and_decoder_agree_with_the_library():
    library, merges = Tokenizer.from_file(BYTE), bpe.load(BYTE)[0]
    for text in texts(800):
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(text, BYTE) == want
        r, encoder, out, k = random.Random(len(text)), bpe.StreamingEncoder(merges, longest=20), b"", 0
        while k < len(text):
            n = r.randrange(1, 9)
            out += encoder.feed(text[k : k + n])
            k += n
        assert np.frombuffer(out + encoder.finish(), "<u4").tolist() == want
        assert bpe.decode_ids(want, BYTE) == library.decode(want, skip_special_tokens=False)


def test_bounded_lookahead_on_runs_without_spaces():
    library, merges = Tokenizer.from_file(BYTE), bpe.load(BYTE)[0]
    assert 1 < merges.lookahead < 1000
    r, tokens = random.Random(2), [t.decode() for t in merges.bytes_of if t.isalpha() and t.isascii()]
    for _ in range(30):
        text = "".join(r.choice(tokens) for _ in range(r.randrange(200, 700)))
        stream, out, k, data = bpe.PieceStream(merges), [], 0, text.encode()
        while k < len(data):
            n = r.randrange(1, 400)
            out += stream.feed(data[k : k + n])
            assert len(stream.held) <= 2 * stream.window
            k += n
        assert out + stream.finish() == library.encode(text, add_special_tokens=False).ids


def test_decoder_replaces_broken_bytes_as_the_library_does():
    library, r = Tokenizer.from_file(BYTE), random.Random(3)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(12))]
        assert bpe.decode_ids(ids, BYTE) == library.decode(ids, skip_special_tokens=False)


def test_round_trip_of_odd_rows(odd, empty):
    library = Tokenizer.from_file(BYTE)
    rows = bpe.round_trip(odd, BYTE).collect()
    want = sorted((len(i := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()) for (t,) in odd.select("text").collect())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert bpe.round_trip(empty, BYTE).count() == 0
    encoded = bpe.encode(odd.where("doc_id = 7"), BYTE)
    assert bpe.decode(encoded, BYTE).first()["text"] == odd.where("doc_id = 7").first()["text"]


def test_words_agree_with_the_library():
    library, words = Tokenizer.from_file(WORD), packing.words(WORD)
    source = [*texts(1500), None, "", "<|ENDOFTEXT|>"]
    ids, begin = words.encode(pa.array(source, pa.string()))
    for k, t in enumerate(source):
        assert ids[begin[k] : begin[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, docs, share):
    library = Tokenizer.from_file(WORD)
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    pad = total = 0
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
        pad += 0 if at & (at - 1) == 0 else packing.SEQUENCE - at
        total += at
    assert pad <= share * total + packing.SEQUENCE


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack(odd, WORD).collect()
    check_packing(rows, [tuple(r) for r in odd.select("doc_id", "text").collect()], 0.5)
    assert packing.pack(empty, WORD).count() == 0


def test_packing_of_the_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op7_packing(spark, sf).collect(), docs, 0.03)


def test_cutting_stock_is_near_its_bound():
    demand = np.zeros(512, np.int64)
    demand[[99, 149, 201, 255, 300]] = [1000, 700, 900, 400, 250]
    patterns = packing.cutting_stock(demand, 512)
    assert (sum(n * p for n, p in patterns) == demand).all() and all(((np.arange(512) + 1) * p).sum() <= 512 for _, p in patterns)
    used, least = sum(n for n, _ in patterns), ((np.arange(512) + 1) * demand).sum() / 512
    assert used >= least
    greedy = first_fit(demand, 512)
    assert used <= greedy


def first_fit(demand, capacity):
    room = []
    for w in range(len(demand), 0, -1):
        for _ in range(demand[w - 1]):
            k = next((i for i, r in enumerate(room) if r >= w), None)
            if k is None:
                room.append(capacity - w)
            else:
                room[k] -= w
    return len(room)
