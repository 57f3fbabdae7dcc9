"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

The merge list alone fixes how many bytes behind a token can still change it (`Merges.lookahead`).
A piece of text is therefore encoded window by window: every token that ends that many bytes before
the window's end is final and is emitted, so the state stays of constant size however long a text or
a single run without white space is. Decoding keeps at most three bytes of an unfinished character.

Cases: a null text counts as empty and has no tokens; the contents of special tokens in a text become
their ids, as in the tokenizers library; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import arrow_map, claim

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHIFT, _LOW, _NONE = 17, (1 << 17) - 1, 1 << 62
#: Texts are fed in pieces of so many characters; encodings of so many pieces are remembered by a worker.
CHUNK, REMEMBERED = 1 << 20, 600_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class Merges:
    """Vocabulary, ranked merges and the lookahead they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.pairs, order = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(a << _SHIFT | b, rank << _SHIFT | c)
            order.append((a, b, c))
        self.lookahead = self._lookahead(order)

    def _lookahead(self, order: list[tuple[int, int, int]]) -> int:
        """Bytes behind a token's end that may still change it.

        A merge (a, b) is undone only by an earlier-ranked merge that takes b together with what follows,
        which again holds only if nothing of still earlier rank takes its right part. Ranks fall along
        such a chain, so one pass in rank order finds the longest: need[t] is what token t must see
        behind it, reach[a] the most that merges starting with a look at, over the ranks so far.
        """
        need: dict[int, int] = {}
        reach: dict[int, int] = {}
        for a, b, c in order:
            need[c] = max(need.get(c, 0), need.get(b, 0), reach.get(b, 0))
            reach[a] = max(reach.get(a, 0), len(self.bytes_of[b]) + need[c])
        return max([1, *need.values(), *reach.values()])

    def merge(self, data: bytes) -> list[int]:
        """Merges a whole window: the lowest rank first, leftmost first."""
        ids, get = [self.byte_id[b] for b in data], self.pairs.get
        ranks = [get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            new = best & _LOW
            ids[i : i + 2] = (new,)
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | new, _NONE)
            if i < len(ranks):
                ranks[i] = get(new << _SHIFT | ids[i + 1], _NONE)
        return ids


class PieceStream:
    """Encodes one piece from bytes that arrive bit by bit."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.window = merges, b"", 2 * merges.lookahead + 256

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), self.window):
            self.held += data[k : k + self.window]
            if len(self.held) >= self.window:
                end, safe = 0, len(self.held) - self.merges.lookahead
                for token in self.merges.merge(self.held):
                    if (after := end + len(self.merges.bytes_of[token])) > safe:
                        break
                    out.append(token)
                    end = after
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge(self.held), b""
        return out


class _Remembered(dict):
    """Piece to its ids as little-endian 32-bit integers; bounded."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > 4 * self.merges.lookahead + 512:
            stream = PieceStream(self.merges)
            return np.array(stream.feed(data) + stream.finish(), "<u4").tobytes()
        ids = np.array(self.merges.merge(data), "<u4").tobytes()
        if len(data) <= 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class StreamingEncoder:
    """Feeds of text to ids (as little-endian 32-bit integers), in constant memory."""

    _find = regex.compile(PIECE).findall
    _iter = regex.compile(PIECE).finditer
    _runs = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]

    def __init__(self, merges: Merges, remembered: _Remembered | None = None, longest: int = 1 << 16):
        self.merges, self.ids_of, self.longest = merges, remembered if remembered is not None else _Remembered(merges), longest
        self.hold = max([16, *map(len, merges.special)])
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.text, self.run, self.stream = "", None, None

    def feed(self, text: str, last: bool = False) -> bytes:
        text, out = self.text + text, []
        if self.special and any(s in text for s in self.merges.special):
            start = 0
            for m in self.special.finditer(text):
                out.append(self._segment(text[start : m.start()], True)[0])
                out.append(np.array([self.merges.special[m.group()]], "<u4").tobytes())
                start = m.end()
            text = text[start:]
        ids, self.text = self._segment(text, last)
        return b"".join([*out, ids])

    def finish(self) -> bytes:
        return self.feed("", True)

    def _segment(self, text: str, last: bool) -> tuple[bytes, str]:
        """Ids of text up to where later text can't change the pieces, and the rest."""
        out = []
        if self.run is not None:
            m = self.run.match(text)
            end = m.end() if m else 0
            if end == len(text) and not last:
                end = max(0, end - self.hold)
                out.append(np.array(self.stream.feed(text[:end].encode()), "<u4").tobytes())
                return b"".join(out), text[end:]
            if self.run is self._runs[3] and end < len(text) and end:
                end -= 1
            out.append(np.array(self.stream.feed(text[:end].encode()) + self.stream.finish(), "<u4").tobytes())
            text, self.run, self.stream = text[end:], None, None
        if last:
            out.append(b"".join(map(self.ids_of.__getitem__, self._find(text))))
            return b"".join(out), ""
        safe, done = len(text) - self.hold, 0
        for m in self._iter(text):
            if m.end() > safe:
                break
            out.append(self.ids_of[m.group()])
            done = m.end()
        rest = text[done:]
        if len(rest) > self.longest:
            skip = rest[:1] == " " and not self._runs[3].match(rest, 1)
            self.run = next(r for r in self._runs if r.match(rest, skip))
            self.stream = PieceStream(self.merges)
            if skip:
                out.append(np.array(self.stream.feed(b" "), "<u4").tobytes())
                rest = rest[1:]
            ids, rest = self._segment(rest, False)
            out.append(ids)
        return b"".join(out), rest


class StreamingDecoder:
    """Ids to text; between feeds it keeps only the bytes of an unfinished character."""

    def __init__(self, merges: Merges):
        self.bytes_of, self.state = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)), last)


_loaded: dict[str, tuple[Merges, _Remembered, list[str]]] = {}


def load(path: str) -> tuple[Merges, _Remembered, list[str]]:
    """A worker's model, what it remembers, and each id in decimal."""
    claim("bpe", _loaded.clear)
    if path not in _loaded:
        merges = Merges(path)
        _loaded[path] = merges, _Remembered(merges), [str(i) for i in range(len(merges.bytes_of))]
    return _loaded[path]


def encode_text(text: str | None, path: str) -> list[int]:
    merges, remembered, _ = load(path)
    return np.frombuffer(b"".join(_chunks(text or "", merges, remembered)), "<u4").tolist()


def decode_ids(ids: list[int], path: str) -> str:
    decoder = StreamingDecoder(load(path)[0])
    return decoder.feed(ids) + decoder.feed([], True)


def _chunks(text: str, merges: Merges, remembered: _Remembered) -> Iterator[bytes]:
    encoder = StreamingEncoder(merges, remembered)
    for k in range(0, len(text), CHUNK):
        yield encoder.feed(text[k : k + CHUNK], k + CHUNK >= len(text))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, and its token ids as an array."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode_text(t, path) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(id_col, text_col), rows, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id and the text of its token ids."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [decode_ids(i or [], path) for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return arrow_map(encoded.select(id_col, "ids"), rows, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them; nothing is shuffled."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges, remembered, decimal = load(path)
        counts, coded, decoded = [], [], []
        for text in batch.column(1).to_pylist():
            n, first, second = 0, hashlib.sha256(), hashlib.sha256()
            decoder = StreamingDecoder(merges)
            for part in _chunks(text or "", merges, remembered):
                ids = np.frombuffer(part, "<u4").tolist()
                if ids:
                    first.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
                    n += len(ids)
                    second.update(decoder.feed(ids).encode())
            second.update(decoder.feed([], True).encode())
            counts.append(n)
            coded.append(first.hexdigest())
            decoded.append(second.hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
