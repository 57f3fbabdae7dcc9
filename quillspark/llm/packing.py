"""Packing token sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; those full pieces fill sequences of their
own. What remains of each document is counted in a histogram of lengths (cells of `GRAIN` tokens, rounded
up, so that a pattern always fits). A linear program over cutting patterns covers the histogram: a
knapsack dynamic program prices new patterns from the duals until none improves it. The solution is
rounded down, the few pieces left over are packed best fit, and the documents of each cell, ranked, are
dealt to the slots of the patterns. Only the histogram (at most SEQUENCE / GRAIN counts) reaches the driver.

Cases: a null text is empty and still has the end id; a document of exactly full pieces has no remainder;
documents with the same or a null doc_id are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, claim, expand, split_words, stage

SEQUENCE, GRAIN, END = 4096, 8, 2
#: Pricing rounds; stopping early keeps a valid, slightly looser packing.
ROUNDS = 4000
#: Words whose ids a worker remembers, twice so many at most; ranked rows of one window group.
REMEMBERED, GROUP_ROWS = 450_000, 1_000_000
APART = "\x00"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Words:
    """Ids of whole texts by remembered words.

    The normaliser and splitter of the vocabulary drop white space and never look across it, so a text's
    ids are those of its words between ASCII white space; other white space stays inside a word, where the
    tokenizer drops it. Only the distinct words of a batch are looked up, and only new ones are encoded,
    many in one call: a control character that no word holds keeps them apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before = Tokenizer.from_file(path), {}, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart = self._plain([APART])[0]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Words of letters alone end with their only token that ends a word; the others are kept apart by a control character."""
        letters, short, whole = [], [], []
        for w in new:
            (letters if w.isalpha() and w.isascii() else short if APART not in w and len(w) <= 64 else whole).append(w)
        self.known.update(zip(whole, self._plain(whole)))
        between = np.frombuffer(self.apart, "<u4")[0]
        for words, glue in ((letters, " "), (short, f" {APART} ")):
            for k in range(0, len(words), 2000):
                some = words[k : k + 2000]
                (joined,) = self._plain([glue.join(some)])
                ids = np.frombuffer(joined, "<u4")
                if words is letters:
                    stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                    starts = np.concatenate([[0], stops[:-1]])
                else:
                    cuts = 4 * np.flatnonzero(ids == between)
                    starts, stops = np.concatenate([[0], cuts + 4]), np.concatenate([cuts, [len(joined)]])
                if len(stops) == len(some):
                    self.known.update(zip(some, [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist())]))
                else:
                    self.known.update(zip(some, self._plain(some)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and where each text's begin (one entry more)."""
        low = pc.ascii_lower(texts)  # as the normaliser would, unless that made a special token
        words, codes, offsets = split_words(texts if pc.any(pc.match_substring(low, "<|")).as_py() else low)
        words = words.to_pylist()
        if len(self.known) > REMEMBERED:  # two generations: what is used again moves on, the rest is forgotten
            self.known, self.before = {}, self.known
        if new := [w for w in words if w not in self.known]:
            if self.before:
                get = self.before.get
                self.known.update((w, ids) for w in new if (ids := get(w)) is not None)
                new = [w for w in new if w not in self.known]
            self._learn(new)
        ids = [self.known[w] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")[expand(codes, lengths)]
        return flat, np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]


_loaded: dict[str, Words] = {}


def words(path: str) -> Words:
    claim("packing", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Words(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """A row per piece: full pieces and each document's remainder, with the crc32 of its ids."""
    tail = np.array([end], "<u4").tobytes()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, begin = words(path).encode(batch.column(1))
        view, out = memoryview(ids).cast("B"), []
        for doc_id, a, b in zip(batch.column(0).to_pylist(), begin[:-1].tolist(), begin[1:].tolist()):
            n = b - a + 1
            for s in range(0, n, sequence):
                crc = zlib.crc32(view[4 * (a + s) : 4 * min(b, a + s + sequence)])
                out.append((doc_id, s, min(sequence, n - s), zlib.crc32(tail, crc) if n <= s + sequence else crc, n))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, PIECES)


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: value[w] for width w + 1; the best worth and how often it takes each width."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1][: min(room, len(value))] + value[:room]
        w = int(worth.argmax())
        if worth[w] > best[room - 1] + 1e-12:
            best[room], take[room] = worth[w], w + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(value), np.int64), capacity
    while room > 0:
        if take[room]:
            counts[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[int, np.ndarray]]:
    """Patterns with how often each is used; they cover demand[w] pieces of width w + 1 exactly."""
    kinds = np.flatnonzero(demand > 0)
    if not len(kinds):
        return []
    width = kinds + 1
    basis = np.diag(capacity // width).astype(float)
    inverse, level = np.diag(1.0 / (capacity // width)), demand[kinds] / (capacity // width)
    value = np.full(capacity, -1.0)
    for _ in range(rounds):
        value[:] = -1.0
        value[kinds] = inverse.sum(axis=0)
        worth, counts = best_pattern(np.maximum(value, -1.0), capacity)
        if worth <= 1 + 1e-5:
            break
        column = counts[kinds].astype(float)
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, level / step, np.inf)
        leave = int(ratio.argmin())
        amount = ratio[leave]
        level = np.maximum(level - amount * step, 0)
        level[leave] = amount
        basis[:, leave] = column
        row = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, row)
        inverse[leave] = row
    left, used = demand[kinds].copy(), []
    for j in np.argsort(-level):
        pattern = basis[:, j].astype(np.int64)
        fits = min([int(np.floor(level[j] + 1e-9)), *(left[pattern > 0] // pattern[pattern > 0])])
        if fits > 0:
            used.append((fits, pattern))
            left = left - fits * pattern
    bins: list[tuple[int, np.ndarray]] = []  # of the rest, at most a few for each pattern: best fit, widest first
    room: list[int] = []
    for k in range(len(kinds) - 1, -1, -1):
        for _ in range(int(left[k])):
            ok = [i for i, r in enumerate(room) if r >= width[k]]
            if ok:
                i = min(ok, key=room.__getitem__)
            else:
                i = len(room)
                room.append(capacity)
                bins.append((1, np.zeros(len(kinds), np.int64)))
            room[i] -= int(width[k])
            bins[i][1][k] += 1
    out = []
    for times, pattern in used + bins:
        full = np.zeros(len(demand), np.int64)
        full[kinds] = pattern
        out.append((times, full))
    return out


def slots(patterns: list[tuple[int, np.ndarray]], cells: int) -> list[tuple[np.ndarray, ...]]:
    """For each cell: from which rank on a pattern takes its pieces, how many a sequence, and its first sequence."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(cells)]
    rank, first = np.zeros(cells, np.int64), 0
    for times, pattern in patterns:
        for c in np.flatnonzero(pattern):
            rows[c].append((int(rank[c]), int(pattern[c]), first))
            rank[c] += times * pattern[c]
        first += times
    return [tuple(np.array(x, np.int64) for x in zip(*r)) for r in rows]


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, grain: int = GRAIN, end: int = END) -> DataFrame:
    """Every piece with its sequence and the offset there."""
    spark = docs.sparkSession
    cut, _ = stage(pieces(docs, path, sequence, end), "pieces")
    cells = sequence // grain
    cell = F.ceil(F.col("length") / grain).cast("int") - 1
    full, part = cut.where(F.col("length") == sequence), cut.where(F.col("length") < sequence)
    # a cell may hold a third of all pieces: ranks are made in salted groups, shifted by the groups' counts
    n = {r["cell"]: r["n"] for r in part.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(cells, np.int64)
    for c, k in n.items():
        demand[c] = k
    patterns = cutting_stock(demand, cells)
    plan = slots(patterns, cells)
    salts = max(1, -(-int(demand.max(initial=0)) // GROUP_ROWS))
    part = part.withColumns({"cell": cell, "salt": F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts))})
    shift = part.groupBy("cell", "salt").agg(F.count("*").alias("n"))
    shift = shift.select("cell", "salt", (F.sum("n").over(Window.partitionBy("cell").orderBy("salt")) - F.col("n")).alias("shift"))  # at most cells * salts rows
    own = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("length", "doc_id", "start", "ids_crc32")) - 1
    ranked = part.withColumn("own", own).join(shift, ["cell", "salt"]).withColumn("rank", F.col("own") + F.col("shift"))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
        to, slot = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for c in np.unique(at):
            own = at == c
            begin, each, first = plan[c]
            k = np.searchsorted(begin, rank[own], "right") - 1
            to[own] = first[k] + (rank[own] - begin[k]) // each[k]
            slot[own] = (rank[own] - begin[k]) % each[k]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to), pa.array(slot + (at.astype(np.int64) << 16))], [*batch.schema.names[:5], "sequence_id", "slot"])

    names = [c.split()[0] for c in PIECES.split(", ")]
    dealt = arrow_map(ranked.select(*names, "cell", "rank"), deal, f"{PIECES}, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")
    # sequences of one full piece: numbers behind those of the patterns
    alone = full.select(*names, (F.monotonically_increasing_id() + F.lit(sum(times for times, _ in patterns))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.select(*names, "sequence_id", "offset").unionByName(alone)
