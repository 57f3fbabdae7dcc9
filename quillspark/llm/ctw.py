"""Language-model scoring by context-tree weighting, beside a unigram base score.

A text is its lower-cased (A-Z) words, each ended by a space, and an end mark. Bytes are coded as eight
binary decisions. Every decision (node of the byte's binary tree) has a context tree over the DEPTH bytes
before it; its nodes hold Krichevsky-Trofimov counts, and the prediction mixes the estimates of all
depths with the weights that context-tree weighting gives them.

Every n-gram counts, however rare; no table of them is sent around. One scan cuts the documents into
blocks and lists each block's distinct n-grams with how often it teaches them, in parts by a hash of the two
bytes before. Each part adds up what all blocks list and works out its contexts of depth 2 to DEPTH; only
sums by context of depth 1 (at most 256 of them) reach the driver. Each part then answers every block's list,
and a block's texts look their bytes up in the answers. Another scan counts the words: those of the base
score that are frequent (at most HOT) are looked up in place; all others are joined with the counts by word.

`train` makes a model in one process, of the most frequent contexts with at most `kept` n-grams a depth (the
counts of others go, in full, to their parent's branch for all other contexts). Scores don't use it.

Cases: a null text is empty and has the end token alone; a null doc_id has bucket crc32("") % 7 = 0 and
is learnt from; rows that repeat count each; with nothing to learn from, N = V = 0 and the base score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bucket, claim, split_words, stage

DEPTH, KEPT, HOT = 5, 1 << 18, 1 << 19
#: Stands for the end token among words (no word holds white space); its byte never occurs in UTF-8.
END = " "
_CHUNK, _HELD, _TABLE_BITS = 1 << 19, 2_500_000, 21
#: A block of texts ends at so many bytes or distinct n-grams.
BLOCK_BYTES, BLOCK_KEYS = 32 << 20, 1 << 20
#: Contexts up to this depth are in several parts, so they are added up over all.
UPPER = 1


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the documents that are learnt from, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            learn = np.array([bucket(i, 7) != 2 for i in batch.column(0).to_pylist()])
            texts = batch.column(1).filter(pa.array(learn))
            if not len(texts):
                continue
            words, codes, _ = split_words(pc.ascii_lower(texts))
            held.append(pa.table({"word": pa.concat_arrays([words.cast(pa.string()), pa.array([END])]), "c": np.append(np.bincount(codes, minlength=len(words)), len(texts)).astype(np.int64)}))
            if sum(t.num_rows for t in held) > 700_000:
                held = [merged()]
                if held[0].num_rows > 500_000:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from merged().to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, c long").where("word <> ''").groupBy("word").agg(F.sum("c").alias("c"))


def _streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, DEPTH zeros before each, and where each text's zeros begin (one entry more)."""
    parts = [b"\0" * DEPTH + b" ".join([*(t or "").encode().lower().split(), b"\xff"]) for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _keys(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For each byte of data[start:stop]: the byte (lowest) and the DEPTH bytes before it."""
    back = min(start, DEPTH)
    b = data[start - back : stop].astype(np.uint64)
    out = b.copy()
    for s in range(1, DEPTH + 1):
        out[s:] |= b[:-s] << np.uint64(8 * s)
    return out[back:]


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of all texts, some at a time, with which of them are a text's own and each key's place."""
    data, begin = _streams(texts)
    own = np.ones(len(data), bool)
    for k in range(DEPTH):
        own[begin[:-1] + k] = False
    for k in range(0, len(data), _CHUNK):
        yield _keys(data, k, min(len(data), k + _CHUNK)), own[k : k + _CHUNK], begin


def _added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their times."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """depth, key, n over the documents that are learnt from."""

    def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for depth in range(DEPTH, -1, -1):
            key, n = _added([key & np.uint64((1 << (8 * depth + 8)) - 1)], [n])
            for k in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array((key[k : k + 200_000] | np.uint64(depth << 56)).view(np.int64)), pa.array(n[k : k + 200_000])], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for batch in batches:
            texts = [t for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if bucket(i, 7) != 2]
            if not texts:
                continue
            for key, own, _ in _chunks(texts):
                key, n = np.unique(key[own], return_counts=True)
                keys.append(key)
                times.append(n)
                if sum(map(len, keys)) > _HELD:
                    key, n = _added(keys, times)
                    keys, times = [key], [n]
                    if len(key) > _HELD // 2:
                        yield from out(key, n)
                        keys, times = [], []
        if keys:
            yield from out(*_added(keys, times))

    summed = docs.select("doc_id", "text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("key", 56).cast("int").alias("depth"), F.col("key").bitwiseAND(F.lit((1 << 56) - 1)).alias("key"), "n")


def _thresholds(sizes: list[tuple[int, int, int]], most: int, groups: int) -> list[int]:
    """For each group, the least count (a power of two's eighth) from which at most `most` rows are left."""
    least = [1] * groups
    for g in range(groups):
        total = 0
        for step, n in sorted(((s, n) for d, s, n in sizes if d == g), reverse=True):
            total += n
            if total > most:
                least[g] = int(np.ceil(2 ** ((step + 1) / 8)))
                break
        if g:  # what is kept has kept ancestors
            least[g] = max(least[g], least[g - 1])
    return least


def _step(column: str) -> F.Column:
    return F.floor(F.log2(F.col(column)) * 8 + 1e-9).cast("int")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series after moving small arguments up."""
    x, shift = x.astype(np.float64).copy(), np.zeros(len(x))
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class Model:
    """Per depth and bit: sorted nodes (context and bits so far), weight of stopping there, and the chances of a one here and in the branch of all other contexts."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], bits: Iterable[int] = range(8)):
        """tables: for each depth, sorted keys and counts; a context is there with all its bytes or not at all.

        Tables of the first depths may be empty; then the model ends at the least depth that isn't."""
        self.nodes: list[list[tuple[np.ndarray, ...]]] = [[() for _ in range(8)] for _ in range(len(tables))]
        self.cache: tuple[np.ndarray, np.ndarray] | None = None
        self.top: list[tuple[np.ndarray, ...] | None] = [None] * 8
        for bit in bits:
            below = None
            for depth in range(len(tables) - 1, -1, -1):
                key, n = tables[depth]
                if not len(key):
                    self.nodes[depth][bit] = (np.empty(0, np.uint64), *(np.empty(0, np.float32),) * 3)
                    continue
                run = key >> np.uint64(8 - bit)
                first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                one = ((key >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
                b, total = np.add.reduceat(np.where(one, n, 0), first).astype(np.float64), np.add.reduceat(n, first).astype(np.float64)
                a = total - b
                low = key[first] & np.uint64(255)
                node = (key[first] & ~np.uint64(255)) | np.uint64(1 << bit) | (low >> np.uint64(8 - bit))
                estimate = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(total + 1) - np.log(np.pi)
                rest_a, rest_b, split = a.copy(), b.copy(), np.zeros(len(a))
                if below is None:
                    stop, whole = np.ones(len(a)), estimate
                else:
                    b_node, b_whole, b_a, b_b = below
                    parent = (b_node & np.uint64(255)) | ((b_node >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)
                    at = np.searchsorted(node, parent)
                    rest_a -= np.bincount(at, b_a, len(a))
                    rest_b -= np.bincount(at, b_b, len(a))
                    rest_a, rest_b = rest_a.clip(0), rest_b.clip(0)
                    split = np.bincount(at, b_whole, len(a)) + _log_gamma(rest_a + 0.5) + _log_gamma(rest_b + 0.5) - _log_gamma(rest_a + rest_b + 1) - np.log(np.pi)
                    whole = np.logaddexp(estimate, split) - np.log(2)
                    stop = 1 / (1 + np.exp(np.clip(split - estimate, -700, 700)))
                self.nodes[depth][bit] = node, stop.astype(np.float32), ((b + 0.5) / (total + 1)).astype(np.float32), ((rest_b + 0.5) / (rest_a + rest_b + 1)).astype(np.float32)
                below = node, whole, a, b
            self.top[bit] = below

    def chances(self, key: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each key's own bit after its context and the bits before, and whether the least depth has that node."""
        byte = key & np.uint64(255)
        prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        p, there = np.full(len(key), 0.5), np.zeros(len(key), bool)
        for depth in range(len(self.nodes) - 1, -1, -1):
            node, stop, here, rest = self.nodes[depth][bit]
            if not len(node):
                continue
            want = (key & np.uint64(((1 << (8 * depth + 8)) - 1) & ~255)) | prefix
            at = np.minimum(np.searchsorted(node, want), len(node) - 1)
            found = node[at] == want
            w = stop[at].astype(np.float64)
            p = np.where(found, w * here[at] + (1 - w) * np.where(there, p, rest[at]), 0.5)
            there = found
        return np.where(one, p, 1 - p), there

    def log_chances(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte after its context."""
        return sum(np.log10(self.chances(key, bit)[0]) for bit in range(8))

    def remembered(self, key: np.ndarray) -> np.ndarray:
        """log_chances by way of a table with one place for each hash; what isn't there is worked out and put there."""
        if self.cache is None:
            self.cache = np.full(1 << _TABLE_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << _TABLE_BITS)
        there, value = self.cache
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        out, miss = value[slot], there[slot] != key
        if miss.any():
            new = np.unique(key[miss])
            chance = self.log_chances(new)
            out[miss] = chance[np.searchsorted(new, key[miss])]
            slot = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            last = np.zeros(len(new), bool)
            last[np.unique(slot, return_index=True)[1]] = True
            there[slot[last]], value[slot[last]] = new[last], chance[last]
        return out

    def forget(self) -> None:
        self.cache = None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text."""
        return _sums(texts, self.remembered)


def _sums(texts: list[str | None], look_up: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each text: the sum of what its keys look up."""
    sums, at = np.zeros(len(texts)), 0
    for key, own, begin in _chunks(texts):
        value = np.where(own, look_up(key), 0.0)
        first, last = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, at + len(key), "left")
        sums[first:last] += np.add.reduceat(value, np.maximum(begin[first:last] - at, 0))
        at += len(key)
    return sums


def train(docs: DataFrame, kept: int = KEPT) -> Model:
    """The model of the documents that are learnt from; at most kept n-grams of each depth reach the driver."""
    whole = Window.partitionBy("depth", F.shiftright("key", 8))  # of a context: at most 256 rows
    grams, _ = stage(ngram_counts(docs).withColumn("t", F.sum("n").over(whole)), "ngrams")
    sizes = [tuple(r) for r in grams.groupBy("depth", _step("t").alias("s")).count().collect()]  # a few hundred rows
    least = _thresholds(sizes, kept, DEPTH + 1)
    limit = F.element_at(F.array(*(F.lit(x) for x in least)), F.col("depth") + 1)
    table = grams.where(F.col("t") >= limit).select("depth", "key", "n").toArrow()
    depth, key, n = (table.column(c).to_numpy() for c in ("depth", "key", "n"))
    tables = []
    for d in range(DEPTH + 1):
        k = key[depth == d].astype(np.uint64)
        order = np.argsort(k)
        tables.append((k[order], n[depth == d][order]))
    return Model(tables)


def _packed(x: np.ndarray) -> bytes:
    """Numbers, compressed with the bytes of equal rank together."""
    return len(x).to_bytes(8, "little") + pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _packed_keys(key: np.ndarray) -> bytes:
    return _packed(np.diff(key, prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of documents (part -1), and for each block and part the block's distinct keys with how often they are learnt from."""

    def lists(block: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        context = (key >> np.uint64(8)) & np.uint64(65535)
        part = (((context * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        key, n, part = key[order], n[order], part[order].astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = [*first[1:], len(key)]
        columns = [pa.array(part[first]), pa.array([_packed_keys(key[a:b]) for a, b in zip(first, last)], pa.binary()), pa.array([_packed(n[a:b]) for a, b in zip(first, last)], pa.binary())]
        k = len(first)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *columns, pa.nulls(k, pa.int64()), pa.nulls(k, pa.string())], names)

    names = ["block", "part", "keys", "n", "doc_id", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ctw", int)
        block, size = TaskContext.get().partitionId() << 32, 0
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for batch in batches:
            k, texts = batch.num_rows, batch.column(1).to_pylist()
            if not k:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), *batch.columns], names)
            held = [bucket(i, 7) == 2 for i in batch.column(0).to_pylist()]
            for out in (False, True):
                for key, own, _ in _chunks([t for t, h in zip(texts, held) if h == out]):
                    key, n = np.unique(key[own], return_counts=True)
                    keys.append(key)
                    times.append(n * (not out))
                    if sum(map(len, keys)) > _HELD:
                        key, n = _added(keys, times)
                        keys, times = [key], [n]
            size += batch.nbytes
            if size > BLOCK_BYTES or len(keys[0]) > BLOCK_KEYS:
                yield lists(block, *_added(keys, times))
                block, size, keys, times = block + 1, 0, [], []
        if keys:
            yield lists(block, *_added(keys, times))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, part int, keys binary, n binary, doc_id long, text string")


def _nodes(blocks: DataFrame) -> DataFrame:
    """For each part: its keys, for each the chances of its bits by the contexts deeper than UPPER (not a number where there
    is none), and the sums of those contexts for the nodes of depth UPPER."""
    sums_type = pa.struct([("node", pa.int64()), ("whole", pa.float64()), ("a", pa.float64()), ("b", pa.float64())])

    def worked_out(part: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        none = np.empty(0, np.uint64), np.empty(0, np.int64)
        deeper = [(key[n > 0], n[n > 0])]
        for depth in range(DEPTH - 1, UPPER, -1):
            deeper.insert(0, _added([deeper[0][0] & np.uint64((1 << (8 * depth + 8)) - 1)], [deeper[0][1]]) if len(deeper[0][0]) else none)
        chances, sums = np.empty((8, len(key)), np.float32), []
        for bit in range(8):
            model = Model([none] * (UPPER + 1) + deeper, (bit,))
            p, there = model.chances(key, bit)
            chances[bit] = np.where(there, p, np.nan)
            if model.top[bit]:
                node, *values = model.top[bit]
                parent, at = np.unique(node & np.uint64((1 << (8 * UPPER + 8)) - 1), return_inverse=True)
                sums.append((parent.view(np.int64), *(np.bincount(at, v, len(parent)) for v in values)))
        columns = [np.concatenate(c) for c in zip(*sums)] if sums else [np.empty(0, np.int64), *(np.empty(0),) * 3]
        listed = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(sums_type))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([_packed_keys(key)], pa.binary()), pa.array([_packed(chances.ravel())], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)],
            ["part", "keys", "chances", "sums"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ctw", int)
        now, keys, times = -1, [], []
        for batch in batches:
            for part, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and keys:
                    yield worked_out(now, *_added(keys, times))
                    keys, times = [], []
                now = part
                keys.append(_unpacked_keys(key))
                times.append(_unpacked(n, np.int64))
                if sum(map(len, keys)) > max(_HELD, 2 * len(keys[0])):
                    key, n = _added(keys, times)
                    keys, times = [key], [n]
        if keys:
            yield worked_out(now, *_added(keys, times))

    lists = blocks.where("part >= 0").select("part", "keys", "n").repartition("part").sortWithinPartitions("part")
    return lists.mapInArrow(run, "part int, keys binary, chances binary, sums array<struct<node: long, whole: double, a: double, b: double>>")


def _upper(nodes: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For depths 0 to UPPER, by node: weight of stopping there (not a number where there is none) and chance of a one."""
    sums = nodes.select(F.explode("sums").alias("s")).groupBy("s.node").agg(F.sum("s.whole"), F.sum("s.a"), F.sum("s.b")).toArrow()
    at, split, a, b = (c.to_numpy() for c in sums.columns)
    out = []
    for depth in range(UPPER, -1, -1):
        estimate = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
        size = 1 << (8 * depth + 8)
        stop, here = np.full(size, np.nan), np.full(size, 0.5)
        stop[at], here[at] = 1 / (1 + np.exp(np.clip(split - estimate, -700, 700))), (b + 0.5) / (a + b + 1)
        out.insert(0, (stop, here))
        whole = np.logaddexp(estimate, split) - np.log(2)
        at, back = np.unique(at & ((size >> 8) - 1), return_inverse=True)
        split, a, b = (np.bincount(back, x, len(at)) for x in (whole, a, b))
    return out


def _log_chances(key: np.ndarray, chances: np.ndarray, upper: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each key's byte: the deeper contexts' chances of its bits (8, keys), mixed with the upper nodes."""
    out, byte = np.zeros(len(key)), key & np.uint64(255)
    for bit in range(8):
        prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        p = np.where(np.isnan(chances[bit]), 0.5, chances[bit].astype(np.float64))
        for depth in range(UPPER, -1, -1):
            stop, here = (x[(key & np.uint64(((1 << (8 * depth + 8)) - 1) & ~255)) | prefix] for x in upper[depth])
            p = np.where(np.isnan(stop), 0.5, stop * np.where(one, here, 1 - here) + (1 - stop) * p)
        out += np.log10(p)
    return out


def _answers(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """block, part, keys, value: log10 probabilities of each block's keys."""
    upper = blocks.sparkSession.sparkContext.broadcast(_upper(nodes))  # at most 256 contexts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ctw", int)
        key = value = None
        for batch in batches:
            out = []
            for part, block, keys, chances in zip(*(c.to_pylist() for c in batch.columns)):
                if block < 0:  # a part's own row comes first
                    key = _unpacked_keys(keys)
                    value = _log_chances(key, _unpacked(chances, np.float32).reshape(8, -1), upper.value).astype(np.float32)
                else:
                    out.append((block, part, keys, _packed(value[np.searchsorted(key, _unpacked_keys(keys))])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "part", "keys", "value"])

    asked = blocks.where("part >= 0").select("part", "block", "keys", F.lit(None).cast("binary").alias("chances"))
    both = nodes.select("part", F.lit(-1).cast("long").alias("block"), "keys", "chances").union(asked)
    return both.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, "block long, part int, keys binary, value binary")


class Answers:
    """The values of a block's keys, most of them found in one of two tables with one place for each hash."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key)
        self.key, self.value, self.tables = key[order], value[order], []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slot = self._slot(key, factor)
            there, held = np.full(1 << _TABLE_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << _TABLE_BITS, np.float32)
            there[slot], held[slot] = key, value  # of keys with one place the last stays, in both
            self.tables.append((factor, there, held))
            other = there[slot] != key
            key, value = key[other], value[other]

    @staticmethod
    def _slot(key: np.ndarray, factor: int) -> np.ndarray:
        return ((key * np.uint64(factor)) >> np.uint64(64 - _TABLE_BITS)).view(np.int64)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """What no text of the block has as its own (the zeros before it) may have any value."""
        out, left = np.empty(len(key)), np.arange(len(key))
        for factor, there, held in self.tables:
            want = key[left]
            slot = self._slot(want, factor)
            out[left] = held[slot]
            left = left[there[slot] != want]
        out[left] = self.value[np.minimum(np.searchsorted(self.key, key[left]), len(self.key) - 1)]
        return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document, and the code length in bits per byte of its stream."""
    spark = docs.sparkSession
    counts, _ = stage(word_counts(docs), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, ends = int(total["n"]), counts.where(F.col("word") == END).first()
    ends = int(ends["c"]) if ends else 0
    low = float(np.log10(n_all + total["v"] + 1))
    sizes = [(0, *r) for r in counts.groupBy(_step("c").alias("s")).count().collect()]
    (least,) = _thresholds(sizes, HOT, 1)
    hot = counts.where((F.col("c") >= least) & (F.col("word") != END)).toArrow()  # at most HOT rows
    words, times = hot.column("word").combine_chunks(), hot.column("c").to_numpy()
    spread = spark.sparkContext.broadcast((words, np.append(times, 0)))
    blocks, _ = stage(_blocks(docs, min(65536, int(spark.conf.get("spark.sql.shuffle.partitions")))), "blocks")
    nodes, _ = stage(_nodes(blocks), "nodes")

    def rows(batch: pa.RecordBatch, answers: Answers) -> pa.RecordBatch:
        hot_words, hot_times = spread.value
        n = batch.num_rows
        own, codes, offsets = split_words(pc.ascii_lower(batch.column(1)))
        real = pc.not_equal(own, "").to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(own, value_set=hot_words), len(hot_words)).to_numpy()
        known = hot_times[at]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        keep = real[codes]
        doc, codes = doc[keep], codes[keep]
        tokens = np.bincount(doc, minlength=n) + 1
        texts = batch.column(1).to_pylist()
        scores = _sums(texts, answers.look_up)
        lengths = np.diff(_streams(texts)[1]) - DEPTH
        base = np.bincount(doc, np.log10(known + 1.0)[codes], n) + np.log10(ends + 1.0)
        seen = np.bincount(doc, (known > 0)[codes], n).astype(np.int64) + (ends > 0)
        rare = at[codes] == len(hot_words)
        pair, times = np.unique(doc[rare] * len(own) + codes[rare], return_counts=True)
        where = np.concatenate([[0], np.cumsum(np.bincount(pair // max(1, len(own)), minlength=n))]).astype(np.int32)
        items = pa.StructArray.from_arrays([own.take(pa.array(pair % max(1, len(own)))), pa.array(times.astype(np.int64))], ["word", "n"])
        held = [bucket(i, 7) == 2 for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(held), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(scores), pa.array(-scores / np.log10(2.0) / lengths), pa.ListArray.from_arrays(pa.array(where), items)],
            ["doc_id", "held_out", "n_tokens", "seen", "base", "score", "code_length_per_byte", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ctw", int)
        now, keys, values, answers = None, [], [], None
        for batch in batches:
            block, text = batch.column(0).to_numpy(), ~batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (text[1:] != text[:-1]), [True]])) if len(block) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = batch.slice(a, b - a)
                if block[a] != now:
                    now, keys, values, answers = block[a], [], [], None
                if not text[a]:  # a block's answers come before its texts
                    keys += map(_unpacked_keys, some.column(1).to_pylist())
                    values += (_unpacked(v, np.float32) for v in some.column(2).to_pylist())
                else:
                    answers = answers or Answers(keys, values)
                    yield rows(some.select(["doc_id", "text"]), answers)

    texts = blocks.where("part < 0").selectExpr("block", "2147483647 as part", "cast(null as binary) as keys", "cast(null as binary) as value", "doc_id", "text")
    both = _answers(blocks, nodes).selectExpr("block", "part", "keys", "value", "cast(null as long) as doc_id", "cast(null as string) as text").union(texts)
    both = both.repartition("block").sortWithinPartitions("block", "part").select("block", "keys", "value", "doc_id", "text")
    parts = both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, seen long, base double, score double, code_length_per_byte double, rare array<struct<word string, n long>>")
    parts, _ = stage(parts.withColumn("row", F.monotonically_increasing_id()), "scores")
    cold = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts.where(F.col("c") < least), "word")
    cold = cold.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("add"))
    base = F.col("base") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(low)
    return parts.drop("rare").join(cold, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "code_length_per_byte")
