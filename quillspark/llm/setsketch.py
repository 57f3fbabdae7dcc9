"""Near-duplicate documents by SetSketch registers, confirmed on whole shingle sets.

Shingles are five words. A document's sketch has REGISTERS registers, each the truncated, exponentially
spaced minimum of the shingles' exponential variates; registers of a union are the elementwise maximum,
and two sketches agree in a register with nearly the probability of the sets' Jaccard similarity.

1. One scan makes set sizes, set digests and sketches. Equal sets fall into one class, represented by
   its smallest doc_id; only representatives go on.
2. Bands of registers are bucketed; each bucket links its members to its smallest one (a star, never
   all pairs). A pair at similarity 0.85 misses all bands once in 50 million, one at 0.8 once in 300,000.
3. Pairs pass a likelihood test on their registers and known set sizes (a true link fails it about once
   in a million), then the whole sets of the survivors are compared: the members' texts go to their star's
   centre, those of a centre with many in groups of GROUP, so each text moves once a pair and no set is repeated.
4. Where a bucket still holds several components, its other pairs across components are compared too,
   in blocks of BLOCK x BLOCK sketches, and survivors confirmed on whole sets. So no link is lost to the stars.
5. Components come from alternating large-star and small-star rounds, each written to the shared folder.

Cases: a null or blank text has an empty set and links with nothing; fewer than five words form one
shingle; a null doc_id forms no link, its component_id is null and it is kept; rows that repeat a doc_id
share its component; columns other than doc_id and text don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, claim, stage

WORDS, PERCENT = 5, 85
REGISTERS, BAND, BASE, TOP = 96, 4, 1.001, 65534
BANDS = REGISTERS // BAND
#: Log-likelihood that a pair may lose against its best estimate and still be confirmed on whole sets.
SLACK = 12.0
BLOCK, GROUP = 256, 256
#: Ids, and pairs, that are broadcast at most (some 64 MB each); beyond, their join shuffles.
BROADCAST_IDS, BROADCAST_PAIRS = 4_000_000, 1_000_000

_random = np.random.default_rng(20)
_multiply = _random.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_place = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


_hash_of = _WordHash()


def _begin() -> None:
    claim("setsketch", _hash_of.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mixed((h * _place[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - WORDS + 1
    total = h[:n] * _place[0]
    for k in range(1, WORDS):
        total += h[k : k + n] * _place[k]
    return np.unique(_mixed(total))


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of well-mixed 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(elements), 512):
        np.minimum(least, (elements[k : k + 512, None] * _multiply).min(axis=0), out=least)
    variate = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP + 1).astype(np.uint16) if len(elements) else np.zeros(REGISTERS, np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_grid = np.linspace(0, 1, 101)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float = PERCENT / 100) -> np.ndarray:
    """Whether each pair may be as similar as least: the joint likelihood of its registers, given the set sizes, against the best estimate's.

    For similarity j and size shares u + v = 1 a register of the first exceeds the second's with
    probability p(u - v j), is less with p(v - u j), where p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    # estimates beyond the sizes' own bound on similarity don't exist
    j = np.minimum(_grid[None, :], most[:, None] - 1e-9).clip(0)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        return more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(np.clip(1 - up - down, 1e-9, 1))

    near = likelihood(np.minimum(np.maximum(_grid[_grid >= least - 1e-9][None, :], least), np.maximum(most, least)[:, None] - 1e-9))
    return (most >= least - 1e-9) & (near.max(axis=1) >= likelihood(j).max(axis=1) - SLACK)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (digest of the set), registers."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        _begin()
        n, digest, sketch = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text)
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketch.append(registers(s).tobytes())
        d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "registers"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_shingles long, d1 long, d2 long, registers binary")


def buckets(reps: DataFrame) -> DataFrame:
    """bucket, doc_id: a row for each band of each representative."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(ids), BANDS)
        keys = _mixed(_mixed(bands) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(ids, BANDS))], ["bucket", "doc_id"])

    return arrow_map(reps.select("doc_id", "registers"), rows, "bucket long, doc_id long")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose registers pass the likelihood test."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (4, 5))
        ok = plausible(ra, rb, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent / 100)
        return batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return arrow_map(joined.select("a", "b", "na", "nb", "ra", "rb"), rows, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), distinct, that link by their whole sets. Of rows that repeat an id, any that links counts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        now, centre = None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, group, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, group) != now:  # a group's centre comes first
                    now, centre = (a, group), shingles(text)
                elif b != a:
                    own = shingles(text)
                    common = len(np.intersect1d(centre, own, assume_unique=True))
                    if 100 * common >= percent * (len(centre) + len(own) - common):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    grouped = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("group"), "b")
    centres = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("a").alias("b"))
    wanted, _ = stage(grouped.unionByName(centres).withColumn("first", F.col("a") == F.col("b")), "wanted")
    n = wanted.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("b"), "text").where("b is not null")
    moved = texts.join(F.broadcast(wanted) if n <= BROADCAST_PAIRS else wanted, "b").select("a", "group", "b", "text", "first")
    ordered = moved.repartition("a", "group").sortWithinPartitions("a", "group", F.desc("first"), "b").select("a", "group", "b", "text")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node that has a link (a, b)."""
    edges, _ = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, _ = stage(small, "edges")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == now:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _block_pairs(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs across components inside a bucket whose sketches are plausible, block by block.

    members: bucket, n (the bucket's size), doc_id, component, n_shingles, registers.
    """

    def compare(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        ids, comp, size = (table.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        first, second = np.flatnonzero(left), np.flatnonzero(~left if (~left).any() else left)
        out = []
        for i in first:
            j = second[(comp[second] != comp[i]) & (100 * np.minimum(size[second], size[i]) >= percent * np.maximum(size[second], size[i]))]
            if len(j):
                ok = j[plausible(np.broadcast_to(sketch[i], (len(j), REGISTERS)), sketch[j], np.full(len(j), size[i]), size[j], percent / 100)]
                out.append(np.stack([np.minimum(ids[ok], ids[i]), np.maximum(ids[ok], ids[i])], 1))
        pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "doc_id", "component", "n_shingles", "registers")
    return keyed.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; links from a similarity of percent hundredths on (80 at least)."""
    if not 80 <= percent <= 100:
        raise ValueError("the bands are made for similarities of 0.8 to 1")
    made, _ = stage(sketches(docs), "sketches")
    classes = made.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce(F.col("rep"), F.col("doc_id"))).otherwise(F.col("doc_id"))
    named = made.join(classes, ["d1", "d2"], "left").withColumn("rep", rep)
    named, _ = stage(named.select("doc_id", "n_shingles", "rep", F.when((F.col("rep") == F.col("doc_id")) & (F.col("n_shingles") > 0), F.col("registers")).alias("registers")), "classes")
    reps = named.where("registers is not null").select("doc_id", "n_shingles", "registers")

    rows = buckets(reps)
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n")).where("a <> z")
    full, _ = stage(rows.join(shared, "bucket").select("bucket", "a", "n", "doc_id"), "buckets")  # buckets of one document end here
    stars = full.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    stars, _ = stage(_likely(stars, reps, percent), "stars")
    links, _ = stage(_confirmed(stars, docs, percent), "links")
    found, _ = stage(components(links), "components")

    label = found.select(F.col("node").alias("doc_id"), "component")
    inside = full.where("n > 2").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = inside.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    members = inside.join(mixed, "bucket", "left_semi").where("doc_id <> a").join(reps, "doc_id").select("bucket", "n", "doc_id", "component", "n_shingles", "registers")
    rest, _ = stage(_block_pairs(members, percent), "rest")
    if not rest.isEmpty():
        more, _ = stage(_confirmed(rest, docs, percent), "links")
        if not more.isEmpty():
            found, _ = stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    final = named.select("doc_id", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce(F.col("component"), F.col("rep"))
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't among ids (column doc_id): broadcast up to BROADCAST_IDS of them, else shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id, once. Rows with a null doc_id stay."""
    found, _ = stage(near_duplicates(docs, percent).select("doc_id", "kept"), "near-duplicates")
    left = without(docs, found.where(~F.col("kept")).select("doc_id").distinct())
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    again, _ = stage(again, "repeated")
    if again.isEmpty():
        return left
    return without(left, again).unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns))
