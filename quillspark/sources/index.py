"""A versioned index: Parquet segments, tombstones, postings and numbered manifests.

Every operation has a stamp; a delete affects documents of smaller stamps only. A commit writes the
buffered rows as one segment (partitioned by shard), the buffered deletes as tombstones, and then creates
the next manifest, which fails if another writer has: the highest manifest is the current version, and
nothing that exists is ever overwritten. Readers keep the version they opened. `merge` rewrites the live
documents as one segment; what is buffered stays buffered.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillspark.functions import text
from quillspark.functions.bm25 import Stats
from quillspark.operators import approximate
from quillspark.operators.search import Searcher, literals
from quillspark.plans import ir
from quillspark.sources.schema import ID, SchemaConfig
from quillspark.sources.storage import Storage

#: Token buckets of the postings: a term reads one of them.
TOKEN_BUCKETS = 64
#: A task that writes postings takes so many bytes of a segment at least, and where there is work for all tasks the second
#: number: every task writes a file of each bucket, and small commits and merges shouldn't scatter.
TASK_BYTES, FULL_BYTES = 4 << 20, 32 << 20
#: A file of a merged segment has about so many bytes.
MERGED_BYTES = 64 << 20
#: A row group of a segment before compression: as many tasks can read a file as it has of them.
ROW_GROUP = 32 << 20
#: Tokens that a worker groups at once.
BLOCK_TOKENS = 1 << 21
#: A block of postings: a token with the rows of a batch of documents that hold it, an entry each in every array.
BLOCK = f"token string, {ID} array<long>, _op array<long>, _row array<long>, dl array<int>, tf array<int>, positions array<array<int>>"
PARTS = (ID, "_op", "_row", "dl", "tf", "positions")
#: Regexes that match letters and digits alone, so that no match leaves a token.
_IN_TOKEN = re.compile(r"(?:[a-z0-9]|\[[a-z0-9-]+\]|\{[0-9,]+\}|[*+?]|\\d)+")


def length_column(field: str) -> str:
    return f"_len_{field}"


def blocks_of(most: int = BLOCK_TOKENS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (id, _op, _row, dl, tokens) to blocks: as many rows as a batch, or a part of it of about so many tokens, has different tokens."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(4).offsets.to_numpy()[1:] // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if (found := grouped(*batch.slice(a, b - a).columns)) is not None:
                    yield found

    def grouped(ids: pa.Array, ops: pa.Array, rows: pa.Array, lengths: pa.Array, tokens: pa.Array) -> pa.RecordBatch | None:
        flat, sizes = tokens.flatten(), np.diff(tokens.offsets.to_numpy())
        if not len(flat):
            return None
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")  # by token, document, position
        codes, owner = codes[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order]
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])  # of each posting
        codes, owner = codes[first], owner[first]
        head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])  # of each block
        listed = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)
        taken = [listed(head, c.take(pa.array(owner))) for c in (ids, ops, rows, lengths)]
        tf = pa.array(np.diff(np.r_[first, len(place)]).astype(np.int32))
        columns = [coded.dictionary.take(pa.array(codes[head])), *taken, listed(head, tf), listed(head, listed(first, pa.array(place)))]
        return pa.RecordBatch.from_arrays(columns, names=["token", *PARTS])

    return blocks  # a function inside another travels whole: workers needn't have the package


class Index:
    def __init__(self, spark: SparkSession, path: str, manifest: dict[str, Any]):
        self.spark, self.path, self.store = spark, path, Storage(spark, path)
        self.config = SchemaConfig.of(manifest["config"])
        self._load(manifest)
        self._adds: list[dict] = []
        self._frames: list[tuple[int, DataFrame]] = []
        self._deletes: list[tuple[int, int | None]] = []
        self._queries: list[tuple[int, ir.Query]] = []
        self._prepared: dict[str, Any] | None = None
        self._listed: tuple[list[str], DataFrame] | None = None

    def _load(self, manifest: dict[str, Any]) -> None:
        self.manifest = manifest
        self._stamp = manifest["stamp"]

    # ---- lifecycle ----

    @staticmethod
    def create(spark: SparkSession, path: str, config: dict | SchemaConfig) -> Index:
        config, store = SchemaConfig.of(config), Storage(spark, path)
        manifest = {"version": 0, "stamp": 0, "config": config.to_json(), "segments": [], "tombstones": [], "batches": {}}
        if _latest(store) is not None or not store.write_new(json.dumps(manifest), "manifests", "0.json"):
            raise ValueError(f"there is an index at {path}")
        return Index(spark, path, manifest)

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> Index:
        store = Storage(spark, path)
        manifest = _latest(store) if version is None else json.loads(store.read("manifests", f"{version}.json"))
        if manifest is None:
            raise ValueError(f"no index at {path}")
        return Index(spark, path, manifest)

    def reload(self) -> None:
        """The newest version; what isn't committed stays buffered."""
        self.manifest, self._prepared = _latest(self.store), None
        self._stamp = max(self._stamp, self.manifest["stamp"])

    def close(self) -> None:
        self.rollback()

    def __enter__(self) -> Index:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and (self._adds or self._frames or self._deletes or self._queries):
            self.commit()
        self.close()

    def __repr__(self) -> str:
        return f"Index(path={self.path!r}, num_docs={self.num_docs}, version={self.version})"

    # ---- writing ----

    def _next(self) -> int:
        if self._prepared is not None:
            raise ValueError("a commit is prepared: commit or roll back first")
        self._stamp += 1
        return self._stamp

    def add(self, node_id: int, **values: Any) -> int:
        if unknown := set(values) - set(self.schema.names):
            raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}")
        stamp = self._next()
        self._adds.append({ID: node_id, **values, "_op": stamp})
        return stamp

    def add_many(self, rows: DataFrame | Iterable[dict]) -> int:
        """A DataFrame with the schema's columns, or dictionaries with the id under its name."""
        if isinstance(rows, DataFrame):
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in rows.columns]
            stamp = self._next()
            self._frames.append((stamp, rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name in rows.columns), *missing)))
            return stamp
        for r in rows:
            self.add(r[ID], **{k: v for k, v in r.items() if k != ID})
        return self._stamp

    def delete(self, node_id: int) -> int:
        self._deletes.append((self._next(), node_id))
        return self._stamp

    def delete_by_query(self, query) -> int:
        self._queries.append((self._next(), self.searcher().parsed(query)))
        return self._stamp

    def delete_term(self, field: str, value: Any) -> int:
        return self.delete_by_query(ir.Term(field, value))

    def delete_all(self) -> int:
        return self.delete_by_query(ir.All())

    def update(self, node_id: int, **values: Any) -> int:
        self.delete(node_id)
        return self.add(node_id, **values)

    def run(self, operations: Iterable[tuple[str, Any]]) -> int:
        """A batch of ("add", row) and ("delete", id) in order."""
        for kind, value in operations:
            self.add(value[ID], **{k: v for k, v in value.items() if k != ID}) if kind == "add" else self.delete(value)
        return self._stamp

    def rollback(self) -> None:
        self._adds, self._frames, self._deletes, self._queries, self._prepared = [], [], [], [], None
        self._stamp = self.manifest["stamp"]

    def _rows(self) -> DataFrame | None:
        """Everything buffered, with stamps, minus what later deletes of the same batch took."""
        schema = StructType([*self.schema.fields, StructField("_op", LongType())])
        parts = [rows.withColumn("_op", F.lit(stamp).cast("long")) for stamp, rows in self._frames]
        if self._adds:
            parts.append(self.spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in self._adds], schema))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def _analyzed(self, rows: DataFrame) -> DataFrame:
        for f in self.config.text_fields():
            rows = rows.withColumn(length_column(f), F.size(text.ANALYZERS[self.config.analyzers()[f]].tokens(F.coalesce(F.col(f), F.lit("")))))
        return rows.withColumn("shard", F.pmod(F.xxhash64(ID), F.lit(self.config.shards)).cast("int"))

    def prepare_commit(self) -> None:
        """Writes all files of the next version; `commit` then only publishes it."""
        new = json.loads(json.dumps(self.manifest)) | {"version": self.manifest["version"] + 1, "stamp": self._stamp}
        rows = self._rows()
        if rows is not None:
            name = f"seg={uuid.uuid4().hex}"
            self._analyzed(rows).write.option("parquet.block.size", ROW_GROUP).partitionBy("shard").parquet(self.store.at("segments", name))
            if self.config.postings and self.config.text_fields():
                self._write_postings(name)
            new["segments"].append({"name": name, **self._counted(name)})
        taken = self.spark.createDataFrame(self._deletes, "_stop long, _node_id long") if self._deletes else None
        for stamp, query in self._queries:  # what the query finds among older documents
            hits = Searcher(self._docs(new), ID, self.config.analyzers()).run(query, need_score=False).select(F.lit(stamp).cast("long").alias("_stop"), ID)
            taken = hits if taken is None else taken.unionByName(hits)
        if taken is not None:
            name = uuid.uuid4().hex
            taken.write.parquet(self.store.at("tombstones", name))
            new["tombstones"].append({"name": name})
        self._prepared = new

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._full_schema()).parquet(self.store.at("segments", name))

    def _counted(self, segment: str) -> dict[str, Any]:
        """Documents and tokens of a segment, for its entry in the manifest."""
        fields = self.config.text_fields()
        row = self._segment(segment).agg(F.count("*").alias("n"), *(F.sum(length_column(f)).alias(f"t{k}") for k, f in enumerate(fields))).first()
        return {"blocks": True, "rows": row["n"], "tokens": {f: int(row[f"t{k}"] or 0) for k, f in enumerate(fields)}}

    def _write_postings(self, segment: str) -> None:
        """Blocks of postings. Tokens are grouped where their documents are, and each task writes its part of every bucket: nothing is shuffled."""
        docs = self._segment(segment)
        size = self.store.size("segments", segment)
        tasks = max(1, min(size // TASK_BYTES, max(2 * self.spark.sparkContext.defaultParallelism, size // FULL_BYTES)))
        out = None
        for f in self.config.text_fields():
            tokens = text.ANALYZERS[self.config.analyzers()[f]].tokens(F.col(f))
            rows = docs.where(F.col(f).isNotNull()).coalesce(tasks).withColumn("_row", F.monotonically_increasing_id())  # an id may repeat, even in one operation
            rows = rows.select(ID, "_op", "_row", F.col(length_column(f)).alias("dl"), tokens.alias("tokens")).mapInArrow(blocks_of(), BLOCK).select(F.lit(f).alias("field"), "*")
            out = rows if out is None else out.unionByName(rows)
        bucket = F.pmod(F.xxhash64("token"), F.lit(TOKEN_BUCKETS)).cast("int")
        out.withColumn("bucket", bucket).sortWithinPartitions("bucket", "field", "token").write.partitionBy("bucket").parquet(self.store.at("postings", segment))

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """Publishes the buffered operations; batch (stream name, number) makes a repeated call harmless."""
        if batch and self.manifest["batches"].get(batch[0], -1) >= batch[1]:
            self.rollback()
            return self.version
        if self._prepared is None:
            self.prepare_commit()
        new = self._prepared
        if batch:
            new["batches"][batch[0]] = batch[1]
        self._publish(new)
        self.rollback()
        return self.version

    def _publish(self, new: dict[str, Any]) -> None:
        if not self.store.write_new(json.dumps(new), "manifests", f"{new['version']}.json"):
            self._prepared = None
            raise ValueError(f"another writer has published version {new['version']}: reload, then commit again")
        self.manifest = new
        self._stamp = max(self._stamp, new["stamp"])

    def merge(self, names: Iterable[str] | None = None, partitions: int | None = None) -> int:
        """Compacts the named segments, or all: live documents become one segment. Tombstones go when all were merged.

        Buffered operations stay buffered; a prepared commit has to be published or rolled back before."""
        if self._prepared is not None:
            raise ValueError("a commit is prepared: commit or roll back first")
        every = [s["name"] for s in self.manifest["segments"]]
        chosen = every if names is None else [n for n in every if n in set(names)]
        if not chosen:
            return self.version
        docs = self._docs(self.manifest | {"segments": [{"name": n} for n in chosen]})
        name = f"seg={uuid.uuid4().hex}"
        files = -(-sum(self.store.size("segments", n) for n in chosen) // (MERGED_BYTES * self.config.shards))  # of a shard: as many tasks write it
        if partitions:
            docs = docs.repartition(partitions, "shard")
        elif self.config.shards > 1:
            docs = docs.repartition(max(1, files) * self.config.shards, "shard", F.pmod(F.xxhash64(ID, "_op"), F.lit(max(1, files))))
        docs.write.option("parquet.block.size", ROW_GROUP).partitionBy("shard").parquet(self.store.at("segments", name))
        if self.config.postings and self.config.text_fields():
            self._write_postings(name)
        kept = [s for s in self.manifest["segments"] if s["name"] not in chosen]
        self._publish(self.manifest | {"version": self.manifest["version"] + 1, "segments": [*kept, {"name": name, **self._counted(name)}], "tombstones": self.manifest["tombstones"] if kept else []})
        return self.version

    def merge_candidates(self, least: int = 8, level: float = 0.75, layer: int = 10_000, most: int = 10_000_000) -> list[list[str]]:
        """Groups of at least `least` segments of like size (in documents, by logarithmic levels), as a merge policy."""
        sizes = sorted(((s["rows"], s["name"]) for s in self.inspect_segments()), reverse=True)
        groups: list[list[str]] = []
        top = None
        for rows, name in sizes:
            if rows > most:
                continue
            at = math.log2(max(rows, layer))
            if top is None or at < top - level:
                groups.append([])
                top = at
            groups[-1].append(name)
        return [g for g in groups if len(g) >= least]

    def vacuum(self) -> None:
        """Removes files that the current version doesn't use."""
        kept = {s["name"] for s in self.manifest["segments"]} | {t["name"] for t in self.manifest["tombstones"]}
        for folder in ("segments", "postings", "tombstones"):
            for name in self.store.list(folder):
                if name not in kept:
                    self.store.delete(folder, name)

    # ---- reading ----

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def schema(self) -> StructType:
        return self.config.struct()

    @property
    def num_shards(self) -> int:
        return self.config.shards

    @property
    def num_docs(self) -> int:
        return self.documents().count()

    def _full_schema(self) -> StructType:
        lengths = [StructField(length_column(f), IntegerType()) for f in self.config.text_fields()]
        return StructType([*self.schema.fields, StructField("_op", LongType()), *lengths, StructField("shard", IntegerType())])

    def _docs(self, manifest: dict[str, Any]) -> DataFrame:
        paths = [self.store.at("segments", s["name"]) for s in manifest["segments"]]
        if not paths:
            return self.spark.createDataFrame([], self._full_schema())
        schema = StructType([*self._full_schema().fields, StructField("seg", StringType())])
        docs = self.spark.read.schema(schema).option("basePath", self.store.at("segments")).parquet(*paths).drop("seg")  # one scan, however many commits
        if manifest["tombstones"]:
            stops = self.spark.read.parquet(*(self.store.at("tombstones", t["name"]) for t in manifest["tombstones"]))
            stops = stops.groupBy(F.col(ID).alias("_dead")).agg(F.max("_stop").alias("_stop"))
            docs = docs.join(stops, (docs[ID] == stops["_dead"]) & (docs["_op"] < stops["_stop"]), "left_anti")
        return docs

    def documents(self, internal: bool = False) -> DataFrame:
        """Live documents."""
        docs = self._docs(self.manifest)
        return docs if internal else docs.select(*self.schema.names)

    def blocks(self, field: str | None = None, token: str | None = None) -> DataFrame:
        """Blocks of postings with field, seg and bucket, deleted documents among them; a token reads one bucket only."""
        names = [s["name"] for s in self.manifest["segments"]]
        schema = f"field string, {BLOCK}, seg string, bucket int"
        if not names:
            return self.spark.createDataFrame([], schema)
        if self._listed is None or self._listed[0] != names:  # the files of a segment never change: they are listed once
            read = lambda schema, some: self.spark.read.schema(schema).option("basePath", self.store.at("postings")).parquet(*(self.store.at("postings", n) for n in some))
            single = [s["name"] for s in self.manifest["segments"] if not s.get("blocks")]  # of a former layout: a row for each posting
            parts = [read(schema, some)] if (some := [n for n in names if n not in single]) else []
            if single:
                rows = read(f"field string, token string, {ID} long, _op long, _row long, dl int, tf int, positions array<int>, seg string, bucket int", single)
                parts.append(rows.select("field", "token", *(F.array(p).alias(p) for p in PARTS), "seg", "bucket"))
            self._listed = names, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        out = self._listed[1]
        if token is not None:
            out = out.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(token)), F.lit(TOKEN_BUCKETS)).cast("int")) & (F.col("token") == token))
        return out if field is None else out.where(F.col("field") == field)

    def spread(self, blocks: DataFrame, *parts: str) -> DataFrame:
        """The postings of live documents in blocks: a row for each, with the parts named (the others aren't read) in place of the arrays."""
        stopped = bool(self.manifest["tombstones"])
        wanted = [p for p in PARTS if p in parts or stopped and p in (ID, "_op")]
        out = blocks.select(*(c for c in blocks.columns if c not in PARTS), F.inline(F.arrays_zip(*wanted)))
        if stopped:
            stops = self.spark.read.parquet(*(self.store.at("tombstones", t["name"]) for t in self.manifest["tombstones"])).groupBy(F.col(ID).alias("_dead")).agg(F.max("_stop").alias("_stop"))
            out = out.join(stops, (out[ID] == stops["_dead"]) & (out["_op"] < stops["_stop"]), "left_anti")
        return out.drop(*(p for p in wanted if p not in parts))

    def postings(self, field: str | None = None, token: str | None = None) -> DataFrame:
        """field, token, id, tf, dl, positions of live documents; a token reads one bucket only."""
        return self.spread(self.blocks(field, token), *PARTS)

    def term_dictionary(self, field: str) -> DataFrame:
        """token, df (documents), cf (occurrences)."""
        blocks = self.blocks(field)
        if self.manifest["tombstones"]:
            return self.spread(blocks, "tf").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        cf = F.aggregate("tf", F.lit(0).cast("long"), lambda a, n: a + n)
        return blocks.groupBy("token").agg(F.sum(F.size("tf")).alias("df"), F.sum(cf).alias("cf"))

    def searcher(self, stats: Stats | None = None, quantize_norm: bool = False) -> Searcher:
        docs = self.documents(internal=True).drop("_op", "shard")
        out = IndexSearcher(docs, ID, self.config.analyzers(), stats, {f: length_column(f) for f in self.config.text_fields()}, quantize_norm)
        out.index = self if self.config.postings else None
        return out

    def search(self, query, limit: int = 10, highlights: bool = False, allowed_ids: Iterable[int] | None = None, fields: bool = False, offset: int = 0) -> DataFrame:
        names = self.schema.names[1:] if fields or highlights else False
        out = self.searcher().search(query, limit, offset, allowed_ids, names, highlights)
        return out if fields or not highlights else out.select(ID, "score", "highlights")

    # ---- statistics of several indexes ----

    def export_stats(self, query) -> dict:
        return self.searcher().export_stats(query).to_json()

    @staticmethod
    def merge_stats(parts: Iterable[dict]) -> dict:
        out = Stats()
        for p in parts:
            out = out.merge(Stats.from_json(p))
        return out.to_json()

    def search_with_global_stats(self, query, stats: dict, limit: int = 10) -> DataFrame:
        return self.searcher(Stats.from_json(stats)).search(query, limit)

    # ---- copies ----

    def _files(self, manifest: dict[str, Any]) -> dict[str, str]:
        """Relative path to folder of every directory that a version uses."""
        names = [("segments", s["name"]) for s in manifest["segments"]] + [("tombstones", t["name"]) for t in manifest["tombstones"]]
        names += [("postings", s["name"]) for s in manifest["segments"] if self.store.exists("postings", s["name"])]
        return {f"{a}/{b}": a for a, b in names}

    def export_snapshot_to(self, path: str) -> str:
        """Copies the current version to another path."""
        target = Storage(self.spark, path)
        for name in self._files(self.manifest):
            target.copy_in(self.store.at(name), name)
        target.write_new(json.dumps(self.manifest), "manifests", f"{self.version}.json")
        return path

    @staticmethod
    def import_snapshot_from(spark: SparkSession, source: str, path: str) -> Index:
        Index.open(spark, source).export_snapshot_to(path)
        return Index.open(spark, path)

    def _read_all(self, name: str) -> list[tuple[str, bytes]]:
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.store.at(name)).select("path", "content")
        return [(f"{name}/{r['path'].split(f'/{name}/', 1)[1]}", bytes(r["content"])) for r in rows.toLocalIterator()]

    def export_snapshot(self) -> bytes:
        """The current version as one zip, for indexes that fit the driver; else export_snapshot_to."""
        return self._zip(list(self._files(self.manifest)), [])

    def _zip(self, names: list[str], removed: list[str], base: str | None = None) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("manifest.json", json.dumps(self.manifest))
            z.writestr("removed.json", json.dumps({"removed": removed, "base": base}))
            for n in names:
                for path, data in self._read_all(n):
                    z.writestr(path, data)
        return out.getvalue()

    @staticmethod
    def _unzip(store: Storage, data: bytes) -> dict[str, Any]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            manifest = json.loads(z.read("manifest.json"))
            for name in z.namelist():
                if name not in ("manifest.json", "removed.json"):
                    stream = store.fs.create(store._path(store.at(name)), True)
                    stream.write(bytearray(z.read(name)))
                    stream.close()
        if not store.write_new(json.dumps(manifest), "manifests", f"{manifest['version']}.json"):
            raise ValueError(f"there is a version {manifest['version']} already")
        return manifest

    @staticmethod
    def import_snapshot(spark: SparkSession, data: bytes, path: str) -> Index:
        return Index(spark, path, Index._unzip(Storage(spark, path), data))

    def version_hash(self) -> str:
        return _hash(self.manifest)

    def shard_versions(self) -> list[str]:
        """A hash of each shard's files and of the tombstones, which may concern any shard."""
        fixed = [self.manifest["tombstones"], self.manifest["config"]]
        files = lambda shard: [[s["name"], self.store.list("segments", s["name"], f"shard={shard}")] for s in self.manifest["segments"]]
        return [hashlib.sha256(json.dumps([*fixed, [x for x in files(k) if x[1]]], sort_keys=True).encode()).hexdigest()[:16] for k in range(self.num_shards)]

    def history(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.list("manifests") if n.endswith(".json"))

    def _since(self, since: int) -> tuple[list[str], dict[str, Any]]:
        """Folders that came after a version that is still in the history; those that went, and the version's hash."""
        if since not in self.history():
            raise ValueError(f"version {since} isn't known: take a snapshot")
        before = json.loads(self.store.read("manifests", f"{since}.json"))
        old, new = self._files(before), self._files(self.manifest)
        return [n for n in new if n not in old], {"removed": [n for n in old if n not in new], "base": _hash(before)}

    def _fits(self, about: dict[str, Any]) -> None:
        if about["base"] != self.version_hash():
            raise ValueError("the delta was made from another version than this index has: take a snapshot")

    def export_sharded_delta(self, since: int) -> bytes:
        """What changed since a version that is still in the history, for changes that fit the driver; else export_sharded_delta_to."""
        added, about = self._since(since)
        return self._zip(added, about["removed"], about["base"])

    def apply_sharded_delta(self, delta: bytes) -> None:
        with zipfile.ZipFile(io.BytesIO(delta)) as z:
            about = json.loads(z.read("removed.json"))
        self._fits(about)
        self._load(Index._unzip(self.store, delta))
        for n in about["removed"]:
            self.store.delete(n)

    def export_sharded_delta_to(self, since: int, path: str) -> str:
        """The same as files under another path: they are copied as streams, whatever their size."""
        added, about = self._since(since)
        target = Storage(self.spark, path)
        for name in added:
            target.copy_in(self.store.at(name), name)
        if not target.write_new(json.dumps(about | {"added": added, "manifest": self.manifest}), "delta.json"):
            raise ValueError(f"there is a delta at {path}")
        return path

    def apply_sharded_delta_from(self, path: str) -> None:
        source = Storage(self.spark, path)
        about = json.loads(source.read("delta.json"))
        self._fits(about)
        for name in about["added"]:
            if self.store.exists(name):  # of an attempt that was cut off: no version here uses it
                self.store.delete(name)
            self.store.copy_in(source.at(name), name)
        if not self.store.write_new(json.dumps(about["manifest"]), "manifests", f"{about['manifest']['version']}.json"):
            raise ValueError(f"there is a version {about['manifest']['version']} already")
        self._load(about["manifest"])
        for n in about["removed"]:
            self.store.delete(n)

    # ---- diagnostics ----

    def inspect_term(self, field: str, token: str) -> DataFrame:
        return self.spread(self.blocks(field, token), ID, "tf", "dl", "positions").select(ID, "tf", "dl", "positions")

    def inspect_segments(self) -> list[dict[str, Any]]:
        return [{"name": s["name"], "rows": s["rows"], "bytes": self.store.size("segments", s["name"]), "postings_bytes": self.store.size("postings", s["name"])} for s in self.manifest["segments"]]

    def space_usage(self) -> dict[str, int]:
        return {k: sum(self.store.size(n) for n, folder in self._files(self.manifest).items() if folder == k) for k in ("segments", "postings", "tombstones")}

    def fields_metadata(self) -> list[dict[str, Any]]:
        return [{"name": f.name, "type": f.dataType.simpleString(), **f.metadata} for f in self.schema.fields]

    def validate(self) -> bool:
        """Whether every file of the version is there and readable."""
        return all(self.store.exists(n) for n in self._files(self.manifest)) and self.documents().agg(F.count("*")).first() is not None

    def trace_search(self, query) -> str:
        plan = self.searcher().run(query)
        return plan._jdf.queryExecution().toString()


def _hash(manifest: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps([manifest[k] for k in ("segments", "tombstones", "config")], sort_keys=True).encode()).hexdigest()[:16]


def _latest(store: Storage) -> dict[str, Any] | None:
    """The highest manifest that was written to its end."""
    for n in sorted((int(x.removesuffix(".json")) for x in store.list("manifests") if x.endswith(".json")), reverse=True):
        try:
            return json.loads(store.read("manifests", f"{n}.json"))
        except ValueError:  # its writer hasn't ended yet, or never will
            continue
    return None


class IndexSearcher(Searcher):
    """Terms and phrases read the postings (one token bucket each) in place of the texts. Substrings, prefixes, regexes
    of letters and digits, and typo-tolerant substrings lie inside tokens, so they scan the postings' tokens; other
    regexes read the texts of those documents only whose tokens hold the regex's literals. The rest scans documents."""

    index: Index | None = None

    def corpus(self, *fields: str) -> tuple[int, dict[str, int]]:
        """From the manifest, where nothing was deleted."""
        if self.index is not None and self.stats is None and not self.quantize and not self.index.manifest["tombstones"]:
            segments = self.index.manifest["segments"]
            known = self.index.config.text_fields()
            if all(f in known for f in fields):
                self._corpus = {f: (sum(s["rows"] for s in segments), sum(s["tokens"][f] for s in segments)) for f in known} or self._corpus
        return super().corpus(*fields)

    def _whole_tokens(self, q: ir.Query) -> bool:
        """Whether the postings hold every run of letters and digits of the query's field."""
        field = getattr(q, "field", None)
        return self.index is not None and not self.quantize and self.stats is None and field in self.index.config.text_fields() and self.index.config.analyzers()[field] == "simple"

    def _inside(self, q: ir.Query) -> DataFrame | None:
        """id, seg, _row, dl, tf of a query whose matches lie inside tokens or are runs of neighbouring tokens."""
        if not self._whole_tokens(q):
            return None
        rows, token = self.index.blocks(q.field), F.col("token")
        if isinstance(q, ir.RegexContains):
            if not _IN_TOKEN.fullmatch(q.pattern):
                return None
            count = F.regexp_count(token, F.lit(q.pattern))
            return self._summed(rows.where(token.rlike(q.pattern)), count)
        if not isinstance(q, (ir.Contains, ir.PhrasePrefix)) or getattr(q, "strict", False):
            return None
        words = [t.lower() for t in q.terms] if isinstance(q, ir.PhrasePrefix) else text.query_tokens(q.value)[0]
        if not words:
            return None
        first = isinstance(q, ir.PhrasePrefix) or q.anchor
        last = isinstance(q, ir.Contains) and q.exact
        if len(words) == 1:
            w = words[0]
            if first or last:
                test = token == w if first and last else token.startswith(w) if first else token.endswith(w)
                return self._summed(rows.where(test), F.lit(1))
            if any(w[:k] == w[-k:] for k in range(1, len(w))):  # matches may overlap
                return self._summed(rows.where(token.contains(w)), F.regexp_count(token, F.lit(f"(?={re.escape(w)})")))
            return self._summed(rows.where(token.contains(w)), ((F.octet_length(token) - F.octet_length(F.replace(token, F.lit(w), F.lit("")))) / len(w.encode())).cast("int"))
        hits = None
        for k, w in enumerate(words):
            if k == 0 and not first:
                some = rows.where(token.endswith(w))
            elif k == len(words) - 1 and not last:
                some = rows.where(token.startswith(w))
            else:
                some = self.index.blocks(q.field, w)
            places = self.index.spread(some, ID, "_row", "dl", "positions").groupBy(F.col(ID).alias("id"), "seg", "_row").agg(F.first("dl").alias("dl"), F.flatten(F.collect_list("positions")).alias(f"p{k}"))
            hits = places if hits is None else hits.join(places.drop("dl"), ["id", "seg", "_row"])

        def starts(p: Column) -> Column:
            out = F.array_contains("p1", p + 1)
            for k in range(2, len(words)):
                out = out & F.array_contains(f"p{k}", p + k)
            return out

        return hits.select("id", "seg", "_row", "dl", F.size(F.filter("p0", starts)).cast("long").alias("tf")).where("tf > 0")

    def _summed(self, rows: DataFrame, times: Column) -> DataFrame:
        """Blocks' postings added up by document; times a token's tf counts."""
        rows = self.index.spread(rows.withColumn("_times", times), ID, "_row", "dl", "tf")
        return rows.groupBy(F.col(ID).alias("id"), "seg", "_row").agg(F.first("dl").alias("dl"), F.sum(F.col("tf") * F.col("_times")).alias("tf"))

    def _fuzzy(self, q: ir.Fuzzy) -> DataFrame | None:
        """id, score: the n-grams' places come from the tokens that hold them; windows of them are looked for in Python."""
        plan = approximate.FuzzyPlan(q.value, q.distance)
        if not plan.grams or not self._whole_tokens(q):
            return None
        grams, token = list(enumerate(plan.grams)), F.col("token")
        some = token.contains(plan.grams[0])
        for g in plan.grams[1:]:
            some = some | token.contains(g)
        held = F.array_compact(F.array(*(F.when(token.contains(g), F.lit(k)) for k, g in grams)))
        rows = self.index.spread(self.index.blocks(q.field).where(some).withColumn("g", held), ID, "_row", "dl", "positions")
        codes = F.flatten(F.transform("positions", lambda p: F.transform("g", lambda g: p.cast("long") * len(grams) + g)))
        rows = rows.select(F.col(ID).alias("id"), "seg", "_row", "dl", codes.alias("codes"))
        rows = rows.groupBy("id", "seg", "_row").agg(F.first("dl").alias("dl"), F.sort_array(F.flatten(F.collect_list("codes"))).alias("codes"))
        found = approximate.fuzzy_windows_udf(q.value, q.distance)
        hits = rows.select("id", "dl", found("codes").alias("f")).select("id", "dl", "f.tf", "f.misses")
        return self._scored(q.field, hits, -1000.0 * F.col("misses"))

    def _tokens(self, field: str, keep) -> DataFrame:
        if self.index is None:
            return super()._tokens(field, keep)
        return self.index.spread(self.index.blocks(field).where(keep(F.col("token"))), ID, "dl", "tf").select(F.col(ID).alias("id"), "token", F.col("tf").cast("long").alias("tf"), "dl")

    def _indexed(self, q: ir.Query) -> tuple[str, ...] | None:
        """The tokens that a query looks for in the postings, if those answer it."""
        if self.index is None or self.quantize or getattr(q, "field", None) not in self.index.config.text_fields():
            return None
        if isinstance(q, ir.Term):
            return (str(q.value).lower(),)
        if isinstance(q, ir.Phrase) and not q.slop:
            return tuple(t.lower() for t in q.terms)
        if isinstance(q, ir.Contains) and q.anchor and q.exact and not q.strict and not self.analyzer(q.field).camel and self.analyzers.get(q.field) != "default":
            words = tuple(text.query_tokens(q.value)[0])
            return words if len(words) == 1 else None
        return None

    def leaf(self, q: ir.Query):
        if self.stats is None and (self._indexed(q) or self._inside(q) is not None or isinstance(q, ir.Fuzzy)):
            return None
        return super().leaf(q)

    def table(self, q: ir.Query) -> DataFrame | None:
        tokens = self._indexed(q)
        if not tokens or self.stats is not None:
            inside = self._inside(q) if self.stats is None else None
            if inside is not None:
                return self._scored(q.field, inside)
            return (self._fuzzy(q) if isinstance(q, ir.Fuzzy) else None) or super().table(q)
        parts = ID, "_row", "dl", "tf", *(["positions"] if len(tokens) > 1 else [])
        lists = [self.index.spread(self.index.blocks(q.field, t), *parts).select(F.col(ID).alias("id"), "seg", "_row", "dl", F.col("tf").cast("long").alias("tf"), *([F.col("positions").alias(f"p{k}")] if len(tokens) > 1 else [])) for k, t in enumerate(tokens)]
        if len(lists) == 1:
            return self._scored(q.field, lists[0].select("id", "dl", "tf"))
        hits = lists[0]
        for k, other in enumerate(lists[1:], 1):
            hits = hits.join(other.select("id", "seg", "_row", f"p{k}"), ["id", "seg", "_row"])  # rows that repeat an id are rows of their own

        def starts(p: Column) -> Column:
            """Whether the phrase starts at position p of its first token."""
            out = F.array_contains(F.col("p1"), p + 1)
            for k in range(2, len(tokens)):
                out = out & F.array_contains(F.col(f"p{k}"), p + k)
            return out

        hits = hits.select("id", "dl", F.size(F.filter("p0", starts)).cast("long").alias("tf"))
        dfs = None if isinstance(q, ir.Contains) else [x.count() for x in lists]
        return self._scored(q.field, hits, dfs=dfs)

    def _holding(self, field: str, words: list[str]) -> DataFrame:
        """Ids of the documents whose tokens hold every word."""
        token = F.col("token")
        some = token.contains(words[0])
        for w in words[1:]:
            some = some | token.contains(w)
        held = F.array_compact(F.array(*(F.when(token.contains(w), F.lit(k)) for k, w in enumerate(words))))
        rows = self.index.spread(self.index.blocks(field).where(some).withColumn("w", held), ID, "_row").select(ID, "seg", "_row", "w")
        return rows.groupBy(ID, "seg", "_row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("w")))).alias("n")).where(F.col("n") == len(words)).select(ID).distinct()

    def run(self, query, need_score: bool = True) -> DataFrame:
        """Unions of terms, as of more-like-this, add up in one aggregation without a join."""
        q = ir.simplify(self.parsed(query))
        if isinstance(q, ir.RegexContains) and self._whole_tokens(q) and not _IN_TOKEN.fullmatch(q.pattern) and (words := literals(q.pattern)):
            n, tokens = self.corpus(q.field)
            few = Searcher(self.docs.join(self._holding(q.field, words), ID, "left_semi"), self.id, self.analyzers, None, self.lengths)
            match, ((_, tf, _),) = few.leaf(q)
            hits = few.docs.where(match).select(F.col(self.id).alias("id"), tf.alias("tf"), few.length(q.field).alias("dl"))
            return self._scored(q.field, hits).withColumnRenamed("id", self.id)
        if isinstance(q, ir.Bool) and q.should and not q.must and not q.must_not and q.needed() == 1 and self.stats is None:
            terms = [(c.query, c.factor) if isinstance(c, ir.Boost) else (c, 1.0) for c in q.should]
            if all(self._indexed(c) for c, _ in terms):
                out = None
                for c, factor in terms:
                    one = self.table(c).withColumn("score", F.col("score") * float(factor))
                    out = one if out is None else out.unionByName(one)
                return out.groupBy(F.col("id").alias(self.id)).agg(F.sum("score").alias("score"))
        return super().run(q, need_score)

    def export_stats(self, query) -> Stats:
        return Searcher(self.docs, self.id, self.analyzers, None, self.lengths, self.quantize).export_stats(query)

    def explain(self, query) -> DataFrame:
        return Searcher(self.docs, self.id, self.analyzers, self.stats, self.lengths, self.quantize).explain(query)
