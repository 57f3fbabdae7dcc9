"""Index configurations to Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DecimalType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

ID = "_node_id"
TYPES: dict[str, DataType] = {
    "text": StringType(), "string": StringType(), "i64": LongType(), "u64": LongType(), "u64_wide": DecimalType(20, 0), "f64": DoubleType(), "bool": BooleanType(),
    "date": TimestampType(), "bytes": BinaryType(), "json": StringType(), "ip": StringType(), "facet": ArrayType(StringType()),
}


@dataclass
class SchemaConfig:
    """Fields with type, stored, indexed, fast and multi (several values a row); tokenizer of the text fields; number of shards."""

    fields: list[dict[str, Any]]
    tokenizer: str = "raw_code"
    shards: int = 1
    postings: bool = True
    extra: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(data: dict | SchemaConfig) -> SchemaConfig:
        if isinstance(data, SchemaConfig):
            return data
        known = {k: data[k] for k in ("fields", "tokenizer", "shards", "postings") if data.get(k) is not None}
        out = SchemaConfig(**known, extra={k: v for k, v in data.items() if k not in known})
        names = [f["name"] for f in out.fields]
        if len(set(names)) != len(names):
            raise ValueError("a field name repeats")
        for f in out.fields:
            if f["type"] not in TYPES:
                raise ValueError(f"unknown type {f['type']!r} of field {f['name']!r}")
        return out

    def struct(self) -> StructType:
        out = [StructField(ID, LongType(), True)]
        for f in self.fields:
            if f["name"] != ID:
                kind = TYPES[f["type"]]
                flags = {k: f.get(k, k == "stored" or f["type"] in ("text", "string")) for k in ("stored", "indexed", "fast")}
                out.append(StructField(f["name"], ArrayType(kind) if f.get("multi") else kind, True, {"type": f["type"], **flags}))
        return StructType(out)

    def text_fields(self) -> list[str]:
        return [f["name"] for f in self.fields if f["type"] == "text" and not f.get("multi")]

    def analyzers(self) -> dict[str, str]:
        return {f["name"]: f.get("tokenizer", self.tokenizer) if f["type"] == "text" else "raw" for f in self.fields if f["type"] in ("text", "string", "json", "ip")}

    def to_json(self) -> dict[str, Any]:
        return {"fields": self.fields, "tokenizer": self.tokenizer, "shards": self.shards, "postings": self.postings, **self.extra}
