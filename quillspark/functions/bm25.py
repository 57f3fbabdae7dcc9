"""BM25 with k1 = 1.2 and b = 0.75, as column expressions over counted statistics."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


@dataclass
class Stats:
    """Corpus counts: documents, tokens by field, documents by leaf. Sums of parts are those of the whole."""

    docs: int = 0
    tokens: dict[str, int] = field(default_factory=dict)
    df: dict[str, int] = field(default_factory=dict)

    def merge(self, other: Stats) -> Stats:
        both = lambda a, b: {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}
        return Stats(self.docs + other.docs, both(self.tokens, other.tokens), both(self.df, other.df))

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> Stats:
        return Stats(int(data["docs"]), dict(data["tokens"]), dict(data["df"]))


def idf(docs: int, df: int) -> float:
    return math.log(1 + (docs - df + 0.5) / (df + 0.5))


def idf_column(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def score(weight: Column | float, tf: Column, length: Column, average: Column | float) -> Column:
    """weight (the idf, or a sum of them) times the saturated term frequency."""
    weight = F.lit(weight) if isinstance(weight, (int, float)) else weight
    average = F.lit(float(average)) if isinstance(average, (int, float)) else average
    return weight * (1 + K1) * tf / (tf + K1 * (1 - B + B * length / average))


_NORMS = list(range(40)) + [((8 + (i - 24) % 8) << ((i - 24) // 8 - 1)) + 24 for i in range(40, 256)]


def quantized(length: Column) -> Column:
    """A length rounded down to what one byte can hold (exact up to 40, then eight steps for each doubling)."""
    return F.element_at(F.lit([n for n in _NORMS]), F.greatest(F.lit(1), F.array_size(F.filter(F.lit([n for n in _NORMS]), lambda n: n <= length))))
