"""Query nodes. They are plain values; `quillspark.operators.search` compiles them to one DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


class Query:
    """A node; user-defined queries subclass it and give `compile(searcher)`, a DataFrame of (id, score)."""

    def children(self) -> tuple[Query, ...]:
        return ()

    def walk(self) -> Iterator[Query]:
        yield self
        for c in self.children():
            yield from c.walk()


@dataclass(frozen=True)
class All(Query):
    pass


@dataclass(frozen=True)
class Empty(Query):
    pass


@dataclass(frozen=True)
class Contains(Query):
    """Substring of the field, case-insensitive; several words must follow each other."""

    field: str
    value: str
    anchor: bool = False
    exact: bool = False
    strict: bool = False


@dataclass(frozen=True)
class Fuzzy(Query):
    """Substring up to some typos: enough n-grams of the value close together."""

    field: str
    value: str
    distance: int = 1


@dataclass(frozen=True)
class RegexContains(Query):
    """Regex anywhere in the lower-cased field; `.` crosses lines."""

    field: str
    pattern: str


@dataclass(frozen=True)
class Term(Query):
    field: str
    value: Any


@dataclass(frozen=True)
class TermSet(Query):
    field: str
    values: tuple


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class PhrasePrefix(Query):
    field: str
    terms: tuple[str, ...]
    max_expansions: int = 50


@dataclass(frozen=True)
class RegexPhrase(Query):
    field: str
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class RegexTerm(Query):
    """Every token that the whole pattern matches counts with its own document frequency."""

    field: str
    pattern: str


@dataclass(frozen=True)
class FuzzyTerm(Query):
    field: str
    value: str
    distance: int = 1
    transpose: bool = True
    prefix: bool = False


@dataclass(frozen=True)
class Range(Query):
    field: str
    lower: Any = None
    upper: Any = None
    include_lower: bool = True
    include_upper: bool = True


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Filter(Query):
    """A typed comparison of a column; scores nothing."""

    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    min_should: int | None = None

    def children(self):
        return self.must + self.should + self.must_not

    def needed(self) -> int:
        """How many optional clauses must match: one if there are no others."""
        if self.min_should is not None:
            return self.min_should
        return int(bool(self.should) and not self.must and not self.must_not)


@dataclass(frozen=True)
class DisMax(Query):
    queries: tuple[Query, ...]
    tie: float = 0.0

    def children(self):
        return self.queries


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float

    def children(self):
        return (self.query,)


@dataclass(frozen=True)
class Const(Query):
    query: Query
    value: float

    def children(self):
        return (self.query,)


@dataclass(frozen=True)
class MoreLikeThis(Query):
    fields: tuple[str, ...]
    text: str
    min_doc_frequency: int = 5
    max_doc_frequency: int | None = None
    min_term_frequency: int = 2
    max_query_terms: int = 25
    min_word_length: int | None = None
    max_word_length: int | None = None
    boost_factor: float = 1.0
    stop_words: tuple[str, ...] = field(default=())


def simplify(q: Query) -> Query:
    """Constant folding of All and Empty, unwrapping of single clauses, optional clauses that are all needed become required."""
    if isinstance(q, Bool):
        must, should, must_not = ([simplify(c) for c in cs] for cs in (q.must, q.should, q.must_not))
        needed = q.needed()
        if not must and not should:
            return Empty()
        if any(isinstance(c, Empty) for c in must) or any(isinstance(c, All) for c in must_not):
            return Empty()
        should, must_not = [c for c in should if not isinstance(c, Empty)], [c for c in must_not if not isinstance(c, Empty)]
        if needed > len(should):
            return Empty()
        if should and needed == len(should):
            must, should, needed = must + should, [], 0
        if len(must) == 1 and not should and not must_not:
            return must[0]
        return Bool(tuple(must), tuple(should), tuple(must_not), needed)
    if isinstance(q, DisMax):
        queries = tuple(c for c in map(simplify, q.queries) if not isinstance(c, Empty))
        return Empty() if not queries else queries[0] if len(queries) == 1 else DisMax(queries, q.tie)
    if isinstance(q, (Boost, Const)):
        inner = simplify(q.query)
        return inner if isinstance(inner, Empty) else type(q)(inner, q.factor if isinstance(q, Boost) else q.value)
    return q
