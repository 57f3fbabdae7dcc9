"""Snippets: the best fragment of a text for a query's terms, with matches marked. Used on top results only."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspark.functions import text
from quillspark.operators.search import Searcher
from quillspark.plans import ir

_WORD = re.compile(r"[^\W_]+")


def query_terms(q: ir.Query) -> dict[str, set[str]]:
    """Single words that a query looks for, by field."""
    out: dict[str, set[str]] = {}
    for node in q.walk():
        if isinstance(node, (ir.Phrase, ir.PhrasePrefix)):
            out.setdefault(node.field, set()).update(t.lower() for t in node.terms)
        elif isinstance(node, ir.TermSet):
            out.setdefault(node.field, set()).update(str(v).lower() for v in node.values)
        elif isinstance(node, (ir.Term, ir.FuzzyTerm, ir.Contains, ir.Fuzzy)):
            out.setdefault(node.field, set()).update(text.query_tokens(str(node.value))[0])
    return out


def best_fragment(source: str, weights: dict[str, float], longest: int = 150) -> tuple[str, list[tuple[int, int]]]:
    """A run of whole words of at most `longest` characters with the largest sum of weights (the earliest of equals), and matches in it."""
    best, now = (0.0, 0, 0, []), [0.0, 0, 0, []]
    for m in _WORD.finditer(source):
        if m.end() - now[1] > longest:
            if now[0] > best[0]:
                best = tuple(now)
            now = [0.0, m.start(), m.start(), []]
        now[2] = m.end()
        if w := weights.get(m.group().lower()):
            now[0] += w
            now[3] = [*now[3], m.span()]
    if now[0] > best[0]:
        best = tuple(now)
    score, start, stop, marks = best
    return (source[start:stop], [(a - start, b - start) for a, b in marks]) if score else ("", [])


def to_html(fragment: str, marks: list[tuple[int, int]], before: str = "<b>", after: str = "</b>") -> str:
    out, done = [], 0
    for a, b in sorted(marks):
        if a >= done:
            out += [html.escape(fragment[done:a]), before, html.escape(fragment[a:b]), after]
            done = b
    return "".join(out) + html.escape(fragment[done:])


def snippet_udf(weights: dict[str, float], longest: int, before: str, after: str) -> Callable[..., Column]:
    @pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_html(*best_fragment(t or "", weights, longest), before, after))

    return make


def snippets(searcher, top: DataFrame, query, field: str, longest: int = 150, before: str = "<b>", after: str = "</b>") -> DataFrame:
    """top (id, score) with a column snippet; a term weighs 1 / (1 + its document frequency)."""
    words = sorted(query_terms(searcher.parsed(query)).get(field, ()))
    weights: dict[str, float] = {}
    if words:
        row = searcher.docs.agg(*(F.sum(Searcher.leaf(searcher, ir.Term(field, w))[0].cast("long")).alias(f"d{k}") for k, w in enumerate(words))).first()
        weights = {w: 1 / (1 + int(row[k] or 0)) for k, w in enumerate(words)}
    rows = searcher.docs.select(searcher.id, field).join(F.broadcast(top), searcher.id)  # top is at most a page of results
    return rows.withColumn("snippet", snippet_udf(weights, longest, before, after)(F.col(field))).drop(field).orderBy(F.desc("score"), searcher.id)
