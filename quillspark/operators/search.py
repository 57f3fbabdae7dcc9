"""Compiles query nodes to DataFrames of (id, score).

A query over one table is a predicate and a score per row, so all leaves that can be told from the row
itself become column expressions of one scan: one aggregation counts documents, lengths and every leaf's
document frequency together, and the second scan filters and scores. Only queries that expand over the
token dictionary (regex and fuzzy terms) or need Python (slop, typos) make a small DataFrame of matching
rows of their own, joined by id. Nothing is collected but one row of counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import bm25, text
from quillspark.operators import approximate
from quillspark.plans import dsl, ir

_A = rf"[{text.ALNUM}]"


def quoted(s: str) -> str:
    """A literal in a Java regex."""
    return "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in s)


def java_regex(pattern: str) -> str:
    """Unicode classes, and `.` across lines; look-around and back-references are refused."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P?=", pattern):
        raise ValueError(f"look-around and back-references aren't supported: {pattern!r}")
    return f"(?sU){pattern}"


def literals(pattern: str) -> list[str]:
    """Runs that every match must hold: lower-case letters and digits outside of groups, classes and repetitions."""
    if re.search(r"[|(]", pattern):
        return []
    plain = re.sub(r"\[[^\]]*\]|\\.", "\0", pattern)
    plain = re.sub(r".(?:[*?]|\{[^}]*\})", "\0", plain)
    return [w for w in re.findall(r"[a-z0-9]+", plain) if len(w) > 1]


class Searcher:
    """Queries over the rows of docs. Statistics are those of docs, or given ones (of a larger whole)."""

    def __init__(self, docs: DataFrame, id_col: str = "_node_id", analyzers: dict[str, str] | None = None, stats: bm25.Stats | None = None, lengths: dict[str, str] | None = None, quantize_norm: bool = False):
        self.docs, self.id, self.analyzers = docs, id_col, analyzers or {}
        self.stats, self.lengths, self.quantize = stats, lengths or {}, quantize_norm
        self._corpus: dict[str, tuple[int, int]] = {}

    # ---- fields ----

    def kind(self, field: str):
        return self.docs.schema[field].dataType

    def is_text(self, field: str) -> bool:
        return isinstance(self.kind(field), StringType) and self.analyzers.get(field, "default") != "raw"

    def analyzer(self, field: str) -> text.Analyzer:
        return text.ANALYZERS[self.analyzers.get(field, "default")]

    def length(self, field: str) -> Column:
        """Tokens of a field: a stored column if there is one."""
        n = F.col(self.lengths[field]) if field in self.lengths else F.size(self.analyzer(field).tokens(field)) if self.analyzer(field).camel else text.token_count(field)
        return bm25.quantized(n) if self.quantize else n

    def corpus(self, *fields: str) -> tuple[int, dict[str, int]]:
        """Documents and tokens of each field; counted once."""
        if self.stats is not None and all(f in self.stats.tokens for f in fields):
            return self.stats.docs, self.stats.tokens
        missing = [f for f in fields if f not in self._corpus] or ([] if self._corpus or fields else [None])
        if missing:
            row = self.docs.agg(F.count("*").alias("n"), *(F.sum(self.length(f)).alias(f"t{k}") for k, f in enumerate(missing) if f)).first()
            for k, f in enumerate(missing):
                self._corpus[f or ""] = row["n"], int(row[f"t{k}"] or 0) if f else 0
        return next(iter(self._corpus.values()))[0], {f: t for f, (_, t) in self._corpus.items()}

    # ---- leaves that are column expressions ----

    def contains_pattern(self, q: ir.Contains) -> str | None:
        words, between = text.query_tokens(q.value)
        if not words:
            return None
        if self.analyzer(q.field).camel and not q.strict:
            joint, gap = f"{text.JOINT}?", f"[ {text.JOINT}]"
            words = [joint.join(map(quoted, w)) for w in words]
        else:
            gap = f"[^{text.ALNUM}]+"
            words = [quoted(w) for w in words]
        body = words[0]
        for k, w in enumerate(words[1:]):
            body += (quoted(between[k]) if q.strict else gap) + w
        return (f"(?<!{_A})" if q.anchor else "") + body + (f"(?!{_A})" if q.exact else "")

    def base_text(self, q: ir.Query) -> Column:
        if isinstance(q, ir.Contains) and self.analyzer(q.field).camel and not q.strict:
            return text.marked(q.field, True)
        return F.lower(F.col(q.field))

    def leaf(self, q: ir.Query) -> tuple[Column, list[tuple[str, Column, str | None]]] | None:
        """Whether a row matches, and its scoring parts: (key, term frequency, field or None for a constant)."""
        if isinstance(q, ir.Contains):
            pattern = self.contains_pattern(q)
            if pattern is None:
                return F.lit(False), []
            t = self.base_text(q)
            words, _ = text.query_tokens(q.value)
            plain = len(words) == 1 and not q.anchor and not q.exact and not self.analyzer(q.field).camel
            match = t.contains(words[0]) if plain else t.rlike(pattern)
            if not plain and not self.analyzer(q.field).camel:  # cheap tests first
                for w in words:
                    match = F.lower(F.col(q.field)).contains(w) & match
            w = words[0]
            if plain and not any(w[:k] == w[-k:] for k in range(1, len(w))):  # matches can't overlap: lengths tell their number
                tf = ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(w), F.lit("")))) / len(w.encode())).cast("int")
            else:
                tf = F.regexp_count(t, F.lit(f"(?={pattern})"))
            return match, [(repr(q), tf, q.field)]
        if isinstance(q, ir.RegexContains):
            t, pattern = F.lower(F.col(q.field)), java_regex(q.pattern)
            match = t.rlike(pattern)
            for w in literals(q.pattern):
                match = t.contains(w) & match
            return match, [(repr(q), F.regexp_count(t, F.lit(pattern)), q.field)]
        if isinstance(q, ir.Term) and self.is_text(q.field):
            pattern = f"(?<!{_A}){quoted(str(q.value).lower())}(?!{_A})"
            if self.analyzer(q.field).camel:
                tf = F.size(F.filter(self.analyzer(q.field).tokens(q.field), lambda t: t == str(q.value).lower()))
                return tf > 0, [(repr(q), tf, q.field)]
            t = F.lower(F.col(q.field))
            return t.contains(str(q.value).lower()) & t.rlike(pattern), [(repr(q), F.regexp_count(t, F.lit(pattern)), q.field)]
        if isinstance(q, ir.Term):
            c = F.col(q.field)
            match = F.array_contains(c, q.value) if isinstance(self.kind(q.field), ArrayType) else c == F.lit(q.value)
            return match, [(repr(q), F.lit(1), None)]
        if isinstance(q, ir.TermSet):
            if not self.is_text(q.field):
                among = lambda c: c.isin(list(q.values))
                return F.exists(F.col(q.field), among) if isinstance(self.kind(q.field), ArrayType) else among(F.col(q.field)), [(repr(q), F.lit(1), None)]
            parts = [self.leaf(ir.Term(q.field, v)) for v in q.values]
            match = F.lit(False)
            for m, _ in parts:
                match = match | m
            return match, [p for _, ps in parts for p in ps]
        if isinstance(q, (ir.Phrase, ir.PhrasePrefix)) and not getattr(q, "slop", 0):
            gap = f"[^{text.ALNUM}]+"
            terms = [t.lower() for t in q.terms]
            pattern = f"(?<!{_A})" + gap.join(map(quoted, terms)) + ("" if isinstance(q, ir.PhrasePrefix) else f"(?!{_A})")
            t = F.lower(F.col(q.field))
            match = t.rlike(pattern)
            for w in terms:
                match = t.contains(w) & match
            return match, [(repr(q), F.regexp_count(t, F.lit(f"(?={pattern})")), q.field)]
        if isinstance(q, ir.RegexPhrase):
            slots = [re.sub(r"(?<!\\)\.", lambda _: _A, p) for p in q.patterns]
            pattern = f"(?U)(?<!{_A})" + f"[^{text.ALNUM}]+".join(f"(?:{s})" for s in slots) + f"(?!{_A})"
            t = F.lower(F.col(q.field))
            return t.rlike(pattern), [(repr(q), F.regexp_count(t, F.lit(f"(?={pattern})")), q.field)]
        if isinstance(q, ir.Range):
            return self._range(q), [(repr(q), F.lit(1), None)]
        if isinstance(q, ir.Exists):
            name, _, path = q.field.partition(".")
            if q.field in self.docs.columns:
                c = F.col(q.field)
            else:
                c = F.get_json_object(F.col(name), text.json_path(path))
            return c.isNotNull() & (F.size(c) > 0 if q.field in self.docs.columns and isinstance(self.kind(q.field), ArrayType) else F.lit(True)), [(repr(q), F.lit(1), None)]
        if isinstance(q, ir.Filter):
            return self._filter(q), []
        return None

    def _bound(self, field: str, value):
        if isinstance(value, str) and field in self.docs.columns and self.kind(field).typeName() in ("timestamp", "timestamp_ntz", "date"):
            return F.lit(value).cast(self.kind(field))
        return F.lit(value)

    def _range(self, q: ir.Range) -> Column:
        def test(c: Column) -> Column:
            out = c.isNotNull()
            if q.lower is not None:
                out = out & (c >= self._bound(q.field, q.lower) if q.include_lower else c > self._bound(q.field, q.lower))
            if q.upper is not None:
                out = out & (c <= self._bound(q.field, q.upper) if q.include_upper else c < self._bound(q.field, q.upper))
            return out

        if q.field not in self.docs.columns:
            name, _, path = q.field.partition(".")
            c = F.get_json_object(F.col(name), text.json_path(path))
            return test(c if isinstance(q.lower if q.lower is not None else q.upper, str) else c.try_cast("double"))
        if isinstance(self.kind(q.field), ArrayType):
            return F.exists(F.col(q.field), test)
        if self.is_text(q.field):
            return F.exists(self.analyzer(q.field).tokens(q.field), test)
        return test(F.col(q.field))

    def _filter(self, q: ir.Filter) -> Column:
        c, v = F.col(q.field), q.value
        each = isinstance(self.kind(q.field), ArrayType)

        def any_of(test) -> Column:
            return F.exists(c, test) if each else test(c)

        def lit(x):
            return self._bound(q.field, x)

        match q.op:
            case "eq":
                return any_of(lambda x: x == lit(v))
            case "ne":
                return ~F.coalesce(any_of(lambda x: x == lit(v)), F.lit(False))
            case "lt":
                return any_of(lambda x: x < lit(v))
            case "lte":
                return any_of(lambda x: x <= lit(v))
            case "gt":
                return any_of(lambda x: x > lit(v))
            case "gte":
                return any_of(lambda x: x >= lit(v))
            case "in":
                return any_of(lambda x: x.isin(list(v)))
            case "not_in":
                return ~F.coalesce(any_of(lambda x: x.isin(list(v))), F.lit(False))
            case "between":
                return any_of(lambda x: x.between(lit(v[0]), lit(v[1])))
            case "starts_with":
                return F.exists(self.analyzer(q.field).tokens(q.field), lambda t: t.startswith(str(v).lower())) if self.is_text(q.field) else any_of(lambda x: x.startswith(str(v)))
        raise ValueError(f"unknown filter op {q.op!r}")

    # ---- leaves that are small DataFrames of their own ----

    def _tokens(self, field: str, keep) -> DataFrame:
        """id, token, tf, dl of the tokens that pass keep, from rows that have any."""
        c = F.filter(self.analyzer(field).tokens(field), keep)
        rows = self.docs.select(F.col(self.id).alias("id"), c.alias("ts"), self.length(field).alias("dl")).where(F.size("ts") > 0)
        return rows.select("id", "dl", F.explode("ts").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))

    def _by_token(self, field: str, hits: DataFrame) -> DataFrame:
        """Sum of the tokens' BM25, each with its own document frequency."""
        n, tokens = self.corpus(field)
        df = hits.groupBy("token").agg(F.count("*").alias("df"))
        each = bm25.score(bm25.idf_column(F.lit(n), F.col("df")), F.col("tf"), F.col("dl"), tokens[field] / max(n, 1))
        return hits.join(df, "token").groupBy("id").agg(F.sum(each).alias("score"))

    def _scored(self, field: str, hits: DataFrame, extra: Column | None = None, dfs: list[int] | None = None) -> DataFrame:
        """hits (id, tf, dl, ...) scored as one term whose document frequency is their number, or with the sum of idfs given."""
        n, tokens = self.corpus(field)
        hits = hits.where("tf > 0")
        weight = F.lit(sum(bm25.idf(n, d) for d in dfs)) if dfs else F.lit(bm25.idf(n, hits.count()))
        value = bm25.score(weight, F.col("tf"), F.col("dl"), tokens[field] / max(n, 1))
        return hits.select("id", (value if extra is None else value + extra).alias("score"))

    def table(self, q: ir.Query) -> DataFrame | None:
        """id, score of a query that isn't a column expression."""
        if type(q).__module__ != ir.__name__ and hasattr(q, "compile"):
            return q.compile(self)
        if isinstance(q, ir.RegexTerm):
            return self._by_token(q.field, self._tokens(q.field, lambda t: t.rlike(f"(?U)^(?:{q.pattern})$")))
        if isinstance(q, ir.FuzzyTerm):
            if q.distance > 2:
                raise ValueError("a fuzzy term allows two edits at most")
            want, d = q.value.lower(), q.distance
            if q.prefix:
                near = lambda t: F.exists(F.sequence(F.lit(max(0, len(want) - d)), F.lit(len(want) + d)), lambda n: F.levenshtein(F.substring(t, F.lit(1), n), F.lit(want)) <= d)
                return self._by_token(q.field, self._tokens(q.field, near))
            if q.transpose:  # a transposition is two edits at most: those further off can't pass
                close = approximate.damerau_udf(want, d)
                hits = self._tokens(q.field, lambda t: F.levenshtein(t, F.lit(want)) <= 2 * d)
                good = hits.select("token").distinct().where(close(F.col("token")))
                return self._by_token(q.field, hits.join(good, "token", "left_semi"))
            return self._by_token(q.field, self._tokens(q.field, lambda t: F.levenshtein(t, F.lit(want)) <= d))
        if isinstance(q, ir.Phrase):
            terms = [t.lower() for t in q.terms]
            rows = self.docs
            for t in terms:
                rows = rows.where(F.lower(F.col(q.field)).contains(t))
            count = approximate.slop_udf(terms, q.slop)
            hits = rows.select(F.col(self.id).alias("id"), count(self.analyzer(q.field).tokens(q.field)).alias("tf"), self.length(q.field).alias("dl"))
            dfs = self.docs.agg(*(F.sum(Searcher.leaf(self, ir.Term(q.field, t))[0].cast("long")).alias(f"d{k}") for k, t in enumerate(terms))).first()
            return self._scored(q.field, hits, dfs=[int(x or 0) for x in dfs])
        if isinstance(q, ir.Fuzzy):
            plan = approximate.FuzzyPlan(q.value, q.distance)
            if not plan.grams:
                return self.docs.select(F.col(self.id).alias("id"), F.lit(0.0).alias("score")).limit(0)
            low = F.lower(F.col(q.field))
            present = sum((low.contains(g).cast("int") for g in plan.grams), F.lit(0))  # each must lie in one token
            rows = self.docs.where(present >= plan.threshold).select(F.col(self.id).alias("id"), F.col(q.field).alias("t"), self.length(q.field).alias("dl"))
            found = approximate.fuzzy_udf(q.value, q.distance)
            hits = rows.select("id", "dl", found("t").alias("f")).select("id", "dl", "f.tf", "f.misses")
            return self._scored(q.field, hits, -1000.0 * F.col("misses"))
        if isinstance(q, ir.MoreLikeThis):
            return self.run(self.like_this(q))
        return None

    def like_this(self, q: ir.MoreLikeThis) -> ir.Query:
        """The weighted terms that a text is about."""
        n, _ = self.corpus(*q.fields)
        terms = Counter(w for w in text.query_tokens(q.text)[0] if (q.min_word_length or 0) <= len(w) <= (q.max_word_length or 1 << 30) and w not in q.stop_words)
        terms = {w: c for w, c in terms.items() if c >= q.min_term_frequency}
        if not terms:
            return ir.Empty()
        scored = []
        for f in q.fields:
            tokens = self.docs.select(F.explode(F.array_intersect(self.analyzer(f).tokens(f), F.lit(list(terms)))).alias("w"))
            for w, df in tokens.groupBy("w").count().collect():  # at most the text's own words
                if df >= q.min_doc_frequency and (q.max_doc_frequency is None or df <= q.max_doc_frequency):
                    scored.append((terms[w] * bm25.idf(n, df), f, w))
        scored = sorted(scored, key=lambda s: (-s[0], s[1], s[2]))[: q.max_query_terms]
        return ir.Bool(should=tuple(ir.Boost(ir.Term(f, w), s * q.boost_factor / scored[0][0]) for s, f, w in scored)) if scored else ir.Empty()

    # ---- whole queries ----

    def run(self, query: ir.Query | dict | str, need_score: bool = True) -> DataFrame:
        """id, score of every matching row."""
        q = ir.simplify(self.parsed(query))
        if isinstance(q, ir.Empty):
            return self.docs.select(F.col(self.id), F.lit(0.0).alias("score")).limit(0)
        single = self.table(q) if not isinstance(q, (ir.Bool, ir.DisMax, ir.Boost, ir.Const, ir.All)) and self.leaf(q) is None else None
        if single is not None:
            return single.withColumnRenamed("id", self.id)
        docs, columns = self.docs, {}
        for k, node in enumerate(dict.fromkeys(n for n in q.walk() if not n.children() and not isinstance(n, (ir.All, ir.Empty)))):
            if (found := self.leaf(node)) is not None:
                columns[node] = found
            elif (rows := self.table(node)) is not None:
                docs = docs.join(rows.select(F.col("id").alias(self.id), F.col("score").alias(f"_leaf{k}")), self.id, "left")
                columns[node] = F.col(f"_leaf{k}").isNotNull(), F.coalesce(F.col(f"_leaf{k}"), F.lit(0.0))
            else:
                raise ValueError(f"no plan for {node}")
        weights = self._weights(docs, q, columns) if need_score else None
        match, value = self._combine(q, columns, weights)
        return docs.where(match).select(F.col(self.id), (value if need_score else F.lit(0.0)).cast("double").alias("score"))

    def parsed(self, query) -> ir.Query:
        return query if isinstance(query, ir.Query) else dsl.parse(query, self.docs.schema, [f.name for f in self.docs.schema.fields if isinstance(f.dataType, StringType) and self.is_text(f.name)])

    def _weights(self, docs: DataFrame, q: ir.Query, columns: dict) -> dict:
        """Documents, average lengths and each key's idf, from one aggregation."""
        fields = sorted({f for c in columns.values() if isinstance(c[1], list) for _, _, f in c[1] if f})
        keys = {}
        for node, (match, parts) in columns.items():
            if isinstance(parts, list):
                for key, tf, f in parts:
                    if f:
                        keys[key] = match if len(parts) == 1 else tf > 0
                if isinstance(node, ir.Phrase) and len(node.terms) > 1:  # a phrase weighs as its terms do together
                    for t in node.terms:
                        term = ir.Term(node.field, t)
                        keys[repr(term)] = self.leaf(term)[0]
        if not keys:
            return {}
        known = self.stats
        if known is not None and all(k in known.df for k in keys) and all(f in known.tokens for f in fields):
            n, tokens, df = known.docs, known.tokens, known.df
        else:
            names = list(keys)
            cold = [f for f in fields if f not in self._corpus]
            row = docs.agg(F.count("*").alias("n"), *(F.sum(self.length(f)).alias(f"t{k}") for k, f in enumerate(cold)), *(F.sum(F.coalesce(keys[x], F.lit(False)).cast("long")).alias(f"d{k}") for k, x in enumerate(names))).first()
            for k, f in enumerate(cold):
                self._corpus[f] = row["n"], int(row[f"t{k}"] or 0)
            n, tokens = row["n"], {f: self._corpus[f][1] for f in fields}
            df = {x: int(row[f"d{k}"] or 0) for k, x in enumerate(names)}
            if known is not None and all(f in known.tokens for f in fields):
                n, tokens = known.docs, known.tokens
        out = {k: bm25.idf(n, df[k]) for k in keys}
        for node in columns:
            if isinstance(node, ir.Phrase) and len(node.terms) > 1:
                out[repr(node)] = sum(out[repr(ir.Term(node.field, t))] for t in node.terms)
        return {"idf": out, "avg": {f: (tokens[f] / n if n else 1.0) or 1.0 for f in fields}, "n": n, "tokens": tokens, "df": df}

    def export_stats(self, query) -> bm25.Stats:
        """Counts that a search elsewhere needs to score this query as if over the union."""
        q = ir.simplify(self.parsed(query))
        columns = {n: c for n in q.walk() if not n.children() and not isinstance(n, (ir.All, ir.Empty)) and (c := self.leaf(n)) is not None}
        mine = Searcher(self.docs, self.id, self.analyzers, None, self.lengths, self.quantize)
        w = mine._weights(self.docs, q, columns)
        return bm25.Stats(w.get("n", 0), {f: w["tokens"][f] for f in w.get("avg", {})}, w.get("df", {}))

    def _combine(self, q: ir.Query, columns: dict, w: dict | None) -> tuple[Column, Column]:
        no = F.lit(0.0)
        if isinstance(q, ir.All):
            return F.lit(True), F.lit(1.0)
        if isinstance(q, ir.Empty):
            return F.lit(False), no
        if isinstance(q, ir.Boost):
            match, value = self._combine(q.query, columns, w)
            return match, value * float(q.factor)
        if isinstance(q, ir.Const):
            return self._combine(q.query, columns, None)[0], F.lit(float(q.value))
        if isinstance(q, ir.DisMax):
            parts = [self._combine(c, columns, w) for c in q.queries]
            match = parts[0][0]
            for m, _ in parts[1:]:
                match = match | m
            values = [F.when(m, v).otherwise(no) for m, v in parts]
            top = F.greatest(*values) if len(values) > 1 else values[0]
            return match, top + float(q.tie) * (sum(values[1:], values[0]) - top)
        if isinstance(q, ir.Bool):
            must, should, must_not = ([self._combine(c, columns, w) for c in cs] for cs in (q.must, q.should, q.must_not))
            match, value = F.lit(True), no
            for m, v in must:
                match, value = match & m, value + v
            if q.needed() == 1:
                some = should[0][0]
                for m, _ in should[1:]:
                    some = some | m
                match = match & some
            elif q.needed() > 1:
                match = match & (sum((F.coalesce(m, F.lit(False)).cast("int") for m, _ in should), F.lit(0)) >= q.needed())
            for m, v in should:
                value = value + F.when(m, v).otherwise(no)
            for m, _ in must_not:
                match = match & ~F.coalesce(m, F.lit(False))
            return match, value
        match, parts = columns[q]
        if not isinstance(parts, list):
            return match, parts
        value = no
        for key, tf, field in parts:
            if field is None:
                value = value + 1.0
            elif w:
                one = bm25.score(w["idf"][key], tf, self.length(field), w["avg"][field])
                value = value + (one if len(parts) == 1 else F.when(tf > 0, one).otherwise(no))
        return match, value

    # ---- results ----

    def search(self, query, limit: int = 10, offset: int = 0, allowed_ids: Iterable[int] | DataFrame | None = None, fields: bool | list[str] = False, highlights: bool = False) -> DataFrame:
        """The best rows: id, score, and on demand stored fields and highlights (byte ranges by field)."""
        found = self.run(query)
        if isinstance(allowed_ids, DataFrame):
            found = found.join(allowed_ids.toDF(self.id), self.id, "left_semi")
        elif allowed_ids is not None:
            found = found.where(F.col(self.id).isin(list(allowed_ids)))
        top = top_k(found, limit, offset, self.id)
        if fields or highlights:
            names = [c for c in self.docs.columns if c != self.id] if fields is True or not fields else list(fields)
            top = self.docs.select(self.id, *names).join(F.broadcast(top), self.id)  # at most limit rows
            if highlights:
                marks = approximate.highlight_patterns(self.parsed(query))
                shown = {f: p for f, p in marks.items() if f in names}
                top = top.withColumn("highlights", F.create_map(*(x for f, p in shown.items() for x in (F.lit(f), approximate.highlight_udf(p)(F.col(f))))) if shown else F.lit(None).cast("map<string,array<struct<from:int,to:int>>>"))
                top = top.select(self.id, "score", *(names if fields else []), "highlights")
            top = top.orderBy(F.desc("score"), self.id)
        return top

    def explain(self, query) -> DataFrame:
        """id, score and the parts of each leaf (term frequency, length, idf)."""
        q = ir.simplify(self.parsed(query))
        columns = {n: c for n in q.walk() if not n.children() and not isinstance(n, (ir.All, ir.Empty)) and (c := self.leaf(n)) is not None}
        w = self._weights(self.docs, q, columns)
        match, value = self._combine(q, columns, w)
        parts = [F.struct(F.lit(key).alias("leaf"), tf.cast("long").alias("tf"), self.length(f).cast("long").alias("dl"), F.lit(w["idf"][key]).alias("idf"), F.lit(w["avg"][f]).alias("avgdl")) for _, ps in columns.values() for key, tf, f in ps if f]
        return self.docs.where(match).select(self.id, value.alias("score"), (F.array(*parts) if parts else F.lit(None)).alias("details"))


def top_k(found: DataFrame, limit: int, offset: int = 0, id_col: str = "_node_id") -> DataFrame:
    """Highest scores first, ties by id; a bounded heap per partition, never a full sort."""
    return found.orderBy(F.desc("score"), F.col(id_col)).offset(offset).limit(limit) if offset else found.orderBy(F.desc("score"), F.col(id_col)).limit(limit)


