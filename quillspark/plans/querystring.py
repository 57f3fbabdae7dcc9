"""The query-string language: a recursive-descent parser to query nodes, strict or lenient."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from quillspark.functions.text import query_tokens
from quillspark.plans import ir

_SPECIAL = re.compile(r"\s|[()\[\]{}\"'^]")


class ParseError(ValueError):
    pass


class Parser:
    """One query over a schema. Words without a field go to the default fields."""

    def __init__(self, schema: StructType, defaults: list[str], conjunction: bool = False, allow_regexes: bool = True, lenient: bool = False, boosts: dict[str, float] | None = None, fuzzy: dict[str, tuple[int, bool, bool]] | None = None):
        self.schema, self.defaults, self.conjunction = schema, defaults, conjunction
        self.allow_regexes, self.lenient, self.boosts, self.fuzzy = allow_regexes, lenient, boosts or {}, fuzzy or {}
        self.errors: list[str] = []

    def parse(self, text: str) -> ir.Query:
        self.text, self.at = text, 0
        out = self.clauses(None, top=True)
        self.space()
        if self.at < len(text):
            self.fail(f"unexpected {text[self.at]!r} at {self.at}")
        return out

    # ---- characters ----

    def fail(self, why: str) -> None:
        if not self.lenient:
            raise ParseError(why)
        self.errors.append(why)

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def keyword(self, word: str) -> bool:
        m = re.compile(rf"\s*{word}(?=[\s(]|$)").match(self.text, self.at)
        if m:
            self.at = m.end()
        return bool(m)

    def word(self) -> str:
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out.append(self.text[self.at + 1])
                self.at += 2
                continue
            if _SPECIAL.match(c):
                break
            out.append(c)
            self.at += 1
        return "".join(out)

    # ---- grammar ----

    def clauses(self, field: str | None, top: bool = False) -> ir.Query:
        """OR of ANDs of signed clauses; AND binds tighter."""
        groups: list[list[tuple[str, ir.Query]]] = [[]]
        explicit = False
        while True:
            self.space()
            if self.at >= len(self.text) or self.peek(")"):
                break
            if groups[0] and self.keyword("OR"):
                explicit = True
                groups.append([])
                continue
            if groups[-1] and self.keyword("AND"):
                explicit = True
                clause = self.signed(field)
                if clause:
                    sign, q = groups[-1].pop()
                    groups[-1].append(("+" if sign == "" else sign, q))
                    groups[-1].append(("+" if clause[0] == "" else clause[0], clause[1]))
                continue
            before = self.at
            clause = self.signed(field)
            if clause:
                if not clause[0] and explicit and any(s == "+" for s, _ in groups[-1]):
                    groups.append([])
                groups[-1].append(clause)
            elif self.at == before:
                if top and not self.lenient:
                    break
                self.fail(f"unexpected {self.text[self.at]!r} at {self.at}")
                self.at += 1
        built = [self.combine(g) for g in groups if g]
        if not built:
            return ir.Empty()
        return built[0] if len(built) == 1 else ir.Bool(should=tuple(built))

    def combine(self, group: list[tuple[str, ir.Query]]) -> ir.Query:
        default = "+" if self.conjunction else ""
        must = tuple(q for s, q in group if (s or default) == "+")
        should = tuple(q for s, q in group if (s or default) == "")
        must_not = tuple(q for s, q in group if s == "-")
        if must_not and not must and not should:
            self.fail("only excluded clauses")
            must = (ir.All(),)
        if len(group) == 1 and not must_not:
            return group[0][1]
        return ir.Bool(must, should, must_not)

    def signed(self, field: str | None) -> tuple[str, ir.Query] | None:
        self.space()
        sign = "+" if self.take("+") else "-" if self.take("-") or self.keyword("NOT") else ""
        q = self.boosted(field)
        return (sign, q) if q is not None else None

    def boosted(self, field: str | None) -> ir.Query | None:
        q = self.leaf(field)
        if q is not None and self.take("^"):
            m = re.compile(r"\d+(?:\.\d+)?|\.\d+").match(self.text, self.at)
            if m:
                self.at = m.end()
                q = ir.Boost(q, float(m.group()))
            else:
                self.fail("a boost needs a number")
        return q

    def leaf(self, field: str | None) -> ir.Query | None:
        self.space()
        if self.take("("):
            q = self.clauses(field)
            self.space()
            if not self.take(")"):
                self.fail("a bracket isn't closed")
            return q
        m = re.compile(r"((?:[A-Za-z_](?:[\w.\-]|\\.)*))\s*:(?!:)").match(self.text, self.at)
        if m and field is None:
            self.at = m.end()
            name = m.group(1)
            if not self.known(name):
                self.fail(f"unknown field {name!r}")
                self.leaf("\0")
                return None
            self.space()
            return self.leaf(name)
        if self.keyword("IN") or field and re.compile(r"IN\s*\[").match(self.text, self.at) and self.take("IN"):
            return self.set_of(field)
        if self.peek("[") or self.peek("{"):
            return self.range_of(field)
        m = re.compile(r"(>=|<=|>|<)\s*").match(self.text, self.at)
        if m:
            self.at = m.end()
            value = self.value(field, self.word())
            sides = {">": ("lower", False), ">=": ("lower", True), "<": ("upper", False), "<=": ("upper", True)}
            side, closed = sides[m.group(1)]
            return self.each(field, lambda f: ir.Range(f, **{side: value, f"include_{side}": closed}))
        if self.peek('"') or self.peek("'"):
            return self.phrase(field)
        if self.peek("/") and field is not None:
            end = self.at + 1
            while end < len(self.text) and self.text[end] != "/":
                end += 2 if self.text[end] == "\\" else 1
            if end >= len(self.text):
                self.fail("a regex isn't closed")
            pattern = self.text[self.at + 1 : end].replace("\\/", "/")
            self.at = min(end + 1, len(self.text))
            if not self.allow_regexes:
                self.fail("regexes aren't allowed")
                return None
            return ir.RegexTerm(field, pattern)
        if self.peek("*") and (self.at + 1 == len(self.text) or self.text[self.at + 1] in " )\t\n"):
            self.at += 1
            return ir.Exists(field) if field else ir.All()
        word = self.word()
        if not word:
            return None
        return self.each(field, lambda f: self.literal(f, word))

    def known(self, name: str) -> bool:
        return name in self.schema.names or name.split(".")[0] in self.schema.names

    def each(self, field: str | None, make) -> ir.Query:
        names = [field] if field else self.defaults
        if field == "\0":
            return ir.Empty()
        if not names:
            self.fail("no default field")
            return ir.Empty()
        parts = []
        for f in names:
            q = make(f)
            parts.append(ir.Boost(q, self.boosts[f]) if f in self.boosts else q)
        return parts[0] if len(parts) == 1 else ir.Bool(should=tuple(parts))

    def type_of(self, field: str | None) -> DataType:
        if field is None or field not in self.schema.names:
            return StringType()
        kind = self.schema[field].dataType
        return kind.elementType if isinstance(kind, ArrayType) else kind

    def value(self, field: str | None, word: str):
        """A literal in the field's type; paths inside JSON are guessed: date, number, boolean, string."""
        kind = self.type_of(field)
        try:
            if field and field not in self.schema.names:
                for guess in (int, float):
                    try:
                        return guess(word)
                    except ValueError:
                        pass
                return {"true": True, "false": False}.get(word, word)
            if isinstance(kind, BooleanType):
                return {"true": True, "false": False}[word.lower()]
            if isinstance(kind, NumericType):
                return int(word) if kind.typeName() in ("long", "integer", "short", "byte") else float(word)
            if kind.typeName() in ("timestamp", "timestamp_ntz", "date"):
                datetime.fromisoformat(word.replace("Z", "+00:00"))
        except (ValueError, KeyError):
            self.fail(f"{word!r} doesn't suit field {field!r}")
            return None
        return word

    def literal(self, field: str, word: str) -> ir.Query:
        if not isinstance(self.type_of(field), StringType) or field not in self.schema.names:
            value = self.value(field, word)
            return ir.Empty() if value is None else ir.Term(field, value) if field in self.schema.names else ir.Range(field, value, value)
        words = query_tokens(word)[0]
        if not words:
            return ir.Empty()
        if field in self.fuzzy and len(words) == 1:
            distance, transpose, prefix = self.fuzzy[field]
            return ir.FuzzyTerm(field, words[0], distance, transpose, prefix)
        return ir.Term(field, words[0]) if len(words) == 1 else ir.Phrase(field, tuple(words))

    def phrase(self, field: str | None) -> ir.Query:
        quote = self.text[self.at]
        end, out = self.at + 1, []
        while end < len(self.text) and self.text[end] != quote:
            if self.text[end] == "\\" and end + 1 < len(self.text):
                end += 1
            out.append(self.text[end])
            end += 1
        if end >= len(self.text):
            self.fail("a quotation isn't closed")
        self.at = min(end + 1, len(self.text))
        slop, prefix = 0, False
        if m := re.compile(r"~(\d+)").match(self.text, self.at):
            slop, self.at = int(m.group(1)), m.end()
        elif self.take("*"):
            prefix = True
        words = tuple(query_tokens("".join(out))[0])

        def make(f: str) -> ir.Query:
            if not isinstance(self.type_of(f), StringType):
                return self.literal(f, "".join(out))
            if not words:
                return ir.Empty()
            if prefix:
                return ir.PhrasePrefix(f, words)
            return ir.Term(f, words[0]) if len(words) == 1 else ir.Phrase(f, words, slop)

        return self.each(field, make)

    def range_of(self, field: str | None) -> ir.Query:
        closed = self.take("[") or not self.take("{")
        m = re.compile(r"\s*(\*|[^\s\]}]+)\s+TO\s+(\*|[^\s\]}]+)\s*([\]}])").match(self.text, self.at)
        if not m:
            self.fail("a range needs [lower TO upper]")
            end = min((k for k in (self.text.find("]", self.at), self.text.find("}", self.at)) if k >= 0), default=len(self.text) - 1)
            self.at = end + 1
            return ir.Empty()
        self.at = m.end()
        strip = lambda s: s.strip("\"'")

        def make(f: str) -> ir.Query:
            low, high = (None if g == "*" else self.value(f, strip(g)) for g in m.groups()[:2])
            return ir.Range(f, low, high, closed, m.group(3) == "]")

        return self.each(field, make)

    def set_of(self, field: str | None) -> ir.Query:
        self.space()
        if not self.take("["):
            self.fail("IN needs a list")
            return ir.Empty()
        words = []
        while self.at < len(self.text) and not self.peek("]"):
            self.space()
            if self.peek('"'):
                end = self.text.find('"', self.at + 1)
                words.append(self.text[self.at + 1 : end])
                self.at = end + 1
            elif w := self.word():
                words.append(w)
            elif not self.peek("]"):
                self.at += 1
            self.space()
        if not self.take("]"):
            self.fail("a list isn't closed")
        return self.each(field, lambda f: ir.TermSet(f, tuple(self.value(f, w) for w in words)))


def parse(text: str, schema: StructType, defaults: list[str], **options) -> ir.Query:
    """Strict: raises ParseError."""
    return Parser(schema, defaults, **options).parse(text)


def parse_lenient(text: str, schema: StructType, defaults: list[str], **options) -> tuple[ir.Query, list[str]]:
    """As much of the query as makes sense, and what was wrong with the rest."""
    p = Parser(schema, defaults, lenient=True, **options)
    return p.parse(text), p.errors
