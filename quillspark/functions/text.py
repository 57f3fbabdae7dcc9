"""Tokenizers and token filters as column expressions, and the analyzers made of them.

Everything here stays inside the JVM: no Python runs on the executors except for compound words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"\p{IsAlphabetic}\p{N}"
RUN = rf"[{ALNUM}]+"
#: Marks the joint of two pieces inside a run.
JOINT = "\u0001"

Filter = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- tokenizers: text to an array of strings ----


def simple_tokens(c: Column | str) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(_col(c), F.lit(RUN), F.lit(0))


def whitespace_tokens(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), r"[ \t\n\r\f]+"), lambda t: t != "")


def raw_token(c: Column | str) -> Column:
    return F.array(_col(c))


def regex_tokens(pattern: str) -> Callable[[Column | str], Column]:
    """Non-empty matches of a pattern."""
    return lambda c: F.filter(F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0)), lambda t: t != "")


def facet_tokens(c: Column | str) -> Column:
    """A path and all its ancestors: /a/b gives /a and /a/b (and the root)."""
    parts = F.filter(F.split(_col(c), "/"), lambda t: t != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))


def empty_tokens(c: Column | str) -> Column:
    return F.array().cast("array<string>")


# ---- filters: array to array ----


def lower_case(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def remove_long(limit: int) -> Filter:
    """Drops tokens of limit bytes or more."""
    return lambda tokens: F.filter(tokens, lambda t: F.octet_length(t) < limit)


def alphanum_only(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike("^[A-Za-z0-9]*$"))


def stop_words(words: list[str]) -> Filter:
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


STOP_WORDS = {
    "en": "a be if of an in on no to or as is at it by and the are for was not but such with will then into this that they there these their".split(),
    "fr": "la ma sa ta ce de je le me ne se te il en on un et au du ou qu tu une que lui qui son par sur pas ces des les aux eux avec elle leur pour mais dans nous vous".split(),
    "de": "am im an in so er es du zu und die sie wie auf ich bei dem zum den bin ein von war der ihr wir zur für das des bis als uns aus hat mit ist sind eine sich doch noch auch aber oder einem einen einer nicht".split(),
    "es": "a o y la ya de le me se te mi si al el en un lo no yo es su tu una que del sin con por las mas los nos sus ella para esta este como pero sobre".split(),
}

_FOLD_MANY = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
_FOLD_FROM = "ÀÁÂÃÄÅĀĂĄàáâãäåāăąÇĆĈĊČçćĉċčĎĐďđÈÉÊËĒĔĖĘĚèéêëēĕėęěĜĞĠĢĝğġģĤĦĥħÌÍÎÏĨĪĬĮİìíîïĩīĭįıĴĵĶķĹĻĽĿŁĺļľŀłÑŃŅŇñńņňÒÓÔÕÖØŌŎŐòóôõöøōŏőŔŖŘŕŗřŚŜŞŠśŝşšŢŤŦţťŧÙÚÛÜŨŪŬŮŰŲùúûüũūŭůűųŴŵÝŶŸýÿŷŹŻŽźżžÐð"
_FOLD_TO = "AAAAAAAAAaaaaaaaaaCCCCCcccccDDddEEEEEEEEEeeeeeeeeeGGGGggggHHhhIIIIIIIIIiiiiiiiiiJjKkLLLLLlllllNNNNnnnnOOOOOOOOOoooooooooRRRrrrSSSSssssTTTtttUUUUUUUUUUuuuuuuuuuuWwYYYyyyZZZzzzDd"


def fold(c: Column) -> Column:
    """Latin letters with diacritics as ASCII."""
    for a, b in _FOLD_MANY.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, _FOLD_FROM, _FOLD_TO)


def ascii_folding(tokens: Column) -> Column:
    return F.transform(tokens, fold)


def _pieces(run: Column) -> Column:
    """A run cut at lower-Upper, UPPER-Upperlower and letter-digit joints, short chunks merged forward (at most two raw chunks a piece)."""
    raw = F.split(run, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    # a chunk under four characters takes the next one in; what is held after the last goes to the piece before, or stands alone
    step = lambda acc, x: F.when(acc["held"] != "", F.struct(F.array_append(acc["done"], F.concat(acc["held"], x)).alias("done"), F.lit("").alias("held"))).when(F.length(x) < 4, F.struct(acc["done"].alias("done"), x.alias("held"))).otherwise(F.struct(F.array_append(acc["done"], x).alias("done"), F.lit("").alias("held")))
    last = lambda acc: F.when(acc["held"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
    return F.aggregate(raw, start, step, last)


def camel_split(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, _pieces))


def compound_words(dictionary: list[str]) -> Filter:
    """Splits a token if words of the dictionary make it up entirely; else it stays."""
    words = sorted(set(dictionary), key=len, reverse=True)
    whole = "^(?:" + "|".join(map(re.escape, words)) + ")+$"
    each = "|".join(map(re.escape, words))
    return lambda tokens: F.flatten(F.transform(tokens, lambda t: F.when(t.rlike(whole), F.regexp_extract_all(t, F.lit(each), F.lit(0))).otherwise(F.array(t))))


class Analyzer:
    """A tokenizer and filters, for columns; and how its tokens look as text for matching."""

    def __init__(self, tokenizer: Callable[[Column | str], Column], *filters: Filter, camel: bool = False):
        self.tokenizer, self.filters, self.camel = tokenizer, filters, camel

    def tokens(self, c: Column | str) -> Column:
        out = self.tokenizer(c)
        for f in self.filters:
            out = f(out)
        return out


ANALYZERS: dict[str, Analyzer] = {
    "raw": Analyzer(raw_token),
    "default": Analyzer(simple_tokens, remove_long(40), lower_case),
    "simple": Analyzer(simple_tokens, lower_case),
    "whitespace": Analyzer(whitespace_tokens),
    "raw_code": Analyzer(simple_tokens, camel_split, lower_case, camel=True),
}


def register_analyzer(name: str, analyzer: Analyzer) -> None:
    ANALYZERS[name] = analyzer


def pre_tokenized(c: Column | str) -> Column:
    """The texts of an array of structs (text, from, to, pos) that the caller made."""
    return F.transform(_col(c), lambda t: t["text"])


def token_count(c: Column | str) -> Column:
    """Length of a text in runs; null counts as none."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(RUN)), F.lit(0))


def marked(c: Column | str, camel: bool) -> Column:
    """Lower-cased runs with one space between them and, if camel, JOINT between the pieces of each."""
    if not camel:
        return F.trim(F.regexp_replace(F.lower(_col(c)), rf"[^{ALNUM}]+", " "))
    return F.lower(F.array_join(F.transform(simple_tokens(c), lambda r: F.array_join(_pieces(r), JOINT)), " "))


def byte_offset(text: Column, char_offset: Column) -> Column:
    """Bytes before a 0-based character offset."""
    return F.octet_length(F.substring(text, F.lit(1), char_offset))


def wildcard_to_regex(pattern: str) -> str:
    return ".*".join(re.escape(p) for p in pattern.split("*"))


def query_tokens(text: str) -> tuple[list[str], list[str]]:
    """Lower-cased runs of a query and the separators between them."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    return [text[a:b].lower() for a, b in spans], [text[a[1] : b[0]].lower() for a, b in zip(spans, spans[1:])]


def json_path(path: str) -> str:
    """A dotted path (\\. is a dot inside a name) as a JSONPath."""
    parts = re.split(r"(?<!\\)\.", path)
    return "$" + "".join("['" + p.replace("\\.", ".") + "']" for p in parts)
