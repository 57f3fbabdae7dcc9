"""Personal data: exact base patterns, and a semi-Markov conditional random field for what they miss.

The base patterns (e-mail, IP, card, phone) are found in linear time and always stay. The field looks at
the stretches of text that could hold an entity of another form (long digit groups without the base's
marks, spelt-out addresses, and secrets: long runs of letters and digits mixed, as in access tokens). There, candidate segments of up to LONGEST tokens are scored as wholes:
digit-group shape, separators, checksum, alphabet, context word, borders. A dynamic program over segment ends
picks the best joint choice of borders and types; everywhere else the only label is "outside", which
scores zero, so leaving those stretches out of the program changes nothing. The weights are fitted by
conditional likelihood (forward sums over all segmentations) on sentences built in `labelled_sentences`.

Offsets are code points, ends exclusive. Cases: a null text is empty and has no spans; whole texts are
searched however long; equal texts give equal spans; added spans never overlap base ones.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, claim

KINDS = ("email", "ip", "card", "phone")
#: The field's own kinds: those of the base, and what the base has no pattern for.
FIELD_KINDS = (*KINDS, "secret")
LONGEST = 24
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9][0-9. -]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by kind as listed, then by start."""
    emails, ips, cards, phones = [], [], [], []
    at, done = text.find("@"), 0
    while at >= 0:  # the local part is the run before the sign, from the last match on
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            emails.append(("email", start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no later local part reaches over this sign
            at = text.find("@", at + 1)
    for region in _DIGITS.finditer(text):  # both patterns consist of these characters and start with a digit
        lo, hi = region.span()
        if hi - lo >= 7:
            if text.count(".", lo, hi) >= 3:
                ips += [("ip", m.start(), m.end()) for m in _IP.finditer(text, lo, hi) if all(len(p := q.lstrip("0")) <= 3 and int(p or "0") <= 255 for q in m.group().split("."))]
            if hi - lo >= 13:
                for m in _CARD.finditer(text, lo, hi):
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        cards.append(("card", m.start(), m.end()))
    if "+" in text:
        phones = [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return emails + ips + cards + phones


# ---- the field ----

_ZONE = re.compile(r"[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[({<] ?(?:at|AT) ?[\])}>]| (?:at|AT) ) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({<] ?(?:dot|DOT) ?[\])}>]| (?:dot|DOT) ) ?[A-Za-z0-9-]++)+")
#: Runs of letters and digits that could be a secret, and what shows that both are in it.
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+")
_MIXED = re.compile(r"(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])")
_TOKEN = re.compile(r"(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+|[A-Za-z]+|[0-9]+|.", re.S)
_NUMBER, _LETTER, _NAME = re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]"), re.compile(r"[a-z]+")
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?(?: .*)?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d")
_WORDS = {"tel": "tel", "phone": "tel", "call": "tel", "telefon": "tel", "mobile": "tel", "fax": "tel", "cell": "tel", "dial": "tel", "whatsapp": "tel", "ring": "tel", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "debit": "card", "ip": "ip", "server": "ip", "host": "ip", "addr": "ip", "mail": "mail", "email": "mail", "contact": "mail", "write": "mail", "date": "no", "order": "no", "invoice": "no", "isbn": "no", "id": "no", "ref": "no", "account": "no", "number": "no", "version": "no", "population": "no", "from": "no", "token": "key", "secret": "key", "key": "key", "apikey": "key", "password": "key", "passwd": "key", "pwd": "key", "bearer": "key", "auth": "key", "credential": "key", "sha": "sum", "md": "sum", "commit": "sum", "hash": "sum", "checksum": "sum", "etag": "sum", "digest": "sum", "revision": "sum", "blob": "sum", "uuid": "sum"}


def features(text: str, start: int, end: int) -> list[str] | None:
    """Features of the whole span; None where no entity can be."""
    span = text[start:end]
    if span[0].isspace() or span[-1].isspace() or not (span[0].isalnum() or span[0] in "(+"):
        return None
    if not span[-1].isalnum() or (start and text[start - 1].isalnum() and span[0].isalnum()) or (end < len(text) and text[end].isalnum()):
        return None
    found = _NUMBER.findall(span)
    digits, letters = "".join(found), bool(_LETTER.search(span))
    if letters and len(span) >= 20 and span.isalnum():
        return _secret_features(text, start, span)
    lower = span.lower()
    at = "@" if "@" in span else "[at]" if re.search(r"[\[({<] ?at ?[\])}>]", lower) else "at" if " at " in lower else ""
    if not at and (letters or len(digits) < 7):
        return None
    out = ["bias", f"at={at}"]
    if at:
        dot = "[dot]" if re.search(r"[\[({<] ?dot ?[\])}>]", lower) else "dot" if " dot " in lower else "." if (m := re.search(r"@|at", lower)) and "." in lower[m.end() :] else ""
        last = lower[len(lower.rstrip("abcdefghijklmnopqrstuvwxyz")) :]
        out += [f"dot={dot}", f"at={at},dot={dot}", f"end={last if last in ('com', 'org', 'net', 'edu', 'de', 'fr', 'es', 'uk', 'io', 'gov') else 'other'}"]
    else:
        groups = [len(g) for g in found]
        n = len(digits)
        out.append("n=" + ("7" if n == 7 else "8-9" if n < 10 else "10" if n == 10 else "11-12" if n < 13 else "13-15" if n < 16 else "16" if n == 16 else "17-19" if n < 20 else ">19"))
        out.append("shape=" + "-".join(map(str, groups)) if len(groups) < 6 else "shape=many")
        out.append("separators=" + "".join(sorted({c for c in set(span) if not c.isalnum()})))
        out.append(f"groups={min(len(groups), 6)}")
        if 13 <= n <= 19:
            out.append(f"luhn={luhn(digits)}")
        if len(groups) == 4 and span.count(".") == 3:
            out.append("four parts" if all(int(g) <= 255 for g in found) else "four, too large")
        if _DATE.fullmatch(span):
            out.append("date")
    if span[0] == "(":
        out.append("bracket")
    near = [_WORDS[w] for w in _NAME.findall(text[max(0, start - 24) : start].lower())[-2:] if w in _WORDS]
    out.append(f"near={near[-1] if near else ''}")
    if not at:
        out.append(f"near={near[-1] if near else ''},groups={min(len(groups), 4)}")
    return out


def _secret_features(text: str, start: int, run: str) -> list[str] | None:
    """Features of a run of letters and digits; None where only one of both is in it."""
    if not run.isascii() or not _MIXED.match(run):
        return None
    n = len(run)
    before = text[max(0, start - 24) : start].lower()
    near = [_WORDS[w] for w in re.findall(r"[a-z]+", before) if _WORDS.get(w) in ("key", "sum")]
    lead = before.rstrip("\"' ")[-1:]
    alphabet = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) else "one case" if run == run.lower() or run == run.upper() else "two cases"
    changes = len(re.findall(r"[A-Za-z]+|[0-9]+", run)) / n  # words with a number behind change once
    return [
        "bias", "run", f"run near={near[-1] if near else ''}", f"run alphabet={alphabet}", f"run lead={lead if lead in ('=', ':') else ''}",
        f"run n={'20-31' if n < 32 else '32' if n == 32 else '33-39' if n < 40 else '40' if n == 40 else '41-63' if n < 64 else '64' if n == 64 else '>64'}",
        f"run changes={min(3, int(changes * 10))}", f"run near={near[-1] if near else ''},lead={lead if lead in ('=', ':') else ''}",
    ]


def segments(text: str, start: int, end: int) -> tuple[list[int], dict[int, list[tuple[int, list[str]]]]]:
    """Token borders of a stretch, and by end border the candidate segments: (start border, features)."""
    borders, possible = _candidates(text, start, end)
    found: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
    for j in range(1, len(borders)):
        for i in possible(j):
            f = features(text, borders[i], borders[j])
            if f:
                found[j].append((i, f))
    return borders, found


def _candidates(text: str, start: int, end: int) -> tuple[list[int], Callable[[int], list[int]]]:
    """Token borders of a stretch, and which borders a segment that ends at one could start from.

    Left out are those only that `features` refuses anyhow: a segment without a sign for "at" has digits
    alone, seven at least, and starts with one or a bracket; a secret is one token."""
    borders, digits, words, firsts = [start], [0], [-1], []
    for m in _TOKEN.finditer(text, start, end):
        c = m.group()
        borders.append(m.end())
        digits.append(digits[-1] + (len(c) if c.isdecimal() else 0))
        words.append(len(borders) - 1 if c[0].isalpha() or not c.isascii() or not (c.isdecimal() or len(c) == 1) else words[-1])
        firsts.append(c[0].isdigit() or c[0] in "(+")
    spelt = bool(re.search(r"@|at", text[start:end], re.I))

    def possible(j: int) -> list[int]:
        low = max(0, j - LONGEST)
        if spelt:
            return list(range(low, j))
        out = [i for i in range(max(low, words[j]), j) if firsts[i] and digits[j] - digits[i] >= 7]
        return [*out, j - 1] if words[j] == j and borders[j] - borders[j - 1] >= 20 else out

    return borders, possible


def _score(weights: dict[tuple[str, str], float], kind: str, f: list[str]) -> float:
    return sum(weights.get((kind, x), 0.0) for x in f)


def decode(text: str, start: int, end: int, weights: dict[tuple[str, str], float]) -> list[Span]:
    """The best segmentation of a stretch: outside tokens score zero, segments their weights."""
    borders, possible = _candidates(text, start, end)
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)]
    known: dict[tuple[str, ...], tuple[float, str]] = {}  # the best kind of equal features
    for j in range(1, len(borders)):
        top = (best[j - 1][0], j - 1, None)
        for i in possible(j):  # features of one border's segments at a time
            f = features(text, borders[i], borders[j])
            if f:
                if (key := tuple(f)) not in known:
                    known[key] = max(((_score(weights, k, f), k) for k in FIELD_KINDS), key=lambda x: x[0])
                s, kind = known[key]
                if best[i][0] + s > top[0] + 1e-9:
                    top = (best[i][0] + s, i, kind)
        best.append(top)
    out, j = [], len(borders) - 1
    while j:
        _, i, kind = best[j]
        if kind:
            out.append((kind, borders[i], borders[j]))
        j = i
    return out[::-1]


def labelled_sentences(n: int = 420, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Sentences with entities in forms that the base patterns miss, and with numbers that are none."""
    r, out = random.Random(seed), []
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "in", "re", "ti", "on", "es")) for _ in range(r.randint(1, 3)))

    def card(sep: str) -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def secret() -> tuple[str, str]:
        alphabet = r.choice(("0123456789abcdef", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
        name = r.choice(("token", "token", "secret", "api_key", "password", "access_token", "auth_token", "secret_key", "apikey"))
        return f"{name}{r.choice((' = ', '=', ': ', ':'))}{r.choice(('', '', chr(34), chr(39)))}", "".join(r.choice(alphabet) for _ in range(r.choice((24, 32, 32, 40, 40, 40, 48, 64))))

    for _ in range(n):
        make = [
            lambda: ("phone", r.choice(("tel ", "phone: ", "call ", "mobile ", "")), f"({d(3)}) {d(3)}-{d(4)}"),
            lambda: ("phone", r.choice(("tel ", "phone ", "call ", "fax: ")), f"{d(3)}-{d(3)}-{d(4)}"),
            lambda: ("phone", r.choice(("tel ", "phone ", "call ")), f"{d(3)}.{d(3)}.{d(4)}"),
            lambda: ("phone", r.choice(("tel ", "phone ", "call ")), f"{d(3)} {d(3)} {d(4)}"),
            lambda: ("card", r.choice(("card ", "visa ", "credit card ")), card(r.choice((".", "/")))),
            lambda: ("email", r.choice(("mail ", "contact ", "")), f"{word()}{r.choice((' [at] ', '[at]', ' (at) ', '(at)', ' @ '))}{word()}{r.choice((' [dot] ', '[dot]', ' (dot) ', '.'))}{r.choice(('com', 'org', 'net', 'de', 'io'))}"),
            lambda: ("email", r.choice(("mail ", "contact ", "email ")), f"{word()} at {word()} dot {r.choice(('com', 'org', 'net'))}"),
            *[lambda: ("", r.choice(("order ", "id ", "", "", "", "account ", "ref ")), d(r.choice((7, 8, 9, 9, 10, 10, 11, 12, 13, 16, 16, 20))))] * 5,
            *[lambda: ("", r.choice(("", "date ", "from ")), r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"20{d(2)}-{d(2)}-{d(2)} 1{d(1)}.{d(2)}")))] * 2,
            lambda: ("", r.choice(("", "isbn ", "number ")), r.choice((f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"{d(4)} {d(4)}", f"{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(1)}.{d(7)}"))),
            *[lambda: ("secret", *secret())] * 4,
            *[lambda: ("", r.choice(("sha256 ", "commit ", "md5: ", "hash = ", "etag: ", "checksum ", "revision ", "", "")), "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))))] * 2,
            lambda: ("", r.choice(("", "id ", "file ")), "".join(word() for _ in range(12))[:24] + d(r.choice((1, 2, 4)))),
            lambda: ("", "", f"{word()} at {word()}. {word()}"),
            lambda: ("", "", f"{word()} @ {word()} {word()}"),
        ]
        kind, before, entity = r.choice(make)()
        text = f"{word()} {word()} {before}"
        spans = [(kind, len(text), len(text) + len(entity))] if kind else []
        out.append((f"{text}{entity}{r.choice((' ', ', ', '. '))}{word()} {word()}", spans))
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches that could hold an entity; those that overlap are one."""
    runs = [m.span() for m in _RUN.finditer(text) if _MIXED.match(m.group())]
    out = [m.span() for m in _ZONE.finditer(text)]
    if not runs:
        return out
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out + runs):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


@lru_cache(1)
def fitted(rounds: int = 12) -> dict[tuple[str, str], float]:
    """Weights of the largest conditional likelihood of the labelled sentences, by adaptive gradient steps with a ridge."""
    examples = []
    for text, spans in labelled_sentences():
        for zone in zones(text):
            borders, found = segments(text, *zone)
            inside = [s for s in spans if s[1] >= zone[0] and s[2] <= zone[1]]
            if found:
                examples.append((borders, found, {(borders.index(a), borders.index(b)): k for k, a, b in inside if a in borders and b in borders}))
    weights: dict[tuple[str, str], float] = defaultdict(float)
    for kind in FIELD_KINDS:
        weights[kind, "bias"] = -1.0
    moved: dict[tuple[str, str], float] = defaultdict(lambda: 1e-2)
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(examples)
        for borders, found, gold in examples:
            n = len(borders)
            scored = {j: [(i, f, {k: _score(weights, k, f) for k in FIELD_KINDS}) for i, f in found[j]] for j in found}
            ahead = [0.0] * n
            for j in range(1, n):
                ahead[j] = _log_sum([ahead[j - 1], *(ahead[i] + s for i, _, by in scored.get(j, ()) for s in by.values())])
            back, starts = [0.0] * n, defaultdict(list)
            for j, some in scored.items():
                for i, _, by in some:
                    starts[i] += [(j, s) for s in by.values()]
            for i in range(n - 2, -1, -1):
                back[i] = _log_sum([back[i + 1], *(s + back[j] for j, s in starts[i])])
            slope: dict[tuple[str, str], float] = defaultdict(float)
            for j, some in scored.items():
                for i, f, by in some:
                    for kind, s in by.items():
                        p = (gold.get((i, j)) == kind) - math.exp(ahead[i] + s + back[j] - ahead[-1])
                        if abs(p) > 1e-4:
                            for x in f:
                                slope[kind, x] += p
            for key, g in slope.items():
                g -= 0.002 * weights[key]
                moved[key] += g * g
                weights[key] += 0.5 * g / math.sqrt(moved[key])
    return dict(weights)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def added_spans(text: str, base: list[Span], weights: dict[tuple[str, str], float]) -> list[Span]:
    """What the field finds beside the base spans."""
    out: list[Span] = []
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):  # as stretches that don't overlap
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for start, end in zones(text):
        # of a stretch that base spans cut, what lies between them is tried piece by piece
        edges = [start]
        for k in range(bisect_right(ends, start), bisect_left(starts, end)):
            edges += [max(start, starts[k]), min(end, ends[k])]
        edges.append(end)
        pieces = [(edges[k], edges[k + 1]) for k in range(0, len(edges), 2)]
        for a, b in pieces:
            if b - a >= 7:
                out += decode(text, a, b, weights)
    return out


def find(text: str | None, weights: dict[tuple[str, str], float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, both by kind as listed and then start."""
    base = base_spans(text or "")
    more = added_spans(text or "", base, weights)
    return base, sorted(base + more, key=lambda s: (FIELD_KINDS.index(s[0]), s[1])) if more else base


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out.append(f"{text[done:a]}[{kind.upper()}]")
            done = b
        else:
            done = max(done, b)
    return "".join(out) + text[done:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans, and how many the field added."""
    spread = docs.sparkSession.sparkContext.broadcast(fitted())  # some hundred weights

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("pii", int)
        counts, digest, spans, added = [], [], [], []
        for text in batch.column(1).to_pylist():
            base, every = find(text, spread.value)
            counts.append([sum(s[0] == k for s in base) for k in KINDS])
            digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(every))
            added.append(len(every) - len(base))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digest), pa.array(spans), pa.array(added, pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
        )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by its kind; n_chars, if there, follows; other columns stay."""
    spread = docs.sparkSession.sparkContext.broadcast(fitted())
    names = docs.columns

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("pii", int)
        texts = [None if t is None else redacted(t, s) if (s := find(t, spread.value)[1]) else t for t in batch.column(names.index("text")).to_pylist()]
        columns = list(batch.columns)
        columns[names.index("text")] = pa.array(texts, pa.string())
        if "n_chars" in names:
            kind = columns[names.index("n_chars")].type
            columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], kind)
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(docs, rows, docs.schema)
