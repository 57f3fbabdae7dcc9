"""Main text of HTML pages by the maximum-scoring contiguous subsequence.

A page becomes a sequence of words and tags. Words score positive, but for those that an enclosing
element marks as menus, adverts, notices and the like, and those outside of the article where the page
marks one (article, main); tags score negative. A linear scan finds the contiguous region of largest
total; the blocks that it touches, without what is boilerplate in them, are the text. The weights come
from labelled pages (`labelled_pages`, built here from page layouts with known articles): a structured
perceptron moves them until the best region of each page is the labelled one, within the signs above.
Nothing but the scan decides where the text starts and ends (it is then widened to whole blocks).

Cases: a null page is empty and gives an empty text; text without any tag is one block; tags that never
close, comments and scripts cut off at the end, and bad character references are taken as browsers take
them; a null page_id or url is passed through; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"head", "script", "style", "noscript", "template", "svg", "math", "object", "iframe", "canvas", "audio", "video", "title", "xmp", "noembed", "noframes"}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "input", "option", "label", "fieldset", "datalist", "search"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES_P = _BLOCK - {"caption", "body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend"}
_MARK = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|captcha|comments?|commentlist|consent|cookies?|discussion|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|paywall|popup|promos?|recommended|related|replies|respond|share|sharing|sidebar|signup|site-header|skip|social|sponsor|sponsored|subscribe|subscription|teaser|toolbar|topbar|widget)(?:$|[\s_-])", re.I)
#: In front of such a word, these say that the page has it or not, not that this is it.
_SAYS = {"no", "has", "with", "without", "hide", "show", "is", "have"}
_NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|comments?|commentlist|promo|recommended|related|repl(?:y|ies)|respond|sponsored|teaser)(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: What tokens are told apart by; each stands for itself on a page without a marked article, inside of one, and outside.
KINDS = ["word", "link", "aside", "p", "/p", "heading", "inline", "block", "/block", "main", "/main", "item", "asidetag"]
PLACES = ("", "inside ", "outside ")
_INDEX = {k: i for i, k in enumerate(KINDS)}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _marked(value: str) -> bool:
    for m in _MARK.finditer(value):
        before = re.split(r"[\s_-]+", value[: m.start()].strip(" _-"))[-1].lower()
        if before not in _SAYS or value[m.start() : m.start() + 1].isspace():
            return True
    return False


def _aside(tag: str, attributes: str, in_main: bool, marks: bool) -> bool:
    """Whether an element holds something other than the article."""
    if tag in _ASIDE or (tag == "header" and not in_main):
        return True
    if not attributes or not marks or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(n.lower() in ("class", "id") and _NOT_ARTICLE.search("".join(v)) for n, *v in _ATTRIBUTE.findall(attributes))
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and _marked(value) or name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I))


class _Open:
    """The open elements, with the places of each tag and of blocks, so that no search walks the stack."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []  # tag, aside or below one, hidden or below such
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, aside: bool, hidden: bool) -> None:
        self.at[tag].append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, aside, hidden))

    def cut(self, k: int) -> None:
        """Closes all elements from place k on."""
        while len(self.stack) > k:
            tag, *_ = self.stack.pop()
            self.at[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        if self.at[tag]:
            self.cut(self.at[tag][-1])

    def end(self, tags: set[str]) -> None:
        """Closes the last of these, if no other block was opened after it."""
        last = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        if last >= 0 and (not self.blocks or self.blocks[-1] <= last):
            self.cut(last)

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def count(self, *tags: str) -> int:
        return sum(len(self.at[t]) for t in tags)


def tokens(page: str, marks: bool = True) -> list[tuple[int, int, str | None, bool]]:
    """(kind, words, text, starts a block) in page order; tags have no text. marks: heed class names and the like."""
    out: list[tuple[int, int, str | None, bool]] = []
    open_ = _Open()
    aside = hidden = False
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            if page[m.start()] == "<" and (at - m.start() > 1):
                continue  # a comment or declaration
            if not hidden:
                text = entities.unescape(m.group())
                link = open_.at["a"] and not open_.count(*_HEADINGS)  # a title is one, linked or not
                out.append((_INDEX["aside" if aside else "link" if link else "word"], len(text.split()), text, False))
            continue
        tag, closing, attributes = tag.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        block = tag in _BLOCK
        kind = "main" if tag in ("article", "main") else "p" if tag == "p" else "heading" if tag in _HEADINGS else "item" if tag in ("li", "td", "th", "dd", "dt") else "block" if block else "inline"
        if closing:
            open_.close(tag)
            aside, hidden = open_.state()
            if kind in ("p", "main", "block"):
                kind = "/" + kind
            out.append((_INDEX["asidetag" if aside else kind], 0, None, block))
            continue
        if tag in _CLOSES_P or tag in ("li", "td", "th", "tr", "dd", "dt", "option"):  # what an unclosed element ends at
            ends = {"p"} if tag in _CLOSES_P else set()
            ends |= {"li"} if tag == "li" else {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {"td", "th", "tr"} if tag == "tr" else {"option"} if tag == "option" else set()
            open_.end(ends)
            aside, hidden = open_.state()
        if tag == "body" and len(open_.stack) > open_.count("html"):  # a head that was never closed
            html = open_.count("html")
            open_ = _Open()
            for _ in range(html):
                open_.push("html", False, False)
            aside = hidden = False
        below = aside or _aside(tag, attributes, open_.count("article", "main") > 0, marks), hidden or tag in _HIDDEN
        out.append((_INDEX["asidetag" if below[0] else kind], 0, None, block))
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in _VOID and not attributes.endswith("/"):
            open_.push(tag, *below)
            aside, hidden = below
        elif tag == "br" and not hidden:
            out.append((_INDEX["aside" if aside else "inline"], 0, " ", False))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of largest sum; empty if none is positive."""
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def labelled_pages(n: int = 240, seed: int = 5) -> list[str]:
    """Pages in several layouts; the words of their articles start with g, all others with b."""
    r, out = random.Random(seed), []
    for _ in range(n):
        count = iter(range(10**6))
        good = lambda a, b: " ".join(f"g{next(count)}" for _ in range(r.randint(a, b)))
        bad = lambda a, b: " ".join(f"b{next(count)}" for _ in range(r.randint(a, b)))
        maybe = lambda p, text: text if r.random() < p else ""
        advert = lambda: f'<div class="ad">{bad(3, 25)}</div>'
        menu = "<nav><ul>" + "".join(f'<li><a href="/">{bad(1, 2)}</a></li>' for _ in range(r.randint(3, 9))) + "</ul></nav>"
        links = "<div>" + "".join(f'<p><a href="/">{bad(1, 6)}</a></p>' for _ in range(r.randint(3, 20))) + "</div>"

        def blocks(least: int, most: int) -> str:
            made = ""
            for _ in range(r.randint(least, most)):
                inline = maybe(0.3, f" <b>{good(1, 4)}</b> ") + maybe(0.3, f' <a href="x">{good(1, 5)}</a>')
                made += f"<p>{good(1, 80)}{inline}{r.choice(('</p>', '</p>', '', '<br></p>'))}" + maybe(0.15, f"<h2>{good(1, 8)}</h2>") + maybe(0.1, advert())
            if r.random() < 0.2:
                made += "<table>" + "".join(f"<tr><td>{good(1, 2)}</td><td><b>{good(1, 1)}</b></td></tr>" for _ in range(r.randint(2, 5))) + "</table>"
            made += maybe(0.2, f"<div><p><b><i>{good(1, 1)}</i></b></p></div>")
            if r.random() < 0.3:
                made += "<ul>" + "".join(f"<li>{good(1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            return made

        mark = r.choice(("article", "article", "main", None, None))
        before, after = (f"<{mark}>", f"</{mark}>") if mark else r.choice((("<div>", "</div>"), ("", ""), ("<div><div>", "</div></div>")))
        whole = f"{before}{r.choice(('<h1>', '<header><h1>')) if mark else '<h1>'}{good(1, 10)}</h1>{blocks(1, 12)}{after}"
        if mark and r.random() < 0.2:  # a second part, or a link list and a short one that is none
            whole += advert() + f"<{mark}>{blocks(3, 8)}</{mark}>"
        notes = r.choice(("<section class=comments>", "<div id=comments>")) + "".join(f"<p>{bad(3, 25)}</p>" for _ in range(r.randint(1, 5))) + r.choice(("</section>", "</div>"))
        foot = f"<footer>{bad(2, 15)}</footer>"
        loose = f"<p>{bad(1, 8)}</p>" if mark else ""
        out.append(f"<html><body>{menu}{maybe(0.6, advert())}{maybe(0.3, loose)}{maybe(0.3, links)}{whole}{maybe(0.3, links)}{maybe(0.3, loose)}{maybe(0.4, notes)}{maybe(0.8, foot)}</body></html>")
    return out


Token = tuple[int, int, str | None, bool]


def kinds(seq: list[Token]) -> np.ndarray:
    """A number for each token: its kind, and whether it is inside or outside of a marked article that holds words."""
    kind = np.array([t[0] for t in seq], np.int64)
    depth = np.maximum(np.cumsum((kind == _INDEX["main"]).astype(np.int64) - (kind == _INDEX["/main"])), 0)
    if not any(d and t[0] <= _INDEX["link"] and t[1] for d, t in zip(depth.tolist(), seq)):
        return kind
    inside = (depth > 0) | (kind == _INDEX["/main"])
    return kind + len(KINDS) * np.where(inside, 1, 2)


def amounts(seq: list[Token]) -> np.ndarray:
    """What a token's weight is taken times: a text's words; one for tags, and for boilerplate, which is left out however long."""
    aside = _INDEX["aside"]
    return np.array([1 if t[2] is None else min(t[1], 1) if t[0] == aside else t[1] for t in seq], float)


def _bounds() -> tuple[np.ndarray, np.ndarray]:
    """The signs of the method: words positive (but for links, and outside of a marked article), tags negative."""
    n = len(KINDS)
    low, high = np.full(3 * n, -8.0), np.full(3 * n, -0.01)
    for place in (0, 1):
        low[_INDEX["word"] + place * n], high[_INDEX["word"] + place * n] = 0.1, 8.0
        high[_INDEX["link"] + place * n] = 8.0
    return low, high


def _labelled_region(seq: list[Token]) -> tuple[int, int]:
    """The least region that holds all words of the article; words of its own only, but for what is left out in any case."""
    inside = [i for i, t in enumerate(seq) if t[2] and t[2].lstrip()[:1] == "g"]
    return (inside[0], inside[-1] + 1) if inside else (0, 0)


@lru_cache(1)
def weights(rounds: int = 25) -> tuple[float, ...]:
    """Weights of every kind and place: mean of a structured perceptron's over the labelled pages."""
    low, high = _bounds()
    w = np.clip(np.where(high > 0, 1.0, -0.2), low, high)
    pages = []
    for page in labelled_pages():
        seq = tokens(page)
        pages.append((kinds(seq), amounts(seq), _labelled_region(seq)))
    total, times, order = np.zeros(len(w)), 0, random.Random(3)
    for k in range(rounds):
        order.shuffle(pages)
        for kind, amount, (a, b) in pages:
            score = w[kind] * amount
            c, d = best_region(score.tolist())
            if abs(score[c:d].sum() - score[a:b].sum()) > 1e-9:
                step = np.bincount(kind[a:b], amount[a:b], len(w)) - np.bincount(kind[c:d], amount[c:d], len(w))
                w = np.clip(w + 0.5 / (1 + k) * step / max(1.0, np.abs(step).max()), low, high)
            if k >= rounds // 2:
                total += w
                times += 1
    return tuple(float(x) for x in total / times)


def extract(page: str | None) -> str:
    """The article's blocks, joined by line feeds. Where class names would rule out the whole page, only tags count."""
    return _extract(tokens(page or "")) or _extract(tokens(page or "", False))


def _extract(seq: list[Token]) -> str:
    if not seq:
        return ""
    kind = kinds(seq)
    start, end = best_region((np.array(weights())[kind] * amounts(seq)).tolist())
    if start == end:
        return ""
    while start > 0 and not seq[start][3] and not seq[start - 1][3]:  # the blocks that the region touches, whole
        start -= 1
    while end < len(seq) and not seq[end][3]:
        end += 1
    outside = kind >= 2 * len(KINDS)
    blocks, now = [], []
    for (what, _, text, new), out in zip(seq[start:end], outside[start:end].tolist()):
        if new and now:
            blocks.append("".join(now))
            now = []
        if text and what != _INDEX["aside"] and not out:
            now.append(text)
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each page; nothing is shuffled."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), rows, "page_id long, url string, text string, n_chars long")
