"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier (log ratios of the mean n-gram
frequencies of the languages with and without that bit, hashed n-grams of lower-cased UTF-8) says how
far a text leans to one side. Decoding adds up, bit by bit, a logistic loss weighted by how reliable
that bit was for that language on a bounded sample of the labelled rows (whole texts, drawn by a hash of the
id from each language), and takes the nearest codeword.
Where the runner-up is nearly as near, the prediction is flagged as ambiguous.

The n-gram counts come from all labelled rows: each task adds up its own, then one sum by n-gram.

Cases: a null text, or one without any letter, is `und` with score 0; rows with a null lang aren't
learnt from; a null doc_id has bucket crc32("") % 3 = 0; without any labelled row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, bucket, claim

TABLE, SMOOTH = 1 << 16, 0.5
#: Labelled rows of each language that measure how reliable each bit is for it: so many are expected, where there are more.
SAMPLE_ROWS = 2000
#: A text's n-grams aren't independent: its evidence counts as that of so many at most.
EVIDENCE = 12.0
#: Ambiguous: the best codeword's share of the decoded weight is below this.
SURE = 0.5
_letter = regex.compile(r"\p{L}").search


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams and bigrams of the lower-cased text, with a space before and behind."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << 8
    three = two[:-1] | b[2:] << 16
    return np.concatenate([(two * np.uint32(2654435761)) >> 16, (three * np.uint32(2246822519) + np.uint32(374761393)) * np.uint32(3266489917) >> 16]).astype(np.uint16)


def codebook(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits for few of them, else far-apart random ones."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 5:
        bits = [[1 if (k >> (languages - 1 - i)) & 1 else -1 for i in range(languages)] for k in range(1 << (languages - 1), (1 << languages) - 1)]
        return np.array(bits, float).T
    random, width, best = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(languages)))), None
    for _ in range(200):
        book = np.where(random.random((languages, width)) < 0.5, -1.0, 1.0)
        apart = ((width - book @ book.T) / 2 + np.eye(languages) * width).min()
        if abs(book.sum(axis=0)).max() < languages and (best is None or apart > best[0]):
            best = apart, book
    return best[1]


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with text and lang; a row per language and n-gram from each task, then their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ecoc", int)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and lang is not None and _letter(text):
                    if lang not in counts:
                        counts[lang] = np.zeros(TABLE, np.int64)
                    g = grams(text)
                    if len(g) < TABLE // 8:
                        np.add.at(counts[lang], g, 1)
                    else:
                        counts[lang] += np.bincount(g, minlength=TABLE)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages, codewords, n-gram weights of each bit, and each bit's reliability for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.book = languages, codebook(len(languages))
        share = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * TABLE) if len(languages) else np.zeros((0, TABLE))
        self.weights = np.zeros((TABLE, self.book.shape[1] if len(languages) else 1), np.float32)
        for k in range(self.book.shape[1] if len(languages) > 1 else 0):
            yes, no = share[self.book[:, k] > 0], share[self.book[:, k] < 0]
            self.weights[:, k] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
        self.reliable = np.ones_like(self.book)

    def lean(self, text: str) -> np.ndarray:
        """Each bit's mean log ratio, times the evidence."""
        g, total = grams(text), np.zeros(self.weights.shape[1])
        for k in range(0, len(g), 1 << 16):
            total += self.weights[g[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total * min(len(g), EVIDENCE) / len(g)

    def judged(self, text: str, lang: str) -> np.ndarray:
        """Which bits put a text on its language's side."""
        return self.lean(text) * self.book[self.languages.index(lang)] > 0

    def learn_reliability(self, right: dict[str, np.ndarray], seen: dict[str, int]) -> None:
        """Share of each language's sampled texts that each bit puts on the right side; rows of it sum to one."""
        share = np.stack([(right.get(x, 0) + np.ones(self.book.shape[1])) / (seen.get(x, 0) + 2.0) for x in self.languages])
        self.reliable = share / share.sum(axis=1, keepdims=True) * share.shape[1]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (the nearest codeword's share of the weight), and whether it is ambiguous."""
        if not text or not self.languages or not _letter(text):
            return "und", 0.0, True
        loss = (self.reliable * np.logaddexp(0, -self.book * self.lean(text))).sum(axis=1)
        share = np.exp(loss.min() - loss)
        best, score = int(loss.argmin()), float(1 / share.sum())
        return self.languages[best], score, score < SURE


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from all labelled rows (text, lang, and doc_id to draw by); reliabilities from about sample_rows of each language."""
    table = count_grams(labelled).toArrow()  # at most languages * TABLE rows, as columns
    coded = table.column("lang").combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    languages = sorted(found)
    counts = np.zeros((len(languages), TABLE))
    at = np.array([languages.index(x) for x in found], np.int64)[coded.indices.to_numpy()]
    counts[at, table.column("gram").to_numpy()] = table.column("n").to_numpy()
    model = Model(languages, counts)
    if len(languages) > 1:
        model.learn_reliability(*_reliability(labelled, model, sample_rows))
    return model


def _reliability(labelled: DataFrame, model: Model, sample_rows: int) -> tuple[dict[str, np.ndarray], dict[str, int]]:
    """For each language, over a sample of its rows: how often each bit is right, and the rows; counted where the rows are."""
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    draw, parts = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32)), {x: min(1 << 32, (sample_rows << 32) // n) for x, n in sizes.items()}
    least = F.element_at(F.create_map(*(F.lit(v) for x in parts.items() for v in x)), F.col("lang"))
    spread = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ecoc", int)
        right: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and lang in spread.value.languages and _letter(text):
                    right[lang] = right.get(lang, 0) + spread.value.judged(text, lang).astype(np.int64)
                    seen[lang] = seen.get(lang, 0) + 1
        for lang, n in right.items():
            k = len(n) + 1
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.arange(-1, k - 1, dtype=np.int32)), pa.array(np.concatenate([[seen[lang]], n]))], ["lang", "bit", "n"])

    sums = labelled.where(draw < least).select("text", "lang").mapInArrow(run, "lang string, bit int, n long").groupBy("lang", "bit").agg(F.sum("n").alias("n")).collect()  # languages * bits
    right, seen = {x: np.zeros(model.book.shape[1]) for x in sizes}, {}
    for lang, bit, n in sums:
        if bit < 0:
            seen[lang] = n
        else:
            right[lang][bit] = n
    return right, seen


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learnt from: crc32(doc_id as text) mod 3 is not 1, text and lang are there."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    return docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for each row; the model is a few MB at most."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("ecoc", int)
        found = [spread.value.predict(t) for t in batch.column(1).to_pylist()]
        held = [bucket(i, 3) == 1 for i in batch.column(0).to_pylist()]
        lang, score, unsure = zip(*found)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is recognised: neither `und` nor ambiguous. All columns stay as they are."""
    spread = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim("ecoc", int)
        return batch.filter(pa.array([not spread.value.predict(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return arrow_map(docs, rows, docs.schema)
