"""Operator 7: language identification with averaged hashed subword embeddings.

A text's byte n-grams are hashed; the average of their embeddings goes through a linear softmax.  Both are
trained by stochastic gradient descent in NumPy on a bounded sample of labelled rows, the same number for every language.

Rejection is calibrated on texts in no learned language: for every sampled text one of equal length is made up, with its letters
shuffled, replaced at random, taken from other scripts, or built of the random syllables of an invented language.  They
train one more class.  A text's evidence is the logit of its best language above that class, times the root of its
number of n-grams, so that a word or two is no ground for rejection.  Rejected is what lies clearly below the
least evidence of languages in the calibration part; ``false_accept`` is the share of made-up texts there that pass.

Prediction reads whole texts, needs no shuffle, and ships a model of fixed size.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, row_windows, tidy, utf8_column

BUCKETS = 8192
ORDERS = (2, 3, 4)  # bytes in an n-gram
SAMPLE_ROWS = 2000  # labelled rows the model is fitted on, at most, and as many made-up ones
LANGUAGES = 200  # languages learned at most, the most frequent ones
MADE_UP_LETTERS = 600  # length of a made-up text at most
DIMS, EPOCHS, BATCH, RATE = 8, 12, 32, 4.0
UNKNOWN = "und"
_WINDOW = 1 << 20

# ASCII letters in lower case, every other ASCII sign one blank, bytes of other signs as they are.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def features(data: np.ndarray) -> np.ndarray:
    """Share of each bucket among the hashed n-grams of one text's bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    longest = max(ORDERS)
    for at in range(0, len(data), _WINDOW):
        b = _FOLD[data[at : at + _WINDOW + longest - 1]].astype(np.uint32)
        own = min(_WINDOW, len(data) - at)
        h = np.zeros(len(b), np.uint32)
        for k in range(1, longest + 1):
            if k > len(b):
                break
            h = h[: len(b) - k + 1] * np.uint32(0x01000193) + b[k - 1 :] + np.uint32(k)
            if k in ORDERS:
                mixed = (h[:own] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
                counts += np.bincount(mixed, minlength=BUCKETS)
    total = counts.sum()
    return (counts / total if total else counts).astype(np.float32)


def gram_count(bytes_: int) -> int:
    return sum(max(0, bytes_ - k + 1) for k in ORDERS)


# First and last code point of letters: Latin with marks, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
SCRIPTS = [(0x100, 0x17F), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
_PLAIN = "abcdefghijklmnopqrstuvwxyz"


def made_up_text(text: str, seed: int) -> str:
    """A text of about the same length in no language; seed decides how it is made."""
    rng = random.Random(seed)
    text = text[:MADE_UP_LETTERS]
    kind = seed % 4
    if kind == 0:  # the same letters in another order
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        left = iter(letters)
        return "".join(next(left) if c.isalpha() else c for c in text)
    if kind == 1:  # random Latin letters
        return "".join(rng.choice(_PLAIN) if c.isalpha() else c for c in text)
    if kind == 2:  # another script, one third of its letters used, most of them rarely
        low, high = SCRIPTS[rng.randrange(len(SCRIPTS))]
        own = [chr(rng.randint(low, high)) for _ in range(max(20, (high - low) // 3 % 400))]
        return "".join(own[int(len(own) * rng.random() ** 2)] if c.isalpha() else c for c in text)
    some = rng.sample(_PLAIN, 18)  # words of an invented language's syllables
    vowels, others = rng.sample("aeiouy", 4), [c for c in some if c not in "aeiouy"]
    syllables = [rng.choice(others) + rng.choice(vowels) + (rng.choice(others) if rng.random() < 0.4 else "") for _ in range(40)]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(max(1, len(text) // 6)))


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # embedding times softmax weights: a row for each bucket; the last column is that of made-up texts
    bias: np.ndarray
    temperature: float = 1.0
    least: float = float("-inf")  # evidence below which a text is rejected
    false_accept: float = 1.0  # share of made-up calibration texts that pass
    false_reject: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x) / self.temperature
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def evidence(self, x: np.ndarray, grams) -> np.ndarray:
        z = self.logits(x)
        return (z[..., :-1].max(-1) - z[..., -1]) * np.sqrt(grams)


class Sample:
    """Sparse feature vectors of labelled rows, as views of two Arrow columns; only the rows of a batch are made dense."""

    def __init__(self, buckets, shares):
        self.ends, self.buckets = self._flat(buckets, np.uint16)
        _, self.shares = self._flat(shares, np.float32)

    @staticmethod
    def _flat(col, kind):
        col = col.combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)
        size = np.dtype(kind).itemsize
        return offsets // size, np.frombuffer(col.buffers()[2], np.uint8)[: offsets[-1]].view(kind)

    def dense(self, rows) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            own = slice(self.ends[row], self.ends[row + 1])
            x[i, self.buckets[own]] = self.shares[own]
        return x


def fit(sample: Sample, labels: list[str | None], grams: np.ndarray, seed: int = 5) -> LanguageModel:
    """SGD on four fifths of the sample; the rest sets temperature and rejection.  A null label is a made-up text."""
    languages = sorted({v for v in labels if v is not None})
    number = {v: i for i, v in enumerate(languages)} | {None: len(languages)}
    y = np.array([number[v] for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMS, len(languages) + 1)).astype(np.float32)
    bias = np.zeros(len(languages) + 1, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        turn = rng.permutation(used)
        for at in range(0, len(turn), BATCH):
            rows = turn[at : at + BATCH]
            xb = sample.dense(rows)
            hidden = xb @ emb
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad_hidden = p @ out.T
            out -= rate * hidden.T @ p
            bias -= rate * p.sum(0)
            # a bucket holds about 1 / BUCKETS of a text, so its row takes a longer step
            emb -= (rate * 64) * (xb.T @ grad_hidden)
    model = LanguageModel(languages, emb @ out, bias)
    check = held if len(held) else used
    z = np.concatenate([model.logits(sample.dense(check[k : k + 256])) for k in range(0, len(check), 256)])
    truth = y[check]

    def loss(t: float) -> float:
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return float(-np.log(np.maximum(p[np.arange(len(check)), truth] / p.sum(1), 1e-9)).mean())

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    evidence = (z[:, :-1].max(1) - z[:, -1]) * np.sqrt(grams[check])
    real, made = evidence[truth < len(languages)], evidence[truth == len(languages)]
    if len(real) and len(made):
        low = min(0.0, float(real.min()))
        model.least = low - max(0.0, low - float(np.median(made))) / 4
        model.false_accept, model.false_reject = float((made >= model.least).mean()), float((real < model.least).mean())
    return model


def held_out_fold(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _featurise(batches):
    """(text, lang, by, seed) -> lang, by, seed, made, grams, buckets, shares: a row for the text and one for a text made up like it."""
    for batch in batches:
        rows = []
        for text, lang, by, seed in zip(*(batch.column(c).to_pylist() for c in range(4))):
            for made, body in ((False, text), (True, made_up_text(text, seed & 0xFFFFFFFF))):
                raw = np.frombuffer(body.encode("utf-8", "replace"), np.uint8)
                x = features(raw)
                at = np.flatnonzero(x)
                if len(at):
                    rows.append((lang, by, seed, made, gram_count(len(raw)), at.astype(np.uint16).tobytes(), x[at].tobytes()))
        cols = list(zip(*rows)) or [[]] * len(_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FEATURES.types)], schema=_FEATURES)


_FEATURES = pa.schema([("lang", pa.string()), ("by", pa.int64()), ("seed", pa.int64()), ("made", pa.bool_()), ("grams", pa.int64()), ("buckets", pa.binary()), ("shares", pa.binary())])


def train_language_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fits on at most sample_rows labelled rows outside the held-out fold, shared equally among the languages, and as many made-up
    texts.  A language's rows are its first by hash of doc_id and text; equal rows are interchangeable, so the sample is the same in every run.
    The driver gets the counts of LANGUAGES languages at most, and a sparse vector of at most BUCKETS entries, 6 bytes each, for
    each sampled row.  No labelled row with a letter: None."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out_fold(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()  # at most LANGUAGES rows
    if not counts:
        return None
    quota = max(1, sample_rows // len(counts))
    # Few more than the quota are drawn by hash alone; the first of these are the sample.
    draw = F.lit(0)
    for r in counts:
        draw = F.when(F.col("lang") == r["lang"], min(1_000_000, math.ceil(1e6 * (1.3 * quota + 30) / r["count"]))).otherwise(draw)
    seeded = labelled.where(F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("doc_id").alias("by"), F.xxhash64("doc_id", "text").alias("seed"))
    drawn = seeded.where(F.pmod(F.xxhash64("by"), F.lit(1_000_000)) < draw)
    rows = drawn.mapInArrow(tidy(_featurise), "lang string, by long, seed long, made boolean, grams long, buckets binary, shares binary")
    first = Window.partitionBy("lang", "made").orderBy("by", "seed")
    rows = rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= quota)
    table = rows.select("lang", "made", "by", "seed", "grams", "buckets", "shares").toArrow()  # at most 2 * sample_rows rows
    if not len(table):
        return None
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("lang", "made", "by", "seed")]))
    labels = [None if made else lang for lang, made in zip(table["lang"].to_pylist(), table["made"].to_pylist())]
    sample, grams = Sample(table["buckets"], table["shares"]), table["grams"].to_numpy().astype(float)
    del table
    model = fit(sample, labels, grams)
    del sample
    give_back()  # the driver goes on to other stages
    return model


def _predict(model: LanguageModel | None):
    def run(batches):
        for batch in batches:
            offsets, data, _ = utf8_column(batch.column(1))
            langs, scores, rejected = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                part = data[a:b]
                if model is None or not len(part) or not has_letter(part.tobytes().decode("utf-8", "replace")):
                    langs.append(UNKNOWN), scores.append(0.0), rejected.append(True)
                    continue
                x = features(part).astype(np.float64)
                p = model.probabilities(x)[:-1]
                at = int(p.argmax())
                langs.append(model.languages[at]), scores.append(min(1.0, float(p[at])))
                rejected.append(bool(model.evidence(x, gram_count(len(part))) < model.least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify_language(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, rejected.

    Only text decides a prediction.  A null or empty text and one without a letter is ``und``, score 0, rejected; a text
    whose evidence for its best language is under the calibrated least keeps that language and is rejected.  score is
    the calibrated probability of the best language, beside the other languages and no language.
    A null doc_id isn't held out and isn't learned from.  Repeated rows keep a row each.  Without labelled
    rows everything is ``und``.  No rows: no rows.
    """
    model = train_language_model(docs, sample_rows)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_predict(model)), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that language identification rejects; same columns."""
    model = train_language_model(docs)
    names = docs.columns

    def run(batches):
        judge = _predict(model)
        for batch in batches:
            offsets, _, _ = utf8_column(batch.column("text"))
            for a, b in row_windows(offsets, _WINDOW):
                part = batch.slice(a, b - a)
                (seen,) = judge([part.select(["doc_id", "text"])])
                yield part.filter(pc.invert(seen.column(3)))

    return docs.mapInArrow(tidy(run), docs.schema).select(*names)
