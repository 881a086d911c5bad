"""Language identification by error-correcting output codes.

Each learned language has a codeword; for every bit a binary classifier over hashed byte trigrams of the lower-cased
letters (log ratio of two smoothed multinomial models, scaled by logistic regression) gives a margin. Decoding adds up the
logistic loss of each margin against each codeword, weighted by how well the bit does on the training rows, and takes the
nearest codeword; the score is its share of exp(-loss), and a result whose runner-up is close is flagged ambiguous.

The models are fitted on a bounded sample of labelled rows, about ``SAMPLE_PER_LANGUAGE`` of each language, picked by a hash
of doc_id and text, equal ones once. Nulls: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; a null lang is never learned; a null
doc_id counts as the empty string for the split. Empty tables give an empty result, and with no labelled row all is
``und``. Repeated rows each get a row, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_sums, table, text_slices, utf8_buffer

SAMPLE_PER_LANGUAGE = 400
BUCKETS = 1 << 15
AMBIGUOUS = 0.6
_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts (other than letters is one space) and the n+1 places where texts begin."""
    data, offsets = utf8_buffer(pa.array([" " + t.lower() for t in texts], pa.large_string()))
    data = _KEEP[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[:-1]] = True  # the space before each text
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep].astype(np.uint32)
    ids = ((data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)
    inner = np.ones(len(ids), dtype=bool)
    for k in (1, 2):  # trigrams across the end of a text
        cut = at[1:-1] - k
        inner[cut[(cut >= 0) & (cut < len(ids))]] = False
    first = np.concatenate([[0], np.cumsum(inner)])[np.minimum(at, len(ids))]
    return ids[inner], first


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all splits up to 7 languages, beyond it the random code of largest least distance among 200."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1 << (n - 1)) if n > 2 else np.arange(2)
        bits = ((splits[None, :] >> np.arange(n - 1)[:, None]) & 1)[:, : (1 << (n - 1)) - 1]
        return np.where(np.vstack([np.ones((1, bits.shape[1])), bits]) > 0, 1.0, -1.0)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, code = -1, None
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], size=(n, length))
        c = c[:, np.abs(c.sum(axis=0)) < n]
        gap = (c.shape[1] - np.where(np.eye(n, dtype=bool), -np.inf, c @ c.T).max()) / 2
        if gap > best:
            best, code = gap, c
    return code


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x BUCKETS
    scale: np.ndarray  # bits x (slope, offset)
    trust: np.ndarray  # bits

    def margins(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.sqrt(np.maximum(np.diff(first), 1))
        raw = np.stack([row_sums(w[ids], first) / n for w in self.weights], axis=1)
        return raw * self.scale[:, 0] + self.scale[:, 1]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(axis=1) for c in self.code], axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], dtype=bool)
        if not self.languages or not lettered.any():
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        loss = self.losses(self.margins(*grams([t or "" for t in texts])))
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        score = np.where(lettered, share.max(axis=1), 0.0)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score, ~lettered | (score < AMBIGUOUS)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset that predict y (+1, -1) from x, by Newton steps with a small ridge."""
    features, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ ((y > 0) - p) - 1e-2 * w
        hess = (features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        w += np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def train(rows: list[tuple[str, str]], alpha: float = 0.5) -> LanguageModel:
    """Fit on (text, lang) rows."""
    rows = sorted((lang, text) for text, lang in rows if text and lang is not None)
    languages = sorted({lang for lang, _ in rows})
    code = codewords(len(languages))
    if not rows:
        return LanguageModel([], code, np.zeros((0, BUCKETS)), np.zeros((0, 2)), np.zeros(0))
    label = np.searchsorted(languages, [lang for lang, _ in rows])
    ids, first = grams([t for _, t in rows])
    who = np.repeat(label, np.diff(first))
    counts = np.bincount(who * BUCKETS + ids, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS).astype(float)
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1) / 1e5
    weights, scale, trust = [], [], []
    for bit in code.T:
        yes, no = counts[bit > 0].sum(axis=0) + alpha, counts[bit < 0].sum(axis=0) + alpha
        weights.append((np.log(yes / yes.sum()) - np.log(no / no.sum())).astype(np.float32))
        x = row_sums(weights[-1][ids], first) / np.sqrt(np.maximum(np.diff(first), 1))
        scale.append(_logistic(x, bit[label]))
        error = np.mean((x * scale[-1][0] + scale[-1][1]) * bit[label] <= 0)
        trust.append(0.5 * np.log((1 - error + 0.01) / (error + 0.01)))
    trust = np.maximum(np.array(trust), 0.0)
    return LanguageModel(languages, code, np.array(weights), np.array(scale), trust / max(trust.mean(), 1e-9))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 11) -> LanguageModel:
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    # A row is drawn by its id and text, and equal texts count once, so that equal rows can't swell the sample.
    pick = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND((1 << 31) - 1)
    limit = F.lit(-1)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 31, (per_language << 31) // n))).otherwise(limit)
    return train([(r.text, r.lang) for r in rows.where(pick < limit).select("text", "lang").distinct().collect()])


def identify(docs: DataFrame, model: LanguageModel, *carry: str) -> DataFrame:
    """The columns ``carry``, lang_pred, score and ambiguous of every document; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(*dict.fromkeys([*carry, "text"]))
    names = [n for n in given.columns if n in carry]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            lang, score, unsure = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])

    return given.mapInArrow(run, f"{out}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return identify(docs.withColumn("held_out", held_out()), fit(docs), "doc_id", "held_out")
