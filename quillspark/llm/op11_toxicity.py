"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel of two strings counts the subsequences of three letters that both hold, each at ``DECAY`` to the power of the stretch it
spans (at most ``REACH`` letters), and is divided by the norms of both. So letters put into an insult, or endings that no training
text has, lower the kernel only a little. The strings are the words of a sentence between two marks of the edge: lower case, letters
and digits only, so that signs within a word don't hide it; parts of a word between such signs count too, single letters in a row
are read as one word, and long ones are cut in overlapping windows.

Training works on sentences. A sentence of a clean document is clean; of a toxic document at least one is toxic, so the machine takes
the one it finds worst (at first the one with the word most typical of toxic documents) and is fitted again, ``ROUNDS`` times; the
words found are also shown to it with a letter put in at each place. A sentence is as toxic as its worst word, a document as its worst sentence. Landmarks are words typical of toxic
documents, the commonest of clean ones, and those of clean ones that are most like the first, each unlike those before it. The kernel map to the landmarks is whitened, the machine has a squared
hinge; a logistic curve through a third of the sample, its toxic words
plain and disguised, gives the score, moved to the labels' own shares.

As the decision is linear in the three-letter subsequences of the landmarks, executors get one table of weights of fixed size, and
score each distinct word once a worker, in whole texts.

Bounds of the sample: ``SAMPLE_PER_LABEL`` rows a label, texts of at most ``SAMPLE_BYTES``, drawn by hash of doc_id and text.

Rows: a label row with a null doc_id or a label other than 0 and 1 is ignored; of conflicting labels of a doc_id the higher holds.
Null and empty texts, and those without a letter or digit, have the decision -1. Without labels of both kinds the score is the
share of label 1 (0 without labels). A null doc_id keeps its row and isn't held out; rows that repeat a doc_id are documents of
their own. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, spaced_words, table, text_slices, utf8_buffer

SAMPLE_PER_LABEL, SAMPLE_BYTES = 1000, 8192
#: Letters of a subsequence span at most so many; what each letter of the span costs; letters of a window over a long word.
REACH, DECAY, WINDOW = 8, 0.6, 24
LANDMARKS, ROUNDS = 192, 4
#: Decision for a text without words.
NOTHING = -1.0
#: Letters of the landmarks that have a class of their own; all others share the classes above.
_LETTERS, _BITS = 64, 7
#: Words remembered in a worker.
CACHE_WORDS = 1 << 19
_CHUNK = 1 << 17
#: Rows of a matrix that are worked on at once.
_ROWS = 1 << 14
_POWER = DECAY ** np.arange(3, REACH + 1)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"[.!?\n]+", text) if s.strip()]


def normal_words(words: list[str]) -> list[list[str]]:
    """The strings that stand for each word: its letters and digits together, and its parts of three letters or more."""
    parts = [w.split() for w in re.sub(r"[^\w\n]|_", " ", "\n".join(w.replace("\n", " ") for w in words).lower()).split("\n")] if words else []
    out = []
    for p in parts:
        strings = ["".join(p)] + [x for x in p if len(x) >= 3] * (len(p) > 1) if p else []
        out.append([w for s in strings for w in ([s] if len(s) <= WINDOW else [s[i : i + WINDOW] for i in range(0, len(s) - WINDOW // 2, WINDOW // 2)])])
    return out


def words_of(text: str) -> list[str]:
    """All strings of a sentence, rows of single letters read as one among them."""
    words = normal_words(re.findall(r"[^\x20\x09-\x0D]+", text))
    out, row = [s for w in words for s in w], ""
    for w in [*words, [""]]:
        if w and len(w[0]) == 1:
            row += w[0]
        elif w:
            if len(row) >= 3:
                out += [row[i : i + WINDOW] for i in range(0, max(1, len(row) - WINDOW // 2), WINDOW // 2)]
            row = ""
    return out


class Alphabet:
    """Class of each letter: the commonest letters of the landmarks have their own."""

    def __init__(self, landmarks: list[str]):
        count = Counter("".join(landmarks))
        own = ["\1", "\2", *sorted(count, key=lambda c: (-count[c], c))][:_LETTERS]
        self.own = np.sort(np.array([ord(c) for c in own], dtype=np.uint32))

    def classes(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, codes), len(self.own) - 1)
        return np.where(self.own[at] == codes, at, _LETTERS + codes % ((1 << _BITS) - _LETTERS)).astype(np.int64)

    def features(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, subsequence and weight of all distinct subsequences, by string; weights are divided by the norm of the string."""
        codes = self.classes(np.frombuffer("".join(f"\1{s}\2" for s in strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
        of = np.repeat(np.arange(len(strings)), [len(s) + 2 for s in strings])
        keys = []
        for last in range(2, REACH):
            n = len(codes) - last
            if n <= 0:
                break
            at = np.flatnonzero(of[last:] == of[:n])
            ends = (of[at] << 24) | (codes[at] << 2 * _BITS + 3) | (codes[at + last] << 3) | (last - 2)
            keys += [ends | (codes[at + middle] << _BITS + 3) for middle in range(1, last)]
        keys = np.sort(np.concatenate(keys)) if keys else np.empty(0, dtype=np.int64)
        if not len(keys):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        first = np.flatnonzero(np.diff(keys >> 3, prepend=-1))
        weight = np.add.reduceat(_POWER[keys & 7], first)
        string, sub = keys[first] >> 24, (keys[first] >> 3) & ((1 << 3 * _BITS) - 1)
        norm = np.sqrt(np.bincount(string, weights=weight**2, minlength=len(strings)))
        return string, sub, weight / norm[string]

    def kernel(self, strings: list[str], landmarks: list[str]) -> np.ndarray:
        """Kernel of each string and each landmark."""
        mark, sub, weight = self.features(landmarks)
        columns, place = np.unique(sub, return_inverse=True)
        dense = np.zeros((len(columns), len(landmarks)), dtype=np.float32)
        dense[place, mark] = weight
        out = np.zeros((len(strings), len(landmarks)), dtype=np.float32)
        for lo in range(0, len(strings), 4096):
            string, sub, weight = self.features(strings[lo : lo + 4096])
            at = np.minimum(np.searchsorted(columns, sub), max(0, len(columns) - 1))
            there = np.flatnonzero(columns[at] == sub)
            string, at, weight = string[there], at[there], weight[there].astype(np.float32)
            for k in range(0, len(there), _ROWS):
                part = string[k : k + _ROWS]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                out[lo + part[first]] += np.add.reduceat(dense[at[k : k + _ROWS]] * weight[k : k + _ROWS, None], first, axis=0)
        return out


@dataclass
class ToxicityModel:
    alphabet: Alphabet
    weights: np.ndarray  # of each subsequence
    offset: float
    slope: float
    shift: float

    def decisions(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.offset)
        for lo in range(0, len(strings), 8192):
            string, sub, weight = self.alphabet.features(strings[lo : lo + 8192])
            out[lo : lo + 8192] += np.bincount(string, weights=weight * self.weights[sub], minlength=len(strings[lo : lo + 8192]))
        return out

    def scores(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.shift, -500, 500)))


def hinge_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine with squared hinge, by Newton steps over the rows within the margin. The last column of ``x`` is 1."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = ridge * 1e-3

    def margins(w: np.ndarray) -> np.ndarray:
        return y * np.concatenate([x[k : k + _ROWS] @ w for k in range(0, len(x), _ROWS)])

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - margins(w)) ** 2).sum() + w @ keep @ w)

    now = loss(w)
    for _ in range(steps):
        inside, left, right = np.flatnonzero(margins(w) < 1), keep.copy(), np.zeros(len(w))
        for k in range(0, len(inside), _ROWS):
            xi = x[inside[k : k + _ROWS]].astype(np.float64)
            weighed = xi * weight[inside[k : k + _ROWS], None]
            left += weighed.T @ xi
            right += weighed.T @ y[inside[k : k + _ROWS]]
        goal = np.linalg.solve(left, right)
        size, then = 1.0, loss(goal)
        while then > now and size > 1e-3:
            size /= 2
            then = loss(w + size * (goal - w))
        if now - then <= 1e-9 * max(now, 1e-12):
            break
        w, now = w + size * (goal - w), then
    return w


def disguised(word: str) -> list[str]:
    """``word`` with a letter put in or said twice, at each place inside it, for words of four letters or more."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in ("x", "e", word[i])] if len(word) >= 4 else []


def _landmarks(n1: Counter, n0: Counter, docs1: int, docs0: int) -> list[str]:
    """A third typical of toxic documents, a sixth the commonest of clean ones, half the words of clean ones most like the first third.

    Each has a kernel below 0.9 to those of its kind before it.
    """

    def typical(w: str) -> float:
        a, b = n1[w] / docs1, n0[w] / docs0
        return (a - b) / np.sqrt((a + b) * (1 / docs1 + 1 / docs0))

    chosen: list[str] = []

    def choose(ranked: list[str], most: int) -> None:
        like = Alphabet(ranked).kernel(ranked, ranked) if ranked else np.zeros((0, 0))
        free = np.ones(len(ranked), dtype=bool)
        for i, w in enumerate(ranked):
            if len(chosen) < most and free[i] and w not in chosen:
                chosen.append(w)
                free &= like[i] < 0.9

    choose([w for w in sorted((w for w in n1 if n1[w] >= 2), key=lambda w: (-typical(w), w))[: 4 * LANDMARKS] if typical(w) > 1], LANDMARKS // 3)
    toxic, clean = list(chosen), sorted(n0)
    choose(sorted(n0, key=lambda w: (-n0[w], w))[: 2 * LANDMARKS], LANDMARKS // 2)
    alphabet = Alphabet(toxic)
    near = np.concatenate([np.empty(0), *(alphabet.kernel(clean[k : k + _ROWS], toxic).max(axis=1, initial=0.0) for k in range(0, len(clean), _ROWS))])
    choose([clean[i] for i in np.argsort(-near, kind="stable")[: 4 * LANDMARKS]], LANDMARKS)
    return chosen


def train(rows: list[tuple[str, int]], share: float) -> ToxicityModel | None:
    """Fit on (text, label) rows; ``share`` is that of label 1 among all labels. None without rows of both labels."""
    rows = sorted(set(rows))
    bags = [([words_of(s) for s in sentences(t)], y) for t, y in rows]
    bags = [([s for s in b if s], y) for b, y in bags]
    bags = [(b, y) for b, y in bags if b]
    fit = [b for k, b in enumerate(bags) if k % 3] or bags
    if len({y for _, y in fit}) < 2:
        return None
    n1, n0 = Counter(), Counter()
    for b, y in fit:
        (n1 if y else n0).update({w for s in b for w in s})
    docs1, docs0 = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    marks = _landmarks(n1, n0, docs1, docs0)
    alphabet = Alphabet(marks)
    words = sorted({w for b, _ in bags for s in b for w in s})
    index = {w: i for i, w in enumerate(words)}
    values, vectors = np.linalg.eigh(alphabet.kernel(marks, marks))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))

    def mapped(strings: list[str]) -> np.ndarray:
        """The whitened kernel map, and a 1."""
        out = np.ones((len(strings), len(marks) + 1), dtype=np.float32)
        for k in range(0, len(strings), _ROWS):
            out[k : k + _ROWS, :-1] = alphabet.kernel(strings[k : k + _ROWS], marks) @ whiten
        return out

    x = mapped(words)
    clean = np.array(sorted({index[w] for b, y in fit if not y for s in b for w in s}))
    toxic = [[np.array([index[w] for w in s]) for s in b] for b, y in fit if y]
    first = np.array([(n1[w] + 0.5) / (n0[w] * docs1 / docs0 + 0.5) if n1[w] >= 2 else 0.0 for w in words])
    rank = first
    for step in range(ROUNDS):
        # The worst word of the worst sentence of each toxic document, and that word disguised.
        witness = np.array([max((s[rank[s].argmax()] for s in b), key=lambda i: rank[i]) for b in toxic])
        seen, times = np.unique(witness, return_counts=True)
        at = np.concatenate([seen, clean])
        y = np.concatenate([np.ones(len(seen)), -np.ones(len(clean))])
        weight = np.concatenate([np.sqrt(times) / np.sqrt(times).sum(), np.full(len(clean), 1 / len(clean))])
        near = [v for i in seen[rank[seen] > 0] for v in disguised(words[i])] if step else []
        if near:
            w = hinge_machine(np.concatenate([x[at], mapped(near)]), np.concatenate([y, np.ones(len(near))]), np.concatenate([weight, np.full(len(near), 1 / len(near))]))
        else:
            w = hinge_machine(x[at], y, weight)
        rank = x @ w
    beta, w_offset = whiten @ w[:-1], float(w[-1])
    table_ = np.zeros(1 << 3 * _BITS, dtype=np.float32)
    mark, sub, weight = alphabet.features(marks)
    np.add.at(table_, sub, (weight * beta[mark]).astype(np.float32))
    test = [b for k, b in enumerate(bags) if not k % 3]
    test = test if len({y for _, y in test}) == 2 else bags
    worst = [max({w for s in b for w in s}, key=lambda w: (rank[index[w]], w)) for b, _ in test]
    top, y = rank[[index[w] for w in worst]], np.array([v for _, v in test], dtype=float)
    hidden = [v for w in sorted({w for w, v in zip(worst, y, strict=True) if v}) for v in disguised(w)]
    seen = alphabet.kernel(hidden, marks) @ beta + w_offset
    curve = np.concatenate([top, seen]), np.concatenate([y, np.ones(len(hidden))]), np.concatenate([np.ones(len(y)), np.full(len(hidden), 0.1 * y.sum() / max(1, len(hidden)))])
    slope, shift = _curve(*curve)
    odds = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)) - np.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(alphabet, table_, w_offset, slope, float(shift + odds))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of a logistic curve from x to y; both labels are drawn in a little, so that clear cases stay finite."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    rows, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-4 * np.eye(2), rows.T @ (weight * (goal - p)) - 1e-4 * w)
        w = w + step / max(1.0, float(np.abs(step).max()) / 5)
    return max(float(w[0]), 1e-3), float(w[1])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[ToxicityModel | None, float]:
    """The model of the labelled documents that aren't held out, and the share of label 1 among their labels."""
    spark = docs.sparkSession
    known = labels.select(id_column(), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = count.get(1, 0) / max(1, sum(count.values()))
    if len(count) < 2:
        return None, share
    most, rows = 4 * SAMPLE_PER_LABEL, []
    for label in (0, 1):
        # At most ``most`` ids of a label are sent to all tasks.
        part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, 1.5 * most / count[label]) * (1 << 30))
        ids = known.where(F.col("toxic") == label).where(part).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most).collect()
        ids = spark.createDataFrame([(r.doc_id,) for r in ids], "doc_id long")
        texts = docs.select(id_column(), "text").where(F.octet_length("text").between(1, SAMPLE_BYTES)).join(F.broadcast(ids), "doc_id")
        rows += [(r.text, label) for r in texts.orderBy(F.xxhash64("doc_id", "text"), "text").limit(SAMPLE_PER_LABEL).select("text").collect()]
    return train(rows, share), share


def _scored(model: ToxicityModel) -> Iterator:
    """A function from texts to decisions that remembers the words it has seen."""
    known: dict[bytes, int] = {}
    values, single = [np.empty(0)], [np.empty(0, dtype=bool)]

    def of_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Decision of each word (-inf without letters), and whether it is one letter."""
        if len(known) > CACHE_WORDS:
            known.clear()
            values[:], single[:] = [np.empty(0)], [np.empty(0, dtype=bool)]
        new = [w for w in words if w not in known]
        for lo in range(0, len(new), _CHUNK):
            strings = normal_words([w.decode() for w in new[lo : lo + _CHUNK]])
            flat = [s for x in strings for s in x]
            n = np.array([len(x) for x in strings])
            worst = np.full(len(n), -np.inf)
            np.maximum.at(worst, np.repeat(np.arange(len(n)), n), model.decisions(flat))
            values.append(worst)
            single.append(np.array([len(x) == 1 and len(x[0]) == 1 for x in strings], dtype=bool))
            for w in new[lo : lo + _CHUNK]:
                known[w] = len(known)
        values[:], single[:] = [np.concatenate(values)], [np.concatenate(single)]
        at = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
        return values[0][at], single[0][at]

    def score(texts: pa.Array) -> np.ndarray:
        data, offsets = utf8_buffer(texts, after=" ")
        start, end, first = spaced_words(data, offsets)
        worst = np.full(len(texts), -np.inf)
        if len(start):
            cut = np.concatenate([[0], np.cumsum(end - start)])
            packed = data[(data != 32) & ((data < 9) | (data > 13))]
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(packed)]).dictionary_encode()
            of, (value, one) = np.asarray(coded.indices), of_words(coded.dictionary.to_pylist())
            doc = np.repeat(np.arange(len(texts)), np.diff(first))
            np.maximum.at(worst, doc, value[of])
            # Rows of single letters; a word without letters or digits doesn't part them.
            seen = np.flatnonzero(np.isfinite(value[of]))
            lone = one[of[seen]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (lone * (doc[seen] + 1)), [0]])))
            for a, b in zip(edge, edge[1:]):
                if b - a >= 3 and lone[a]:
                    line = " ".join(data[start[k] : end[k]].tobytes().decode() for k in seen[a:b])
                    worst[doc[seen[a]]] = max(worst[doc[seen[a]]], model.decisions(words_of(line)).max())
        return np.where(np.isfinite(worst), worst, NOTHING)

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, and the decision of its worst word."""
    model, share = fit(docs, labels)
    rows = docs.select(id_column(), "text")
    if model is None:
        out = rows.select("doc_id", F.lit(NOTHING).alias("decision"), F.lit(float(share)).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            score = _scored(shared.value)
            for part in text_slices(batches):
                decisions = score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(decisions), pa.array(shared.value.scores(decisions))], names=["doc_id", "decision", "score"])

        out = rows.mapInArrow(run, "doc_id long, decision double, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "decision")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
