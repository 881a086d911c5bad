"""Alignment, periodic runs and toxicity against brute-force versions and held-out labels."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import op11_toxicity, op12_alignment, op13_periodic
from quillspark.llm.vocab import vocabulary_path

from .test_llm import documents, some_texts

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"

# ------------------------------------------------------------------ 11


def brute_kernel(s, t):
    """Subsequences of three letters of both strings, weighed by the stretches they span."""

    def features(word):
        word, out = f"\1{word}\2", collections.defaultdict(float)
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + op11_toxicity.REACH)):
                    out[word[i] + word[j] + word[k]] += op11_toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    norm = lambda x: sum(v * v for v in x.values()) ** 0.5
    return sum(v * b.get(k, 0) for k, v in a.items()) / (norm(a) * norm(b) or 1)


def test_kernel():
    words = ["idiot", "idxiot", "id", "a", "banana", "schlecht", "xx" * 12, "trash", "thrash"]
    alphabet = op11_toxicity.Alphabet(words)
    found = alphabet.kernel(words, words)
    assert np.allclose(found, [[brute_kernel(s, t) for t in words] for s in words])
    assert found[0, 1] > 0.4 > found[0, 4]


def test_words_of_a_sentence():
    assert op11_toxicity.words_of("An id-iot, i d i o t -- (x) to") == ["an", "idiot", "iot", "i", "d", "i", "o", "t", "x", "to", "idiotx"]
    assert op11_toxicity.words_of("--- !!") == []
    windows = op11_toxicity.words_of("x" * 100)
    assert all(len(w) <= op11_toxicity.WINDOW for w in windows) and sum(map(len, windows)) >= 100


def toxic_world(n=900, seed=4):
    rng = random.Random(seed)
    parts = ["the", "an", "er", "in", "on", "tion", "ha", "nd", "st", "ble", "wh", "ou"]
    insults = ["idiot", "worthless", "scum", "zorquf"]
    texts, toxic = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 2)):
                words[rng.randrange(len(words))] = rng.choice(insults) + rng.choice(["", "", ".", rng.choice(parts[:4])])
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    return texts, toxic


def labelled(spark, rows):
    return spark.createDataFrame([(i, 1, t, "x") for i, t in rows], "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_labels(spark):
    texts, toxic = toxic_world()
    extra = [None, "", "!!", " ".join(["the"] * 30000), " ".join(["the"] * 30000) + " idiot", "You i-d-i-o-t there", "i d i o t"]
    docs = documents(spark, texts + extra)
    rows = op11_toxicity.toxicity(docs, labelled(spark, enumerate(toxic))).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(by) == len(texts) + len(extra)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [i for i in range(len(texts)) if by[i].held_out]
    assert np.mean([by[i].predicted == toxic[i] for i in held]) > 0.98
    n = len(texts)
    assert [by[n + k].predicted for k in range(7)] == [0, 0, 0, 0, 1, 1, 1]
    assert {by[n + k].decision for k in range(3)} == {op11_toxicity.NOTHING}


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    texts, toxic = toxic_world(300, 5)
    docs = documents(spark, texts)
    turned = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    found = [{r.doc_id: r.score for r in op11_toxicity.toxicity(docs, labelled(spark, enumerate(x))).collect()} for x in (toxic, turned)]
    assert found[0] == found[1]


def test_toxicity_of_odd_rows(spark):
    texts, toxic = toxic_world(200, 6)
    ids = [None if i % 10 == 3 else 7 if i % 10 == 5 else i for i in range(200)]
    docs = documents(spark, texts, ids=ids)
    labels = labelled(spark, [*((i, t) for i, t in zip(ids, toxic)), (None, 1), (3, None), (5, 2)])
    rows = op11_toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 200 and not any(r.held_out for r in rows if r.doc_id is None)
    assert op11_toxicity.toxicity(docs.limit(0), labels).count() == 0
    for known, score in (([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)):
        assert {r.score for r in op11_toxicity.toxicity(docs, labelled(spark, known)).collect()} == {score}


# ------------------------------------------------------------------ 12


def brute_tokens(texts):
    """Token ids and bytes of each text on both sides, or None where they don't give the text back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in plain)}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        said_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        ok = b"".join(said_a) == b"".join(said_b) == (" " + t).encode()
        out.append((ids_a, np.cumsum([len(x) for x in said_a]).tolist(), ids_b, np.cumsum([len(x) for x in said_b]).tolist()) if ok else None)
    return out


def brute_alignment(texts):
    tokens, links = brute_tokens(texts), []
    for t in tokens:
        if t is None:
            links.append([])
            continue
        ids_a, end_a, ids_b, end_b = t
        links.append([(x, y) for x, s, e in zip(ids_a, [0, *end_a], end_a) for y, u, v in zip(ids_b, [0, *end_b], end_b) if s < v and u < e])
    count = collections.Counter(p for held in links for p in set(held))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for t, held in zip(tokens, links, strict=True):
        if t is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids_a, end_a, ids_b, end_b = t
        groups, i, j = [], 0, 0
        for cut in sorted(set(end_a) & set(end_b)):
            k, m = end_a.index(cut) + 1, end_b.index(cut) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        rows.append((len(ids_a), len(ids_b), len(groups), len(held), sum(count[p] == best[p[0]] for p in held), sum(count[p] for p in held), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


ODD = [
    "a  b", " x", "\nab", "a\nb  \n c", "<s>a</s> <|endoftext|>", "a▁b", "\x00a", "é\xa0 x", "a ", "don't  we'll\r\n x\r y", "　  x \x85 y", "\x1c \x1d a", "\t\t a\t\tb", "日本 語\n\n\nに", "🙂 🙂🙂", "12 345  678", "<0x0A> x <unk>",
    "à la été   z", "\x7f z", "if (x) {\r\n  y;\r\n}", "\n\n\n", "   ", "'s 's", "x" * 500, "ab " * 400,
]
COLUMNS_12 = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs, **more):
    return op12_alignment.alignment(docs, vocabulary_path(A), vocabulary_path(B), **more)


@pytest.mark.parametrize("block_bytes", [1, 1 << 22])
def test_alignment(spark, block_bytes):
    texts = some_texts(7) + ODD
    found = {r.doc_id: tuple(r[c] for c in COLUMNS_12) for r in aligned(documents(spark, texts), block_bytes=block_bytes).collect()}
    assert [found[i] for i in range(len(texts))] == brute_alignment(texts)


def test_alignment_of_random_texts(spark):
    rng = random.Random(12)
    signs = ["a", "b", "th", "e", " ", " ", "  ", "\n", "\r", "\t", "\xa0", " ", "　", "é", "à", "'", "s", "1", "22", ".", "▁", "ſ", "́", "🙂", "{", "\x85", "\x1f"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    found = {r.doc_id: tuple(r[c] for c in COLUMNS_12) for r in aligned(documents(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_alignment(texts)


def test_alignment_of_odd_rows(spark):
    docs = documents(spark, ["same text", "same text", "other words", None], ids=[5, 5, None, None])
    rows = aligned(docs).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in rows)[:2] == [(False, 2, 4)] * 2
    assert sorted(r.n_a for r in rows if r.doc_id is None) == [0, 2]
    assert aligned(docs.limit(0)).count() == 0
    assert {r.n_links for r in aligned(documents(spark, [None, ""])).collect()} == {0}


# ------------------------------------------------------------------ 13


def brute_runs(doc_id, text):
    words = SPACE.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]

    def smallest(s, e):
        return next(q for q in range(1, e - s + 1) if all(words[i] == words[i + q] for i in range(s, e - q)))

    runs = []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s + q
            while e < n and words[e] == words[e - q]:
                e += 1
            if e - s >= max(6, 4 * q) and smallest(s, e) == q:
                runs.append((s, e - s, q))
            s = max(s + 1, e - q + 1)
    runs.sort(key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS_13 = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_texts():
    rng = random.Random(13)
    texts = some_texts(3, 30) + ["a a a a a a", "a a a a a", "a b a b a b a b", "a b a b a b a", "x a a a a a a a b b b b b b b y", "a b c " * 5, " ".join("ab" * 7 + "a"), "a a b " * 9 + "a a", "  a a " * 5]
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "a", "abcdefgh"])
        words = []
        while len(words) < rng.randint(1, 90):
            words += [rng.choice(letters) for _ in range(rng.randint(1, 5))] * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("long_bytes", [1 << 16, 0])
def test_periodic_runs(spark, long_bytes):
    texts = periodic_texts()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS_13) for r in op13_periodic.periodic_runs(documents(spark, texts), long_bytes).collect()}
    assert len(found) == len(texts)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    for i, t in enumerate(texts):
        assert found[i] == brute_runs(i, t), (i, t)


@pytest.mark.parametrize("long_bytes", [1 << 16, 0])
def test_periodic_runs_of_odd_rows(spark, long_bytes):
    texts = [None, "a " * 40, "a " * 40, "b c " * 30, "", " "]
    docs = documents(spark, texts, ids=[None, None, 4, 4, 4, 9])
    rows = op13_periodic.periodic_runs(docs, long_bytes)
    assert rows.dtypes[0] == ("doc_id", "bigint")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r[c] for c in ["doc_id", *COLUMNS_13]) for r in rows.collect()], key=key) == sorted([(i, *brute_runs(i, t)) for i, t in zip([None, None, 4, 4, 4, 9], texts)], key=key)
    assert op13_periodic.periodic_runs(docs.limit(0), long_bytes).count() == 0


def test_long_periods_are_found_by_ranges_of_lags(spark):
    rng = random.Random(5)
    block = [str(rng.random()) for _ in range(700)]
    text = " ".join(["start"] + block * 5 + ["end"])
    rows = op13_periodic.periodic_runs(documents(spark, [text, text], ids=[1, 2]).where(F.length("text") > 0), 1000).collect()
    assert {(r.start, r.length, r.period) for r in rows} == {(1, 3500, 700)}
