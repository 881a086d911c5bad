"""Each corpus operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bcr, graph, op01_language, op02_suffix_dedup, op03_token_store, op04_quality, op05_mixing, op06_decontaminate, op07_token_counts, op08_secret_scan, op09_minhash, op10_fingerprint
from quillspark.llm.common import scratch_path
from quillspark.llm.vocab import WordBpe, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id long"
WORDS = "the of and tion heer ing café über 12 $$$ don't x9 É".split()


def documents(spark, texts, ids=None, sources=None, langs=None):
    """A documents table with columns whose names clash with those the operators use."""
    rows = [((ids or range(len(texts)))[i], t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or ""), 0.5, "k", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    out = [None, "", " ", "a", "\n\t", "日本語 " * 30, "x" * 3000, passage, passage, passage + " end", "pre " + passage]
    for _ in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.randint(1, 120)))
        out.append(text if rng.random() < 0.7 else text[:20] + passage + text[20:])
    return out


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ------------------------------------------------------------------ 1


def test_language(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "ru", "mi", "to"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "que", "ment", "les"]}
    langs = [rng.choice(list(parts)) for _ in range(300)]
    texts = [" ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30)) for lang in langs]
    docs = documents(spark, [*texts, None, "", "123 !!", "ß" * 5000], langs=[*langs, "aa", "bb", None, None])
    found = op01_language.identify(docs.withColumn("held_out", op01_language.held_out()), op01_language.fit(docs), "doc_id", "held_out").collect()
    assert len(found) == 304
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (300, 301, 302))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in found)
    held = [i for i in range(300) if by[i].held_out]
    assert np.mean([by[i].lang_pred == langs[i] for i in held]) > 0.97


def test_language_without_labels(spark):
    docs = documents(spark, ["abc", None], langs=[None, None])
    assert {r.lang_pred for r in op01_language.identify(docs, op01_language.fit(docs), "doc_id").collect()} == {"und"}
    empty = docs.limit(0)
    assert op01_language.identify(empty, op01_language.fit(empty), "doc_id").count() == 0


def test_language_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op01_language, "train", lambda rows: seen.extend(rows))
    texts = [f"word {i % 3} {i}" for i in range(900)] + ["same"] * 900
    for ids in ([1] * 1800, [None] * 1800):
        seen.clear()
        op01_language.fit(documents(spark, texts, ids=ids), per_language=50)
        assert 20 <= len(seen) <= 100 or zlib.crc32(str(ids[0] or "").encode()) % 4 == 2


@pytest.mark.parametrize("n", [2, 3, 5, 7, 12])
def test_codewords_are_apart(n):
    code = op01_language.codewords(n)
    gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(gaps) >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 8)
    assert all(0 < (c > 0).sum() < n for c in code.T)


def test_letters_are_of_category_l(spark):
    docs = documents(spark, ["²", "½ ①", "Ⅷ", "ª", "x", "ж", None, "x", "x"], ids=[1, 2, 3, 4, 5, 6, 7, 5, None], langs=["en"] * 9)
    found = op01_language.identify(docs, op01_language.fit(docs), "doc_id", "text").collect()
    assert len(found) == 9 and {r.text for r in found if r.lang_pred == "und"} == {"²", "½ ①", "Ⅷ", None}


def test_decoding_equals_brute_force():
    rng = random.Random(8)
    rows = [("".join(rng.choice(abc) for _ in range(40)), lang) for abc, lang in (("abcd ", "p"), ("cdef ", "q"), ("efgh ", "r")) for _ in range(20)]
    model = op01_language.train(rows)
    texts = [t[:9] for t, _ in rows] + ["Abc, dé", "1"]
    margins = model.margins(*op01_language.grams(texts))
    lang, score, unsure = model.predict(texts)
    for i, text in enumerate(texts[:-1]):
        padded = re.sub(rb"[^a-z\x80-\xff]+", b" ", (" " + text.lower() + " ").encode())
        ids = [((padded[k] << 16 | padded[k + 1] << 8 | padded[k + 2]) * 2654435761 % 2**32) >> 17 for k in range(len(padded) - 2)]
        raw = [sum(float(w[g]) for g in ids) / max(len(ids), 1) ** 0.5 for w in model.weights]
        assert margins[i] == pytest.approx([r * a + b for r, (a, b) in zip(raw, model.scale, strict=True)], abs=1e-3), text
        loss = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margins[i], word, model.trust, strict=True)) for word in model.code]
        share = np.exp(min(loss) - np.array(loss)) / np.exp(min(loss) - np.array(loss)).sum()
        assert lang[i] == model.languages[int(np.argmin(loss))] and score[i] == pytest.approx(share.max()) and unsure[i] == (share.max() < op01_language.AMBIGUOUS)
    assert lang[-1] == "und" and score[-1] == 0


def thue_morse(n):
    """Two words of n letters that any polynomial modulo a power of two hashes alike."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_hash_alike_modulo_powers_of_two(spark, n):
    one, two = thue_morse(n)
    texts = [one, two, f"{one} x y z", f"{two} x y z"]
    docs = documents(spark, texts)
    ids, at = WordBpe(vocabulary_path()).encode(texts)
    assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == library(texts)
    assert [r.n_tokens for r in op03_token_store.token_store(docs).orderBy("doc_id").collect()] == [len(x) + 1 for x in library(texts)]
    counts = op07_token_counts.token_counts(docs, op07_token_counts.CountCache(spark, scratch_path(spark, "test")))
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == dict(enumerate(map(len, library(texts))))
    assert [r.component_id for r in op09_minhash.near_duplicates(docs, 4, 80).orderBy("doc_id").collect()] == [0, 1, 2, 3]
    items = spark.createDataFrame([("p", one), ("q", two)], "item_id string, text string")
    assert sorted(tuple(r) for r in op06_decontaminate.contamination(docs, items).collect()) == contaminated(texts, [("p", one), ("q", two)], 10)
    got = sorted(tuple(r)[:5] for r in op02_suffix_dedup.remove_repeats(docs).collect())
    assert got == repeats([(i, t.encode()) for i, t in enumerate(texts)], 100)


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr("quillspark.llm.vocab.SpanHasher.spans", lambda self, prefix, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    texts = [*some_texts(6, 20), "it's 'sun we're"]
    bpe = WordBpe(vocabulary_path())
    for _ in range(2):
        ids, at = bpe.encode(texts)
        assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == library(texts)


# ------------------------------------------------------------------ 2


def repeats(docs, width):
    """Brute force: rows of (doc_id, n_bytes, n_removed, n_spans, digest of the rest)."""
    first = {}
    for i, b in docs:
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], (i, p))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] != (i, p):
                gone[p : p + width] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "anchor"), [(100, 32), (20, 6), (7, 3)])
def test_suffix_dedup(spark, width, anchor):
    texts = [*some_texts(3), "ab" * 400, "ab" * 90 + "c" + "ab" * 90, "z" * 99, "z" * 100, "z" * 101]
    got = sorted(tuple(r)[:5] for r in op02_suffix_dedup.remove_repeats(documents(spark, texts), width, anchor).collect())
    assert got == repeats([(i, (t or "").encode()) for i, t in enumerate(texts)], width)


def test_suffix_dedup_of_odd_ids(spark):
    docs = documents(spark, ["q" * 150, "q" * 150, None], ids=[None, 5, 5])
    got = {r.doc_id: r for r in op02_suffix_dedup.remove_repeats(docs).collect() if r.n_bytes}
    assert got[None].n_removed == 149 and got[5].n_removed == 150
    assert op02_suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_keeps_rows_of_one_id_apart(spark):
    rng = random.Random(22)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, shared = some(900), some(130)
    texts = [base, some(200) + base[300:430] + some(200), some(530), some(357), shared + some(300), some(90) + shared + some(40), "same " * 60, "same " * 60, some(700)[:650] + base[:50], None, ""]
    ids = [1, 2, 2, None, None, 4, 2, 2, None, 2, 2]
    docs = documents(spark, texts, ids=ids)
    tags = [r.tag for r in spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "i int, text string").orderBy("i").selectExpr("pmod(xxhash64(text), 2147483648L) AS tag").collect()]
    keys = [(i is not None, i or 0, tag) for i, tag in zip(ids, tags)]
    one = dict(zip(keys, [(t or "").encode() for t in texts]))
    expected = {r[0]: r[1:] for r in repeats(sorted(one.items()), 100)}
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted((tuple(r)[:5] for r in op02_suffix_dedup.remove_repeats(docs).collect()), key=key)
    assert got == sorted(((i, *expected[k]) for i, k in zip(ids, keys)), key=key)


def test_collection_transform():
    rng = random.Random(4)
    for _ in range(15):
        strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 20))) for _ in range(rng.randint(1, 20))]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        bwt, lcp, _ = bcr.collection_bwt(np.frombuffer(b"".join(strings), np.uint8), offsets)
        rows = sorted(((s[i:], j, i) for j, s in enumerate(strings) for i in range(len(s) + 1)), key=lambda r: [(c + 1, 0) for c in r[0]] + [(0, r[1])])
        assert list(bwt) == [strings[j][i - 1] + 1 if i else 0 for _, j, i in rows]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert list(lcp) == [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))]


# ------------------------------------------------------------------ 3 and 7


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_cache_equals_library():
    texts = [*some_texts(5), "it's 'sun we're I'll 'tis ''s ,'s a'd' 'm", "<|endoftext|> hi", "ΣΑΣ", "İstanbul", "½ ² 12345", "a\x1cb\x85c", "É'S 'T"]
    bpe = WordBpe(vocabulary_path())
    for _ in range(2):
        ids, at = bpe.encode(texts)
        assert [list(ids[a:b]) for a, b in zip(at, at[1:], strict=False)] == library(texts)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_vbyte_round_trip(n):
    values = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n, dtype=np.uint32)
    control, data = op03_token_store.vbyte_encode(values)
    assert (op03_token_store.vbyte_decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def test_token_store(spark):
    texts = some_texts(6)
    ids = [i * 3 % 1000 for i in range(len(texts))]
    path = scratch_path(spark, "test-store")
    op03_token_store.write_store(documents(spark, texts, ids), path, vocabulary_path(), block_ids=500)
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op03_token_store.read_store(spark, path).collect()}
    want, start = {}, 0
    for i, e in sorted(zip(ids, library(texts), strict=True)):
        raw = np.array([*e, 2], dtype="<u4")
        want[i] = (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert got == want


def test_token_store_of_odd_ids(spark):
    rows = op03_token_store.token_store(documents(spark, ["b", "a", None], ids=[7, 7, None])).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 7, 7] and [r.start for r in rows] == [0, 1, 3]
    assert op03_token_store.token_store(documents(spark, ["b"]).limit(0)).count() == 0


def test_token_counts_and_cache(spark):
    texts = some_texts(7)
    cache = op07_token_counts.CountCache(spark, scratch_path(spark, "test-cache"))
    docs = documents(spark, texts)
    want = {i: (len((t or "").encode()), len(e), len(e) > 50) for i, (t, e) in enumerate(zip(texts, library(texts), strict=True))}
    for _ in range(2):
        assert {r.doc_id: tuple(r)[1:] for r in op07_token_counts.token_counts(docs, cache, limit=50).collect()} == want
    stored = spark.read.parquet(cache.path)
    assert stored.count() == stored.select("digest").distinct().count() == len({re.sub("[ \t\n]+", " ", t or "") for t in texts})
    op07_token_counts.token_counts(documents(spark, ["quite new", texts[8]]), cache).count()
    assert spark.read.parquet(cache.path).count() == stored.count() + 1
    assert op07_token_counts.token_counts(docs.limit(0), cache).count() == 0


# ------------------------------------------------------------------ 4


def test_quality(spark):
    rng = random.Random(8)
    good = [" ".join(rng.choice(["river", "stone", "green", "walk"]) for _ in range(40)) for _ in range(80)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "win###"]) for _ in range(40)) for _ in range(20)]
    docs = documents(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(i, 0, 0) for i in range(80, 100)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op04_quality.resample(docs, labels, keep=0.8).collect()}
    assert len(got) == 102 and sum(r.selected for r in got.values()) == round(0.8 * 102)
    assert sum(got[i].selected for i in range(80)) == 80 and got[100].log_weight == got[101].log_weight == 0
    assert op04_quality.resample(docs.limit(0), labels).count() == 0
    assert all(r.log_weight == 0 for r in op04_quality.resample(docs, labels.limit(0)).collect())


@pytest.mark.parametrize("sharpness", [None, 20.0])
def test_importance_ratio_equals_brute_force(spark, sharpness):
    """Models of all raw and of the good documents, the ratio of each text, and the share kept; repeated rows, null ids and ties too."""
    texts = [*some_texts(14, 40), "same words", "same words", None]
    ids = [*range(len(texts) - 3), 500, 500, None]
    docs = documents(spark, texts, ids=ids)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    parts = {}
    for text in {t or "" for t in texts}:
        chars, _, pairs, _ = op04_quality.features(pa.array([text]))
        assert len(chars) == max(0, len(text.encode()) - 2), text[:20]  # the line's end is a sign of the last one
        assert len(pairs) == max(0, len(re.findall("[^ \\t\\n\\r\\f\\v]+", text)) - 1)
        parts[text] = (chars, pairs)
    raw, good = np.ones(2 * op04_quality.BUCKETS), np.ones(2 * op04_quality.BUCKETS)
    for i, t in zip(ids, texts, strict=True):
        for bucket in np.concatenate(parts[t or ""]):
            raw[bucket] += 1
            good[bucket] += i is not None and i < 20 and i % 2
    half = op04_quality.BUCKETS
    ratio = np.concatenate([np.log(good[p] / good[p].sum()) - np.log(raw[p] / raw[p].sum()) for p in (slice(0, half), slice(half, None))])
    want = [sum(ratio[b] for b in np.concatenate(parts[t or ""])) / (1 if sharpness is None else max(len(np.concatenate(parts[t or ""])), 1) / sharpness) for t in texts]
    got = op04_quality.resample(docs, labels, 0.5, sharpness).collect()
    found, wanted = sorted((str(r.doc_id), r.log_weight) for r in got), sorted((str(i), w) for i, w in zip(ids, want, strict=True))
    assert [i for i, _ in found] == [i for i, _ in wanted] and [w for _, w in found] == pytest.approx([w for _, w in wanted], abs=0.02)
    keys = sorted((r.key for r in got), reverse=True)
    cut = keys[round(0.5 * len(keys)) - 1]
    assert all(r.selected == (r.key >= cut) for r in got) and len({r.selected for r in got if r.doc_id == 500}) == 1


def test_kth_largest(spark):
    values = [float(x) for x in [3, 3, 3, 9, -2, 7, 7.5, 1e9, 0, 3]]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, 11):
        assert op04_quality.kth_largest(rows, "v", k, parts=3) == sorted(values, reverse=True)[k - 1]


# ------------------------------------------------------------------ 5


def test_apportionment_is_by_highest_quotients():
    rng = random.Random(9)
    for _ in range(40):
        votes = [rng.choice([0.0, 1.0, rng.random() * 100]) for _ in range(rng.randint(1, 8))]
        seats = rng.randint(0, 60)
        if not any(votes):
            continue
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        want = collections.Counter(i for _, i in ranked)
        assert op05_mixing.sainte_lague(votes, seats) == [want[i] for i in range(len(votes))]
    assert op05_mixing.sainte_lague([10, 1], 9, [3, 5]) == [3, 5]


def highest_quotients(votes, seats, caps):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))):
        got[max((i for i in range(len(votes)) if votes[i] > 0 and got[i] < caps[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_with_many_claimants():
    assert op05_mixing.sainte_lague([1000.0] + [0.6] * 100, 1060)[0] == 960
    votes = [1000.0, *(0.6 + k % 7 for k in range(1000))]
    assert op05_mixing.sainte_lague(votes, 3000) == highest_quotients(votes, 3000, [3000] * 1001)
    rng = random.Random(23)
    for _ in range(60):
        n = rng.randint(1, 40)
        votes, caps, seats = [rng.choice([0, 0.6, 1, 2, 100 * rng.random()]) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)], rng.randint(0, 300)
        assert op05_mixing.sainte_lague(votes, seats, caps) == highest_quotients(votes, seats, caps)


def test_targets_are_capped_and_reshared():
    assert op05_mixing.targets([10, 100, 100], [1, 1, 1], 210) == [30.0, 90.0, 90.0]
    assert op05_mixing.targets([0, 10], [5, 1], 10) == [0.0, 10.0]


def test_mix(spark):
    rng = random.Random(10)
    texts = [" ".join("w" for _ in range(rng.randint(0, 200))) for _ in range(400)] + [None]
    sources = [rng.choice(["b", "a", "é", None, "c"]) if i > 5 else "tiny" for i in range(400)] + ["a"]
    docs = documents(spark, texts, sources=sources)
    first = sorted(tuple(r) for r in op05_mixing.mix(docs, lambda k: k % 3 + 1).drop("source", "shard").collect())
    again = sorted(tuple(r) for r in op05_mixing.mix(docs.repartition(7), lambda k: k % 3 + 1).drop("source", "shard").collect())
    assert first == again and len(first) == 401
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    totals, taken = collections.Counter(), collections.Counter()
    for i, s, source_size, _, took in first:
        assert s == size[i] and 0 <= took <= 3 * s
        totals[sources[i]] += s
        taken[sources[i]] += took
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, op05_mixing.targets([totals[s] for s in order], [k % 3 + 1 for k in range(len(order))], sum(totals.values())), strict=True))
    for i, _, source_size, target, _ in first:
        assert source_size == totals[sources[i]] and target == pytest.approx(goal[sources[i]])
    assert all(abs(taken[s] - goal[s]) <= 0.05 * goal[s] + 3 for s in order)
    assert op05_mixing.mix(docs.limit(0), lambda k: 1).count() == 0


# ------------------------------------------------------------------ 6


def contaminated(texts, items, window):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower_ascii(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in enumerate(texts):
        w, hit, found = pattern.findall(lower_ascii(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize(("window", "slice_bytes"), [(10, 1 << 20), (3, 1 << 20), (4, 600), (1, 1 << 20)])
def test_decontamination(spark, window, slice_bytes):
    texts = [*some_texts(11, 80), "THE Of and", "x\0y " * 4]
    items = [(0, "the of and tion the"), (1, "Heer ing"), (2, "café über 12 x9 É the of"), (2, "über"), (None, "the"), (3, None), (4, ""), (5, texts[7]), (11, "the of and tion the"), (6, "x y x y")]
    benchmark = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n_words int")
    got = sorted(tuple(r) for r in op06_decontaminate.contamination(documents(spark, texts), benchmark, window, slice_bytes).collect())
    assert got == sorted(contaminated(texts, items, window))


def test_decontamination_keeps_rows_apart(spark):
    texts = ["a b c d", "a b c d", "x", None, "x b c", "a b c d"]
    docs = documents(spark, texts, ids=[None, None, 4, 4, 4, 4])
    items = spark.createDataFrame([("i", "a b c"), ("j", "b c"), ("i", "b c d")], "item_id string, text string")
    for slice_bytes in (1 << 20, 4):
        got = op06_decontaminate.contamination(docs, items, 10, slice_bytes, carry=("text", "score")).collect()
        want = contaminated(texts, [("i", "a b c"), ("j", "b c"), ("i", "b c d")], 10)
        assert sorted((str(r.text), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted((str(texts[i]), *rest) for i, *rest in want)
        assert sorted(str(r.doc_id) for r in got) == ["4"] * 4 + ["None"] * 2


def test_decontamination_of_empty_tables(spark):
    docs = documents(spark, ["the of", None])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in op06_decontaminate.contamination(docs, none).collect()] == [0, 0]
    assert op06_decontaminate.contamination(docs.limit(0), none).count() == 0


# ------------------------------------------------------------------ 8


def test_secrets(spark):
    hexes, access = hashlib.sha1(b"1").hexdigest(), "AKIA" + "Z9" * 8
    texts = [*some_texts(12, 20), None, f"🙂 Password = '{hexes}'", f"token: short, secret:{access} {access}", "token=secret: abcdefghij", f"API_KEY=abc.def/ghi+{'k' * 40} x {hexes}{hexes}", "AKIAAKIA" + "B" * 9, "api-key: nope12345", "ſecret=12345678", "a" * 31 + " " + "a" * 32]
    kinds = (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))
    want = {}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in p.finditer(t or "") if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k])
        want[i] = (*[sum(s[1] == k for s in spans) for k in range(3)], hashlib.sha256(",".join(f"{op08_secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest(), {f"{op08_secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans})
    for r in op08_secret_scan.secret_scan(documents(spark, texts)).collect():
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert want[r.doc_id][4] <= set(r.spans.split(",")) and all(s.startswith("markov") for s in set(r.spans.split(",")) - want[r.doc_id][4] - {""})


def test_markov_models_tell_random_from_named(spark):
    ratios = op08_secret_scan.fit(op08_secret_scan.labelled_samples(spark, 2000))
    fresh = op08_secret_scan.labelled_samples(spark, 3000).where("length(text) >= 20")
    right = fresh.select((F.col("label") == (op08_secret_scan.token_score(F.col("text"), ratios) >= op08_secret_scan.THRESHOLD)).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.98
    text = "see Zm9vQmF6OTg3NjU0MzIxMHF3ZXJ0eXVpb3A0 and customer_account_balance_total here"
    spans = op08_secret_scan.secret_scan(documents(spark, [text])).first().spans
    assert spans == "markov:4:40"
    assert op08_secret_scan.secret_scan(documents(spark, [text]).limit(0)).count() == 0


def test_secrets_of_a_text_with_many_matches(spark):
    """Thousands of runs of hex in one text, between tokens that overlap none: spans by brute force, in time that follows their number."""
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(3000)]
    text = " ".join(h if k % 3 else "é x-" + h for k, h in enumerate(hexes))
    docs = spark.createDataFrame([(1, text), (None, text[:500]), (1, text[:500])], "doc_id long, text string")
    rows = op08_secret_scan.secret_scan(docs).collect()
    spans = [f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{32,}", text)]
    whole = next(r for r in rows if r.n_hex > 100)
    assert whole.n_hex == len(spans) and whole.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert whole.spans == ",".join(spans) and sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]


# ------------------------------------------------------------------ 9


def near(texts, words, percent):
    pattern, sets = re.compile("[^\x20\x09-\x0d]+"), []
    for t in texts:
        w = pattern.findall(lower_ascii(t))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("words", "percent"), [(4, 80), (5, 80), (2, 90)])
def test_near_duplicates(spark, words, percent):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "One", "one ", "a b", "A  B", " "]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 120, 400]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 12, 20]))) for _ in range(40)]
    got = sorted(tuple(r) for r in op09_minhash.near_duplicates(documents(spark, texts), words, percent).collect())
    assert got == near(texts, words, percent)


def test_near_duplicates_of_a_large_group(spark):
    """2,000 near copies, some too far from most others, and 400 documents that share a passage only."""
    rng = random.Random(31)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(2000):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            words[rng.randrange(60)] = f"v{k}x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:40] + [f"u{k}y{i}" for i in range(60)]) for k in range(400)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    number = {}
    hold = np.zeros((len(sets), sum(map(len, sets))), dtype=bool)
    for i, own in enumerate(sets):
        hold[i, [number.setdefault(x, len(number)) for x in own]] = True
    hold = hold[:, : len(number)].astype(np.float32)
    both = np.concatenate([hold[at : at + 300] @ hold.T for at in range(0, len(hold), 300)])
    size = both.diagonal()
    link = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    least = np.arange(len(sets))
    while True:
        now = np.array([least[row].min() for row in link])
        if (now == least).all():
            break
        least = now
    got = [r.component_id for r in op09_minhash.near_duplicates(documents(spark, texts), 4, 80).orderBy("doc_id").collect()]
    assert got == least.tolist() and 100 < len(set(got[:2000])) < 1900


def test_pairs_below_the_threshold_send_nothing(spark):
    """Sets of 300 shingles that share so many with one base that two of them reach 0.75, and six that reach the threshold with each other."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base[:257] + [f"v{k}x{i}" for i in range(43)]) for k in range(60)]
    texts += [" ".join(base[:280] + [f"u{k}y{i}" for i in range(20)]) for k in range(6)] + ["same " * 50 + " ".join(base[:200])]
    rows = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    got = op09_minhash._bitmaps(rows, 1).orderBy("id").toArrow()
    bits = np.frombuffer(b"".join(got.column("bits").to_pylist()), dtype=np.uint8).reshape(len(texts), -1)
    side = (np.asarray(got.column("id")), np.arange(len(texts)), np.asarray(got.column("n")), bits)
    a, b, _ = op09_minhash._best(side, side, 10**6, 80)
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(x & y) >= 80 * len(x | y)}
    assert want == set(zip(a.tolist(), b.tolist(), strict=True)) and len(want) == 30


def test_near_duplicates_of_odd_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x y z u v w", "x y z u v w"], ids=[None, 4, 4, 9])
    got = sorted((r.doc_id is None, r.component_id, r.kept) for r in op09_minhash.near_duplicates(docs).collect())
    assert got == [(False, 4, False), (False, 4, True), (False, 4, True), (True, None, True)]
    assert op09_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_register_estimate_is_near():
    rng = np.random.default_rng(14)
    for share in (0.3, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        k = int(1000 * share * 2 / (1 + share))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:k], pool[1000 : 2000 - k]]))
        regs = op09_minhash.registers(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        assert abs(op09_minhash.estimate(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0] - share) < 0.12


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for e in edges for n in e if e[0] != e[1]} | {n: got[n] for n in ()}
    more = spark.createDataFrame([(0, 1000), (5000, 5001)], "a long, b long")
    joined = {r.node: r.component for r in graph.join_groups(graph.components(spark.createDataFrame(edges, "a long, b long")), more).collect()}
    assert joined[1100] == joined[0] == root(0) and joined[5001] == 5000


# ------------------------------------------------------------------ 10


def test_fingerprints(spark):
    texts = [*some_texts(16), "🙂" * 40, "ab"]
    order = sorted(range(len(texts)), reverse=True)
    following = {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    for parts in (1, 5):
        for r in op10_fingerprint.edit_neighbours(documents(spark, texts).repartition(parts)).collect():
            text, other = texts[r.doc_id] or "", texts[following[r.doc_id]] or ""
            changed = op10_fingerprint.edited(text, other)
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
            a, b, c = op10_fingerprint.fingerprints([text, changed, other])
            assert (r.fingerprint, r.edited_fingerprint) == (op10_fingerprint.fingerprint_hex(a), op10_fingerprint.fingerprint_hex(b))
            assert (r.near_edited, r.near_next) == (op10_fingerprint.likeness(a, b), op10_fingerprint.likeness(a, c))
            assert text[: r.unchanged] == changed[: r.unchanged] and (text + "\0")[r.unchanged] != (changed + "\1")[r.unchanged]


def test_fingerprints_of_odd_ids(spark):
    rows = op10_fingerprint.edit_neighbours(documents(spark, ["abcdef" * 9, "ghijkl" * 9, None], ids=[None, 3, 3])).collect()
    assert len(rows) == 3
    one = op10_fingerprint.edit_neighbours(documents(spark, ["abcabc"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcaab").hexdigest()
    assert op10_fingerprint.edit_neighbours(documents(spark, ["a"]).limit(0)).count() == 0


def test_prefix_hashes_compare_any_spans():
    codes = np.frombuffer(("abcabcabxabcabc" * 20).encode("utf-32-le"), np.uint32)
    hashes = op10_fingerprint.PrefixHashes(codes)
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 290, 200), rng.integers(0, 290, 200)
    n = np.minimum(300 - np.maximum(a, b), 12)
    same = hashes.spans(a, a + n) == hashes.spans(b, b + n)
    assert same.tolist() == [codes[x : x + k].tolist() == codes[y : y + k].tolist() for x, y, k in zip(a, b, n, strict=True)]
    limit = 300 - np.maximum(a, b)
    want = [next((k for k in range(m) if codes[x + k] != codes[y + k]), m) for x, y, m in zip(a, b, limit, strict=True)]
    assert hashes.extension(a, b, limit).tolist() == want


# ------------------------------------------------------------------ the queries and the pipeline


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = cp.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:4]:
        before = docs
        docs = cp.materialise(stage(spark, before, sf), "test-stage")
        assert docs.columns == cp.COLUMNS
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        own = sorted((r.doc_id, r.text) for r in before.collect())
        if name == "near duplicates":
            groups = near([t for _, t in own], 5, 80)
            assert ids == {own[i][0] for i, _, _, kept in groups if kept}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in cp.table(spark, sf, "benchmark").collect()]
            assert ids == {own[r[0]][0] for r in contaminated([t for _, t in own], items, 10) if not r[5]}
        else:
            assert ids <= {i for i, _ in own}
    final = {(r.start, r.doc_id): r.n_tokens for r in cp.STAGES[4][1](spark, docs, sf).collect()}
    rows = sorted(r.doc_id for r in docs.collect())
    assert [i for _, i in sorted(final)] == rows
    counts = dict(zip(texts, library(texts.values()), strict=True))
    assert all(n == len(counts[i]) + 1 for (_, i), n in final.items())


def test_pipeline_without_labels(spark):
    import corpus_pipeline as cp

    texts = ["some words", "日本語", "12 $$$ _", "", None, "é", "held out"]
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = documents(spark, texts, ids=[*range(6), held], langs=[None] * 6 + ["en"])
    left = cp.language_id(spark, docs, "")
    assert left.columns == cp.COLUMNS and sorted(r.text for r in left.collect()) == sorted(["some words", "日本語", "é", "held out"])


def test_pipeline_drops_rows_and_not_ids(spark, tmp_path):
    import corpus_pipeline as cp

    passage = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([("b", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [f"x {passage} y", "clean a", f"z {passage}", "clean b", "clean c", None], ids=[None, None, 4, 4, 5, None])
    left = cp.decontaminate(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("4", "clean b"), ("5", "clean c"), ("None", "None"), ("None", "clean a")]

    copy, other, lone = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    docs = documents(spark, [copy, copy, copy, other, other, lone, copy, "", None, lone, copy], ids=[None, 4, 4, None, None, 4, 9, 4, None, 3, None])
    left = cp.near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == [("3", lone), ("4", ""), ("4", copy), ("None", "None"), ("None", other)]


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, ["same text here", "same text here", None, "", "12 $", "same text here", "x" * 100_000], ids=[1, 1, 2, None, None, None, 3])
    docs = docs.withColumn(cp.ROW, F.lit(1)).withColumn("taken", F.lit("x")).withColumn("component_id", F.lit("x")).withColumn("contaminated", F.lit(True))
    left = {name: stage(spark, docs, str(tmp_path)) for name, stage in cp.STAGES}
    assert all(left[name].columns == cp.COLUMNS for name, _ in cp.STAGES[:4])
    texts = {name: sorted(str(r.text)[:20] for r in left[name].collect()) for name, _ in cp.STAGES[:4]}
    assert texts["near duplicates"] == ["", "12 $", "None", "same text here", "x" * 20]
    assert len(texts["decontamination"]) == 7 and left["token files"].count() == 7
    assert texts["language id"] == ["same text here"] * 3 + ["x" * 20]
    assert set(texts["source mix"]) <= {"12 $", "same text here", "x" * 20} and len(texts["source mix"]) == 5
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("shard_words", [2_000_000, 2_000])
def test_pipeline_mix_keeps_the_words_of_each_source(spark, monkeypatch, shard_words):
    import corpus_pipeline as cp

    monkeypatch.setattr(op05_mixing, "SHARD_WORDS", shard_words)
    rng = random.Random(21)
    sources = ["tiny", *(rng.choices(["a", "b", None, "é"], [10, 4, 2, 1], k=600))]
    texts = ["only three words", *(" ".join([f"d{i}"] * rng.randint(1, 200)) for i in range(600))]
    ids = [None if i % 10 == 3 else 7 if i % 10 == 4 else i for i in range(601)]  # the tiny source makes blocks of one word
    docs = documents(spark, texts, ids=ids, sources=sources)
    rows = cp.mix_sources(spark, docs, "").collect()
    size, words, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for s, t in zip(sources, texts, strict=True):
        size[s] += len(t.split())
        longest[s] = max(longest[s], len(t.split()))
    for r in rows:
        words[r.source] += len(r.text.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, op05_mixing.targets([size[s] for s in order], [k % 3 + 1 for k in range(len(order))], sum(size.values())), strict=True))
    assert min(goal[s] / size[s] for s in order) < 0.5  # a source that rounding to the nearest whole would drop
    for s in order:
        assert abs(words[s] - goal[s]) <= longest[s] + 3 + 0.03 * goal[s] * (shard_words == 2_000), s


def test_every_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
