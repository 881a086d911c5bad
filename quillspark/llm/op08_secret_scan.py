"""Secret scan with DataFrame functions only: three base patterns, and two character Markov models.

Base kinds: ``assign`` (a secret's name, a sign, 8 or more value characters), ``access`` (AKIA and more, 16 or more
characters), ``hex`` (32 or more hex digits). The method adds kind ``markov``: a run of 20 or more characters of
A-Z a-z 0-9 + / _ = - that overlaps no base span, where the first-order model of random strings beats the model of
ordinary identifiers by ``THRESHOLD`` nats a transition. Both models are counted from labelled samples (see
``labelled_samples``; ``fit`` takes any), with add-half smoothing over 66 classes; the two count tables are bounded by
the classes, so the driver holds them.

Spans are code points, end exclusive. Java's matcher gives the matches and the texts between them, so a span's start is
the sum of the lengths before it. Nulls: a null text is empty, a null doc_id keeps its row; repeated rows each get a
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_column, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs end where the class ends, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
THRESHOLD = 0.5
SAMPLE_ROWS = 4000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET)
#: Parts of the labelled identifiers.
PARTS = (
    "account address alert apply array async audit author batch binary block branch bridge broker buffer build cache "
    "calendar call category change channel chart check child class client cluster code collect column command commit "
    "common compare config connect content context control convert count create current customer data database date "
    "debug default define delete deploy detail device direct display document domain driver element email enable "
    "encode engine entity entry error event exact example execute export extend factory feature field file filter "
    "find first fixed folder format frame function general generate global graph group handle header health history "
    "image import index input insert instance interface internal invoice item job join journal kernel label language "
    "layer layout ledger length level library limit line link list listener load local location lookup machine main "
    "manager mapping master match measure member memory merge message method metric minimum model module monitor name "
    "network node note notify number object offset option order output owner package page panel parent parse partner "
    "payment pending period person pipeline player point policy position prefix price print process product profile "
    "project property provider public query queue random range rate reader record reference refresh region register "
    "release remote render report request reset resource response result return review role route rule sample schedule "
    "schema scope score screen search section select send sequence server service session setting shape share signal "
    "simple single size source split stack stage standard start state status storage store stream string style subject "
    "summary supplier support switch symbol system table target task template term test text theme thread time title "
    "token tool total trace track transfer transform transition tree trigger type unit update upload user utility value "
    "vector vendor version view virtual visible volume warning watch weight widget window word worker write zone"
).split()


def labelled_samples(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows`` random strings (label true: base64, hex, base62) and as many identifiers (false: snake, camel, kebab, run together, some with a number)."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("random:"), i), 256)
    base64 = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, F.substring(digest, 1, 40)).otherwise(F.regexp_replace(base64, "[+/=]", ""))
    parts = F.array(*[F.lit(p) for p in PARTS])
    word = [F.get(parts, F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(len(PARTS))).cast("int")) for k in range(4)]
    number = F.when(F.col("id") % 5 == 0, F.concat(F.lit("_"), F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string"))).otherwise("")
    kind = F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(4))
    name = F.when(kind == 0, F.concat_ws("_", *word)).when(kind == 1, F.concat(word[0], *[F.initcap(w) for w in word[1:]])).when(kind == 2, F.concat_ws("-", *word)).otherwise(F.concat(*word))
    ids = spark.range(rows)
    return ids.select(F.lit(True).alias("label"), random.alias("text")).unionByName(ids.select(F.lit(False).alias("label"), F.concat(name, number).alias("text")))


def fit(samples: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) at CLASSES * a + b, from rows of (label boolean, text)."""
    chars = samples.where("text is not null").select("label", F.filter(F.split("text", ""), lambda c: F.length(c) > 0).alias("c"))
    pairs = chars.select("label", F.explode(F.expr("transform(sequence(1, greatest(size(c) - 1, 0)), i -> if(i < size(c), concat(c[i - 1], c[i]), null))")).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in ALPHABET:
        rows = [[counts.get((label, a + b), 0) + 0.5 for b in ALPHABET] for label in (True, False)]
        sums = [sum(r) for r in rows]
        out += [math.log(x / sums[0]) - math.log(y / sums[1]) for x, y in zip(*rows, strict=True)]
    return out


def token_score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    place = {ord(c): k for k, c in enumerate(ALPHABET)}
    classes = F.array(*[F.lit(place.get(c, 0)) for c in range(128)])
    table_ = F.lit(ratios)
    numbers = F.transform(F.filter(F.split(token, ""), lambda c: F.length(c) > 0), lambda c: F.get(classes, F.ascii(c)))
    fold = F.aggregate(
        numbers, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table_, acc["last"] * CLASSES + c))).alias("sum")),
        lambda acc: acc["sum"])
    return fold / F.greatest(F.length(token) - 1, F.lit(1))


_SPANS = "array<struct<start:int,kind:int,end:int,token:string>>"


#: Matches of a text that are laid or searched together, so that a text of many costs little more than each of them.
CHUNK = 128


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(array: Column) -> Column:
    """The array in pieces of ``CHUNK``."""
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / CHUNK).cast("int")), lambda k: F.slice(array, k * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.slice(F.array(array), 1, 0))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern in order, as (start, kind, end, token)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("token"))
    length = lambda x: F.length(x["gap"]) + F.length(x["token"])

    def laid(piece: Column, at: Column) -> Column:
        return F.aggregate(
            piece, F.struct(at.alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + length(x)).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + length(x)).alias("end"), x["token"].alias("token")))).alias("out")),
            lambda acc: acc["out"])

    def all_laid(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + length(x)))
        upto = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return _let(upto, lambda at: F.flatten(F.transform(pieces, lambda p, k: laid(p, F.get(at, k)))))

    return F.when(F.size(found) > 0, _let(zipped, lambda z: _let(_chunks(z), all_laid))).otherwise(F.array().cast(_SPANS))


def _clear_of(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no span of ``base``, which is sorted by start: a piece is searched only if it reaches the token."""
    pieces = F.transform(_chunks(base), lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("low"), F.array_max(F.transform(p, lambda x: x["end"])).alias("high"), p.alias("all")))
    meets = lambda t, b, low, high: (b[low] < t["end"]) & (t["start"] < b[high])
    free = lambda t, held: ~F.exists(held, lambda c: meets(t, c, "low", "high") & F.exists(c["all"], lambda b: meets(t, b, "start", "end")))
    return _let(pieces, lambda held: F.filter(tokens, lambda t: free(t, held)))


def secret_spans(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``found``: all spans as (start, kind, end, token), base and markov, in order."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(id_column(), text.alias("text"))
    rows = rows.select("doc_id", *[_spans(F.col("text"), p, k).alias(KINDS[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    assign = F.filter("assign", lambda x: F.length(F.regexp_extract(x["token"], ASSIGN, 1)) >= 8)
    rows = rows.select("doc_id", F.array_sort(F.concat(assign, "access", "hex")).alias("base"), "markov")
    clear = F.filter(_clear_of(F.col("markov"), F.col("base")), lambda t: token_score(t["token"], ratios) >= threshold)
    return rows.select("doc_id", "base", F.when(F.size("markov") > 0, clear).otherwise(F.col("markov")).alias("markov"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def secret_scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts of the base kinds, the digest of the base spans, and all spans as text."""
    ratios = fit(samples if samples is not None else labelled_samples(docs.sparkSession))
    found = secret_spans(docs, ratios, threshold)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "markov"))).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))
