"""Queries of passages, ranking, notes chosen by words, and thread budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as wd
from ..operators import retrieval as rt
from ..operators import sequences as sq
from ..sources import report_views as rv
from ..sources.report_views import with_views
from ..sources.store import built
from .registry import query, table

QUESTION = "What drove the outlook in the segment, and was there a tion and heer of the risk factors?"
TERMS = wd.query_terms(QUESTION)
_TERMS_SQL = "terms AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in TERMS.items()) + ") t(term, weight))"
_BM25 = f"""{_TERMS_SQL}, len_ AS (SELECT id, sum(tf) AS dl FROM v_postings GROUP BY id), avg_ AS (SELECT avg(dl) AS avgdl FROM len_),
dfs AS (SELECT term, count(*) AS df FROM v_postings GROUP BY term),
bm AS (SELECT p.id, sum(t.weight * ln(1 + ((SELECT count(*) FROM v_passages) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM v_postings p JOIN terms t USING (term) JOIN dfs USING (term) JOIN len_ USING (id), avg_ GROUP BY p.id)"""
_BOOST = """bo AS (SELECT b.id, v.section_id, v.seq, v.kind, b.score * CASE WHEN v.kind = 'risk' THEN 1.6 WHEN v.kind IN ('mdna', 'letter', 'strategy', 'business', 'highlights', 'board_report') THEN 1.25 ELSE 1.0 END AS score FROM bm b JOIN v_passages v USING (id))"""
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY score DESC, seq) AS place FROM (SELECT id, section_id, seq, kind, round(score, 6) AS score FROM bo)) WHERE place <= 4 ORDER BY score DESC, seq LIMIT 30)"
_V = with_views("v_postings", "v_passages")


def _scores(spark, d):
    return rt.bm25(built(spark, "bm25-index", d, lambda: rt.index(rv.passages(spark, d)), "bucket"), TERMS)


def _top(spark, d):
    return rt.candidates(rt.boosted(_scores(spark, d), rv.passages(spark, d), QUESTION))


@query("f9_tokens_df", with_views("v_postings") + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM v_postings GROUP BY term")
def f9(spark, d):
    return rt.postings(rv.passages(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("a5_corpus_stats", with_views("v_postings") + "SELECT count(DISTINCT id) AS docs, count(DISTINCT term) AS terms, round(sum(tf) / count(DISTINCT id), 6) AS avgdl FROM v_postings")
def a5(spark, d):
    return rt.postings(rv.passages(spark, d)).agg(F.countDistinct("id").alias("docs"), F.countDistinct("term").alias("terms"), F.round(F.sum("tf") / F.countDistinct("id"), 6).alias("avgdl"))


@query("r1_bm25", f"{_V}, {_BM25} SELECT id, round(score, 6) AS score FROM bm")
def r1(spark, d):
    return _scores(spark, d).select("id", F.round("score", 6).alias("score"))


@query("r3_boosted", f"{_V}, {_BM25}, {_BOOST} SELECT id, kind, round(score, 6) AS score FROM bo")
def r3(spark, d):
    return rt.boosted(_scores(spark, d), rv.passages(spark, d), QUESTION).select("id", "kind", F.round("score", 6).alias("score"))


@query("o1_bm25_top30", f"{_V}, {_BM25}, {_BOOST}, {_TOP} SELECT id, section_id, score FROM top")
def o1(spark, d):
    return _top(spark, d).select("id", "section_id", "score")


@query("o3_keyword_pick", f"{_V}, {_BM25}, {_BOOST}, {_TOP} SELECT id, score FROM top WHERE score >= 0.6 * (SELECT max(score) FROM top) ORDER BY score DESC, seq LIMIT 2")
def o3(spark, d):
    return rt.ahead_of_rest(_top(spark, d), 0.6, 2, F.col("seq")).select("id", "score")


@query("r4_named_sections", f"{_V}, {_BM25}, {_BOOST}, {_TOP} SELECT id, kind FROM top WHERE kind = 'risk' ORDER BY score DESC, seq LIMIT 2")
def r4(spark, d):
    return _top(spark, d).where(F.array_contains(wd.named_kinds(F.lit(QUESTION)), F.col("kind"))).orderBy(F.desc("score"), "seq").limit(2).select("id", "kind")


@query("f12_query_terms", f"WITH {_TERMS_SQL} SELECT term, weight FROM terms")
def f12(spark, d):
    return spark.createDataFrame(sorted(TERMS.items()), "term string, weight double")


@query("f13_named_kinds", """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'risk' WHEN item_id % 3 = 1 THEN 'mdna' END AS named,
CASE WHEN item_id % 3 = 0 THEN 'risk' END AS boosted FROM benchmark""")
def f13(spark, d):
    text = F.when(F.col("item_id") % 3 == 0, "what are the Risk Factors").when(F.col("item_id") % 3 == 1, "in the MD&A of it").otherwise("and so on")
    return table(spark, d, "benchmark").select("item_id", F.get(wd.named_kinds(text), 0).alias("named"), F.get(wd.boosted_kinds(text), 0).alias("boosted"))


@query("f14_kind_of", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'risk' WHEN 1 THEN 'mdna' WHEN 2 THEN 'legal' WHEN 3 THEN 'auditor_report' WHEN 4 THEN 'letter' ELSE 'other' END AS kind FROM part""")
def f14(spark, d):
    title = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'Item 1A. Risk Factors' WHEN 1 THEN 'Management’s Discussion' WHEN 2 THEN 'ITEM 3. Legal Proceedings' WHEN 3 THEN 'Auditor''s Report' WHEN 4 THEN 'From the Chairman' ELSE p_name END")
    return table(spark, d, "part").select("p_partkey", wd.kind_of(title).alias("kind"))


@query("f10_link_words", with_views("v_notes") + r"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '[a-z][a-z''\-]+'),
 lambda w: CASE WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END), lambda w: length(w) > 2))), ' ') AS words FROM v_notes""")
def f10(spark, d):
    return rv.notes(spark, d).select("id", F.array_join(F.array_sort(wd.link_words(F.col("title"))), " ").alias("words"))


@query("f11_question_words", r"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\-]{2,}'),
 lambda w: w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'their', 'its', 'about', 'into', 'over', 'note', 'notes', 'report', 'annual', 'what', 'which', 'how', 'company', 'detail', 'details', 'give', 'related', 'other', 'net', 'total', 'change', 'non', 'main', 'key', 'year', 'years', 'cash', 'flow', 'loss', 'profit', 'asset', 'assets')),
 lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END), lambda w: length(w) > 2))), ' ') AS words
FROM conversations WHERE role = 'user'""")
def f11(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.array_sort(wd.question_words(F.col("text"))), " ").alias("words"))


_NOTE_TEXTS = """texts AS (SELECT id, title, CASE WHEN number % 5 = 0 THEN ['General', 'The Economy at large'] ELSE ['small ringside'] END AS subs, CASE WHEN number % 7 = 0 THEN 'of the Economy' END AS digest FROM v_notes),
sc AS (SELECT id, CAST(3 * (title LIKE '%small ring%')::INT + 3 * (title LIKE '%economy%')::INT + (array_to_string(subs, ' ') LIKE '%small ring%')::INT + (lower(array_to_string(subs, ' ')) LIKE '%economy%' OR coalesce(lower(digest), '') LIKE '%economy%')::INT
  + 2 * (title LIKE '%widget%')::INT + 2 * (title LIKE '%ring%')::INT AS BIGINT) AS score FROM texts),
near AS (SELECT id, score FROM sc WHERE score > 0 AND score >= 0.5 * (SELECT max(score) FROM sc) ORDER BY score DESC, id DESC LIMIT 5)"""


def _note_scores(spark, d):
    subs = F.when(F.col("number") % 5 == 0, F.array(F.lit("General"), F.lit("The Economy at large"))).otherwise(F.array(F.lit("small ringside")))
    notes = rv.notes(spark, d).withColumn("subheadings", subs).withColumn("digest", F.when(F.col("number") % 7 == 0, "of the Economy"))
    return rt.keyword_scores(notes, ["small ring", "economy"], ["widgets", "rings"])


@query("o2_keyword_select", with_views("v_notes") + f", {_NOTE_TEXTS} SELECT id, score FROM near")
def o2(spark, d):
    return rt.ahead_of_rest(_note_scores(spark, d), 0.5, 5, F.desc("id"))


@query("r6_keyword_scores", with_views("v_notes") + f", {_NOTE_TEXTS} SELECT id, score FROM sc WHERE score > 0")
def r6(spark, d):
    return _note_scores(spark, d)


@query("r7_select_notes", with_views("v_notes") + f""", {_NOTE_TEXTS}, hint AS (SELECT id, number AS place FROM v_notes WHERE title LIKE '%e%' ORDER BY number, id LIMIT 2),
picks AS (SELECT id, 0 AS p, number AS place FROM v_notes WHERE number = 17 UNION ALL SELECT id, 1, place FROM hint UNION ALL SELECT id, 2, row_number() OVER (ORDER BY score DESC, id DESC) FROM near)
SELECT id, p AS priority FROM (SELECT id, min(p) AS p, arg_min(place, p) AS place FROM picks GROUP BY id) ORDER BY p, place, id LIMIT 5""")
def r7(spark, d):
    """Notes for a question: those that it names, the two best hints of the statements, then those by keywords."""
    notes = rv.notes(spark, d)
    hints = notes.where("title like '%e%'").select("id", F.struct("number", "id").alias("place")).orderBy("place").limit(2).select("id", "place.number")
    found = rt.select_notes(notes.where("number = 17").select("id", F.col("number").alias("place")), hints.withColumnRenamed("number", "place"), _note_scores(spark, d), 5)
    return found.select("id", F.col("priority").cast("long").alias("priority"))


@query("o7_budget", """SELECT conv_id, array_to_string(f.taken, ',') AS taken FROM (
  SELECT conv_id, list_reduce(list(struct_pack(t := turn, s := length(text)) ORDER BY turn), lambda a, x: CASE WHEN len(a.taken) = 0 OR a.used + x.s <= 1500 THEN struct_pack(used := a.used + x.s, taken := list_append(a.taken, x.t), t := 0::BIGINT, s := 0::BIGINT) ELSE a END,
    struct_pack(used := 0::BIGINT, taken := []::BIGINT[], t := 0::BIGINT, s := 0::BIGINT)) AS f FROM conversations GROUP BY conv_id)""".replace(
    "list(struct_pack(t := turn, s := length(text)) ORDER BY turn)", "list(struct_pack(used := 0::BIGINT, taken := []::BIGINT[], t := turn, s := length(text)) ORDER BY turn)"))
def o7(spark, d):
    turns = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return rt.budget_fill(turns, "conv_id", "turn", "size", "turn", 1500).select("conv_id", F.array_join(F.transform("taken", lambda x: x.cast("string")), ",").alias("taken"))


@query("o8_capped_additions", """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND length(text) <= 400) WHERE n <= 3""")
def o8(spark, d):
    """At most three additions of those that are small enough to add."""
    from pyspark.sql import Window

    small = table(spark, d, "conversations").where((F.col("role") == "user") & (F.length("text") <= 400))
    return small.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 3").select("conv_id", "turn")


@query("o9_merge_lists", """SELECT id, min(priority) AS priority FROM (SELECT p_partkey AS id, 0 AS priority FROM part WHERE p_size > 48 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_retailprice > 1050 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_partkey < 50) GROUP BY id""")
def o9(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"), "p_size", "p_retailprice")
    return rt.merge_ordered(part.where("p_size > 48"), part.where("p_retailprice > 1050"), part.where("id < 50")).select("id", F.col("priority").cast("long").alias("priority"))


@query("w12_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 10")
def w12(spark, d):
    return sq.last_rows(table(spark, d, "conversations"), ["conv_id"], "turn", 10).select("conv_id", "turn", "role")


@query("p10_detect_scope", r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'standalone' WHEN turn % 4 = 1 THEN 'both' ELSE 'consolidated' END AS scope FROM conversations""")
def p10(spark, d):
    """Which statements a question is about: consolidated unless it asks for standalone ones, or for both."""
    q = F.expr("CASE turn % 4 WHEN 0 THEN 'the standalone accounts, not consolidated ones' WHEN 1 THEN 'both standalone and consolidated' WHEN 2 THEN 'consolidated tax' ELSE text END")
    alone = q.rlike(r"(?i)\b(standalone|stand-alone|unconsolidated)\b")
    rest = F.regexp_replace(q, r"(?i)\b(?:not|non|un)[\s-]*consolidated\b", "")
    scope = F.when(alone & (rest.rlike(r"(?i)\bconsolidated\b") | q.rlike(r"(?i)\bboth\b")), "both").when(alone, "standalone").otherwise("consolidated")
    return table(spark, d, "conversations").select("conv_id", "turn", scope.alias("scope"))


@query("p12_explicit_refs", r"""SELECT DISTINCT conv_id, turn, 'C' || n AS id FROM (SELECT conv_id, turn, turn % 5 + 1 AS n FROM conversations UNION ALL SELECT conv_id, turn, 17 FROM conversations WHERE turn % 2 = 0)""")
def p12(spark, d):
    """Notes that a question names, each once, if the report has them."""
    q = F.concat(F.lit("see Note "), (F.col("turn") % 5 + 1).cast("string"), F.when(F.col("turn") % 2 == 0, " and note no. 17, note 999").otherwise(""))
    numbers = F.regexp_extract_all(q, F.lit(r"(?i)\bnote\s*(?:no\.?|number|#)?\s*([0-9]{1,3})\b"), F.lit(1))
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(numbers)).alias("n"))
    known = rv.notes(spark, d).where("section_id = 'consolidated'").select("id")
    return asked.select("conv_id", "turn", F.concat(F.lit("C"), F.col("n").cast("int").cast("string")).alias("id")).join(F.broadcast(known), "id", "left_semi").select("conv_id", "turn", "id")


@query("p16_prefer_specific", """SELECT c_custkey AS id FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_custkey % 10 <> 0 AND x.c_acctbal > 5000 AND c.c_custkey % 10 = 0 AND x.c_custkey // 10 = c.c_custkey // 10) AND (c_custkey % 10 = 0 OR c_acctbal > 5000)""")
def p16(spark, d):
    """Chosen units without those that a chosen part stands for: an anti-join on the parent."""
    chosen = table(spark, d, "customer").where("c_custkey % 10 = 0 OR c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.floor(F.col("c_custkey") / 10) * 10).alias("parent"))
    parents = chosen.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    return chosen.select("id").join(parents, "id", "left_anti")


@query("f19_snippet", r"""SELECT doc_id, arg_max(sentence, struct_pack(n := n, p := -pos)) AS sentence, max(n) AS words FROM (
  SELECT doc_id, pos, trim(sentence) AS sentence, len(list_filter(list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')), lambda w: w IN ('the', 'tion', 'and', 'heer'))) AS n
  FROM (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(10), ' '), '[.!?] +') AS s FROM documents))) WHERE n > 0 GROUP BY doc_id""")
def f19(spark, d):
    """The sentence with most of the asked words, the first of equals."""
    asked = F.array(*[F.lit(w) for w in ("the", "tion", "and", "heer")])
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), "[.!?] +")).alias("pos", "sentence"))
    n = F.size(F.array_intersect(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), F.lit(0)), asked)).cast("long")
    return cut.select("doc_id", "pos", F.trim("sentence").alias("sentence"), n.alias("n")).where("n > 0").groupBy("doc_id").agg(F.max_by("sentence", F.struct("n", -F.col("pos"))).alias("sentence"), F.max("n").alias("words"))
