"""Report tables derived from the driver's tables: statement lines and values, notes and their figures, blocks, passages.

An order is a statement, its line items are lines, their measures are printed figures; the first parts are notes, which
print some of the figures; documents cut at line feeds are blocks. ``SQL`` has the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import built

NOTES = 40


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """id, section_id, unit_id, seq, pdf_page, label, note_ref, and the measures behind the values."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # Names come first and the order last, so that what follows an order's lines finds them dealt by order; a line without a part still counts.
    names = _t(spark, d, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("_names"))
    # Lines are sent with what they say and no more: whole hundredths and years are shorter than doubles and times.
    own = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", F.round(F.col("l_discount") * 100).cast("long").alias("discount"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"), F.year("l_shipdate").cast("long").alias("year"),
    )
    items = own.join(names, F.col("l_partkey") == F.col("p_partkey"), "left").withColumn("seq", F.row_number().over(order).cast("long"))
    items = items.select("*", F.inline("_names"))
    number = (F.col("l_partkey") % NOTES + 1).cast("string")
    ref = F.when(F.col("l_partkey") % 4 == 0, number).when(F.col("l_partkey") % 4 == 1, F.concat(number, F.lit("(a)"))).when(F.col("l_partkey") % 4 == 2, F.lit("")).otherwise(F.lit(None))
    unit = F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))
    return items.select(
        F.concat(unit, F.lit("-L"), F.lpad(F.col("seq").cast("string"), 3, "0")).alias("id"),
        F.when(F.col("l_orderkey") % 2 == 0, "consolidated").otherwise("standalone").alias("section_id"),
        unit.alias("unit_id"), "seq", (F.col("l_orderkey") % 400 + 1).alias("pdf_page"), F.col("p_name").alias("label"), ref.alias("note_ref"),
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "discount", "tax", "year",
    )


def held_lines(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    """``lines``, numbered once and kept dealt by order; ``plain`` for those who deal them themselves."""
    return built(spark, "lines", d, lambda: lines(spark, d), deal="order_id", plain=plain)


def values(spark: SparkSession, d: str, own: DataFrame | None = None, *keep: str) -> DataFrame:
    """line_id, col, heading and raw: four printed figures a line. They keep the columns ``keep`` of their line, so that no join brings those back."""
    price = F.format_number(F.col("cents") / 100, 2)
    cut = F.floor(F.col("cents") * F.col("discount") / 100)
    year = F.col("year").cast("string")
    cell = lambda col, heading, raw: F.struct(F.lit(col).cast("long").alias("col"), heading.alias("heading"), raw.alias("raw"))
    cells = F.array(
        cell(0, F.lit("Units"), F.col("quantity").cast("string")),
        cell(1, F.concat(F.lit("Year ended March 31, "), year), F.concat(F.lit("Rs. "), price)),
        cell(2, F.concat(F.lit("FY "), year), F.when(cut == 0, F.lit("—")).otherwise(F.concat(F.lit("("), F.format_number(cut / 100, 2), F.lit(")")))),
        cell(3, F.concat(F.lit("31st December, "), year), F.when(F.col("tax") == 0, F.lit("-")).otherwise(F.concat(F.col("tax").cast("string"), F.lit("%")))),
    )
    return (lines(spark, d) if own is None else own).select(F.col("id").alias("line_id"), *keep, F.inline(cells))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """section_id, id, number and title of the notes of both sections."""
    part = _t(spark, d, "part").where(F.col("p_partkey").between(1, NOTES))
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_name"))
    base = part.select(F.col("p_partkey").alias("number"), title.alias("title"))
    section = F.explode(F.array(F.lit("consolidated"), F.lit("standalone"))).alias("section_id")
    return base.select(section, "number", "title").select("section_id", F.concat(F.when(F.col("section_id") == "consolidated", "C").otherwise("S"), F.col("number").cast("string")).alias("id"), "number", "title")


def note_figures(spark: SparkSession, d: str, own: DataFrame | None = None) -> DataFrame:
    """section_id, note_id, raw: figures printed in the notes, the prices of all lines."""
    own = lines(spark, d) if own is None else own
    number = F.col("part_id") % NOTES + 1
    return own.select("section_id", F.concat(F.when(F.col("section_id") == "consolidated", "C").otherwise("S"), number.cast("string")).alias("note_id"), F.format_number(F.col("cents") / 100, 2).alias("raw"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, seq and text of the lines of each document."""
    return _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).select("doc_id", F.col("seq").cast("long").alias("seq"), "text")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """id, section_id, seq, path, kind, text and chars: a document is a passage of its source."""
    kinds = F.array(*[F.lit(k) for k in ("mdna", "risk", "business", "letter", "other")])
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("section_id"), F.col("doc_id").alias("seq"), F.concat("source", F.lit(" › "), "lang").alias("path"), F.get(kinds, (F.col("doc_id") % 5).cast("int")).alias("kind"), "text", F.length("text").cast("long").alias("chars"))


#: The same views for DuckDB; a view may use those above it.
SQL = {
    "v_lines": """
        SELECT 'O' || l_orderkey || '-L' || lpad(CAST(seq AS VARCHAR), 3, '0') AS id,
               CASE WHEN l_orderkey % 2 = 0 THEN 'consolidated' ELSE 'standalone' END AS section_id,
               'O' || l_orderkey AS unit_id, seq, l_orderkey % 400 + 1 AS pdf_page, p_name AS label,
               CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey % 40 + 1 AS VARCHAR) WHEN 1 THEN (l_partkey % 40 + 1) || '(a)' WHEN 2 THEN '' END AS note_ref,
               l_orderkey AS order_id, l_partkey AS part_id, CAST(l_quantity AS BIGINT) AS quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS discount,
               CAST(round(l_tax * 100) AS BIGINT) AS tax, year(l_shipdate) AS year
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem)
        JOIN part ON l_partkey = p_partkey""",
    "v_values": """
        SELECT id AS line_id, CAST(0 AS BIGINT) AS col, 'Units' AS heading, CAST(quantity AS VARCHAR) AS raw FROM v_lines
        UNION ALL SELECT id, 1, 'Year ended March 31, ' || year, 'Rs. ' || format('{:,.2f}', cents / 100.0) FROM v_lines
        UNION ALL SELECT id, 2, 'FY ' || year, CASE WHEN cents * discount // 100 = 0 THEN '—' ELSE '(' || format('{:,.2f}', (cents * discount // 100) / 100.0) || ')' END FROM v_lines
        UNION ALL SELECT id, 3, '31st December, ' || year, CASE WHEN tax = 0 THEN '-' ELSE tax || '%' END FROM v_lines""",
    "v_notes": """
        SELECT s.section_id, CASE WHEN s.section_id = 'consolidated' THEN 'C' ELSE 'S' END || p_partkey AS id, p_partkey AS number,
               CASE WHEN p_partkey % 2 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name END AS title
        FROM part, (VALUES ('consolidated'), ('standalone')) s(section_id) WHERE p_partkey BETWEEN 1 AND 40""",
    "v_note_figures": """
        SELECT section_id, CASE WHEN section_id = 'consolidated' THEN 'C' ELSE 'S' END || (part_id % 40 + 1) AS note_id, format('{:,.2f}', cents / 100.0) AS raw
        FROM v_lines""",
    "v_blocks": """
        SELECT doc_id, i - 1 AS seq, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))""",
    "v_passages": """
        SELECT doc_id AS id, source AS section_id, doc_id AS seq, source || ' › ' || lang AS path,
               ['mdna', 'risk', 'business', 'letter', 'other'][doc_id % 5 + 1] AS kind, text, length(text) AS chars FROM documents""",
    # Value and nil of each printed figure.
    "v_parsed": r"""
        SELECT line_id, col, heading, raw,
               CASE WHEN nil THEN 0.0 WHEN negative THEN -size ELSE size END AS value, nil
        FROM (
          SELECT *, CASE WHEN whole <> '' OR part <> '' THEN TRY_CAST(CASE WHEN replace(whole, ',', '') = '' THEN '0' ELSE replace(whole, ',', '') END || part AS DOUBLE) END AS size
          FROM (
            SELECT *, regexp_extract(core, '^([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+|)(\.[0-9]+)?$', 1) AS whole,
                   regexp_extract(core, '^([0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3}|[0-9]+|)(\.[0-9]+)?$', 2) AS part
            FROM (
              SELECT *, replace(regexp_replace(trim(regexp_replace(inner2, '^(?:Rs\.?|INR|US\$|\$|₹|`)\s*|\s*(?:Rs\.?|₹)$', '', 'g')), '%+$', ''), ' ', '') AS core
              FROM (
                SELECT *, CASE WHEN regexp_matches(inner1, '^[-–−]') THEN trim(substr(inner1, 2)) ELSE inner1 END AS inner2,
                       (text LIKE '(%)' AND length(text) > 1) OR regexp_matches(inner1, '^[-–−]') AS negative
                FROM (
                  SELECT *, CASE WHEN text LIKE '(%)' THEN trim(substr(text, 2, length(text) - 2)) ELSE text END AS inner1,
                         regexp_matches(text, '^(?:[-–—−]{1,2}|[Nn][Ii][Ll])$') AS nil
                  FROM (SELECT *, trim(regexp_replace(trim(raw), '^(?:Rs\.?|INR|US\$|\$|₹|`)\s*|\s*(?:Rs\.?|₹)$', '', 'g')) AS text FROM v_values))))))""",
    "v_tokens": """
        SELECT id, section_id, kind, CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y'
               WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS term, weight
        FROM (SELECT id, section_id, kind, unnest(regexp_extract_all(replace(replace(lower(text), '’', ''''), '''s', ''), '[a-z0-9]+')) AS w, 1 AS weight FROM v_passages
              UNION ALL SELECT id, section_id, kind, unnest(regexp_extract_all(lower(path), '[a-z0-9]+')), 3 FROM v_passages)
        WHERE w NOT IN ({stopwords})""",
    "v_postings": "SELECT id, term, sum(weight) AS tf FROM v_tokens GROUP BY id, term",
}


def with_views(*names: str) -> str:
    """A WITH clause of the named views and those they use, in order."""
    from ..functions.words import RETRIEVAL_STOPWORDS

    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in SQL:
                if other != name and other in SQL[name]:
                    add(other)

    for n in names:
        add(n)
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in RETRIEVAL_STOPWORDS)
    body = ", ".join(f"{n} AS ({s.replace('{stopwords}', words).strip()})" for n, s in SQL.items() if n in wanted)
    return f"WITH {body} "
