"""Structure of a report from its lines: statement pages, note headings, section maps, tables, views and quality facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import accepted_steps, gap_clusters, keep_first, runs

# How notes begin, what tells formats apart, browser marks of a page, and the names of bold fonts.
NOTES_HEADERS = tuple((kind.lower(), f"notes {link} {kind.lower()} financial statements") for kind in ("Consolidated", "Standalone") for link in ("to", "forming part of the", "to the"))
SCHEDULE_LINE = r"(?im)^\s*schedule\s*[‘’'`´\"\ufffd]?\s*(?:[A-Z]{1,2}|[0-9]{1,2}|[IVXL]{1,5})\s*[‘’'`´\"\ufffd]?\s*(?:[:.\-–]|$)"
FORMING_PART = r"(?i)forming\s+part\s+of\s+the\s+(?:balance\s+sheet|profit\s*(?:and|&)\s*loss\s+account|accounts)"
FORM_10K = r"\bFORM\s+10-K\b"
PAGE_CHROME = r"(?i)^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4},?\s+[0-9]{1,2}:[0-9]{2}\s*[AP]M\b|^Table of Contents$"
PAGE_URL = "^https?://"
BOLD_FONTS = "Bold|Black|Heavy|Semibold|SemiBold|Demi"
LEAST_SIGNALS, COVER_PAGES, ROWS_ABOVE_HEADER = 3, 5, 4


def notes_section(text: Column, *more: tuple[str, str]) -> Column:
    """Section whose notes a page's text heads, by the first phrase in order; ``more`` are (section, phrase) of a profile. Null if none."""
    plain = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(*[F.when(plain.contains(phrase.lower()), F.lit(section)) for section, phrase in (*NOTES_HEADERS, *more)])


def report_format(pages: DataFrame) -> DataFrame:
    """(report, format and its four signals): notes on three pages make it modern (a 10-K if the cover says so), else schedules make it legacy. Takes (report, page from 1, text)."""
    signals = {
        "modern_notes_pages": F.count_if(notes_section(F.col("text")).isNotNull()),
        "schedule_headings": F.sum(F.regexp_count("text", F.lit(SCHEDULE_LINE))),
        "forming_part_pages": F.count_if(F.col("text").rlike(FORMING_PART)),
        "form_10k_cover": F.count_if((F.col("page") <= COVER_PAGES) & F.col("text").rlike(FORM_10K)),
    }
    held = pages.groupBy("report").agg(*[c.cast("long").alias(n) for n, c in signals.items()])
    modern, legacy = F.col("modern_notes_pages") >= LEAST_SIGNALS, F.greatest("schedule_headings", "forming_part_pages") >= LEAST_SIGNALS
    return held.withColumn("format", F.when(modern & (F.col("form_10k_cover") > 0), "us-10k").when(~modern & legacy, "legacy").otherwise("modern"))


def header_row(rows: DataFrame, header: str) -> DataFrame:
    """(page, position, text): the first row of a page's top fifth that holds ``header``, at most four rows above it. Takes (page, y0, x0, text, height)."""
    position = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0")) - 1
    near = rows.withColumn("position", position).where((F.col("position") <= ROWS_ABOVE_HEADER) & (F.col("y0") <= F.col("height") * 0.2) & F.lower("text").contains(header.lower()))
    return near.groupBy("page").agg(F.min("position").alias("position"), F.min_by("text", "position").alias("text"))


def page_bounds(rows: DataFrame) -> DataFrame:
    """(page, top, bottom, body_top) without what a browser prints: date lines in the top eighth, the URL at the bottom. Takes (page, y0, y1, text, height)."""
    chrome = (F.col("y0") < F.col("height") * 0.12) & F.col("text").rlike(PAGE_CHROME)
    footer = (F.col("y0") > F.col("height") * 0.85) & F.col("text").rlike(PAGE_URL)
    ends = rows.groupBy("page").agg(F.greatest(F.min("y0"), F.max(F.when(chrome, F.col("y1")))).alias("top"), F.least(F.max("y1") + 0.5, F.min(F.when(footer, F.col("y0")))).alias("low"))
    ends = ends.select("page", "top", (F.col("low") - 0.5).alias("bottom"))
    inside = (F.col("y0") > F.col("top") + 0.5) & (F.col("y1") < F.col("bottom"))
    return rows.join(ends, "page").groupBy("page", "top", "bottom").agg(F.coalesce(F.min(F.when(inside, F.col("y0"))), F.col("top")).alias("body_top"))


def is_capitals(text: Column) -> Column:
    """Four letters or more, nine tenths of them capitals."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (letters >= 4) & (F.regexp_count(text, F.lit(r"\p{Lu}")) >= 0.9 * letters)


def is_bold(flags: Column, font: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | font.rlike(BOLD_FONTS)


def is_monospaced(font: Column) -> Column:
    """Of a page's rows (an aggregate): nine tenths in a typewriter font."""
    return F.count_if(F.lower(font).rlike("courier|mono")) >= 0.9 * F.count("*")


def gap_lines(gaps: DataFrame) -> DataFrame:
    """(feature, line): the gaps as rows of a Markdown table."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    return gaps.select("feature", F.concat(F.lit("| "), "feature", F.lit(" | "), cell("own"), F.lit(" | "), cell("other"), F.lit(" |")).alias("line"))


def dominant(rows: DataFrame, group: list[str], feature: str, least: int = 3, share: float = 0.2) -> DataFrame:
    """Rows whose feature is frequent in its group: at least ``least`` and ``share`` of the most frequent one."""
    counted = rows.groupBy(*group, feature).agg(F.count("*").alias("_n"))
    kept = counted.withColumn("_top", F.max("_n").over(Window.partitionBy(*group))).where(F.col("_n") >= F.greatest(F.lit(least), F.col("_top") * share))
    return rows.join(kept.select(*group, feature), [*group, feature], "left_semi")


def note_index(lines: DataFrame, group: str, step: int = 4) -> DataFrame:
    """(group, accepted): numbers of the headings in a dominant style, in their order, as far as they go up by small steps. Takes (group, seq, style, number)."""
    return accepted_steps(dominant(lines, [group], "style"), group, "seq", "number", step)


def statement_groups(pages: DataFrame, group: list[str], reach: int = 15) -> DataFrame:
    """Runs of pages of one statement before the notes begin, at most ``reach`` pages before. Takes (group, page, kind, notes_page)."""
    near = pages.where((F.col("page") < F.col("notes_page")) & (F.col("page") >= F.col("notes_page") - reach))
    return runs(near.select(*group, "page", "kind"), group, "page", "kind", 1)


def section_map(entries: DataFrame, group: str) -> DataFrame:
    """Entries of the first source that has any: bookmarks, contents, headers, items, headings. Takes (group, source, place, title); ``source`` is its rank."""
    first = entries.groupBy(group).agg(F.min("source").alias("source"))
    return entries.join(first, [group, "source"])


def aligned_table(cells: DataFrame, table: list[str], gap: float) -> DataFrame:
    """(table, row, cells): cells in columns by their right edges, a column being edges at most ``gap`` apart; an empty place is "". Takes (table, row, edge, text)."""
    placed = gap_clusters(cells, table, "edge", gap)
    width = placed.groupBy(*table).agg(F.max("cluster").alias("_last"))
    held = placed.groupBy(*table, "row").agg(F.map_from_entries(F.collect_set(F.struct("cluster", "text"))).alias("_m")).join(width, table)
    return held.select(*table, "row", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_last").cast("bigint")), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(""))).alias("cells"))


def nested_view(lines: DataFrame, unit: list[str], order: str, *columns: str) -> DataFrame:
    """One row a unit with its lines as an ordered array of structs."""
    return lines.groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("lines"))


def markers(lines: DataFrame, group: list[str], pattern: str, order: str) -> DataFrame:
    """First line of each distinct marker (upper-cased first group of ``pattern``) of a group."""
    found = lines.withColumn("marker", F.upper(F.regexp_extract("text", pattern, 1))).where("marker != ''")
    return keep_first(found, [*group, "marker"], F.col(order))


def pitch_columns(text: Column) -> Column:
    """Columns of a fixed-pitch line: parts set two or more blanks apart."""
    return F.filter(F.split(F.trim(text), " {2,}"), lambda p: p != "")


def quality_facts(documents: DataFrame, facts: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """One row a report: named facts, and the names of the warnings that hold."""
    held = documents.groupBy("report").agg(*[c.alias(n) for n, c in facts.items()])
    raised = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in warnings.items()]), lambda x: x.isNotNull())
    return held.withColumn("warnings", F.array_join(raised, ","))


def feature_gaps(report: DataFrame, model: DataFrame) -> DataFrame:
    """(feature, own, other) of the features in which a report and a model differ; a missing one differs from any."""
    a, b = report.select("feature", F.col("value").alias("own")), model.select("feature", F.col("value").alias("other"))
    return a.join(b, "feature", "full").where(~F.col("own").eqNullSafe(F.col("other")))
