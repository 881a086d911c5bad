"""Queries of the section map: found from contents, bookmarks and running headers of reports that hold the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections as sc
from ..sources import section_views as sv
from ..sources.store import built
from .registry import query


def _map(spark, d):
    """The section map of all reports, built once."""

    def build():
        # Dealt by report once; windows, groups and joins on the report follow without another exchange.
        own = built(spark, "report-sections", d, lambda: sv.sections(spark, d)).repartition("report")
        counts, finder = sv.counts(own), sc.PageFinder(sv.labels(own))
        segments, sizes = sv.contents_pages(own)
        runs = sc.header_runs(sv.headers(own)).select("report", F.col("first").alias("ord"), "title", F.col("first").alias("start"), F.lit(None).cast("string").alias("grp"))
        return sc.section_map(counts, bookmarks=sc.bookmark_entries(sv.bookmarks(own)), contents=sc.contents_entries(segments, sizes, finder, counts), running_header=runs)

    return built(spark, "section-map", d, build)


@query("d11_report_sections", "WITH " + sv.SQL + " SELECT n.report, n.seq, n.id, CASE WHEN n.grp IS NOT NULL THEN 'N-' || replace(upper(n.grp), ' ', '-') END AS parent_id, n.title, n.level, n.start AS start_page, n.stop AS end_page, n.source FROM n")
def section_map(spark, d):
    """Sections of every report with their pages, groups and source."""
    return _map(spark, d).drop("kind")


@query("d11_cover", "WITH " + sv.SQL + " SELECT report, any_value(page_count) AS pages, true AS once, CASE WHEN count(grp) > 0 THEN 2 ELSE 1 END AS depth FROM e GROUP BY report")
def covered_once(spark, d):
    """Each page of a report is in one section, and sections are two deep at most."""
    own = built(spark, "report-sections", d, lambda: sv.sections(spark, d))
    return sc.cover(_map(spark, d), sv.counts(own))


@query("d11_printed_pages", "WITH " + sv.SQL + " SELECT report, k, start AS page FROM s")
def printed_pages(spark, d):
    """Printed numbers as pages: borne by the page, else by the offset that most feet share."""
    own = built(spark, "report-sections", d, lambda: sv.sections(spark, d))
    entries = own.select("report", "k", F.concat(F.lit("0"), (F.col("start") - sv.SHIFT).cast("string"), F.lit(" - 999")).alias("printed"))
    return sc.PageFinder(sv.labels(own)).pages(entries).select("report", "k", F.col("start").alias("page"))
