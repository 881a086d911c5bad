"""The section map of many reports at once: which pages form which section, from the first source that says so.

Sources in the order of trust: ``bookmark_entries``, ``contents_entries`` (the printed contents, over one page or more), ``header_runs``
(titles at the top of the pages), ``item_headings`` and ``heading_entries`` (large bold lines). Each gives entries (report, ord, title,
start, grp); ``section_map`` takes for each report the first source with entries, puts the pages before them under front matter, lets a
section end where the next one begins, and groups those of one heading. A page of the contents is paired with its printed numbers by
position; printed numbers become pages by the page that bears them, else by the offset that most pages share (``PageFinder``).

All is keyed by report; windows, joins and folds over one page or one report do the work. Segments are those of ``layout`` with (report,
page) in front. Rows with a null report or page are left out; a report without entries has no sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import words as wd
from .sequences import keep_first

# What a contents title, a page number, a leader line and an item heading look like; pages searched, entries needed.
CONTENTS_TITLE = r"(?i)^(?:.*\bindex to form\b.*|(?:table of )?contents|index)$"
PAGE_NUMBER = r"^(?:[A-Z]-)?\d{1,3}(?:\s*[-–]\s*\d{1,3})?$"
LEADING_NUMBER = r"^(\d{1,3})\s+(\D.*)$"
LEADER_LINE = r"^(.*?\S)\s*(?:\.\s*){3,}\s*((?:[A-Z]-)?\d{1,3}(?:\s*[-–]\s*\d{1,3})?)$"
NUMBERED_TITLE = r"^(\d{1,2})\.(\d{1,2})?\s"
ITEM_HEADING = r"(?i)^ITEM\s+(\d{1,2}[A-C]?)\.\s*(.*)$"
TITLE_ENDS = r"[\s.,;:·…]+$"
SEARCHED_PAGES, LEAST_ENTRIES, LEADERS = 15, 5, 5
SOURCES = ("bookmarks", "contents", "running_header", "item_heading", "heading")

_PAGE = ["report", "page"]


def title_words(title: Column) -> Column:
    plain = F.replace(F.replace(F.lower(title), F.lit("&"), F.lit(" and ")), F.lit("’"), F.lit("'"))
    return F.filter(F.split(F.regexp_replace(plain, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def same_title(a: Column, b: Column) -> Column:
    """Equal words; or two words or more of one within the other; or three fifths of all words in common."""
    x, y = title_words(a), title_words(b)
    s, t = F.array_join(x, " "), F.array_join(y, " ")
    within = lambda p, n, q: (n >= 2) & F.contains(F.concat(F.lit(" "), q, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))
    shorter = F.when(F.length(s) <= F.length(t), within(s, F.size(x), t)).otherwise(within(t, F.size(y), s))
    share = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return (s != "") & (t != "") & ((s == t) | shorter | (share >= 0.6))


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, TITLE_ENDS, ""))


# ---------------------------------------------------------------- printed numbers


def _bare(label: Column) -> Column:
    """A printed number without zeros in front."""
    cut = F.regexp_replace(label, "^0+", "")
    return F.when((cut == "") & (label != ""), "0").otherwise(cut)


class PageFinder:
    """Pages of printed numbers. Takes ``labels`` (report, page, printed, footer): the label of a page, and the number read at its foot.

    The offset of a report is that of most feet, else of most labels (of equals the first seen). A page bears a number by its label, the
    first of equals; a foot counts if it agrees with the offset, and before a label.
    """

    def __init__(self, labels: DataFrame):
        labels = labels.where("report is not null and page is not null")
        feet = labels.where(F.col("footer").rlike(r"^\d+$")).select("report", "page", F.col("footer").cast("int").cast("string").alias("key"))
        said = labels.where("printed is not null and printed <> ''").select("report", "page", _bare(F.col("printed")).alias("key"))
        steps = feet.withColumn("rank", F.lit(0)).unionByName(said.where(F.col("key").rlike(r"^\d+$")).withColumn("rank", F.lit(1)))
        steps = steps.groupBy("report", "rank", (F.col("page") - F.col("key").cast("int")).alias("offset")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
        self.offsets = keep_first(steps, ["report"], F.col("rank"), F.desc("n"), F.col("first")).select("report", "offset")
        agreed = feet.join(self.offsets, "report").where("page - cast(key as int) = offset").select("report", "page", "key", F.lit(0).alias("rank"))
        borne = agreed.unionByName(said.withColumn("rank", F.lit(1)))
        order = [F.col("rank"), F.when(F.col("rank") == 0, -F.col("page")).otherwise(F.col("page"))]
        self.exact = keep_first(borne, ["report", "key"], *order).select("report", "key", F.col("page").alias("exact"))

    def pages(self, entries: DataFrame) -> DataFrame:
        """Adds ``start``, the page of ``printed``; null where it is neither borne nor a number."""
        first = F.trim(F.regexp_extract("printed", r"^([^-–]*)", 1))
        key = _bare(F.when(F.trim("printed").rlike(r"^[A-Z]-\d+$"), F.trim("printed")).otherwise(first))
        found = entries.withColumn("key", key).join(self.exact, ["report", "key"], "left").join(self.offsets, "report", "left")
        counted = F.when(F.col("key").rlike(r"^\d+$"), F.col("key").cast("int") + F.coalesce("offset", F.lit(0)))
        return found.withColumn("start", F.coalesce("exact", counted).cast("long")).drop("key", "exact", "offset")


# ---------------------------------------------------------------- the contents


def _split_numbers(segments: DataFrame) -> DataFrame:
    """Numbers printed close to their title as segments of their own; ``pair`` joins a leader's two sides."""
    leader, front = F.col("t").rlike(LEADER_LINE), F.col("t").rlike(LEADING_NUMBER)
    piece = lambda k, x0, x1, t, pair: F.struct(F.lit(k).alias("k"), x0.alias("x0"), x1.alias("x1"), t.alias("t"), pair.alias("pair"))
    x0, x1, size, t, none = F.col("x0"), F.col("x1"), F.col("size"), F.col("t"), F.lit(None).cast("long")
    left, number = F.regexp_extract(t, LEADER_LINE, 1), F.regexp_extract(t, LEADER_LINE, 2)
    ahead, rest = F.regexp_extract(t, LEADING_NUMBER, 1), F.regexp_extract(t, LEADING_NUMBER, 2)
    middle = x0 + 0.55 * size * F.length(ahead)
    pieces = (
        F.when(leader, F.array(piece(0, x0, x0 + 0.5 * size * F.length(left), left, F.col("seg")), piece(1, x1 - 0.55 * size * F.length(number), x1, number, F.col("seg"))))
        .when(front, F.array(piece(0, x0, middle, ahead, none), piece(1, middle + 4, x1, rest, none)))
        .otherwise(F.array(piece(0, x0, x1, t, none)))
    )
    return segments.withColumn("leader", leader).withColumn("p", F.explode(pieces)).select(*_PAGE, "seg", "p.k", "p.x0", "y0", "p.x1", "y1", "p.t", "size", "bold", "p.pair", "leader", "height")


_ENTRY = "struct<title:string,printed:string,x0:double,y0:double,y1:double,size:double>"


def parse_contents(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """(report, page, titled, n, title, printed, grp): entries of the pages that read as contents, in order; ``titled`` if a contents title is on the page.

    A number belongs to the text right of it ("06  About the report"), or on pages where numbers come last to the text left of it, or
    to the text before its leader. A line without a number continues the title above it; a larger line, or a bold one in capitals, heads
    a group. Fewer than ``LEAST_ENTRIES`` entries are none. ``pages`` has (report, page, height).
    """
    page = Window.partitionBy(*_PAGE)
    parts = _split_numbers(segments.join(pages.select(*_PAGE, "height"), _PAGE))
    parts = parts.withColumn("leaders", F.size(F.collect_set(F.when(F.col("leader"), F.col("seg"))).over(page)))
    order = F.struct("seg", "k")
    is_title = F.trim("t").rlike(CONTENTS_TITLE) & ((F.col("y0") < 0.35 * F.col("height")) | (F.col("leaders") >= LEADERS))
    first = F.min(F.when(is_title, order)).over(page)
    parts = parts.withColumn("_title", first).withColumn("top", F.min(F.when(order == F.col("_title"), F.col("y0"))).over(page))
    parts = parts.where(F.col("_title").isNull() | (order != F.col("_title"))).where(F.col("top").isNull() | (F.col("leaders") < LEADERS) | (F.col("y0") >= F.col("top")))
    parts = parts.withColumn("titled", F.col("top").isNotNull()).withColumn("number", F.col("t").rlike(PAGE_NUMBER))
    sizes = F.array_sort(F.collect_list("size").over(page))
    parts = parts.withColumn("median", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))
    # A page holds its numbers and its texts, and each text meets the numbers of its page there.
    place, number = ("seg", "k", "x0", "y0", "x1", "y1", "t", "size", "pair"), F.col("number")
    held = parts.groupBy(*_PAGE).agg(
        F.collect_list(F.when(number, F.struct(*place))).alias("numbers"), F.collect_list(F.when(~number, F.struct(*place, "bold", "median"))).alias("texts"),
        F.first("titled").alias("titled"), F.first("leaders").alias("leaders"),
    )
    of_pair = lambda t, n: t["pair"].isNotNull() & n["pair"].eqNullSafe(t["pair"])
    same_line = lambda t, n: (F.abs((t["y0"] + t["y1"]) / 2 - (n["y0"] + n["y1"]) / 2) <= 0.6 * F.greatest(t["size"], n["size"])) | of_pair(t, n)
    # Numbers come first on a page where half of them have a text close behind.
    led = F.filter("numbers", lambda n: F.exists("texts", lambda t: (t["x0"] - n["x1"]).between(0, 60) & same_line(t, n)))
    held = held.where(F.size("numbers") > 0).withColumn("numbers_first", F.size(led) * 2 >= F.size("numbers"))

    def beside(t: Column) -> Column:
        """The nearest number that a text may belong to, with its distance; of equals the first."""
        plain = lambda n: n["pair"].isNull() & t["pair"].isNull() & same_line(t, n)
        behind = lambda n: plain(n) & F.col("numbers_first") & (t["x0"] >= n["x1"])
        before = lambda n: plain(n) & ~F.col("numbers_first") & (t["x1"] < n["x0"])
        away = lambda n: F.when(of_pair(t, n), -1.0).when(behind(n), t["x0"] - n["x1"]).when(before(n), n["x0"] - t["x1"])
        near = F.transform("numbers", lambda n: F.struct(away(n).alias("away"), n["seg"].alias("seg"), n["k"].alias("k"), n["x1"].alias("x1"), n["t"].alias("t"), n["pair"].alias("pair")))
        return F.array_min(F.filter(near, lambda n: n["away"].isNotNull()))

    texts = held.select(*_PAGE, "titled", "leaders", "numbers_first", F.inline_outer(F.transform("texts", lambda t: F.struct(t.alias("x"), beside(t).alias("of"))))).where("x is not null")
    texts = texts.select(*_PAGE, "titled", "leaders", "numbers_first", "x.*", F.col("of.seg").alias("n_seg"), F.col("of.k").alias("n_k"), F.col("of.x1").alias("n_x1"), F.col("of.t").alias("n_t"), F.col("of.pair").alias("n_pair"))
    # Behind a number the first text is near, and the others follow with small gaps.
    along = Window.partitionBy(*_PAGE, "n_seg", "n_k").orderBy("x0", "seg", "k")
    gap = F.col("x0") - F.coalesce(F.lag("x1").over(along), F.col("n_x1"))
    far = F.when(F.col("numbers_first") & F.col("n_pair").isNull() & (gap >= F.when(F.row_number().over(along) == 1, 60.001).otherwise(40.0)), 1).otherwise(0)
    texts = texts.withColumn("_far", far).withColumn("_far", F.sum("_far").over(along)).withColumn("chosen", F.col("n_seg").isNotNull() & (F.col("_far") == 0))
    own = lambda value: F.when(F.col("chosen"), value)
    first = F.when(F.col("chosen"), F.struct("x0", "seg", "k"))
    item = F.transform(F.array_sort(F.collect_list(own(F.struct("x0", "seg", "k", "t")))), lambda x: x["t"])
    free = F.when(~F.col("chosen") & (F.col("leaders") < LEADERS), F.struct("y0", "x0", "seg", "k", "t", "y1", "size", "bold", "median"))
    entries = texts.groupBy(*_PAGE, "n_seg", "n_k").agg(
        F.first("titled").alias("titled"), F.first("n_t").alias("printed"), tx.despace(F.array_join(item, " ")).alias("title"), F.min_by("x0", first).alias("x0"), F.min(own(F.col("y0"))).alias("y0"),
        F.max(own(F.col("y1"))).alias("y1"), F.min_by("size", first).alias("size"), F.collect_list(free).alias("loose"), F.bool_or("chosen").alias("led"),
    )
    entry = F.when(F.col("led"), F.struct("y0", "x0", "title", "printed", "y1", "size"))
    listed = entries.groupBy(*_PAGE).agg(F.first("titled").alias("titled"), F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.flatten(F.collect_list("loose"))).alias("loose")).where(F.size("entries") >= LEAST_ENTRIES)
    listed = listed.withColumn("entries", F.transform("entries", lambda e: F.struct(*(e[c].alias(c) for c in ("title", "printed", "x0", "y0", "y1", "size")))))

    def add(state: Column, x: Column) -> Column:
        """A loose line continues the lowest entry right above it, or heads a group, or is nothing."""
        above = lambda e: (F.abs(x["x0"] - e["x0"]) <= 3) & (x["y0"] - e["y1"] > 0) & (x["y0"] - e["y1"] <= 1.2 * e["size"]) & (F.abs(x["size"] - e["size"]) < 0.5)
        lowest = F.array_max(F.transform(F.filter(state["entries"], above), lambda e: e["y1"]))
        takes = lambda e: F.coalesce(above(e) & (e["y1"] == lowest), F.lit(False))
        more = F.transform(state["entries"], lambda e: F.struct(F.when(takes(e), F.concat(e["title"], F.lit(" "), x["t"])).otherwise(e["title"]).alias("title"), e["printed"].alias("printed"), e["x0"].alias("x0"), e["y0"].alias("y0"), F.when(takes(e), x["y1"]).otherwise(e["y1"]).alias("y1"), e["size"].alias("size")))
        heads = lowest.isNull() & ((x["size"] >= 1.25 * x["median"]) | (x["bold"] & ((F.upper(x["t"]) == x["t"]) & (F.lower(x["t"]) != x["t"]) | x["t"].startswith("PART "))))
        group = F.struct(tx.despace(x["t"]).alias("title"), x["y0"].alias("y0"), x["x0"].alias("x0"))
        return F.struct(more.alias("entries"), F.when(heads, F.concat(state["groups"], F.array(group))).otherwise(state["groups"]).alias("groups"))

    start = F.struct(F.col("entries").cast(f"array<{_ENTRY}>").alias("entries"), F.array().cast("array<struct<title:string,y0:double,x0:double>>").alias("groups"))
    read = listed.select(*_PAGE, "titled", F.aggregate("loose", start, add).alias("s"))
    read = read.select(*_PAGE, "titled", "s.groups", F.posexplode_outer("s.entries").alias("n", "e")).where("n is not null")
    owner = F.array_max(F.transform(F.filter("groups", lambda g: (g["y0"] < F.col("e.y0")) & (F.abs(g["x0"] - F.col("e.x0")) <= 40)), lambda g: F.struct(g["y0"].alias("y0"), g["title"].alias("title"))))
    return read.select(*_PAGE, "titled", "n", clean_title(F.col("e.title")).alias("title"), "e.printed", owner["title"].alias("grp"))


def _first_number(printed: Column) -> Column:
    return F.coalesce(F.regexp_extract(printed, r"^(?:[A-Z]-)?(\d+)", 1).try_cast("int"), F.lit(0))


def numbered_groups(entries: DataFrame) -> DataFrame:
    """Entries "4.1 Copper" belong to the last "4. Our assets" above them, which is then their group and no entry.

    The numbering begins anew behind an entry without a number. Takes (report, ord, title, grp).
    """
    order = Window.partitionBy("report").orderBy("ord")
    major, minor = F.regexp_extract("title", NUMBERED_TITLE, 1), F.regexp_extract("title", NUMBERED_TITLE, 2)
    rows = entries.withColumns({"major": F.when(F.col("title").rlike(NUMBERED_TITLE), major), "minor": F.when(F.col("title").rlike(NUMBERED_TITLE), minor)})
    rows = rows.withColumn("era", F.sum(F.when(F.col("major").isNull(), 1).otherwise(0)).over(order))
    head = F.when(F.col("minor") == "", F.struct("ord", "title"))
    above = F.last(head, ignorenulls=True).over(Window.partitionBy("report", "era", "major").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("head", F.when(F.col("minor") != "", above))
    rows = rows.withColumn("heads", F.collect_set("head.ord").over(Window.partitionBy("report"))).where(~F.array_contains("heads", F.col("ord")))
    return rows.withColumn("grp", F.coalesce("head.title", "grp")).drop("major", "minor", "era", "head", "heads")


def contents_entries(segments: DataFrame, pages: DataFrame, finder: PageFinder, counts: DataFrame) -> DataFrame:
    """Entries of the printed contents: of the first page that is one, and of the pages behind it that go on with larger numbers.

    ``counts`` has (report, page_count); entries that lead before the contents or beyond the report are left out.
    """
    parsed = parse_contents(segments, pages)
    # All of a report's entries in one order: a page is followed by its first entry and led by the last one of the page before.
    titled = F.min(F.when(F.col("titled") & (F.col("page") <= SEARCHED_PAGES), F.col("page"))).over(Window.partitionBy("report"))
    own = parsed.withColumn("contents_page", titled).where("page >= contents_page")
    follow = Window.partitionBy("report").orderBy("page", "n")
    last, said = F.lag("page").over(follow), F.lag("printed").over(follow)
    goes_on = (F.col("page") == last) | ((F.col("page") == last + 1) & (_first_number(F.col("printed")) >= _first_number(said)))
    own = own.withColumn("_stop", F.when(F.coalesce(goes_on, F.col("page") == F.col("contents_page")), 0).otherwise(1))
    own = own.withColumn("_stop", F.sum("_stop").over(follow)).where("_stop = 0").withColumn("ord", F.row_number().over(follow).cast("long")).drop("_stop")
    placed = finder.pages(numbered_groups(own)).join(counts, "report").where("start > contents_page and start <= page_count")
    return placed.select("report", "ord", "title", "start", "grp")


# ---------------------------------------------------------------- the other sources


def header_runs(headers: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(report, title, first, last): runs of pages under one title. Takes (report, page, place, line); ``groups`` (report, title) are no titles.

    Lines on over three tenths of the pages are the report's name. The title of a page is its first line that isn't in capitals, else
    its first; a page without one doesn't end a run, two do. Runs of one page count where a report has fewer than three runs.
    """
    rows = headers.where("report is not null and page is not null and line is not null")
    pages = rows.groupBy("report").agg(F.countDistinct("page").alias("pages"))
    lines = rows.groupBy("report", "line").agg(F.collect_list(F.struct("page", "place")).alias("at")).where(~F.col("line").rlike(PAGE_NUMBER) & (F.length("line") >= 4))
    rows = lines.join(pages, "report").where(F.size(F.array_distinct("at.page")) <= 0.3 * F.col("pages")).select("report", "line", F.inline("at"))
    if groups is not None:
        key = F.array_join(title_words(F.col("line")), " ")
        known = groups.select("report", F.array_join(title_words(F.col("title")), " ").alias("key")).distinct()
        rows = rows.withColumn("key", key).join(known, ["report", "key"], "left_anti").drop("key")
    capitals = (F.upper("line") == F.col("line")) & (F.lower("line") != F.col("line"))
    titles = rows.groupBy("report", "page").agg(F.min_by("line", F.struct(capitals, "place")).alias("title"))
    order = Window.partitionBy("report").orderBy("page")
    new = ~F.col("title").eqNullSafe(F.lag("title").over(order)) | (F.col("page") - F.lag("page").over(order) > 2)
    titles = titles.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(order))
    runs = titles.groupBy("report", "run", "title").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    runs = runs.withColumn("n", F.count("*").over(Window.partitionBy("report"))).where("last > first or n < 3")
    return runs.select("report", "title", "first", "last")


def item_headings(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """(report, ord, title, start, item): bold lines "Item 7. …" at the left margin. ``pages`` has (report, page, width)."""
    rows = segments.where(F.col("t").rlike(ITEM_HEADING) & F.col("bold") & (F.length("t") <= 160)).join(pages.select(*_PAGE, "width"), _PAGE).where("x0 < 0.25 * width")
    order = F.row_number().over(Window.partitionBy("report").orderBy("page", "seg")).cast("long")
    return rows.select("report", order.alias("ord"), F.col("t").alias("title"), F.col("page").alias("start"), F.upper(F.regexp_extract("t", ITEM_HEADING, 1)).alias("item"))


def bookmark_entries(bookmarks: DataFrame) -> DataFrame:
    """Entries of an outline (report, seq, level, title, page): the first level with three bookmarks or more gives the groups, the one below it the sections."""
    rows = bookmarks.where("page >= 1")
    top = rows.groupBy("report", "level").agg(F.count("*").alias("n")).where("n >= 3").groupBy("report").agg(F.min("level").alias("top"))
    # What comes next in the outline tells whether a bookmark of the first level is a group.
    order = Window.partitionBy("report").orderBy("seq")
    nexts = bookmarks.withColumn("child", F.coalesce((F.lead("level").over(order) == F.col("level") + 1) & (F.lead("page").over(order) >= 1), F.lit(False))).where("page >= 1")
    own = nexts.join(top, "report").where("level in (top, top + 1)").withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    group = F.last(F.when(F.col("level") == F.col("top"), F.struct(F.when(F.col("child"), F.col("title")).alias("t"))), ignorenulls=True).over(order)["t"]
    own = own.withColumn("grp", group).where("level > top or not child")
    return own.select("report", F.col("seq").cast("long").alias("ord"), "title", F.col("page").alias("start"), F.when(F.col("level") > F.col("top"), F.col("grp")).alias("grp"))


def heading_entries(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries from large bold lines near the top of a page, stacked ones joined; a title that goes on within three pages counts once."""
    body = segments.groupBy("report", F.bround("size").alias("s")).agg(F.sum(F.length("t")).alias("n"), F.min(F.struct("page", "seg")).alias("f")).groupBy("report").agg(F.max_by("s", F.struct("n", -F.col("f.page"), -F.col("f.seg"))).alias("body"))
    rows = segments.join(pages.select(*_PAGE, "height"), _PAGE).join(body, "report").where("bold")
    down = Window.partitionBy(*_PAGE).orderBy("y0", "x0", "seg")
    stands = (F.col("size") >= 1.15 * F.col("body")) & (F.length("t") <= 90) & F.col("t").rlike("[A-Za-z]{3}") & (F.col("y0") <= 0.4 * F.col("height"))
    rows = rows.withColumn("from", F.min(F.when(stands, F.struct("y0", "x0", "seg", "size", "y1"))).over(Window.partitionBy(*_PAGE))).where("from is not null and struct(y0, x0, seg) >= struct(from.y0, from.x0, from.seg)")
    near = (F.abs(F.col("size") - F.col("from.size")) < 0.3) & (F.coalesce(F.col("y0") - F.lag("y1").over(down), F.lit(0.0)).between(0.0, 0.8 * F.col("from.size")))
    rows = rows.withColumn("_off", F.sum(F.when(near, 0).otherwise(1)).over(down)).where("_off = 0")
    titles = rows.groupBy(*_PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seg", "t"))), lambda x: x["t"]), " ").alias("title")).withColumn("title", clean_title(F.col("title")))
    listed = titles.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("page", "title"))).alias("s"))

    def add(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        again = F.coalesce(same_title(last["title"], x["title"]) & (x["page"] - last["page"] <= 3), F.lit(False))
        return F.when(again, kept).otherwise(F.concat(kept, F.array(x)))

    kept = listed.select("report", F.posexplode(F.aggregate("s", F.slice("s", 1, 0), add)).alias("ord", "e"))
    return kept.select("report", (F.col("ord") + 1).cast("long").alias("ord"), "e.title", F.col("e.page").alias("start"), F.lit(None).cast("string").alias("grp"))


# ---------------------------------------------------------------- the map


def section_map(counts: DataFrame, **sources: DataFrame) -> DataFrame:
    """(report, seq, id, parent_id, title, kind, level, start_page, end_page, source): sections of every report.

    ``counts`` has (report, page_count); ``sources`` are entries (report, ord, title, start, grp) named as in ``SOURCES``, of which each
    report uses the first that has any. Pages before the first section are front matter; a group spans its sections.
    """
    given = [sources[name].select("report", "ord", "title", F.col("start").cast("long").alias("start"), "grp", F.lit(name).alias("source"), F.lit(k).alias("rank")) for k, name in enumerate(SOURCES) if name in sources]
    entries = given[0]
    for more in given[1:]:
        entries = entries.unionByName(more)
    report = Window.partitionBy("report")
    entries = entries.withColumn("_best", F.min("rank").over(report)).where("rank = _best").join(counts, "report")
    order = report.orderBy("start", "ord")
    entries = entries.withColumn("i", F.row_number().over(order)).withColumn("next", F.lead("start").over(order))
    entries = entries.withColumn("end", F.greatest(F.coalesce(F.col("next") - 1, F.col("page_count")), F.col("start")))
    # The first entry of a group brings the group with it, the first of a report its front matter.
    group = Window.partitionBy("report", "grp").orderBy("i")
    after = F.last("next").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    entries = entries.withColumn("heads", F.col("grp").isNotNull() & (F.row_number().over(group) == 1)).withColumn("last", F.coalesce(after - 1, F.col("page_count")))
    made = {"i": "int", "k": "int", "title": "string", "start": "long", "end": "long", "source": "string", "grp": "string", "level": "int"}
    row = lambda *values: F.struct(*(v.cast(t).alias(c) for (c, t), v in zip(made.items(), values)))
    none, lit = F.lit(None), F.lit
    own = row(F.col("i"), lit(1), F.col("title"), F.col("start"), F.col("end"), F.col("source"), F.col("grp"), lit(2))
    head = F.when(F.col("heads"), row(F.col("i"), lit(0), F.col("grp"), F.col("start"), F.greatest("last", "start"), F.col("source"), none, lit(1)))
    front = F.when((F.col("i") == 1) & (F.col("start") > 1), row(lit(0), lit(0), lit("Front matter"), lit(1), F.col("start") - 1, lit("fallback"), none, lit(1)))
    rows = entries.select("report", F.inline(F.array_compact(F.array(own, head, front)))).withColumn("seq", (F.row_number().over(report.orderBy("i", "k")) - 1).cast("long"))
    slug = tx.slug(F.col("title"))
    nth = F.row_number().over(Window.partitionBy("report", "_slug").orderBy("seq"))
    rows = rows.withColumn("_slug", slug).withColumn("id", F.when(nth > 1, F.concat("_slug", F.lit("-"), nth)).otherwise(F.col("_slug")))
    leads = (F.col("k") == 0) & (F.col("source") != "fallback")
    rows = rows.withColumn("_grp", F.when(leads, F.col("title")).otherwise(F.col("grp")))
    parent = F.max(F.when(leads, F.col("id"))).over(Window.partitionBy("report", "_grp"))
    rows = rows.withColumn("parent_id", F.when(F.col("grp").isNotNull(), parent))
    return rows.select("report", "seq", "id", "parent_id", "title", wd.kind_of(F.col("title")).alias("kind"), "level", F.col("start").alias("start_page"), F.col("end").cast("long").alias("end_page"), "source")


def leaves(sections: DataFrame) -> DataFrame:
    """Sections that are no other section's parent."""
    return sections.join(sections.where("parent_id is not null").select("report", F.col("parent_id").alias("id")).distinct(), ["report", "id"], "left_anti")


def confirmations(sections: DataFrame, **others: DataFrame) -> DataFrame:
    """(report, id, source, page, warns): other sources (report, title, start) that have a section's title; ``warns`` if over two pages away.

    A source never confirms its own sections; of several runs of a title the first counts.
    """
    own = leaves(sections).where("source <> 'fallback'").select("report", "id", "title", "start_page", F.col("source").alias("of"))
    out = None
    for name, rows in others.items():
        # Titles that mean the same share a word, so they meet on one.
        word = lambda c: F.explode(F.array_distinct(title_words(F.col(c))))
        a = own.where(F.col("of") != name).withColumn("w", word("title"))
        b = rows.select("report", F.col("title").alias("other"), F.col("start").alias("page")).withColumn("w", word("other"))
        hits = a.join(b, ["report", "w"]).where(same_title(F.col("title"), F.col("other")))
        hits = keep_first(hits, ["report", "id"], F.col("page")).select("report", "id", F.lit(name).alias("source"), "page", (F.abs(F.col("page") - F.col("start_page")) > 2).alias("warns"))
        out = hits if out is None else out.unionByName(hits)
    return out


def cover(sections: DataFrame, counts: DataFrame) -> DataFrame:
    """(report, pages, once, depth): pages of a report, whether its leaves hold each of them exactly once, and the deepest level."""
    own = leaves(sections)
    held = own.select("report", F.explode(F.sequence("start_page", "end_page")).alias("page")).groupBy("report").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    depth = sections.groupBy("report").agg(F.max(F.when(F.col("parent_id").isNull(), 1).otherwise(2)).alias("depth"))
    return held.join(counts, "report").join(depth, "report").select("report", "pages", ((F.col("n") == F.col("pages")) & (F.col("pages") == F.col("page_count"))).alias("once"), "depth")
