"""Parsed pages: edge lines, page offsets, sections, titles, tables across pages, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as fx

# Lines that are no table titles, words that titles and headers hold.
NO_TITLE = [
    r"^单位[:：]|^编制单位|币种|^注[:：]|^资料来源|^数据来源", r"^[\d\s,.\-—－%()（）]+$",
    r"^[√□✓✗]|适用\s*[□√]|^[（(]?[0-9一二三四五六七八九十]+[)）]?\s*$", r"^[\d]{4}\s*年|^[0-9]{4}[-/年]", r"[.·…]{4,}", r"^\s*第\s*[一二三四五六七八九十]+\s*节", r"[：。]$",
]


def repeated_edges(pages: DataFrame, group: str, text: str, least: Column | int) -> DataFrame:
    """(group, line, n): first and last lines of pages that occur ``least`` times or more; a single line counts as both."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), fx.strip), lambda x: x != "")
    edges = pages.select(group, lines.alias("lines")).where("size(lines) > 0").select(group, F.explode(F.array(F.element_at("lines", 1), F.element_at("lines", -1))).alias("line"))
    return edges.groupBy(group, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def headers_by_share(pages: DataFrame, group: str, text: str, share: float = 0.5) -> DataFrame:
    """Edge lines on more than that share of a group's pages."""
    total = pages.groupBy(group).agg(F.count("*").alias("pages"))
    return repeated_edges(pages, group, text, 1).join(total, group).where(F.col("n") > share * F.col("pages")).drop("pages")


def mode_with_share(rows: DataFrame, group: str, value: str, least: float = 0.9, seen: str | None = None) -> DataFrame:
    """(group, mode, share): the most frequent value, null if its share is less; of ties the first seen, else the smallest."""
    order = F.min(seen if seen else value)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), order.alias("_first"))
    best = counts.groupBy(group).agg(F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), "_first", value)).alias("best"))
    share = -F.col("best.col1") / F.col("total")
    return best.select(group, F.when(share >= least, F.col(f"best.{value}")).alias("mode"), F.round(share, 6).alias("share"))


def carry_forward(rows: DataFrame, partition: list[str], order: list[str], label: Column, default: str) -> DataFrame:
    """Adds section: the last label so far in order, or the default before any."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(default)))


def section_heading(line: Column) -> Column:
    """The heading's label, or null: no ellipsis, at most six dots."""
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    good = F.rlike(line, F.lit(fx.SECTION)) & ~F.contains(line, F.lit("…")) & (dots <= 6)
    return F.when(good, F.concat(F.lit("第"), F.regexp_extract(line, fx.SECTION, 1), F.lit("节 "), fx.strip(F.regexp_extract(line, fx.SECTION, 2))))


def toc_entry(line: Column) -> Column:
    """struct<number, title, page> of a line of contents, or null."""
    p = r"第\s*([一二三四五六七八九十]+)\s*节\s*(.{2,40}?)[\s.·…]{4,}(\d{1,3})\s*$"
    made = F.struct(F.regexp_extract(line, p, 1).alias("number"), fx.strip(F.regexp_extract(line, p, 2)).alias("title"), F.regexp_extract(line, p, 3).try_cast("int").alias("page"))
    return F.when(F.rlike(line, F.lit(p)), made)


def spans(marks: DataFrame, partition: str, start: str, end: str) -> DataFrame:
    """Adds stop: the next mark's start, or the page's end."""
    return marks.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(partition).orderBy(start)), F.col(end)))


def drop_page_marks(lines: Column, headers: Column) -> Column:
    """Lines without closing page numbers (taken away again and again) and header lines."""
    marks = lambda x: F.rlike(x, F.lit("|".join(f"(?:{p})" for p in fx.PAGE_MARKS)))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("end"))
    step = lambda acc, x: F.when(acc["end"] & (marks(fx.strip(x)) | (fx.strip(x) == "")), acc).otherwise(F.struct(F.concat(F.array(x), acc["out"]).alias("out"), F.lit(False).alias("end")))
    kept = F.aggregate(F.reverse(lines), zero, step, lambda acc: acc["out"])
    return F.filter(kept, lambda x: ~F.array_contains(headers, fx.strip(x)))


def table_title(above: Column, keywords: list[str]) -> Column:
    """The nearest line above (array, top first) of 4 to 40 characters with a keyword, lines that can't be titles skipped."""
    bad = F.lit("|".join(f"(?:{p})" for p in NO_TITLE))
    has = lambda x: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(x, k))
    good = F.filter(F.transform(above, fx.strip), lambda x: ~F.rlike(x, bad) & (F.length(x) >= 4) & (F.length(x) <= 40) & has(x))
    return F.try_element_at(good, F.lit(-1))


#: Fixed value: a cell that is a bare number.
NUMERIC_CELL = r"^[\d,.\-—()（）%]+$"


def looks_like_header(row: Column, keywords: list[str]) -> Column:
    """Two cells at least, none a bare number, one with a keyword."""
    cells = F.filter(F.transform(row, lambda c: fx.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    has = F.exists(cells, lambda c: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(c, k)))
    return (F.size(cells) >= 2) & ~F.exists(cells, lambda c: F.rlike(c, F.lit(NUMERIC_CELL))) & has


def inline_title(rows: Column, cell_widths: Column, table_width: Column, share: float = 0.7) -> Column:
    """The first row's text if it is one merged cell wider than that share and more than three rows follow it."""
    first = F.filter(F.element_at(rows, 1), lambda c: F.coalesce(c, F.lit("")) != "")
    wide = F.array_max(cell_widths) > share * table_width
    return F.when((F.size(rows) > 3) & (F.size(first) == 1) & wide, F.try_element_at(first, F.lit(1)))


def outside_boxes(chars: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """Characters (x0, x1, top, bottom) whose centre lies in no box of their page; borders count as inside."""
    cx, cy = (F.col("c.x0") + F.col("c.x1")) / 2, (F.col("c.top") + F.col("c.bottom")) / 2
    inside = (F.col(f"c.{page}") == F.col(f"b.{page}")) & cx.between(F.col("b.bx0"), F.col("b.bx1")) & cy.between(F.col("b.btop"), F.col("b.bbottom"))
    return chars.alias("c").join(boxes.alias("b"), inside, "left_anti")


def merge_tables(fragments: DataFrame, doc: str) -> DataFrame:
    """Fragments of tables that go on over pages, as one: (doc, title, rows, first_page, last_page).

    fragments(doc, seq, page, title, rows, top, bottom, height, section, header_like).
    In order, a fragment joins the table before it if its title is empty or equal, it
    doesn't look like a header, it has as many columns, the first fragment ends below
    0.72 of its page and this one starts above 0.28, it is on the next page and in the
    same section. A chain keeps its first fragment's box, title and width; only the
    last page moves on. A repeated first row goes. One report's tables are one fold;
    a report is one document, so the fold's size is a document's.
    """
    item = F.struct("seq", "page", "title", "rows", "top", "bottom", "height", "section", "header_like")
    ordered = fragments.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("f"))
    kind = "array<struct<title:string,rows:array<array<string>>,first_page:int,last_page:int,bottom:double,height:double,section:string>>"

    def fresh(x: Column) -> Column:
        return F.struct(
            x["title"].alias("title"), x["rows"].alias("rows"), x["page"].cast("int").alias("first_page"), x["page"].cast("int").alias("last_page"),
            x["bottom"].cast("double").alias("bottom"), x["height"].cast("double").alias("height"), x["section"].alias("section"),
        )

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        title = F.coalesce(x["title"], F.lit(""))
        joins = (
            last.isNotNull() & ((title == "") | title.eqNullSafe(last["title"])) & ~x["header_like"] & (F.size(x["rows"][0]) == F.size(last["rows"][0]))
            & (last["bottom"] > 0.72 * last["height"]) & (x["top"] < 0.28 * x["height"]) & (x["page"] == last["last_page"] + 1) & x["section"].eqNullSafe(last["section"])
        )
        body = F.when(x["rows"][0] == last["rows"][0], F.slice(x["rows"], F.lit(2), F.size(x["rows"]))).otherwise(x["rows"])
        merged = F.struct(
            last["title"].alias("title"), F.concat(last["rows"], body).alias("rows"), last["first_page"].alias("first_page"), x["page"].cast("int").alias("last_page"),
            last["bottom"].alias("bottom"), last["height"].alias("height"), last["section"].alias("section"),
        )
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(head, F.array(merged))).otherwise(F.concat(acc, F.array(fresh(x))))

    tables = ordered.select(doc, F.posexplode(F.aggregate("f", F.array().cast(kind), step)).alias("table_no", "t"))
    return tables.select(doc, "table_no", "t.title", "t.rows", "t.first_page", "t.last_page")


def latest(rows: DataFrame, keys: list[str], time: str, seq: str) -> DataFrame:
    """The newest row of each key, null times as the oldest; of ties the last in sequence. Sums only, no sort of a group."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(0)).alias("t"), F.col(seq).alias("s"), F.struct(*rows.columns).alias("row"))).alias("b"))
    return best.select("b.row.*")


def title_matches(title: Column, keywords: list[str], excluded: list[str]) -> Column:
    """A keyword once spaces are gone, and no excluded word."""
    bare = F.replace(F.coalesce(title, F.lit("")), F.lit(" "), F.lit(""))
    any_of = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(bare, w)) if words else F.lit(False)
    return any_of([k.replace(" ", "") for k in keywords]) & ~any_of(excluded)
