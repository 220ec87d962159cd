"""Windows over pages and characters, and the plan that parts a long document into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, BUDGET, OVERLAP = 120_000, 60_000, 4_000


def page_ranges(n: Column, size: Column, overlap: Column) -> Column:
    """Array of (first, last), 1-based and inclusive: windows of ``size`` pages, each ``overlap`` into the one before."""
    size = F.greatest(size, F.lit(1))
    step = size - F.least(F.greatest(overlap, F.lit(0)), size - 1)
    count = F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)) + 1
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step + 1).alias("first"), F.least(i * step + size, n).alias("last")))
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def char_ranges(n: Column, size: Column, overlap: Column) -> Column:
    """Array of (start, end), 0-based and end-exclusive."""
    return F.transform(page_ranges(n, size, overlap), lambda r: F.struct((r["first"] - 1).alias("start"), r["last"].alias("end")))


def plan(documents: DataFrame, threshold: int = THRESHOLD, budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """key, est_tokens, sectioned, paginated, section, first, last. ``documents`` has key, pages (array of page, markdown)
    and page_count. Paginated documents are parted by pages, others by characters (first, last: start, end); a document at or
    under the threshold is one row without a section."""
    tokens = F.aggregate("pages", F.lit(0).cast("long"), lambda s, p: s + F.floor(F.length(F.coalesce(p["markdown"], F.lit(""))) / 4).cast("long"))
    pages = F.coalesce(F.nullif(F.col("page_count").cast("int"), F.lit(0)), F.size("pages"))
    df = documents.select("key", "pages", pages.alias("n_pages"), tokens.alias("est_tokens"))
    df = df.withColumns({"sectioned": F.col("est_tokens") > threshold, "paginated": (F.col("n_pages") > 1) & (F.size("pages") > 1)})
    average = F.greatest(F.lit(1), F.floor(F.col("est_tokens") / F.col("n_pages"))).cast("int")
    size = F.greatest(F.lit(1), F.bround(F.lit(budget) / average).cast("int"))
    over = F.least(size - 1, F.greatest(F.lit(0), F.bround(F.lit(overlap) / average).cast("int")))
    text = F.length(F.array_join(F.transform("pages", lambda p: F.coalesce(p["markdown"], F.lit(""))), "\n\n"))
    by_page = F.transform(page_ranges(F.col("n_pages"), size, over), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    by_char = F.transform(char_ranges(text, F.lit(budget * 4), F.lit(overlap * 4)), lambda r: F.struct(r["start"].alias("first"), r["end"].alias("last")))
    ranges = F.when(~F.col("sectioned"), F.array().cast("array<struct<first:int,last:int>>")).when(F.col("paginated"), by_page).otherwise(by_char)
    out = df.select("key", "est_tokens", "sectioned", "paginated", F.posexplode_outer(ranges).alias("section", "range"))
    return out.select("key", "est_tokens", "sectioned", "paginated", "section", "range.first", "range.last")


def section_text(pages: Column, first: Column, last: Column) -> Column:
    """Pages ``first`` to ``last`` as one text; a page that is missing is empty."""
    by_number = F.map_from_entries(F.transform(pages, lambda p: F.struct(p["page"], p["markdown"])))
    each = F.transform(F.sequence(first, last), lambda n: F.concat(F.lit("<!-- PAGE "), n.cast("string"), F.lit(" -->\n\n"), F.coalesce(F.try_element_at(by_number, n), F.lit(""))))
    return F.array_join(each, "\n\n---\n\n")
