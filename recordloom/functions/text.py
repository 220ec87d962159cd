"""Scalar text functions as Column builders. All stay in generated JVM code; ``(?U)`` gives Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n<!-- page-break -->\n\n"
_BLANKS = " \t\n\r\x0b\x0c"


def _s(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(_s(c), r"(?U)^\s+|\s+$", "")


def readable_ratio(c: Column | str) -> Column:
    """Letters, digits and white space among the characters; null for blank texts."""
    t = _s(c)
    return F.when(stripped(c) != "", F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", "")) / F.length(t))


def is_garbled(c: Column | str, threshold: float = 0.75) -> Column:
    return F.coalesce(readable_ratio(c) < threshold, F.lit(False))


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of word characters that are wholly a-z and 0-9."""
    words = F.regexp_extract_all(F.lower(_s(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[a-z0-9]+$"))


def split_pages(c: Column | str) -> Column:
    """Array of (page, markdown): numbered before empty pages are dropped; blank texts give one page."""
    parts = F.split(_s(c), r"\Q" + PAGE_BREAK + r"\E")
    pages = F.filter(F.transform(parts, lambda p, i: F.struct((i + 1).alias("page"), stripped(p).alias("markdown"))), lambda p: p["markdown"] != "")
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(F.struct(F.lit(1).alias("page"), stripped(c).alias("markdown"))))


def normalized_name(c: Column | str) -> Column:
    """Lower case, ``&`` as ``and``, no punctuation, single blanks."""
    kept = F.regexp_replace(F.replace(F.lower(_s(c)), F.lit("&"), F.lit("and")), r"(?U)[^\w\s]", "")
    return stripped(F.regexp_replace(kept, r"(?U)\s+", " "))


def slug(c: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(stripped(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def file_stem(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_s(c), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def doc_slug(c: Column | str) -> Column:
    made = slug(file_stem(c))
    return F.when(made == "", F.lit("document")).otherwise(made)


def est_tokens(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_s(c)) / 4).cast("long")


def strip_frontmatter(c: Column | str) -> Column:
    return stripped(F.regexp_replace(_s(c), r"(?s)\A---\n.*?\n---\n", ""))


def section(c: Column | str, heading: str) -> Column:
    """The body below ``## heading`` up to the next one."""
    return stripped(F.regexp_extract(_s(c), rf"(?s)(?:\A|\n)## \Q{heading}\E[ \t]*\n(.*?)(?=\n## |\z)", 1))


def short_id(c: Column | str) -> Column:
    return F.substring(F.sha2(_s(c), 256), 1, 16)


def note_id(c: Column | str) -> Column:
    safe = F.regexp_replace(_s(c), "[^A-Za-z0-9_-]", "_")
    return F.concat(F.substring(safe, 1, 40), F.lit("-"), F.substring(F.sha2(_s(c), 256), 1, 8))


def preview(c: Column | str, n: int = 300) -> Column:
    return F.substring(_s(c), 1, n)


def one_line(c: Column | str, n: int = 200) -> Column:
    return F.replace(F.substring(_s(c), 1, n), F.lit("\n"), F.lit(" "))


def render_date(c: Column | str) -> Column:
    """``15 Mar 2020``, ``March 2020`` or the text itself where it is no such date."""
    t = _s(c)
    day = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), F.lit("yyyy-MM-dd"))
    month = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))), F.lit("yyyy-MM-dd"))
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), F.date_format(month, "MMMM yyyy"), t)


def date_key(c: Column | str) -> Column:
    """Sort key of dates of any precision: a coarser date comes first within its span."""
    t = _s(c)
    return F.when(F.length(t) == 4, F.concat(t, F.lit("-00-00"))).when(F.length(t) == 7, F.concat(t, F.lit("-00"))).otherwise(t)


def year_of(c: Column | str) -> Column:
    t = F.substring(_s(c), 1, 4)
    return F.when(t == "", F.lit("Unknown")).otherwise(t)


def human_size(c: Column | str) -> Column:
    n = (F.col(c) if isinstance(c, str) else c).cast("double")
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(out)
    return out


def page_label(c: Column | str) -> Column:
    n = F.col(c) if isinstance(c, str) else c
    return F.when(n == 1, F.lit("1 page")).otherwise(F.format_string("%d pages", n.cast("long")))


def html_text(c: Column | str) -> Column:
    """Readable text of a page: no scripts, styles, navigation, comments or tags; common entities decoded; one blank a run."""
    t = _s(c)
    for tag in ("script", "style", "nav"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\x0b\x0c]+", " "))


def wiki_links(c: Column | str) -> Column:
    """Targets of ``[[target|alias]]`` links."""
    return F.regexp_extract_all(_s(c), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))


def wiki_link(target: Column, alias: Column) -> Column:
    return F.concat(F.lit("[["), target, F.lit("|"), alias, F.lit("]]"))


def eta(seconds: Column | str) -> Column:
    """``45s``, ``2m 05s`` or ``1h 03m``."""
    s = (F.col(seconds) if isinstance(seconds, str) else seconds).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )
