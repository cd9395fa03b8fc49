"""Web pages and paged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NOISE = "(?s)<!--.*?-->|<(?:script|style|nav|footer|aside|head|form)[ >].*?</(?:script|style|nav|footer|aside|head|form)>|<div class=\"ad\">.*?</div>"
#: The named references that are decoded; & comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def markdown(html: Column) -> Column:
    """The page without scripts, styles and page furniture; headings as ``#``, blocks apart by a blank line."""
    c = F.regexp_replace(html, _NOISE, " ")
    c = F.regexp_replace(c, "(?s)<h([1-6])[^>]*>(.*?)</h[1-6]>", "\n\n# $2\n\n")
    c = F.regexp_replace(c, "</?(?:p|li|div|ul|ol|tr|table|article|section|body|html)[^>]*>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, "<br[^>]*>", " "), "<[^>]*>", "")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t\\r]+", " "), "\\s*\\n\\s*\\n\\s*", "\n\n")
    return F.trim(c, F.lit(" \n"))


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, text, title, site."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", markdown(F.col("html")).alias("text"), title.alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"))


def repeated_lines(lines: DataFrame, share: float = 0.3, least: int = 2, pages: int = 3) -> DataFrame:
    """doc_id, line, k: running heads and feet, by occurrences (doc_id, page, line); only of documents of three pages or more."""
    trimmed = lines.withColumn("line", F.trim("line"))
    n = trimmed.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    counts = trimmed.where("line <> ''").groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(n, "doc_id").where((F.col("pages") >= pages) & (F.col("k") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("pages"))))).select("doc_id", "line", "k")


def paragraphs(text: Column) -> Column:
    """Lines to paragraphs: a blank line ends one."""
    c = F.regexp_replace(text, "\\n[ \\t]*\\n\\s*", "\u0001")
    return F.replace(F.regexp_replace(c, "\\s*\\n\\s*", " "), F.lit("\u0001"), F.lit("\n\n"))


def scanned(pages: DataFrame, key: str, per_page: int = 200) -> DataFrame:
    """key, n_chars, pages, scanned: too little text for its pages."""
    g = pages.groupBy(key).agg(F.sum(F.char_length("text")).alias("n_chars"), F.count(F.lit(1)).alias("pages"))
    return g.withColumn("scanned", F.col("n_chars") < per_page * F.col("pages"))
