"""Web pages as documents: title and text out of raw HTML, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip

#: Character references that texts commonly hold.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def text_of(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; block ends become line feeds."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|noscript)\b.*?</\1\s*>", " ")
    lined = F.regexp_replace(bare, r"(?i)</(p|div|li|h[1-6]|tr|section|article|ul|ol|table)>|<br\s*/?>", "\n")
    plain = F.regexp_replace(lined, r"(?s)<[^>]*>", " ")
    for name, sign in REFERENCES:
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return strip(F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"))


def read(pages: DataFrame) -> DataFrame:
    """pages with `title`, `content` and `description`; what is missing is empty."""
    title = strip(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    description = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?is)<meta\s+name=["']description["']\s+content=["'](.*?)["']""", 1)
    return pages.withColumns({"title": title, "content": text_of(F.coalesce("html", F.lit(""))), "description": description})


def as_nodes(read_pages: DataFrame, project: str | None = None) -> DataFrame:
    """A document node for each page, named by its URL's hash."""
    tags = [F.lit("ingested"), F.col("url")] + ([F.lit(f"project:{project}")] if project else [])
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), "content")
    return read_pages.select(F.sha2(F.coalesce("url", F.lit("")), 256).alias("id"), F.lit("document").alias("node_type"), body.alias("body"), F.array(*tags).alias("tags"), F.lit(1.0).alias("confidence"))
