"""Web pages and texts: addresses, content identity, stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators.graph import components


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without ``www.`` and ``m.``, without tracking and paging parameters, fragment or trailing slash."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    head = F.regexp_extract(u, r"^[A-Za-z]+://[^/?]*", 0)
    u = F.concat(F.lower(head), F.substring(u, F.length(head) + 1, F.length(u)))
    u = F.regexp_replace(u, r"^(https?://)(www\.|m\.)", "$1")
    u = F.regexp_replace(u, r"([?&])((utm_[a-z]+|fbclid|ref|page)=[^&]*&?)+", "$1")
    return F.regexp_replace(F.regexp_replace(u, r"[?&]+$", ""), r"/+$", "")


def declared_url(url: Column, html: Column) -> Column:
    """The canonical address that a page declares of itself, else its own; canonicalised."""
    own = F.regexp_extract(html, r"""(?i)<link[^>]*rel=["']?canonical["']?[^>]*href=["']([^"']+)""", 1)
    return canonical_url(F.when(own != "", own).otherwise(url))


def html_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags, common entities resolved, white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


#: In order: the ampersand last, so that nothing is resolved twice.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def due_again(attempts: Column, fetched: Column, most: int = 3) -> Column:
    """Whether a page is tried again: not fetched yet, and fewer than ``most`` attempts so far."""
    return ~fetched & (attempts < most)


def content_hash(text: Column) -> Column:
    """sha256 of the text with white space folded."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


#: Stages of a page in order; each is what remains of the ones before.
STAGES = ("rejected", "short", "duplicate", "accepted")


def stage(short: Column, toxic: Column, copy: Column) -> Column:
    return F.when(toxic, "rejected").when(short, "short").when(copy, "duplicate").otherwise("accepted")


def stories(texts: DataFrame, words: int = 8, most: int | None = None) -> DataFrame:
    """(page_id, story) of ``texts`` (page_id, text): pages that share a passage of so many words tell one story, which is named by its least page.

    Passages are compared without case. A passage is a star of the pages that hold it, around the least, so links grow with the passages and not with
    pairs of pages. One that more than ``most`` pages hold (a menu, a notice) links nothing; None: each does. Pages that share nothing, and those without a
    text, are stories of their own; rows without a page_id give none.
    """
    pages = texts.where("page_id is not null")
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    starts = F.when(F.size("w") >= words, F.sequence(F.lit(1), F.size("w") - words + 1)).otherwise(F.array().cast("array<int>"))
    passages = F.array_distinct(F.transform(starts, lambda k: F.md5(F.array_join(F.slice("w", k, words), " "))))
    # dealt by passage once: the distinct rows, the stars and the join need no other exchange, and texts are read once
    held = pages.select("page_id", w.alias("w")).select("page_id", F.explode(passages).alias("passage")).select("page_id", F.unhex("passage").alias("passage")).repartition("passage").distinct()
    stars = held.groupBy("passage").agg(F.min("page_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    if most is not None:
        stars = stars.where(F.col("n") <= most)
    links = held.join(stars.hint("merge"), "passage").select(F.col("page_id").alias("a"), "b").where("a <> b").distinct()
    named = components(links)
    return pages.select("page_id").distinct().join(named, F.col("page_id") == F.col("node"), "left").select("page_id", F.coalesce("component", "page_id").alias("story"))
