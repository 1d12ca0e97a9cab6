"""Texts and links of HTML pages, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.scalars import let

# Parts of a page that are no text, in the order in which they go.
NO_TEXT = [r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?is)<!doctype[^>]*>"]
TAG = r"<[^>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"
# Beginnings of titles that a listing of new pages, and one of a category, leaves out, and the date of an entry.
NEW_PAGES_SKIP, CATEGORY_SKIP = ["Special:", "User:", "User talk:"], ["Category:", "Special:", "User:"]
ENTRY_DATE = r"\d{1,2}:\d{2},\s*\d{1,2}\s+\w+\s+\d{4}"


def unescaped(text: Column) -> Column:
    """Text with the common entities as signs."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _bare(html: Column) -> Column:
    html = F.coalesce(html, F.lit(""))
    for pattern in NO_TEXT:
        html = F.regexp_replace(html, pattern, "")
    return html


def pieces(html: Column) -> Column:
    """What stands between tags, trimmed, without empty pieces."""
    return F.filter(F.transform(F.split(_bare(html), TAG), lambda x: _stripped(unescaped(x))), lambda x: x != "")


def main_text(html: Column) -> Column:
    """The text of a page, a line for each piece between tags, with at most one empty line, and without [n] where a line begins with it. Null gives an empty text."""
    text = F.regexp_replace(F.array_join(pieces(html), "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"(?m)^\[\d+\]", "")


def _one_link(a: Column) -> Column:
    """struct<title, href, text> of a link's element: the title is its attribute, else its text."""
    text = _stripped(unescaped(F.regexp_replace(F.regexp_extract(a, r"(?is)^<a\s[^>]*>(.*)</a\s*>$", 1), TAG, "")))
    title = _stripped(unescaped(F.regexp_extract(a, r"(?is)^<a\s[^>]*?\btitle\s*=\s*[\"']([^\"']*)[\"']", 1)))
    href = unescaped(F.regexp_extract(a, r"(?is)^<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1))
    return F.struct(F.coalesce(F.nullif(title, F.lit("")), text).alias("title"), href.alias("href"), text.alias("text"))


def links(html: Column) -> Column:
    """array<struct<title, href, text>> of a page's links, in their order."""
    return F.transform(F.regexp_extract_all(_bare(html), F.lit(LINK), F.lit(0)), _one_link)


def _entries(lists: Column, skip: list[str]) -> Column:
    """array<struct<title, href, date>>: the first link of each entry of the lists, unless its title begins with one of skip."""
    entries = F.flatten(F.transform(lists, lambda ul: F.regexp_extract_all(ul, F.lit(r"(?is)<li\b[^>]*>(.*?)</li\s*>"), F.lit(1))))

    def entry(li: Column) -> Column:
        link = _one_link(F.regexp_extract(li, LINK, 0))
        date = F.nullif(F.regexp_extract(F.regexp_replace(li, TAG, ""), ENTRY_DATE, 0), F.lit(""))
        return let(link, lambda x: F.struct(x["title"].alias("title"), x["href"].alias("href"), date.alias("date")))

    def stays(e: Column) -> Column:
        good = e["title"] != ""
        for begin in skip:
            good = good & ~e["title"].startswith(begin)
        return good

    return F.filter(F.transform(entries, entry), stays)


def new_pages(html: Column) -> Column:
    """array<struct<title, href, date>>: the entries of a wiki's listing of new pages that are pages of the wiki."""
    lists = F.regexp_extract_all(_bare(html), F.lit(r"(?is)<ul\b[^>]*\bclass\s*=\s*[\"']mw-contributions-list[\"'][^>]*>(.*?)</ul\s*>"), F.lit(1))
    return F.filter(_entries(lists, NEW_PAGES_SKIP), lambda e: e["href"].contains("/index.php"))


def category_pages(html: Column) -> Column:
    """array<struct<title, href, date>>: the entries of a wiki's category page; dates are null."""
    block = F.regexp_extract(_bare(html), r"(?is)<div\b[^>]*\bid\s*=\s*[\"']mw-pages[\"'][^>]*>(.*)", 1)
    return F.transform(_entries(F.array(block), CATEGORY_SKIP), lambda e: F.struct(e["title"].alias("title"), e["href"].alias("href"), F.lit(None).cast("string").alias("date")))
