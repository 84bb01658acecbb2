"""HTML functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import entities

#: Elements without visible text, and elements that end a line.
DROPPED = ("script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form")
BLOCKS = "p|div|section|article|main|li|ul|ol|tr|table|h[1-6]|br|hr|blockquote|pre"


def drop(c: Column, names=DROPPED) -> Column:
    for n in names:
        c = F.regexp_replace(c, rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", " ")
    return F.regexp_replace(c, "(?s)<!--.*?-->", " ")


def visible(c: Column) -> Column:
    """Visible text: one line a block, white space collapsed, empty lines gone."""
    c = F.regexp_replace(drop(c), rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    c = entities(F.regexp_replace(c, "<[^>]+>", " "))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_lines(c: Column) -> Column:
    """First occurrence of each line, without lines about cookies."""
    return F.array_distinct(F.filter(F.split(c, "\n"), lambda x: ~F.lower(x).rlike(r"\bcookies?\b") & (x != "")))


def title(c: Column) -> Column:
    return F.trim(F.regexp_replace(entities(F.regexp_extract(c, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def meta(c: Column, name: str) -> Column:
    """The content of the first meta tag of that name or property, in either order of attributes."""
    a = F.regexp_extract(c, rf"(?is)<meta\b[^>]*\b(?:name|property|itemprop)=[\"']{name}[\"'][^>]*\bcontent=[\"']([^\"']*)", 1)
    b = F.regexp_extract(c, rf"(?is)<meta\b[^>]*\bcontent=[\"']([^\"']*)[\"'][^>]*\b(?:name|property|itemprop)=[\"']{name}[\"']", 1)
    return entities(F.when(a != "", a).otherwise(b))


def headings(c: Column) -> Column:
    """Texts of h1 to h3, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(entities(F.regexp_replace(x, "<[^>]+>", " ")), r"\s+", " "))), lambda x: x != "")


def hrefs(c: Column) -> Column:
    """Targets of links, distinct, in page order, without fragments of the page itself."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<a\b[^>]*\bhref=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: entities(F.trim(x))), lambda x: ~x.startswith("#")))


def nav_texts(c: Column, most: int = 20) -> Column:
    """Texts of 2 to 40 characters in nav, or else in header."""
    nav = F.regexp_extract(c, r"(?is)<nav\b[^>]*>(.*?)</nav>", 1)
    part = F.when(nav != "", nav).otherwise(F.regexp_extract(c, r"(?is)<header\b[^>]*>(.*?)</header>", 1))
    found = F.regexp_extract_all(part, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))
    texts = F.transform(found, lambda x: F.trim(F.regexp_replace(entities(F.regexp_replace(x, "<[^>]+>", " ")), r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(texts, lambda x: F.length(x).between(2, 40))), 1, most)


def digest(url: Column, c: Column) -> Column:
    return F.struct(title(c).alias("title"), meta(c, "description").alias("description"), meta(c, "og:image").alias("image"), headings(c).alias("headings"), nav_texts(c).alias("nav"), visible(c).alias("text"), hrefs(c).alias("links"))


def markdown(c: Column) -> Column:
    """Text with headings as markdown."""
    c = drop(c)
    for k in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{k}\b[^>]*>(.*?)</h{k}>", "\n" + "#" * k + " $1\n")
    return visible(c)


def thin(c: Column, words: Column) -> Column:
    """Fewer than 40 words and a script-built page."""
    return (words < 40) & (c.rlike(r"(?i)id=[\"'](root|app|__next|__nuxt)[\"']") | (F.regexp_count(c, F.lit(r"(?i)<script\b[^>]*\bsrc=")) >= 3))


def challenge(status: Column, c: Column) -> Column:
    """A bot challenge by its title, or a refusal with a marker near its start."""
    return title(c).rlike(r"(?i)just a moment|attention required|verify you are human|access denied") | (status.isin(403, 503) & F.substring(c, 1, 20_000).rlike(r"(?i)captcha|cf-chl|challenge-platform|are you a robot"))


def unreadable(status: Column, kind: Column, c: Column) -> Column:
    """Why a page can't be read, or null: the first rule that holds."""
    words = F.size(F.filter(F.split(visible(c), r"\s+"), lambda x: x != ""))
    return F.when(status.isNull(), "no-answer").when(challenge(status, c), "challenge").when(status.isin(401, 402), "login-required").when(status.isin(404, 410), "dead").when(status >= 400, F.concat(F.lit("http-"), status.cast("string"))).when(~kind.rlike("(?i)html|text|markdown"), "not-html").when(thin(c, words), "thin")


def prices(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([$€£] ?\d+(?:[.,]\d{2})?)"), F.lit(1)))
