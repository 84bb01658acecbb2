"""Pages of sites: which to read, their in-page sections, outlines that fit, summaries of links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.text import clip

#: What the first path segment of a page names, in order of preference.
BUCKETS = [
    ("docs", "docs?|documentation|guides?|getting-started|get-started|introduction|intro|quick-?start|installation|install|overview|reference"),
    ("components", "components?|blocks?|library|ui|elements|widgets|sections|templates?|examples?|showcase|gallery|browse|explore|collections?|categories|category|icons|fonts|typefaces|kits?|patterns|effects|animations|backgrounds|skills|presets|themes"),
    ("pricing", "pricing|plans|prices?|purchase|buy|pro|premium|all-access|lifetime"),
    ("about", "about|about-us|faq|faqs|features|why"),
    ("license", "license|licen[cs]ing|licen[cs]e-agreement|usage-rights"),
]
#: Paths never read, and what the place of a link adds to its score.
SKIPPED = r"(?i)^/(blog|posts?|news|changelog|login|log-in|signin|sign-in|signup|sign-up|register|auth|account|cart|checkout|privacy|cookies?|terms|legal|careers|jobs|press|contact|tag|tags|author|search|feed|rss)(/|$)|^/[a-z]{2}(-[a-z]{2,4})?(/|$)(?!.*(docs|components))"
BONUS = {"llms": 3, "nav": 2, "home": 1, "sitemap": 0}
#: Ids that name nothing.
LANDMARK = re.compile(r"(top|main|content|nav|footer|header|root|__next|app)", re.I)
FRAMEWORK = re.compile(r"(radix-|headlessui-|react-|mui-|base-ui-|reka-|aria-|:r)", re.I)


def bucket(u: Column) -> Column:
    """The bucket that a page's first path segment names; null for none and for paths of over three segments."""
    s = urls.segments(u)
    first = F.regexp_replace(F.lower(F.get(s, F.lit(0))), r"\.(html?|md|mdx)$", "")
    out = F.when(F.size(s) > 3, F.lit(None).cast("string"))
    for name, words in BUCKETS:
        out = out.when(first.rlike(f"^({words})$"), name)
    return out


def choose(candidates: DataFrame, most: int = 4) -> DataFrame:
    """(home, url, bucket, place) for candidates (home, url, source): the best page of each bucket in order, then the best
    shallow docs and components pages, up to `most`. Ranks are limited before the shuffle, so a site with very many links costs little."""
    clean = F.regexp_replace("url", "/$", "")
    depth = F.size(urls.segments(F.col("url")))
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BONUS.items() for x in p]), F.col("source")), F.lit(0))
    p = urls.path(F.col("url"))
    order = F.array_position(F.array(*[F.lit(b) for b, _ in BUCKETS]), F.col("bucket"))
    c = candidates.withColumn("url", clean).where(F.col("url") != F.regexp_replace("home", "/$", ""))
    c = c.where((urls.site(F.col("url")) == urls.site(F.col("home"))) & ~F.col("url").contains("?") & ~p.rlike(SKIPPED) & ~urls.is_asset(F.col("url"))).withColumn("bucket", bucket(F.col("url"))).where("bucket is not null")
    c = c.groupBy("home", "url", "bucket").agg(F.max(bonus - 2 * depth - F.length(p) / 100).alias("score"), F.first(depth <= 2).alias("shallow"))
    best = [F.desc("score"), F.col("url")]
    r = c.withColumn("_k", F.row_number().over(Window.partitionBy("home", "bucket", "shallow").orderBy(*best))).where(F.col("_k") <= most + 1)
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy("home", "bucket").orderBy(*best)))
    lead = F.col("_k") == 1
    r = r.where(lead | (F.col("shallow") & F.col("bucket").isin("docs", "components")))
    place = F.row_number().over(Window.partitionBy("home").orderBy(F.when(lead, order).otherwise(len(BUCKETS) + 1), *best))
    return r.withColumn("place", place).where(F.col("place") <= most).select("home", "url", "bucket", "place")


def is_junk_id(name: str) -> bool:
    """Landmarks, ids of frameworks, ids that are mostly digits, and hashes."""
    s = name.strip()
    core = re.sub(r"[^a-z0-9]", "", s, flags=re.I)
    if not s or len(s) > 80 or LANDMARK.fullmatch(s) or FRAMEWORK.match(s) or not re.search("[a-z]", core, re.I):
        return True
    return sum(x.isdigit() for x in core) * 2 > len(core) or bool(re.fullmatch(r"[0-9a-f]{12,}", core, re.I))


class _Anchors(HTMLParser):
    """One pass over a page: a heading names itself if it has an id, and every open block that waits for its first heading."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.named: dict[str, str | None] = {}
        self.linked: dict[str, str] = {}
        self.open: list[str | None] = []
        self.heading: tuple[str, str | None, list[str]] | None = None
        self.link: tuple[str, list[str]] | None = None

    def _new(self, name: str | None) -> str | None:
        if name is None or is_junk_id(name) or name in self.named:
            return None
        self.named[name] = None
        return name

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("section", "article", "div"):
            self.open.append(self._new(a.get("id")))
        elif re.fullmatch("h[1-4]", tag):
            self.heading = (tag, self._new(a.get("id")), [])
        elif tag == "a" and (a.get("href") or "").startswith("#"):
            self.link = (a["href"][1:].strip(), [])

    def handle_data(self, data):
        for held in (self.heading and self.heading[2], self.link and self.link[1]):
            if held is not None:
                held.append(data)

    def handle_endtag(self, tag):
        if tag in ("section", "article", "div") and self.open:
            self.open.pop()
        elif self.heading and tag == self.heading[0]:
            text = self._text(self.heading[2])
            for name in [self.heading[1], *self.open]:
                if name is not None and self.named[name] is None:
                    self.named[name] = text
            self.heading = None
        elif tag == "a" and self.link:
            name, text = self.link[0], self._text(self.link[1])
            if text and name not in self.linked and not is_junk_id(name):
                self.linked[name] = text
            self.link = None

    @staticmethod
    def _text(parts: list[str]) -> str:
        return " ".join(" ".join(parts).split())[:120]

    def found(self) -> list[dict]:
        named = {k: v for k, v in self.named.items() if v is not None}
        return [{"id": k, "text": v} for k, v in (named | {k: v for k, v in self.linked.items() if k not in named}).items()]


def anchors_of(page: str | None) -> list[dict]:
    """{id, text} of a page: headings and blocks with ids in document order, then ids that only links of the page name."""
    p = _Anchors()
    p.feed(page or "")
    p.close()
    return p.found()


def anchors(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, anchor, text) of every page; nesting needs a parser, so it runs in Arrow batches."""
    kind = pa.list_(pa.struct([("id", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([anchors_of(t) for t in b.column(1).to_pylist()], kind)], [id, "a"])

    made = pages.select(id, html).mapInArrow(run, f"{id} {pages.schema[id].dataType.simpleString()}, a array<struct<id:string,text:string>>")
    return made.select(id, F.posexplode("a").alias("pos", "a")).select(id, "pos", F.col("a.id").alias("anchor"), F.col("a.text").alias("text"))


def outline(sections: DataFrame, docs: DataFrame, budget: int = 7000, lead: int = 1500) -> DataFrame:
    """(doc, depth, listed, text): the first section's beginning and the titles of the rest, down to the deepest of three levels
    whose outline has at most `budget` bytes; depth 0 where only some of the top level fits. sections as sections.split() gives them, docs (doc, text)."""
    first = F.col("n") == 1
    head = F.concat(F.lit("§1 "), "title", F.lit("\n"), clip(F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")), lead))
    row = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0))), F.lit("§"), F.col("n").cast("string"), F.lit(" "), clip(F.col("title"), 100))
    one = sections.where(first).join(docs.select("doc", "text"), "doc").select("doc", "n", F.lit(0).alias("depth"), head.alias("line"))
    lines = one.unionByName(sections.where(~first).select("doc", "n", "depth", row.alias("line"))).withColumn("size", F.octet_length("line") + 1)
    note = lambda k: F.concat(F.lit("… +"), k.cast("string"), F.lit(" sections not listed"))
    kept = [F.sum(F.when(F.col("depth") <= d, F.col("size")).otherwise(0)).alias(f"b{d}") for d in (1, 2, 3)] + [F.count_if(F.col("depth") > d).alias(f"m{d}") for d in (1, 2, 3)]
    per = lines.groupBy("doc").agg(*kept)
    depth = F.lit(0)
    for d in (1, 2, 3):
        whole = F.col(f"b{d}") - 1 + F.when(F.col(f"m{d}") > 0, F.octet_length(note(F.col(f"m{d}"))) + 1).otherwise(0)
        depth = F.when(whole <= budget, d).otherwise(depth)
    level = per.select("doc", depth.alias("level"))
    ran = F.sum("size").over(Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    top = lines.where("depth <= 1").withColumn("ran", ran).select("doc", "n", "ran")
    all_ = lines.join(level, "doc").join(top, ["doc", "n"], "left")
    keep = F.when(F.col("level") > 0, F.col("depth") <= F.col("level")).otherwise((F.col("depth") <= 1) & (F.col("ran") <= budget - 40))
    listed = F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("n", "line")))), lambda x: x["line"])
    out = all_.groupBy("doc").agg(F.first("level").alias("depth"), listed.alias("lines"), F.count("*").alias("n"))
    left = F.col("n") - F.size("lines")
    return out.select("doc", "depth", F.size("lines").alias("listed"), F.array_join(F.when(left > 0, F.concat("lines", F.array(note(left)))).otherwise(F.col("lines")), "\n").alias("text"))


def link_paths(links: Column, most: int = 40) -> Column:
    """Distinct paths with queries of absolute links, without the root, the first `most`."""
    paths = F.transform(links, lambda u: F.regexp_extract(u, r"^(?i)https?://[^/?#]+([^#]*)", 1))
    return F.slice(F.array_distinct(F.filter(paths, lambda p: (p != "") & (p != "/"))), 1, most)


def next_page(links: DataFrame, current: str = "url", link: str = "link", param: str = "page") -> DataFrame:
    """(url, next): the link of a listing page to its next page number (a page without a number is the first)."""
    number = lambda c: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(c, rf"[?&]{param}=(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
    same = urls.page_key(F.col(current)) == urls.page_key(F.col(link))
    return links.where(same & (number(F.col(link)) == number(F.col(current)) + 1)).groupBy(current).agg(F.min(link).alias("next"))


def host_filter(locs: DataFrame, most: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Sitemap locations (domain, pos, loc): those of the own host, repaired, the first of equal ones, at most so many a domain
    (the feature's own limit); and per domain how many were foreign, repaired, repeated and over the limit."""
    fixed = urls.repair(F.col("loc"), F.col("domain"))
    r = locs.withColumn("url", fixed).withColumn("repaired", F.col("url") != F.col("loc")).withColumn("own", urls.site(F.col("url")) == F.regexp_replace("domain", r"^www\.", ""))
    kept = r.where("own").groupBy("domain", "url").agg(F.min("pos").alias("pos"))
    ranked = kept.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where(F.col("_r") <= most)
    sizes = kept.groupBy("domain").agg(F.count("*").alias("n"))
    seen = r.groupBy("domain").agg(F.count_if(~F.col("own")).alias("foreign"), F.count_if("repaired").alias("repaired"), F.count_if("own").alias("ours")).join(sizes, "domain", "left")
    n = F.coalesce("n", F.lit(0))
    return ranked.drop("_r"), seen.select("domain", "foreign", "repaired", (F.col("ours") - n).alias("repeated"), F.greatest(n - most, F.lit(0)).alias("truncated"))
