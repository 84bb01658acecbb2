"""What becomes an item, an answer or a candidate: gates over links, types, names and paths, and the projections of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.functions.text import clip, slug
from quarry.operators import reports
from quarry.operators.items import COMPONENT, SKIPPED
from quarry.operators.search import reference

#: Languages that a docs path may name, categories whose entries get docs pages, types and names that are never tagged,
#: builds and demos in names, hosts and paths that are no resource.
DOCS_LOCALE = r"(?i)^(cn|zh|zh-cn|zh-hans|zh-hant|zh-tw|ja|jp|ko|kr|fr|de|es|pt|pt-br|ru|it|id|tr|vi|th|pl|nl|ar|hi|uk|he|sv|da|fi|no|nb|cs|hu|ro|el|bg|fa|ms)$"
UI_CATEGORIES = ["components", "sections", "inspiration", "templates", "motion", "color-effects", "layout", "registries"]
UNTAGGED_TYPE = r"^registry:(hook|lib|style|theme|font|file)$"
ICON_NAME = r"(?i)^icons?[-_/]|^components-animate-icons"
BUILD = r"(?i)[-_](ts|js)[-_](tw|css)$"
DEMO = r"(?i)(^|[-_])demos?([-_]|$)"
ASSET_HOST = (
    r"^(images\.unsplash\.com|fonts\.googleapis\.com|fonts\.gstatic\.com|raw\.githubusercontent\.com|stream\.mux\.com|s3[.-][a-z0-9-]+\.amazonaws\.com|pscp\.tv|drive\.google\.com|fb\.me|bit\.ly"
    r"|(www\.)?(youtu\.be|youtube\.com|m\.youtube\.com)|amzn\.to)$"
)
ASSET_PATH = r"(?i)\.(png|jpe?g|gif|webp|svg|mp4|mov|m3u8|pdf|zip|css|js)$"
JUNK = r"^(app\.getsupers\.com/sites/|gumroad\.com/a/)"
COMMUNITY, COMMUNITY_MENTIONS = "x-community", 2


def rendered(origins: Column, mentions: Column) -> Column:
    """Shown: named by a source that isn't the community, or mentioned often enough."""
    return F.exists(origins, lambda o: o != COMMUNITY) | (mentions >= COMMUNITY_MENTIONS)


def is_resource(u: Column) -> Column:
    """Neither an asset by its host or path, nor junk."""
    return ~(urls.host(u).rlike(ASSET_HOST) | urls.path(u).rlike(ASSET_PATH) | F.concat(urls.site(u), urls.path(u)).rlike(JUNK))


def docs_page(u: Column, domain: Column, tagged: Column) -> Column:
    """The slug of a component's docs page, else null: on the entry's host, two segments or more, none a language or a skipped one, not an
    index page, and below a component segment or, where the slug is tagged, below docs. tagged: whether the last segment names an element."""
    s = F.transform(urls.segments(u), lambda x: F.regexp_replace(x, r"(?i)\.(md|mdx|txt|html?)$", ""))
    last = F.element_at(s, -1)
    own = urls.site(u) == F.regexp_replace(domain, r"^www\.", "")
    barred = F.exists(s, lambda x: x.rlike(DOCS_LOCALE) | x.rlike(SKIPPED))
    index = ~last.rlike("(?i)[a-z]") | (last == "index") | last.rlike(COMPONENT)
    under = F.exists(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x.rlike(COMPONENT))
    return F.when(own & (F.size(s) >= 2) & ~barred, F.when(~index & (under | (F.array_contains(s, "docs") & tagged)), last))


def reads_links(categories: Column, registry: Column) -> Column:
    """Whether an entry's link file makes items: an entry of interface resources, or one with a registry."""
    return F.arrays_overlap(categories, F.array(*[F.lit(c) for c in UI_CATEGORIES])) | registry.isNotNull()


def is_taggable(type: Column, name: Column, asset_registry: Column) -> Column:
    """Not a hook, style or the like, and not an icon or a part of an asset library."""
    return ~(F.coalesce(type, F.lit("")).rlike(UNTAGGED_TYPE) | F.coalesce(asset_registry, F.lit(False)) | name.rlike(ICON_NAME))


def is_demo(type: Column, name: Column) -> Column:
    return (type == "registry:example") | name.rlike(DEMO)


def demo_base(name: Column) -> Column:
    """A demo's name without the word."""
    return F.regexp_replace(F.regexp_replace(name, r"(?i)(^|[-_])demos?(?=[-_]|$)", ""), r"^[-_]+|[-_]+$", "")


def clean_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""), r"\s+", " "))


def build_of(name: Column) -> Column:
    """The stack of a build's name, such as ts-tw, else null."""
    return F.when(name.rlike(BUILD), F.lower(F.concat(F.regexp_extract(name, BUILD, 1), F.lit("-"), F.regexp_extract(name, BUILD, 2))))


def merge_builds(items: DataFrame) -> DataFrame:
    """(id, name, stacks, names) of items (parent, pos, name): builds of one component are one item, its stacks and names in order."""
    stack = build_of(F.col("name"))
    base = F.when(stack.isNotNull(), F.regexp_replace("name", BUILD, "")).otherwise(F.col("name"))
    r = items.select("pos", F.concat("parent", F.lit("/"), slug(base)).alias("id"), base.alias("base"), stack.alias("stack"), "name")
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda x: x["v"]), lambda v: v.isNotNull()))
    return r.groupBy("id").agg(F.min_by("base", "pos").alias("name"), listed("stack").alias("stacks"), listed("name").alias("names"))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def path_words(u: Column) -> Column:
    return words(urls.path(u))


def flag_words(c: Column) -> Column:
    """A line of flags as a list; "(some gated)" stays with its word."""
    bare = F.regexp_replace(F.trim(c), "^`|`$", "")
    return F.regexp_extract_all(bare, F.lit(r"\S+(?: \(some gated\))?"), F.lit(0))


def named_by_path(u: Column, needles: list[str]) -> Column:
    """Any whole word of the path is one that is looked for."""
    return F.arrays_overlap(path_words(u), F.array(*[F.lit(n) for n in needles])) if needles else F.lit(False)


def needles(query: str | None, element: str | None = None, aliases: list[str] = (), variant: str | None = None, variant_aliases: list[str] = ()) -> list[str]:
    """Words that a path about the query or the element holds: those of the query with two letters or more, and all of the names given."""
    import re

    said = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    return sorted({w for w in said(query) if len(w) > 1} | {w for a in (element, *aliases, variant, *variant_aliases) for w in said(a)})


def directory_counts(pages: DataFrame, k: int = 8) -> DataFrame:
    """(prefix, n): the k commonest directories of paths (url), by words, and under "more" how many others there are."""
    p = path_words(F.col("url"))
    prefix = F.when(F.size(p) > 1, F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/"))).when(F.size(p) == 1, F.concat(F.lit("/"), F.get(p, F.lit(0)))).otherwise("/")
    c = pages.select(prefix.alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    first = c.orderBy(F.desc("n"), "prefix").limit(k)
    rest = c.join(first.select("prefix"), "prefix", "left_anti").agg(F.count("*").alias("n")).where("n > 0")
    return first.union(rest.select(F.lit("more").alias("prefix"), "n"))


def registry_names(items: DataFrame) -> DataFrame:
    """(parent, name, id): every name under which a registry has an item (id, parent, slug, names); of equal ones the last id."""
    own = F.coalesce(F.col("slug"), F.expr("substring(id, length(parent) + 2)"))
    each = items.select("id", "parent", F.explode(F.coalesce("names", F.array(own))).alias("name"))
    return each.groupBy("parent", "name").agg(F.max("id").alias("id"))


def lookup(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked (parent, name) with the item of that registry name, else the one whose id the name's slug makes."""
    by_name = registry_names(items).select("parent", "name", F.col("id").alias("_a"))
    by_id = items.select(F.col("id").alias("_b")).distinct()
    r = asked.join(by_name, ["parent", "name"], "left").withColumn("_k", F.concat("parent", F.lit("/"), slug(F.col("name")))).join(by_id, F.col("_k") == F.col("_b"), "left")
    return r.select(*asked.columns, F.coalesce("_a", "_b").alias("id"))


def carved_out(candidates: DataFrame, listed: DataFrame) -> DataFrame:
    """candidates (domain, url) that a sitemap lists: the entry's, or one of the URL's own host with or without www. listed: (domain, url)."""
    keys = listed.select(F.lower("domain").alias("folder"), urls.query_key(F.col("url")).alias("key")).where("key is not null").distinct()
    h = urls.host(F.col("url"))
    bare = F.regexp_replace(h, r"^www\.", "")
    each = candidates.withColumn("key", urls.query_key(F.col("url"))).withColumn("folder", F.explode(F.array_distinct(F.array(F.lower("domain"), h, bare, F.concat(F.lit("www."), bare)))))
    return each.join(keys, ["folder", "key"], "left_semi").select(*candidates.columns).distinct()


def related_ids(related: DataFrame, entries: DataFrame) -> DataFrame:
    """related (id, kind, url) with the entry that a repo or docs URL names: entries (id, url)."""
    known = entries.select(reference(F.col("url")).alias("_k"), F.col("id").alias("entry")).groupBy("_k").agg(F.max("entry").alias("entry"))
    return related.join(known, F.when(F.col("kind").isin("repo", "docs"), reference(F.col("url"))) == F.col("_k"), "left").drop("_k")


def members_by_tag(tags: DataFrame) -> DataFrame:
    """(key, tags): tags (tag, pos, keys) turned round, a key's tags in order."""
    each = tags.select("tag", "pos", F.explode("keys").alias("key"))
    return each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))


def item_record(c: dict[str, Column]) -> Column:
    """An item as the index keeps it, as JSON: a short description, and no empty fields."""
    some = lambda x: F.when(F.size(x) > 0, x)
    names = F.when((F.size(c["names"]) > 1) | (F.get(c["names"], F.lit(0)) != F.coalesce(c["slug"], c["name"])), c["names"])
    return F.to_json(F.struct(c["id"].alias("id"), c["parent"].alias("parent"), c["name"].alias("name"), c["access"].alias("access"), F.when(c["description"] != "", clip(c["description"], 200)).alias("description"), some(c["elements"]).alias("elements"), names.alias("names")))


def hit(c: dict[str, Column], total: Column) -> Column:
    """An entry as an answer shows it."""
    return F.struct(c["id"].alias("id"), c["name"].alias("name"), c["url"].alias("url"), clip(F.coalesce(F.nullif(c["desc"], F.lit("")), c["domain"]), 200).alias("summary"), F.coalesce(total, F.lit(0)).alias("pages"))


def group_counts(ranked: DataFrame) -> DataFrame:
    """One row of how many hits (kind, access, granularity) are resources, components, gallery examples and docs pages."""
    page = F.col("access") == "page"
    item = F.col("kind") == "item"
    return ranked.agg(F.count_if(~item).alias("resources"), F.count_if(item & ~page).alias("components"), F.count_if(item & page & (F.col("granularity") == "example")).alias("gallery"), F.count_if(item & page & ~F.col("granularity").eqNullSafe("example")).alias("docs"))


def hints(c: dict[str, Column]) -> Column:
    """What an entry's source says of it, as JSON: url, kind, name, desc; title and about where they differ from desc; labels and note if any; categories."""
    desc = F.coalesce(c["desc"], F.lit(""))
    other = lambda x: F.when((x != "") & ~x.eqNullSafe(c["desc"]), x)
    return F.to_json(F.struct(c["url"].alias("url"), c["kind"].alias("kind"), c["name"].alias("name"), desc.alias("desc"), other(c["title"]).alias("title"), other(c["about"]).alias("about"), F.when(F.size(c["labels"]) > 0, c["labels"]).alias("labels"), F.when(c["note"] != "", c["note"]).alias("note"), c["categories"].alias("categories")))


def hint_categories(categories: Column, by_text: Column, default: str) -> Column:
    """The source's categories without the default, joined with those that the text names."""
    return F.array_union(F.filter(F.coalesce(categories, F.array().cast("array<string>")), lambda x: x != default), F.coalesce(by_text, F.array().cast("array<string>")))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a fingerprint of a table's contents, whatever the order of its rows. Sums of hashes: partial before the shuffle."""
    h = F.md5(F.concat_ws("\x01", *columns))
    part = lambda k: F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("long").cast("decimal(38,0)")).cast("string")
    return rows.agg(F.concat_ws("-", F.count("*").cast("string"), F.coalesce(part(1), F.lit("0")), F.coalesce(part(9), F.lit("0"))).alias("fingerprint"))


def is_fresh(index: DataFrame, schema_version: int, now: DataFrame) -> DataFrame:
    """index (schema_version, fingerprint) with fresh: whether it may be used as it is. now: the one row that fingerprint() gives."""
    return index.withColumn("fresh", (F.col("schema_version") == schema_version) & (F.col("fingerprint") == now.select("fingerprint").scalar()))


def component_pages(locs: DataFrame) -> DataFrame:
    """(key, author, name, url) of sitemap locations (pos, loc) that are components' pages of an author; of equal ones the first."""
    bare = F.regexp_replace(F.trim("loc"), "[?#].*$", "")
    rx = r"^(https?://[^/]+)/@([^/]+)/components/([^/]+)/?$"
    m = locs.select("pos", bare.alias("u")).where(F.col("u").rlike(rx))
    m = m.select("pos", F.regexp_extract("u", rx, 1).alias("site"), F.regexp_extract("u", rx, 2).alias("author"), F.regexp_extract("u", rx, 3).alias("name"))
    m = m.withColumn("key", F.concat_ws("/", "author", "name"))
    one = m.groupBy("key").agg(F.min_by(F.struct("site", "author", "name"), "pos").alias("f"))
    return one.select("key", "f.author", "f.name", F.concat("f.site", F.lit("/@"), "f.author", F.lit("/components/"), "f.name").alias("url"))


def batch_texts(rows: DataFrame, by: list[str], order: list[Column], size: int, head: str) -> DataFrame:
    """(by..., batch, text): the instructions of each batch of ids: a heading and the numbered ids. head holds {n}, the batch's number."""
    placed = reports.batches(rows, by, order, size).withColumn("_p", F.row_number().over(Window.partitionBy(*by, "batch").orderBy(*order)))
    line = F.concat(F.col("_p").cast("string"), F.lit(". `"), F.col("id").cast("string"), F.lit("`"))
    made = placed.groupBy(*by, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    return made.select(*by, "batch", F.concat(F.replace(F.lit(head), F.lit("{n}"), (F.col("batch") + 1).cast("string")), F.lit("\n\n"), F.array_join("lines", "\n")).alias("text"))


def is_recent(at: Column, now: Column, days: int = 7) -> Column:
    """Read so lately that it needn't be read again."""
    return F.coalesce(at > now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def mcp_endpoint(u: Column, probed: Column, llms: Column) -> Column:
    """(url, evidence) of an MCP endpoint: the entry's own URL, a probe, or the first line of its link file that names one; else null."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"[),.;:\]]+$", ""), r"\?.*$", "")
    line = F.get(F.filter(F.split(F.coalesce(llms, F.lit("")), "\n"), lambda x: x.rlike(r"(?i)\bmcp\b") & F.exists(F.regexp_extract_all(x, F.lit(r"https?://[^\s)\"'\]]+"), F.lit(0)), lambda y: clean(y).rlike(r"(?i)/mcp\b|/mcp\.md$|mcp\."))), F.lit(0))
    found = F.get(F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"https?://[^\s)\"'\]]+"), F.lit(0)), clean), lambda y: y.rlike(r"(?i)/mcp\b|/mcp\.md$|mcp\.")), F.lit(0))
    return F.when(u.rlike(r"/mcp\b"), F.struct(u.alias("url"), F.lit("url").alias("evidence"))).when(probed, F.struct(u.alias("url"), F.lit("probe").alias("evidence"))).when(found.isNotNull(), F.struct(found.alias("url"), F.concat(F.lit("llms.txt: "), F.substring(F.trim(line), 1, 120)).alias("evidence")))


def pricing(text: Column) -> Column:
    """freemium or paid by the first plan price in a page's text, null without one."""
    amount = text.rlike(r"(?i)(\$|€|£)\s?\d[\d.,]*\s*(?:/|per\s)\s*(?:mo|month|user|seat|year)")
    free = text.rlike(r"(\$|€|£)\s?0\b") | text.rlike(r"(?i)\bfree\b|no credit card|open source|MIT license|free forever|start for free")
    return F.when(amount, F.when(free, "freemium").otherwise("paid"))


def gated(status: Column, body: Column) -> Column:
    """A refusal, or words of licences and keys in the answer."""
    return (status == 401) | F.coalesce(body, F.lit("")).rlike(r"(?i)licen[cs]e|unauthoriz|unauthorized|authentication|\bapi key\b")


def is_safe_path(p: Column) -> Column:
    """A relative path that stays in its folder."""
    parts = F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/")
    return (p != "") & ~p.rlike(r"^[/\\]|^[A-Za-z]:") & ~F.exists(parts, lambda x: x == "..")


def markdown_digest(c: Column) -> Column:
    """struct(title, headings, text) of a markdown page: three levels of headings, and its text without code, images and markup."""
    src = F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    heading = lambda k: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(src, F.lit(rf"(?m)^#{{{k}}}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "[*_`]", ""))), lambda x: x != ""))
    t = src
    for rx, to in ((r"(?s)<!--.*?-->", " "), (r"(?s)```.*?```", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"(?i)</?[a-z][^>]*>", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*+]\s+", "- "), (r"[*_`]{1,3}", "")):
        t = F.regexp_replace(t, rx, to)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.struct(F.coalesce(F.get(heading(1), F.lit(0)), F.lit("")).alias("title"), F.struct(heading(1).alias("h1"), heading(2).alias("h2"), heading(3).alias("h3")).alias("headings"), F.array_join(F.array_distinct(lines), "\n").alias("text"))


def totals(sites: DataFrame) -> DataFrame:
    """One row over sites (type, status, registry, items): how many there are, with a registry, and items in all; and maps of counts by type and by status."""
    by = lambda c: sites.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))).scalar()  # noqa: E731  kinds are few
    return sites.agg(F.count("*").alias("sites"), F.count_if("registry").alias("with_registry"), F.sum("items").alias("items"), by("type").alias("by_type"), by("status").alias("by_status"))


def dependencies(items: DataFrame) -> DataFrame:
    """(dep, pos): the distinct dependencies of items (pos, deps) in the order in which they are first named."""
    each = items.select("pos", F.posexplode("deps").alias("k", "dep"))
    return each.groupBy("dep").agg(F.min(F.struct("pos", "k")).alias("first"))


def queue_order(entries: DataFrame) -> DataFrame:
    """A queue (id, curated, readable, pos) in the order in which it is worked: curated entries, readable ones, the rest."""
    return entries.withColumn("rank", F.when(F.col("curated"), 0).when(F.col("readable"), 1).otherwise(2)).orderBy("rank", "pos")


def filter_order(rows: DataFrame, prior: Column) -> DataFrame:
    """Rows (name) without a query: by prior, then by name in dictionary order."""
    return rows.withColumn("score", prior).orderBy(F.desc("score"), F.collate(F.lower("name"), "UNICODE"), "id")
