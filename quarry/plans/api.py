"""The query API: eight calls over a catalog of entries and items. Each returns a DataFrame.

An unknown element, category or reference is a ValueError that says what is known.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.operators import gates, index, pages, phrases, reports, search, sections


class Catalog:
    """entries: id, name, url, domain, kind, desc, about, categories, elements, mentions. items: id, parent, name, slug, url, description,
    elements, variants, access, granularity, type, stacks. contents: doc (entry id), text. Missing columns are null."""

    COLUMNS = {
        "id": "string", "name": "string", "url": "string", "domain": "string", "kind": "string", "desc": "string", "about": "string", "categories": "array<string>", "elements": "array<string>", "mentions": "int",
        "parent": "string", "slug": "string", "description": "string", "variants": "map<string,array<string>>", "access": "string", "granularity": "string", "type": "string", "stacks": "array<string>", "install_url": "string",
        "local": "boolean", "auto": "boolean", "readable": "boolean", "record": "boolean",
    }

    def __init__(self, entries: DataFrame, items: DataFrame, contents: DataFrame | None = None, synonyms: DataFrame | None = None, vocabulary: phrases.Vocabulary | None = None) -> None:
        self.spark: SparkSession = entries.sparkSession
        full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in self.COLUMNS.items()])
        self.entries, self.contents, self.vocabulary = full(entries), contents, vocabulary
        self.items = full(items).withColumn("kind", F.lit("item"))
        self.synonyms = synonyms if synonyms is not None else self.spark.createDataFrame([], "term string, alt_terms array<string>")

    @cached_property
    def all(self) -> DataFrame:
        return self.entries.unionByName(self.items)

    @cached_property
    def postings(self) -> DataFrame:
        joined = self.all.withColumn("element", F.array_join("elements", " ")).withColumn("category", F.array_join("categories", " ")).withColumn("variant", F.array_join(F.flatten(F.map_values("variants")), " ")).withColumn("text", F.coalesce("desc", "description"))
        pairs = F.flatten(F.transform(F.map_entries("variants"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit("/"), v))))
        tags = [("element", "el", F.col("elements")), ("category", "cat", F.col("categories"))] + ([("variant", "va", pairs)] if self.vocabulary else [])
        return index.postings(joined, "id", {"name": "name", "element": "element", "variant": "variant", "description": "text", "about": "about", "category": "category", "domain": "domain"}, tags).persist()

    @cached_property
    def idf(self) -> DataFrame:
        """From all documents, whatever a query filters."""
        return index.idf(self.postings, self.all.count()).persist()

    @cached_property
    def priors(self) -> DataFrame:
        """(id, prior): what a result is worth before the query; entries that have items are mapped."""
        mapped = self.items.select(F.col("parent").alias("id")).distinct().withColumn("_mapped", F.lit(True))
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        p = search.prior(F.col("kind"), F.col("access"), yes("local"), yes("auto"), yes("_mapped"), F.coalesce("readable", F.lit(True)), yes("record"))
        return self.all.join(mapped, "id", "left").select("id", p.alias("prior")).dropDuplicates(["id"])

    def _ranked(self, query: str | None, rows: DataFrame) -> DataFrame:
        """rows (already filtered) with their score: the prior alone without a query, else what matches, and what the query names just above."""
        rows = rows.join(self.priors, "id")
        if not query:
            return rows.withColumnRenamed("prior", "score")
        asked = self.spark.createDataFrame([(query,)], "q string")
        concepts = phrases.analyse(asked, self.vocabulary, self.idf.select("term")) if self.vocabulary else search.analyse(asked, self.synonyms)
        hits = search.score(self.postings, self.idf, concepts).withColumnRenamed("doc", "id")
        hits = hits.join(rows.select("id", "prior"), "id").select("q", F.col("id").alias("doc"), (F.col("score") * F.col("prior")).alias("score"))
        hits = search.boost(hits, rows.where("kind <> 'item'").withColumnRenamed("id", "doc"))
        return rows.drop("prior").join(hits.select(F.col("doc").alias("id"), "score"), "id")

    def _page(self, rows: DataFrame, limit: int, offset: int, most: int) -> DataFrame:
        if not 0 < limit <= most or not 0 <= offset <= 5000:
            raise ValueError(f"limit must be 1 to {most}, offset 0 to 5000")
        return rows.orderBy(F.desc("score"), F.collate(F.lower("name"), "UNICODE"), "id").offset(offset).limit(limit)

    def _known(self, column: str, value: str | None) -> None:
        if value is not None:
            known = self.all.select(F.explode(column).alias("v")).distinct()
            if known.where(F.col("v") == value).isEmpty():
                raise ValueError(f"{column}: {value} is not known; known are {', '.join(r.v for r in known.orderBy('v').limit(100).collect())}")

    def _hits(self, query, element=None, category=None, kind=None, variant=None) -> DataFrame:
        self._known("elements", element)
        self._known("categories", category)
        return self._ranked(query, self.all.where(search.passes(kind=kind, category=category, element=element, variant=variant)))

    def search(self, query: str | None = None, element=None, category=None, kind=None, variant=None, limit: int = 20, offset: int = 0) -> DataFrame:
        """Entries and items together, by rank."""
        return self._page(self._hits(query, element, category, kind, variant), limit, offset, 60)

    def search_groups(self, query: str | None = None, element=None, category=None, kind=None, variant=None, limit: int = 10) -> DataFrame:
        """(grp, place, id, name, url, score, also): an answer of ``limit`` hits in groups. Equal components are one hit; each group's strong
        leader comes in first, then strong hits within the group's cap, then what is left by rank."""
        if not 0 < limit <= 60:
            raise ValueError("limit must be 1 to 60")
        rows = self._hits(query, element, category, kind, variant).withColumn("grp", search.answer_group(F.col("kind"), F.col("access"), F.col("granularity")))
        own = F.when(F.col("kind") == "item", F.concat_ws("\x01", F.lower(F.coalesce("slug", "name")), F.array_join(F.array_sort("elements"), ","))).otherwise(F.concat(F.lit("\x02"), "id"))
        one = search.collapse(rows.withColumn("_key", own), ["grp", "_key"], [F.desc("score"), F.col("id")], "id")
        shown = search.capped_fill(one.select("grp", F.col("id").alias("doc"), "score"), limit, search.answer_caps(limit), limit)
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "id"))  # of limit rows
        return shown.select(F.col("doc").alias("id")).join(one, "id").select("grp", place.alias("place"), "id", "name", "url", "score", "also")

    def counts(self, query: str | None = None, **filters) -> DataFrame:
        """One row: how many hits are resources, components, gallery examples and docs pages."""
        return gates.group_counts(self._hits(query, **filters))

    def close(self) -> None:
        """Gives back what the index keeps on the executors."""
        for kept in ("postings", "idf"):
            if kept in self.__dict__:
                self.__dict__.pop(kept).unpersist()

    def facets(self, element: str) -> DataFrame:
        return search.facets(self.items, element)

    def search_items(self, query: str | None = None, element=None, variant=None, registry=None, access=None, stack=None, limit: int = 20) -> DataFrame:
        """Items; equal components of several registries are one row, the other ids in also."""
        self._known("elements", element)
        rows = self._ranked(query, self.items.where(search.passes(element=element, variant=variant, registry=registry, access=access, stack=stack)))
        rows = rows.withColumn("_key", F.lower(F.coalesce("slug", "name"))).withColumn("_e", F.array_join(F.array_sort("elements"), ","))
        return self._page(search.collapse(rows, ["_key", "_e"], [F.desc("score"), F.col("id")], "id").drop("_key", "_e"), limit, 0, 50)

    def resolve(self, ref: str) -> str:
        got = search.resolve(self.spark.createDataFrame([(ref,)], "ref string"), self.entries).first()
        if got.id is None:
            near = self.entries.where(F.lower("name").contains(ref.lower()) | F.col("domain").contains(ref.lower())).orderBy(F.desc("mentions"), "name").limit(10).collect()
            raise ValueError(f"{ref} names {'several entries' if got.candidates > 1 else 'no entry'}; near: {', '.join(r.id for r in near)}")
        return got.id

    def list_pages(self, ref: str, query: str | None = None, element=None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self._ranked(query, self.items.where((F.col("parent") == self.resolve(ref)) & search.passes(element=element)))
        return self._page(rows, limit, offset, 300)

    def site_urls(self, pages: DataFrame, ref: str, query: str | None = None, element: str | None = None, aliases: list[str] = (), limit: int = 50, offset: int = 0) -> DataFrame:
        """URLs of an entry's sitemap, pages (domain, pos, url), whose path holds a word of the query or a name of the element; all without either."""
        own = self.entries.where(F.col("id") == self.resolve(ref)).select(F.regexp_replace("domain", r"^www\.", "").alias("domain"))
        rows = pages.join(own, "domain", "left_semi")
        if words := gates.needles(query, element, aliases):
            rows = rows.where(gates.named_by_path(F.col("url"), words))
        return rows.orderBy("pos").offset(offset).limit(limit).select("url")

    def closest(self, ref: str, most: int = 3) -> list[str]:
        """Ids of items with code that a wrong item id may have meant: of its registry, else of any."""
        key = ref.strip().lower().rstrip("/")
        registry, _, name = key.rpartition("/")
        name = " ".join(gates.needles(name))
        if not name:
            return []
        known = self.entries.where(F.col("id") == registry).select("id").collect() if registry else []
        for parent in [*(r.id for r in known), None]:
            rows = self.items.where("access = 'code'")
            got = self._page(self._ranked(name, rows.where(F.col("parent") == parent) if parent else rows), most, 0, 50).collect()
            if got:
                return [r.id for r in got]
        return []

    def get(self, ref: str, most: int = 2000) -> DataFrame:
        """One entry as JSON, its fields fewer until it fits."""
        e = self.entries.where(F.col("id") == self.resolve(ref))
        tiers = [F.to_json(F.struct(*c)) for c in (self.entries.columns, ["id", "name", "url", "kind", "desc", "categories", "elements"], ["id", "name", "url", "kind", "desc"], ["id", "name", "url"])]
        return e.select("id", reports.smallest_tier(tiers, most).alias("record"))

    def list_registry(self, ref: str, query: str | None = None, type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        """Items of a registry whose name or description holds every word."""
        rows = self.items.where(F.col("parent") == self.resolve(ref)).withColumn("score", F.lit(0.0))
        if type:
            rows = rows.where(F.col("type") == (type if ":" in type else f"registry:{type}"))
        hay = F.lower(F.concat_ws(" ", "name", "description"))
        for w in (query or "").lower().split():
            rows = rows.where(hay.contains(w))
        return self._page(rows, limit, offset, 300)

    def content(self, ref: str, query: str | None = None, section: int | None = None, whole: int = 12_000) -> DataFrame:
        """Sections of an entry's document: one, the best for a query, all if it is short, or the outline without text."""
        doc = self.contents.where(F.col("doc") == self.resolve(ref)).select(F.xxhash64("doc").alias("doc"), "text")
        parts = sections.split(doc).join(doc, "doc").withColumn("part", F.expr("substring(text, start + 1, end - start)"))
        if section is not None:
            return parts.where(F.col("n") == section).select("n", "title", "path", "part")
        if query:
            words = self.spark.createDataFrame([(query,)], "q string").select(F.transform(text.tokens(F.col("q")), text.stem).alias("w")).first().w
            if self.vocabulary:
                concepts = phrases.for_sections(phrases.analyse(self.spark.createDataFrame([(query,)], "q string"), self.vocabulary), self.vocabulary)
                ranked = sections.rank_headed(parts.select("doc", "n", "title", "path", F.col("part").alias("text")), concepts)
                return parts.join(ranked, ["doc", "n"]).orderBy(F.desc("score"), "n").limit(5).select("n", "title", "path", "part", "score")
            ranked = sections.rank(parts.select("doc", "n", F.col("part").alias("text")), sorted(set(words)))
            return parts.join(ranked, ["doc", "n"]).orderBy(F.desc("score"), "n").limit(5).select("n", "title", "path", "part", "score")
        return parts.select("n", "title", "path", F.when(F.length("text") <= whole, F.col("part")).alias("part")).orderBy("n")

    def outline(self, ref: str, budget: int = 7000) -> DataFrame:
        """The titles of an entry's document, down to the level that fits the budget of bytes."""
        doc = self.contents.where(F.col("doc") == self.resolve(ref)).select(F.xxhash64("doc").alias("doc"), "text")
        return pages.outline(sections.split(doc), doc, budget).select("depth", "listed", "text")

    def component(self, sources: DataFrame, ref: str, name: str, offset: int = 0, size: int = 20_000) -> DataFrame:
        """A window of a component's source files (parent, name, path, content), joined in path order."""
        f = sources.where((F.col("parent") == self.resolve(ref)) & (F.lower("name") == name.lower()))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: F.concat(F.lit("// "), x["path"], F.lit("\n"), x["content"])), "\n\n")
        return f.groupBy("parent", "name").agg(whole.alias("w")).select("parent", "name", reports.window_of(F.col("w"), offset, size).alias("source")).select("parent", "name", "source.part", "source.next_offset")

    def install_plan(self, ids: list[str], manager: str = "npm") -> DataFrame:
        """(id, command, skipped): how each item is installed, or why it can't be. The runners."""
        if not 0 < len(ids) <= 25:
            raise ValueError("1 to 25 ids")
        run = {"npm": "npx", "pnpm": "pnpm dlx", "yarn": "yarn dlx", "bun": "bunx --bun"}[manager]
        asked = self.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id string, pos int")
        got = asked.join(self.items.drop("kind"), "id", "left")
        why = F.when(F.col("name").isNull(), "unknown").when(F.col("access") == "page", "page").when(F.col("access") == "gated", "gated").when(F.col("install_url").isNull(), "no-registry")
        return got.select("id", "pos", F.when(why.isNull(), F.concat(F.lit(f"{run} shadcn@latest add "), F.col("install_url"))).alias("command"), why.alias("skipped")).orderBy("pos").drop("pos")
