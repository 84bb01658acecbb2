"""Tagging by alias spans, and classification by labels, texts and a default."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ascii_tokens, singular
from quarry.operators.sizes import small

#: A small vocabulary; any table of this shape may be given instead.
ALIASES = [
    ("button", "button", False, False), ("navbar", "navbar", False, False), ("navbar", "navigation bar", False, False), ("modal", "modal", False, False), ("modal", "alert dialog", False, False), ("modal", "dialog", False, False),
    ("footer", "footer", False, False), ("pricing", "pricing", False, False), ("card", "card", False, False), ("pricing", "pricing card", False, False), ("menu", "menu", True, False), ("dock", "dock", False, False), ("mind-map", "mind map", False, True),
]
SCHEMA = "element string, alias string, weak boolean, exclude boolean"


def alias_tokens(aliases: DataFrame) -> DataFrame:
    """(alias_id, element, weak, exclude, k, tok, size); alias words are not made singular, text words are."""
    t = aliases.withColumn("alias_id", F.xxhash64("element", "alias")).withColumn("t", ascii_tokens(F.col("alias")))
    return t.select("alias_id", "element", "weak", "exclude", F.size("t").alias("size"), F.posexplode("t").alias("k", "tok"))


def spans(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, element, weak, exclude, start, stop) of each alias found in texts (id, text). A small vocabulary is broadcast."""
    words = texts.select("id", F.posexplode(ascii_tokens(F.col("text"))).alias("pos", "raw"))
    forms = words.select("id", "pos", F.explode(F.array_distinct(F.array("raw", singular(F.col("raw"))))).alias("tok"))
    met = forms.join(small(alias_tokens(aliases)), "tok").withColumn("start", F.col("pos") - F.col("k"))
    whole = met.groupBy("id", "alias_id", "element", "weak", "exclude", "size", "start").agg(F.countDistinct("k").alias("n")).where("n = size and start >= 0")
    return whole.select("id", "element", "weak", "exclude", "start", (F.col("start") + F.col("size")).alias("stop"))


def elements(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, element): spans that no exclusion of the element covers, no longer span of another element contains,
    that don't start after "with"; a weak alias only counts where there is no strong span of another element."""
    s = spans(texts, aliases)
    stop = texts.select("id", F.array_position(ascii_tokens(F.col("text")), "with").alias("w"))
    own, other = s.where("not exclude").alias("s"), s.alias("o")
    inside = (F.col("o.start") <= F.col("s.start")) & (F.col("o.stop") >= F.col("s.stop"))
    longer = (F.col("o.stop") - F.col("o.start")) > (F.col("s.stop") - F.col("s.start"))
    covered = (F.col("s.id") == F.col("o.id")) & inside & ((F.col("o.exclude") & (F.col("o.element") == F.col("s.element"))) | (~F.col("o.exclude") & (F.col("o.element") != F.col("s.element")) & longer))
    kept = own.join(other, covered, "left_anti").join(stop, "id").where((F.col("w") == 0) | (F.col("start") < F.col("w") - 1))
    strong = kept.where("not weak").select("id", F.col("element").alias("e")).distinct()
    weak = kept.where("weak").join(strong, "id", "left_anti")
    return kept.where("not weak").select("id", "element").union(weak.select("id", "element")).distinct()


def categorize(rows: DataFrame, labels: DataFrame, words: DataFrame, default: str) -> DataFrame:
    """(id, categories): up to two by label in order; else by the first word of the text that names one; else the default.

    rows (id, labels array, text), labels (label, category), words (word, category).
    """
    each = rows.select("id", F.posexplode("labels").alias("pos", "label")).join(small(labels), "label")
    first = each.groupBy("id", "category").agg(F.min("pos").alias("pos"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos", "category"))).where("r <= 2")
    by_label = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category"))), lambda x: x["category"]).alias("by_label"))
    said = rows.select("id", F.posexplode(ascii_tokens(F.col("text"))).alias("pos", "word")).join(small(words), "word")
    by_text = said.groupBy("id").agg(F.min(F.struct("pos", "category")).alias("t"))
    out = rows.select("id").join(by_label, "id", "left").join(by_text, "id", "left")
    return out.select("id", F.coalesce("by_label", F.when(F.col("t").isNotNull(), F.array("t.category")), F.array(F.lit(default))).alias("categories"))


def tag_items(items: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, element) of items (id, registry, name, title, type, asset): what an override (registry, name, elements) says, else what name and title
    name; hooks, styles and the like, icons and items of asset libraries have none."""
    from quarry.operators import gates

    o = overrides.select("registry", "name", F.col("elements").alias("_fixed"))
    r = items.join(o, ["registry", "name"], "left")
    fixed = r.where("_fixed is not null").select("id", F.explode("_fixed").alias("element"))
    free = r.where("_fixed is null").where(gates.is_taggable(F.col("type"), F.col("name"), F.col("asset")))
    texts = free.select(F.struct("id", F.lit(0).alias("part")).alias("id"), F.col("name").alias("text")).union(free.select(F.struct("id", F.lit(1).alias("part")), "title"))
    found = elements(texts.where("text is not null"), aliases).select(F.col("id.id").alias("id"), "element").distinct()
    return fixed.union(found)


def merge(tags: DataFrame) -> DataFrame:
    """(id, elements, kinds) of tags (id, pos, element, variants): an item's elements in the order in which they are found, and the kinds of all of them."""
    first = tags.groupBy("id", "element").agg(F.min("pos").alias("pos"))
    els = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "element"))), lambda x: x["element"]).alias("elements"))
    kinds = tags.select("id", F.explode("variants").alias("v")).groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("kinds"))
    return els.join(kinds, "id", "left").select("id", "elements", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


#: Elements that ordinary prose names too often, categories of interface resources, the length of a short note.
NOISY = ["team", "features", "ai-agent-ui", "cursor", "map", "list", "select", "404", "command-palette", "switch", "contact", "stats", "changelog", "timeline", "form", "input", "banner", "alert", "pagination"]
RESOURCES = ["components", "sections", "inspiration", "templates", "motion", "layout", "color-effects", "registries"]
SHORT_NOTE = 100


def variants(texts: DataFrame, aliases: DataFrame, variant_aliases: DataFrame) -> DataFrame:
    """(id, element, variant) for texts (id, text): aliases of variants (element, variant, alias) that lie in no alias of their element."""
    own = spans(texts, aliases.where("not weak and not exclude"))
    key = F.concat_ws("\x01", "element", "variant")
    v = spans(texts, variant_aliases.select(key.alias("element"), "alias", F.lit(False).alias("weak"), F.lit(False).alias("exclude")))
    v = v.select("id", F.split("element", "\x01")[0].alias("element"), F.split("element", "\x01")[1].alias("variant"), "start", "stop").alias("v")
    within = (F.col("o.id") == F.col("v.id")) & (F.col("o.element") == F.col("v.element")) & (F.col("o.start") <= F.col("v.start")) & (F.col("o.stop") >= F.col("v.stop"))
    return v.join(own.alias("o"), within, "left_anti").select("id", "element", "variant").distinct()


def hints(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, element, strong) of entries (id, name, desc, labels, categories, about, note): strong where name and description name it,
    else where a label does or, for interface resources, the about text or a short note. The entry's own name is cut out of texts."""
    quoted = F.concat(F.lit(r"(?i)\Q"), F.replace("name", F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    bare = lambda c: F.when(F.coalesce("name", F.lit("")) != "", F.regexp_replace(F.coalesce(c, F.lit("")), quoted, F.lit(" "))).otherwise(F.coalesce(c, F.lit("")))
    resource = F.coalesce(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in RESOURCES])), F.lit(False))
    main = F.concat(F.lower(F.coalesce("name", F.lit(""))), F.lit(" | "), bare(F.col("desc")))
    about = F.when(resource & ~F.col("about").eqNullSafe(F.col("desc")), bare(F.col("about")))
    note = F.when(resource & (F.length("note") <= SHORT_NOTE), bare(F.col("note")))
    told = F.array_compact(F.concat(F.array(main), F.transform(F.coalesce("labels", F.array().cast("array<string>")), bare), F.array(about, note)))
    texts = rows.select("id", F.posexplode(told).alias("part", "text")).select(F.struct("id", "part").alias("id"), "text")
    found = elements(texts, aliases).groupBy(F.col("id.id").alias("id"), "element").agg(F.bool_or(F.col("id.part") == 0).alias("strong"))
    return found.where(F.col("strong") | ~F.col("element").isin(NOISY))
