"""Names, keywords and stack labels as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import urls

#: Title parts that name nothing, and what parts a title.
GENERIC = r"(?i)^(home|homepage|welcome|index|untitled|loading|official site|official website|website)$"
FAILED = r"(?i)unavailable|not available|not found|^404\b|^error\b|^oops\b|access denied|just a moment"
SEPARATOR = r"\s+[|·•–—/-]\s+|\s*:\s+"

#: Words whose s at the end is no plural, and plurals that no rule covers.
KEEP_END = r"(ss|us|is|as|os|ics|js|ous|news|series|species)$"
KEEP = ["docs", "sales", "postgres", "kubernetes", "aws", "less", "express", "lens", "plus", "yes"]
PLURALS = {"menus": "menu", "emojis": "emoji", "canvases": "canvas", "statuses": "status", "lenses": "lens", "indices": "index"}

#: Spellings of one stack.
STACKS = {
    "tailwindcss": "tailwind", "tailwind css": "tailwind", "next.js": "nextjs", "next": "nextjs", "vue.js": "vue", "vuejs": "vue", "react.js": "react", "reactjs": "react", "react native": "react-native",
    "threejs": "three.js", "three": "three.js", "framer motion": "framer-motion", "motion": "framer-motion", "motion/react": "framer-motion", "radix-ui": "radix", "svelte kit": "sveltekit", "angular.js": "angular",
    "typescript": "typescript", "ts": "typescript", "shadcn/ui": "shadcn", "shadcn ui": "shadcn", "radix ui": "radix", "node.js": "node", "nodejs": "node", "html5": "html", "css3": "css",
}


def nfkc(c: Column) -> Column:
    """Unicode compatibility form (Arrow-batched Python: no built-in does this)."""
    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return form(c)


def nfkc_native(c: Column) -> Column:
    """As nfkc(), by the ICU library that Spark brings, and only for texts that aren't ASCII. To be selected before it is used:
    Spark takes a Java method for random and makes it again wherever it is named."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def head_singular(w: Column) -> Column:
    """Singular of one word where its ending says so; short words, words with digits and the kept ones stay."""
    irregular = reduce(lambda x, p: x.when(w == p[0], p[1]), PLURALS.items(), F.when(F.lit(False), ""))
    less = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    regular = (
        F.when((F.length(w) < 4) | w.rlike(r"\d") | w.rlike(KEEP_END) | w.isin(KEEP), w)
        .when(w.endswith("ies") & (F.length(w) > 5) & ~w.rlike("(movies|cookies)$"), F.concat(less(3), F.lit("y")))
        .when(w.rlike("(ch|sh|x|z|ss|o)es$"), less(2))
        .when(w.rlike("[^s']s$"), less(1))
        .otherwise(w)
    )
    return F.coalesce(irregular, regular)


def keyword(c: Column) -> Column:
    """Lower case, one space between words, bare ends, the last word singular; null counts as empty."""
    return keyword_of_form(nfkc(F.coalesce(c, F.lit(""))))


def keyword_of_form(c: Column) -> Column:
    """keyword() of a text in compatibility form."""
    s = F.regexp_replace(F.lower(c), r"[_\s]+", " ")
    s = F.trim(F.regexp_replace(s, r"^[^\p{L}\p{N}#.+]+|[^\p{L}\p{N}#+]+$", ""))
    last = F.regexp_extract(s, r"([\p{L}\p{N}.+#']+)$", 1)
    return F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(last)), head_singular(last))


def spelling(c: Column) -> Column:
    """What spellings of one keyword share: its letters and digits."""
    return F.regexp_replace(keyword(c), r"[^\p{L}\p{N}]+", "")


def stacks(names: Column) -> Column:
    """Stack names in one spelling each, the first of equal ones."""
    plain = F.split(nfkc(F.array_join(names, "\x01")), "\x01")
    plain = F.filter(F.transform(plain, lambda x: F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")), lambda x: x != "")
    known = F.create_map(*[F.lit(v) for p in STACKS.items() for v in p])
    return F.array_distinct(F.transform(plain, lambda x: F.coalesce(F.element_at(known, x), F.replace(x, F.lit(" "), F.lit("-")))))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def is_placeholder(name: Column, domain: Column) -> Column:
    """Empty, or a host or URL."""
    n = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    return (n == "") | (n == domain) | (n == F.concat(F.lit("www."), domain)) | n.rlike(r"^https?:|^[\w.-]+\.[a-z]{2,}(/\S*)?$")


def title_parts(title: Column) -> Column:
    """Parts of a page title that can name something."""
    parts = F.transform(F.split(F.coalesce(title, F.lit("")), SEPARATOR), lambda x: F.trim(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N})]+$", "")))
    return F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.rlike(GENERIC) & ~x.rlike(FAILED))


def brand(parts: Column, domain: Column) -> Column:
    """The first short part that a label of the domain holds or begins with, else null."""
    labels = F.split(domain, r"\.")
    labels = F.filter(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (F.length(x) >= 3) & (x != "www"))
    near = lambda p, s: p.contains(s) | s.startswith(p)
    ours = F.filter(parts, lambda p: (F.length(p) <= 40) & (F.length(_bare(p)) >= 3) & F.exists(labels, lambda s: near(_bare(p), _bare(s))))
    return F.get(ours, F.lit(0))


def path_name(url: Column, owner: Column) -> Column:
    """The last path segment as words with (owner) after them; null where it isn't words."""
    last = F.coalesce(F.try_element_at(urls.segments(url), F.lit(-1)), F.lit(""))
    last = F.trim(F.regexp_replace(F.regexp_replace(last, r"(?i)\.[a-z0-9]{2,5}$", ""), r"[-_+]+", " "))
    words = F.length(last).between(3, 60) & last.rlike("(?i)[a-z]{3}") & ~F.replace(last, F.lit(" "), F.lit("")).rlike(r"(?i)^[\da-f]{8,}$")
    return F.when(words, F.concat(F.upper(F.substring(last, 1, 1)), F.substring(last, 2, 1 << 30), F.lit(" ("), owner, F.lit(")")))


def display_name(name: Column, kind: Column, url: Column, domain: Column, title: Column) -> Column:
    """A given name unless it is a host; owner/repo; the title's brand (sites), its first other part or the path (pages)."""
    parts = title_parts(title)
    b = brand(parts, domain)
    owner = F.coalesce(b, domain)
    first = F.get(F.filter(parts, lambda x: F.coalesce(x != b, F.lit(True)) & (F.length(x) <= 60)), F.lit(0))
    repo = F.regexp_extract(url, r"^https?://github\.com/([^/]+/[^/?#]+)", 1)
    page = F.coalesce(F.concat(first, F.lit(" ("), owner, F.lit(")")), path_name(url, owner))
    made = F.when((kind == "repo") & (repo != ""), repo).when(kind == "site", b).when(kind == "page", page)
    return F.when(is_placeholder(name, domain), F.coalesce(made, name)).otherwise(name)


def without_site(title: Column, site_names: list[str]) -> Column:
    """A title without the site's own segments at its end."""
    parts = F.split(title, SEPARATOR)
    ours = F.array(*[F.lit(s.lower()) for s in site_names])
    kept = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: ~F.array_contains(ours, F.lower(F.element_at(parts, i))))
    stop = F.greatest(F.coalesce(F.array_max(kept), F.lit(1)), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), stop), " - ")


def clip_bytes(c: Column, most: int) -> Column:
    """The longest beginning whose UTF-8 form, with an ellipsis where cut, has at most `most` (3 or more) bytes."""
    raw = c.cast("binary")
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")  # noqa: E731  byte k + 1 continues a character
    head = F.lit("")
    for k in range(max(most - 6, 1), most - 2):
        head = F.when(~inside(k), F.decode(F.substring(raw, 1, k), "UTF-8")).otherwise(head)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(head, F.lit("…")))


def cut_at_line(c: Column, most: int) -> Column:
    """At most `most` characters, ended at the last line end if that keeps over 70 % of them."""
    head = F.substring(c, 1, most)
    line = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    return F.when(F.length(c) <= most, c).when(F.length(line) > int(most * 0.7), line).otherwise(head)


def short_desc(desc: Column, name: Column, domain: Column, most: int = 100) -> Column:
    """A description without the title that it begins with where that only repeats the name or domain; at most `most` characters."""
    d = F.trim(F.regexp_replace(F.coalesce(desc, F.lit("")), "^GitHub - [^:]{1,60}:\\s*", ""))
    marks = [" — ", " – ", " - ", " / ", ": "]
    first = F.get(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.instr(d, m) > 1), F.lit(0))
    lead = _bare(F.split_part(d, F.coalesce(first, F.lit("\x01")), F.lit(1)))
    site = _bare(F.split_part(domain, F.lit("."), F.lit(1)))
    repeats = first.isNotNull() & (lead != "") & (_bare(name).startswith(lead) | lead.startswith(site) | _bare(domain).startswith(lead))
    rest = F.trim(F.substring(d, F.instr(d, first) + F.length(first), F.length(d)))
    out = F.when(F.coalesce(repeats, F.lit(False)), rest).otherwise(d)
    return F.when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most - 3)), F.lit("…"))).otherwise(out)
