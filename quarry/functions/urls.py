"""URL functions as column expressions."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|ref|ref_src|fbclid|gclid|mc_cid|mc_eid)(=|$)"
ASSET = r"(?i)\.(png|jpe?g|gif|svg|webp|ico|css|js|mjs|woff2?|ttf|mp4|webm|zip|pdf)$"
_PARTS = r"^(?i)(https?)://([^/?#\s]+)([^?#\s]*)(?:\?([^#\s]*))?"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 1))


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _PARTS, 2))


def path(u: Column) -> Column:
    return F.regexp_extract(u, _PARTS, 3)


def query(u: Column) -> Column:
    """The query without tracking parameters, its order kept."""
    parts = F.filter(F.split(F.regexp_extract(u, _PARTS, 4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    return F.array_join(parts, "&")


def _bare(u: Column) -> Column:
    """Without the marks that text leaves at a URL's end."""
    return F.regexp_replace(F.trim(u), r"[)\]>*`'\"]+$", "")


def _marked(q: Column) -> Column:
    return F.regexp_replace(q, "^(?=.)", "?")


def normalize(u: Column) -> Column:
    """http(s) URL with a lower-case host, no fragment or tracking, no slash at the end; null if it is none."""
    u = _bare(u)
    return F.when(host(u) != "", F.concat(scheme(u), F.lit("://"), host(u), F.regexp_replace(path(u), "/$", ""), _marked(query(u))))


def site(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def key(u: Column) -> Column:
    """What makes two URLs the same page: host without www, path (lower case on code hosts) and query."""
    u = _bare(u)
    p = F.regexp_replace(path(u), "/$", "")
    p = F.when(site(u) == "github.com", F.lower(p)).otherwise(p)
    return F.when(host(u) != "", F.concat(site(u), p, _marked(query(u))))


def page_key(u: Column) -> Column:
    """key() without the query."""
    return F.regexp_replace(key(u), r"\?.*$", "")


def query_key(u: Column) -> Column:
    """Host without www, path and query as they are: what sitemaps are compared by when URLs are carved out; null if it is no URL."""
    return F.when(host(u) != "", F.concat(site(u), F.regexp_replace(path(u), "/+$", ""), F.when(F.regexp_extract(u, _PARTS, 4) != "", F.concat(F.lit("?"), F.regexp_extract(u, _PARTS, 4))).otherwise("")))


def listed_key(u: Column) -> Column:
    """The URL without its fragment and without a slash at its end; its query stays, and its host in lower case."""
    bare = F.regexp_replace(u, "#.*$", "")
    return F.when(host(u) != "", F.regexp_replace(F.concat(scheme(bare), F.lit("://"), host(bare), F.regexp_replace(bare, r"^(?i)https?://[^/?#\s]+", "")), "/$", ""))


def sitemap_key(u: Column) -> Column:
    """page_key() decoded, lower case, without an .html ending."""
    k = page_key(u)
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(k), k), r"(/index)?\.html?$", ""))


def segments(u: Column) -> Column:
    """Decoded path segments; a bad escape leaves its segment as it is."""
    return F.transform(F.filter(F.split(path(u), "/"), lambda x: x != ""), lambda x: F.coalesce(F.try_url_decode(x), x))


def is_asset(u: Column) -> Column:
    return path(u).rlike(ASSET)


def is_public(h: Column) -> Column:
    """Not a local name, and not an address of a private, loopback, link-local or shared range."""
    n = F.transform(F.split(h, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b = F.get(n, F.lit(0)), F.get(n, F.lit(1))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    named = h.contains(".") & ~h.rlike(r"(?i)(^|\.)(localhost|local|internal|lan|home|test|invalid)$")
    return F.when(h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~F.coalesce(private, F.lit(False))).otherwise(named & ~h.startswith("["))


def follows(u: Column, own: Column) -> Column:
    """May be followed: https, default port, no user, public host, own site."""
    h = host(u)
    return (scheme(u) == "https") & ~h.contains("@") & (~h.contains(":") | h.endswith(":443")) & is_public(F.regexp_replace(h, ":443$", "")) & (site(u) == own)


def suffixes(h: Column) -> Column:
    """A host and all its parents, for an equi-join with a list of hosts."""
    p = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, 1 << 20), "."))


def repair(loc: Column, own: Column) -> Column:
    """A sitemap location without a host gets the site's."""
    return F.when(loc.rlike("^(?i)https?://[^/]"), loc).when(loc.startswith("//"), F.concat(F.lit("https:"), loc)).otherwise(F.concat(F.lit("https://"), own, F.lit("/"), F.regexp_replace(loc, "^(?i)(https?:)?/*", "")))


def with_page(u: Column, param: str, n: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(u, f"([?&]){param}=[^&#]*&?", "$1"), "[?&]$", "")
    return F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit(f"{param}="), n.cast("string"))


def item_bases(base: Column, name: Column) -> Column:
    """Where a registry may keep an item. The layouts."""
    layouts = ["r/{}.json", "registry/{}.json", "r/styles/default/{}.json", "r/styles/new-york/{}.json", "registry/styles/default/{}.json", "registry/styles/new-york/{}.json", "public/r/{}.json", "api/registry/{}.json", "api/r/{}.json"]
    root = F.regexp_replace(base, "/+$", "")
    return F.array_distinct(F.array(*[F.concat(root, F.lit("/" + a), name, F.lit(b)) for a, b in (x.split("{}") for x in layouts)]))


def template(pattern: str) -> str:
    """A path template as a Java regular expression with named groups: {name}, {author}, {element}, {n} and {*} each stand for one segment or part of it."""
    kinds = {"n": r"\d+", "*": "[^/]+"}
    out = []
    for part in re.split(r"(\{[^}]+\})", pattern.strip("/")):
        if part.startswith("{"):
            k = part[1:-1]
            out.append(kinds[k] if k in kinds else f"(?<{k}>[^/]+)")
        else:
            out.append(re.escape(part))
    return "^/?" + "".join(out) + "/?$"


def match(p: Column, patterns: list[str], group: str = "name") -> Column:
    """The group's text in the first template that matches the path, else null."""
    found = []
    for t in patterns:
        rx = template(t)
        names = re.findall(r"\(\?<(\w+)>", rx)
        found.append(F.when(p.rlike(rx), F.regexp_extract(p, rx, names.index(group) + 1) if group in names else F.lit("")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def resolve(base: Column, link: Column) -> Column:
    """A relative link as an absolute URL (Arrow-batched Python: no built-in does this)."""
    @F.pandas_udf("string")
    def join(b: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return urljoin(x, y) if x is not None and y is not None else None
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(b, r, strict=True)], dtype=object)

    return join(base, link)


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


#: A name that no registry has, for soft-404 probes.
NO_SUCH_NAME = "no-such-item-zq7"


def _encoded(name: Column) -> Column:
    parts = F.split(name, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.when(~bad, F.array_join(F.transform(parts, lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))), "/"))


def candidates(name: Column, templates: list[str]) -> Column:
    """A name in each URL template that has {name}; none for a name with an empty part or one that leaves its folder."""
    filled = _encoded(name)
    return F.coalesce(F.when(filled.isNotNull(), F.array_distinct(F.array(*[F.replace(F.lit(t), F.lit("{name}"), filled) for t in templates]))), F.array().cast("array<string>"))


def probe(name: Column, template: str) -> Column:
    """The same with the name's last part replaced by one that no site has; null where candidates() has none."""
    other = F.regexp_replace(name, r"[^/]+$", NO_SUCH_NAME)
    return F.when(_encoded(name).isNotNull(), F.replace(F.lit(template), F.lit("{name}"), _encoded(other)))
