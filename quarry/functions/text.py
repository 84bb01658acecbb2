"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, not only ASCII.
SPACE = r"[\s\x{00a0}\x{feff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    """Words of letters and digits in any script, lower case; camel case and letter/digit borders part words."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    """Words of a-z and 0-9 only, parted like tokens()."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def _ends(w: Column, *ends: str) -> Column:
    return reduce(lambda x, y: x | y, [w.endswith(e) for e in ends])


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def plural(w: Column) -> Column:
    """Search's plural rule: ies to y, -es after a hiss, -s unless ss, us or is. Plain string functions: this runs for every word."""
    return (
        F.when(~w.endswith("s") | _ends(w, "ss", "us", "is"), w)
        .when(w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
        .when(_ends(w, "ches", "shes", "xes", "zes", "sses"), _cut(w, 2))
        .otherwise(_cut(w, 1))
    )


def stem(w: Column) -> Column:
    """Plural rule, then -ation, -ing or -ed off words long enough. Short words and those with digits stay.

    One flat list of endings, so that nothing is computed twice: a plural's ending and the one before it are cut together.
    """
    n = F.length(w)
    digits = F.translate(w, "0123456789", "") != w
    single = ~w.endswith("s") | _ends(w, "ss", "us", "is")
    return (
        F.when((n < 4) | digits, w)
        .when(single, F.when((n > 6) & w.endswith("ation"), _cut(w, 5)).when((n > 5) & w.endswith("ing"), _cut(w, 3)).when((n > 5) & w.endswith("ed"), _cut(w, 2)).otherwise(w))
        .when(w.endswith("ies"), F.concat(_cut(w, 3), F.lit("y")))
        .when(_ends(w, "ches", "shes", "xes", "zes", "sses"), _cut(w, 2))
        .when((n > 7) & w.endswith("ations"), _cut(w, 6))
        .when((n > 6) & w.endswith("ings"), _cut(w, 4))
        .when((n > 6) & w.endswith("eds"), _cut(w, 3))
        .otherwise(_cut(w, 1))
    )


def singular(w: Column) -> Column:
    """The tagger's plural rule, which also cuts -oes."""
    return (
        F.when(F.length(w) < 4, w)
        .when(w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(ss|us|is)$"), w)
        .when(w.rlike("(ch|sh|x|z|ss|o)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def slug(c: Column, most: int = 72) -> Column:
    c = F.regexp_replace(F.lower(c), "^https?://", "")
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(c, 1, most), "-+$", "")


def humanise(c: Column) -> Column:
    """Words of a slug with first letters raised."""
    words = F.filter(F.split(c, "[-_ ]+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def clip(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"\s+$", ""), F.lit("…"))).otherwise(c)


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def near(a: Column, b: Column) -> Column:
    """At most one insertion, deletion or substitution."""
    return F.levenshtein(a, b, 1) >= 0


def non_latin_share(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, 1 - F.regexp_count(c, F.lit(r"\p{IsLatin}")) / letters).otherwise(0.0)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expression replacements, one after the other."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def untrusted(c: Column, tag: str = "untrusted") -> Column:
    """Text from outside in a tag that it cannot close."""
    return F.concat(F.lit(f"<{tag}>\n"), F.regexp_replace(c, f"(?i)</({tag})", "&lt;/$1"), F.lit(f"\n</{tag}>"))


def evidence(c: Column, pattern: str, around: int = 80) -> Column:
    """The first match with up to `around` characters on each side."""
    return F.regexp_extract(c, f"(?is).{{0,{around}}}(?:{pattern}).{{0,{around}}}", 0)


def license_of(c: Column) -> Column:
    """A licence label from text. The labels and what names them."""
    rules = [("MIT", r"\bMIT\b"), ("Apache-2.0", r"\bApache(?: License)?,? (?:Version )?2\.0\b"), ("GPL", r"\bA?GPL(?:v[23])?\b"), ("BSD", r"\bBSD\b"), ("commercial", r"(?i)\bcommercial licen[cs]e\b")]
    return reduce(lambda x, r: F.coalesce(x, F.when(c.rlike(r[1]), F.lit(r[0]))), rules, F.lit(None).cast("string"))


#: Entities that are decoded, by table. The five of XML; those that pages use beside them.
XML = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
PAGE = {
    "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•", "rarr": "→", "larr": "←", "times": "×",
    "euro": "€", "pound": "£", "laquo": "«", "raquo": "»", "zwj": "", "zwnj": "", "shy": "",
}


def entities(c: Column, table: dict[str, str] | None = None) -> Column:
    """Named entities of the table and numeric ones, each decoded once. A text without an ampersand is left alone."""
    known = XML | (PAGE if table is None else table)
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]+|#\d+|[A-Za-z][A-Za-z0-9]*);", 1))
        rest = F.regexp_replace(part, r"^(#[xX][0-9a-fA-F]+|#\d+|[A-Za-z][A-Za-z0-9]*);", "")
        digits = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        point = F.when(digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))
        made = F.when(name.startswith("#"), point).otherwise(names[name])
        return F.when(made.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(made, rest))

    parts = F.split(c, "&")
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)
