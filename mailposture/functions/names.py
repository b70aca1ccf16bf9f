"""Column functions that turn place names into domain slugs and compare them with domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import strip


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), pairs, c)


def bare_name(name: Column) -> Column:
    """Lower-case name without parenthesised parts."""
    text = strip(F.lower(name))
    return F.when(F.contains(text, F.lit("(")), F.regexp_replace(text, r"\s*\(.*?\)\s*", "")).otherwise(text)


def german(c: Column, sharp_s: bool = True) -> Column:
    pairs = [("ä", "ae"), ("ö", "oe"), ("ü", "ue")] + ([("ß", "ss")] if sharp_s else [])
    return _replace_all(c, pairs)


def french(c: Column) -> Column:
    return F.translate(c, *dims.FRENCH_ACCENTS)


def slug(c: Column) -> Column:
    """Quotes dropped, every run of other characters a dash, no dash at the ends."""
    return F.btrim(F.regexp_replace(F.translate(c, "'’`", ""), r"[^a-z0-9]+", "-"), F.lit("-"))


def dashless(c: Column) -> Column:
    return F.replace(c, F.lit("-"), F.lit(""))


def _distinct(*slugs: Column) -> Column:
    # Array functions without a lambda: they are compiled, and repeated slugs are evaluated once.
    return F.array_distinct(F.array_remove(F.array(*slugs), ""))


def slug_set(name: Column, country: str) -> Column:
    """Slugs of a name under the rules of one country; ``generic`` is the rule set for any country."""
    raw = bare_name(name)
    if country in ("ch", "generic"):
        plain = [slug(german(raw, sharp_s=False)), slug(french(raw)), slug(raw)]
        return _distinct(*plain) if country == "generic" else _distinct(*plain, *[dashless(s) for s in plain])
    de = german(raw)
    base = [slug(de), slug(raw), dashless(slug(de))]
    if country == "de":
        return _distinct(*base)
    preposition = r"\s+(?:" + "|".join(dims.AT_PREPOSITIONS) + r")\s+"
    without = strip(F.regexp_replace(de, preposition, " "))
    first = F.get(F.split(de, preposition, 2), F.lit(0))
    changed = without != de
    slugs = _distinct(
        *base,
        F.when(changed, slug(without)).otherwise(""),
        F.when(changed, slug(first)).otherwise(""),
    )
    short = F.transform(slugs, lambda s: _replace_all(s, [("sankt-", "st-"), ("sankt", "st")]))
    return F.when(F.contains(de, F.lit("sankt")), F.array_distinct(F.concat(slugs, short))).otherwise(slugs)


def _by_country(country: Column, make) -> Column:
    return (
        F.when(country == "de", make("de")).when(country == "at", make("at")).when(country == "ch", make("ch"))
    ).otherwise(make("generic"))


def slugs_for(name: Column, country: Column) -> Column:
    """:func:`slug_set` with the country taken from a column."""
    return _by_country(country, lambda cc: slug_set(name, cc))


def slug_in_domain(slugs: Column, domain: Column) -> Column:
    """Whether any slug occurs in the domain; an equal first label is a special case of that."""
    host = F.lower(domain)
    return F.coalesce((domain != "") & F.exists(slugs, lambda s: F.contains(host, s)), F.lit(False))


def domain_matches_name(name: Column, domain: Column, country: Column) -> Column:
    """Plausible match of a domain and a name under the rules of the country in ``country``."""
    return F.coalesce(name != "", F.lit(False)) & slug_in_domain(slugs_for(name, country), domain)


def website_mismatch(name: Column, domain: Column) -> Column:
    """A website whose domain holds neither a slug of the name nor one of its words of four or more letters."""
    raw = bare_name(name)
    host = F.lower(domain)
    words = F.concat(
        *[
            F.regexp_extract_all(variant, F.lit("[a-z]{4,}"), F.lit(0))
            for variant in (raw, german(raw, sharp_s=False), french(raw))
        ]
    )
    found = slug_in_domain(slug_set(name, "generic"), domain) | F.exists(words, lambda w: F.contains(host, w))
    return F.coalesce((name != "") & (domain != "") & ~found, F.lit(False))


def strict_match(slugs: Column, label: Column, sub: Column) -> Column:
    """The registered label is a slug, alone or behind one of the fixed prefixes, or the subdomain is a slug."""
    prefixes = ["", *dims.STRICT_PREFIXES]
    base = F.lower(label)
    return F.exists(
        slugs,
        lambda s: F.endswith(base, s)
        & F.substring(base, F.lit(1), F.length(base) - F.length(s)).isin(prefixes),
    ) | ((sub != "") & F.array_contains(slugs, F.lower(sub)))


def normalize_name(c: Column) -> Column:
    """Name for loose matching: umlauts spelled out, accents dropped, everything else a single blank.

    Accents are removed for the letters of the Latin blocks; the table follows from Unicode decomposition.
    """
    text = german(F.lower(strip(c)))
    plain = F.translate(text, *_accent_table())
    return strip(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), r"\s+", " "))


def _accent_table() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xA0, 0x250):
        char = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", char) if not unicodedata.combining(x))
        if len(base) == 1 and base != char and base in "abcdefghijklmnopqrstuvwxyz0123456789 ":
            pairs.append((char, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
