"""Column functions over URLs, hosts, addresses and free text.  All of them stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailposture import dims


def contains_any(c: Column, patterns: Iterable[str]) -> Column:
    """Case-insensitive substring match against any of a few fixed patterns; false for null or no patterns.

    Several patterns become one alternation of quoted literals, so the text is evaluated once.
    """
    words = [p.lower() for p in patterns]
    text = F.lower(c)
    if not words:
        return F.lit(False)
    test = F.contains(text, F.lit(words[0])) if len(words) == 1 else text.rlike("|".join(rf"\Q{w}\E" for w in words))
    return F.coalesce(test, F.lit(False))


def ends_with_any(c: Column, suffixes: Iterable[str]) -> Column:
    tests = [F.endswith(c, F.lit(s)) for s in suffixes]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def first_match(cases: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """Ordered CASE: the value of the first true condition."""
    cases = list(cases)
    if not cases:
        return default
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A small fixed table as a CASE expression."""
    return first_match(
        ((c == F.lit(key), F.lit(value)) for key, value in table.items()),
        F.lit(None).cast("string") if default is None else default,
    )


def strip(c: Column) -> Column:
    """Remove white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def url_host(c: Column) -> Column:
    """Lower-case host of an absolute or scheme-relative URL: no user part, no port; '' when there is none."""
    authority = F.regexp_extract(c, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[^:\]]*$", "")
    return F.lower(host)


def url_domain(c: Column) -> Column:
    """Host of a URL with or without a scheme, without a leading ``www.``; null when there is none."""
    url = F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c))
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.when(host != "", host)


def normalize_domain(c: Column) -> Column:
    """A domain given as a bare name or an http(s) URL, without scheme and ``www.``."""
    text = strip(c)
    host = F.when(text.rlike(r"^https?://") & (url_host(text) != ""), url_host(text)).otherwise(text)
    return F.regexp_replace(host, r"^www\.", "")


def is_valid_email(c: Column) -> Column:
    """Plausible address: dot-atom local part, host of two or more labels, no special-use or file-name ending."""
    domain = F.lower(F.substring_index(c, "@", -1))
    local = F.substring_index(c, "@", 1)
    ending = F.substring_index(domain, ".", -1)
    return F.coalesce(
        c.rlike(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[^@]+$")
        & (F.length(local) <= 64)
        & domain.rlike(r"^([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])?$")
        & (F.length(domain) <= 253)
        & ~ending.isin(dims.SPECIAL_USE_TLDS)
        & ~ending.isin(dims.ASSET_EXTENSIONS),
        F.lit(False),
    )


def classify_homepage(html: Column) -> Column:
    """``parked`` (parking words and no municipal word), ``has_…`` or ``no_municipality_keywords``."""
    municipal = contains_any(html, dims.MUNICIPAL_WORDS)
    parked = contains_any(html, dims.PARKED_WORDS)
    return (
        F.when(municipal, "has_municipality_keywords").when(parked, "parked").otherwise("no_municipality_keywords")
    )


def registered_label(domain: Column, suffix: Column) -> Column:
    """Label in front of the public suffix ('' when the domain is a bare suffix)."""
    host = F.lower(domain)
    front = F.when(suffix == "", host).otherwise(
        F.when(host == suffix, "").otherwise(F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1))
    )
    return F.substring_index(front, ".", -1)


def subdomain(domain: Column, suffix: Column) -> Column:
    """Everything in front of the registered label ('' when there is nothing)."""
    host = F.lower(domain)
    front = F.when(suffix == "", host).otherwise(
        F.when(host == suffix, "").otherwise(F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1))
    )
    last = F.substring_index(front, ".", -1)
    return F.when(F.contains(front, F.lit(".")), F.substring(front, F.lit(1), F.length(front) - F.length(last) - 1)).otherwise("")


def asn_number(txt: Column) -> Column:
    """Number of an answer ``ASN | prefix | CC | …``; null with fewer than three parts or no integer."""
    return F.regexp_extract(txt, r"^\s*([+-]?\d+)\s*\|[^|]*\|", 1).try_cast("bigint")


def asn_country(txt: Column) -> Column:
    """Lower-case country of registration, third part of the answer."""
    return F.lower(F.trim(F.split_part(txt, F.lit("|"), F.lit(3))))


def to_bool(c: Column) -> Column:
    """Localised boolean kept as text: WAHR is true; FALSCH, 0, None, null and '' are false; other text is true.

    A JSON ``false`` read as text is ``false``.
    """
    return F.coalesce(~c.isin("FALSCH", "0", "0.0", "None", "", "false", "False"), F.lit(False))


def normalize_code(code: Column, width: int | None) -> Column:
    """Code as text, zero-padded to ``width`` when it is shorter."""
    text = code.cast("string")
    return text if not width else F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def apex(host: Column) -> Column:
    """Last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def mx_operator(mx: Column) -> Column:
    """Operator label of a primary MX host, first matching rule wins."""
    host = F.lower(F.trim(F.substring_index(mx, ";", 1)))
    return first_match(((F.contains(host, F.lit(p)), F.lit(label)) for p, label in dims.MX_OPERATORS), F.lit("other"))


def classify_host(host: Column, domestic_tlds: Iterable[str]) -> Column:
    """Struct (vendor, vendor_category) of a mail host: known vendors, known domestic hosts, domestic TLD, unknown."""
    name = F.lower(host)
    short = F.substring_index(F.regexp_replace(name, r"^_", ""), ".", -2)
    plain = F.substring_index(F.regexp_replace(host, r"^_", ""), ".", -2)

    def result(vendor: Column, category: str) -> Column:
        return F.struct(vendor.alias("vendor"), F.lit(category).alias("vendor_category"))

    cases = [(contains_any(host, words.split()), result(F.lit(v), cat)) for v, cat, words in dims.VENDORS]
    cases.append((contains_any(host, dims.KNOWN_DOMESTIC_HOSTS), result(short, "domestic")))
    cases.append((ends_with_any(name, domestic_tlds), result(plain, "domestic")))
    return first_match(cases, result(plain, "unknown"))


def spf_delegations(spf: Column) -> Column:
    """All ``include:`` targets followed by all ``redirect=`` targets."""
    return F.coalesce(
        F.concat(
            F.regexp_extract_all(spf, F.lit(r"include:([^\s]+)"), 1),
            F.regexp_extract_all(spf, F.lit(r"redirect=([^\s]+)"), 1),
        ),
        F.array().cast("array<string>"),
    )


def condense_detail(kind: Column, detail: Column) -> Column:
    """Short form of an evidence text per kind; texts of another form stay as they are."""
    arrow = "→"

    def pick(pattern: str, template: str) -> tuple[Column, Column]:
        return detail.rlike(pattern), F.regexp_replace(detail, pattern, template)

    rules = {
        "mx": [pick(r"^MX\s+(\S+)\s+matches\s+\S+$", "$1")],
        "spf": [pick(r"^SPF\s+include:(\S+)\s+matches\s+\S+$", "$1")],
        "dkim": [
            pick(
                rf"^DKIM\s+(selector\d+)\._domainkey\.\S+\s+CNAME\s+{arrow}\s+\S+\._domainkey\.(\S+)$",
                f"$1 {arrow} $2",
            )
        ],
        "asn": [
            pick(r"^ASN\s+(\d+)\s+matches\s+\S+$", "AS$1"),
            pick(r"^ASN\s+(\d+)\s+is Swiss ISP:\s+(.+)$", "AS$1 ($2)"),
            pick(r"^ASN\s+(\d+)\s+registered in\s+\S+$", "AS$1"),
        ],
        "tenant": [pick(r"^MS365 tenant detected:\s+(.+)$", "$1")],
        "autodiscover": [
            pick(rf"^autodiscover\s+CNAME\s+{arrow}\s+(.+)$", f"{arrow} $1"),
            pick(rf"^autodiscover\s+SRV\s+{arrow}\s+(.+)$", f"SRV {arrow} $1"),
        ],
        "txt_verification": [
            pick(r"^TXT verification matches\s+(\S+)$", "$1"),
            (F.contains(detail, F.lit("AWS SES")), F.lit("AWS SES")),
        ],
        "spf_ip": [
            pick(r"^.*ASN\s+(\d+)\s+is Swiss ISP:\s+(.+)$", "AS$1 ($2)"),
            pick(r"^.*ASN\s+(\d+)\s+matches\s+(\S+)$", "AS$1"),
            pick(r"^.*ASN\s+(\d+)\s+registered in\s+\S+$", "AS$1"),
        ],
        "dmarc": [pick(r"^DMARC record\s+(.+)$", "$1")],
    }
    return first_match(((kind == k, first_match(cases, detail)) for k, cases in rules.items()), detail)
