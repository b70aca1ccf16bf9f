"""Mail domains and contact links out of fetched pages.

Each obfuscation technique is one array expression over the page; the page itself never leaves its row.  Only short
(page, technique, domain) rows are shuffled.  The single Python step decodes HTML entities in Arrow batches, and only
for pages that contain an ampersand.
"""

from __future__ import annotations

import html as html_module
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.text import contains_any, is_valid_email, normalize_domain, strip, url_domain, url_host
from mailposture.operators.domains import split_domain
from mailposture.skew import lookup_join

# --- fixed values: patterns of the obfuscation techniques ---------------------------------------------------------

SHIFTED = r"""linkTo_UnCryptMailto\((?:['"]|%27|%22)([^'"]+?)(?:['"]|%27|%22)"""
HEX_MASKED = r'data-cfemail="([0-9a-fA-F]+)"'
FORM_ID = r'name="form_id"\s+value="([^"]+)"'
MAILTO = r'mailto:([^">\s?]+)'
BUILD_MAIL = r'buildMail\(\s*"[^"]*"\s*,\s*"([^"]*)"\s*,\s*"([^"]*)"'
LINK_BASE64 = r'data-email-link="([^"]+)"'
HIDDEN_SPAN = r'<span[^>]*(?:aria-hidden="true"|class="none"|data-nosnippet|display:\s*none)[^>]*>[^<]*</span>'
ROTATED = r"""href=['"]#([a-z0-9._-]+)\$([a-z0-9.-]+)['"]"""
SPELLED_AT = r"(?U)([\w.-]+)\s*[\[(][Aa][Tt][\])](?=\s*([\w.-]+\.\w+))"
ANCHOR = r'(?i)<a\s[^>]*href="([^"]*)"'


def html_decoder():
    """Arrow function that decodes HTML entities; null stays null."""
    @F.pandas_udf("string")
    def decode(pages: pd.Series) -> pd.Series:
        return pages.map(html_module.unescape, na_action="ignore")

    return decode


def found(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def gated(html: Column, marker: str, value: Column) -> Column:
    """Evaluate a technique only on pages that contain its marker."""
    return F.when(F.contains(html, F.lit(marker)), value).otherwise(F.array().cast("array<string>"))


def has_address(c: Column) -> Column:
    return F.coalesce(c.rlike(dims.EMAIL_PATTERN), F.lit(False))


def percent_decoded(c: Column) -> Column:
    """Percent-decoding that keeps ``+``; malformed text stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def base64_text(c: Column) -> Column:
    """Text of a base64 string, characters outside the alphabet ignored; null when it does not decode."""
    clean = F.regexp_replace(c, "[^A-Za-z0-9+/=]", "")
    return F.try_validate_utf8(F.try_to_binary(clean, F.lit("base64")).cast("string"))


def without_scheme(c: Column) -> Column:
    return F.replace(c, F.lit("mailto:"), F.lit(""))


def _shift_alphabets() -> tuple[str, list[str]]:
    """Characters of the three shifted ranges, and their images under every shift from -25 to 25."""
    plain = [chr(x) for lo, hi in dims.SHIFT_RANGES for x in range(lo, hi + 1)]
    images = []
    for shift in range(-dims.MAX_SHIFT, dims.MAX_SHIFT + 1):
        images.append("".join(chr(lo + (x - lo + shift) % (hi - lo + 1)) for lo, hi in dims.SHIFT_RANGES for x in range(lo, hi + 1)))
    return "".join(plain), images


def unshifted(c: Column) -> Column:
    """First shift of a text that shows an address; null when none does."""
    plain, images = _shift_alphabets()
    every = F.transform(
        F.array(*[F.lit(i) for i in images]), lambda image: without_scheme(F.call_function("translate", c, F.lit(plain), image))
    )
    return F.get(F.filter(every, has_address), F.lit(0))


def unmasked(c: Column) -> Column:
    """Hex bytes, all masked with the first one."""

    def byte(at: Column) -> Column:
        return F.conv(F.substring(c, at, F.lit(2)), 16, 10).cast("int")

    chars = F.transform(F.sequence(F.lit(3), F.length(c), F.lit(2)), lambda i: F.chr(byte(i).bitwiseXOR(byte(F.lit(1))).cast("bigint")))
    return F.when(F.length(c) > 2, F.array_join(chars, ""))


def rotated(c: Column) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, low, low[13:] + low[:13])


def joined_at(text: Column, pattern: str, change=lambda c: c) -> Column:
    """Local part and domain captured by two groups, put together."""
    return F.zip_with(found(text, pattern, 1), found(text, pattern, 2), lambda a, b: F.concat(change(a), F.lit("@"), change(b)))


def techniques(html: Column, decoded: Column, decoded_clean: Column) -> dict[str, Column]:
    """Array of address candidates per technique."""
    forms = F.transform(found(html, FORM_ID, 1), lambda v: base64_text(F.substring_index(v, ":", 1)))
    fields = F.flatten(F.transform(forms, lambda j: F.array(F.get_json_object(j, "$.recipient_email"), F.get_json_object(j, "$.from"))))
    spelled = F.zip_with(
        found(decoded, SPELLED_AT, 1), found(decoded, SPELLED_AT, 2), lambda a, b: F.concat(F.right(a, F.lit(64)), F.lit("@"), b)
    )
    return {
        "plain": gated(decoded, "@", found(decoded, dims.EMAIL_PATTERN, 0)),
        "mailto": gated(decoded, "mailto:", F.filter(found(decoded, MAILTO, 1), lambda e: F.contains(e, F.lit("@")))),
        "shifted": gated(html, "linkTo_UnCryptMailto", F.transform(found(html, SHIFTED, 1), lambda e: unshifted(percent_decoded(e)))),
        "build_mail": gated(html, "buildMail(", joined_at(html, BUILD_MAIL)),
        "link_base64": gated(
            html,
            "data-email-link",
            F.filter(F.transform(found(html, LINK_BASE64, 1), lambda e: without_scheme(percent_decoded(base64_text(e)))), has_address),
        ),
        "hidden_span": F.when(decoded_clean.isNotNull(), found(decoded_clean, dims.EMAIL_PATTERN, 0)).otherwise(F.array().cast("array<string>")),
        "hex_masked": gated(html, "data-cfemail", F.filter(F.transform(found(html, HEX_MASKED, 1), unmasked), has_address)),
        "form_id": gated(html, "form_id", F.filter(F.transform(fields, base64_text), has_address)),
        "rotated": gated(html, "$", joined_at(html, ROTATED, rotated)),
        "spelled_at": F.when(decoded.rlike(r"[\[(][Aa][Tt][\])]"), spelled).otherwise(F.array().cast("array<string>")),
    }


def address_domains(addresses: DataFrame, skip: Sequence[str], reserved: Sequence[str], suffixes: DataFrame | None) -> DataFrame:
    """Valid addresses to domains: skip list, reserved domains with their subdomains, known public suffix."""
    domain = F.regexp_replace(F.lower(F.substring_index("address", "@", -1)), r"[\\/.]+$", "")
    rows = addresses.filter(is_valid_email(F.col("address"))).withColumn("domain", domain).drop("address").distinct()
    rows = rows.filter((F.col("domain") != "") & ~F.col("domain").isin(list(skip)))
    for name in reserved:
        rows = rows.filter(~(F.col("domain") == name) & ~F.endswith("domain", F.lit("." + name)))
    return split_domain(rows, "domain", suffixes).filter(F.col("suffix") != "").drop("suffix", "label", "sub")


def extract_email_domains(
    pages: DataFrame,
    keys: Sequence[str],
    skip: Sequence[str] = (),
    reserved: Sequence[str] = tuple(dims.RESERVED_DOMAINS),
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Distinct (keys, technique, domain) of all addresses on the pages, plain or obfuscated.

    ``suffixes`` is a table of public suffix rules, by default the full list.
    """
    decode = html_decoder()
    html = F.col("html")
    cleaned = F.when(html.rlike(HIDDEN_SPAN), F.regexp_replace(html, HIDDEN_SPAN, ""))
    prepared = pages.select(
        *keys,
        html.alias("html"),
        F.coalesce(decode(F.when(F.contains(html, F.lit("&")), html)), html).alias("decoded"),
        decode(cleaned).alias("decoded_clean"),
    )
    arrays = techniques(html, F.col("decoded"), F.col("decoded_clean"))

    def tagged(name: str, addresses: Column) -> Column:
        return F.transform(addresses, lambda e: F.struct(F.lit(name).alias("technique"), e.alias("address")))

    rows = prepared.select(*keys, F.explode(F.concat(*[tagged(n, a) for n, a in arrays.items()])).alias("x")).select(*keys, "x.technique", "x.address")
    return address_domains(rows.filter(F.col("address").isNotNull()), skip, reserved, suffixes)


def discover_links(pages: DataFrame) -> DataFrame:
    """Distinct (site, path) of links on the page that stay on the site and look like contact pages."""
    bare = normalize_domain(F.col("site"))
    hrefs = pages.select("site", bare.alias("_bare"), F.explode(found(F.col("html"), ANCHOR, 1)).alias("href"))
    href = strip(F.col("href"))
    scheme = F.lower(F.regexp_extract(href, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(href, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", ""), r"^//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), r";[^/]*$", "")
    host = url_host(href)
    rows = hrefs.filter(
        (href != "")
        & ~href.rlike(r"^(#|javascript:|mailto:|tel:)")
        & scheme.isin("", "http", "https")
        & ((host == "") | (host == F.col("_bare")) | (host == F.concat(F.lit("www."), F.col("_bare"))))
        & ~path.isin("", "/")
    )
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    rows = rows.select("site", full.alias("path")).filter(
        contains_any(F.col("path"), dims.CONTACT_KEYWORDS)
        & ~F.col("path").rlike(dims.LINK_ASSET_PATTERN)
        & ~F.contains("path", F.lit("redirectEmailLink"))
        & ~F.contains("path", F.lit("%"))
    )
    return rows.distinct()


# --- fetch results of whole sites ---------------------------------------------------------------------------------


def fetched_pages(page_fetch: DataFrame) -> DataFrame:
    """Pages that count: nothing of a site whose homepage failed, and nothing behind three failures in a row.

    ``seq`` numbers the fetches of a site without gaps, 0 being the homepage; ``status`` is null for a failed fetch.  The
    cut is found by counting failures per position and the two before it, so no site is put in order in one task.
    """
    failed = page_fetch.filter((F.col("seq") > 0) & F.col("status").isNull())
    runs = failed.select("site", F.explode(F.array(F.col("seq"), F.col("seq") + 1, F.col("seq") + 2)).alias("end"))
    cut = runs.groupBy("site", "end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 3)
    cut = cut.groupBy("site").agg(F.min("end").alias("cut"))
    home = page_fetch.filter((F.col("seq") == 0) & F.col("status").isNotNull()).select("site").distinct()
    state = home.join(cut, "site", "left").withColumn("open", F.lit(True))
    rows = lookup_join(page_fetch.filter(F.col("status").isNotNull()), state, ["site"], "inner")
    return rows.filter(F.col("cut").isNull() | (F.col("seq") <= F.col("cut"))).drop("cut", "open")


def site_redirects(counted: DataFrame) -> DataFrame:
    """First page of a site that ended on another host ``(site, seq, redirect)``."""
    final = url_domain(F.col("final_url"))
    rows = counted.filter(final.isNotNull() & (final != F.col("site"))).select("site", "seq", final.alias("redirect"))
    return rows.groupBy("site").agg(F.min(F.struct("seq", "redirect")).alias("first")).select("site", "first.seq", "first.redirect")


def usable_pages(page_fetch: DataFrame) -> DataFrame:
    """Pages whose content counts, without the content: no error pages other than HTML."""
    page_fetch = page_fetch.select("site", "seq", "final_url", "status", "content_type")
    html = F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html"))
    return fetched_pages(page_fetch).filter((F.col("status") < 400) | html)


def site_emails(
    page_fetch: DataFrame, skip: Sequence[str] = (), reserved: Sequence[str] = tuple(dims.RESERVED_DOMAINS), suffixes: DataFrame | None = None
) -> DataFrame:
    """Distinct (site, domain) over all pages of a site.

    The page that first reveals a redirect to a blocklisted host contributes nothing; later pages do.  Addresses are taken
    from every fetched page where it lies; the rules of the site then select among the short (page, domain) rows.
    """
    counted = usable_pages(page_fetch)
    blocked = site_redirects(counted).filter(contains_any(F.col("redirect"), dims.REDIRECT_BLOCKLIST)).select("site", "seq")
    kept = counted.select("site", "seq").join(blocked, ["site", "seq"], "left_anti")
    fetched = page_fetch.filter(F.col("status").isNotNull())
    found = extract_email_domains(fetched, ["site", "seq"], skip, reserved, suffixes).select("site", "seq", "domain").distinct()
    return found.join(kept, ["site", "seq"], "left_semi").select("site", "domain").distinct()


def site_status(page_fetch: DataFrame) -> DataFrame:
    """Per site: whether its homepage answered, and the redirect."""
    reached = F.bool_or((F.col("seq") == 0) & F.col("status").isNotNull()).alias("accessible")
    sites = page_fetch.groupBy("site").agg(reached)
    return sites.join(site_redirects(usable_pages(page_fetch)).select("site", "redirect"), "site", "left")
