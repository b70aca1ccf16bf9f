"""Candidate mail domains of entities: collection from registries, guesses, and joins with observations.

``entity(country, code, name, region, override_domain, override_name, website_domain)`` and
``candidate(country, code, pos, domain, source, is_email_domain)``; ``pos`` keeps the order of the sources.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailposture import dims
from mailposture.functions.labels import region_by_prefix
from mailposture.functions.names import normalize_name, slug_set, slugs_for
from mailposture.functions.text import classify_homepage, first_match, lookup, normalize_domain, strip, url_domain
from mailposture.operators.reports import ENTITY, n_rows
from mailposture.skew import lookup_join

CANDIDATE = ["country", "code", "pos", "domain", "source", "is_email_domain"]
OVERRIDE = ["email_domain", "website", "name", "canton"]


def filled(c: Column | str) -> Column:
    """The text, or null when it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def stack_candidates(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def listed(rows: DataFrame, cc: str, pos: int, domain: Column, source: str, is_email: bool, skip: list[str]) -> DataFrame:
    """Candidates of one source: lower case, not empty, not on the skip list."""
    return rows.select(
        F.lit(cc).alias("country"),
        "code",
        F.lit(pos).cast("bigint").alias("pos"),
        F.lower(domain).alias("domain"),
        F.lit(source).alias("source"),
        F.lit(is_email).alias("is_email_domain"),
    ).filter((F.coalesce("domain", F.lit("")) != "") & ~F.col("domain").isin(skip))


def apply_overrides(entity: DataFrame, overrides: DataFrame, use_canton: bool = False) -> DataFrame:
    """Override columns of an entity: a missing mail domain means '' (no mail), no override row means null."""
    ov = overrides.select("code", *[F.col(c).alias(f"_{c}") for c in OVERRIDE], F.lit(True).alias("_ov"))
    rows = entity.join(ov, "code", "left")
    region = F.coalesce(filled("_canton"), F.col("region")) if use_canton else F.col("region")
    return (
        rows.withColumn("override_domain", F.when(F.col("_ov"), F.coalesce("_email_domain", F.lit(""))))
        .withColumn("override_name", filled("_name"))
        .withColumn("website_domain", filled("_website"))
        .withColumn("region", region)
        .drop("_ov", *[f"_{c}" for c in OVERRIDE])
    )


def append_override_only(entity: DataFrame, overrides: DataFrame, cc: str) -> DataFrame:
    """Entities that only the overrides know and name."""
    extra = overrides.filter(F.col("name").isNotNull()).join(entity.select("code"), "code", "left_anti")
    return entity.unionByName(
        extra.select(
            F.lit(cc).alias("country"),
            "code",
            "name",
            F.coalesce("canton", F.lit("")).alias("region"),
            F.coalesce("email_domain", F.lit("")).alias("override_domain"),
            F.lit(None).cast("string").alias("override_name"),
            F.lit(None).cast("string").alias("website_domain"),
        )
    )


def _entity(rows: DataFrame, cc: str) -> DataFrame:
    return rows.select(F.lit(cc).alias("country"), "code", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("region", F.lit("")).alias("region"))


def _with_website(entity: DataFrame, candidates: DataFrame, keep_first: bool) -> DataFrame:
    """Website from the candidates of website sources: the latest one, or the earliest where none is set yet."""
    sites = candidates.filter(~F.col("is_email_domain"))
    place = F.struct("pos", "domain")
    pick = (F.min(place) if keep_first else F.max(place)).alias("site")
    rows = entity.join(sites.groupBy("code").agg(pick), "code", "left")
    site = F.col("site.domain")
    value = F.coalesce("website_domain", site) if keep_first else F.coalesce(site, "website_domain")
    return rows.withColumn("website_domain", value).drop("site")


def collect_ch(bfs: DataFrame, plz: DataFrame, bindings: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Official list decides which entities exist; region from it, the second registry, or the bindings.

    ``bfs(code, name, canton)``, ``plz(code, canton)``, ``bindings(code, website, cantonLabel)``.
    """
    rows = bfs.join(plz.select("code", F.col("canton").alias("_plz")), "code", "left")
    rows = rows.join(bindings.select("code", F.col("cantonLabel").alias("_label")), "code", "left")
    rows = rows.withColumn("region", F.coalesce(filled("canton"), filled("_plz"), filled("_label")))
    entity = apply_overrides(_entity(rows, "ch"), overrides, use_canton=True)
    own = bindings.join(bfs.select("code"), "code", "left_semi")
    candidates = listed(own, "ch", 0, url_domain(F.col("website")), "wikidata", False, dims.SKIP_DOMAINS["ch"])
    entity = _with_website(entity, candidates, keep_first=False)
    return append_override_only(entity, overrides, "ch"), candidates


def match_by_name(entity: DataFrame, mail_list: DataFrame, skip: list[str]) -> DataFrame:
    """First usable entry of a mail list for every entity with the same normalised name.

    An entry with a region fits only entities of that region.  The list is reduced to one entry per (name, region)
    first, so a frequent name does not multiply rows: each entity is looked up once with and once without a region.
    """
    rows = mail_list.filter(~F.col("domain").isin(skip))
    first = rows.groupBy("name_key", F.coalesce("region", F.lit("")).alias("_region")).agg(F.min(F.struct("pos", "domain")).alias("first"))
    keyed = entity.select("code", "region", normalize_name(F.col("name")).alias("name_key")).filter(F.col("name_key") != "")
    anywhere = first.filter(F.col("_region") == "").select("name_key", F.col("first").alias("_any"))
    here = first.filter(F.col("_region") != "").select("name_key", F.col("_region").alias("region"), F.col("first").alias("_here"))
    # Both lookups follow the name, so its hot keys are counted once, on the entities themselves.
    both = lookup_join(lookup_join(keyed, anywhere, ["name_key"]), here, ["name_key", "region"], weigh=keyed)
    return both.select("code", F.least("_any", "_here").alias("m")).filter(F.col("m").isNotNull()).select("code", F.col("m.domain").alias("domain"))


def collect_de(a: DataFrame, b: DataFrame, bindings: DataFrame, mail_list: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of three sources; name from the first that has the code; region from the code."""
    skip = dims.SKIP_DOMAINS["de"]
    names = reduce(
        DataFrame.unionByName,
        [x.select("code", F.lit(i).alias("rank"), "name") for i, x in enumerate((a, bindings, b))],
    )
    rows = names.groupBy("code").agg(F.min(F.struct("rank", "name")).alias("first")).select("code", F.col("first.name").alias("name"))
    rows = rows.withColumn("region", region_by_prefix(F.col("code"), "de"))
    entity = apply_overrides(_entity(rows, "de"), overrides)
    candidates = stack_candidates(
        [
            listed(a, "de", 0, F.col("domain"), "livenson", True, skip),
            listed(b, "de", 1, F.col("domain"), "b42labs", True, skip),
            listed(bindings, "de", 2, url_domain(F.col("website")), "wikidata", False, skip),
            listed(match_by_name(entity, mail_list, skip), "de", 3, F.col("domain"), "csv_email", True, skip),
        ]
    )
    return _with_website(entity, candidates, keep_first=False), candidates


def collect_at(plz: DataFrame, registry: DataFrame, bindings: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postal registry decides which entities exist; the first known website counts; government guesses for all."""
    skip = dims.SKIP_DOMAINS["at"]
    rows = plz.select("code", "name").withColumn("region", region_by_prefix(F.col("code"), "at"))
    entity = apply_overrides(_entity(rows, "at"), overrides)
    known = plz.select("code")
    registry, bindings = registry.join(known, "code", "left_semi"), bindings.join(known, "code", "left_semi")
    candidates = stack_candidates(
        [
            listed(registry, "at", 0, F.col("website_domain"), "bresu", False, skip),
            listed(registry, "at", 1, F.col("email_domain"), "bresu_email", True, skip),
            listed(bindings, "at", 2, url_domain(F.col("website")), "wikidata", False, skip),
        ]
    )
    entity = _with_website(entity, candidates, keep_first=True)
    return entity, candidates.unionByName(gov_guesses(entity, candidates))


# --- guesses ------------------------------------------------------------------------------------------------------


def _filled_in(template: str, slug: Column, region: Column) -> Column:
    pieces = []
    for i, part in enumerate(template.replace("{slug}", "|s|").replace("{region}", "|r|").split("|")):
        if part and i % 2 == 0:
            pieces.append(F.lit(part))
        elif part:
            pieces.append(slug if part == "s" else region)
    return F.concat(*pieces)


def guess_slugs(name: Column, cc: str) -> Column:
    """Slugs of a name and of its parts around a slash."""
    parts = F.filter(F.transform(F.split(name, "/"), strip), lambda p: p != "")
    if cc == "ch":
        # The whole name counts, and its parts when there are several.
        parts = F.when(F.size(parts) > 1, F.concat(F.array(name), parts)).otherwise(F.array(name))
    several = F.array_distinct(F.flatten(F.transform(parts, lambda p: slug_set(p, cc))))
    return F.when(F.contains(name, F.lit("/")), several).otherwise(slug_set(name, cc))


def guess_array(slugs: Column, region: Column, cc: str) -> Column:
    """All guessed domains, sorted and distinct, as one array expression."""
    suffix = {
        "de": F.lit(None).cast("string"),
        "at": lookup(region, dims.AT_REGION_SUFFIX),
        "ch": lookup(region, dims.REGION_ABBREVIATIONS["ch"]),
    }[cc]
    plain, regional = dims.GUESS_TEMPLATES[cc], dims.REGION_GUESS_TEMPLATES[cc]
    made = F.flatten(F.transform(slugs, lambda s: F.array(*[_filled_in(t, s, suffix) for t in plain])))
    if regional:
        more = F.flatten(F.transform(slugs, lambda s: F.array(*[_filled_in(t, s, suffix) for t in regional])))
        made = F.when(suffix.isNotNull(), F.concat(made, more)).otherwise(made)
    return F.sort_array(F.array_distinct(made))


def guess_domains(entity: DataFrame) -> DataFrame:
    """Guessed domains per entity ``(country, code, pos, domain)``: projections and explodes, no shuffle."""
    name, none = F.col("name"), F.array().cast("array<string>")
    slugs = first_match(((F.col("country") == cc, guess_slugs(name, cc)) for cc in dims.COUNTRIES), none)
    # The one-element explode keeps the slug expression compiled: it would otherwise be copied into the lambdas below.
    rows = entity.filter(name != "").select(*ENTITY, "region", F.explode(F.array(slugs)).alias("slugs"))
    guesses = first_match(
        ((F.col("country") == cc, guess_array(F.col("slugs"), F.col("region"), cc)) for cc in dims.COUNTRIES), none
    )
    return rows.select(*ENTITY, F.posexplode(guesses).alias("pos", "domain"))


#: Guesses stand behind all other candidates, those of government names before the rest; positions count rows and never reach these numbers.
GOVERNMENT_GUESS, OTHER_GUESS = 1 << 60, 1 << 61


def _as_guess(rows: DataFrame, offset: int) -> DataFrame:
    return rows.select(
        *ENTITY, (F.col("pos") + offset).cast("bigint").alias("pos"), "domain", F.lit("guess").alias("source"), F.lit(False).alias("is_email_domain")
    )


def add_guesses(entity: DataFrame, candidates: DataFrame) -> DataFrame:
    """Guesses for entities that have neither an override nor any candidate other than a guess."""
    real = candidates.filter(F.col("source") != "guess").select(*ENTITY).distinct()
    open_ = entity.filter(F.col("override_domain").isNull()).join(real, ENTITY, "left_anti")
    return candidates.unionByName(_as_guess(guess_domains(open_), OTHER_GUESS))


def gov_guesses(entity: DataFrame, candidates: DataFrame) -> DataFrame:
    """``slug.gv.at`` for every entity without an override, unless it is a candidate already."""
    open_ = entity.filter((F.col("name") != "") & F.col("override_domain").isNull())
    rows = open_.select(*ENTITY, F.posexplode(slug_set(F.col("name"), "at")).alias("pos", "slug"))
    rows = rows.withColumn("domain", F.concat("slug", F.lit(".gv.at"))).drop("slug")
    return _as_guess(rows.join(candidates.select(*ENTITY, "domain"), [*ENTITY, "domain"], "left_anti"), GOVERNMENT_GUESS)


# --- reports over sources -----------------------------------------------------------------------------------------


def source_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one source that the other lacks."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    only_a = left.join(right, key, "left_anti").withColumn("missing_in", F.lit("b"))
    return only_a.unionByName(right.join(left, key, "left_anti").withColumn("missing_in", F.lit("a")))


def coverage(entity: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities per source, distinct domains, overrides, entities with a static mail domain: rows (metric, n)."""
    per = candidates.select(*ENTITY, "source").distinct().groupBy("source").agg(n_rows().alias("n"))
    frames = [
        per.select(F.concat(F.lit("source "), F.col("source")).alias("metric"), "n"),
        entity.agg(n_rows().alias("n")).select(F.lit("entities").alias("metric"), "n"),
        candidates.agg(F.count_distinct("domain").alias("n")).select(F.lit("unique domains").alias("metric"), "n"),
        entity.agg(F.count("override_domain").alias("n")).select(F.lit("overrides").alias("metric"), "n"),
        candidates.filter("is_email_domain").select(*ENTITY).distinct().agg(n_rows().alias("n")).select(F.lit("static email domain").alias("metric"), "n"),
    ]
    return reduce(DataFrame.unionByName, frames)


# --- joins with observations --------------------------------------------------------------------------------------


def dns_prefilter(candidates: DataFrame, dns_obs: DataFrame) -> DataFrame:
    """Drop candidates that resolve neither bare nor with ``www.``; mail domains stay.  ``dns_obs(name, resolves)``."""
    up = dns_obs.filter("resolves")
    bare = up.select(F.col("name").alias("domain"))
    www = up.filter(F.startswith("name", F.lit("www."))).select(F.substring("name", 5, 1 << 30).alias("domain"))
    known = bare.unionByName(www).distinct().withColumn("_up", F.lit(True))
    rows = lookup_join(candidates, known, ["domain"])
    return rows.filter(F.col("_up") | F.col("is_email_domain")).select(*candidates.columns)


def http_status(http_fetch: DataFrame) -> DataFrame:
    """Result of the fetches ``(domain, prefix_order, status, final_url, ssl_failed)`` of a site.

    The first prefix (www before bare) with a status below 400 counts; another final host is a redirect.
    """
    good = F.when(F.col("status") < 400, F.struct("prefix_order", "final_url", "ssl_failed"))
    rows = http_fetch.groupBy("domain").agg(F.min(good).alias("first"))
    final = url_domain(F.col("first.final_url"))
    return rows.select(
        "domain",
        F.col("first").isNotNull().alias("accessible"),
        F.when(final != F.col("domain"), final).alias("redirect"),
        F.coalesce("first.ssl_failed", F.lit(False)).alias("ssl_failed"),
    )


def annotate_http(domains: DataFrame, http: DataFrame) -> DataFrame:
    """Candidates or other rows with ``domain``, with access and redirect; unobserved domains are not accessible."""
    rows = lookup_join(domains, http.select("domain", "accessible", "redirect", "ssl_failed"), ["domain"])
    return rows.withColumn("accessible", F.coalesce("accessible", F.lit(False))).withColumn("ssl_failed", F.coalesce("ssl_failed", F.lit(False)))


def content_flags(domains: DataFrame, http: DataFrame, pages: DataFrame) -> DataFrame:
    """Homepage class of every accessible domain ``(domain, flag)``; without a page there are no keywords.

    Pages are classified where they lie; only the flag is joined.
    """
    # One page for each domain: of several the first flag by name counts.
    flags = pages.select("domain", classify_homepage(F.col("html")).alias("flag")).groupBy("domain").agg(F.min("flag").alias("flag"))
    up = http.filter("accessible").select("domain").join(domains.select("domain").distinct(), "domain", "left_semi")
    return up.join(flags, "domain", "left").select("domain", F.coalesce("flag", F.lit("no_municipality_keywords")).alias("flag"))


def scrape_worklist(candidates: DataFrame, http: DataFrame, content: DataFrame) -> DataFrame:
    """Accessible domains that are not parked and belong to no entity with a verified mail domain."""
    verified = candidates.filter(F.col("is_email_domain") & ~F.col("source").isin(dims.UNVERIFIED_EMAIL_SOURCES))
    settled = candidates.join(verified.select(*ENTITY).distinct(), ENTITY, "left_semi").select("domain").distinct()
    up = candidates.select("domain").distinct().join(http.filter("accessible").select("domain"), "domain", "left_semi")
    parked = content.filter(F.col("flag") == "parked").select("domain")
    return up.join(parked, "domain", "left_anti").join(settled, "domain", "left_anti")


def misses(wanted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Wanted domains without a fresh observation."""
    return wanted.select("domain").distinct().join(fresh.select("domain"), "domain", "left_anti")


def mx_worklist(candidates: DataFrame, entity: DataFrame, scraped: DataFrame, skip: list[str]) -> DataFrame:
    """Domains whose MX is needed: candidates, overrides, scraped mail domains and redirects, minus the skip list.

    ``scraped(email_domain, redirect)``.
    """
    frames = [
        candidates.select("domain"),
        entity.select(F.col("override_domain").alias("domain")),
        scraped.select(F.col("email_domain").alias("domain")),
        scraped.select(F.col("redirect").alias("domain")),
    ]
    rows = reduce(DataFrame.unionByName, frames)
    return rows.filter((F.coalesce("domain", F.lit("")) != "") & ~F.col("domain").isin(skip)).distinct()


def attach_scraped(candidates: DataFrame, emails: DataFrame) -> DataFrame:
    """Mail domains found on the sites of an entity ``(country, code, site, email_domain)``."""
    every = candidates.select(*ENTITY, F.col("domain").alias("site"))
    found = emails.select("site", F.col("domain").alias("email_domain"))
    return lookup_join(every.distinct(), found, ["site"], "inner", weigh=every).distinct()


def url_worklist(domains: DataFrame, cc: str) -> DataFrame:
    """Homepage and fixed subpages under the www and the bare name, in order ``(domain, pos, url)``."""
    bare = normalize_domain(F.col("domain"))
    frames = [F.struct(F.lit(base).alias("base"), F.lit(path).alias("path")) for base in ("https://www.", "https://") for path in ["/", *dims.SUBPAGES[cc]]]
    rows = domains.select("domain", F.posexplode(F.array(*frames)).alias("pos", "u"))
    return rows.select("domain", "pos", F.concat("u.base", bare, "u.path").alias("url"))


def rescrape_worklist(sites: DataFrame, emails: DataFrame) -> DataFrame:
    """Accessible sites on which no mail domain was found."""
    return sites.filter("accessible").select("site").join(emails.select("site"), "site", "left_anti")


def with_slugs(entity: DataFrame) -> DataFrame:
    """Slugs of the name under the rules of the country; an entity table that already has them is left as it is."""
    return entity if "slugs" in entity.columns else entity.withColumn("slugs", slugs_for(F.col("name"), F.col("country")))
