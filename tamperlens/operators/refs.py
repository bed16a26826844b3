"""External references: URLs in content, and where they point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import as_findings, findings_of, hit, hits_if
from tamperlens.functions.groups import capped_lists
from tamperlens.rules import markers as M

_FLAGS = "(?i)"
_SSRF = "|".join(M.SSRF_PATTERNS)


def _all_matches(text: Column, patterns: list[str]) -> Column:
    """Every match of every pattern; a pattern is tried only where "://" occurs."""
    found = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(_FLAGS + p), 0) for p in patterns])
    )
    return F.when(F.contains(text, F.lit("://")), found)


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port, path, query or fragment."""
    authority = F.regexp_extract(url, r"^[A-Za-z0-9+.-]+://([^/?#]*)", 1)
    return F.lower(F.split_part(F.substring_index(authority, "@", -1), F.lit(":"), F.lit(1)))


def is_internal(url: Column) -> Column:
    return F.rlike(url, F.lit(f"{_FLAGS}^(?:{_SSRF})"))


def urls(texts: DataFrame) -> DataFrame:
    """(path, source, url, host, is_ssrf, is_file) for every URL occurrence."""
    return described(texts.select("path", "source", F.explode(_all_matches(F.col("text"), M.URL_PATTERNS)).alias("url")))


def described(urls: DataFrame) -> DataFrame:
    """Add ``host``, ``is_ssrf`` and ``is_file`` to rows with ``url``."""
    return (
        urls.withColumn("host", host_of(F.col("url")))
        .withColumn("is_ssrf", is_internal(F.col("url")))
        .withColumn("is_file", F.startswith(F.lower("url"), F.lit("file://")))
    )


def ssrf(texts: DataFrame) -> DataFrame:
    """One finding per source with URLs to internal hosts."""
    return ssrf_of(texts.select("path", "source", F.explode(_all_matches(F.col("text"), M.SSRF_PATTERNS)).alias("url")))


def ssrf_of(rows: DataFrame) -> DataFrame:
    """The same for rows (path, source, url) of internal URLs."""
    per_source = capped_lists(rows, ["path", "source"], F.col("url"), 10)
    return as_findings(
        per_source,
        "external_ref",
        "External Reference - SSRF Vector",
        "High",
        7.5,
        F.concat(F.col("total").cast("string"), F.lit(" URLs lead to internal hosts")),
        evidence={"ssrf_urls": F.to_json("items"), "total_found": F.col("total")},
        advice="Load only where internal services cannot be reached.",
        cwe="CWE-918",
    )


def local_files(urls: DataFrame) -> DataFrame:
    per_source = capped_lists(urls.where("is_file"), ["path", "source"], F.col("url"), 10)
    return as_findings(
        per_source,
        "external_ref",
        "External Reference - Local File Access",
        "High",
        7.0,
        F.concat(F.col("total").cast("string"), F.lit(" file URLs")),
        evidence={"file_urls": F.to_json("items"), "total_found": F.col("total")},
        advice="Check that these paths are meant.",
        cwe="CWE-22",
    )


def is_allowed(host: Column, allowed: list[str] = M.SAFE_DOMAINS) -> Column:
    """The host is an allowed domain or lies under one.

    Every suffix of the host is looked up in the allow-list, so a longer list
    costs no more per row than a short one.
    """
    labels = F.split(host, r"\.")
    count = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), ".")
    )
    return F.arrays_overlap(suffixes, F.array(*[F.lit(d.lower()) for d in allowed]))


def outside_urls(urls: DataFrame, allowed: list[str] = M.SAFE_DOMAINS) -> DataFrame:
    """URLs that are neither internal, nor files, nor on an allowed domain."""
    external = ~F.col("is_ssrf") & ~F.col("is_file") & (F.col("host") != "")
    return urls.where(external & ~is_allowed(F.col("host"), allowed))


def unknown_domains(urls: DataFrame, allowed: list[str] = M.SAFE_DOMAINS) -> DataFrame:
    """One finding per source with URLs on domains that are not expected there."""
    keys = ["path", "source"]
    outside = outside_urls(urls, allowed)
    hosts = capped_lists(outside, keys, F.col("host"), 20, "domains", "_n", "n_domains").drop("_n")
    samples = capped_lists(outside, keys, F.col("url"), 10, "sample_urls", "n_urls", "_d").drop("_d")
    both = hosts.join(samples, keys)
    few = F.col("n_domains") <= 3
    return as_findings(
        both,
        "external_ref",
        "External Reference - Unknown Domains",
        F.when(few, "Medium").otherwise("High"),
        F.when(few, 5.5).otherwise(7.0),
        F.concat(F.col("n_domains").cast("string"), F.lit(" unexpected domains")),
        evidence={
            "domains": F.to_json("domains"),
            "sample_urls": F.to_json("sample_urls"),
            "n_domains": F.col("n_domains"),
            "total_urls": F.col("n_urls"),
        },
        advice="Check these references; put expected domains on the allow-list.",
        cwe="CWE-829",
    )


def _sorted(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def _some(items: Column) -> Column:
    """The array in an array, unless it is empty: what follows is computed only then."""
    return F.filter(F.array(items), lambda g: F.size(g) > 0)


def unknown_domain_columns(found: Column, allowed: list[str] = M.SAFE_DOMAINS) -> Column:
    """Hit of the URLs of one text that lie on domains not expected there."""
    with_hosts = F.transform(found, lambda u: F.struct(u.alias("url"), host_of(u).alias("host")))
    outside = F.filter(
        with_hosts,
        lambda p: (p["host"] != "")
        & ~F.startswith(F.lower(p["url"]), F.lit("file://"))
        & ~is_internal(p["url"])
        & ~is_allowed(p["host"], allowed),
    )

    def lines(group: Column) -> Column:
        domains = _sorted(F.transform(group, lambda p: p["host"]))
        few = F.size(domains) <= 3
        return hit(
            "external_ref", "External Reference - Unknown Domains", F.when(few, "Medium").otherwise("High"),
            F.when(few, 5.5).otherwise(7.0),
            F.concat(F.size(domains).cast("string"), F.lit(" unexpected domains")),
            evidence={
                "domains": F.to_json(F.slice(domains, 1, 20)),
                "sample_urls": F.to_json(F.slice(_sorted(F.transform(group, lambda p: p["url"])), 1, 10)),
                "n_domains": F.size(domains),
                "total_urls": F.size(group),
            },
            advice="Check these references; put expected domains on the allow-list.", cwe="CWE-829",
        )

    return F.transform(_some(outside), lines)


def reference_columns(found: Column, internal: Column, allowed: list[str] = M.SAFE_DOMAINS) -> Column:
    """Hits of one text from its arrays of URLs and of internal URLs.

    The lists stand in the row, so they are counted and cut there: no shuffle.
    """
    files = F.filter(found, lambda u: F.startswith(F.lower(u), F.lit("file://")))

    def listed(kind: str, score: float, urls: Column, key: str, words: str, advice: str, cwe: str) -> Column:
        return hit(
            "external_ref", kind, "High", score, F.concat(F.size(urls).cast("string"), F.lit(words)),
            evidence={key: F.to_json(F.slice(_sorted(urls), 1, 10)), "total_found": F.size(urls)}, advice=advice, cwe=cwe,
        )

    ssrf_hit = listed(
        "External Reference - SSRF Vector", 7.5, internal, "ssrf_urls", " URLs lead to internal hosts",
        "Load only where internal services cannot be reached.", "CWE-918",
    )
    file_hits = F.transform(
        _some(files),
        lambda g: listed(
            "External Reference - Local File Access", 7.0, g, "file_urls", " file URLs",
            "Check that these paths are meant.", "CWE-22",
        ),
    )
    return F.concat(hits_if((F.size(internal) > 0, ssrf_hit)), file_hits, unknown_domain_columns(found, allowed))


def urls_in(text: Column) -> Column:
    """Array of the URLs of a text; NULL when it holds none at all."""
    return _all_matches(text, M.URL_PATTERNS)


def internal_urls_in(text: Column) -> Column:
    return _all_matches(text, M.SSRF_PATTERNS)


def url_arrays(texts: DataFrame) -> DataFrame:
    """(path, source, found, internal) of the texts that hold any URL."""
    return texts.where(F.contains("text", F.lit("://"))).select(
        "path", "source", _all_matches(F.col("text"), M.URL_PATTERNS).alias("found"),
        _all_matches(F.col("text"), M.SSRF_PATTERNS).alias("internal"),
    )


def reference_findings(texts: DataFrame, allowed: list[str] = M.SAFE_DOMAINS) -> DataFrame:
    """Findings of every kind for texts that are each a source of their own: one narrow pass."""
    return findings_of(url_arrays(texts), reference_columns(F.col("found"), F.col("internal"), allowed))
