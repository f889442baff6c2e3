"""URL expressions: domains, canonical form, allowlist matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that start so are tracking keys; prefixes, so that e.g. "refresh" is one as well.
TRACKING = ("utm_", "fbclid", "gclid", "ref_", "ref")


def normalize_domain(domain: Column) -> Column:
    """Trimmed and lower-cased, without scheme and port."""
    d = F.lower(F.trim(domain))
    host = F.when(d.rlike("^https?://"), F.regexp_extract(d, "^https?://([^/?#]*)", 1)).otherwise(d)
    return F.regexp_replace(host, ":.*$", "")


def url_domain(url: Column) -> Column:
    """The lower-cased host without port; null where a URL has none."""
    host = F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(host, ":.*$", ""), F.lit(""))


def _path(path: Column) -> Column:
    """Dot segments resolved, repeated slashes collapsed, a slash at the end kept."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
    )
    joined = F.concat(F.lit("/"), F.array_join(up, "/"))
    return F.when(path.endswith("/") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def _query(query: Column) -> Column:
    """Keys and values sorted, tracking keys dropped, percent escapes written anew."""

    def part(p: Column) -> Column:
        key = F.regexp_extract(p, "^([^=]*)", 1)
        value = F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))
        return F.struct(F.coalesce(F.try_url_decode(key), key).alias("k"), F.coalesce(F.try_url_decode(value), value).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), part)
    own = F.filter(pairs, lambda p: ~F.exists(F.array(*map(F.lit, TRACKING)), lambda t: F.startswith(F.lower(p["k"]), t)))
    return F.array_join(F.transform(F.array_sort(own), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme (https where there is none) and host, no default port, clean path, sorted query, no fragment."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    host = F.lower(F.regexp_extract(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    host = F.when((scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":80$", "")).when((scheme == "https") & host.endswith(":443"), F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(u, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^([^?]*)", 1), ";[^/]*$", "")
    query = F.when(rest.contains("?"), F.regexp_replace(rest, "^[^?]*\\?", "")).otherwise(F.lit(""))
    cleaned = _query(query)
    clean_path = F.when(path == "", F.lit("/")).otherwise(_path(path))
    return F.concat(scheme, F.lit("://"), host, clean_path, F.when(cleaned == "", F.lit("")).otherwise(F.concat(F.lit("?"), cleaned)))


def domain_allowed(domain: Column, pattern: Column) -> Column:
    """Equal, a wildcard match, a subdomain, or with and without www."""
    glob = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(pattern, "([.+^$(){}\\[\\]|\\\\])", "\\\\$1"), "\\*", ".*"), F.lit("$"))
    return (
        (domain == pattern) | (pattern.contains("*") & F.regexp_like(domain, glob)) | domain.endswith(F.concat(F.lit("."), pattern))
        | (domain == F.concat(F.lit("www."), pattern)) | (pattern == F.concat(F.lit("www."), domain))
    ) & (pattern != "")


def domain_keys(domain: Column) -> Column:
    """The patterns without wildcard that allow a domain: itself, its parents, and its www twin. For an equi-join."""
    parts = F.split(domain, "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.concat(parents, F.array(F.concat(F.lit("www."), domain))))
