"""URL functions as Column expressions; no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visits.
TRACKERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "_ga", "msclkid", "mc_cid", "mc_eid")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def port(url: Column) -> Column:
    given = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    scheme = F.lower(part(url, 1))
    return F.when(given != "", given).when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")


def normalize_query(query: Column, drop: tuple[str, ...] = TRACKERS) -> Column:
    """Pairs without trackers, sorted by name and value; a name alone where the value is empty."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["k"]).isin(*drop)))
    return F.array_join(F.transform(kept, lambda x: F.when(x["v"] == "", x["k"]).otherwise(F.concat(x["k"], F.lit("="), x["v"]))), "&")


def normalize(url: Column, drop: tuple[str, ...] = TRACKERS) -> Column:
    """Lower scheme and authority, no fragment, no trailing slash, no trackers, sorted query."""
    u = F.trim(url)
    path = part(u, 3)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = normalize_query(part(u, 4), drop)
    scheme = F.lower(part(u, 1))
    head = F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit("://"))), F.lower(part(u, 2)))
    return F.concat(head, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def same_host(a: Column, b: Column, subdomains: bool = False) -> Column:
    x, y = host(a), host(b)
    return (x == y) | x.endswith(F.concat(F.lit("."), y)) if subdomains else x == y


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and effective port agree; an empty or about: address always does."""
    empty = (F.coalesce(F.trim(a), F.lit("")) == "") | F.lower(a).startswith("about:")
    return empty | ((F.lower(part(a, 1)) == F.lower(part(b, 1))) & (host(a) == host(b)) & (port(a) == port(b)))


def absolute(base: Column, href: Column) -> Column:
    """href against the page's address, for the forms that occur in links: absolute, root-relative, query and relative."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, part(base, 3), href))
        .otherwise(F.concat(origin, folder, href))
    )


def path_query(url: Column) -> Column:
    q = part(url, 4)
    return F.concat(part(url, 3), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))


def public_ipv4(ip: Column) -> Column:
    """Not in a private, loopback, link-local, carrier, documentation, multicast or reserved network; false if not an IPv4."""
    closed = r"^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.(1[89])\.|^198\.51\.100\.|^203\.0\.113\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\."
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.coalesce(ip.rlike(rf"^{octet}(\.{octet}){{3}}$") & ~ip.rlike(closed), F.lit(False))
