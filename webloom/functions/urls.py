"""URL functions as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_SHAPE = r"\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"
EMPTY_URL = "the url string is empty"
NO_DOMAIN = "url domain e.g .com, .net was missing"
BAD_ESCAPE = "invalid URL escape"

# Private IPv4 ranges, upper end exclusive.
PRIVATE_RANGES = (
    ("10.0.0.0", "10.255.255.255"),
    ("100.64.0.0", "100.127.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_SHAPE, 1))


def authority(url: Column) -> Column:
    """Host with port, without user name."""
    return F.regexp_replace(F.regexp_extract(url, URL_SHAPE, 2), r"\A.*@", "")


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":[0-9]*\z", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)\z", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_SHAPE, 3)


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def registered_domain(url: Column) -> Column:
    """Last two labels of the host name."""
    return F.regexp_extract(hostname(url), r"([^.]+\.[^.]+)\z", 1)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"\A-|-\z", "")


def query_param(url: Column, name: str) -> Column:
    """Decoded value of the first query parameter called ``name``, empty when absent."""
    raw = F.regexp_extract(url, rf"\A[^?#]*\?(?:[^#]*&)??{name}=([^&#]*)", 1)
    return F.coalesce(F.try_url_decode(raw), F.lit(""))


def normalize_url(url: Column) -> tuple[Column, Column]:
    """(normalized url, error). Exactly one of the two is set."""
    whole_path = path(url)
    decoded = F.try_url_decode(F.replace(whole_path, F.lit("+"), F.lit("%2B")))
    bad_escape = F.regexp_replace(whole_path, "%[0-9a-fA-F]{2}", "").contains("%")
    name = hostname(url)
    host = F.when(name != "", name).otherwise(F.replace(decoded, F.lit("/"), F.lit("")))
    error = (
        F.when(url == "", F.lit(EMPTY_URL))
        .when(bad_escape, F.lit(BAD_ESCAPE))
        .when(~host.contains("."), F.lit(NO_DOMAIN))
    )
    kind = F.when(scheme(url) == "", F.lit("http")).otherwise(scheme(url))
    slashes = F.length(decoded) - F.length(F.replace(decoded, F.lit("/"), F.lit("")))
    result = F.concat(kind, F.lit("://"), host, F.when(slashes > 1, decoded).otherwise(F.lit("")))
    return F.when(error.isNull(), result), error


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, ``/`` for an empty path; other texts as they are."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^#]*)(?:#.*)?$"
    kind, place, rest = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    kind, place = F.lower(kind), F.lower(place)
    port = F.when(kind == "http", r":(80)?$").when(kind == "https", r":(443)?$").otherwise(r":$")
    tail = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(pattern), F.concat(kind, F.lit("://"), F.regexp_replace(place, port, F.lit("")), tail)).otherwise(url)


def link_base(root: Column, base_tag: Column) -> Column:
    """What relative links are appended to: the base tag, or the root of the host."""
    return (
        F.when(F.coalesce(base_tag, F.lit("")) == "", root)
        .when(base_tag.startswith("/"), F.concat(root, base_tag))
        .otherwise(base_tag)
    )


def absolute(root: Column, base: Column, href: Column) -> Column:
    """Absolute form of a link without its fragment, given host root and base."""
    whole = (
        F.when(href.startswith("/"), F.concat(root, href))
        .when(~href.startswith("http://") & ~href.startswith("https://"), F.concat(F.regexp_replace(base, r"/\z", ""), F.lit("/"), href))
        .otherwise(href)
    )
    return F.substring_index(whole, "#", 1)


def resolve_link(page_url: Column, base_tag: Column, href: Column) -> Column:
    """Absolute form of a link on a page."""
    root = site_root(page_url)
    return absolute(root, link_base(root, base_tag), href)


def ipv4_number(ip: Column) -> Column:
    """IPv4 address as a number; NULL when it is not one."""
    octets = F.split(ip, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.try_cast("bigint"))
    return F.when(ip.rlike(r"\A(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z"), number)


def is_private_ip(ip: Column) -> Column:
    """Whether the address lies in a private range. The six ranges fold to literals."""
    number, inside = ipv4_number(ip), F.lit(False)
    for low, high in PRIVATE_RANGES:
        inside = inside | ((number >= ipv4_number(F.lit(low))) & (number < ipv4_number(F.lit(high))))
    return F.coalesce(inside, F.lit(False))
