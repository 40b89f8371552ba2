"""Addresses of pages and images, and storage paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Which addresses are refused, and why.
FETCH_SCHEMES = ["http", "https"]
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "169.254.169.254", "[::1]"]
PRIVATE_PREFIXES = ["192.168.", "10."]
PRIVATE_172 = (16, 31)
RESTRICTED_PAGE_PREFIXES = ["chrome:", "chrome-extension:", "edge:", "about:", "data:", "file:"]
AUTH_REQUIRED_DOMAINS = [
    "drive.google.com",
    "docs.google.com",
    "onedrive.live.com",
    "1drv.ms",
    "icloud.com",
    "dropbox.com",
    "previews.dropboxusercontent.com",
]
PUBLIC_PREFIX = "/uploads/"


def _group(value: Column, pattern: str) -> Column:
    """First capture group, or null where the pattern does not match at all."""
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scheme(url: Column) -> Column:
    """Lower-cased protocol, or null. Read by pattern, so malformed addresses still have one."""
    return F.lower(_group(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):"))


def authority(url: Column) -> Column:
    return _group(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)")


def host(url: Column) -> Column:
    """Host as written (case and IPv6 brackets kept), without user and port; null when absent."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(bare, F.lit(""))


def port(url: Column) -> Column:
    given = F.nullif(F.regexp_extract(F.coalesce(authority(url), F.lit("")), r":([0-9]+)$", 1), F.lit(""))
    usual = F.when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)
    return F.coalesce(given.cast("int"), usual)


def domain(url: Column) -> Column:
    """Site of a page: a leading ``www.`` goes first, then the rest is lower-cased.

    The order matters: an upper-case ``WWW.`` stays, as the host is taken as written.
    """
    return F.lower(F.regexp_replace(host(url), r"^www\.", ""))


def is_private(h: Column) -> Column:
    """By text, as in ``10.``: a name starting that way counts too. ``172.`` needs a second part
    that begins with an integer from 16 to 31."""
    second = F.regexp_extract(h, r"^172\.([+-]?[0-9]+)", 1)
    low, high = PRIVATE_172
    by_prefix = any_of([h.startswith(p) for p in PRIVATE_PREFIXES])
    return by_prefix | F.coalesce(second.try_cast("bigint").between(low, high), F.lit(False))


def fetch_refusal(url: Column) -> Column:
    """Why an image address must not be fetched; null when it may. The first failing rule counts."""
    h = host(url)
    return (
        F.when(~F.coalesce(scheme(url).isin(FETCH_SCHEMES), F.lit(False)), "invalid_url_scheme")
        .when(h.isNull(), "invalid_url")
        .when(F.lower(h).isin(BLOCKED_HOSTS), "blocked_host")
        .when(is_private(h), "private_network")
    )


def page_allowed(url: Column) -> Column:
    return ~any_of([url.startswith(p) for p in RESTRICTED_PAGE_PREFIXES])


def needs_login(url: Column) -> Column:
    """The host contains one of the known login-only sites."""
    h = F.lower(host(url))
    return F.coalesce(any_of([h.contains(d) for d in AUTH_REQUIRED_DOMAINS]), F.lit(False))


def same_origin(image_url: Column, page_url: Column) -> Column:
    """Protocol, host and port agree; relative addresses belong to the page, ``//host`` takes its protocol."""
    own_scheme = F.coalesce(scheme(image_url), scheme(page_url))
    usual = F.when(own_scheme == "https", 443).when(own_scheme == "http", 80)
    same = (
        (own_scheme == scheme(page_url))
        & (F.lower(host(image_url)) == F.lower(host(page_url)))
        & (F.coalesce(port(image_url), usual) == port(page_url))
    )
    relative = scheme(image_url).isNull() & host(image_url).isNull()
    return F.when(relative, True).otherwise(F.coalesce(same, F.lit(False)))


def local_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^file://", "")


def _after_uploads(path: Column) -> Column:
    at = F.instr(path, PUBLIC_PREFIX)
    return F.when(at > 0, F.substr(path, at))


def public_url(path: Column) -> Column:
    """Address of a stored asset: from the first ``/uploads/`` on, else the path itself."""
    return F.coalesce(_after_uploads(path), path)


def mask_url(path: Column) -> Column:
    """Address of a stored mask, or null when it is not below ``/uploads/``."""
    return _after_uploads(path)
