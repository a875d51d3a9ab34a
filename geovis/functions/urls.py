"""URL functions. Pattern-based, because Spark's URL parser rejects unescaped characters
that browsers accept and escape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geovis.functions.core import let

ABSOLUTE = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[^\s/?#:@<>\[\]\\^|%]+)(?::\d*)?(?:[/?#]|\s*$)"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}

# Link endings that are files, not pages.
ASSET_SUFFIXES = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "css", "js", "json",
    "pdf", "xml", "zip", "mp4", "webm", "woff", "woff2",
]

_TO_ESCAPE = r"""[^\x21-\x7E]|["<>`{}]"""


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(ABSOLUTE), F.lit(False))


_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#\s]*)"
_PATH = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def hostname(url: Column) -> Column:
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]*)", 1))


def host(url: Column) -> Column:
    """Host name with the port unless it is the scheme's default."""
    defaults = [f"{name}:{port}" for name, port in DEFAULT_PORTS.items()]

    def assemble(u):
        port = F.regexp_extract(F.regexp_extract(u, _AUTHORITY, 1), r":(\d+)$", 1)
        return let(
            port,
            lambda p: F.when(
                (p == "") | F.concat(scheme(u), F.lit(":"), p).isin(*defaults), hostname(u)
            ).otherwise(F.concat(hostname(u), F.lit(":"), p)),
        )

    return let(url, assemble)


def _raw_origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def percent_encode(text: Column) -> Column:
    """Escape what a browser escapes in a path; text that needs nothing is returned as is."""

    def escape(t):
        return F.array_join(
            F.transform(
                F.split(t, ""),
                lambda ch: F.when(
                    ch.rlike(_TO_ESCAPE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))
                ).otherwise(ch),
            ),
            "",
        )

    return let(text, lambda t: F.when(t.rlike(_TO_ESCAPE), escape(t)).otherwise(t))


def _resolve_dots(path: Column) -> Column:
    """Apply "." and ".." segments of an absolute path."""

    def resolve(p):
        kept = F.aggregate(
            F.split(p, "/"),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        tail = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
        return F.regexp_replace(F.concat(F.array_join(kept, "/"), tail), "^$", "/")

    return let(path, lambda p: F.when(p.rlike(r"/\.\.?(?:/|$)"), resolve(p)).otherwise(p))


def path(url: Column) -> Column:
    """Path of an absolute URL, "/" when empty."""
    raw = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, _PATH, 1), r"\s+$", ""), "^$", "/")
    return percent_encode(_resolve_dots(raw))


def _query(url: Column) -> Column:
    """Query with its question mark; a bare question mark is dropped."""
    raw = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return percent_encode(F.regexp_replace(raw, r"^\?$", ""))


def domain(url: Column) -> Column:
    return F.when(is_url(url), hostname(url)).otherwise(url)


def origin(url: Column) -> Column:
    return F.when(is_url(url), _raw_origin(url)).otherwise(url)


def site_url(url: Column) -> Column:
    """Origin and path: query and fragment dropped, trailing slash kept; invalid text unchanged."""
    return F.when(is_url(url), F.concat(_raw_origin(url), path(url))).otherwise(url)


def page_url(url: Column) -> Column:
    """Fragment dropped, one trailing slash dropped unless the path is the root."""

    def cut(parts):
        return F.when(
            parts.path == "/", F.concat(parts.origin, parts.path, parts.query)
        ).otherwise(F.regexp_replace(F.concat(parts.origin, parts.path, parts.query), "/$", ""))

    parts = F.struct(
        _raw_origin(url).alias("origin"), path(url).alias("path"), _query(url).alias("query")
    )
    return F.when(is_url(url), let(parts, cut)).otherwise(url)


def path_depth(url: Column) -> Column:
    """Number of non-empty path segments; 0 for text that is no URL."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    return F.when(is_url(url), F.size(parts)).otherwise(0)


def protocol(url: Column) -> Column:
    return F.when(url.startswith("https"), "https").otherwise("http")


def is_page_link(url: Column) -> Column:
    """False for links to images, styles, scripts and other files."""
    return ~url.rlike(rf"(?i)\.(?:{'|'.join(ASSET_SUFFIXES)})$")


def _absolute(href: Column, base_origin: Column) -> Column:
    """Absolute form of a trimmed link, null for addresses of another kind (mail, phone, script)."""
    return (
        F.when(href.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), href)
        .when(href.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("//"), F.concat(scheme(base_origin), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base_origin, href))
        .otherwise(F.concat(base_origin, F.lit("/"), href))
    )


def normal_link(url: Column) -> Column:
    """Normal form of an absolute link: fragment and trailing slash dropped, null if invalid."""

    def build(u):
        full = F.concat(_raw_origin(u), path(u), _query(u))
        return F.when(is_url(u), F.regexp_replace(full, "/$", ""))

    return let(url, build)


def resolve_link(href: Column, base_origin: Column) -> Column:
    """The normal form of a link found on a site, null when it leads to no page address."""
    trimmed = F.regexp_replace(href, r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")
    return normal_link(let(trimmed, lambda t: _absolute(t, base_origin)))
