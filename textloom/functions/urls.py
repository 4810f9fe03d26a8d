"""URL functions as Column expressions; only resolving a relative link needs an Arrow UDF."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def host(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d+$", "")


def canonical_url(url: Column, *, www_for: list[str] | None = None) -> Column:
    """Lower-case scheme and host, no default port, query or fragment, single slashes, no trailing slash.

    Hosts in ``www_for`` get a leading ``www.``; other values than absolute URLs stay as they are.
    """
    s, h = scheme(url), authority(url)
    h = F.when(s == "https", F.regexp_replace(h, ":443$", "")).otherwise(F.when(s == "http", F.regexp_replace(h, ":80$", "")).otherwise(h))
    if www_for:
        h = F.when(h.isin(*www_for), F.concat(F.lit("www."), h)).otherwise(h)
    p = F.regexp_replace(F.regexp_replace(path(url), "/{2,}", "/"), "/+$", "")
    return F.when(url.rlike(_PARTS), F.concat(s, F.lit("://"), h, p)).otherwise(url)


def plain_url(url: Column) -> Column:
    """The simpler form: lower-case scheme and host, no query or fragment, no trailing slash."""
    return F.when(url.rlike(_PARTS), F.concat(scheme(url), F.lit("://"), authority(url), F.regexp_replace(path(url), "/+$", ""))).otherwise(F.trim(url))


def asset_url(url: Column) -> Column:
    """An asset keeps its query; parameters of the last path segment and the fragment go."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r";[^/?]*(?=\?|$)", "")


def allowed_article(url: Column, *, hosts: list[str], excluded_paths: list[str], excluded_prefixes: list[str]) -> Column:
    """Scope of article pages: scheme, host, no listing pages, no images."""
    p = path(canonical_url(url))
    out = scheme(url).isin("http", "https") & host(url).isin(*hosts) & ~p.isin("", "/", *excluded_paths)
    for prefix in excluded_prefixes:
        out = out & ~p.startswith(prefix)
    return out & ~F.lower(p).rlike(r"\.(?:jpe?g|png|gif|webp|svg|avif|bmp|ico)$")


def page_number(url: Column) -> Column:
    """The ``page=`` number of a listing link; null where there is none."""
    found = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    return F.when(found != "", found.cast("int"))


# Extensions by type, those kept as they stand in a path, and those of further types.
TYPE_EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/avif": ".avif", "image/svg+xml": ".svg"}
PATH_EXTENSION = r"\.(?:jpg|jpeg|png|gif|webp|avif|svg)$"
GUESSED_EXTENSIONS = {"image/bmp": ".bmp", "image/tiff": ".tiff", "image/vnd.microsoft.icon": ".ico", "image/x-icon": ".ico", "image/heic": ".heic"}
# What names an image that decorates the page.
DECORATIVE = r"logo|avatar|profile|icon|emoji|spinner|tracking|pixel|gravatar"


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def image_extension(mime: Column, url: Column) -> Column:
    """File extension by MIME type, else the path's own, else a guess by the type, else ``.img``."""
    own = F.lower(F.regexp_extract(F.lower(path(url)), PATH_EXTENSION, 0))
    return F.coalesce(_lookup(TYPE_EXTENSIONS)[mime], F.when(own != "", own), _lookup(GUESSED_EXTENSIONS)[mime], F.lit(".img"))


def decorative_image(signature: Column, width: Column, height: Column) -> Column:
    """Icons, logos and the like by their class, id and URL (``signature``), or both sides of 1 to 80 pixels."""
    small = width.between(1, 80) & height.between(1, 80)
    return F.coalesce(F.lower(signature).rlike(DECORATIVE), F.lit(False)) | F.coalesce(small, F.lit(False))


def url_hash(url: Column, length: int = 20) -> Column:
    return F.substring(F.sha2(url, 256), 1, length)


@F.pandas_udf(T.StringType())
def resolve_link(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link seen from its page; null where either is."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])
