"""Addresses: normalisation, removal of fragments, resolution of links."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The ports that go without saying.
DEFAULT_PORTS = {"http": ":80", "https": ":443"}


def normalize_url(url: str | None) -> str:
    """Lower-case scheme and authority, no default port, parameters or fragment; path and query stay. "" for nothing, what
    can't be parsed stays as it is."""
    if not url:
        return ""
    try:
        parts = urlparse(url)
        scheme, place = parts.scheme.lower(), parts.netloc.lower()
        place = place.removesuffix(DEFAULT_PORTS.get(scheme, "\0"))
        return urlunparse((scheme, place, parts.path, "", parts.query, ""))
    except ValueError:
        return url


def without_fragment(url: str | None) -> str:
    try:
        return urldefrag(url or "")[0]
    except ValueError:
        return url or ""


def resolve(base: str, href: str | None) -> str | None:
    """The address a link leads to, None for links that lead nowhere."""
    href = (href or "").strip()
    if not href or href.startswith(("mailto:", "javascript:")):
        return None
    try:
        return urldefrag(urljoin(base, href) if base else href)[0]
    except ValueError:
        return None


@F.pandas_udf(StringType())
def normalize_column(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: normalize_url(without_fragment(u)), na_action="ignore")
