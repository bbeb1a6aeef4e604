"""Decisions about fetched pages: outcome, waiting, charset, robots, and which addresses may be fetched."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PAGE_BYTES = 5 << 20


def fetch_outcome(status: Column, content_type: Column, size: Column, max_bytes: int = MAX_PAGE_BYTES) -> Column:
    html_type = F.lower(F.coalesce(content_type, F.lit(""))).rlike(r"^\s*(text/html|application/xhtml\+xml)\s*(;|$)")
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "transient")
        .when(status >= 400, "http_error").when((status < 200) | (status >= 300), "transient")
        .when(~html_type, "not_html").when(size > max_bytes, "too_large").otherwise("fetched")
    )


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait: digits, or an HTTP date from now on; null for anything else."""
    text = F.trim(header)
    date = F.try_to_timestamp(F.regexp_extract(text, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(text.rlike(r"^\d+$"), text.try_cast("double")).when(date.isNotNull(), F.greatest(F.lit(0.0), F.unix_timestamp(date) - F.unix_timestamp(now.cast("timestamp"))).cast("double"))


def charset_of(content_type: Column) -> Column:
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w.:\-]+)", 1))
    return F.when(named != "", named).otherwise("utf-8")


@F.pandas_udf(T.StringType())
def decoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Bytes as text by their charset; an unknown one is UTF-8, bad bytes become replacement characters."""
    for body, charset in batches:
        out = []
        for b, c in zip(body, charset, strict=True):
            try:
                out.append(None if b is None else bytes(b).decode(c or "utf-8", "replace"))
            except LookupError:
                out.append(bytes(b).decode("utf-8", "replace"))
        yield pd.Series(out)


def robots_rule(status: Column) -> Column:
    """What a robots file's answer means; 'parse' leaves it to its text."""
    return F.when(status.isNull() | (status >= 500), "unreachable").when(status.isin(401, 403), "deny").when(status >= 400, "allow").when(status.between(200, 299), "parse").otherwise("unreachable")


def fetchable_url(url: Column) -> Column:
    """Shape of a URL that may be fetched: http(s), a host, no credentials, the usual ports."""
    host = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    port = F.regexp_extract(host, r":(\d*)$", 1)
    return url.rlike(r"(?i)^https?://") & (host != "") & ~F.contains(host, F.lit("@")) & port.isin("", "80", "443")


def public_address(text: str) -> bool:
    """Globally reachable; a mapped IPv4 address is judged itself, and addresses that wrap an IPv4 one are refused."""
    try:
        a = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return False
    if a.version == 6:
        if a.ipv4_mapped is not None:
            return public_address(str(a.ipv4_mapped))
        if a.sixtofour is not None or a.teredo is not None or a in ipaddress.ip_network("64:ff9b::/96") or a in ipaddress.ip_network("64:ff9b:1::/48"):
            return False
    return a.is_global and not a.is_multicast


@F.pandas_udf(T.BooleanType())
def public_addresses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether every address of a list is public; an empty list is not."""
    for s in batches:
        yield s.map(lambda xs: xs is not None and len(xs) > 0 and all(map(public_address, xs)))


def politeness_delay(own: float, crawl_delay: Column, most: float) -> Column:
    """Seconds between fetches of a host; null (skip the host) above the cap."""
    wait = F.greatest(F.lit(float(own)), F.coalesce(crawl_delay, F.lit(0.0)))
    return F.when(wait <= most, wait)


def backoff(failures: Column, base: float, cap: float) -> Column:
    """Doubles with every failure up to the cap; none after success."""
    return F.when(failures <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(base)) * F.pow(F.lit(2.0), failures - 1), F.lit(float(cap))))
