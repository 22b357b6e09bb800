"""Column expressions on URLs. Null gives null."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
#: Fixed value: the unreserved characters of the URI standard.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def _host_and_port(url: Column) -> tuple[Column, Column]:
    """Host as it is written, and port digits or an empty text; user names go."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")
    return F.regexp_replace(authority, r":[0-9]*$", ""), F.regexp_extract(authority, r":([0-9]*)$", 1)


def host(url: Column) -> Column:
    """Lower-case host; empty where there is none."""
    return F.lower(_host_and_port(url)[0])


def host_without_www(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def origin(url: Column) -> Column:
    """Scheme, host, and port unless it is the scheme's own."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    name, port = _host_and_port(url)
    own = (port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.concat(scheme, F.lit("://"), F.lower(name), F.when(own, "").otherwise(F.concat(F.lit(":"), port)))


def _form_encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """https, lower-case ASCII host, no port 443, no user name, fragment or tracking parameters; percent codes of the path normal; parameters decoded, sorted and encoded again, blank ones kept.

    A host that has no ASCII form gives null.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    name, port = _host_and_port(bare)
    other = F.when(F.octet_length(name) != F.length(name), name)  # only hosts that need it go to Python
    ascii_host = F.lower(F.when(other.isNotNull(), idna_host(other)).otherwise(name))
    number = F.coalesce(F.regexp_replace(port, r"^0+", ""), F.lit(""))
    path = F.regexp_extract(bare, _AUTHORITY + r"([^?]*)", 2)
    coded = F.when(path.contains("%"), path)
    path = F.when(path == "", "/").otherwise(F.coalesce(normalize_percent(coded), path))
    decoded = lambda c: F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))
    key = lambda p: decoded(F.substring_index(p, "=", 1))
    value = lambda p: decoded(F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit("")))
    parts = F.filter(F.split(F.regexp_extract(bare, r"[?](.*)$", 1), "&"), lambda p: p != "")
    pairs = F.filter(F.transform(parts, lambda p: F.struct(key(p).alias("k"), value(p).alias("v"))), lambda p: ~F.lower(p["k"]).startswith(TRACKING_PREFIX) & ~F.lower(p["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), ascii_host, F.when((number == "") | (number == "443"), "").otherwise(F.concat(F.lit(":"), number)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


@F.pandas_udf(StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """Hosts in their ASCII form; null where there is none."""

    def one(h: str) -> str | None:
        try:
            return h.encode("idna").decode()
        except UnicodeError:
            return None

    return hosts.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_percent(urls: pd.Series) -> pd.Series:
    """Percent codes of unreserved characters decoded, the others in upper case."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c in UNRESERVED else m[0].upper()

    return urls.map(lambda u: re.sub(r"%([0-9A-Fa-f]{2})", one, u), na_action="ignore")


@F.pandas_udf(StringType())
def _joined(base: pd.Series, relative: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, relative, strict=True)], dtype=object)


def resolved(base: Column, address: Column) -> Column:
    """An address as seen from base; one with a scheme as it is."""
    relative = F.when(~address.rlike(_SCHEME), address)
    return F.coalesce(_joined(F.when(relative.isNotNull(), base), relative), address)


def document_canonical(declared: Column, fetched: Column) -> Column:
    """The address that a document declares, relative ones resolved, if on the same host but for www, else the fetched one; canonical."""
    whole = resolved(fetched, F.nullif(declared, F.lit("")))
    mine = F.when(host_without_www(whole) == host_without_www(fetched), canonical(whole))
    return F.coalesce(mine, canonical(fetched))
