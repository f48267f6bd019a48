"""Canonical form of listing URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.scalars import blank_to_null

# Parameters that only track where a visitor came from, besides utm_*.
TRACKING = ["fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "referrer", "spm", "cmpid", "campaign_id", "share_id", "vgo_ee"]
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(raw: Column) -> Column:
    """Scheme and host in lower case; no fragment, default port, tracking parameter, double or final slash; parameters by name.

    Null unless the URL is http or https. Parameters are compared and kept as written.
    """
    url = F.trim(raw)
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default = F.when(scheme == "https", "443").otherwise("80")
    port = F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(part(4), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(F.lit("/"))
    pairs = F.filter(F.split(part(5), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(pairs, lambda p: ~F.lower(name(p)).startswith("utm_") & ~F.lower(name(p)).isin(TRACKING))
    # By name, and by position where names are equal.
    numbered = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p"))))
    query = F.array_join(F.transform(numbered, lambda s: F.when(F.contains(s["p"], F.lit("=")), s["p"]).otherwise(F.concat(s["p"], F.lit("=")))), "&")
    built = F.concat(scheme, F.lit("://"), host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https"), built)


def domain_of(url: Column) -> Column:
    """Host without a leading www."""
    return blank_to_null(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), r"^www\.", ""))


def url_slug(url: Column) -> Column:
    """The last ten letters and digits."""
    return F.right(F.regexp_replace(url, "[^A-Za-z0-9]", ""), F.lit(10))
