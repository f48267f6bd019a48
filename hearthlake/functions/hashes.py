"""Content hashes that change only when what a reader sees changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlake.functions.scalars import blank_to_null, plain_number

LEAST_DESCRIPTION = 40


def photo_key(url: Column) -> Column:
    """Identity of a photo: its URL in lower case without a size suffix."""
    return F.regexp_replace(F.lower(url), r"_\d+x\d+c?(?=\.|$)", "")


def photo_hash(urls: Column) -> Column:
    """Hash of a set of photos; null if there are none."""
    keys = F.array_sort(F.array_distinct(F.transform(urls, photo_key)))
    return F.when(F.size(urls) > 0, F.sha2(F.array_join(keys, "|"), 256))


def normalized_description(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def description_hash(text: Column) -> Column:
    """Hash that ignores case, punctuation and blanks; null for short text."""
    clean = normalized_description(text)
    return F.when(F.length(clean) >= LEAST_DESCRIPTION, F.sha2(clean, 256))


def content_hash(price: Column, effective: Column, beds: Column, baths: Column, square_feet: Column, title: Column, description: Column, photos: Column) -> Column:
    """Hash of what makes up a listing."""
    none = F.lit("")
    parts = [F.coalesce(plain_number(c), none) for c in (price, effective, beds, baths, square_feet)]
    return F.sha2(F.concat_ws("\u001f", *parts, F.coalesce(title, none), F.coalesce(description_hash(description), none), F.coalesce(photo_hash(photos), none)), 256)


def group_id(ids: Column) -> Column:
    """Id of a group that its members alone decide."""
    return F.concat(F.lit("dup_"), F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 12))


def record_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id of a record from its natural key."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 20))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def not_empty(text: Column) -> Column:
    return blank_to_null(F.trim(text))
