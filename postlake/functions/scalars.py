"""Scalar column expressions shared by normalizers, search and export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "epoch_to_ts", "parse_iso_ts", "first_non_empty", "author_or_deleted",
    "last_path_segment", "strip_scheme", "hashtag_with_prefix", "hashtag_bare",
    "truthy_id", "json_of", "iso_text", "split_handle",
    "tag_names", "short_error", "hashtags_of", "norm_text", "count_hits",
]

# The deleted-author sentinel and the URL bases the reference builds.
DELETED_AUTHOR = "[deleted]"
REDDIT_BASE = "https://reddit.com"
BSKY_PROFILE = "https://bsky.app/profile/"


# Full date, then optionally a time with fraction and zone.
ISO_SHAPE = (r"^\d{4}-\d{2}-\d{2}"
             r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?$")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_ts(c) -> Column:
    """Epoch seconds (int or fractional) to a UTC instant."""
    return F.timestamp_seconds(_c(c).cast("double"))


def parse_iso_ts(c) -> Column:
    """ISO-8601 text (``Z`` or an offset allowed) to an instant; null when
    it does not parse or has no full date (callers fall back, D11).  The shape
    is checked first: a bare time would otherwise become a time of today."""
    return F.when(_c(c).rlike(ISO_SHAPE), F.try_to_timestamp(_c(c)))


def first_non_empty(a, b) -> Column:
    """``a`` unless null or empty, else ``b``."""
    return F.coalesce(F.nullif(_c(a), F.lit("")), _c(b))


def author_or_deleted(c) -> Column:
    """Author name or the deleted sentinel."""
    return F.coalesce(_c(c), F.lit(DELETED_AUTHOR))


def last_path_segment(c) -> Column:
    """E5: text after the last ``/``."""
    return F.substring_index(_c(c), "/", -1)


def strip_scheme(c) -> Column:
    """Remove every ``http://`` / ``https://``."""
    return F.regexp_replace(_c(c), r"https?://", "")


def hashtag_with_prefix(c) -> Column:
    """``#`` prefixed when missing."""
    c = _c(c)
    return F.when(c.startswith("#"), c).otherwise(F.concat(F.lit("#"), c))


def hashtag_bare(c) -> Column:
    """Hashtag term without ``#``, lower case (matching key)."""
    return F.lower(F.regexp_replace(_c(c), r"^#+", ""))


def truthy_id(c) -> Column:
    """E10 for ids carried as text: false for null, empty and ``0``."""
    c = _c(c)
    return c.isNotNull() & (c != F.lit("")) & (c != F.lit("0"))


def json_of(c) -> Column:
    """JSON text keeping null fields (``views`` must survive)."""
    return F.to_json(_c(c), {"ignoreNullFields": "false"})


def iso_text(c) -> Column:
    """Instant to ISO text as Python's ``isoformat`` prints it: seconds,
    plus ``.ffffff`` only when the fraction is not zero."""
    c = _c(c)
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(c.isNull(), F.lit(None)).when(
        F.date_format(c, "SSSSSS") == F.lit("000000"), base
    ).otherwise(F.concat(base, F.lit("."), F.date_format(c, "SSSSSS")))


def split_handle(c, part: int) -> Column:
    """``[@]user@instance`` -> part 1 user, part 2 instance (both forms)."""
    return F.nullif(F.regexp_extract(_c(c), r"^@?([^@]+)@(.+)$", part), F.lit(""))


def tag_names(c) -> Column:
    """Names of an array of ``{name}`` structs, null-safe."""
    return F.coalesce(F.transform(_c(c), lambda t: t["name"]), F.array().cast("array<string>"))


def short_error(c) -> Column:
    """Error text cut to 30 characters for a status line."""
    return F.substring(_c(c), 1, 30)


def hashtags_of(c) -> Column:
    """Distinct lower-case hashtags (``#word``) of a text."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(_c(c), F.lit(r"#(\w+)"), 1), lambda x: F.lower(x)))


def norm_text(c) -> Column:
    """Whitespace-collapsed, trimmed, lower-case text (fingerprints)."""
    return F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " ")))


def count_hits(haystack_lower, needle_lower) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``haystack`` (both already
    lower case); 0 for a null haystack.  Counted in bytes, which every string knows the
    number of; characters would be counted anew for each pair."""
    h, n = _c(haystack_lower), _c(needle_lower)
    return F.coalesce(
        ((F.octet_length(h) - F.octet_length(F.replace(h, n, F.lit("")))) / F.octet_length(n)).cast("long"),
        F.lit(0).cast("long"))
