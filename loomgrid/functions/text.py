"""Names, keys and coercions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(text: Column) -> Column:
    """Characters other than letters, digits, underscore, dot and hyphen as one underscore a run, without `._` at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+|[._]+$", "")


def chart_name(song_id: Column, kind: Column, difficulty: Column, title: Column) -> Column:
    return F.concat_ws("_", F.lpad(song_id.cast("string"), 5, "0"), kind, difficulty.cast("string"), safe_name(title))


def chart_id(song_id: Column, kind: Column, difficulty: Column) -> Column:
    return F.concat_ws(":", song_id.cast("string"), F.upper(kind), difficulty.cast("string"))


def segment_key(chart: Column, segment: Column) -> Column:
    """Null for segment ids outside 0 to 4."""
    return F.when(segment.between(0, 4), F.concat_ws(":", chart, segment.cast("string")))


def chunk_key(name: Column, start: Column, end: Column) -> Column:
    return F.concat(name, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def text_or_empty(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit(""))


def int_or(v: Column, default: int = -1) -> Column:
    return F.coalesce(v.try_cast("bigint"), F.lit(default).cast("bigint"))


def float_or(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.try_cast("double"), F.lit(default))


def song_title(title: Column) -> Column:
    """Trimmed, without a trailing ` [DX]` or ` [ST]`."""
    return F.trim(F.regexp_replace(F.trim(title), r"\s+\[(DX|ST)\]$", ""))


def artist_key(artist: Column) -> Column:
    """Lower case, wide plus and ampersand narrowed, separators removed."""
    folded = F.translate(F.trim(artist), "＋＆", "+&")
    return F.lower(F.regexp_replace(F.coalesce(folded, F.lit("")), r"[\s+&・/／]+", ""))


def version_number(version: Column, missing: int = 9999) -> Column:
    """The number before the first dot, if the version starts with one."""
    return F.coalesce(F.regexp_extract(F.trim(version), r"^(\d+)\.", 1).try_cast("int"), F.lit(missing))


def chart_kind(title: Column, folder: Column, cabinet: Column, version: Column) -> Column:
    """A suffix of title or folder, then the cabinet, then versions from 14 on; a missing version counts as late."""
    ends = lambda mark: F.coalesce(F.trim(title).endswith(mark), F.lit(False)) | F.coalesce(F.trim(folder).endswith(mark), F.lit(False))
    return F.when(ends("[ST]"), "ST").when(ends("[DX]"), "DX").when(F.upper(F.trim(cabinet)) == "DX", "DX").when(version_number(version) >= 14, "DX").otherwise("ST")


def large_dividers(text: Column, threshold: float) -> Column:
    """Distinct `{N}` above a threshold, ascending; `{#N}` is no divider."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[{](\d+(?:\.\d+)?)[}]"), F.lit(1)), lambda x: x.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x > threshold)))


def audio_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def json_fields(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)
