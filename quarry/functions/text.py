"""Scalar functions on strings and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_pointer(document: Column, pointer: str) -> Column:
    """The value at an RFC 6901 pointer, as text (null if absent). `~1` stands for `/`, `~0` for `~`."""
    if pointer and not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    path = "$"
    for raw in pointer.split("/")[1:]:
        token = raw.replace("~1", "/").replace("~0", "~")
        if "'" in token:
            raise ValueError("quotes in a pointer are not supported")
        path += f"[{token}]" if token.isdigit() else f"['{token}']"
    return F.get_json_object(document, path)


def edge_id(u: Column, v: Column) -> Column:
    return F.format_string("E_N%06d_N%06d", F.least(u, v).cast("long"), F.greatest(u, v).cast("long"))


def parse_edge_id(value: Column) -> Column:
    """Both node numbers; null unless the whole value is an edge id."""
    ok = value.rlike(r"^E_N\d+_N\d+$")
    part = lambda k: F.when(ok, F.regexp_extract(value, r"^E_N(\d+)_N(\d+)$", k).cast("long"))
    return F.struct(part(1).alias("u"), part(2).alias("v"))


def piped(values: Column) -> Column:
    """Distinct values, sorted, joined by bars."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(values, lambda x: x.cast("string")))), "|")


def unpiped(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), F.trim)
    return F.filter(parts, lambda x: x != "")


def blank_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", F.trim(value))


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("1", "true", "yes", "y")


def heading_section(text: Column, heading: str, level: int = 2) -> Column:
    """What follows a Markdown heading, up to the next one of its level or above; null if it is not there."""
    import re

    mark = "#" * level
    pattern = rf"(?s)(?:^|\n){mark} {re.escape(heading)}[ \t]*\n(.*?)(?=\n#{{1,{level}}} |\z)"
    return F.when(text.rlike(pattern), F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed."""
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1))


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys, without nulls."""
    return F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256)


def embedded_json(page: Column, element_id: str) -> Column:
    """The text of a script element with this id, as it stands."""
    import re

    pattern = r"(?s)<script[^>]*\bid=[\"']" + re.escape(element_id) + r"[\"'][^>]*>(.*?)</script>"
    return blank_null(F.regexp_extract(page, pattern, 1))


def asset_references(page: Column) -> Column:
    """Distinct targets of src and href, sorted."""
    found = F.regexp_extract_all(page, F.lit(r"(?:src|href)\s*=\s*[\"']([^\"'#]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def json_keys(document: Column) -> Column:
    """Top-level keys of a JSON object, sorted; null for anything else."""
    return F.array_sort(F.json_object_keys(document))


def utc_stamp(moment: Column) -> Column:
    """ISO 8601 in UTC, to the second, whatever zone the session has."""
    seconds = F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone())
    return F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_stamp(text: Column) -> Column:
    """The moment that an ISO 8601 text names; null for what is none."""
    return F.try_to_timestamp(text)
