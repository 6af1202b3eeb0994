"""Request paths, byte ranges and retries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request paths; the groups are the file, then what the kind needs.
ROUTES = {
    "header": r"^/header/(\d+)$",
    "preview": r"^/preview/(\d+)$",
    "preview-bin": r"^/preview-bin/(\d+)$",
    "slice": r"^/slice/(\d+)/(axial|coronal|sagittal)/(\d+)$",
    "lod": r"^/lod/(\d+)/(\d+)$",
    "file": r"^/file/(\d+)$",
}

#: Tries of a request, and milliseconds before the second one.
TRIES, BACKOFF_MS = 3, 500


def route(url: Column) -> list[Column]:
    """kind, file, axis and index (of a slice, or level) of a path; kind is null for paths that aren't known."""
    kind = F.lit(None).cast("string")
    for name, pattern in ROUTES.items():
        kind = F.when(url.rlike(pattern), name).otherwise(kind)
    part = lambda n: F.try_element_at(F.split(url, "/"), F.lit(n))
    index = F.when(kind == "slice", part(5)).when(kind == "lod", part(4))
    return [kind.alias("kind"), F.when(kind.isNotNull(), part(3)).cast("long").alias("file"), F.when(kind == "slice", part(4)).alias("axis"), index.cast("long").alias("index")]


def byte_range(header: Column, size: Column) -> list[Column]:
    """status, first and last byte of a Range header: 206 for 'bytes=a-b' and 'bytes=a-', 416 for others, 200 without one."""
    pattern = r"bytes=(\d+)-(\d*)"
    known = header.rlike(pattern)
    start = F.expr("NULL").cast("long")
    start = F.when(header.isNull(), F.lit(0).cast("long")).when(known, F.nullif(F.regexp_extract(header, pattern, 1), F.lit("")).cast("long")).otherwise(start)
    asked = F.nullif(F.regexp_extract(header, pattern, 2), F.lit("")).cast("long")
    end = F.when(header.isNull(), size - 1).when(known, F.least(size - 1, F.coalesce(asked, size - 1)))
    status = F.when(header.isNull(), 200).when(known, 206).otherwise(416)
    return [status.alias("status"), start.alias("first"), end.alias("last")]


def backoff_ms(attempt: Column, base: int = BACKOFF_MS) -> Column:
    """Wait after a failed attempt (from 0), doubling; null after the last one."""
    return F.when(attempt < TRIES - 1, (base * F.pow(F.lit(2.0), attempt)).cast("long"))


def url_parts(url: Column, suffix: str = ".gz") -> list[Column]:
    """host, route (the path's first part), id (a number at its end) of a URL, empty where it has none, and whether it ends in ``suffix``, which tells what is gzipped."""
    parts = {"host": r"^https?://([^/]+)", "route": r"^https?://[^/]+/([^/?#]+)", "id": r"/([0-9]+)(\?|#|$)"}
    return [F.regexp_extract(url, pattern, 1).alias(name) for name, pattern in parts.items()] + [url.endswith(suffix).alias(suffix.lstrip("."))]
