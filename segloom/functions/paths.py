"""Path functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by extension.
EXTENSIONS = {"epub": "epub", "srt": "srt", "vtt": "vtt", "ass": "ass", "ssa": "ass", "lrc": "lrc", "txt": "txt", "md": "md", "markdown": "md", "docx": "docx"}
SUFFIX = {"bilingual": "bilingual", "replace": "translated"}


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """After the last dot that isn't the name's first character; null without one."""
    e = F.regexp_extract(name(path), r"^.+\.([^.]*)$", 1)
    return F.when(name(path).rlike(r"^.+\.[^.]*$"), e)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]*$", "$1")


def detect(path: Column) -> Column:
    """The format, or null if it isn't supported."""
    e = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def is_generated(path: Column) -> Column:
    return F.coalesce(stem(path).rlike(r"(?s)\.(bilingual|translated)$"), F.lit(False))


def output_path(path: Column, mode: Column, in_place: Column | None = None, explicit: Column | None = None) -> Column:
    """In place, else the given path, else a sibling with the mode's suffix."""
    suffix = F.when(mode == "replace", SUFFIX["replace"]).otherwise(SUFFIX["bilingual"])
    ext = extension(path)
    new = F.concat(F.regexp_extract(path, "(?s)^(.*/)?", 0), stem(path), F.lit("."), suffix, F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise(""))
    if explicit is not None:
        new = F.coalesce(explicit, new)
    return F.when(in_place, path).otherwise(new) if in_place is not None else new


def components(path: Column) -> Column:
    """What paths are ordered by."""
    return F.split(path, "/")


def is_safe(path: Column) -> Column:
    """Normal components alone."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def api_path(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, "/"), lambda c: ~c.isin("", ".", "..")), "/")


def join_archive(folder: Column, href: Column) -> Column:
    """A path in an archive: backslashes turned, dots and empty parts dropped, ".." popping."""
    parts = F.split(F.replace(F.concat_ws("/", F.when(folder != "", folder), href), F.lit("\\"), F.lit("/")), "/")
    empty = F.array().cast("array<string>")
    walk = F.aggregate(parts, empty, lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walk, "/")


def is_runtime_file(path: Column) -> Column:
    return ~path.contains("/") & (path.endswith(".safetensors") | path.endswith(".json") | (path == "chat_template.jinja"))
