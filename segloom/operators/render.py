"""Blocks back to text, with translations by block number: a map column, so rendering moves no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.text import html_escape

MODES = ("bilingual", "replace")


def by_number(df: DataFrame, translations: DataFrame, key: str = "doc_id", out: str = "tr") -> DataFrame:
    """df with a map from seg_id to text: a left join on the document; translations has key, seg_id, text."""
    maps = translations.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("seg_id", "text"))).alias(out))
    return df.join(maps, key, "left").withColumn(out, F.coalesce(out, F.create_map().cast("map<bigint,string>")))


def render(format_: str, blocks: Column, tr: Column, mode: str = "bilingual") -> Column:
    """The document's text. A block without a translation keeps its own."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if format_ in ("epub", "docx") and mode == "replace":
        raise ValueError(f"{format_} can't be written in replace mode")
    both = mode == "bilingual"

    def with_(join: str, prefix: Column, b: Column, t: Column) -> Column:
        if not both:
            return F.concat(prefix, t)
        return F.concat(prefix, F.when(b.text == "", t).otherwise(F.concat(b.text, F.lit(join), t)))

    def got(i: Column) -> Column:
        return F.try_element_at(tr, i.cast("long"))

    empty = F.lit("")
    if format_ in ("txt", "md"):
        join = "\n" if format_ == "txt" else "\n\n"
        return F.array_join(F.transform(blocks, lambda b, i: F.when((b.kind == "pass") | got(i).isNull(), b.text).otherwise(with_(join, empty, b, got(i)))), "\n")
    if format_ in ("srt", "vtt"):
        own = lambda b: F.when(b.text == "", b.framing).otherwise(F.concat(b.framing, F.lit("\n"), b.text))
        parts = F.transform(blocks, lambda b, i: F.when(b.kind == "pass", b.framing).when(got(i).isNull(), own(b)).otherwise(with_("\n", F.concat(b.framing, F.lit("\n")), b, got(i))))
        return F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))
    if format_ == "ass":  # a line is a cue, so a translation's line ends are the format's own
        own = lambda i: F.replace(got(i), F.lit("\n"), F.lit("\\N"))
        parts = F.transform(blocks, lambda b, i: F.when(b.kind == "pass", b.framing).when(got(i).isNull(), F.concat(b.framing, b.text)).otherwise(with_("\\N", b.framing, b, own(i))))
        return F.concat(F.array_join(parts, "\n"), F.lit("\n"))
    if format_ == "lrc":  # both lines have the cue's time tags
        own = lambda i: F.replace(got(i), F.lit("\n"), F.lit(" "))

        def line(b: Column, i: Column) -> Column:
            second = F.concat(b.framing, own(i))
            full = second if not both else F.when(b.text == "", second).otherwise(F.concat(b.framing, b.text, F.lit("\n"), second))
            return F.when(b.kind == "pass", b.framing).when(got(i).isNull(), F.concat(b.framing, b.text)).otherwise(full)

        return F.array_join(F.transform(blocks, line), "\n")
    raise ValueError(f"unsupported format: {format_}")


def html_wrapper(tag: Column) -> Column:
    return F.when(tag.isin("li", "dt", "dd"), tag).otherwise("p")


def html_translation(tag: Column, text: Column) -> Column:
    """The element that follows a translated one; the class name is a fixed value."""
    return F.concat(F.lit("<"), html_wrapper(tag), F.lit(' class="hy-zh">'), html_escape(text), F.lit("</"), html_wrapper(tag), F.lit(">"))
