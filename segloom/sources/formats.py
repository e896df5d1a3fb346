"""Text formats as array columns of blocks: struct(kind, framing, text), in document order.

kind is 'text' for what may be translated and 'pass' for what is written back as
it stands (its text is in framing, except in TXT and Markdown where both keep it
in text). Each parser is one expression on one row, so parsing moves no rows;
Markdown's state machine is the exception and runs over Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions import text as X

BLOCKS = "array<struct<kind:string,framing:string,text:string>>"
DEFAULT_COMMAS = 9


def block(kind: Column | str, framing: Column | str, text: Column | str) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(col(kind).alias("kind"), col(framing).alias("framing"), col(text).alias("text"))


def txt(source: Column) -> Column:
    """A block a line; blank lines and those that begin with a bracket pass."""
    return F.transform(X.lines(source), lambda line: block(F.when(X.is_blank(line) | line.rlike(r"(?U)^\s*\["), "pass").otherwise("text"), "", line))


def timed(source: Column) -> Column:
    """SRT and VTT: blocks between blank lines; one with an arrow line is a cue, framed up to that line."""
    blocks = F.filter(F.split(F.concat(F.lit("\n"), X.unix_lines(source), F.lit("\n")), r"(?U)\n(?:\s*\n)+|(?<![\s\S])\n|\n(?![\s\S])"), lambda b: ~X.is_blank(b))
    cue = r"(?s)^(.*?-->[^\n]*)(?:\n(.*))?$"
    return F.transform(blocks, lambda b: F.when(b.contains("-->"), block("text", F.regexp_extract(b, cue, 1), F.regexp_extract(b, cue, 2))).otherwise(block("pass", b, "")))


def lrc(source: Column) -> Column:
    """Lines with time tags before the text; others pass."""
    tags = r"(?s)^((?:\[[0-9]+:[^\]]*\])+)(.*)$"
    return F.transform(X.lines(source), lambda line: F.when(line.rlike(tags), block("text", F.regexp_extract(line, tags, 1), F.regexp_extract(line, tags, 2))).otherwise(block("pass", line, "")))


def commas_before_text(fields: Column) -> Column:
    """Fields before the last one named Text, else all but the last."""
    named = F.transform(F.split(fields, ",", -1), lambda f: F.lower(X.trim(f)))
    back = F.array_position(F.reverse(named), "text")
    return F.when(back > 0, F.size(named) - back).otherwise(F.size(named) - 1).cast("int")


def split_at_comma(s: Column, n: Column) -> tuple[Column, Column]:
    """Through the n-th comma, and the rest; the whole and nothing with fewer commas."""
    parts = F.split(s, ",", -1)
    enough = F.size(parts) > n
    head = F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(0))), ","), F.lit(",")))
    tail = F.array_join(F.slice(parts, n + 1, F.size(parts)), ",")
    return F.when(enough, head).otherwise(s), F.when(enough, tail).otherwise("")


def ass(source: Column) -> Column:
    """ASS and SSA: Dialogue lines of the events section, split before their text field.

    The last section header and the last Format line before a line tell how to
    read it; both are few, so each line looks back into their short arrays.
    """
    tail = r"(?s)^((?:\{[^}]*\})*)(.*)$"
    last = lambda marks, i, field, default: F.coalesce(F.get(F.reverse(F.filter(marks, lambda x: x.i < i)), F.lit(0))[field], F.lit(default))

    def headers(lines: Column) -> Column:
        named = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.lower(X.trim(line)).alias("s")))
        return F.filter(named, lambda h: h.s.startswith("[") & h.s.endswith("]"))

    def formats_in(lines: Column, heads: Column) -> Column:
        fields = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.when(X.trim(line).startswith("Format:") & (last(heads, i, "s", "") == "[events]"), commas_before_text(F.substring(X.trim(line), F.lit(8), F.char_length(line)))).alias("n")))
        return F.filter(fields, lambda f: f.n.isNotNull())

    def read(line: Column, i: Column, heads: Column, forms: Column) -> Column:
        def cue(n: Column) -> Column:
            head, text = split_at_comma(F.substring(line, F.lit(10), F.char_length(line)), n)
            return X.let(text, lambda t: block("text", F.concat(F.lit("Dialogue:"), head, F.regexp_extract(t, tail, 1)), F.regexp_extract(t, tail, 2)))

        return F.when(line.startswith("Dialogue:") & (last(heads, i, "s", "") == "[events]"), X.let(last(forms, i, "n", DEFAULT_COMMAS), cue)).otherwise(block("pass", line, ""))

    return X.let(X.lines(source), lambda lines: X.let(headers(lines), lambda heads: X.let(formats_in(lines, heads), lambda forms: F.transform(lines, lambda line, i: read(line, i, heads, forms)))))


def _markdown(source: str) -> list[tuple[str, str]]:
    """(kind, text) of the blocks of one Markdown text."""
    out: list[tuple[str, str]] = []
    para: list[str] = []
    held: list[str] = []
    close = ""  # what ends the held block: front matter's own line, or a fence's character

    def flush() -> None:
        if para:
            only = para[0].strip() if len(para) == 1 else ""
            out.append(("pass" if only and (is_rule(only) or is_reference(only)) else "text", "\n".join(para)))
            para.clear()

    for i, line in enumerate(source.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
        bare = line.strip()
        if close:
            held.append(line)
            if bare == close if len(close) == 3 else bare.startswith(close * 3):
                out.append(("pass", "\n".join(held)))
                held.clear()
                close = ""
        elif i == 0 and bare in ("---", "+++"):
            close = bare
            held.append(line)
        elif bare.startswith(("```", "~~~")):
            flush()
            close = bare[0]
            held.append(line)
        elif not bare:
            flush()
            out.append(("pass", ""))
        else:
            para.append(line)
    flush()
    if held:
        out.append(("pass", "\n".join(held)))
    return out


def is_rule(s: str) -> bool:
    """Three or more of one of - * _, with or without blanks, and nothing else."""
    marks = s.replace(" ", "")
    return len(marks) >= 3 and marks[0] in "-*_" and marks == marks[0] * len(marks)


def is_reference(s: str) -> bool:
    return s.startswith("[") and "]:" in s


def markdown(df: DataFrame, source: str, out: str = "blocks") -> DataFrame:
    """Paragraphs, with front matter, fences, rules, link definitions and blank lines passing."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(BLOCKS))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("framing", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            got = [[{"kind": k, "framing": "", "text": t} for k, t in _markdown(x or "")] for x in b.column(b.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], schema.names)

    return df.mapInArrow(run, schema)


#: Elements whose text is translated, and those whose content is not looked at.
TRACKED = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "figcaption", "dt", "dd")
SUPPRESSED = ("head", "title", "script", "style", "pre", "code", "nav", "textarea", "svg")


def html_tokens(html: Column) -> Column:
    """Tags and texts outside suppressed elements and comments."""
    plain = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in SUPPRESSED:
        plain = F.regexp_replace(plain, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_extract_all(plain, F.lit("<[^>]*>|[^<]+"), F.lit(0))


def html(source: Column) -> Column:
    """Array of struct(tag, text): an opening tracked tag whose next tracked tag closes it, with text that isn't blank.

    An element without an end tag is no leaf: where one stops is not in the text.
    """
    tag = rf"(?i)^<(/?(?:{'|'.join(TRACKED)}))(?:[\s>/]|$)"

    def tags(tokens: Column) -> Column:
        named = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.lower(F.regexp_extract(t, tag, 1)).alias("tag")))
        return F.filter(named, lambda m: m.tag != "")

    def leaf(m: Column, after: Column, tokens: Column) -> Column:
        inside = F.slice(tokens, m.i + 2, F.greatest(after.i - m.i - 1, F.lit(0)))
        text = F.array_join(F.filter(inside, lambda t: ~t.startswith("<")), "")
        return F.when(after.tag == F.concat(F.lit("/"), m.tag), F.struct(m.tag.alias("tag"), text.alias("text")))

    found = X.let(html_tokens(source), lambda tokens: X.let(tags(tokens), lambda marks: F.transform(marks, lambda m, k: X.let(F.get(marks, k + 1), lambda after: leaf(m, after, tokens)))))
    return F.filter(found, lambda x: x.isNotNull() & ~X.is_blank(x.text))


PARSERS = {"txt": txt, "srt": timed, "vtt": timed, "lrc": lrc, "ass": ass}
FRAME_PARSERS = {"md": markdown}


def register(name: str, parser) -> None:
    """Adds a format: a function of the source column that gives its blocks."""
    PARSERS[name] = parser


def parse(df: DataFrame, format_: str, source: str = "source", out: str = "blocks") -> DataFrame:
    """df with the blocks of a format's source."""
    if format_ in FRAME_PARSERS:
        return FRAME_PARSERS[format_](df, source, out)
    if format_ not in PARSERS:
        raise ValueError(f"unsupported format: {format_}")
    return df.withColumn(out, PARSERS[format_](F.col(source)))


def batched(format_: str) -> bool:
    """Whether a format's segments go out in batches with context."""
    return format_ not in ("epub", "docx")
