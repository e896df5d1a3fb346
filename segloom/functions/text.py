"""Scalar text functions as Spark columns; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which an overlong text may be halved.
BOUNDARIES = " \t\n\r.!?;:,，。！？；：、"
RUN_CAP = 8
#: Fixed value: wordings of a prompt that is too long.
OVERFLOW = "context length|input prompt|context window|token limit|maximum context"


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, also where f uses it in a lambda or more than once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return x.rlike(r"(?U)^\s*$")


def unix_lines(x: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(x, "\r\n?", "\n")


def lines(x: Column) -> Column:
    return F.split(unix_lines(x), "\n", -1)


def collapse_runs(x: Column, cap: int = RUN_CAP) -> Column:
    """Runs of over `cap` equal characters cut to `cap`."""
    return F.regexp_replace(x, rf"(?s)(.)\1{{{cap - 1}}}\1+", "$1" * cap)


def truncate_bytes(x: Column, most: int) -> Column:
    """At most `most` UTF-8 bytes, whole characters, and an ellipsis if anything is cut."""
    head = F.substring(F.encode(x, "UTF-8"), 1, most)
    # characters that end within the bytes: lead bytes, less one if the last one's tail is cut off
    digits = F.hex(head)
    high = F.regexp_replace(digits, "([0-9A-F])[0-9A-F]", "$1")
    cut = high.rlike("(?:[CD]|E[89AB]?|F[89AB]{0,2})$")
    whole = F.length(F.regexp_replace(high, "[89AB]", "")) - cut.cast("int")
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(F.substring(x, F.lit(1), whole), F.lit("…")))


def split_boundary(x: Column) -> Column:
    """struct(left, right): halves at the boundary run nearest to the middle, the run on the left; null where either is blank."""
    marks = BOUNDARIES.replace(".", r"\.")

    def lead(y: Column, kind: str) -> Column:
        """Characters of the kind at the front of y."""
        return F.char_length(F.regexp_extract(y, f"^[{kind}]*", 0))

    def cut(n: Column) -> Column:
        # only the words at the middle are looked at, on either side; the left side has the middle itself
        mid = F.floor(n / 2).cast("int")
        sides = F.struct(lead(F.reverse(F.substring(x, F.lit(1), mid + 1)), "^" + marks).alias("l"), lead(F.substring(x, mid + 2, n), "^" + marks).alias("r"))
        near = lambda s: F.when((s.l < F.least(mid + 1, n)) & ((s.l <= s.r + 1) | (s.r >= n - mid - 1)), mid - s.l).when(s.r < n - mid - 1, mid + 1 + s.r)
        return let(let(sides, near), lambda i: i + lead(F.substring(x, i + 1, n), marks))

    parts = let(F.char_length(x), lambda n: let(cut(n), lambda c: F.struct(F.substring(x, F.lit(1), c).alias("left"), F.substring(x, c + 1, n).alias("right"))))
    return let(parts, lambda h: F.when(~is_blank(h.left) & ~is_blank(h.right), h))


#: The requests' wording and sampling.
SINGLE = "Translate the following text into {target}. Note that you should only output the translated result without any additional explanation:\n\n"
BATCH = "Please accurately translate the following text into {target}. You must retain the exact same number of <cN></cN> delimiters in the translation, in the same order. Strictly do not omit, escape, or translate these delimiters. Translate only the text between them; do not merge, split, add, or skip any.\n\n"
CONTEXT = "The lines below under 'Context' are for context only — do NOT translate or wrap them in tags:\n\nContext:\n"
SAMPLING = {"temperature": 0.7, "top_p": 0.6, "top_k": 20, "repetition_penalty": 1.05}


def _for_target(wording: str, target: Column) -> Column:
    before, after = wording.split("{target}")
    return F.concat(F.lit(before), target, F.lit(after))


def single_prompt(text: Column, target: Column) -> Column:
    return F.concat(_for_target(SINGLE, target), trim(text))


def batch_prompt(cues: Column, context: Column, target: Column) -> Column:
    """Cues in numbered tags, after an optional block of context."""
    before = F.concat(F.lit(CONTEXT), F.array_join(context, "\n"), F.lit("\n\n"))
    tagged = F.transform(cues, lambda c, i: F.concat(F.lit("<c"), (i + 1).cast("string"), F.lit(">"), collapse_runs(c), F.lit("</c"), (i + 1).cast("string"), F.lit(">")))
    return F.concat(_for_target(BATCH, target), F.when(F.size(context) > 0, before).otherwise(""), F.array_join(tagged, "\n"))


def single_prompt_text(text: str, target: str) -> str:
    """single_prompt() of a Python string, for requests that halving makes on an executor."""
    return SINGLE.replace("{target}", target) + text.strip()


def batch_prompt_text(cues: list[str], context: list[str], target: str) -> str:
    """batch_prompt() of Python strings."""
    before = CONTEXT + "\n".join(context) + "\n\n" if context else ""
    clean = [re.sub(rf"(?s)(.)\1{{{RUN_CAP},}}", lambda m: m[1] * RUN_CAP, c) for c in cues]
    return BATCH.replace("{target}", target) + before + "\n".join(f"<c{i}>{c}</c{i}>" for i, c in enumerate(clean, 1))


def chat_request(model: Column, prompt: Column) -> Column:
    """The request body; sampling is fixed and no length limit is sent."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages"), *[F.lit(v).alias(k) for k, v in SAMPLING.items()]))


def chat_content(body: Column) -> Column:
    """The first choice's content, or null."""
    parsed = F.from_json(body, "choices array<struct<message:struct<content:string>>>")
    return F.get(parsed["choices"], 0)["message"]["content"]


def parse_tagged(response: Column, count: Column) -> Column:
    """Array of `count` texts by tag number: the first of each, trimmed; null where it is missing."""
    tag = F.lit(r"(?s)<c0*([0-9]{1,10})>(.*?)</c\1>")
    found = F.struct(F.regexp_extract_all(response, tag, F.lit(1)).alias("number"), F.regexp_extract_all(response, tag, F.lit(2)).alias("text"))
    wanted = F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))
    return let(found, lambda got: F.transform(wanted, lambda k: trim(F.get(got.text, F.array_position(got.number, k.cast("string")).cast("int") - 1))))


def missing(parts: Column) -> Column:
    return F.size(F.filter(parts, lambda p: p.isNull()))


def cache_key(model: Column, target: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", model, target, text), 256)


def cache_path(key: Column) -> Column:
    return F.concat_ws("/", F.substring(key, 1, 2), F.substring(key, 3, 62))


def owner_hash(user: Column) -> Column:
    return F.substring(F.sha2(user.cast("string"), 256), 1, 32)


def is_context_overflow(error: Column) -> Column:
    #: Wordings of an overlong request's error.
    return F.lower(error).rlike(OVERFLOW)


def http_class(status: Column) -> Column:
    """Of a translation request: success, fatal, transient."""
    return F.when(status.between(200, 299), "success").when(status.between(400, 499) & (status != 429), "fatal").otherwise("transient")


def acquire_class(status: Column) -> Column:
    """Of a lease request: ok, retry, fatal."""
    return F.when(status.between(200, 299), "ok").when((status >= 500) | status.isin(408, 429), "retry").otherwise("fatal")


def backoff_ms(attempt: Column, retry_after_ms: Column) -> Column:
    """Wait before the next attempt, without jitter."""
    return F.least(F.lit(30_000), F.greatest(F.lit(500) * F.pow(F.lit(2), attempt), F.coalesce(retry_after_ms, F.lit(0)))).cast("long")


def html_escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_escape(x: Column) -> Column:
    return html_escape(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def sanitize_log(line: Column, most: int = 600) -> Column:
    """Without terminal escapes and control characters but tabs; `most` characters and dots."""
    plain = F.regexp_replace(F.regexp_replace(line, r"\x1b(?:\[[^@-~]*[@-~]?|[^\[]|$)", ""), r"[\x00-\x08\x0a-\x1f\x7f-\x9f]", "")
    return trim(F.when(F.char_length(plain) >= most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain))


def percent(line: Column) -> Column:
    """The number before the first percent sign, 100 at most; null above 255 or without one."""
    n = F.regexp_extract(line, r"^[^%]*?([0-9]+)[ \t\n\f\r]*%", 1).try_cast("int")
    return F.when(n <= 255, F.least(n, F.lit(100)))


def startup_signal(line: Column) -> Column:
    """struct(stage, progress) of a start-up log line, or null."""
    low = F.lower(line)
    pct = percent(low)
    signal = lambda stage, p: F.struct(F.lit(stage).alias("stage"), p.cast("int").alias("progress"))
    #: The log's wordings, stages and progress figures.
    return (
        F.when(low.contains("loading safetensors checkpoint shards"), signal("loading_weights", 10 + F.floor(F.coalesce(pct, F.lit(0)) * 35 / 100)))
        .when(low.rlike("loading model weights took|model loading took|weights loaded"), signal("loading_weights", F.lit(48)))
        .when(low.rlike("cuda graph|cudagraph"), signal("capturing_graphs", 65 + F.floor(F.coalesce(pct, F.lit(5)) * 30 / 100)))
        .when(low.rlike("compil|triton|flashinfer|marlin|torchinductor|ninja|nvcc"), signal("compiling_kernels", F.lit(52)))
        .when(low.rlike("application startup complete|uvicorn running|starting vllm api server|available routes"), signal("starting_server", F.lit(98)))
    )


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.round(done / total * 100))).otherwise(0).cast("long")


def prompt_budget(max_model_len: Column) -> Column:
    return F.greatest(F.lit(512), F.floor(max_model_len / 2) - 256).cast("long")
