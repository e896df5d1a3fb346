"""Named queries over the driver's tables and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom import adapters as A
from segloom.functions import paths as P
from segloom.functions import text as X
from segloom.operators import cache, engine, render, segments, translate, units
from segloom.oracles import ORACLES as ORACLES
from segloom.plans import ledger, models, planning, settings, telemetry
from segloom.sources import files, formats, zipped

QUERIES: dict = {}
TARGET, MODEL, BUDGET, LIMIT = "French", "7b-fp8", 1500, 1000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _txt(spark: SparkSession, sf: str) -> DataFrame:
    return formats.parse(A.txt_sources(spark, sf), "txt").withColumn("segments", segments.of_blocks(F.col("blocks")))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return segments.explode_segments(_txt(spark, sf), ["doc_id"])


def _units(df: DataFrame, starts, context: int = units.CONTEXT) -> DataFrame:
    rows = df.withColumn("units", units.units(F.col("segments"), starts, context)).select("doc_id", F.posexplode("units").alias("unit_idx", "u"))
    return rows.select("doc_id", F.col("unit_idx").cast("long").alias("unit_idx"), "u.ids", "u.cues", "u.context")


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return _units(_txt(spark, sf), units.starts_fixed(F.size("segments")))


# paths and files


@query
def format_detect(spark, sf):
    return A.paths(spark, sf).select("path", P.detect(F.col("path")).alias("format"))


@query
def generated_outputs(spark, sf):
    return A.paths(spark, sf).select("path", P.is_generated(F.col("path")).alias("generated"))


@query
def output_paths(spark, sf):
    p = F.col("path")
    mode = F.when(F.expr("p_partkey % 2 = 0"), "replace").otherwise("bilingual")
    return A.paths(spark, sf).select("path", P.output_path(p, mode).alias("suffixed"), P.output_path(p, mode, in_place=F.expr("p_partkey % 5 = 0"), explicit=F.when(F.expr("p_partkey % 3 = 0"), "given.txt")).alias("resolved"))


@query
def path_order(spark, sf):
    """Places of paths in the order of their components."""
    p = A.paths(spark, sf).select("path", F.element_at(P.components(F.col("path")), 1).alias("top"))
    return segments.running_number(p, ["top"], [P.components(F.col("path"))], "place").select("path", "place")


@query
def archive_paths(spark, sf):
    href = F.expr("CASE p_partkey % 5 WHEN 0 THEN '../img/' WHEN 1 THEN './a//' WHEN 2 THEN 'x\\\\\\\\y/' WHEN 3 THEN '../../../' ELSE '' END || CAST(p_partkey AS STRING)")
    folder = F.when(F.expr("p_partkey % 3 = 0"), "").otherwise("OEBPS/text")
    return A.table(spark, sf, "part").select("p_partkey", P.join_archive(folder, href).alias("joined"), P.is_safe(href).alias("safe"), P.api_path(F.replace(href, F.lit("\\"), F.lit("/"))).alias("api"))


@query
def listing(spark, sf):
    return planning.listing(A.paths(spark, sf).select("path", F.col("p_size").cast("long").alias("size")), "d1")


@query
def folder_filter(spark, sf):
    return planning.folder_filter(planning.listing(A.paths(spark, sf).select("path", F.col("p_size").cast("long").alias("size")), "d2"), "1", "file").select("name", "kind", "supported")


# text formats


@query
def txt_blocks(spark, sf):
    b = _txt(spark, sf).select("doc_id", F.posexplode("blocks").alias("block_idx", "b"))
    return b.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "b.kind", "b.text")


@query
def txt_segments(spark, sf):
    return _segments(spark, sf)


@query
def txt_stats(spark, sf):
    return _txt(spark, sf).select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), F.size("segments").cast("long").alias("n_segments"))


def _cues(format_):
    def run(spark, sf):
        b = formats.parse(A.subtitles(spark, sf, format_), format_).select("conv_id", F.posexplode("blocks").alias("block_idx", "b"))
        cols = ["b.kind", "b.text"] if format_ == "md" else ["b.kind", "b.framing", "b.text"]
        return b.select("conv_id", F.col("block_idx").cast("long").alias("block_idx"), *cols)

    return run


for _f in ("srt", "vtt", "lrc", "ass"):
    QUERIES[f"{_f}_cues"] = _cues(_f)
QUERIES["md_blocks"] = _cues("md")


def _leaves(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", formats.html(F.col("html")).alias("leaves"))


@query
def html_leaf_blocks(spark, sf):
    rows = _leaves(spark, sf).select("page_id", F.posexplode("leaves").alias("leaf_idx", "l"))
    return rows.select("page_id", F.col("leaf_idx").cast("long").alias("leaf_idx"), "l.tag", "l.text")


@query
def html_apply(spark, sf):
    """The translations that follow each page's leaves, under the stand-in translator."""
    out = F.array_join(F.transform("leaves", lambda x: render.html_translation(x.tag, F.concat(F.lit("<t> & "), x.text))), "\n")
    return _leaves(spark, sf).select("page_id", out.alias("inserted"))


# units and prompts


@query
def units_independent(spark, sf):
    return _segments(spark, sf).select("doc_id", F.col("ord").alias("unit_idx"), "seg_id")


@query
def units_batched(spark, sf):
    return _batches(spark, sf).select("doc_id", "unit_idx", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").cast("long").alias("n"), units.prompt_size(F.col("cues"), F.col("context")).alias("prompt_size"))


@query
def units_greedy(spark, sf):
    sizes = F.transform("segments", lambda s: F.octet_length(s.text).cast("long"))
    df = _txt(spark, sf).withColumn("sizes", sizes)
    u = _units(df, units.starts_greedy(F.col("sizes"), units.BATCH, units.CONTEXT, BUDGET))
    return u.select("doc_id", "unit_idx", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").cast("long").alias("n"))


@query
def units_limited(spark, sf):
    df = units.limited(_txt(spark, sf), LIMIT)
    u = _units(df, units.starts_fixed(F.size("segments")))
    return u.select("doc_id", "unit_idx", F.size("ids").cast("long").alias("n"))


@query
def context_windows(spark, sf):
    return _batches(spark, sf).select("doc_id", "unit_idx", F.size("context").cast("long").alias("n_context"), F.array_join("context", "|").alias("context"))


@query
def units_limited_greedy(spark, sf):
    d = units.limited_greedy(_txt(spark, sf), LIMIT, units.BATCH, units.CONTEXT, BUDGET)
    return d.select("doc_id", F.posexplode("units").alias("unit_idx", "u")).select("doc_id", F.col("unit_idx").cast("long").alias("unit_idx"), F.get("u.ids", F.lit(0)).alias("first_id"), F.size("u.ids").cast("long").alias("n"))


@query
def batch_prompts(spark, sf):
    return _batches(spark, sf).select("doc_id", "unit_idx", F.sha2(X.batch_prompt(F.col("cues"), F.col("context"), F.lit(TARGET)), 256).alias("prompt_sha"))


@query
def single_prompts(spark, sf):
    return _segments(spark, sf).select("doc_id", "seg_id", F.sha2(X.single_prompt(F.col("text"), F.lit(TARGET)), 256).alias("prompt_sha"))


@query
def chat_requests(spark, sf):
    """Fields of request bodies and what is read from response bodies."""
    b = A.table(spark, sf, "benchmark").withColumn("req", X.chat_request(F.lit(MODEL), X.single_prompt(F.col("text"), F.lit(TARGET))))
    body = F.when(F.expr("item_id % 5 = 0"), '{"choices": []}').when(F.expr("item_id % 5 = 1"), "no json").otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))))
    field = lambda p: F.get_json_object("req", p)
    return b.select("item_id", field("$.model").alias("model"), field("$.messages[0].content").alias("content"), field("$.temperature").cast("double").alias("temperature"), field("$.top_k").cast("long").alias("top_k"), field("$.max_tokens").isNull().alias("unbounded"), X.chat_content(body).alias("answer"))


@query
def sanitize_text(spark, sf):
    t = F.expr("CASE WHEN doc_id % 4 = 0 THEN repeat('é', CAST(doc_id % 40 AS INT)) || text || '!!!!!!!!!!!!' ELSE text || repeat(chr(10), CAST(doc_id % 12 AS INT)) END")
    return A.table(spark, sf, "documents").select("doc_id", X.collapse_runs(t).alias("clean"))


@query
def truncate_bytes(spark, sf):
    t = F.expr("CASE WHEN doc_id % 3 = 0 THEN repeat('日a🙂', 30) || text ELSE text END")
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", *[X.truncate_bytes(t, n).alias(f"at_{n}") for n in (20, 21, 22, 23, 120)])


@query
def boundary_split(spark, sf):
    halves = X.split_boundary(F.col("text"))
    rows = A.table(spark, sf, "documents").select("doc_id", "text").withColumn("h", halves)
    return rows.select("doc_id", "h.left", "h.right")


# the cache


def _cache(spark, sf):
    """Values for the lines of a third of the documents and for all benchmark items."""
    lines = _segments(spark, sf).filter("doc_id % 3 = 0").select("text").unionByName(A.table(spark, sf, "benchmark").select("text"))
    return cache.keyed(lines.distinct(), F.lit(MODEL), F.lit(TARGET)).select("key", F.concat(F.lit("T:"), F.col("text")).alias("value"))


def _keyed(spark, sf):
    return cache.keyed(_segments(spark, sf), F.lit(MODEL), F.lit(TARGET))


@query
def cache_keys(spark, sf):
    return _keyed(spark, sf).select("doc_id", "seg_id", "key", X.cache_path(F.col("key")).alias("path"))


@query
def cache_hits(spark, sf):
    return cache.hits(_keyed(spark, sf), _cache(spark, sf)).select("doc_id", "seg_id", "value")


@query
def cache_misses(spark, sf):
    return cache.misses(_keyed(spark, sf), _cache(spark, sf)).select("doc_id", "seg_id")


@query
def cache_put(spark, sf):
    """The table after a third of the documents has been translated anew."""
    new = _keyed(spark, sf).filter("doc_id % 3 = 1").select("key", F.concat(F.lit("N:"), F.col("text")).alias("value")).distinct()
    return cache.put(_cache(spark, sf), new).groupBy(F.substring("key", 1, 2).alias("shard")).agg(F.count("*").alias("n"), F.count_if(F.col("value").startswith("N:")).alias("new"))


@query
def segment_dedup(spark, sf):
    return _keyed(spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


# responses


@query
def parse_tagged(spark, sf):
    """Texts by tag from responses with gaps, repeats, zeros before numbers, open tags and stray ones."""
    piece = F.expr("""CASE WHEN turn % 4 = 1 THEN 'skipped' WHEN turn % 6 = 3 THEN '<c0' || CAST(turn + 1 AS STRING) || '> ' || coalesce(text, '') || chr(10) || '</c' || CAST(turn + 1 AS STRING) || '>'
        WHEN turn % 5 = 2 THEN '<c' || CAST(turn + 1 AS STRING) || '>a</c' || CAST(turn + 1 AS STRING) || '><c' || CAST(turn + 1 AS STRING) || '>b</c' || CAST(turn + 1 AS STRING) || '><c99>no</c99>'
        WHEN turn % 7 = 6 THEN '<c' || CAST(turn + 1 AS STRING) || '>open' ELSE '<c' || CAST(turn + 1 AS STRING) || '>' || coalesce(text, '') || '</c' || CAST(turn + 1 AS STRING) || '>' END""")
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", piece.alias("p"))
    r = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda x: x.p), "\n").alias("response"), F.count("*").alias("n"))
    got = r.withColumn("parts", X.parse_tagged(F.col("response"), F.col("n")))
    return got.select("conv_id", X.missing(F.col("parts")).cast("long").alias("missing"), F.posexplode("parts").alias("pos", "text")).select("conv_id", "missing", F.col("pos").cast("long").alias("pos"), "text")


@query
def best_attempt(spark, sf):
    a = A.table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    a = a.select("conv_id", F.col("attempt").cast("long").alias("attempt"), F.expr("(conv_id * 7 + attempt * 3) % 5").alias("n"))
    return translate.best_attempt(a, "conv_id")


@query
def split_plan(spark, sf):
    sizes = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.expr("1 + (count(*) * 7 + conv_id) % 60").cast("int").alias("n"))
    return translate.split_plan(sizes.select("conv_id", "n")).select("conv_id", "path", F.col("first").cast("long").alias("first"), F.col("size").cast("long").alias("size"))


@query
def error_classes(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.expr("CAST(200 + event_id % 400 AS INT)").alias("status"), F.expr("CASE event_type WHEN 'view' THEN 'This Model''s Maximum Context length is 8' WHEN 'click' THEN 'reduce the INPUT prompt' WHEN 'error' THEN 'Token limit' ELSE props END").alias("error"), F.expr("event_id % 6").alias("attempt"))
    return e.select("event_id", X.http_class(F.col("status")).alias("request"), X.acquire_class(F.col("status")).alias("acquire"), X.is_context_overflow(F.col("error")).alias("overflow"), X.backoff_ms(F.col("attempt"), F.when(F.expr("event_id % 3 = 0"), F.expr("event_id % 50000"))).alias("backoff_ms"))


# end to end


def _translated(spark, sf):
    """_txt with a map of translations: prompts, the stand-in translator, and its answers by tag."""
    df = _txt(spark, sf).withColumn("units", units.units(F.col("segments"), units.starts_fixed(F.size("segments")), units.CONTEXT))
    answer = lambda u: X.parse_tagged(translate.fake_column(X.batch_prompt(u.cues, u.context, F.lit(TARGET))), F.size(u.ids))
    pairs = F.flatten(F.transform("units", lambda u: F.filter(F.arrays_zip(u.ids.alias("id"), answer(u).alias("text")), lambda p: p["text"].isNotNull())))
    return df.withColumn("tr", F.map_from_entries(pairs))


@query
def translate_fake_e2e(spark, sf):
    t = _translated(spark, sf)
    return t.select("doc_id", F.size("segments").cast("long").alias("n_segments"), F.size("units").cast("long").alias("n_units"), F.size("tr").cast("long").alias("n_translated"), F.sha2(render.render("txt", F.col("blocks"), F.col("tr")), 256).alias("rendered_sha"))


@query
def translate_cached_e2e(spark, sf):
    """The engine over an Arrow translator, with a table that has the lines of a third of the documents."""
    got = engine.produce(A.txt_sources(spark, sf), "txt", _cache(spark, sf), lambda: translate.fake, MODEL, TARGET, lambda new: new)
    return got.select("doc_id", F.sha2("output", 256).alias("rendered_sha"), "n_segments", "n_hits", "n_translated")


@query
def render_txt_bilingual(spark, sf):
    return _translated(spark, sf).select("doc_id", render.render("txt", F.col("blocks"), F.col("tr")).alias("output"))


@query
def render_txt_replace(spark, sf):
    return _translated(spark, sf).select("doc_id", render.render("txt", F.col("blocks"), F.col("tr"), "replace").alias("output"))


def _rendered(format_, mode):
    """A file with every third segment untranslated, through the join of blocks and translations."""

    def run(spark, sf):
        d = formats.parse(A.subtitles(spark, sf, format_), format_)
        s = segments.explode_segments(d.withColumn("segments", segments.of_blocks(F.col("blocks"))), ["conv_id"])
        tr = s.filter("ord % 3 != 2").select("conv_id", "seg_id", F.concat(F.lit("T\n"), F.substring("text", 1, 20)).alias("text"))
        return render.by_number(d, tr, "conv_id").select("conv_id", render.render(format_, F.col("blocks"), F.col("tr"), mode).alias("output"))

    return run


for _f, _m in (("srt", "bilingual"), ("lrc", "bilingual"), ("ass", "bilingual"), ("md", "bilingual"), ("vtt", "replace")):
    QUERIES[f"render_{_f}"] = _rendered(_f, _m)


def _unit_done(spark, sf):
    """Units with failures: a file in 13 fails to translate a unit, one in 11 fails to be written."""
    u = _batches(spark, sf).select("doc_id", "unit_idx", F.size("ids").cast("long").alias("attempted"))
    return u.withColumn("done", F.when(F.expr("doc_id % 13 = 0 AND unit_idx % 2 = 1"), 0).otherwise(F.col("attempted")).cast("long")).withColumn("error", F.when(F.expr("doc_id % 11 = 0"), "write failed"))


@query
def run_summary(spark, sf):
    return _unit_done(spark, sf).agg(F.sum("attempted").alias("total"), F.sum("attempted").alias("completed"), F.sum("done").alias("translated"), (F.sum("attempted") - F.sum("done")).alias("failed"))


@query
def file_outcomes(spark, sf):
    return _unit_done(spark, sf).groupBy("doc_id").agg(F.sum("attempted").alias("attempted"), F.sum("done").alias("translated"), F.max("error").alias("error")).withColumn("ok", F.col("error").isNull())


# the ledger

_JOB = ["id", "owner", "status", "created_at", "updated_at"]


@query
def jobs_page(spark, sf):
    """Pages of an owner's jobs: the newest, and what follows a cursor."""
    j = A.jobs(spark, sf)
    owner = spark.range(1).select(X.owner_hash(F.lit("605"))).first()[0]
    one = ledger.page(j, owner, 3).select("id", "created_at", F.lit(1).alias("page"))
    two = ledger.page(j, owner, 5, cursor=(870_000_000, "000000007000")).select("id", "created_at", F.lit(2).alias("page"))
    return one.unionByName(two).withColumn("cursor", ledger.cursor_of(F.col("created_at"), F.col("id")))


@query
def jobs_page_phase(spark, sf):
    owner = spark.range(1).select(X.owner_hash(F.lit("1242"))).first()[0]
    return ledger.page(A.jobs(spark, sf), owner, 100, in_phase="in_progress").select(*_JOB)


@query
def jobs_active(spark, sf):
    owner = spark.range(1).select(X.owner_hash(F.lit("1378"))).first()[0]
    return ledger.active(A.jobs(spark, sf), owner).select(*_JOB)


@query
def jobs_active_counts(spark, sf):
    return ledger.counts(A.jobs(spark, sf))


@query
def jobs_recover(spark, sf):
    return ledger.recover(A.jobs(spark, sf), A.NOW).select(*_JOB)


@query
def jobs_claim(spark, sf):
    return ledger.claim(A.jobs(spark, sf), F.expr("CAST(id AS BIGINT) % 3 = 0"), A.NOW).select(*_JOB, "error")


@query
def jobs_retry(spark, sf):
    j = A.jobs(spark, sf)
    return ledger.retry(_asked(j), j, 7)


@query
def jobs_retried(spark, sf):
    j = A.jobs(spark, sf)
    done = ledger.retry(j.filter("CAST(id AS BIGINT) % 2 = 1").select("owner", "id"), j, 9)
    return ledger.retried(j, done, A.NOW).select(*_JOB, "total", "completed", "translated", "failed_segments", "error", "result_available")


@query
def jobs_expired(spark, sf):
    return ledger.expired(A.jobs(spark, sf), 900_000_000).select(*_JOB)


@query
def jobs_delete(spark, sf):
    return ledger.delete_terminal(A.jobs(spark, sf), F.expr("CAST(id AS BIGINT) % 4 = 1")).select(*_JOB)


@query
def jobs_insert(spark, sf):
    """Owners' jobs after an insert that those with many active ones are refused."""
    j = A.jobs(spark, sf)
    new = j.filter("CAST(id AS BIGINT) % 5 = 0").withColumn("id", F.concat(F.lit("n"), F.col("id"))).withColumn("status", F.lit("queued"))
    return ledger.insert(j, new, 9).groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("id").startswith("n")).alias("new"))


def _asked(j):
    return j.filter("CAST(id AS BIGINT) % 10 < 6").select("owner", F.when(F.expr("CAST(id AS BIGINT) % 10 = 3"), F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"))


@query
def jobs_cancel(spark, sf):
    j = A.jobs(spark, sf)
    return ledger.cancel(_asked(j), j)


@query
def jobs_cancelled(spark, sf):
    j = A.jobs(spark, sf)
    return ledger.cancelled(j, ledger.cancel(j.filter("CAST(id AS BIGINT) % 2 = 1"), j), A.NOW).select(*_JOB, "error")


@query
def jobs_upsert(spark, sf):
    j = A.jobs(spark, sf).select(*_JOB)
    new = spark.range(1).select(F.lit("new").alias("id"), F.lit("me").alias("owner"), F.lit("queued").alias("status"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("updated_at"))
    return ledger.upsert(j, j.filter("CAST(id AS BIGINT) % 3 = 0").withColumn("status", F.lit("writing")).unionByName(new))


@query
def schedule_dispatch_busy(spark, sf):
    """What starts beside five running jobs of one preset, some of whose outputs are wanted again."""
    j = A.jobs(spark, sf).withColumn("output", F.when(F.expr("CAST(id AS BIGINT) % 3 != 0"), F.col("save_to"))).withColumn("queue_pos", F.concat(F.lpad(F.col("created_at").cast("string"), 12, "0"), F.col("id")))
    running = j.filter("status = 'translating' and preset = '30b-fp8'").orderBy("queue_pos").limit(5)
    return planning.dispatch(j.filter("status = 'queued'").select("id", "preset", "output", "queue_pos"), running.select("preset", "output"))


@query
def jobs_page_info(spark, sf):
    """The first owner's first page of three, as the service answers it."""
    j = A.jobs(spark, sf)
    first = j.agg(F.min("owner")).first()[0]
    return ledger.page_info(j, first, 3).withColumn("ids", F.array_join("ids", ","))


@query
def jobs_cursor(spark, sf):
    j = A.jobs(spark, sf)
    text = F.when(F.expr("CAST(id AS BIGINT) % 3 = 0"), F.concat("id", F.lit(":a b"))).otherwise(ledger.cursor_of(F.col("created_at"), F.col("id")))
    return j.select("id", ledger.read_cursor(text).alias("c")).select("id", F.col("c.created_at").alias("cursor_at"), F.col("c.id").alias("cursor_id"))


@query
def jobs_progress(spark, sf):
    j = A.jobs(spark, sf)
    return j.select("id", ledger.phase(F.col("status")).alias("phase"), X.progress_percent(F.col("completed"), F.col("total")).alias("percent"), ledger.downloadable(F.col("status"), F.col("result_available")).alias("downloadable"))


@query
def owner_hash(spark, sf):
    return A.table(spark, sf, "customer").select("c_custkey", X.owner_hash(F.col("c_custkey")).alias("owner"))


# planning


@query
def selection_plan(spark, sf):
    """Files under requested folders and paths, asked for in several ways and more than once."""
    files = A.paths(spark, sf).select(F.when(F.expr("p_partkey % 2 = 0"), "documents").otherwise("remote_fs").alias("storage"), "path")
    asked = files.filter("path LIKE '%7%'").unionByName(files.filter("path LIKE '%77%'")).unionByName(spark.createDataFrame([("documents", "d1"), ("remote_fs", "d3"), ("documents", "d1")], "storage string, path string"))
    return planning.select_inputs(asked, files)


@query
def save_plan(spark, sf):
    files = A.paths(spark, sf).select("p_partkey", F.when(F.expr("p_partkey % 2 = 0"), "documents").otherwise("remote_fs").alias("storage"), "path").filter(P.detect(F.col("path")).isNotNull())
    mode = F.when(F.expr("p_partkey % 4 < 2"), "replace").otherwise("bilingual")
    strategy = F.when(F.expr("p_partkey % 3 = 0"), "sibling_suffix").when(F.expr("p_partkey % 3 = 1"), "sibling_overwrite").otherwise("directory")
    plan = planning.destinations(files, mode, strategy, F.lit("out"), F.expr("p_partkey % 2 = 0"))
    there = plan.filter("p_partkey % 5 = 0 AND save_path IS NOT NULL").select("save_path")
    return planning.skip_existing(plan, there, strategy).select("p_partkey", "path", "outcome", "save_path")


@query
def schedule_dispatch(spark, sf):
    q = A.jobs(spark, sf).filter("status = 'queued'").select("id", "preset", F.when(F.expr("CAST(id AS BIGINT) % 3 != 0"), F.col("save_to")).alias("output"), F.concat(F.lpad(F.col("created_at").cast("string"), 12, "0"), F.col("id")).alias("queue_pos"))
    return planning.dispatch(q)


def _mirrors(spark, sf):
    """Three measurements for each nation."""
    s = A.table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("grp"), F.element_at(F.array(*map(F.lit, planning.SOURCES)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("source"), F.expr("s_suppkey % 5 != 0").alias("available"), F.expr("CAST(s_suppkey * 37 % 101 AS BIGINT)").alias("speed")).groupBy("grp", "source").agg(F.max("available").alias("available"), F.max("speed").alias("speed"))


@query
def source_ranking(spark, sf):
    return planning.ranked_sources(_mirrors(spark, sf), "grp")


@query
def source_preference(spark, sf):
    return planning.preference(_mirrors(spark, sf), "grp").select("grp", F.array_join("sources", ",").alias("sources"))


@query
def download_plan(spark, sf):
    f = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model"), F.expr("CAST(l_extendedprice AS BIGINT)").alias("size"), F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN CAST(l_extendedprice AS BIGINT) ELSE 100 END").alias("final_size"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_partkey * 10 END").alias("partial_size"))
    p = planning.download_plan(f, "model")
    ok = planning.download_ok(F.col("total"), F.expr("total + (model % 3) * 1048576"), F.col("remaining"), F.expr("2147483648 + model % 1000 * 100"))
    rate = planning.speed_and_eta(F.col("total"), F.col("present"), F.expr("model % 7 * 1000"), F.expr("CAST(model % 5 AS DOUBLE) / 8"))
    return p.withColumn("r", rate).select("model", "total", "present", "remaining", ok.alias("verdict"), "r.speed", F.coalesce("r.eta", F.lit(-1)).alias("eta"))


@query
def launch_profile(spark, sf):
    g = A.table(spark, sf, "part").select("p_partkey", F.expr("CAST(8046402613 + (p_partkey % 4) * 7515735243 AS BIGINT)").alias("w"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 8589934592 ELSE 3221225472 END").alias("kv"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 0.35D ELSE 0.55D END").alias("tuned"), F.expr("CAST((16 + p_partkey % 60) * 1073741824 AS BIGINT)").alias("total"), F.expr("p_partkey % 3 != 0").alias("flag"))
    g = g.withColumn("free", F.expr("total - CAST((p_partkey % 7) * 536870912 AS BIGINT)"))
    p = planning.launch_profile(F.col("w"), F.col("kv"), F.col("tuned"), F.col("total"), F.col("free"), F.col("flag"))
    return g.withColumn("p", p).select("p_partkey", F.coalesce(F.round("p.utilization", 6), F.lit(-1.0)).alias("utilization"), F.coalesce("p.kv_bytes", F.lit(-1)).alias("kv_bytes"), "p.ok")


# telemetry


@query
def log_signals(spark, sf):
    return telemetry.signals(A.events(spark, sf), ["event_id"]).withColumn("progress", F.coalesce(F.col("progress"), F.lit(-1)).cast("long"))


@query
def startup_progress(spark, sf):
    s = telemetry.signals(A.events(spark, sf), ["run", "at", "event_id"])
    return telemetry.startup_progress(s, "run", [F.col("at"), F.col("event_id")]).select("event_id", F.col("now_progress").cast("long").alias("now_progress"), "now_stage")


@query
def probe_failures(spark, sf):
    return telemetry.probe_failures(A.events(spark, sf), "run", [F.col("at"), F.col("event_id")]).select("event_id", "failures", "failed")


@query
def eta(spark, sf):
    return A.table(spark, sf, "events").select("event_id", telemetry.eta(F.expr("event_id % 101"), F.expr("event_id % 900"), F.lit(600)).alias("remaining"))


@query
def recent_logs(spark, sf):
    return telemetry.recent_logs(A.events(spark, sf), "run", [F.col("at"), F.col("event_id")]).select("run", "event_id", "back")


@query
def lease_sessions(spark, sf):
    s = telemetry.lease_sessions(A.events(spark, sf), "run", "ts", 6 * 3600)
    return s.select("run", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "uses")


@query
def progress_throttle(spark, sf):
    return telemetry.throttled(A.events(spark, sf), "run", "at", 7200).withColumnRenamed("at", "written_at")


# rules, snapshots and manifests


@query
def settings_bounds(spark, sf):
    target = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN chr(9) || 'French ' WHEN 2 THEN repeat('é', 33) WHEN 3 THEN repeat('x', 64) ELSE 'de' END")
    o = F.col("o_orderkey")
    return A.table(spark, sf, "orders").select("o_orderkey", settings.valid(o % 120, o % 60).alias("valid"), settings.valid_target(target).alias("target_ok"), settings.lease_ttl(F.when(o % 7 > 0, o % 5000)).alias("ttl"), settings.retention_cutoff(o, F.lit(604800)).alias("cutoff"), settings.page_size(F.when(o % 3 > 0, o % 200)).alias("page"))


@query
def format_strategies(spark, sf):
    return settings.strategies(spark)


@query
def preset_budgets(spark, sf):
    return planning.presets(spark).select("preset", X.prompt_budget(F.col("max_model_len")).alias("budget"), "download_bytes")


@query
def job_checks(spark, sf):
    j = A.jobs(spark, sf).withColumn("preset", F.expr("CASE WHEN CAST(id AS BIGINT) % 50 = 0 THEN 'x' ELSE preset END")).withColumn("translated", F.expr("CASE WHEN CAST(id AS BIGINT) % 70 = 0 THEN -1 ELSE translated END")).withColumn("status", F.expr("CASE WHEN CAST(id AS BIGINT) % 90 = 0 THEN 'lost' ELSE status END"))
    return settings.violations(j)


@query
def snapshot_changes(spark, sf):
    j = A.jobs(spark, sf)
    after = j.filter("CAST(id AS BIGINT) % 11 != 0").withColumn("status", F.expr("CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'writing' ELSE status END"))
    return settings.changes(j.filter("CAST(id AS BIGINT) % 13 != 0"), after)


@query
def active_overlay(spark, sf):
    j = A.jobs(spark, sf)
    return settings.overlay(j.select("id", "status", "completed"), j.filter("status = 'translating'").select("id", F.lit("writing").alias("status"), F.col("total").alias("completed")), ["status", "completed"])


@query
def live_leases(spark, sf):
    e = A.events(spark, sf).select("event_id", (F.col("at") + F.expr("event_id % 3600")).alias("expires_at"))
    return settings.live_leases(e, 1_705_000_000)


@query
def display_values(spark, sf):
    p = A.table(spark, sf, "part")
    n = F.expr("CAST(pow(2, p_partkey % 40) AS BIGINT) + p_partkey")
    return p.select("p_partkey", settings.display_bytes(n).alias("bytes"), settings.display_duration(F.expr("p_partkey - 5")).alias("duration"), settings.attribute_escape(F.concat(F.lit("<\"&'>"), "p_name")).alias("attribute"))


@query
def file_urls(spark, sf):
    source = F.element_at(F.array(*map(F.lit, (*planning.SOURCES, "auto"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat("p_name", F.lit("+é.json"))
    return A.table(spark, sf, "part").select("p_partkey", settings.file_url(source, F.lit("o/r"), F.lit("abc"), F.replace(path, F.lit(" "), F.lit("_"))).alias("url"), settings.range_starts_at(F.when(F.expr("p_partkey % 3 > 0"), F.concat(F.lit("bytes "), (F.col("p_partkey") % 5).cast("string"), F.lit("-9/10"))), F.col("p_partkey") % 2).alias("resumes"))


@query
def log_lines(spark, sf):
    c = A.table(spark, sf, "events").select("event_id", F.expr("'a' || chr(13) || chr(10) || event_type || chr(10) || chr(10) || repeat('y', CAST(event_id % 7 AS INT) * 3000)").alias("chunk"))
    rows = c.select("event_id", F.posexplode(settings.log_lines(F.col("chunk"))).alias("pos", "line"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), F.char_length("line").cast("long").alias("n"), F.substring("line", 1, 5).alias("head"))


@query
def manifest_files(spark, sf):
    """Model files of manifests of both shapes, one for each order."""
    p = F.concat(F.when(F.expr("l_linenumber % 4 = 0"), "sub/").otherwise(""), F.lit("m"), F.col("l_linenumber").cast("string"), F.element_at(F.array(*map(F.lit, (".safetensors", ".json", ".bin"))), F.expr("CAST(l_partkey % 3 + 1 AS INT)")))
    one = F.struct(p.alias("rfilename"), F.when(F.expr("l_linenumber % 2 = 0"), F.col("l_partkey")).alias("size"), F.struct(F.col("l_suppkey").alias("size"), F.lit("h").alias("sha256")).alias("lfs"))
    two = F.struct(p.alias("Path"), F.when(F.expr("l_linenumber % 2 = 0"), F.col("l_partkey").cast("string")).otherwise(F.col("l_suppkey").cast("string")).alias("Size"), F.lit("s").alias("Sha256"))
    lines = A.table(spark, sf, "lineitem")
    body = lines.groupBy("l_orderkey").agg(F.when(F.expr("l_orderkey % 8 = 0"), F.to_json(F.collect_list(one))).otherwise(F.to_json(F.collect_list(two))).alias("body"))
    return files.manifest(body, "body")


@query
def missing_shards(spark, sf):
    """Shards of weight maps without a file of any size, and each model's bytes."""
    li = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model"), F.concat(F.lit("m"), (F.col("l_partkey") % 6).cast("string"), F.lit(".safetensors")).alias("shard"), "l_linenumber", "l_suppkey")
    maps = li.groupBy("model").agg(F.to_json(F.struct(F.map_from_entries(F.transform(F.collect_list("shard"), lambda s, i: F.struct(F.concat(F.lit("w"), i.cast("string")), s))).alias("weight_map"))).alias("body"))
    there = li.filter("l_linenumber % 2 = 1").select("model", F.col("shard").alias("path"), F.expr("l_suppkey % 3").alias("size"))
    return files.missing_shards(maps, there)


@query
def weights_bytes(spark, sf):
    f = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model"), F.when(F.expr("l_partkey % 3 = 0"), "a.json").otherwise("a.safetensors").alias("path"), F.col("l_suppkey").alias("size"))
    return files.weights_bytes(f, "model").select("model", F.coalesce("bytes", F.lit(-1)).alias("bytes"))


@query
def spine_paths(spark, sf):
    """Reading order of books whose manifests are order lines."""
    li = A.table(spark, sf, "lineitem")
    items = li.select(F.col("l_orderkey").alias("book"), F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("id"), F.expr("CASE WHEN l_partkey % 4 = 0 THEN '../x.xhtml' ELSE 't' || CAST(l_suppkey % 3 AS STRING) || '.xhtml' END").alias("href"), F.when(F.expr("l_partkey % 5 = 0"), "text/css").otherwise("application/xhtml+xml").alias("media_type"), F.when(F.expr("l_partkey % 7 = 0"), "svg nav").alias("properties"), F.lit("OEBPS").alias("folder"))
    refs = li.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").cast("long").alias("pos"), F.concat(F.lit("i"), ((F.col("l_linenumber") * 3) % 8).cast("string")).alias("idref"))
    return settings.spine(items, refs)


def _model_files(spark, sf):
    """Order lines as files of models: the required ones by line number, others shards; some empty."""
    path = F.expr("CASE l_linenumber WHEN 1 THEN 'config.json' WHEN 2 THEN 'tokenizer.json' WHEN 3 THEN 'model.safetensors.index.json' ELSE 'm' || CAST(l_linenumber AS STRING) || '.safetensors' END")
    return A.table(spark, sf, "lineitem").filter("l_partkey % 11 != 0").select(F.col("l_orderkey").alias("model"), path.alias("path"), F.when(F.expr("l_partkey % 13 = 0"), 0).otherwise(F.col("l_suppkey")).cast("long").alias("size"))


def _checked(spark, sf):
    shards = A.table(spark, sf, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("model"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string"), F.lit(".safetensors")).alias("shard"))
    return models.validated(_model_files(spark, sf), shards)


@query
def model_directories(spark, sf):
    return _checked(spark, sf)


@query
def model_status(spark, sf):
    partial = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("model"), (F.col("o_custkey") % 5).alias("downloaded"))
    return models.status(_checked(spark, sf), partial)


@query
def storage_sizes(spark, sf):
    """Sizes of the folders of parts, without one of them."""
    f = A.paths(spark, sf).select((F.col("p_partkey") % 3).alias("store"), "path", F.col("p_size").alias("size"))
    return models.sizes(f, "store", F.lit("d2"))


@query
def model_order(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN '30b-fp8' WHEN 1 THEN '7b-fp8' ELSE p_brand END").alias("preset"))
    return p.select("p_partkey", models.display_rank(F.col("preset")).cast("long").alias("rank"), settings.display_speed(F.col("p_partkey") * 1000).alias("speed"))


@query
def usable_benchmarks(spark, sf):
    r = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("grp"), (F.col("o_orderkey") * 10).alias("tested_at"), F.when(F.expr("o_orderkey % 4 > 0"), "complete").otherwise("testing").alias("state"))
    return models.usable_benchmarks(r, "grp", 150_000)


@query
def start_attempts(spark, sf):
    e = A.events(spark, sf).select("event_id", "run", "at", (~F.col("ok")).alias("failed"))
    return models.start_attempts(e, "run", [F.col("at"), F.col("event_id")]).select("event_id", "failures", "then")


@query
def upload_limits(spark, sf):
    o = A.table(spark, sf, "orders")
    return o.select("o_orderkey", models.accepts(F.when(F.expr("o_orderkey % 2 = 0"), "file").otherwise("field"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 50000 ELSE o_orderkey % 16384 END")).alias("accepted"))


@query
def ascending_ranges(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100).alias("start"), (F.col("l_linenumber") * 100 + 98 + F.col("l_suppkey") % 4).alias("end"))
    return models.ascending(li, "l_orderkey")


# archives


def _epubs(spark, sf):
    pages = A.table(spark, sf, "pages").select((F.col("page_id") % 50).alias("doc_id"), "page_id", "html")
    books = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("p"))

    def make(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zipped.epub_of([(f"t{x['page_id']}.xhtml", x["html"]) for x in p]) for p in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return books.mapInArrow(make, "doc_id long, content binary")


def _docxs(spark, sf):
    talks = A.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))

    def make(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zipped.docx_of([x["text"] for x in p]) for p in b.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return talks.mapInArrow(make, "doc_id long, content binary")


def _archive_output(files, format_):
    tr = zipped.segments(files, format_).filter("error IS NULL AND seg_id % 2 = 0").select("doc_id", "seg_id", F.concat(F.lit("T & "), F.upper("text")).alias("text"))
    done = zipped.render(render.by_number(files, tr), format_)
    # read again: the written archive holds the old and the new segments
    return zipped.segments(done.select("doc_id", "content"), format_)


@query
def epub_segments(spark, sf):
    return zipped.segments(_epubs(spark, sf), "epub")


@query
def docx_segments(spark, sf):
    return zipped.segments(_docxs(spark, sf), "docx")


@query
def epub_render(spark, sf):
    return _archive_output(_epubs(spark, sf), "epub")


@query
def docx_render(spark, sf):
    return _archive_output(_docxs(spark, sf), "docx")
