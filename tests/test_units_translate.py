"""Packing under limits, tagged answers, and translators that fail."""

from pyspark.sql import functions as F

from segloom.functions import text as X
from segloom.operators import cache, render, segments, translate, units
from segloom.sources import formats


def packed(spark, texts, batch=25, context=5, budget=None):
    df = spark.createDataFrame([(1, [(i * 2, t) for i, t in enumerate(texts)])], "doc_id long, segments array<struct<seg_id:long,text:string>>")
    sizes = F.transform("segments", lambda s: F.octet_length(s.text).cast("long"))
    starts = units.starts_fixed(F.size("segments"), batch) if budget is None else units.starts_greedy(sizes, batch, context, budget)
    return [(list(u.ids), list(u.context)) for u in df.select(units.units(F.col("segments"), starts, context).alias("u")).first().u]


def test_batches(spark):
    assert packed(spark, "abcde", 2, 1) == [([0, 2], []), ([4, 6], ["b"]), ([8], ["d"])]
    assert packed(spark, ["x" * 500] * 6, budget=1560, context=0) == [([0, 2], []), ([4, 6], []), ([8, 10], [])]
    assert packed(spark, ["x" * 9000, "y"], budget=600, context=0) == [([0], []), ([2], [])]
    assert packed(spark, []) == packed(spark, [], budget=10) == []


def test_limit_is_shared(spark):
    seg = "array<struct<seg_id:long,text:string>>"
    df = spark.createDataFrame([(d, [(i, "t") for i in range(3)]) for d in (5, 9000, 7)], f"doc_id long, segments {seg}")
    got = {r.doc_id: len(r.segments) for r in units.limited(df, 4).collect()}
    assert got == {5: 3, 7: 1}


def test_running_number(spark):
    df = spark.createDataFrame([("b", 1), (None, 5), ("a", 2), ("a", 1)], "g string, x int")
    assert {(r.g, r.x): r.k for r in segments.running_number(df, ["g"], [F.col("x")], "k").collect()} == {(None, 5): 0, ("a", 1): 1, ("a", 2): 2, ("b", 1): 3}


def test_answers_by_tag(spark):
    cases = ["<c2>b</c2><c1> a\nx </c1>", "<c1>a</c1><c1>z</c1><c9>n</c9>", "<c1>open <c2>b</c2>", "<c02>b</c2> <c2>c</c02>", "plain"]
    got = spark.createDataFrame([(c,) for c in cases], "r string").select(X.parse_tagged(F.col("r"), F.lit(2)).alias("p")).collect()
    want = [["a\nx", "b"], ["a", None], [None, "b"], [None, "b"], [None, None]]
    assert [r.p for r in got] == want == [translate.parse(c, 2) for c in cases]


def test_fake_is_its_column(spark):
    for p in ("<c10>x</c10><c2>y</c2>", "none", "<cN></cN>"):
        assert spark.createDataFrame([(p,)], "p string").select(translate.fake_column(F.col("p"))).first()[0] == translate.fake(p)


def prompt(cues, context, target):
    return "".join(f"<c{i + 1}>{c}</c{i + 1}>" for i, c in enumerate(cues))


def test_halves_while_cues_are_missing():
    asked = []

    def ask(p):
        asked.append(p)
        if p.count("</c") > 2:
            raise translate.Fatal("maximum context length")
        return p.replace(">x", ">ok")

    assert translate.translate_batch(ask, ["x1", "x2", "x3", "x4", "x5"], [], "fr", prompt) == ["ok1", "ok2", "ok3", "ok4", "ok5"]
    assert len(asked) == 5


def test_other_fatal_errors_are_not_split():
    asked = []

    def ask(p):
        asked.append(p)
        raise translate.Fatal("no such model")

    assert translate.translate_batch(ask, ["a", "b", "c"], [], "fr", prompt) == [None] * 3 and len(asked) == 1


def test_transient_errors_wait_and_keep_the_best():
    waits, answers = [], iter([translate.Transient("busy", 2.0), "<c1>a</c1>", "", translate.Transient("busy")])

    def ask(p):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    assert translate.translate_batch(ask, ["x", "y"], [], "fr", prompt, waits.append) == ["a", None]
    assert 1.0 <= waits[0] < 3.0


def test_long_single_text_is_halved():
    def ask(p):
        if len(p) > 80:
            raise translate.Fatal("token limit")
        return f"({p})"

    out = translate.translate_one(ask, "word " * 40, "fr", lambda t, _: t)
    assert out and out.count("(") == 4 and "( " not in out and " )" not in out  # halves are trimmed
    assert translate.translate_one(ask, "x" * 200, "fr", lambda t, _: t) is None


def test_halves_are_asked_as_wholes_are(spark):
    """Halved requests have the same context, collapsed runs and wording as whole ones."""
    asked = []

    def ask(p):
        asked.append(p)
        if p.count("</c") > 1 + 1:  # the wording has one
            raise translate.Fatal("maximum context length")
        return "<c1>ok</c1>"

    assert translate.translate_batch(ask, ["a" * 30, "see <c1> here"], ["before"], "fr") == ["ok", "ok"]
    row = spark.createDataFrame([(["a" * 30], ["before"]), (["see <c1> here"], ["before"])], "cues array<string>, context array<string>").select(X.batch_prompt(F.col("cues"), F.col("context"), F.lit("fr")).alias("p")).collect()
    assert asked[1:] == [r.p for r in row]


def test_engine_asks_for_what_the_table_lacks(spark, tmp_path):
    """Two runs over a table on disk: the second one asks nothing and gives the same files; the newest value of a key counts."""
    from segloom.operators import engine

    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (2, "b\nd"), (3, "")], "doc_id long, source string")
    path, asked = str(tmp_path / "table"), spark.sparkContext.accumulator(0)

    def make():
        def ask(p):
            asked.add(1)
            return translate.fake(p)

        return ask

    def save(new):
        new.write.mode("overwrite").parquet(str(tmp_path / "new"))
        kept = spark.read.parquet(str(tmp_path / "new"))
        cache.write(kept.dropDuplicates(["key"]), path, 2)
        return kept

    key = lambda t: spark.createDataFrame([(t,)], "text string").select(X.cache_key(F.lit("m"), F.lit("fr"), F.col("text")).alias("key"), F.concat(F.lit("T:"), F.col("text")).alias("value"))
    assert cache.read(spark, path).count() == 0
    cache.write(key("a").withColumn("value", F.lit("old")), path, 0)
    cache.write(key("a"), path, 1)
    one = {r.doc_id: r for r in engine.produce(docs, "txt", cache.read(spark, path), make, "m", "fr", save, "replace").collect()}
    assert one[1].output == "T:a\ntranslated 1\n\ntranslated 2" and (one[1].n_hits, one[1].n_translated) == (1, 2) and one[3].n_segments == 0
    first = asked.value
    assert first == 2 and cache.read(spark, path).count() == 4
    two = {r.doc_id: r for r in engine.produce(docs, "txt", cache.read(spark, path), make, "m", "fr", lambda new: new, "replace").collect()}
    assert asked.value == first and {k: r.n_hits for k, r in two.items()} == {1: 3, 2: 2, 3: 0}


def test_cache_sends_misses_once(spark):
    df = formats.parse(spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, source string"), "txt").withColumn("segments", segments.of_blocks(F.col("blocks")))
    seg = cache.keyed(segments.explode_segments(df, ["doc_id"]), F.lit("m"), F.lit("fr"))
    table = seg.filter("text != 'b'").select("key", F.upper("text").alias("value"))
    miss = cache.misses(seg, table)
    assert [r.text for r in miss.collect()] == ["b"]
    u = miss.select("doc_id", F.array("seg_id").alias("ids"), F.array("text").alias("cues"), F.array().cast("array<string>").alias("context")).withColumn("prompt", X.batch_prompt(F.col("cues"), F.col("context"), F.lit("fr")))
    new = translate.translate_units(u, lambda: translate.fake, "fr")
    known = cache.hits(seg, table).select("doc_id", "seg_id", F.col("value").alias("text"))
    out = render.by_number(df, known.unionByName(new)).select(render.render("txt", F.col("blocks"), F.col("tr"), "replace")).first()[0]
    assert out == "A\ntranslated 1\nC"
    again = cache.put(table, miss.join(new, ["doc_id", "seg_id"]).select("key", new.text.alias("value")))
    assert cache.misses(seg, again).count() == 0
