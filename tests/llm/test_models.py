"""Trained operators: held-out accuracy, gradients, windows that score each unit once, and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from segloom.llm import attention, language_id, near_copies, quality
from segloom.llm.attention import INPUTS, STEP, T, UNITS, Attention, window_places, windows
from segloom.llm.common import crc_part, table
from segloom.llm.lm_scoring import score_units

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_windows_score_each_unit_once():
    rng = np.random.default_rng(0)
    n = [0, 1, T - 1, T, T + 1, 5, 400]
    begins = np.cumsum([0, *n])
    units = rng.integers(0, UNITS, begins[-1])
    text, number = window_places(begins)
    x, scored = windows(units, begins, text, number)
    assert sorted(x[:, 1:][scored].tolist()) == sorted(units.tolist())
    model = Attention(np.full(UNITS, 1 / UNITS))
    whole = score_units(model, units, begins)
    alone = [score_units(model, units[a:b], np.array([0, b - a])) for a, b in zip(begins, begins[1:], strict=False) if b > a]
    assert np.allclose(whole, np.concatenate(alone), rtol=1e-4, atol=1e-4)


def test_scores_are_those_of_a_plain_forward_pass():
    """Each unit's probability from loops over places: embeddings of the two ids before, one causal attention, one hidden layer, two softmaxes."""
    rng = np.random.default_rng(4)
    model = Attention(np.arange(1, UNITS + 1)[::-1] / (UNITS * (UNITS + 1) / 2))
    p = {k: (v + rng.standard_normal(v.shape) * 0.05).astype(np.float64) for k, v in model.p.items()}
    model.p = {k: v.astype(np.float32) for k, v in p.items()}
    ids = rng.integers(0, INPUTS, T + STEP + 3)
    got = score_units(model, ids, np.array([0, len(ids)]))
    for place in range(len(ids)):
        number = max(0, -(-(place + 1 - T) // STEP))
        begin = number * STEP
        seen = [ids[k] if k >= 0 else INPUTS for k in range(begin - 1, place)]  # what the window's places up to this one see
        h = [p["e1"][seen[t]] + (p["e2"][seen[t - 1]] if t else 0) + p["at"][t] for t in range(len(seen))]
        q = h[-1] @ p["q"] / np.sqrt(attention.DIM)
        a = np.exp([q @ (x @ p["k"]) for x in h])
        mixed = sum(w * (x @ p["v"]) for w, x in zip(a / a.sum(), h, strict=True))
        h1 = h[-1] + mixed @ p["o"]
        h2 = h1 + np.maximum(h1 @ p["w1"] + p["b1"], 0) @ p["w2"]
        unit, size = min(ids[place], UNITS - 1), UNITS // attention.CLASSES
        outer, inner = h2 @ p["c"] + p["cb"], h2 @ p["m"][unit // size] + p["mb"][unit // size]
        want = outer[unit // size] - np.log(np.exp(outer).sum()) + inner[unit % size] - np.log(np.exp(inner).sum())
        assert abs(got[place] - want) < 1e-3


def test_probabilities_sum_to_one_and_look_back_only():
    model = Attention(np.arange(1, UNITS + 1)[::-1] / (UNITS * (UNITS + 1) / 2))
    x = np.random.default_rng(1).integers(0, UNITS, (1, T + 1))
    h = model.states(x)
    for t in (0, 9):
        lp = model.log_probs(np.repeat(h[t : t + 1], UNITS, axis=0), np.arange(UNITS))
        assert abs(np.exp(lp.astype(np.float64)).sum() - 1) < 1e-3
    y = x.copy()
    y[0, 20:] = (y[0, 20:] + 1) % UNITS
    assert np.array_equal(h[:20], model.states(y)[:20])


def test_gradients():
    model = Attention(np.full(UNITS, 1 / UNITS))
    rng = np.random.default_rng(2)
    x, counted = rng.integers(0, UNITS, (3, T + 1)), rng.random((3, T)) < 0.7
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    _, g = model.gradients(x, counted)
    for name, d in g.items():
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        eps, old = 1e-3, model.p[name][at]
        model.p[name][at] = old + eps
        up = model.gradients(x, counted)[0]
        model.p[name][at] = old - eps
        down = model.gradients(x, counted)[0]
        model.p[name][at] = old
        assert abs((up - down) / (2 * eps) - d[at]) < 0.05 * abs(d[at]) + 2e-4, name


def test_training_learns():
    rng = np.random.default_rng(3)
    units = np.tile(rng.permutation(40), 60)
    begins = np.array([0, len(units)])
    x, scored = windows(units, begins, *window_places(begins))
    model = Attention(np.full(UNITS, 1 / UNITS))
    before = score_units(model, units, begins).sum()
    model.train(x, scored, 150, batch=16)
    assert score_units(model, units, begins).sum() > 0.3 * before
    assert attention.STEP < T


@needs_tables
def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs, crc_part("doc_id", 4) == 2).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_decoding_is_loss_weighted():
    """Language, score and ambiguity against loops over languages and bits."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, 60).astype(np.uint8)) for _ in range(40)]
    x, y = language_id.grams(texts), np.arange(40) % 5
    model = language_id.Model(list("abcde"), x, y)
    lang, score, unsure = model.predict(texts + [b"", b"x"])
    for k, text in enumerate(texts + [b"", b"x"]):
        f = language_id.grams([text])[0].astype(np.float64) @ model.w + model.b
        loss = [sum(t * np.log1p(np.exp(-c * v)) for t, c, v in zip(model.trust, word, f, strict=True)) for word in model.code]
        p = np.exp(-np.array(loss))
        p /= p.sum()
        best = int(p.argmax())
        assert lang[k] == model.languages[best] and abs(score[k] - p[best]) < 1e-5
        assert unsure[k] == (sorted(p)[-2] > language_id.MARGIN * p[best])
    assert sum(lang[k] == "abcde"[k % 5] for k in range(40)) > 35


def test_language_with_clashing_columns(spark):
    rows = [(None if i == 3 else i, ("the cat and the dog " if i % 2 else "le chat et le chien ") * (1 if i else 60_000), "en" if i % 2 else "fr", 1, "x", 0.5, "k", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, at int, id string, score double, k string, n int")
    got = language_id.identify(docs, F.lit(False)).collect()
    assert len(got) == 40 and sum(r.lang_pred == "en" for r in got) == 20 and sum(r.doc_id is None for r in got) == 1


def test_language_sample_is_drawn_before_texts_move(spark):
    """Texts dealt by language would meet in as many tasks as there are languages."""
    rows = spark.range(20_000).selectExpr("id", "concat('text ', id) as text", "if(id % 50 = 0, 'en', 'fr') as lang")
    some = language_id.sample(rows)
    assert {r.lang: r["count"] for r in some.groupBy("lang").count().collect()} == {"en": 400, "fr": 500}
    some.collect()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    written = _shuffled(some)
    assert written and max(written) < 2_000, written


def _shuffled(df):
    """Records that each exchange of an executed plan has written."""
    out, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            open_.append(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        open_ += [kids.apply(i) for i in range(kids.size())]
    return out


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(8)] + [(20 + i, "le chat et le chien " * 3, "fr") for i in range(8)] + [(50, None, "en"), (51, "", None), (52, "12 ½ !", "fr"), (53, "le chat", None), (53, "le chat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, F.lit(False)).collect())
    assert [x[1] for x in got[-5:]] == ["und", "und", "und", "fr", "fr"] and len(got) == len(rows)
    assert {x[1] for x in got[:8]} == {"en"}
    nothing = language_id.identify(docs, F.lit(True)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(docs.filter("false"), F.lit(False)).count() == 0
    one = language_id.identify(docs.filter("lang = 'en'"), F.lit(False)).filter("doc_id < 20").collect()
    assert {r.lang_pred for r in one} == {"en"}


def test_codewords_differ():
    for n in (2, 4, 6, 7, 30):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c}) == n and (np.abs(c.sum(axis=0)) < n).all()


@needs_tables
def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SF.replace("0.01", "0.1"), "documents"), table(spark, SF.replace("0.01", "0.1"), "labels")
    learn = labels.filter("doc_id % 4 != 0")
    model = quality.fit(docs, quality.grades_of(learn))
    assert (np.diff(model.cut) >= 0).all() and (model.w <= 0).all()
    got = quality.with_grades(docs.join(labels.filter("doc_id % 4 = 0"), "doc_id").select("doc_id", "text", "quality", "toxic"), model).collect()
    clean = [r.tail_prob >= model.keep for r in got if r.quality == 1 and r.toxic == 0]
    poor = [r.tail_prob >= model.keep for r in got if r.quality == 0]
    toxic = [r.tail_prob >= model.keep for r in got if r.toxic == 1]
    assert np.mean(clean) > 0.94 and np.mean(poor) < 0.05 and np.mean(toxic) < 0.08
    assert all(0 <= r.expected_grade <= 2 for r in got)


def test_quality_is_the_cumulative_link_model():
    """Grade probabilities and the gradient step against the formula, P(grade <= k) = sigmoid(cut_k - w.x)."""
    rng = np.random.default_rng(0)
    model = quality.Ordinal(4)
    model.cut = np.array([-2.0, -0.5, 1.0])
    model.w[:50] = -rng.random(50)
    for _ in range(20):
        x = np.unique(rng.integers(0, 60, 12))
        s = float(sum(model.w[k] for k in x))
        upto = [1 / (1 + np.exp(-(c - s))) for c in model.cut] + [1.0]
        p = np.diff([0.0, *upto])
        expected, tail = model.grade(x)
        assert abs(expected - sum(k * q for k, q in enumerate(p))) < 1e-6 and abs(tail - p[3]) < 1e-6
    rows = [(np.array([g, 10 + k % 7]), g) for k in range(300) for g in range(3)]
    fitted = quality.Ordinal(3).fit(rows)
    assert (np.diff(fitted.cut) >= quality.GAP).all() and all(abs(fitted.grade(x)[0] - g) < 0.4 for x, g in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "BAD!! BAD!! BAD!!", "x") for i in range(30)] + [(90, None, "x"), (91, "", "x"), (1, "good text here", "x")], "doc_id long, text string, __tail string")
    ratings = spark.createDataFrame([(i, 2 * (i % 2)) for i in range(30)] + [(1, 2), (3, None)], "doc_id long, grade int")
    docs = docs.unionByName(spark.createDataFrame([(None, "good text here", "x"), (92, "good words " * 200_000, "x")], docs.schema))
    graded = quality.with_grades(docs.withColumn("tail_prob", F.lit(1)), quality.fit(docs, ratings))
    assert graded.columns == [*docs.columns, "tail_prob", "expected_grade", "tail_prob_"] and graded.count() == docs.count()
    out = quality.select(docs, quality.fit(docs, ratings))
    assert out.columns == docs.columns and {r.doc_id for r in out.collect() if (r.doc_id or 99) < 50} == set(range(1, 30, 2))
    assert quality.select(docs.filter("false"), quality.fit(docs, ratings.filter("false"))).count() == 0


def edited(words, rng, share):
    return [w if rng.random() > share else f"new{rng.randint(0, 10**6)}" for w in words]


def test_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"{a}{b}{c}" for a in ("tion", "ment", "ing") for b in ("alpha", "beta", "gamma", "delta") for c in range(40)]
    texts = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(80, 200))]
        texts += [" ".join(edited(base, rng, 0.004 if k else 0)) for k in range(rng.randint(1, 60 if g == 0 else 4))]
    texts += [None, "", "  ", "one two three four", texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingles = [frozenset(tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else frozenset() for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(i, j) for i in range(len(texts)) for j in range(i) if shingles[i] == shingles[j] or len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    for i, j in links:
        lo, hi = sorted((find(i), find(j)))
        up[hi] = lo
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.95 * len(links)
    assert all(find(i) == find(c) for i, c in got.items())  # nothing is joined that links don't join
    stay = near_copies.one_of_each(docs)
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(got.values()))
    twice = docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3"))
    assert near_copies.one_of_each(twice).count() == len({got[i] for i in range(3)})
    assert near_copies.groups(docs.filter("false")).count() == 0


def links_of(texts):
    """Brute force: the least number that chains of links at 0.8 reach, and the links."""
    shingles = [frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    for i, j in links:
        lo, hi = sorted((find(i), find(j)))
        up[hi] = lo
    return [find(i) for i in range(len(texts))], links


@pytest.mark.parametrize("many", [False, True])
def test_near_copies_in_chains(spark, many, monkeypatch):
    """Chains in which only neighbours resemble each other, and a crowd of copies of one text that mostly don't: buckets of any size give the groups of brute force."""
    if many:  # every bucket is a large one
        monkeypatch.setattr(near_copies, "SMALL", 2)
        monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(4000)]
    texts = []
    for _ in range(30):
        words = [rng.choice(vocab) for _ in range(150)]
        for _ in range(20):
            at = rng.randrange(140)
            words = [*words[:at], *(rng.choice(vocab) for _ in range(8)), *words[at + 8 :]]
            texts.append(" ".join(words))
    base = [rng.choice(vocab) for _ in range(160)]
    texts += [" ".join(edited(base, rng, rng.choice([0.01, 0.02, 0.03]))) for _ in range(150)]
    long = [rng.choice(vocab) for _ in range(6000)]
    texts += [" ".join(long), " ".join(edited(long, rng, 0.015)), " ".join(edited(long, rng, 0.08))]
    want, links = links_of(texts)
    docs = spark.createDataFrame([(i, t, 1, "m", "s", "k") for i, t in enumerate(texts)], "doc_id long, text string, th long, __id string, root string, `key` string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)
    assert all(want[i] == want[c] for i, c in got.items())
    if many:
        stay = near_copies.one_of_each(docs)
        assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(got.values()))


def test_near_copies_ask_only_where_they_may_connect(spark, monkeypatch):
    """Texts of one component don't meet its small buckets; large ones and those of other components stay."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=150)
        for _ in range(12):
            at, new = rng.randrange(150), rng.choice(words)
            texts.append(" ".join([*base[:at], new, *base[at + 1 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, write = [], near_copies.materialize

    def counted(df, *more):
        out = write(df, *more)
        if {"key", "th", "n", "hub"} <= set(out.columns):
            met.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    got = {r.doc_id: r.component_id for r in near_copies.groups(docs).collect()}
    assert all(got[i] == i // 12 * 12 for i in range(len(texts)))
    assert len(met) == 1 and met[0] <= 12 * len(texts)


def test_near_copies_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (4, "x y"), (5, None), (6, " "), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near_copies.one_of_each(docs).collect()) == [(False, 4), (False, 5), (True, 0)]


@needs_tables
def test_pipeline_does_what_its_stages_say(spark):
    import corpus_pipeline as P

    docs = table(spark, SF, "documents")
    columns = docs.columns
    steps = []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = P.materialize(stage(spark, docs, SF))
        steps.append({tuple(r)[0] for r in docs.collect()})
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    assert steps[0] >= steps[1] >= steps[2] >= steps[3] == steps[4]
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF, "labels").collect()}
    assert sum(labels.get(i) == (1, 0) for i in steps[0]) > 0.9 * sum(v == (1, 0) for v in labels.values())
    assert not any(labels[i][0] == 0 for i in steps[0] & labels.keys())
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len({texts[i] for i in steps[1]}) == len(steps[1])
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    leaked = [i for i in steps[1] if any(t in texts[i] for t in items) and 5 * max(len(t) for t in items if t in texts[i]) > len(texts[i])]
    assert leaked and not set(leaked) & steps[2]
    assert docs.groupBy("shard").count().count() <= P.SHARDS
