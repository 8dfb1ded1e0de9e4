"""Each text operator against brute force, and on empty, null, tied and oddly named input."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from roadloom.llm import ann, decontam, langid, licenses, mixing, neardup, quality, queries, sharding, suffixdedup
from roadloom.llm.common import words_of

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra="n_words string, row int, id int, component string"):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], f"doc_id long, text string, {extra}")


# --- decontamination ---


def hits(words, windows):
    marked, found = set(), set()
    for item, w in windows:
        for i in range(len(words) - len(w) + 1):
            if words[i : i + len(w)] == w:
                marked |= set(range(i, i + len(w)))
                found.add(item)
    return marked, found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14])))) for i in range(12)] + [(50, None), (51, ""), (None, "lonely words here"), (3, "again three")]
    rows = [(i, " ".join(rng.choices([*vocabulary, "other", "LONELY", "Words,", "here"], k=rng.randrange(60)))) for i in range(60)] + [(7, None), (7, ""), (None, "w1 w2")]
    docs, benchmark = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    windows = []
    for item, text in items:
        w = words_of((text or "").encode())
        windows += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    want = []
    for i, t in rows:
        w = words_of((t or "").encode())
        marked, found = hits(w, windows)
        want.append((str(i), len(w), len(marked), sorted(str(x) for x in found if x is not None)))
    for size in (32 << 20, 60):  # in one block, and in many
        got = [(str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontam.scan(docs, benchmark, block_bytes=size).collect()]
        assert sorted(got) == sorted(want)
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not n for _, _, n, _ in want)
    for size in (32 << 20, 60):
        cut = sorted((str(r.doc_id), r.text or "") for r in decontam.decontaminate(docs, benchmark, "span", block_bytes=size).collect())
        assert cut == sorted((str(i), cut_by_brute_force(t or "", windows)) for i, t in rows)


def cut_by_brute_force(text, windows):
    """The text without the stretches from the first to the last word of each run of hit words that windows cover."""
    places = [m.span() for m in re.finditer(r"[0-9a-zA-Z\x80-\U0010ffff]+", text)]
    words = [text[a:b].lower().encode() for a, b in places]
    spans = []
    for _, w in windows:
        spans += [(i, i + len(w)) for i in range(len(words) - len(w) + 1) if words[i : i + len(w)] == w]
    out, at = [], 0
    for a, b in decontam.merged(spans):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def test_decontamination_of_empty_tables(spark):
    docs, none = docs_of(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")
    assert decontam.scan(docs, none).first().n_hit == 0
    assert decontam.scan(docs.limit(0), none).collect() == []


# --- licenses ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=14))
def test_template_automaton_equals_regular_expression(words):
    markup = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> <<var;name="x";words="0-2">> c <<var;name="y";match="a|b b">>'
    places = licenses.Automaton([licenses.Template("t", markup)]).places(words)
    pattern = re.compile(licenses.pattern(markup).replace("(?:^| )", "", 1))
    text = [w.decode() + " " for w in words]
    want = [i for i in range(len(text)) if pattern.match("".join(text[i:]))]
    assert [a for _, a, _ in places] == want


def test_license_scan(spark):
    rows = [(1, "The MIT License, and mit license."), (2, None), (2, ""), (None, "Licensed under the Apache License, Version 2.0."), (4, "GNU General Public License " * 3), (5, "general public. licenses")]
    got = {r.doc_id if r.doc_id != 2 else (2, i): r for i, r in enumerate(licenses.scan(docs_of(spark, rows)).collect())}
    assert [(m.label, m.start, m.stop) for m in got[1].matches] == [("mit", 1, 3), ("mit", 4, 6)]
    assert {m.label for m in got[None].matches} == {"apache", "apache-2.0"}
    assert len(got[4].matches) == 3 and got[5].matches == []
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.Template("x", '<<var;name="v";words="1-2">> a')])


# --- language ---


def test_language_is_learnt_and_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "lost", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    rows = [(1, None), (1, ""), (2, "123 !?"), (3, "the the"), (None, "und der " * 20_000), (4, "²"), (5, "thex")]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs_of(spark, rows), model).collect()]
    assert got[:6] == [(1, "und"), (1, "und"), (2, "und"), (3, "en"), (None, "de"), (4, "und")] and got[6][1] == "en"
    assert langid.predict(docs_of(spark, rows), langid.fit(train.limit(0))).where("lang_pred != 'und'").count() == 0
    assert langid.keep(docs_of(spark, rows), model).count() == 3


def test_rare_languages_are_learnt_beside_many(spark):
    rows = [(i, f"common{i % 260}a common{i % 260}b", f"l{i % 260:03}") for i in range(520)] + [(999, "seldom heard", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 261 and model.scorer()(["seldom heard"])[0][0] == "zz"
    rows = [(7, "copied text", "big")] * 5000 + [(999, "seldom heard", "zz")]  # copies under one id count once
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=1)
    assert model.langs == ["big", "zz"] and model.scorer()(["seldom heard"])[0][0] == "zz"


def test_letters_beside_numbers_have_a_language(spark):
    train = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    model = langid.fit(train)
    texts = ["a\u00b2", "the\u00bd", "x\u2460y", "\u00b2\u00bd", "\u2167the", "9the9", "_the_", "\u4e2d", "\u0001"]
    got = [r.lang_pred for r in langid.predict(docs_of(spark, [*enumerate(texts)]), model).orderBy("doc_id").collect()]
    assert [g != "und" for g in got] == [any(c.isalpha() for c in t) for t in texts]
    assert got[1] == got[4] == got[5] == got[6] == "en"


def language_by_brute_force(train, texts, longest=5, least=2):
    """The method on plain dictionaries."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
    parts = lambda w, n: [("_" + w + "_")[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w) if n else [w]
    langs = sorted({lang for _, lang in train})
    counts = [{} for _ in range(longest + 1)]
    for text, lang in set(train):
        for w in letters(text):
            for n in range(longest + 1):
                for g in parts(w, n):
                    counts[n].setdefault(g, {}).setdefault(lang, 0)
                    counts[n][g][lang] += 1
    logs = []
    for n, table in enumerate(counts):
        total = {lang: sum(c.get(lang, 0) for c in table.values()) for lang in langs}
        logs.append({g: [math.log((c.get(lang, 0) + 0.5) / (total[lang] + 0.5 * len(table))) for lang in langs] for g, c in table.items() if n == 1 or sum(c.values()) >= least})
    out = []
    for text in texts:
        words, sums = letters(text), [0.0] * len(langs)
        for w in words:
            for n in [0, *range(longest, 0, -1)]:
                found = [logs[n][g] for g in parts(w, n) if g in logs[n]]
                if found:
                    sums = [s + sum(f[i] for f in found) / len(found) for i, s in enumerate(sums)]
                    break
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)) if words else ("und", 0.0))
    return out


def test_language_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in rows if r.lang and r.text is not None and r.doc_id % 3 == 0]
    texts = [" ".join((r.text or "").split()[:12]) for r in rows] + [f"{(r.text or '')[5:9]}q" for r in rows] + ["", "1", None, "\u0436\u0436", "z"]
    model = langid.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    got = model.scorer()(texts)
    for (lang, score), (want, its) in zip(got, language_by_brute_force(train, texts), strict=True):
        assert math.isclose(score, its, rel_tol=1e-3) and (lang == want or math.isclose(score, 0.5, abs_tol=1e-3))


# --- quality ---


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [np.array([g, 10 + rng.integers(0, 50)]) for g in grades]
    model = quality.Model.fit(rows, grades.tolist(), 3, bits=8, decay=0.1)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.weights[r].sum() for r in rows])
    assert ((model.tails(scores) > 0.5).sum(axis=1) == grades).mean() > 0.95


def test_quality_query_and_odd_texts(spark):
    got = queries.op6_quality(spark, SF).collect()
    labels = {r.doc_id: r for r in queries.grades(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    mean = lambda g: np.mean([r.expected_grade for r in got if r.doc_id in labels and labels[r.doc_id].grade == g])
    assert mean(2) > mean(1)
    ratings = spark.createDataFrame([(1, 0), (1, 2), (2, None), (None, 1)], "doc_id long, grade int")
    docs = docs_of(spark, [(1, "bad"), (2, None), (3, ""), (None, "x " * 50_000)])
    model = quality.fit(docs, ratings, 3)
    assert quality.predict(docs, model, 1).count() == 4 and quality.predict(docs.limit(0), model, 1).count() == 0
    assert quality.predict(docs, quality.fit(docs, ratings.limit(0), 3), 2).count() == 4


# --- mixing ---


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = mixing.fit(docs, queries.domains(spark.read.parquet(f"{SF}/labels.parquet")), queries.MIXTURE)
    rows = fitted.rates(docs).collect()
    total = sum(r.n_tokens for r in rows)
    for i, d in enumerate(fitted.classifier.domains):
        got = sum(r.rate * r.n_tokens * r.posteriors[i] for r in rows) / total
        assert abs(got - queries.MIXTURE[d]) <= 0.02
    assert all(r.rate >= 0 and abs(sum(r.posteriors) - 1) < 1e-9 for r in rows)
    assert mixing.mixed(docs, fitted).columns == docs.columns


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixture_meets_each_target_by_its_own_size(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    fitted = mixing.fit(docs, queries.domains(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")), queries.MIXTURE)
    rows = fitted.rates(docs).collect()
    total = sum(r.n_tokens for r in rows)
    for i, d in enumerate(fitted.classifier.domains):
        got = sum(r.rate * r.n_tokens * r.posteriors[i] for r in rows)
        assert abs(got / total - queries.MIXTURE[d]) <= 0.01 * queries.MIXTURE[d]
        assert math.isclose(got, fitted.totals[d], rel_tol=1e-6)
    assert fitted.met


def test_mixture_tells_of_targets_out_of_reach(spark):
    docs = spark.createDataFrame([(i, "same words in all") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "poor") for i in range(40)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="targets not met"):
        fitted = mixing.fit(docs, labels, {"good": 0.9, "poor": 0.1})
    assert not fitted.met and max(map(abs, fitted.missed.values())) > 0.1
    assert all(0.5 < r.rate < 2 for r in fitted.rates(docs).collect())


def test_mixture_against_a_plain_solver(spark):
    """The rates nearest to 1 whose totals meet the targets, by many small gradient steps on the multipliers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = mixing.fit(docs, queries.domains(spark.read.parquet(f"{SF}/labels.parquet")), queries.MIXTURE, close=1e-6)
    rows = fitted.rates(docs).collect()
    t, p = np.array([r.n_tokens for r in rows], float), np.array([r.posteriors for r in rows])
    goal = np.array([queries.MIXTURE[d] for d in fitted.classifier.domains]) * t.sum()
    slope = np.zeros(p.shape[1])
    for _ in range(60_000):
        wrong = (t * np.maximum(0, 1 - p @ slope)) @ p - goal
        slope += 0.5 * wrong / t.sum()
    assert np.abs(wrong).max() < 1e-4 * t.sum()
    assert np.abs(np.maximum(0, 1 - p @ slope) - np.array([r.rate for r in rows])).max() < 0.02


def test_an_id_with_many_texts_counts_once(spark):
    docs = spark.createDataFrame([(1, f"good text {i}") for i in range(300)] + [(2, "poor one")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good", 2), (2, "poor", 0)], "doc_id long, domain string, grade int")
    fitted = mixing.Classifier.fit(docs, labels, ["good", "poor"], "doc_id", "text", "domain", 8000, 1 << 10)
    assert math.isclose(fitted.priors[0], fitted.priors[1], abs_tol=0.2)
    model = quality.fit(docs, labels, 3)
    assert quality.predict(docs, model, 1).count() == 301


def test_quality_against_plain_scores(spark):
    """Scores, grades and tails by plain loops; and no small step from the fitted model lowers its loss by much."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, queries.grades(spark.read.parquet(f"{SF}/labels.parquet")), 3)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality.predict(docs, model, 2).collect():
        score = 0.0
        for f in quality.features(texts[r.doc_id]):
            for b in quality.buckets(f, model.bits):
                score += model.weights[b]
        tails = [1 / (1 + math.exp(-(score - c))) for c in model.thresholds]
        assert math.isclose(r.score, score, abs_tol=1e-9) and math.isclose(r.expected_grade, sum(tails), abs_tol=1e-9) and math.isclose(r.tail_probability, tails[1], abs_tol=1e-9)
    rng = np.random.default_rng(1)
    rows, grades = [rng.choice(40, 5, replace=False) for _ in range(400)], []
    for x in rows:
        grades.append(int(np.clip(round(1 + 0.8 * sum(1 if b < 10 else -1 if b < 20 else 0 for b in x) + rng.normal(0, 0.3)), 0, 2)))
    fitted = quality.Model.fit(rows, grades, 3, bits=6, steps=2000, decay=0.5)

    def loss(weights, thresholds):
        s = np.array([weights[x].sum() for x in rows])
        upper = 1 / (1 + np.exp(-(np.append(thresholds, 40.0)[grades] - s)))
        lower = np.where(np.array(grades) > 0, 1 / (1 + np.exp(-(thresholds[np.maximum(np.array(grades) - 1, 0)] - s))), 0.0)
        return -np.log(np.maximum(upper - lower, 1e-9)).sum() + 0.25 * (weights**2).sum()

    best = loss(fitted.weights, fitted.thresholds)
    for _ in range(60):
        assert loss(fitted.weights + rng.normal(0, 0.03, len(fitted.weights)) * (np.arange(64) < 40), fitted.thresholds + rng.normal(0, 0.03, 2)) > best - 0.05


def test_gradient_steps_equal_numpy(spark):
    p = np.array([[0.9, 0.1], [0.2, 0.8], [0.5, 0.5]])
    steps = [[0.5, -2.0], [3.0, 0.1], [-0.2, 0.4]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(x.tolist(),) for x in p], "p array<double>")
    got = [r.r for r in df.select(mixing.rate_of(F.col("p"), steps, 0.9, 0.01).alias("r")).collect()]
    want = np.ones(3)
    for g in steps:
        want = np.maximum(0, want - 0.9 * (p @ np.array(g) + 0.01 * (want - 1)))
    assert np.allclose(got, want)


def test_mixture_of_odd_tables(spark):
    docs = docs_of(spark, [(1, None), (1, ""), (None, "a b"), (2, "c " * 30_000)])
    labels = spark.createDataFrame([(1, "good"), (2, None), (None, "poor"), (2, "other")], "doc_id long, domain string")
    for some in (labels, labels.limit(0)):
        fitted = mixing.fit(docs, some, {"good": 1.0, "poor": 1.0})
        assert fitted.rates(docs).count() == 4
    assert mixing.fit(docs.limit(0), labels, {"good": 1.0}).rates(docs.limit(0)).count() == 0


# --- sharding ---


def test_shards_hold_the_law_and_the_mixture(spark):
    rows = [(i if i % 10 else None, "t", "hot" if i % 3 else f"s{i % 7}" if i % 5 else None) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, source string")
    got = sharding.interleave(docs, 8, carry=["shard", "source"]).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        for source in ("hot", "s1", None):
            whole = sum(r.row.source == source for r in got) / 8
            assert abs(sum(r.shard == s and r.row.source == source for r in got) - whole) <= 2
    assert sharding.interleave(docs.limit(0), 8).collect() == []
    assert len(sharding.interleave(docs.limit(3), 8).collect()) == 3


# --- near-duplicates ---


def groups_by_brute_force(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_brute_force(spark, percent):
    rng = random.Random(percent)
    rows, base = [], [f"w{rng.randrange(500)}" for _ in range(300)]
    for i in range(120):
        words = base[:] if i % 2 else [f"v{rng.randrange(500)}" for _ in range(40)]
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "One\ttwo "), (204, " \n"), (205, rows[3][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs_of(spark, rows), percent).collect()}
    assert got == groups_by_brute_force(rows, percent)


def test_near_duplicates_in_many_parts(spark, monkeypatch):
    """An area of many parts, whose near copies are mostly just under the threshold, gives the same groups."""
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 20_000)
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rng.randrange(2, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows.append((500, " ".join(f"long{i}" for i in range(30_000))))
    rows.append((501, rows[-1][1].replace("long7 ", "other ")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs_of(spark, rows), 85).collect()}
    assert got == groups_by_brute_force(rows, 85)


def test_deduplication_judges_rows_of_one_id_by_their_texts(spark):
    rows = [(1, "one two three four five six"), (5, "one two three four five six"), (5, "quite another text that stays here"), (6, "quite another text that stays here")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, _gone int, _TIE int")
    got = sorted((r.doc_id, r.text) for r in neardup.deduplicate(docs).collect())
    assert got == [rows[0], rows[2]]


def test_recall_of_pairs_at_the_threshold():
    """Pairs of exactly 85 and 80 % similarity share a key and pass the signature distance."""
    rng = np.random.default_rng(5)
    for percent, common, own in ((85, 170, 15), (80, 160, 20)):
        p, most, lost = neardup.plan(percent), neardup.farthest(percent), 0
        for _ in range(1500):
            words = rng.integers(0, 2**63, common + 2 * own, np.uint64)
            pair = np.stack([neardup.signature(np.unique(words[: common + own]), neardup.SLOTS), neardup.signature(np.unique(np.concatenate([words[:common], words[common + own :]])), neardup.SLOTS)])
            keys = p.keys(pair)
            lost += not ((keys[0] == keys[1]).any() and (pair[0] != pair[1]).sum() <= most)
        assert lost <= 1


def test_near_duplicates_of_odd_tables(spark):
    docs = docs_of(spark, [(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (2, "a b c")])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.groups(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "None", True), ("None", "None", True)]
    assert neardup.groups(docs.limit(0)).collect() == []
    assert neardup.deduplicate(docs).count() == 4 and neardup.deduplicate(docs).columns == docs.columns


def test_index_keys_guarantee_the_distance():
    p = neardup.plan(85)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, neardup.SLOTS, np.uint16)
    for _ in range(300):
        b = a.copy()
        b[rng.choice(p.slots, p.distance, replace=False)] ^= np.uint16(1)
        keys = p.keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


# --- repeated windows ---


def removed_by_brute_force(rows, depth):
    seen, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - depth + 1):
            w = b[k : k + depth]
            seen[w] = min(seen.get(w, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] < i:
                gone[k : k + depth] = [True] * depth
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def test_repeated_windows_against_brute_force(spark):
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcé ", k=rng.randrange(30, 200))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choices("abcé ", k=rng.randrange(60))) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "a" * 300), (104, "ab" * 200), (105, rows[4][1]), (106, "x" * 49)]
    rng.shuffle(rows)
    got = {r.doc_id: bytes(r.text or b"") for r in suffixdedup.removed(docs_of(spark, rows), 50).collect()}
    assert got == removed_by_brute_force(rows, 50)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BLOCK", 700)
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    buffer, want = [], suffixdedup.pieces
    batches = docs_of(spark, [(1, text), (2, text[500:2500])]).selectExpr("doc_id as id", "0 as tie", "text").toArrow().to_batches()
    for b, ends, _ids, _ties, places in want(batches, 50, 700):
        first, last, _, _ = suffixdedup.anchors(b, ends, 50)
        buffer.append(int((last - first + 1).sum()))
        assert len(places) == len(ends)
    assert sum(buffer) == 3000 - 49 + 2000 - 49


def test_repeats_of_odd_tables(spark):
    t = "the same text that is longer than fifty bytes by a little"
    docs = docs_of(spark, [(None, t), (1, t), (1, t + "!"), (2, t), (2, t)])
    got = sorted((str(r.doc_id), bytes(r.text).decode()) for r in suffixdedup.removed(docs).collect())
    assert got == [("1", t), ("1", t + "!"), ("2", ""), ("2", ""), ("None", t)]
    assert suffixdedup.removed(docs.limit(0)).collect() == []


def test_repeats_query_on_the_small_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = removed_by_brute_force(rows, 50)
    got = {r.doc_id: r.kept_sha256 for r in queries.op7_repeats(spark, SF).collect()}
    assert got == {i: hashlib.sha256(b).hexdigest() for i, b in want.items()}


# --- nearest neighbours ---


def test_nearest_neighbours_recall(spark):
    found = {}
    for r in queries.op8_nearest(spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    norms = np.sqrt((x * x).sum(axis=1))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norms * norms[q])
        best = [ids[j] for j in np.lexsort((ids, -s)) if j != q][:5]
        got = sorted(found[ids[q]])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(g[2] - s[list(ids).index(g[1])]) < 1e-12 for g in got)
        hit += len({g[1] for g in got} & set(best))
        total += 5
    assert hit >= 0.9 * total


def test_nearest_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [1.0, nan]), (2, [inf, 1.0]), (3, [1.0, None]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [1e-300, 1e-300]), (7, [1.0]), (None, [1.0, 1.0]), (150, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.Index(v).search(queries.F.col("id") % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 4), (0, 2, 5), (0, 3, 6), (0, 4, 150)]
    assert {g[0] for g in got} == {0, 150}
    assert ann.Index(v.limit(0)).search(queries.F.col("id") % 50 == 0).collect() == []


def test_repeated_query_rows_keep_their_neighbours(spark):
    at = lambda d: [math.cos(d / 50), math.sin(d / 50)]
    rows = [(50, at(0)), (50, at(0)), (50, at(0)), (50, at(40)), *[(i, at(i)) for i in range(1, 41)]]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in ann.Index(v, lists=1).search(queries.F.col("id") == 50, 5).collect()]
    assert sorted(got) == sorted([*zip(range(1, 6), (1, 2, 3, 4, 5)), *zip(range(1, 6), (40, 39, 38, 37, 36))])


# --- pipeline ---


def pipeline_by_brute_force(stage, before, after, spark):
    """Whether a stage did to its input what a plain version does."""
    if stage == "language ID":
        kept = {(r.doc_id, r.text) for r in after}
        assert all((r.doc_id, r.text) in kept for r in before if r.lang is not None and sum(c.isalpha() for c in r.text or "") > 400)
        assert not any(r.text is None or not any(c.isalpha() for c in r.text) for r in after)
    elif stage == "near-duplicates":
        want = groups_by_brute_force([(r.doc_id, r.text) for r in before], 80)
        assert {r.doc_id for r in after} == {i for i, (_, c) in want.items() if c == i}
    elif stage == "decontamination":
        items = [words_of((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
        sizes = {len(w) for w in windows}
        clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
        assert {r.doc_id for r in after} == {r.doc_id for r in before if clean(words_of((r.text or "").encode()))}
    elif stage == "mixing":
        # as many copies as the rate's whole part, or one more; the totals of a plain solver are held elsewhere
        docs = spark.createDataFrame(before, spark.read.parquet(f"{SF}/documents.parquet").schema)
        fitted = mixing.fit(docs, queries.domains(spark.read.parquet(f"{SF}/labels.parquet")), queries.MIXTURE)
        rates = {r.doc_id: r.rate for r in fitted.rates(docs).select("row.doc_id", "rate").collect()}
        copies = {i: sum(r.doc_id == i for r in after) for i in rates}
        assert sum(copies.values()) == len(after) and fitted.met
        assert all(math.floor(rate - 1e-9) <= copies[i] <= math.floor(rate + 1e-9) + 1 for i, rate in rates.items())
    else:
        from tokenizers import Tokenizer

        plain, start = Tokenizer.from_file(queries.tokenizer_path()), 0
        got = sorted(after, key=lambda r: r.start)
        for r, d in zip(got, sorted(before, key=lambda d: d.doc_id), strict=True):
            ids = [*plain.encode(d.text or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        pipeline_by_brute_force(name, docs.collect(), out.collect(), spark)
        docs = out


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and an empty table."""
    full = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.schema.fields)
    row = lambda **x: tuple(x.get(f.name) for f in full.schema.fields)
    odd = spark.createDataFrame([row(), row(doc_id=900_001, text=""), row(text="the words and more words " * 9), *[row(doc_id=900_002, text="same words again and again in this one", lang="xx")] * 3], kinds)
    for number, docs in enumerate((full.limit(120).unionByName(odd), full.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{number}-{name.replace(' ', '-')}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == 0 if number else docs.count() > 50
