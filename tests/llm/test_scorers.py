"""Toxicity and quality: automata and gradients against plain versions, held-out accuracy, edge cases; and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from meshlake.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_automaton_equals_edit_distance():
    rng, terms, stems = random.Random(1), ["abcde", "abcab", "bcdeabcdeabc", "ccc", "eeaab"], ["abd", "cab"]
    s = toxicity.Scorer({t: 1.0 + i for i, t in enumerate(terms)} | {x + "*": 1.0 for x in stems})
    names = [*terms, *(x + "*" for x in stems)]
    for _ in range(20000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 13)))
        near = [d for t in terms if (d := distance(w, t)) <= toxicity.edits_of(t)]
        stem, m = any(w.startswith(x) for x in stems), s.lookup(w)
        if near and (min(near) == 0 or not stem):
            assert m is not None and m[1] == min(near)
        elif stem:
            assert names[m[0]].endswith("*") and m[1] == 0
        else:
            assert m is None


def test_context_and_tokens():
    s = toxicity.Scorer({"worthless": 5.0, "scum": 5.0})
    assert [m[1:3] for m in s.matches("you WORTHLESS!! w0rthless (scum) scam wrthless")] == [(0, 0), (0, 1), (1, 0), (0, 1)]
    quoted = s.matches('the report called it "worthless" at last')[0]
    direct = s.matches("you are worthless scum")[0]
    assert quoted[3] and not quoted[4] and direct[4] and not direct[3]
    assert s.matches("") == [] and s.features("")[0] == 0


def own(*key):
    """Words that are nobody else's, without letters that could be terms."""
    return " ".join(f"{'_'.join(map(str, key))}_{k}" for k in range(6))


def sample(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, y int, doc_id long")


def test_rare_terms_and_two_edits(spark):
    rows = [(f"{own(i)}{' rareslur' if i < 8 else ''}", 1) for i in range(300)] + [(own(i), 0) for i in range(300, 3300)]
    copies = [(f"{' '.join(f'copied{chr(97 + k)}' for k in range(40))} {i}", 1) for i in range(30)]
    terms = toxicity.learn_terms(sample(spark, rows + copies))
    assert "rareslur" in terms and not any(t.startswith("copied") for t in terms)
    assert [toxicity.Scorer({t: 5.0}).lookup(w)[1] for t, w in (("abominable", "abomnabl"), ("disgustingl", "disgstngl"))] == [2, 2]


def test_sample_bounds_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i % 7}") for i in range(500)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    assert labelled.training_sample(docs, labels, "toxic", 2).count() == 2
    rows = labelled.training_sample(docs, labels, "toxic", 1000).collect()
    assert len(rows) == labels.where(~labelled.held_out()).count()


def test_likelihood_ratio():
    assert toxicity.likelihood_ratio(5, 10, 50, 100) == pytest.approx(0) and toxicity.likelihood_ratio(10, 10, 100, 100) == 0
    assert toxicity.likelihood_ratio(10, 20, 0, 30) > toxicity.likelihood_ratio(5, 20, 0, 30) > 3.84


def test_misspelled_forms_of_a_stem(spark):
    rows = [(f"{own(w[4:], i)} {w}", 1) for w in ("idiot", "idiots", "idiotic") for i in range(40)] + [(own(i), 0) for i in range(300)]
    terms = toxicity.learn_terms(sample(spark, rows))
    s = toxicity.Scorer(terms)
    assert any(t.endswith("*") for t in terms)
    assert [m[2] for m in s.matches("id1otic 1diots idoot idiotic plain")] == [1, 1, 1, 0]


def test_held_out_toxicity(spark):
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.93
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())


def test_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    w = quality.fit(x, starts, y, steps=1)
    _, grad = quality.gradients(w, x, starts, y, 0.0)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        slope = (quality.gradients(up, x, starts, y, 0.0)[0] - quality.gradients(down, x, starts, y, 0.0)[0]) / 2e-5
        assert grad[k][at] == pytest.approx(slope, abs=1e-6)


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.93 and len(got) == 1000


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edge_cases(spark, saved, module):
    docs = saved([(1, None, "x"), (2, "", "x"), (None, "bad bad", "x"), (3, "bad " * 9000, "x"), (3, "bad", "x"), (4, "fine text", None)], "doc_id long, text string, score string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blank = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (empty, blank):
        model = module.train(docs, labels)
        rows = module.score(docs, model).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert module.score(docs.limit(0), model).count() == 0
    flags = docs.select(labelled.held_out().alias("h")).collect()
    assert all(r.h is not None for r in flags)


def test_pipeline(spark):
    """Over the 0.01 tables; test_queries compares every stage with a plain version."""
    docs, seen = queries.table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), "test")
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert 1000 > seen["toxicity"] > seen["exact_dedup"] > seen["jaccard_join"] == seen["suffix_dedup"]
    assert docs.select("doc_id").distinct().count() == seen["suffix_dedup"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_edge_cases(spark, saved, stage, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ids that repeat, no rows, and extra columns with clashing names."""
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    long = "some words that stand here " * 20_000
    rows = [(1, None, None, None, None, "a", 1), (2, "", "en", "s", 0, None, 2), (None, "no id here", None, "s", 1, "b", 3), (3, long, "en", "s", 2, "b", 4), (3, long, "en", "s", 2, "b", 4), (4, long + "end", "en", None, 3, "b", 5), (4, "other text", "de", "s", 3, "b", 6), (2, "", "en", "s", 0, None, 2)]
    docs = saved(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string, rid long")
    out = stage(spark, docs, sf).collect()
    ids = {r.doc_id for r in out}
    assert ids <= {1, 2, 3, 4, None} and {1, 3} <= ids
    assert stage(spark, docs.limit(0), sf).count() == 0
