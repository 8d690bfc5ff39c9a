"""Suffix-array dedup, n-gram Jaccard join and nearest neighbours against brute force."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.llm import ann, jaccard_join, suffix_dedup
from meshlake.llm.anchors import Anchors

SCHEMA = "doc_id long, text string, rid string, cls string, start long"


def test_deep_shallow_order():
    rng = random.Random(5)
    for _ in range(300):
        s = [b"p" * 9 + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))]
        order, shared = suffix_dedup.deep_shallow(s, rng.choice([0, 8]))
        assert [s[i] for i in order] == sorted(s)
        for k in range(1, len(order)):
            assert shared[k] == suffix_dedup.common_prefix(s[order[k - 1]], s[order[k]])


def test_anchors_depend_on_the_string_alone():
    rng, a = random.Random(3), Anchors(20, 6)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 5, 19, 20, 25, 90, 400]))) for _ in range(50)]
    r, at, covered = a.runs(texts), {}, set()
    for i in range(len(r["doc"])):
        d = int(r["doc"][i])
        for p in range(int(r["start"][i]), int(r["start"][i] + r["count"][i])):
            covered.add((d, p))
            assert at.setdefault(texts[d][p : p + 20], (r["gram"][i], r["start"][i] + r["back"][i] - p)) == (r["gram"][i], r["start"][i] + r["back"][i] - p)
    assert covered == {(d, p) for d, t in enumerate(texts) for p in range(len(t) - 19)}


def removed(rows, length):
    count = defaultdict(int)
    for _, t in rows:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] += 1
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((i, bytes(c for c, g in zip(t, gone, strict=True) if not g), len(re.findall(b"\1+", gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [1024, 3])
def test_suffix_dedup(saved, group):
    rng = random.Random(group)
    base = ["abcdefghij" * 3, "x" * 60, "abab" * 20, "", "the quick brown fox jumps over the lazy dog and runs", "ééé ñ " * 9]
    texts = [rng.choice(base)[rng.randint(0, 5) : rng.randint(10, 60)] + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 30))) + rng.choice(base)[: rng.randint(0, 50)] for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (7, texts[7]), (None, texts[9])]
    df = saved([(i, t, "r", "c", 1) for i, t in rows], SCHEMA)
    got = suffix_dedup.remove_repeats(df, length=20, gram=8, group=group, chunks=(7, 3, 1), carry=("rid",)).collect()
    assert sorted([(r.doc_id, bytes(r.kept), len(r.spans)) for r in got], key=str) == removed([(i, (t or "").encode()) for i, t in rows], 20)
    assert {r.rid for r in got} == {"r"} and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def components(rows, n, percent):
    sets, up = [], list(range(len(rows)))
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("light", [0, 24])
def test_jaccard(saved, monkeypatch, light):
    rng, words = random.Random(11), [f"W{i}" for i in range(40)]
    rows, at = [], 0
    for size in (3, 4, 5, 8, 12, 20, 40, 90):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(5):
                t = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2])):
                    t[rng.randrange(size)] = rng.choice(words)
                t = t[: size - rng.choice([0, 0, 1])]
                rows.append((at, rng.choice([" ", "\n"]).join(t).lower() if rng.random() < 0.5 else " ".join(t)))
                at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, "one"), (at + 3, "ONE "), (3, rows[3][1]), (None, rows[5][1]), (None, "quite alone here and there too")]
    if light != 24:
        monkeypatch.setattr(jaccard_join, "boundary", lambda *_: light)
    df = saved([(i, t, "r", "c", 1) for i, t in rows], SCHEMA)
    got = jaccard_join.jaccard_components(df, 3, 70)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == components(rows, 3, 70)
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_of_common_words_and_rows_without_id(saved):
    """A shingle that every text holds, and many rows without an id, some of them in classes that no id names."""
    rng, rows = random.Random(4), []
    bases = [[f"w{rng.randrange(300)}" for _ in range(30)] for _ in range(120)]
    for i in range(1400):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1])):
            t[rng.randrange(30)] = f"v{rng.randrange(50)}"
        rows.append((None if i % 7 < 5 else i, "the very same four words " + " ".join(t)))
    df = saved([(i, t, "r", "c", 1) for i, t in rows], SCHEMA)
    want = components(rows, 4, 85)
    for bound in (jaccard_join.BROADCAST_IDS, 0):
        got = jaccard_join.jaccard_components(df, 4, 85, broadcast_ids=bound).collect()
        assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == want


def test_near_duplicates_leave_one(saved):
    long = " ".join(f"w{i}" for i in range(120))
    df = saved([(1, long, "", "", 0), (2, long + " more", "", "", 0), (3, "other text of its own", "", "", 0), (4, None, "", "", 0)], SCHEMA)
    assert {r.doc_id for r in jaccard_join.without_near_duplicates(df).collect()} == {1, 3, 4}


def test_prefixes_rule_out_no_link():
    rng = np.random.default_rng(8)
    counts = rng.integers(1, 5, 1 << jaccard_join.SKETCH_BITS).astype(np.uint32)
    seen = set()
    for _ in range(4000):
        pool = rng.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = (np.unique(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(2))
        if rng.random() < 0.5:
            y = np.unique(np.r_[x[rng.random(len(x)) < 0.95], pool[:2]])
        for percent in (70, 85):
            link = jaccard_join.linked(percent, x, y)
            hope = jaccard_join.promising(percent, *(jaccard_join.headed_prefix(s, counts, percent) for s in (x, y)))
            assert hope or not link
            seen.add((link, hope))
    assert seen == {(True, True), (False, True), (False, False)}


def test_boundary_weighs_cost():
    assert jaccard_join.boundary(85, {}) == 0
    assert jaccard_join.boundary(85, {4: 100, 5: 100}) >= 4
    assert jaccard_join.boundary(99, {r: 100 for r in range(1, 90)}) > 24  # no largest size but by cost
    assert math.comb(8, 7) == jaccard_join.subset_cost(85, 8, 8) - sum(math.comb(8, jaccard_join.overlap(85, 8, s)) for s in jaccard_join.partners(85, 8) if s < 8) or jaccard_join.overlap(85, 8, 8) == 8


@pytest.mark.parametrize("kind", ["gaussian", "wide", "norms"])
def test_recall_does_not_hang_on_the_vectors(kind):
    """Recall of 20 nearest in blocks as the index makes them: Gaussian vectors of 64 and of 256 components, and directions with log-normal norms."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 256 if kind == "wide" else 64))
    if kind == "norms":
        x *= rng.lognormal(0, 1, size=(8000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    dim, m = x.shape[1], ann.PROJECTIONS
    a, norms, ids = ann.directions(dim, m, ann.SEED), np.linalg.norm(x, axis=1), np.arange(8000)
    asked = ids[::200]
    best, found, verified = np.full(len(asked), -np.inf), [[] for _ in asked], 0
    for pick in np.array_split(np.argsort(-norms), 2):
        unit = x[pick] / norms[pick[0]]
        values = (np.c_[unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))] @ a).astype("<f4")
        order = np.argsort(values, axis=0)
        data = [np.ascontiguousarray(d).tobytes() for d in (pick, x[pick], np.take_along_axis(values, order, 0).T, np.argsort(order, axis=0).T.astype("<u2"))]
        index = ann.BlockIndex(norms[pick[0]], *data, dim, m)
        for i, rows, score in index.search(asked, x[asked], a, 20, best):
            found[i] += zip(-score, rows, strict=True)
        verified += index.verified
    hits = 0
    for q, got in zip(asked, found, strict=True):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {int(r) for _, r in sorted(got)[:20]})
    assert hits >= 0.95 * 20 * len(asked) and verified < 0.9 * 8000 * len(asked), (hits / 20 / len(asked), verified / 8000 / len(asked))


def test_neighbours(spark, saved):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype("float32")
    x[:300] += 2 * rng.normal(size=16)
    rows = [(i, [float(v) for v in x[i]], "e") for i in range(900)]
    odd = [(1000, None, "e"), (1020, [0.0] * 16, "e"), (1040, [float("nan")] * 16, "e"), (1060, [1.0, None] * 8, "e"), (1080, [1.0] * 3, "e"), (1100, [float("inf")] * 16, "e"), (None, [1.0] * 16, "e"), (901, rows[4][1], "e")]
    df = saved(rows + odd, "vec_id long, embedding array<float>, id string")
    got = ann.search(df, F.col("id") % 20 == 0, k=10, block=256, query_block=16)
    ids = np.array([*range(900), 901])
    v = np.vstack([x, x[4]]).astype(float)
    hits = 0
    answers = defaultdict(list)
    for r in got.collect():
        answers[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(answers) == set(range(0, 900, 20))
    for q, found in answers.items():
        s = v @ v[q]
        order = sorted((-s[k], ids[k]) for k in range(len(ids)) if ids[k] != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(sc - s[np.flatnonzero(ids == i)[0]]) < 1e-9 for _, i, sc in found)
        assert [(-sc, i) for _, i, sc in found] == sorted((-sc, i) for _, i, sc in found)
        hits += len({i for _, i in order} & {i for _, i, _ in found})
    assert hits >= 0.9 * 10 * len(answers)
    few = ann.search(df.where("vec_id < 41"), F.col("id") % 20 == 0, k=50)
    assert few.groupBy("query_id").count().where("count <> 40").count() == 0
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
