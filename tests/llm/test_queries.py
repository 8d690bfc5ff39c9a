"""The registered queries, with their production parameters, against plain versions over a small folder of tables with planted rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meshlake.llm import queries, toxicity

from .test_pairs import components, removed

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The tables of the smallest scale, with nulls, copies, near copies, shared passages, long runs of white space and a shuffled order."""
    sf, con, rng = tmp_path_factory.mktemp("sf"), duckdb.connect(), random.Random(2)
    for t in ("pages", "labels", "embeddings", "conversations", "benchmark"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{sf}/{t}.parquet' (FORMAT parquet)")
    rows = con.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    at = max(i for i, _ in rows) + 1
    base, passage = prose(rng, 300), prose(rng, 80)
    near = base.split(" ")
    planted = [None, "", " ", "\t\n", "one", "ONE", "one two", "One  Two", base, base.upper(), base + " ", "  " + base, base.replace(" ", "\n"), " ".join([*near[:150], "changed", *near[151:]]), " ".join(near[:285])]
    planted += [prose(rng, 50) + " " + passage + " " + prose(rng, 50) for _ in range(3)] + [passage + passage, "ü" * 150, "ü" * 150 + "!", " " * 12_000 + "end", "\n" * 12_000, "tail <|endoftext|> of text", "x" * 20_000]
    rows += [(at + i, t) for i, t in enumerate(planted)]
    rng.shuffle(rows)
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT, spare VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?, 'en', ?, ?, 'x')", [(i, t, f"s{i % 3}", len(t or "")) for i, t in rows])
    con.execute(f"COPY docs TO '{sf}/documents.parquet' (FORMAT parquet)")
    return str(sf), rows


@pytest.fixture(scope="module")
def sql(tables):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet'")
    return lambda name: con.sql(queries.ORACLE_SQL[name]).df().to_dict("records")


def ordered(rows):
    plain = [tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for _, v in sorted(r.items())) for r in rows]
    return sorted(plain, key=str)


@pytest.mark.parametrize("name", ["op1_warc", "op2_suffix_dedup", "op4_jaccard_join", "op9_exact_dedup", "token_rollups_by_pattern"])
def test_equals_sql(spark, tables, sql, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, tables[0]).collect()]
    assert ordered(got) == ordered(sql(name))


def test_suffix_dedup_equals_brute_force(spark, tables):
    got = queries.op2_suffix_dedup(spark, tables[0]).collect()
    want = {i: (kept, spans) for i, kept, spans in removed([(i, (t or "").encode()) for i, t in tables[1]], 200)}
    assert len(got) == len(want)
    for r in got:
        kept, spans = want[r.doc_id]
        assert (r.kept_sha256, r.n_spans, r.n_bytes - r.n_removed) == (hashlib.sha256(kept).hexdigest(), spans, len(kept))
    assert sum(r.n_removed > 0 for r in got) > 10


def test_jaccard_join_equals_brute_force(spark, tables):
    got = queries.op4_jaccard_join(spark, tables[0]).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == components(tables[1], 4, 85)


@pytest.fixture(scope="module")
def encoded(tables):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in tables[1]}, t


def test_bpe_equals_the_library(spark, tables, encoded):
    ids, t = encoded
    got = queries.op6_bpe(spark, tables[0]).collect()
    assert len(got) == len(ids)
    for r in got:
        x = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()


def test_packing_keeps_every_id_once(spark, tables, encoded):
    pieces, used = defaultdict(list), defaultdict(list)
    for r in queries.op3_packing(spark, tables[0]).collect():
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for i, x in encoded[0].items():
        x, at = np.array([*x, 0], "<u4"), 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x), zlib.crc32(x[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(x)
    assert not pieces
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    full = sum(n for p in used.values() for _, n in p)
    assert len(used) == -(-full // 1024)


def test_neighbours_against_all_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    found = defaultdict(list)
    for r in queries.op5_ann(spark, sf).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        s = x @ x[ids == q][0]
        best = [i for _, i in sorted((-s[k], ids[k]) for k in range(len(ids)) if ids[k] != q)[:20]]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        assert all(abs(g[2] - s[ids == g[1]][0]) < 1e-9 for g in got)
        hits += len(set(best) & {g[1] for g in got})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("name, label", [("op7_toxicity", "toxic"), ("op8_quality", "quality")])
def test_scores_leave_the_held_out_fold_alone(spark, tables, name, label):
    """Labels of the held-out fold, lang, source and doc_id change no score."""
    sf = tables[0]
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    assert set(got) == {i for i, _ in tables[1]}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= (0.5 if label == "toxic" else 0.3))
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    module = {"toxic": toxicity, "quality": queries.quality}[label]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = module.train(docs, labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label))))
    again = module.score(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("other")), model).collect()
    assert {r.doc_id: r.score for r in again} == {i: r.score for i, r in got.items()}


def test_token_counts_equal_brute_force(spark, tables):
    import tiktoken

    want = defaultdict(lambda: [0, 0])
    libraries = {}
    for version, file in queries.TOKENIZERS.items():
        with open(public_tokenizers.path(file), "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        libraries[version] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    one, two = libraries
    for i, t in tables[1]:
        n = {v: len(encode(t or "")) for v, encode in libraries.items()}
        if n[one] >= 20:
            for v, tokens in ((one, n[one] + 1), (two, n[two])):
                want[f"s{i % 3}", "en", v][0] += 1
                want[f"s{i % 3}", "en", v][1] += tokens
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in queries.op10_token_counts(spark, tables[0]).collect()}
    assert got == want


def test_pipeline_stage_by_stage(spark, tables):
    """Every stage against a plain version of it over the rows its predecessor kept."""
    sf, rows = tables
    labels = {i: y for i, y in duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()}
    docs, kept = queries.table(spark, sf, "documents"), dict(rows)
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), "test")
        got = texts(out)
        assert out.columns == corpus_pipeline.COLUMNS and out.count() == len(got)
        if name == "toxicity":
            model = toxicity.train(docs, queries.table(spark, sf, "labels"))
            scorer = toxicity.Scorer(model.terms)
            x = np.array([(np.array(scorer.features(t or "")) - model.mean) / model.scale for t in kept.values()]) if model.coef else None
            p = 1 / (1 + np.exp(-(x @ np.array(model.coef[:-1]) + model.coef[-1]))) if model.coef else np.full(len(kept), model.share)
            want = {i: t for (i, t), s in zip(kept.items(), p, strict=True) if s < 0.5 or not scorer.matches(t or "")}
            # So few labels (those outside the held-out fold) teach little; what they must not do is cost clean documents. Accuracy is tested over the 0.01 tables.
            assert sum(i in kept and i not in want for i, y in labels.items() if not y) <= 0.02 * len(labels)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(SPACE.sub(" ", kept[i] or ""), i)
            want = {i: kept[i] for i in first.values()}
        elif name == "jaccard_join":
            want = {i: kept[i] for i, _, least in components(list(kept.items()), 5, 80) if i == least}
        else:
            want = {i: t.decode("utf-8", "ignore") for i, t, _ in removed([(i, (t or "").encode()) for i, t in kept.items()], 200)}
        assert got == want, name
        docs, kept = out, got
    assert len(kept) < len(rows) - 5
    t, seqs = Tokenizer.from_file(PATH), Counter()
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
        seqs[r.sequence_id] += r.length
    assert set(pieces) == set(kept) and max(seqs.values()) <= 1024
    for i, parts in pieces.items():
        assert b"".join(x for _, x in sorted(parts)) == np.array([*t.encode(kept[i], add_special_tokens=False).ids, 0], "<u4").tobytes()
