"""Exact dedup, BPE, packing, token counts and WARC against plain versions, with the defined edge cases."""

import base64
import gzip
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshlake.llm import bpe, exact_dedup, packing, token_counts, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, __id string, part string"
TEXTS = [
    None, "", " ", "a", "a  b", "a\tb\n", "a b", "The  quick\n\n brown fox's 12 dogs' don't", "x" * 5000, "é" * 700 + "ß　 z", "hello<|endoftext|>world <|endoftext|>", "tail ", " lead", "a\r\nb\x0b\x0cc", "😀👍🏽 ok", "\x1c\x1da b",
    "word " * 3000, "a b",
]


def docs(saved):
    rows = [(i, t, "en", "clash", "p") for i, t in enumerate(TEXTS)] + [(2, " ", "en", None, None), (None, "a b", None, None, None), (3, "a", "en", "other", None)]
    return rows, saved(rows, DOCS)


def test_exact_dedup(saved):
    rows, df = docs(saved)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    got = exact_dedup.exact_dedup(df, carry=("text", "__id")).collect()
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        assert r.keep_id == min(i for i in groups[key] if i is not None) and r.group_size == len(groups[key])
        kept[key] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    # Lengths that occur once are settled without any hash, and pairs that occur once without the whole content.
    sizes = defaultdict(list)
    for t in (re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows):
        sizes[len(t.encode())].append(t)
    for r in got:
        same = sizes[r.n_bytes]
        assert (r.prefix_hash is None) == (len(same) == 1)
        assert (r.full_hash is None) == (sum(t[:128] == re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")[:128] for t in same) == 1)
    shuffled = exact_dedup.exact_dedup(df, broadcast_rows=0, hot_keys=1)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in shuffled.collect()) == sorted(str((r.doc_id, r.keep_id, r.group_size)) for r in got)


def test_bpe_equals_the_library():
    t = Tokenizer.from_file(PATH)
    for text in TEXTS:
        want = t.encode(text or "", add_special_tokens=False).ids
        for enc in (bpe.encoder(PATH), packing.whole_encoder(PATH)):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want
        assert bpe.decode(PATH, np.array(want, "<u4").tobytes()) == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text, tokens", [(" " * 5_000_000 + "a", 5_000_000), ("\n" * 5_000_000, 2_500_000), ("x" * 5_000_000, 625_000), ("a" + "\n " * 600_000 + "b", 1_200_001)])
def test_long_runs(text, tokens):
    ids = packing.whole_encoder(PATH).encode(text)
    assert len(ids) == 4 * tokens and bpe.decode(PATH, ids) == text
    short = text[:30_000] + text[-10:]
    assert np.frombuffer(packing.whole_encoder(PATH).encode(short), "<u4").tolist() == Tokenizer.from_file(PATH).encode(short, add_special_tokens=False).ids


def test_encoders_agree_on_white_space(monkeypatch):
    t, rng = Tokenizer.from_file(PATH), random.Random(4)
    monkeypatch.setattr(packing, "LONG_SPACE", 3)
    monkeypatch.setattr(packing, "_LONG_SPACE", regex.compile(r"\s{3,}"))
    parts = [" ", "  ", "\n", "\n\n\n\n", "\t", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "a", "the", "'s", "'ll", "12", "é", "!", "<|endoftext|>", "你", "\r\n", "😀"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = t.encode(text, add_special_tokens=False).ids
        for enc in (bpe.encoder(PATH), packing.whole_encoder(PATH)):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want


def test_bpe_columns(saved):
    rows, df = docs(saved)
    out = bpe.decode_column(bpe.encode_column(df.withColumn("ids", F.lit("old")), PATH), PATH)
    assert out.columns.count("ids") == 1 and {"lang", "__id", "part"} <= set(out.columns)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()) == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    assert bpe.encode_column(df.limit(0), PATH).count() == 0


def test_packing(saved):
    rows, df = docs(saved)
    t, window = Tokenizer.from_file(PATH), 64
    whole = {(i, x): [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, *_ in rows}
    got = packing.pack(df, PATH, window=window).collect()
    seqs, ids = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        ids[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert len(r.ids) == 4 * r.length
    assert sum(r.length for r in got) == sum(len(whole[i, x]) for i, x, *_ in rows)
    used = [sum(n for _, n in v) for _, v in sorted(seqs.items())]
    assert all(u == window for u in used[:-1]) and 0 < used[-1] <= window
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
    for i, x, *_ in rows:
        if i not in (2, 3, None):
            assert sum((p for _, p in sorted(ids[i])), []) == whole[i, x]
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert packing.pack(df, PATH, window=window, broadcast_totals=0).count() == len(got)


def test_ledger(spark, tmp_path):
    ledger = token_counts.TokenLedger(spark, str(tmp_path / "ledger"))
    schema = token_counts.CHANGES + ", extra string"
    first = spark.createDataFrame([("insert", "s", "en", "v1", 10, None, "x"), ("insert", "s", "en", "v1", 10, None, "x"), ("insert", None, None, "v1", None, None, None)], schema)
    assert ledger.apply("b1", first) and not ledger.apply("b1", first)
    assert ledger.apply("b2", spark.createDataFrame([("revise", "s", "en", "v1", 12, 10, None), ("delete", "s", "en", "v1", 10, None, None)], schema))
    totals = lambda: sorted((str(r.source), r.n_docs, r.n_tokens) for r in ledger.totals().collect())
    assert totals() == [("None", 1, 0), ("s", 1, 12)]
    ledger.compact()
    assert totals() == [("None", 1, 0), ("s", 1, 12)] and not ledger.apply("b2", first)
    assert ledger.apply("b3", spark.createDataFrame([("delete", "s", "en", "v1", 12, None, None)], schema))
    ledger.compact()
    assert totals() == [("None", 1, 0)]
    with pytest.raises(Exception, match="unknown operation"):
        ledger.apply("bad", spark.createDataFrame([("upsert", "s", "en", "v1", 1, None, None)], schema))
    assert not ledger.committed("bad") and ledger.apply("none", first.limit(0))
    with pytest.raises(ValueError):
        ledger.apply("../x", first)


def test_warc(saved, tmp_path):
    rows = [(1, "http://a/\r\nx: y é", "same"), (2, None, "same"), (3, "", None), (4, "u", ""), (5, "u", "ü" * 200000), (5, "u", "only"), (None, "n", "same"), (None, "n", "alone"), (7, "u", "tie"), (7, "v", "tie")]
    pages = saved([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    manifest = warc.normalise(warc.write_archives(pages))
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[r.page_id].append((r.record_type, r.refers_to, r.payload_length, r.payload_digest))
    digest = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert seen[1] == [("revisit", 2, 4, digest("same"))] and seen[2] == [("response", None, 4, digest("same"))]
    assert seen[3] == [("revisit", 4, 0, digest(""))] and seen[4] == [("response", None, 0, digest(""))]
    assert sorted(seen[None]) == sorted([("revisit", 2, 4, digest("same")), ("response", None, 5, digest("alone"))])
    assert [x[0] for x in seen[7]] == ["response"] * 2 and sorted(x[2] for x in seen[5]) == [4, 400000]
    first = manifest.first().path
    members = [line.split("\t") for line in open(first + ".idx")]
    data = open(first, "rb").read()
    assert sum(int(x[1]) for x in members) == len(data) and all(gzip.decompress(data[int(a) : int(a) + int(n)]).startswith(b"WARC/1.1") for a, n, *_ in members)
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0)))).count() == 0
    kept = warc.read_archives(warc.normalise(warc.write_archives(pages, least_bytes=5)))
    assert kept.where("page_id = 1").first().record_type == "response"
    (tmp_path / "cut.gz").write_bytes(gzip.compress(gzip.decompress(data)[:-40]))
    with pytest.raises((EOFError, ValueError)):
        warc.normalise_file(str(tmp_path / "cut.gz"), str(tmp_path / "out.gz"))
