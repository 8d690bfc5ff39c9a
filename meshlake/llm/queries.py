"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, jaccard_join, packing, quality, suffix_dedup, token_counts, toxicity, warc
from .labelled import held_out
from .store import fresh_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.normalise(warc.write_archives(table(spark, sf_dir, "pages")))
    records = warc.read_archives(archives)
    return records.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = bpe.decode_column(ids, path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))), 0.3)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(exact_dedup.normalised(F.col("text")), 256))
    return exact_dedup.exact_dedup(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _rolled_up(spark: SparkSession, batches: list[tuple[str, DataFrame]]) -> DataFrame:
    ledger = token_counts.TokenLedger(spark, fresh_path(spark, "token-ledger"))
    for batch_id, changes in batches:
        ledger.apply(batch_id, changes)
    return ledger.totals()


#: Tokenizer versions of op10, by their files.
TOKENIZERS = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under two public tokenizers. Batches: all documents under either version; the first version revised to count an
    end id a document; documents under 20 tokens of the first version deleted from both; one batch sent again."""
    import public_tokenizers

    one, two = TOKENIZERS
    paths = {v: public_tokenizers.path(f) for v, f in TOKENIZERS.items()}
    counted = written(token_counts.counted(table(spark, sf_dir, "documents").select("source", "lang", "text"), paths), "token-counts")
    n = F.col("counts")
    short = counted.where(n[one] < 20)
    inserts = {v: token_counts.change(counted, "insert", v, n[v]) for v in TOKENIZERS}
    revised = token_counts.change(counted, "revise", one, n[one] + 1, n[one])
    deleted = token_counts.change(short, "delete", one, n[one] + 1).unionByName(token_counts.change(short, "delete", two, n[two]))
    return _rolled_up(spark, [(one, inserts[one]), (two, inserts[two]), ("end-ids", revised), (two, inserts[two]), ("short", deleted)])


def token_rollups_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of op10 with counts that SQL can check: words-1 counts runs of characters other than white space, pieces-1 runs of ASCII letters and digits and
    single other characters. Batches: all documents under either version; words-1 revised to leave out lone bars of tables; documents
    under 20 words deleted; one batch sent again."""
    text = F.coalesce("text", F.lit(""))
    counted = table(spark, sf_dir, "documents").select(
        "source",
        "lang",
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
        F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]")).alias("pieces"),
        F.regexp_count(text, F.lit(r"(?:^|[\x20\x09-\x0D])\|(?=[\x20\x09-\x0D]|$)")).alias("bars"),
    )
    counted = written(counted, "token-counts")
    words, pieces, revised = F.col("words"), F.col("pieces"), F.col("words") - F.col("bars")
    short = counted.where(words < 20)
    inserted = token_counts.change(counted, "insert", "pieces-1", pieces)
    deleted = token_counts.change(short, "delete", "words-1", revised).unionByName(token_counts.change(short, "delete", "pieces-1", pieces))
    return _rolled_up(
        spark, [("words", token_counts.change(counted, "insert", "words-1", words)), ("pieces", inserted), ("bars", token_counts.change(counted.where("bars > 0"), "revise", "words-1", revised, words)), ("pieces", inserted), ("short", deleted)]
    )


QUERIES = {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_packing, op4_jaccard_join, op5_ann, op6_bpe, op7_toxicity, op8_quality, op9_exact_dedup, op10_token_counts, token_rollups_by_pattern)}

ORACLE_SQL = {
    "op1_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM p)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i : substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM h
    """,
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        s AS (SELECT doc_id, p, md5_number(b[p + 1:p + 200]) AS h FROM d, LATERAL (SELECT unnest(range(n - 199)) AS p) WHERE n >= 200),
        r AS (SELECT doc_id, p, max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
              FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
        m AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
        x AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS e FROM m GROUP BY doc_id, span),
        k AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_end, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM x),
        t AS (SELECT d.doc_id, any_value(d.n) AS n, coalesce(sum(k.e - k.a), 0) AS gone, count(k.a) AS spans,
                     string_agg(hex(d.b[k.from_end + 1:k.a]), '' ORDER BY k.a) || hex(any_value(d.b[k.e + 1:]) FILTER (k.back = 1)) AS left_hex, any_value(d.b) AS b
              FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
               CASE WHEN spans = 0 THEN sha256(b) ELSE sha256(unhex(left_hex)) END AS kept_sha256
        FROM t
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                  ELSE list_distinct(list_transform(range(len(ws) - 3), lambda i : ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) END AS grams FROM w),
        n AS (SELECT doc_id, CAST(len(grams) AS BIGINT) AS n FROM g),
        e AS (SELECT doc_id, md5_number(unnest(grams)) AS gram FROM g),
        l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
              WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY u, v, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        both_ways AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u)
        SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
    """,
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        h AS (SELECT doc_id, norm, sha256(norm) AS text_sha256 FROM t),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
        SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256 FROM h JOIN g USING (text_sha256)
    """,
    "token_rollups_by_pattern": r"""
        WITH c AS (
            SELECT source, lang,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
                   len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces,
                   len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x : x = '|')) AS bars
            FROM documents),
        k AS (SELECT * FROM c WHERE words >= 20)
        SELECT source, lang, 'words-1' AS tokenizer_version, count(*) AS n_docs, CAST(sum(words - bars) AS BIGINT) AS n_tokens FROM k GROUP BY source, lang
        UNION ALL
        SELECT source, lang, 'pieces-1', count(*), CAST(sum(pieces) AS BIGINT) FROM k GROUP BY source, lang
    """,
}
