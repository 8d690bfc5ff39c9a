"""Token counts kept as additive rollups from signed deltas.

A batch of changes (insert, delete, revise) is summed to one signed row per source, language and tokenizer version. It is written to a folder of its own
and committed by renaming that folder to its batch id, which fails if the id is there already: of two writers of one batch one commits, and a batch that a failure left
unfinished is written anew. Totals are the sum of the last snapshot and of the batches that it does not name. ``compact`` writes such a snapshot, committed the
same way, and removes the batches that are in it; the ids of all batches ever applied stay in a table beside it, which is queried and never collected.

All work is DataFrame aggregation with partial sums before the shuffle, so a source with a third of the rows
is one row a task. The driver lists batches since the last snapshot only. The folder needs a file system whose rename is atomic.

Defined cases: null source, language or version form groups of their own; null counts add nothing; an unknown operation fails the
batch before its commit; repeated rows of one batch all count; an empty batch commits nothing but its id; totals of groups whose documents and tokens are
both zero are left out; other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import rank_encoder
from .store import sliced, tidy

KEYS = ["source", "lang", "tokenizer_version"]
DELTAS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
CHANGES = f"op string, {DELTAS.replace('n_docs long, ', '')}, old_n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes (columns CHANGES) as summed deltas."""
    tokens, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0)), F.col("op")
    unknown = F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("long")
    docs = F.when(op == "insert", F.lit(1)).when(op == "delete", F.lit(-1)).when(op == "revise", F.lit(0)).otherwise(unknown)
    delta = F.when(op == "insert", tokens).when(op == "delete", -tokens).when(op == "revise", tokens - old).otherwise(unknown)
    rows = changes.select(*KEYS, docs.cast("long").alias("d"), delta.cast("long").alias("t"))
    return rows.groupBy(*KEYS).agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens"))


def change(docs: DataFrame, op: str, version: str, tokens: Column, old: Column | None = None) -> DataFrame:
    """One change per row of ``docs`` (columns source and lang)."""
    return docs.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), tokens.cast("long").alias("n_tokens"), (F.lit(None) if old is None else old).cast("long").alias("old_n_tokens"))


def counted(docs: DataFrame, paths: dict[str, str], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the column counts: tokens by tokenizer version, for rank files at ``paths``. A null text has none."""
    rest = [c for c in docs.columns if c not in (text_col, "counts")]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("counts", T.StructType([T.StructField(v, T.LongType()) for v in paths]))])

    @tidy
    def run(batches):
        encoders = [rank_encoder(p) for p in paths.values()]
        for b in sliced(batches):
            texts = [t.as_py() for t in b.column(b.num_columns - 1)]
            columns = [pa.array([len(e.encode(t)) // 4 for t in texts], pa.int64()) for e in encoders]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.StructArray.from_arrays(columns, names=list(paths))], names=[*rest, "counts"])

    return docs.select(*rest, text_col).mapInArrow(run, schema)


class TokenLedger:
    """Rollups in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        p, fs = self._fs(path)
        fs.delete(p, True)

    def _names(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.root}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _commit(self, staged: str, path: str) -> bool:
        """Renames a finished folder; False, and the folder is gone, if the name is taken."""
        jvm = self.spark._jvm
        source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, path))
        _, fs = self._fs(path)
        fs.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(fs.makeQualified(source), fs.makeQualified(target), none)
        except Py4JJavaError as e:
            if not self._exists(path):
                raise e
            self._delete(staged)
            return False
        return True

    def _snapshot(self) -> str | None:
        names = self._names("snapshots")
        return f"{self.root}/snapshots/{names[-1]}" if names else None

    def _merged(self) -> DataFrame:
        """batch_id of all batches that the last snapshot holds."""
        last = self._snapshot()
        return self.spark.read.schema("batch_id string").parquet(f"{last}/merged") if last else self.spark.createDataFrame([], "batch_id string")

    def committed(self, batch_id: str) -> bool:
        # In this order: a compaction in between moves a batch from the first place to the second.
        return self._exists(f"{self.root}/batches/{batch_id}") or not self._merged().where(F.col("batch_id") == batch_id).isEmpty()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False if that id is committed already."""
        if not batch_id or not all(c.isalnum() or c in "-." for c in batch_id) or batch_id.startswith("."):
            raise ValueError(f"batch ids are letters, digits, - and . : {batch_id!r}")
        if self.committed(batch_id):
            return False
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        signed(changes).write.parquet(staged)
        return self._commit(staged, f"{self.root}/batches/{batch_id}")

    def _open(self) -> tuple[DataFrame, list[str]]:
        """Deltas of the last snapshot and of the batches that it does not name; and the names of these."""
        names = self._names("batches")
        if names:
            here = self.spark.createDataFrame([(n,) for n in names], "batch_id string")
            names = sorted(r.batch_id for r in here.join(self._merged(), "batch_id", "left_anti").collect())
        last = self._snapshot()
        paths = [f"{self.root}/batches/{n}" for n in names] + ([f"{last}/totals"] if last else [])
        return self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS), names

    def totals(self) -> DataFrame:
        rows, _ = self._open()
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> bool:
        """Sums all batches up to one snapshot with the ids that it holds; False if another compaction was first. Then its batches and all
        snapshots but the one before it are removed."""
        rows, names = self._open()
        before = self._names("snapshots")
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0").write.parquet(f"{staged}/totals")
        self._merged().unionByName(self.spark.createDataFrame([(n,) for n in names], "batch_id string")).write.parquet(f"{staged}/merged")
        if not self._commit(staged, f"{self.root}/snapshots/{int(before[-1]) + 1 if before else 0:08d}"):
            return False
        for n in names:
            self._delete(f"{self.root}/batches/{n}")
        for n in before[:-1]:
            self._delete(f"{self.root}/snapshots/{n}")
        return True
