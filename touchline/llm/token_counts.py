"""Token counts (operator 9): rollups kept by signed deltas.

A batch of changes is a table (op, doc_id, source, lang, tokenizer, tokens, old_source, old_lang,
old_tokens): ``insert`` adds a document's tokens, ``delete`` takes them away, ``revise`` does both.
``signed`` turns changes into signed rows and ``delta`` sums them by source, language and tokenizer
version, so a batch is as small as its keys before anything is stored.

``Rollup`` keeps one folder per batch id.  A commit writes the delta elsewhere, then renames it to
the batch's folder, which is the commit; a batch that is there already is not written again, and of two
writers of one batch the second finds its folder inside the first's and takes it away.  So a replayed
batch changes nothing, and an executor or driver lost midway leaves no half batch.

``compact`` sums what is there into a fold, which lists the batches it covers and stands beside them;
readers take the fold that covers most and add the batches that it doesn't.  Whatever is committed
meanwhile is in no list and so counts once, and a compaction lost midway changes nothing.  A batch's
folder goes only when an older fold has covered it, so readers that listed before a fold still find it.

Edge cases: null sources and languages are groups of their own; null or empty texts count as
documents with 0 tokens; repeated rows count as often as they come; an unknown op raises; keys whose
documents are all gone keep no row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stage, text_batches
from .tokens import encoder, vocabulary

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokens long"


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", vocab: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) over whole texts."""
    path = vocab or vocabulary(f"{tokenizer}.json")

    def run(batches):
        enc = encoder(path)
        for pdf in batches:
            yield pdf[["doc_id", "source", "lang"]].assign(tokens=[len(enc.ids(t)) for t in pdf["text"]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return text_batches(rows).mapInPandas(run, "doc_id long, source string, lang string, tokens long").withColumn("tokenizer", F.lit(tokenizer))


def inserts(counted: DataFrame) -> DataFrame:
    none = F.lit(None)
    return counted.select(F.lit("insert").alias("op"), "doc_id", *KEYS, "tokens", none.cast("string").alias("old_source"), none.cast("string").alias("old_lang"), none.cast("long").alias("old_tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows: +1 document and its tokens for what comes, -1 and minus the old ones for what goes."""
    new = F.struct(F.col("source"), F.col("lang"), F.col("tokenizer"), F.lit(1).cast("long").alias("n_docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("n_tokens"))
    old = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("tokenizer"), F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    rows = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(old, new))
    rows = rows.otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    return changes.select(F.inline(rows))


def delta(changes: DataFrame) -> DataFrame:
    out = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 or n_tokens <> 0")


class Rollup:
    """Additive totals under ``path``, one folder for each committed batch."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "rollup")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/batches"))

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _fold(self) -> tuple[str | None, set[str]]:
        """The fold that covers most, and the batches that it covers."""
        folds = {n: {r["value"] for r in self.spark.read.text(f"{self.path}/folds/{n}/ids").collect()} for n in self._names("folds")}
        best = max(folds, key=lambda n: (len(folds[n]), n), default=None)
        return best, folds.get(best, set())

    def _snapshot(self) -> tuple[str | None, set[str], set[str]]:
        """(fold, what it covers, the other batches); the fold is read first, so no batch is lost between."""
        fold, covered = self._fold()
        return fold, covered, set(self._names("batches")) - covered

    def batches(self) -> set[str]:
        """Ids (hashed) of all committed batches, folded ones too."""
        _, covered, rest = self._snapshot()
        return covered | rest

    def _put(self, made: str, to: str) -> bool:
        """Rename ``made`` to ``to``; False if another writer was first."""
        done = self._fs.rename(self._at(made), self._at(to))
        nested = self._at(f"{to}/{made.rsplit('/', 1)[1]}")  # a rename onto a folder that exists goes into it
        if self._fs.exists(nested):
            self._fs.delete(nested, True)
            return False
        if not done and not self._fs.exists(self._at(to)):
            raise OSError(f"{to} could not be committed")
        return done

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Store a batch; False, and nothing changes, if it has been stored."""
        name = "b-" + hashlib.sha256(str(batch_id).encode()).hexdigest()[:32]
        if name in self.batches():
            return False
        made = scratch(self.spark, "delta")
        delta(changes).coalesce(1).write.parquet(f"{made}/rows")
        return self._put(made, f"{self.path}/batches/{name}")

    def _sum(self, fold: str | None, names: set[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{n}/rows" for n in sorted(names)] + ([f"{self.path}/folds/{fold}/rows"] if fold else [])
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        fold, _, rest = self._snapshot()
        return self._sum(fold, rest)

    def compact(self) -> None:
        """Put a fold of all batches beside them; then drop what the fold before it covered."""
        fold, covered, rest = self._snapshot()
        if not rest:
            return
        ids = sorted(covered | rest)
        made = scratch(self.spark, "fold")
        self._sum(fold, rest).coalesce(1).write.parquet(f"{made}/rows")
        self.spark.createDataFrame([(i,) for i in ids], "value string").coalesce(1).write.text(f"{made}/ids")
        self._fs.mkdirs(self._at(f"{self.path}/folds"))
        self._put(made, f"{self.path}/folds/all-{hashlib.sha256(' '.join(ids).encode()).hexdigest()[:32]}")
        for name in covered & set(self._names("batches")):
            self._fs.delete(self._at(f"{self.path}/batches/{name}"), True)


def deletes(counted: DataFrame) -> DataFrame:
    none = F.lit(None)
    return counted.select(F.lit("delete").alias("op"), "doc_id", none.cast("string").alias("source"), none.cast("string").alias("lang"), "tokenizer", none.cast("long").alias("tokens"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("tokens").alias("old_tokens"))


def rollup_documents(docs: DataFrame, tokenizers=("byte_bpe_50k",), path: str | None = None) -> DataFrame:
    """Totals over all of ``docs`` by source, lang and tokenizer version, as a corpus comes by its counts:

    every document is inserted uncounted (0 tokens) when it arrives; its count, when there is one, revises
    that; a batch that was loaded a second time under another id is deleted again.  Each batch is
    delivered twice, and batches are folded between, which changes no total."""
    rollup = Rollup(docs.sparkSession, path)
    for name in tokenizers:
        counted = stage(count_tokens(docs, name), "counted")
        arrived = counted.withColumn("tokens", F.lit(0).cast("long"))
        count = counted.select(F.lit("revise").alias("op"), "doc_id", *KEYS, "tokens", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(0).cast("long").alias("old_tokens"))
        for batch, changes in {"arrive": inserts(arrived), "count": count, "again": inserts(counted), "withdraw": deletes(counted)}.items():
            rollup.commit(f"{batch}/{name}", changes)
            rollup.commit(f"{batch}/{name}", changes)  # at-least-once delivery: the second does nothing
        rollup.compact()
    return rollup.totals()
