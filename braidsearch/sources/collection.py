"""A stored collection: text, metadata, counted terms and vector of every document.

A collection is a folder. ``meta`` states name, vector width, metric and buckets. Every batch is a
version: its rows in a folder of their own, its keys beside them, and the keys of earlier rows it
replaces. Nothing that is stored is written again, a reader leaves out replaced rows, and a
version counts once it stands in ``log``. A row is replaced by a later one with the same text or
the same ``doc_id``, so both are unique among the rows that are read.

Term counts are maintained: a version keeps those of its batch (``batch``) and those of all that is stored once
it counts (``whole``): the earlier whole plus the batch minus the rows that it is the first to replace. So
statistics of the collection are never counted anew; of stored rows only the replaced ones are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidsearch.functions.text import Analyzer, content_key, simple_tokens
from braidsearch.functions.vectors import (
    DEFAULT_DIM,
    Embedder,
    check_width,
    hashed_embedder,
)
from braidsearch.operators.bm25 import number_of_docs, term_totals
from braidsearch.operators.index import count_and_embed, count_terms
from braidsearch.schemas import COLLECTION_LOG, COLLECTION_META
from braidsearch.sources.tables import drop_path, path_exists, read_bucketed, write_bucketed


KEYS = "version int, doc_id bigint, content_id string"
# Counts of terms; the row without a term has the number of documents as its ``df``.
COUNTS = "term string, df bigint, count bigint"


def counts_of(rows: DataFrame) -> DataFrame:
    docs = rows.agg(number_of_docs(rows).alias("df"))
    docs = docs.select(F.lit(None).cast("string").alias("term"), "df", F.lit(0).cast("bigint").alias("count"))
    return term_totals(rows).unionByName(docs)


def summed(counts: DataFrame) -> DataFrame:
    """Counts of several tables as one, without terms that no document holds any more."""
    total = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("count").alias("count"))
    return total.filter("term is null or df > 0")


def latest_by_content(docs: DataFrame) -> DataFrame:
    """The document that stands for each text: ``(content_id, doc_id, copies)``.

    The highest ``seq`` (default: ``doc_id``) wins, ties go to the greater ``doc_id``. Only keys and
    numbers are shuffled, and they combine map-side: a text that fills a third of the batch
    reaches its reducer as one row per task. An id that stands for several texts keeps the latest.
    """
    seq = F.col("seq") if "seq" in docs.columns else F.col("doc_id")
    keyed = docs.select(content_key(F.col("text")).alias("content_id"), "doc_id", seq.alias("seq"))
    order = F.struct("seq", "doc_id")
    by_text = keyed.groupBy("content_id").agg(
        F.max_by("doc_id", order).alias("doc_id"), F.count("*").alias("copies"), F.max("seq").alias("seq")
    )
    newest = F.struct("seq", "content_id")
    return by_text.groupBy("doc_id").agg(
        F.max_by("content_id", newest).alias("content_id"), F.max_by("copies", newest).alias("copies")
    )


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    path: str
    dim: int
    metric: str
    buckets: int

    @staticmethod
    def create(
        spark: SparkSession,
        path: str,
        name: str,
        dim: int = DEFAULT_DIM,
        metric: str = "dot",
        buckets: int | None = None,
    ) -> Collection:
        """Create the collection unless it exists; then width and metric must agree.

        ``buckets`` (default: ``spark.sql.shuffle.partitions``) are those of each batch; size them by
        its bytes. `compact` may choose others for what has been gathered.
        """
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not path_exists(spark, f"{path}/meta"):
            meta = spark.createDataFrame(
                [(name, dim, metric, buckets)], COLLECTION_META
            )
            meta.coalesce(1).write.mode("ignore").parquet(f"{path}/meta")
        found = Collection.open(spark, path)
        if (found.dim, found.metric) != (dim, metric):
            raise ValueError(f"{path} holds width {found.dim} and metric {found.metric}")
        return found

    @staticmethod
    def open(spark: SparkSession, path: str) -> Collection:
        if not path_exists(spark, f"{path}/meta"):
            raise FileNotFoundError(f"no collection at {path}; run the ingestion first")
        meta = spark.read.schema(COLLECTION_META).parquet(f"{path}/meta").first()
        return Collection(spark, path, meta.dim, meta.metric, meta.buckets)

    def _log(self) -> list:
        """``(version, base, buckets)`` of every finished version, one row for each batch."""
        log = f"{self.path}/log"
        if not path_exists(self.spark, log):
            return []
        return self.spark.read.schema(COLLECTION_LOG).parquet(log).orderBy("version").collect()

    def version(self) -> int:
        """Highest version that was written to its end, 0 when nothing was ingested."""
        return max((entry.version for entry in self._log()), default=0)

    def _live(self) -> list:
        """The versions that count: from the latest rebuild or compaction on."""
        log = self._log()
        return [entry for entry in log if entry.version >= log[-1].base]

    def gathered(self) -> bool:
        """Whether the current rows are one version, which is read as a bucketed table."""
        return len(self._live()) == 1

    def read(self) -> DataFrame:
        """The current rows; use the columns you need, the rest is not read.

        Rows that a later batch replaced are left out by their keys; after a rebuild or a
        compaction there are none, and the table is read as it is, bucketed by ``doc_id``.
        """
        live = self._live()
        if not live:
            raise FileNotFoundError(f"collection {self.path} is empty; run the ingestion first")
        batches = [
            read_bucketed(self.spark, self._folder(v.version), "doc_id", v.buckets) for v in live
        ]
        if len(live) == 1:
            return batches[0]
        rows = reduce(DataFrame.unionByName, batches)
        gone = reduce(
            DataFrame.unionByName,
            [self.spark.read.schema(KEYS).parquet(self._folder(v.version, "gone")) for v in live[1:]],
        )
        return rows.join(gone.distinct(), ["version", "doc_id", "content_id"], "left_anti")

    def encode(
        self,
        docs: DataFrame,
        analyzer: Analyzer = simple_tokens,
        embedder: Embedder | None = None,
        merge: bool = True,
    ) -> DataFrame:
        """``(doc_id, text, metadata[, seq])`` as rows of this collection.

        Texts are shuffled once, to their buckets, and analysed there. With ``merge``
        equal texts become the row of the latest one, so each is analysed and
        embedded once; ``copies`` keeps their number. ``doc_id`` is unique in ``docs``; a row without one is an
        error, since no later batch could replace it.
        A given ``embedding`` column is kept and must have the collection's width.
        """
        given = [c for c in ("embedding",) if c in docs.columns]
        unnamed = F.raise_error(F.lit("a document without doc_id cannot be stored")).cast("bigint")
        placed = docs.select(F.coalesce("doc_id", unnamed).alias("doc_id"), "text", "metadata", *given)
        placed = placed.repartition(self.buckets, "doc_id")
        placed = placed.withColumn("content_id", content_key(F.col("text")))
        if merge:
            latest = latest_by_content(docs).withColumnRenamed("content_id", "kept")
            placed = self._in_buckets(placed, latest, self.buckets)
            placed = placed.filter(F.array_contains(F.array("kept"), F.col("content_id"))).drop("kept")
        else:
            placed = placed.withColumn("copies", F.lit(1).cast("bigint"))
        if given:
            counted = count_terms(placed, analyzer)
            return counted.withColumn("embedding", check_width(F.col("embedding"), self.dim))
        return count_and_embed(placed, analyzer, embedder or hashed_embedder(self.dim))

    def upsert(self, rows: DataFrame) -> None:
        """Add encoded, merged rows; stored rows with their text or their id are replaced.

        Only the batch is written. Which stored rows it replaces is found on keys alone, by two
        joins that Spark may broadcast or shuffle; either way the same rows go.
        """
        log = self._live()
        version = self.version() + 1
        added = self._write_rows(rows, version)
        if log:
            stored = reduce(
                DataFrame.unionByName,
                [self.spark.read.schema(KEYS).parquet(self._folder(v.version, "keys")) for v in log],
            )
            same_text = stored.join(added.select("content_id"), "content_id", "left_semi")
            same_id = stored.join(added.select("doc_id"), "doc_id", "left_semi")
            gone = same_text.unionByName(same_id).distinct()
            gone.write.mode("overwrite").parquet(self._folder(version, "gone"))
        self._add_counts(version, log)
        self._finish(version, log[-1].base if log else version)

    def rebuild(self, rows: DataFrame, buckets: int | None = None) -> None:
        """Replace everything; rows with the same text stay separate."""
        version = self.version() + 1
        self._write_rows(rows, version, buckets)
        self._add_counts(version, [], buckets)
        self._finish(version, version, buckets)

    def compact(self, buckets: int | None = None) -> None:
        """Write the current rows as one version, in ``buckets`` if given: size them by what is stored."""
        rows = self.read()
        self.rebuild(rows.repartition(buckets or self.buckets, "doc_id"), buckets)

    def remove_old(self) -> list[int]:
        """Delete the versions that no longer count; no reader may be at work on them."""
        live = {entry.version for entry in self._live()}
        old = [entry.version for entry in self._log() if entry.version not in live]
        removed = []
        for version in old:
            for kind in ("rows", "keys", "gone", "batch", "whole"):
                if drop_path(self.spark, self._folder(version, kind)) and kind == "rows":
                    removed.append(version)
        return removed

    def last_batch(self) -> DataFrame:
        """The rows that the latest upsert or rebuild brought."""
        entry = self._live()[-1]
        return read_bucketed(self.spark, self._folder(entry.version), "doc_id", entry.buckets)

    def term_totals(self, last_batch: bool = False) -> tuple[DataFrame, int]:
        """Maintained `bm25.term_totals` and the number of documents: of all that is stored, or of the last batch.

        Equal to counting `read` or `last_batch`, but no stored row is read.
        """
        entry = self._live()[-1]
        kept = self._counts(entry.version, "batch" if last_batch else "whole")
        if kept is None:
            # written before counts were kept
            kept = counts_of(self.last_batch() if last_batch else self.read())
        return kept.filter("term is not null"), kept.filter("term is null").first().df

    def _counts(self, version: int, kind: str) -> DataFrame | None:
        folder = self._folder(version, kind)
        return self.spark.read.schema(COUNTS).parquet(folder) if path_exists(self.spark, folder) else None

    def _add_counts(self, version: int, log: list, buckets: int | None = None) -> None:
        """Write the counts of a version that is written but does not count yet; ``log`` are those it adds to."""
        rows = read_bucketed(self.spark, self._folder(version), "doc_id", buckets or self.buckets)
        counts_of(rows).write.mode("overwrite").parquet(self._folder(version, "batch"))
        whole = self._counts(version, "batch")
        if log:
            before = self._counts(log[-1].version, "whole")
            if before is None:
                before = counts_of(self.read())
            whole = whole.unionByName(before)
            replaced = self._newly_gone(version, log)
            if replaced is not None:
                less = [F.col("term"), (-F.col("df")).alias("df"), (-F.col("count")).alias("count")]
                whole = whole.unionByName(counts_of(replaced).select(*less))
            whole = summed(whole)
        # those of one batch are summed already
        whole.write.mode("overwrite").parquet(self._folder(version, "whole"))

    def _newly_gone(self, version: int, log: list) -> DataFrame | None:
        """Stored rows that ``version`` is the first to replace, from the batches that hold any; None without such."""
        keys = ["version", "doc_id", "content_id"]
        gone = self.spark.read.schema(KEYS).parquet(self._folder(version, "gone"))
        earlier = [self.spark.read.schema(KEYS).parquet(self._folder(v.version, "gone")) for v in log[1:]]
        if earlier:
            gone = gone.join(reduce(DataFrame.unionByName, earlier), keys, "left_anti")
        held = {row.version for row in gone.select("version").distinct().collect()}
        batches = [self._rows_of(v, gone) for v in log if v.version in held]
        return reduce(DataFrame.unionByName, batches) if batches else None

    def _rows_of(self, entry, keys: DataFrame) -> DataFrame:
        """Rows of one batch whose ``(version, doc_id, content_id)`` is in ``keys``."""
        rows = read_bucketed(self.spark, self._folder(entry.version), "doc_id", entry.buckets)
        rows = rows.select("version", "doc_id", "content_id", "copies", "terms")
        own = keys.filter(F.col("version") == entry.version).groupBy("doc_id")
        own = own.agg(F.collect_set("content_id").alias("listed"))
        found = self._in_buckets(rows, own, entry.buckets)
        return found.filter(F.array_contains("listed", F.col("content_id"))).drop("listed")

    @staticmethod
    def _in_buckets(rows: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
        """Join ``rows``, dealt to ``buckets`` by ``doc_id``, with ``keys``, one row per ``doc_id``: only ``keys`` are shuffled.

        They are hashed, so the rows are not sorted. What else must agree is no matter of equality (``==``), which Spark
        would make a key of the join; it then shuffles the rows anew, and each task writes a file for every bucket.
        """
        return rows.join(keys.repartition(buckets, "doc_id").hint("shuffle_hash"), "doc_id")

    def _folder(self, version: int, kind: str = "rows") -> str:
        return f"{self.path}/{kind}/v{version:06d}"

    def _write_rows(self, rows: DataFrame, version: int, buckets: int | None = None) -> DataFrame:
        """Write a batch and its keys; returns the keys."""
        stamped = rows.withColumn("version", F.lit(version))
        folder = self._folder(version)
        written = write_bucketed(stamped, folder, "doc_id", buckets or self.buckets)
        keys = self._folder(version, "keys")
        written.select("version", "doc_id", "content_id").write.mode("overwrite").parquet(keys)
        return self.spark.read.schema(KEYS).parquet(keys)

    def _finish(self, version: int, base: int, buckets: int | None = None) -> None:
        done = self.spark.createDataFrame([(version, base, buckets or self.buckets)], COLLECTION_LOG)
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
