"""Exact dedup against a persistent digest index.

The index is a table with one row per distinct normalised text, bucketed and
sorted by digest. A batch is reduced to its distinct digests, anti-joined with
the index by sort-merge and what is new is appended; the index side of that join
needs no shuffle. What is known already goes to a second such table, so that
later copies count. As both hold a digest once per batch, a text with a thousand
million copies is a few rows of them; the only join that meets such a text is the
last one, of rows with index entries, whose sides are both plain shuffles that
AQE splits where a digest is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, text_or_empty


def normalised(text: str = "text") -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), "[ \\t-\\r]+", "")


def _best(points: str, doc_id: str, *more: str) -> Column:
    """The least is the row with the most code points, then the smallest id; a null id comes last."""
    return F.struct((-F.col(points)).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), *[F.col(c) for c in more])


class DigestIndex:
    """Digests seen so far, in the bucketed and sorted tables ``table`` and ``table`` + _more.

    A task writes one file a bucket, one in all where rows are dealt to as many
    tasks as there are buckets; so fewer buckets than a session's least number
    of tasks would mean many small files.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 256):
        self.spark, self.table, self.more, self.buckets = spark, table, f"{table}_more", buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        """Rows (digest, keep_id, keep_points, copies) of the first batch that had each digest, bucketed by digest."""
        return self.spark.table(self.table)

    def _plain(self, table: str) -> DataFrame:
        """A table's rows without its bucketing, as Spark 4.1 groups a union of bucketed tables bucket by bucket of each."""
        files = self.spark.table(table).inputFiles()
        read = self.spark.read.schema(self.spark.table(table).schema)
        return read.parquet(*files) if files else self.spark.table(table)

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(table)

    def _digests(self, docs: DataFrame, *own: str) -> DataFrame:
        return docs.select("doc_id", F.sha2(normalised().cast("binary"), 256).alias("digest"), F.length(text_or_empty()).cast("long").alias("points"), *own)

    def _store(self, rows: DataFrame, *own: str) -> tuple[DataFrame, DataFrame]:
        """Appends a batch of digests; (its groups, those of them that are new)."""
        best = rows.groupBy("digest").agg(F.min(_best("points", "doc_id", *own)).alias("best"), F.count(F.lit(1)).alias("copies"))
        groups = cut(best.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "copies", *[F.col(f"best.{c}").alias("keep_row") for c in own]), "groups")
        entries = groups.drop("keep_row")
        if not self.exists():
            self._append(entries, self.table)
            self._append(entries.limit(0), self.more)
            return groups, groups
        fresh = cut(groups.join(self.read().hint("merge"), "digest", "left_anti"), "fresh")
        self._append(groups.join(fresh, "digest", "left_anti").select(*entries.columns), self.more)
        self._append(fresh.select(*entries.columns), self.table)
        return groups, fresh

    def append(self, docs: DataFrame) -> None:
        """Takes ``docs`` (doc_id, text) into the index."""
        self._store(cut(self._digests(docs), "digests"))

    def add(self, docs: DataFrame, row: str | None = None) -> DataFrame:
        """Dedups ``docs`` (doc_id, text) within itself and against the index, then appends.

        Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept,
        text_sha256. Of equal texts the one with the most code points, then the
        smallest doc_id stays; against earlier batches the earlier text stays.
        group_size counts the copies of all batches so far. Null texts count as
        empty, so they equal texts of white space alone. A null doc_id loses
        against any other. Rows that repeat both doc_id and text are all marked
        as the row that stays, unless ``row`` names a column with a key of its own
        for each row: then the one with the smallest key is marked alone, and the
        key is returned too. Other columns of ``docs`` are not read; an empty
        table gives no rows.
        """
        own = [] if row is None else [row]
        rows = cut(self._digests(docs, *own), "digests")
        groups, fresh = self._store(rows, *own)
        copies = self.spark.table(self.more).groupBy("digest").agg(F.sum("copies").alias("more"))
        first = self.read().select("digest", F.col("keep_id").alias("first_id"), F.col("copies").alias("first_copies"))
        isnew = fresh.select("digest", F.lit(True).alias("fresh"))
        sizes = groups.join(first.hint("merge"), "digest").join(copies.hint("merge"), "digest", "left").join(isnew, "digest", "left")
        sizes = cut(
            sizes.select("digest", F.col("first_id").alias("keep_id"), "keep_points", (F.col("first_copies") + F.coalesce("more", F.lit(0))).alias("copies"), F.coalesce("fresh", F.lit(False)).alias("fresh"), *["keep_row" for _ in own]), "sizes"
        )
        best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")) if row is None else F.col(row) == F.col("keep_row")
        return rows.join(sizes, "digest", "left").select("doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("fresh") & best).alias("kept"), F.col("digest").alias("text_sha256"), *own)

    def settled(self, docs: DataFrame) -> DataFrame:
        """As ``add`` for ``docs`` that the index has taken: of equal texts of all batches the one with the most code points, then the smallest doc_id, stays."""
        every = self._plain(self.table).unionByName(self._plain(self.more))
        best = every.groupBy("digest").agg(F.min(_best("keep_points", "keep_id")).alias("best"), F.sum("copies").alias("copies"))
        entries = cut(best.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_points"), "copies"), "entries")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
        return self._digests(docs).join(entries, "digest", "left").select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
