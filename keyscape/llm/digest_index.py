"""Operator 9: exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.llm.joins import join_large
from keyscape.session import materialize

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text_col: str = "text"):
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WHITE, "")


class DigestIndex:
    """A table of the distinct normalised texts seen so far, bucketed and sorted by
    SHA-256, so that new data meets it in a sort-merge anti-join without moving it.

    Columns: digest, keep_id and keep_n (the row of a batch with the most code points, then
    the smallest id), rows (of the batch with this text), first (whether the batch brought the
    text). Nothing is ever rewritten: a batch appends its new texts, and a sighting of each
    text that was there. ``labels`` merges the rows of a digest, in place.
    The table lives in the warehouse; ``buckets`` is fixed when it is made.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def labels(self) -> DataFrame:
        """(digest, keep_id, keep_n, group_size) of every text, over all batches."""
        return _best(self.spark.table(self.table).groupBy("digest").agg(
            F.max(F.struct(F.col("keep_n"), (-F.col("keep_id")).alias("low"))).alias("best"),
            F.sum("rows").alias("group_size")))

    def _append(self, groups: DataFrame) -> None:
        (
            groups.select("digest", "keep_id", "keep_n", "rows", "first")
            .repartition(self.buckets, "digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").saveAsTable(self.table)
        )

    def entries(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(i, digest, n): the id, the digest of the normalised text and the code points of
        the original one, stored, for ``add`` and ``label``."""
        return materialize(docs.select(
            F.col(id_col).cast("bigint").alias("i"),
            F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
            F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).alias("n"),
        ), "digest-entries")

    def add(self, entries: DataFrame) -> DataFrame:
        """Deduplicate a batch within itself and against the index, append what is new
        and what was seen again, and return one row per row of the batch: i, keep_id,
        group_size, kept, text_sha256.

        Texts are equal when they are identical without ASCII white space; null
        counts as empty, so null, empty and blank rows are one group. The row of a
        group with the most code points in its original text stays, then the
        smallest id (null last); if the index had the text, the row that it keeps so far
        stays and no new one is kept. group_size counts the rows of all batches so far.
        Of repeated rows with one id, each that equals the kept row is marked kept.
        An empty table adds nothing.
        """
        groups = materialize(_best(entries.groupBy("digest").agg(
            F.max(F.struct(F.col("n").alias("keep_n"), (-F.col("i")).alias("low"))).alias("best"),
            F.count("*").alias("rows"))), "digest-groups")
        labels = groups.withColumn("group_size", F.col("rows"))
        fresh = groups.withColumn("first", F.lit(True))
        if self.exists():
            known = self.labels().hint("merge")
            # both stored before the index grows
            seen = materialize(known.join(groups.select(
                "digest", "rows", F.col("keep_id").alias("id"), F.col("keep_n").alias("len")), "digest"), "digest-seen")
            fresh = materialize(groups.join(known, "digest", "left_anti").withColumn("first", F.lit(True)), "digest-fresh")
            labels = fresh.select("digest", "keep_id", "keep_n", "rows", F.col("rows").alias("group_size")).unionByName(
                seen.select("digest", "keep_id", F.lit(None).cast("int").alias("keep_n"), "rows",
                            (F.col("group_size") + F.col("rows")).alias("group_size")))
            fresh = fresh.unionByName(seen.select(
                "digest", F.col("id").alias("keep_id"), F.col("len").alias("keep_n"), "rows", F.lit(False).alias("first")))
        self._append(fresh)
        return _labelled(entries, labels, "rows")

    def label(self, entries: DataFrame) -> DataFrame:
        """As ``add`` returns, for rows that have been added, over all batches: the best
        row of a text is kept, whichever batch brought it."""
        return _labelled(entries, self.labels(), "group_size")


def _best(groups: DataFrame) -> DataFrame:
    """``best`` (code points, minus the id) as keep_id and keep_n."""
    return groups.withColumns({"keep_id": -F.col("best.low"), "keep_n": F.col("best.keep_n")}).drop("best")


def _labelled(entries: DataFrame, labels: DataFrame, count: str) -> DataFrame:
    out = join_large(entries, labels, "digest", count, entries.count())
    return out.select(
        "i", "keep_id", "group_size",
        (F.col("i").eqNullSafe(F.col("keep_id"))
         & F.coalesce(F.col("n") == F.col("keep_n"), F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, index: DigestIndex, batches: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` with the id, keep_id, group_size, kept and text_sha256, from
    the index after all of them went through it in ``batches`` (by a hash of the id)."""
    entries = index.entries(docs, id_col, text_col)
    for k in range(batches):
        index.add(entries.where(F.pmod(F.xxhash64("i"), F.lit(batches)) == k))
    return index.label(entries).withColumnRenamed("i", id_col)
