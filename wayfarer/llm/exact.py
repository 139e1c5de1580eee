"""Exact dedup against a persistent digest index.  DataFrame and SQL functions only.

The index is a Parquet table bucketed and sorted by digest.  A batch of new rows is reduced to one row per
digest (partial aggregation first, so a text copied a million times sends one row per task), compared with the
index by a sort-merge anti-join that reads the index bucket by bucket without moving it, and what is new is appended.
The index outlives the session at its path; the groups that hold a thousandth of all rows or more are broadcast when
the rows look up their answer, so no task gets a hot digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, joined_evenly, pick, quoted, shared_dir, written

SPACE = r"[\x20\x09-\x0D]+"


def digest_of(text):
    """SHA-256 (lowercase hex) of the text with each run of ASCII white space as one space; null is empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "utf-8"), 256)


class DigestIndex:
    """``digest BINARY, keep_id BIGINT`` in ``buckets`` buckets below ``path``; reopening a path keeps its rows.

    Each append writes one sorted file per bucket: rows are first dealt by the same hash that buckets them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """batch: (digest, keep_id), one row per digest.  Only digests that the index lacks are added."""
        new = batch.join(self.rows().hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").select("digest", "keep_id").write.insertInto(self.name)

    def close(self) -> None:
        """Forgets the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def batches_of(hashed: DataFrame, batches: int) -> list[DataFrame]:
    """hashed cut at equal steps between the smallest and the largest id, in order of id; null ids come last."""
    if batches < 2 or dict(hashed.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        return [hashed]
    least, most = hashed.agg(F.min("doc_id"), F.max("doc_id")).head()
    if least is None or least == most:
        return [hashed]
    ends = [least + (most - least) * i // batches for i in range(1, batches)]
    out, before = [], None
    for end in ends:
        out.append(hashed.where(F.col("doc_id") <= end) if before is None else hashed.where(f"doc_id > {before} and doc_id <= {end}"))
        before = end
    return [*out, hashed.where(f"doc_id > {before} or doc_id is null")]


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one per input row.

    The rows meet the index as ``batches`` successive batches by rising id, each anti-joined with all that the index holds
    by then and appended; without an index a new one is made, which goes with the scratch folders.  keep_id is the id
    that the index holds for the text: the smallest id of the first batch that brought it.  group_size counts the rows
    of docs.  A null text equals the empty one.  Rows that repeat an id keep that id each (``dedup`` keeps one of them);
    null ids lose to any other.  An empty table gives no rows; other columns are ignored.
    """
    spark, own = docs.sparkSession, index is None
    folder = shared_dir(spark)
    index = index or DigestIndex(spark, f"{folder}/digests", buckets=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hashed = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.unhex(digest_of(F.col("text"))).alias("digest"))
    hashed = written(hashed, "hashed", folder)
    for batch in batches_of(hashed, batches):
        index.append(batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
    sizes = hashed.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = written(sizes.join(index.rows().hint("merge"), "digest"), "groups", folder)
    if own:
        index.close()
    joined = joined_evenly(hashed, groups, "digest", "group_size", hashed.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay by the index: of equal texts the one whose id it holds.

    With an index that holds earlier data, texts known from there go altogether, unless the row is the one that brought
    the text.  Rows equal in text and id (repeats) leave one.  The texts of losers are never moved.
    """
    d, k, z = (fresh(docs, x) for x in ("wf_digest", "wf_id", "wf_null"))
    raw = F.col(quoted(id_col))
    stay = exact_groups(docs, index, id_col, text_col).where("kept")
    best = stay.select(F.unhex("text_sha256").alias(d), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(k), F.col("doc_id").isNull().alias(z)).distinct()
    marked = docs.withColumn(d, F.unhex(digest_of(F.col(quoted(text_col)))))
    marked = marked.withColumn(k, F.coalesce(raw.cast("string"), F.lit(""))).withColumn(z, raw.isNull())
    # Joined by digest and id together, so that a hot digest is spread over its ids; the repeats of one id fall together.
    return marked.join(best, [d, k, z], "left_semi").dropDuplicates([d, k, z]).drop(d, k, z)
