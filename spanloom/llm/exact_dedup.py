"""Exact deduplication against a persistent index of text digests.

The index is a table of (digest, keep_id, batch), bucketed and sorted by digest, in a folder that driver and executors
share; any session can open it again by its path. A batch of documents is digested where it is (texts aren't shuffled),
its digests are grouped, and the groups are joined with the index by sort-merge joins that read the index's buckets as
they lie: groups that an earlier batch knows take its keep_id, those that the anti-join leaves are new and are appended.

A batch that runs again gives the same rows and appends nothing that is there already, so a job that was lost on the way
is simply run again; what half of an append has left is completed then.

Texts are equal when they are identical after every run of white space (x20, x09-x0D) has become one space; null counts
as empty. Of equal rows of a batch that is the first to have their text, the one with the smallest doc_id stays; rows
without a doc_id stay only if no equal one has an id; of repeated rows one stays. Columns beside doc_id and text aren't
read, so they can have any name. An empty batch appends nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, shared_dir

#: A digest with more than one in so many of a batch's rows is joined by broadcast: there can be no more than these.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text that is compared."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Index:
    """A digest index at a path: `table` is its name in this session, `buckets` the number of its buckets."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)


def _attach(spark: SparkSession, path: str, buckets: int, id_type: str) -> Index:
    table = f"digests_{uuid.uuid4().hex}"
    spark.sql(f"create table {table} (digest binary, keep_id {id_type}, batch bigint) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}/entries'")
    return Index(spark, table, path, buckets)


def create_index(spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint") -> Index:
    """A new, empty index; in the shared folder unless a path is given, with as many buckets as the session has shuffle
    partitions, so that neither side of its joins is dealt out twice."""
    path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(f"{path}/about")
    return _attach(spark, path, buckets, id_type)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that a session, this or another one, has created."""
    about = spark.read.parquet(f"{path}/about").first()
    return _attach(spark, path, about.buckets, about.id_type)


def compact(index: Index, path: str) -> Index:
    """The index written anew to another path, each digest once and each bucket one sorted file."""
    out = create_index(index.spark, path, index.buckets, index.rows().schema["keep_id"].dataType.simpleString())
    kept = index.rows().groupBy("digest").agg(F.min(F.struct("batch", F.col("keep_id").isNull().alias("none"), "keep_id")).alias("e")).select("digest", "e.keep_id", "e.batch")
    _append(kept, out)
    return out


def _append(entries: DataFrame, index: Index) -> None:
    """Append entries; dealt by bucket, so that each bucket gets one file."""
    dealt = entries.select("digest", "keep_id", "batch").repartition(index.buckets, "digest")
    dealt.write.format("parquet").bucketBy(index.buckets, "digest").sortBy("digest").mode("append").saveAsTable(index.table)


def deduplicate(docs: DataFrame, index: Index, batch: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (of the row that stays, of this batch or an earlier one),
    group_size (equal rows of this batch), kept, text_sha256; new texts go into the index under the batch's number.
    Batches are numbered upwards; only batches with smaller numbers are looked at, so that a repeated run of one gives
    the same."""
    digest = F.unhex(F.sha2(normalised(F.col(text)), 256))
    # read again below; the place makes repeated rows distinct and is fixed by being written
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("place")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    groups = rows.groupBy("digest").agg(first, F.count("*").alias("group_size"))
    # of an interrupted append a digest may be there twice
    known = index.rows().where(F.col("batch") < batch).groupBy("digest").agg(F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id")).alias("known"))
    groups = materialize(groups.join(known.hint("merge"), "digest", "left"), "digest-groups")

    own = F.col("known").isNull()
    fresh = groups.where(own).select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).cast("long").alias("batch"))
    _append(fresh.join(index.rows().hint("merge"), "digest", "left_anti"), index)

    groups = groups.select("digest", F.when(own, F.col("first.doc_id")).otherwise(F.col("known.keep_id")).alias("keep_id"), "group_size", F.when(own, F.col("first.place")).alias("keep_place"))
    # digests with a large share of the rows are few: their rows stay where they are
    total = rows.count()
    hot = F.broadcast(groups.where(F.col("group_size") * HOT_SHARE > total))
    there = rows.join(hot, "digest")
    others = rows.join(hot.select("digest"), "digest", "left_anti").join(groups.where(F.col("group_size") * HOT_SHARE <= total), "digest")
    kept = F.coalesce(F.col("place") == F.col("keep_place"), F.lit(False)).alias("kept")
    return there.unionByName(others).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeated(docs: DataFrame, index: Index, batch: int) -> DataFrame:
    """The rows of docs whose text neither an earlier batch nor a row before them has; doc_id must tell rows apart."""
    kept = deduplicate(docs, index, batch).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
