"""Line dedup with levelled sorted runs (operator 4).

The index of all lines seen so far is a set of *runs*: bucketed tables sorted by line
hash with, per hash, the number of documents and of lines and the largest document id.
A new batch

1. is aggregated to one row per line hash,
2. is merge-anti-joined with the keys of the runs (same buckets and order on both sides, so
   the runs are not shuffled again),
3. is added at level 0: the hashes that the anti-join leaves become the keys of a new run, the
   others are written beside them as increments of keys that an earlier run holds.  So no
   two runs hold the same key, and an anti-join reads keys only.

When a level holds ``fanout`` runs they are merged into one run of the next level, where
increments meet their key or go on as increments, so a line is rewritten once per level,
i.e. logarithmically often.  A lookup merges the few runs that exist.

A line's key is the line without the blanks at both ends and with A-Z lower-cased;
128 bits of hash stand for it.  Keys of fewer than ``min_chars`` code points are never
dropped.

Skew: batches are pre-aggregated by key before the shuffle.  The join of lines with keys
carries hashes and positions only, never texts; keys with more than one line in
``HOT_KEYS`` of all, of which there are at most that many, are joined by broadcast, so
their lines are not shuffled.

Defined cases: a null or empty text is one empty line; rows that share an id but not
the text are separate documents, rows equal in both count once; a null id sorts below
all others; on a tie for the largest id every holder keeps the line; an empty table
gives an empty result; extra columns are carried inside the ``doc`` struct and cannot
clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlab.functions.arrays import let
from growthlab.functions.ordered import materialize
from growthlab.llm.common import BLANKS, LOWER, UPPER, order_id, packed, release, shuffle_width, text_of
from growthlab.session import drop_path, scratch_path

KEY = ["h1", "h2"]
#: Most keys that are joined by broadcast: 10,000 rows of four numbers.
HOT_KEYS = 10_000


class LineRuns:
    """The levelled runs of one index."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def _write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        (keys.repartition(self.buckets, *KEY).write.partitionBy("is_key").bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", path).format("parquet").saveAsTable(name))
        return name, path

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (h1, h2, ...) whose hash no run holds as a key."""
        for run in self.runs():
            keys = keys.join(run.where("is_key").select(*KEY), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Adds one batch of (h1, h2, n_docs, last_doc, n_lines), a row per hash: hashes that no run
        holds as the keys of a new run, the others as increments beside them."""
        if self.levels:
            new = self.unseen(keys).select(*KEY, F.lit(True).alias("is_key"))
            keys = (keys.join(new, KEY, "left")
                    .select(*KEY, "n_docs", "last_doc", "n_lines", F.coalesce("is_key", F.lit(False)).alias("is_key")))
        else:
            keys = keys.select(*KEY, "n_docs", "last_doc", "n_lines", F.lit(True).alias("is_key"))
        self._place(self._write(keys), 0)

    def _place(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged([self.spark.table(name) for name, _ in old]))
            self._drop(old)
            self._place(merged, level + 1)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"),
                                      F.sum("n_lines").alias("n_lines"), F.max("is_key").alias("is_key"))

    def lookup(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc, n_lines) over all runs, a row per hash."""
        return self._merged(self.runs()).drop("is_key")

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop_path(self.spark, path)

    def drop(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, h1, h2, place): one row per line with a long key.  ``row`` tells
    documents of one id apart by their text."""
    text = text_of(F.col("doc.text"))
    key = lambda line: F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(key(x).alias("key"), i.alias("place"))),
                     lambda s: F.length(s["key"]) >= min_chars)
    return docs.select(order_id("doc.doc_id").alias("id"), F.xxhash64(text).alias("row"), F.inline(lines)).select(
        "id", "row", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "place")


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4,
                   fanout: int = 2) -> DataFrame:
    """Drops every line whose key is found in ``min_docs`` documents or more, except in the
    one with the largest id.  Returns (doc: struct of the input row, n_lines, n_dropped,
    kept_text); other lines stay in place.

    ``batches`` is the number of increments in which the corpus enters the runs; the
    result does not depend on it."""
    spark = docs.sparkSession
    docs = packed(docs)
    lines_path = scratch_path(spark, "lines")
    (keyed_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
     .write.partitionBy("batch").parquet(lines_path))
    lines = spark.read.schema("id long, row long, h1 long, h2 long, place int, batch int").parquet(lines_path)
    runs = LineRuns(spark, shuffle_width(docs), fanout)
    for b in range(batches):
        # a row per document and key first: a line repeated inside a document counts once
        one = (lines.where(F.col("batch") == b).groupBy(*KEY, "id", "row").agg(F.count("*").alias("n_lines"))
               .groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("last_doc"), F.sum("n_lines").alias("n_lines")))
        runs.add(one)
    keys = runs.lookup()
    drops = F.col("n_docs") >= min_docs
    # keys with more than this share of all lines are at most HOT_KEYS, hence broadcast; the
    # lines of the others are shuffled, and no key then has more than that share
    share = F.lit(lines.count() // HOT_KEYS)
    hot = F.broadcast(keys.where(F.col("n_lines") > share).select(*KEY, "last_doc", drops.alias("drops")))
    cold = keys.where(drops & (F.col("n_lines") <= share)).select(*KEY, "last_doc")
    matched = (lines.join(hot.where("drops"), KEY).select("id", "row", "place", "last_doc")
               .unionByName(lines.join(hot, KEY, "left_anti").join(cold, KEY).select("id", "row", "place", "last_doc")))
    # per document, the numbers of the lines to drop; with that the runs have served
    gone = materialize(matched.where(F.col("id") < F.col("last_doc"))
                       .groupBy("id", "row").agg(F.array_sort(F.collect_set("place")).alias("gone")))
    runs.drop()
    drop_path(spark, lines_path)
    release(spark)
    text = text_of(F.col("doc.text"))
    parts = (docs.withColumn("id", order_id("doc.doc_id")).withColumn("row", F.xxhash64(text))
             .join(gone, ["id", "row"], "left"))
    split = F.split(text, "\n")
    return parts.select("doc", F.size(split).cast("long").alias("n_lines"),
                        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), _kept(split).alias("kept_text"))


def _kept(split):
    """The lines whose numbers are not in ``gone``, joined; linear in the number of lines."""
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    return F.when(F.col("gone").isNull(), F.array_join(split, "\n")).otherwise(
        let(lambda s: F.array_join(F.transform(places, lambda i: s[i]), "\n"), s=split))
