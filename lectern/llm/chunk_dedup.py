"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, staged, without_ids

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_MIN, CHUNK_MAX = 768, 8192
# A chunk ends after three characters of these classes (about 1 place in 50 of prose), not
# before CHUNK_MIN characters and at CHUNK_MAX at the latest. The rule looks at the content
# alone, so an insertion moves only the chunk boundaries near it.
BOUNDARY = r"(?<=[e-n][a-m][ \n][a-m])"
CHUNK = rf"(?s).{{{CHUNK_MIN},{CHUNK_MAX}}}?{BOUNDARY}|.{{1,{CHUNK_MAX}}}"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z (only) lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def chunks(norm: Column) -> Column:
    """The text cut at content-defined boundaries; concatenated, the chunks are the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_sha256, recipe)``: each document as the ordered list of its chunks'
    verified identifiers.

    A chunk's identifier is its 64-bit hash and an ordinal among the different chunks of that
    hash. The distinct chunk texts are grouped by (hash, text), so an identifier stands for
    one text and no other: where a hash turns out to have several texts, those chunks are
    numbered and the documents' lists are rebuilt with the numbers. Without such a hash the
    ordinal is 0 everywhere and a list is made in the scan, with no movement of texts.
    """
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    cut = norm.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
                      chunks(F.col("norm")).alias("chunks"))
    listed = staged(cut.select("doc_id", "text_sha256",
                               F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")), "recipes")

    distinct = (norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
                .select(F.xxhash64("chunk").alias("h"), "chunk").distinct())
    clashing = staged(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "clash")
    if clashing.isEmpty():
        return listed
    return _with_ordinals(cut, distinct, clashing)


def _with_ordinals(cut: DataFrame, distinct: DataFrame, clashing: DataFrame) -> DataFrame:
    """Lists of ``hash, ordinal`` pairs, for inputs in which different chunks share a hash."""
    numbered = (distinct.join(clashing, "h", "left_semi")
                .withColumn("ordinal", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long")))
    cut = staged(cut.withColumn("row", F.monotonically_increasing_id()), "cut")
    placed = (cut.select("row", F.posexplode("chunks").alias("pos", "chunk"))
              .withColumn("h", F.xxhash64("chunk")).join(numbered, ["h", "chunk"], "left")
              .groupBy("row")  # a document's own chunks
              .agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("ordinal", F.lit(0).cast("long"))
                                                        .alias("ordinal")))).alias("parts")))
    pairs = F.flatten(F.transform(F.coalesce("parts", F.array()), lambda p: F.array(p["h"], p["ordinal"])))
    return (cut.join(placed, "row", "left")
            .select("doc_id", "text_sha256",
                    F.when(F.col("parts").isNull(), F.array().cast("array<long>")).otherwise(pairs).alias("recipe")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row; rows are in
    one group when their ordered identifier lists are equal, and the row with the largest id
    of a group stays.

    The long texts move once, as distinct chunks; the comparison moves only lists of 8 bytes
    a chunk, pre-aggregated in the map tasks, so a group that holds a third of all rows
    reaches the reducer as one row per map task. Group sizes return to the rows through an
    equi-join with the groups of two rows or more, which AQE splits when it is skewed.

    Defined cases: null text counts as empty, and empty texts form a group; null ids never
    stay over other ids, and a group of null ids alone has a null keep_id and stays; rows that
    repeat id and text all count and, if theirs is the largest id, all have kept = true; an
    empty table gives no rows; other columns are not read.
    """
    listed = recipes(docs, id_col, text_col).withColumn("rh", F.xxhash64("recipe"))
    # a table of its own, so that AQE sees two plain sides and splits the join at a hot group
    groups = staged(listed.groupBy("rh", "recipe")
                    .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"),
                    "groups")
    return (listed.alias("d").join(groups.alias("g"), ["rh", "recipe"], "left")
            .select("doc_id",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that :func:`exact_groups` does not keep.

    Defined cases: those of :func:`exact_groups`; rows without an id all stay; rows that repeat the id
    and text that stay all stay; columns of any name are kept.
    """
    key, sha = free_names(docs.columns, "gone_id", "gone_sha")
    gone = staged(exact_groups(docs, id_col, text_col).where("not kept and doc_id is not null")
                  .select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct(), "gone")
    keyed = docs.withColumns({key: F.col(id_col).cast("long"),
                              sha: F.sha2(normalised(F.col(text_col)).cast("binary"), 256)})
    return without_ids(keyed, gone, [key, sha]).select(*docs.columns)
