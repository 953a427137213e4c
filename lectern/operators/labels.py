"""Label table operators: wide <-> long, derived labels, votes, combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as LF


def to_long(df: DataFrame, categories, id_cols=("row_id", "doc_id"),
            extra_cols=(), value_name: str = "label") -> DataFrame:
    """One row per ``(row, category)``: the working form for splits, fits and metrics.

    A narrow ``unpivot`` (Expand): no shuffle, each input row emits one row per category.
    """
    ids = list(id_cols) + list(extra_cols)
    return df.unpivot(ids, list(categories), "category", value_name)


def add_none(df: DataFrame, categories, after: str | None = None, name: str = "none") -> DataFrame:
    """Add the "none of the above" label, placed right after column ``after``."""
    return insert_after(df, name, LF.none_label(categories), after)


def add_or(df: DataFrame, name: str, cols, after: str | None = None) -> DataFrame:
    """Add an OR-derived label (e.g. a category OR its context variant)."""
    return insert_after(df, name, LF.or_label(*cols), after)


def insert_after(df: DataFrame, name: str, col, after: str | None) -> DataFrame:
    cols = [c for c in df.columns if c != name]
    pos = cols.index(after) + 1 if after in cols else len(cols)
    ordered = [F.col(c) for c in cols[:pos]] + [col.alias(name)] + [F.col(c) for c in cols[pos:]]
    return df.select(*ordered)


def majority_vote(votes: DataFrame, keys=("row_id", "category"), vote_col: str = "vote") -> DataFrame:
    """Majority label and full-agreement flag per key from one row per annotator vote.

    Ties give 0. One ``groupBy`` with map-side partial aggregation, so a hot key is
    reduced to one row per map task before the shuffle.
    """
    v = F.col(vote_col)
    return (votes.groupBy(*keys)
            .agg((F.sum(v) * 2 > F.count(F.lit(1))).cast("int").alias("label"),
                 (F.min(v) == F.max(v)).alias("full_agree"),
                 F.count(F.lit(1)).alias("n_votes")))


def label_combinations(df: DataFrame, categories) -> DataFrame:
    """Rows per distinct label combination, with a flag for combinations seen once."""
    return (df.groupBy(LF.combination_key(categories).alias("combination"))
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("singleton", F.col("n_rows") == 1))
