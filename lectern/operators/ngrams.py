"""Language identification by character n-grams learnt from labelled documents.

A document's words are counted once, within its row; everything after works on distinct words. The profile
of a language is the smoothed distribution of the 1- to 3-character n-grams of its words
(with a mark at either end of a word); a word's log likelihoods under all languages are the
sums of its n-grams' weights, and a document's the sums of its words', plus the log share
of each language's training documents. The largest wins, the first language on ties.

Words of up to three letters of an alphabet are few: while the model has at most ``HELD_GRAMS``
n-grams, each task holds them and scores the words of its own rows, so no count of a word
travels. A larger model stays a table, and meets the words in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TF
from . import coded as CO
from .lang import UNKNOWN
from .ranking import materialize

SIZES = (1, 2, 3)
EDGE = "_"
ALPHA = 0.5
HELD_GRAMS = 1 << 17  # n-grams of a model that tasks hold
WORDS = 1 << 20       # words of rows that are looked at together
SCORED = 1 << 14      # words that are scored together


def grams(word: Column, sizes=SIZES) -> Column:
    """All n-grams of a word with its edges marked, in one array, repeats included."""
    marked = F.concat(F.lit(EDGE), word, F.lit(EDGE))
    return F.concat(*[F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{n}}})).") if n > 1 else F.lit("(?s)(.)"), F.lit(1))
                      for n in sizes])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, word, tf)``: lower-cased runs of letters."""
    return (docs.select(id_col, F.explode(TF.letter_words(F.col(text_col))).alias("word"))
            .groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("tf")))


def word_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, words array<string>, tfs array<long>)``: a row's distinct lower-cased runs of letters, as often as
    they occur there. Rows without any are left out; rows that share an id stay apart, as all uses
    add up. Nothing is shuffled."""
    from ..session import ship_package

    ship_package(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], T.StructField("words", T.ArrayType(T.StringType())),
                           T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for big in batches:
            for part in CO.slices(big, "words", WORDS):
                lists = part.column("words")
                coded = lists.flatten().dictionary_encode()
                n = max(1, len(coded.dictionary))
                rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                cells, tfs = np.unique(rows * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(cells // n, minlength=part.num_rows)))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(cells % n))),
                     pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], schema.names)

    return docs.select(id_col, TF.letter_words(F.col(text_col)).alias("words")).where("size(words) > 0").mapInArrow(run, schema)


def _singly(counts: DataFrame, *cols: str) -> DataFrame:
    """``(cols…, word, tf)`` of counts in either form."""
    if "words" not in counts.columns:
        return counts.select(*cols, "word", "tf")
    return (counts.select(*cols, F.explode(F.arrays_zip("words", "tfs")).alias("_c"))
            .select(*cols, F.col("_c.words").alias("word"), F.col("_c.tfs").alias("tf")))


def languages(labelled: DataFrame, lang_col: str = "lang") -> list[str]:
    """The labels in order; as many as there are languages."""
    return [r[0] for r in labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().orderBy(lang_col).collect()]


def fit(counts: DataFrame, labelled: DataFrame, langs: list[str], id_col: str = "doc_id", lang_col: str = "lang",
        alpha: float = ALPHA):
    """``counts`` are ``word_counts`` or ``word_lists``. ``(weights, head)``: ``weights (gram, w array)`` holds a gram's log probability per language,
    ``head`` is one row with the log priors and the log probabilities of an unseen gram.

    One aggregate by word, one by gram over the distinct words; no row is sent twice.
    """
    known = labelled.where(F.col(lang_col).isin(*langs)).select(id_col, lang_col)
    per_word = _singly(counts.join(known, id_col), lang_col).groupBy("word").agg(*[
        F.sum(F.when(F.col(lang_col) == x, F.col("tf")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    at = [f"n{i}" for i in range(len(langs))]
    per_gram = materialize(per_word.select(F.explode(grams(F.col("word"))).alias("gram"), *at)
                           .groupBy("gram").agg(*[F.sum(c).alias(c) for c in at]))
    totals = per_gram.agg(F.count(F.lit(1)).alias("size"), *[F.sum(c).alias(f"t{i}") for i, c in enumerate(at)])
    docs = known.agg(F.count(F.lit(1)).alias("all"), *[F.sum((F.col(lang_col) == x).cast("long")).alias(f"d{i}")
                                                       for i, x in enumerate(langs)])
    a = F.lit(alpha)
    below = [F.col(f"t{i}") + a * F.col("size") for i in range(len(langs))]
    head = totals.join(F.broadcast(docs)).select(  # one row each
        F.array(*[F.log(F.col(f"d{i}") / F.col("all")) for i in range(len(langs))]).alias("prior"),
        F.array(*[F.log(a / b) for b in below]).alias("unseen"))
    weights = per_gram.join(F.broadcast(totals)).select(  # one row
        "gram", F.array(*[F.log((F.col(c) + a) / b) for c, b in zip(at, below)]).alias("w"))
    return weights, head


def _added(arrays: str, n: int, times: Column | None = None) -> Column:
    one = lambda i: F.get(arrays, F.lit(i)) if times is None else times * F.get(arrays, F.lit(i))
    return F.array(*[F.sum(one(i)) for i in range(n)])


def _scored_by_joins(counts: DataFrame, weights: DataFrame, head: DataFrame, n: int, id_col: str) -> DataFrame:
    """``(id, tf, s, grams)`` of every count: its word's sums and n-grams."""
    words = counts.select("word").distinct().select("word", F.explode(grams(F.col("word"))).alias("gram"))
    of_word = (words.join(weights, "gram", "left").join(F.broadcast(head.select("unseen")))  # one row
               .select("word", F.coalesce("w", "unseen").alias("w"))
               .groupBy("word").agg(_added("w", n).alias("s"), F.count(F.lit(1)).alias("grams")))
    return counts.join(materialize(of_word), "word").select(id_col, "tf", "s", "grams")


def _held(weights: DataFrame, head: DataFrame):
    """``(keys, table)`` of a model of HELD_GRAMS n-grams at most: the grams as rising numbers and their
    weights, and a last row with those of an unseen gram. None for a larger or an empty model."""
    import numpy as np

    if weights.limit(HELD_GRAMS + 1).count() > HELD_GRAMS:
        return None
    found, unseen = weights.collect(), head.select("unseen").first()[0]
    if not found or not unseen or None in unseen:  # nothing to learn from
        return None
    keys = np.array([_keys(_chars(r["gram"]), len(r["gram"]))[0] for r in found], np.int64)
    rising = np.argsort(keys)
    return keys[rising], np.array([found[i]["w"] for i in rising] + [unseen], np.float64)


def _keys(chars, n: int):
    """The n-grams of an array of characters, up to three of 21 bits each, as numbers."""
    import numpy as np

    keys = np.zeros(max(0, len(chars) - n + 1), np.int64)
    for i in range(n):
        keys = (keys << 21) | chars[i:len(keys) + i]
    return keys


def _chars(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def word_scores(words: list[str], keys, table):
    """The words' sums of weights and their numbers of n-grams, from a table by rising key."""
    import numpy as np

    sizes = np.array([len(w) for w in words]) + 2 * len(EDGE)
    starts = np.cumsum(sizes) - sizes
    chars = _chars("".join(f"{EDGE}{w}{EDGE}" for w in words))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(chars))  # characters up to the word's end
    sums = np.zeros((len(chars), table.shape[1]))
    for n in SIZES:
        inside = np.nonzero(left >= n)[0]
        wanted = _keys(chars, n)[inside]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        sums[inside] += table[np.where(keys[at] == wanted, at, len(keys))]
    return np.add.reduceat(sums, starts, axis=0), sum(sizes - n + 1 for n in SIZES)


def _scored_by_tasks(counts: DataFrame, keys, table, n: int, id_col: str) -> DataFrame:
    """``(id, tf, s, grams)`` of every row of ``word_lists``, summed over its words (``tf`` is 1)."""
    from ..session import ship_package

    ship_package(counts.sparkSession)
    shared = counts.sparkSession.sparkContext.broadcast((keys, table))
    schema = T.StructType([counts.schema[id_col], T.StructField("tf", T.LongType()),
                           T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("grams", T.LongType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for big in batches:
            for part in CO.slices(big, "words", WORDS):
                coded = part.column("words").flatten().dictionary_encode()
                lens = part.column("words").value_lengths().to_numpy(zero_copy_only=False)
                if not len(coded):
                    continue
                known = coded.dictionary
                sums, sizes = (np.concatenate(x) for x in zip(*(
                    word_scores(known.slice(lo, SCORED).to_pylist(), *shared.value) for lo in range(0, len(known), SCORED))))
                codes, starts = coded.indices.to_numpy(zero_copy_only=False), np.cumsum(lens) - lens
                tfs = part.column("tfs").flatten().to_numpy(zero_copy_only=False)
                s = np.add.reduceat(sums[codes] * tfs[:, None], starts, axis=0)  # no row is without words
                ends = pa.array(np.arange(len(lens) + 1) * n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(np.ones(len(lens), np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(s.ravel())),
                     pa.array(np.add.reduceat(sizes[codes] * tfs, starts).astype(np.int64))], schema.names)

    return counts.mapInArrow(run, schema)


def detect(counts: DataFrame, docs: DataFrame, weights: DataFrame, head: DataFrame, langs: list[str],
           id_col: str = "doc_id") -> DataFrame:
    """``(id, lang_detected, n_grams, margin)`` of every row of ``docs``; ``margin`` is the winner's lead
    over the next language, per n-gram. A document without letters is ``unknown`` (null margin)."""
    n = len(langs)
    model = _held(weights, head) if "words" in counts.columns else None
    of_rows = (_scored_by_joins(_singly(counts, id_col), weights, head, n, id_col) if model is None
               else _scored_by_tasks(counts, *model, n, id_col))
    of_doc = of_rows.groupBy(id_col).agg(_added("s", n, F.col("tf")).alias("s"),
                                         F.sum(F.col("tf") * F.col("grams")).alias("n_grams"))
    scored = of_doc.join(F.broadcast(head.select("prior"))).select(
        id_col, "n_grams", F.zip_with("s", "prior", lambda x, p: x + p).alias("s"))
    ranked = scored.withColumn("best", F.array_max("s")).withColumn("sorted", F.sort_array("s", asc=False))
    lead = (F.col("best") - F.get("sorted", F.lit(1))) / F.col("n_grams") if n > 1 else F.lit(None).cast("double")
    named = ranked.select(id_col, F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("s", F.col("best")) - 1).cast("int"))
                          .alias("lang_detected"), "n_grams", lead.alias("margin"))
    return docs.select(id_col).join(named, id_col, "left").select(
        id_col, F.coalesce("lang_detected", F.lit(UNKNOWN)).alias("lang_detected"),
        F.coalesce("n_grams", F.lit(0).cast("long")).alias("n_grams"), "margin")
