"""Document fingerprints by Order MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

K = 3            # symbols of a k-mer
LENGTH = 2       # k-mers of a component
BIN_BITS = 6     # 64 components
PIECE = 1 << 20  # characters of a piece of a very long text, whose symbols are taken at once
# A symbol is a run of letters, marks and digits; in scripts that put no blanks between words
# (code points of Thai, Lao, Burmese, Khmer, kana and Han) each of them.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF" \
           r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
WORD = r"\p{L}\p{M}\p{N}"
SYMBOL = rf"(?:[{WORD}&&[^{UNSPACED}]]++|[{UNSPACED}])"
# A numbered k-mer is one long: its hash in the high bits, its place in the text in the low ones.
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed_kmers(text: Column, k: int = K) -> Column:
    """``array<long>``: the hash and place of every ``k`` symbols in a row. A text of fewer
    symbols is one k-mer, the empty text none. A very long text's symbols are taken piece by
    piece, cut between words, so that their texts never fill one array."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}(?![{WORD}])|.{{1,{PIECE}}}"), F.lit(0))
    symbols = F.flatten(F.transform(pieces, lambda piece: F.transform(
        F.regexp_extract_all(piece, F.lit(SYMBOL), F.lit(0)), lambda s: F.xxhash64(s))))

    def kmers(hashes):
        return F.transform(F.slice(hashes, 1, F.size(hashes) - (k - 1)), lambda h, i: _numbered(
            F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, k)]), i))

    return _let(symbols, lambda hashes: F.when(F.size(hashes) >= k, kmers(hashes))
                .when(text == "", F.array().cast("array<long>"))
                .otherwise(F.array(_numbered(F.xxhash64(text), F.lit(0)))))


def _numbered(hash_: Column, place: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~PLACES)).bitwiseOR(place.cast("long"))


def _kmer(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def number_occurrences(ordered: Column) -> Column:
    """Sorted placed k-mers with the hash of every further occurrence of a k-mer replaced by one
    of the k-mer and the occurrence's number. Equal k-mers lie together, so the number is the
    distance to the first, which is found by halving."""
    powers = F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))])

    def numbered(xs, steps):
        def one(x, i):
            def same(distance):
                return (i >= distance) & (_kmer(F.get(xs, i - distance)) == _kmer(x))

            def back():
                return F.aggregate(steps, F.lit(0), lambda d, s: F.when(same(d + s), d + s).otherwise(d))

            return F.when(same(F.lit(1)), _numbered(F.xxhash64(_kmer(x), back()), x.bitwiseAND(F.lit(PLACES)))).otherwise(x)

        return F.transform(xs, one)

    # ``ordered`` is named twice, so that Catalyst leaves its sort in a projection with generated code
    return _let(F.filter(powers, lambda p: p < F.size(ordered)), lambda steps: _let(ordered, lambda xs: numbered(xs, steps)))


def components(numbered: Column, length: int = LENGTH, bin_bits: int = BIN_BITS) -> Column:
    """``array<long>``: the signature's components, ascending, a bin's number over 32 bits of hash.

    ``numbered`` is sorted, so its order is that of the hashes, and the top bits deal the
    numbered k-mers to bins (one permutation for all components in place of one each). Of each
    bin the ``length`` least are taken, put back into the order of the text, and hashed.
    """
    def bin_of(x):
        return F.shiftright(x, 64 - bin_bits)

    def hashed(xs):
        def one(x, i):
            members = F.filter(F.slice(xs, i + 1, length), lambda y: bin_of(y) == bin_of(x))
            in_text = F.transform(F.array_sort(F.transform(members, lambda y: F.struct(
                y.bitwiseAND(F.lit(PLACES)).alias("at"), _kmer(y).alias("kmer")))), lambda s: s["kmer"])
            number = (bin_of(x) + F.lit(1 << (bin_bits - 1))) * F.lit(1 << 32)
            return F.when((i == 0) | (bin_of(F.get(xs, i - 1)) != bin_of(x)),
                          number + F.xxhash64(in_text).bitwiseAND(F.lit((1 << 32) - 1)))

        return F.filter(F.transform(xs, one), lambda y: y.isNotNull())

    def least(xs):
        return F.filter(xs, lambda x, i: (i < length) | (bin_of(F.get(xs, i - length)) != bin_of(x)))

    return _let(_let(numbered, least), hashed)


def with_signature(df: DataFrame, text: str, name: str, k: int = K, length: int = LENGTH,
                   bin_bits: int = BIN_BITS) -> DataFrame:
    """``df`` with the Order MinHash signature of a non-null text column, as ``array<long>``.

    Each k-mer of the text is numbered by its occurrence and hashed with that number; of each
    of 2 ** ``bin_bits`` bins of hashes, the least ``length`` are hashed together in the order in
    which they stand in the text. Texts that share few edits share k-mers, and also their order.
    Work and memory are in proportion to the text (sorting by a logarithm more); nothing is moved.
    """
    at = f"{name}_kmers"
    ordered = df.withColumn(at, F.sort_array(placed_kmers(F.col(text), k)))
    ordered = ordered.withColumn(at, F.sort_array(number_occurrences(F.col(at))))
    return ordered.withColumn(name, components(F.col(at), length, bin_bits)).drop(at)


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either signature that hold equal components; 1 where both
    have none (two empty texts)."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled).cast("double")


def as_text(signature: Column) -> Column:
    """A signature as hexadecimal text, ten digits a component."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


# Text of a block of neighbouring documents, and blocks dealt to a task.
BLOCK_BYTES, BLOCKS_PER_TASK = 8 << 20, 4


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``next_<column>`` of the next row in descending order of
    ``doc_id`` (nulls last; equal ids by hash and text); the last row's next is the first row.

    The rows are cut into blocks of neighbours: thin keys are range-partitioned once to find
    the blocks' bounds (one row per block, an array for a binary search), and texts then move
    once, to their block, where a window reads the neighbour. The last row of each block is also
    sent to the block after it. Bounds grow with the text's bytes over BLOCK_BYTES: 16 bytes each.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("key", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (BLOCK_BYTES * BLOCKS_PER_TASK)))
    bounds = staged(keyed.select("key.*").repartitionByRange(tasks * BLOCKS_PER_TASK, "doc_id", "hash")
                    .groupBy(F.spark_partition_id().alias("pid"))
                    .agg(F.min(F.struct("doc_id", "hash")).alias("low"), F.max(F.struct("doc_id", "hash")).alias("high")),
                    "bounds")
    n = bounds.count()
    if n == 0:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    lows = bounds.agg(F.sort_array(F.collect_list("low"))).scalar()
    highs = bounds.agg(F.sort_array(F.collect_list("high"))).scalar()
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    # the number of bounds that are not above the key, by halving
    block = F.aggregate(halves, F.lit(0), lambda at, s: F.when(
        (at + s <= n) & (F.get("lows", at + s - 1) <= F.col("key")), at + s).otherwise(at))
    placed = keyed.withColumn("lows", lows).withColumn("highs", highs).withColumn("block", block)
    after = F.when(F.get("highs", F.col("block") - 1) == F.col("key"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    sent = (placed.withColumn("edge", F.explode(after))
            .drop("lows", "highs")
            .withColumn("block", F.when(F.col("edge"), F.col("block") % n + 1).otherwise(F.col("block")))
            .repartition(tasks, "block"))
    w = Window.partitionBy("block").orderBy(F.col("edge").desc(), "key", "text")
    return (sent.select("*", *[F.lag(c).over(w).alias(f"next_{c}") for c in columns])
            .where("not edge").drop("edge", "block", "key"))


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)`` of every row: the fingerprints of its whole text and of its edited text, whose
    last floor(n / 2) characters are the first as many (or all) of the next document in
    descending id order, and the likeness of its fingerprint to the edited text's and to the
    next document's.

    Defined cases: null text counts as empty; empty texts have the empty fingerprint, alike with
    likeness 1; texts of fewer than K characters have one component; null ids are last in the
    order, rows that share an id follow each other by hash and text, and repeated rows each give
    a row; a single row is its own next; an empty table gives no rows; other columns are not
    read. Places take PLACE_BITS: more characters than Spark holds in one row's array.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = with_next(with_signature(texts, "text", "signature"), ["text", "signature"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = (signed.withColumn("n_chars", F.length("text").cast("long"))
              .withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"),
                                             F.left("next_text", half)))
              .select("doc_id", "n_chars", "signature", "next_signature", "edited"))
    both = with_signature(edited, "edited", "edited_signature")
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("signature")).alias("fingerprint"),
                       as_text(F.col("edited_signature")).alias("edited_fingerprint"),
                       likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
                       likeness(F.col("signature"), F.col("next_signature")).alias("near_next"))
