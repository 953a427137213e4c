"""Token lists as numbers within batches of rows, for joins with a table by token.

A batch of rows (up to ``TOKENS`` tokens, or one longer row) keeps its distinct tokens once and its rows'
tokens as places among them. Only a batch's distinct tokens meet the table, so a token that
every row has is sent once a batch and no task gets all of its occurrences; what they find
meets the batch again (a cogroup), and a numpy lookup gives it to the rows. The batches are
staged: numbers given by a task stay as written. A batch is a long row, so memory counts in batches:
files hold few of them, as readers take up to 4,096 rows of a file at once, and tasks look one up at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = 1 << 16
IN_FILE = 32  # batches of a file


def batched(df: DataFrame, tokens: str, times: str | None = None, size: int = TOKENS) -> DataFrame:
    """``(batch, words, kept, lens, codes, times)``, a row a batch, staged: the other columns of ``df``
    are in ``kept``, a row's tokens are the next ``lens`` of ``codes``, places in ``words``. ``times`` may name
    a list of longs beside the tokens."""
    from ..session import scratch_path, ship_package

    ship_package(df.sparkSession)
    others = [f for f in df.schema.fields if f.name not in (tokens, times)]
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())),
                           T.StructField("kept", T.ArrayType(T.StructType(others))), T.StructField("lens", ints),
                           T.StructField("codes", ints), T.StructField("times", longs)])
    names = [f.name for f in others]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        nth = TaskContext.get().partitionId() << 32
        for big in batches:
            for part in slices(big, tokens, size):
                lists = part.column(tokens)
                coded = lists.flatten().dictionary_encode()
                kept = pa.StructArray.from_arrays([part.column(n) for n in names], names)
                weights = part.column(times).flatten() if times else pa.nulls(0, pa.int64())
                whole = [pa.array([nth], pa.int64())]
                for values in (coded.dictionary, kept, lists.value_lengths().fill_null(0), coded.indices, weights):
                    whole.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                yield pa.RecordBatch.from_arrays(whole, schema.names)
                nth += 1

    path = scratch_path(df.sparkSession, "batches")
    df.mapInArrow(run, schema).write.option("maxRecordsPerFile", IN_FILE).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def slices(batch, tokens: str, size: int):
    """Parts of an Arrow batch of ``size`` tokens or rows at most, of one row at least."""
    import numpy as np

    done = np.cumsum(np.maximum(batch.column(tokens).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 1))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(batches: DataFrame) -> DataFrame:
    """``(batch, code, token)``: the distinct tokens of each batch."""
    return batches.select("batch", F.posexplode("words").alias("code", "token"))


def _looked_up(batches: DataFrame, found: DataFrame, value: str, run, schema: T.StructType) -> DataFrame:
    """``run`` on each batch as an Arrow row, with the codes and values ``found (batch, code, value)`` has for it;
    one batch at a time, whose values are bounded by its words."""
    def one(batch, values):
        import pyarrow as pa

        values = values.combine_chunks()
        rows = [run(row, *(values.column(c).combine_chunks() for c in ("code", "v"))) for row in batch.to_batches() if row.num_rows]
        return pa.Table.from_batches(rows, rows[0].schema if rows else pa.schema([]))

    rows = batches.select("batch", F.size("words").alias("n_words"), "kept", "lens", "codes", "times")
    values = found.select(F.col("batch").alias("of"), "code", F.col(value).alias("v"))
    return rows.groupBy("batch").cogroup(values.groupBy("of")).applyInArrow(one, schema)


def _kept(row) -> list:
    return row.column("kept").flatten().flatten()


def _schema(batches: DataFrame, out: str, kind: T.DataType) -> T.StructType:
    kept = batches.schema["kept"].dataType.elementType.fields
    return T.StructType([*kept, T.StructField(out, T.ArrayType(kind))])


def token_values(batches: DataFrame, found: DataFrame, value: str, out: str, missing: int) -> DataFrame:
    """The kept columns and ``out array<int>``: for each token of a row the ``value`` that ``found (batch,
    code, value)`` has for it, or ``missing``."""
    schema = _schema(batches, out, T.IntegerType())

    def run(row, code, v):
        import numpy as np
        import pyarrow as pa

        table = np.full(row.column("n_words")[0].as_py(), missing, np.int32)
        table[code.to_numpy(zero_copy_only=False)] = v.to_numpy(zero_copy_only=False)
        lens = row.column("lens").flatten().to_numpy(zero_copy_only=False)
        values = table[row.column("codes").flatten().to_numpy(zero_copy_only=False)]
        ends = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32())
        return pa.RecordBatch.from_arrays([*_kept(row), pa.ListArray.from_arrays(ends, pa.array(values))], schema.names)

    return _looked_up(batches, found.withColumn(value, F.col(value).cast("int")), value, run, schema)


def weighted_sums(batches: DataFrame, found: DataFrame, value: str, width: int, out: str = "s") -> DataFrame:
    """The kept columns and ``out array<double>`` of ``width`` elements: the sums over a row's tokens of the
    arrays that ``found (batch, code, value)`` has for them (none: nothing), as often as ``times`` says."""
    schema = _schema(batches, out, T.DoubleType())

    def run(row, code, v):
        import numpy as np
        import pyarrow as pa

        table = np.zeros((row.column("n_words")[0].as_py(), width))
        if len(code):
            table[code.to_numpy(zero_copy_only=False)] = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        lens = row.column("lens").flatten().to_numpy(zero_copy_only=False)
        codes = row.column("codes").flatten().to_numpy(zero_copy_only=False)
        times = row.column("times").flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lens) - lens
        full = np.nonzero(lens)[0]
        sums = np.zeros((len(lens), width))
        if len(full):
            for at in range(0, width, 8):  # some columns at a time: memory
                cells = table[:, at:at + 8][codes]
                if len(times):
                    cells *= times[:, None]
                sums[full, at:at + 8] = np.add.reduceat(cells, starts[full], axis=0)
        ends = pa.array(np.arange(len(lens) + 1) * width, pa.int32())
        return pa.RecordBatch.from_arrays([*_kept(row), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], schema.names)

    return _looked_up(batches, found, value, run, schema)
