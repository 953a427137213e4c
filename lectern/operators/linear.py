"""Logistic models of many heads fitted together, one scan of the rows a step.

A row carries hashed TF-IDF features and the list of heads it trains, with its label for each
(all categories of a multi-label row, every fold model that does not hold the row out, the
tasks that drew it in a mix). A step is one pass: tasks add up the gradients of all heads in
numpy, partial sums are added in two levels, and the driver, which holds nothing but the
model, moves it. Model sizes follow parameters (features x heads), never the data; they are
checked before they are broadcast.

Two models share this pass:

* ``fit``: separate coefficients a head. The loss of a head is its rows' mean log loss plus
  ``l2 / 2`` times its squared coefficients; steps are accelerated gradient steps of the length
  that the unit-length rows allow, with a restart a head, so a head's result does not depend on
  which others are fitted with it. A last round of Newton steps sets the intercepts.
* ``fit_shared``: a projection of the features to ``rank`` dimensions that all heads share
  (the encoder), and a head over it for each task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as SC
from .ranking import materialize

N_FEATURES = 1 << 13
MODEL_BYTES = 256 << 20  # most that a model may take, on the driver and on a worker
CELLS = 2 << 20          # values of a batch x heads table in a task at once
BLOCK = 1 << 19          # cells of a block of rows with its zeros
FULL = 64                # rows with more than a feature in so many are multiplied in such blocks


@dataclass
class Model:
    """``idf`` of the hashed features; ``coef`` (features or rank x heads), ``bias``; with an
    ``encoder`` (features x rank) in between for shared models. ``weight`` is what a row counts
    for in each head's gradients (none: 1)."""

    idf: np.ndarray
    coef: np.ndarray
    bias: np.ndarray
    encoder: np.ndarray | None = None
    weight: np.ndarray | None = None


# --------------------------------------------------------------------------- features
def hashed(tf: DataFrame, n_features: int = N_FEATURES) -> DataFrame:
    """``(row_id, c array<struct<at, tf>>)`` from ``(row_id, token, tf)``, staged: the hashed tokens of a row,
    repeats included. The one time that the counts are sent by row."""
    return materialize(tf.select("row_id", F.struct(_bucket(n_features).alias("at"), F.col("tf").cast("long").alias("tf")).alias("c"))
                       .groupBy("row_id").agg(F.collect_list("c").alias("c")))


def document_frequencies(tf: DataFrame, train_rows: DataFrame, n_features: int = N_FEATURES) -> np.ndarray:
    """Smoothed inverse document frequencies of the hashed tokens over the training rows: a
    table of ``n_features`` rows at most."""
    return hashed_frequencies(hashed(tf, n_features), train_rows, n_features)


def hashed_frequencies(cells: DataFrame, train_rows: DataFrame, n_features: int) -> np.ndarray:
    """``document_frequencies`` of the table that ``hashed`` gives."""
    train = train_rows.select("row_id").distinct()
    n = train.count()
    seen = (cells.join(train, "row_id", "left_semi").select(F.explode(F.array_distinct("c.at")).alias("at"))
            .groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect())
    df = np.zeros(n_features)
    for r in seen:
        df[r["at"]] = r["n"]
    return np.log((n + 1.0) / (df + 1.0))


def _bucket(n_features: int):
    return F.pmod(F.xxhash64("token"), F.lit(n_features)).cast("int")


def features(tf: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(row_id, at array<int>, value array<double>)`` from ``(row_id, token, tf)``: TF-IDF of the hashed
    tokens, scaled to length 1. The values of rows whose tokens all weigh nothing are 0."""
    return hashed_features(hashed(tf, len(idf)), idf)


def hashed_features(cells: DataFrame, idf: np.ndarray) -> DataFrame:
    """``features`` of the table that ``hashed`` gives."""
    _ship()
    shared = cells.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        import pyarrow as pa

        weights = shared.value
        n = len(weights)
        for batch in batches:
            lists = batch.column("c")
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at, tf = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            cells, which = np.unique(rows * n + at, return_inverse=True)  # a row's places, rising
            rows, at = np.divmod(cells, n)
            value = np.bincount(which, tf, len(cells)) * weights[at]
            length = np.sqrt(np.bincount(rows, value * value, batch.num_rows))
            value = value / np.where(length > 0, length, 1.0)[rows]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=batch.num_rows)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(value))], ["row_id", "at", "value"])

    kind = cells.schema["row_id"].dataType.simpleString()
    return cells.mapInArrow(run, f"row_id {kind}, at array<int>, value array<double>")


def training_rows(feats: DataFrame, tasks: DataFrame) -> DataFrame:
    """``feats`` with ``heads array<int>`` and ``labels array<int>`` from the long table
    ``tasks (row_id, head, label)``, staged; ``at`` and ``value`` as the bytes of their int32 and doubles, which
    every pass reads without a step per element. A repeated (row, head) trains twice. Rows without
    tokens keep their place, with empty features."""
    _ship()
    listed = tasks.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("head").cast("int").alias("h"),
                                                                              F.col("label").cast("int").alias("y")))).alias("t"))
    rows = listed.join(feats, "row_id", "left").select(
        "row_id", F.coalesce("at", F.array().cast("array<int>")).alias("at"),
        F.coalesce("value", F.array().cast("array<double>")).alias("value"),
        F.transform("t", lambda t: t["h"]).alias("heads"), F.transform("t", lambda t: t["y"]).alias("labels"))
    kind = rows.schema["row_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_packed, f"row_id {kind}, at binary, value binary, heads array<int>, labels array<int>"))


def _packed(batches):
    """``at`` and ``value`` of rows -> their bytes."""
    import pyarrow as pa

    for batch in batches:
        packed = []
        for name in ("at", "value"):
            lens, values = _lists(batch.column(name))
            ends = np.concatenate(([0], np.cumsum(lens))) * values.itemsize
            packed.append(pa.Array.from_buffers(pa.binary(), batch.num_rows, [
                None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), *packed, batch.column("heads"), batch.column("labels")],
                                         ["row_id", "at", "value", "heads", "labels"])


# --------------------------------------------------------------------------- one pass
def _lists(column):
    """Lengths and values of an Arrow list column."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _unpacked(column, kind):
    """Lengths and values of an Arrow column that ``_packed`` wrote."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind) if data and ends[-1] > ends[0] else np.zeros(0, kind)
    return np.diff(ends) // values.itemsize, values


def _times(lens, at, value, matrix):
    """Sparse rows times a matrix."""
    out = np.zeros((len(lens), matrix.shape[1]))
    full = np.nonzero(lens)[0]
    if len(full):
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))[full]
        out[full] = np.add.reduceat(matrix[at] * value[:, None], starts, axis=0)
    return out


def _add_transposed(into, lens, at, value, matrix):
    """``into`` plus the transposed sparse rows times a matrix."""
    if not len(at):
        return
    rows = np.repeat(np.arange(len(lens)), lens)
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    into[places] += np.add.reduceat(matrix[rows[order]] * value[order][:, None], starts, axis=0)


def _sigmoid(x):
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def _ranges(lens, width: int, n_features: int):
    """Ranges of rows, and whether they are multiplied with their zeros written out. That is several
    times faster than by their features alone, but for rows of few; it takes BLOCK cells. Otherwise
    features x ``width`` stay within CELLS."""
    if lens.sum() * FULL > n_features * len(lens):
        step = max(1, BLOCK // n_features)
        yield from ((lo, min(lo + step, len(lens)), True) for lo in range(0, len(lens), step))
        return
    done = np.cumsum(np.maximum(lens, 1))
    lo = 0
    while lo < len(lens):
        before = done[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(done, before + CELLS // width, side="right")))
        yield lo, hi, False
        lo = hi


class _Full:
    """A block of sparse rows with its zeros; the cells are used again for the next."""

    def __init__(self):
        self.cells = np.zeros(0)

    def of(self, lens, at, value, n_features: int):
        if len(self.cells) < len(lens) * n_features:
            self.cells = np.zeros(len(lens) * n_features)
        self.used = np.repeat(np.arange(len(lens)) * n_features, lens) + at
        self.cells[self.used] = value
        return self.cells[:len(lens) * n_features].reshape(len(lens), n_features)

    def clear(self):
        self.cells[self.used] = 0


def _gradient_pass(shared):
    """Rows of training tables -> one row a task with its summed gradients (key, data)."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model = shared.value
        first = model.coef if model.encoder is None else model.encoder
        n_heads, n_features, block = len(model.bias), len(first), _Full()
        sums = _empty(model)
        for batch in batches:
            all_lens, all_at = _unpacked(batch.column("at"), np.int32)
            all_value = _unpacked(batch.column("value"), np.float64)[1]
            all_times, all_heads = _lists(batch.column("heads"))
            all_labels = _lists(batch.column("labels"))[1]
            ends, trained = (np.concatenate(([0], np.cumsum(x))) for x in (all_lens, all_times))
            for lo, hi, full in _ranges(all_lens, max(n_heads, first.shape[1]), n_features):
                lens, at, value = all_lens[lo:hi], all_at[ends[lo]:ends[hi]], all_value[ends[lo]:ends[hi]]
                heads, labels = all_heads[trained[lo]:trained[hi]], all_labels[trained[lo]:trained[hi]]
                rows = np.repeat(np.arange(hi - lo), all_times[lo:hi])
                x = block.of(lens, at, value, n_features) if full else None
                hidden = x @ first if full else _times(lens, at, value, first)
                margin = (hidden if model.encoder is None else hidden @ model.coef) + model.bias
                p = _sigmoid(margin)
                rest = np.zeros_like(p)
                np.add.at(rest, (rows, heads), p[rows, heads] - labels)
                if model.weight is not None:
                    rest *= model.weight
                sums["bias"] += rest.sum(axis=0)
                np.add.at(sums["curve"], heads, p[rows, heads] * (1 - p[rows, heads]))
                if model.encoder is not None:
                    sums["coef"] += hidden.T @ rest
                name, back = ("coef", rest) if model.encoder is None else ("encoder", rest @ model.coef.T)
                if full:
                    sums[name] += x.T @ back
                    block.clear()
                else:
                    _add_transposed(sums[name], lens, at, value, back)
        task = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() if task else 0], pa.int32()),
                                          pa.array([_flat(sums).tobytes()], pa.binary())], ["part", "data"])
    return run


def _added_up(batches):
    """Rows (part, data) -> their sum, one row."""
    import pyarrow as pa

    total = None
    for batch in batches:
        for data in batch.column("data"):
            one = np.frombuffer(data.as_py(), np.float64)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "data"])


def _empty(model: Model) -> dict:
    out = {"coef": np.zeros_like(model.coef), "bias": np.zeros_like(model.bias), "curve": np.zeros_like(model.bias)}
    return out if model.encoder is None else out | {"encoder": np.zeros_like(model.encoder)}


def _flat(sums: dict):
    return np.concatenate([sums[k].ravel() for k in sorted(sums)])


def gradients(rows: DataFrame, model: Model) -> dict:
    """Summed gradients of all heads at ``model``: one scan, partial sums added by about the
    square root of the tasks, then on the driver."""
    size = sum(x.nbytes for x in (model.coef, model.bias, model.encoder) if x is not None)
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size >> 20} MB; fewer features or heads")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "part int, data binary"
    partial = rows.select("at", "value", "heads", "labels").mapInArrow(_gradient_pass(shared), schema)
    fan = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    total = None
    for r in partial.repartition(fan, "part").mapInArrow(_added_up, schema).collect():
        one = np.frombuffer(r["data"], np.float64)
        total = one if total is None else total + one
    shared.unpersist()
    out = _empty(model)
    if total is not None:
        at = 0
        for k in sorted(out):
            n = out[k].size
            out[k] = total[at:at + n].reshape(out[k].shape)
            at += n
    return out


def head_sizes(rows: DataFrame, n_heads: int) -> np.ndarray:
    """How many rows train each head (at least 1, so that an empty head stays at 0)."""
    n = np.ones(n_heads)
    for r in rows.select(F.explode("heads").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r["h"]] = r["n"]
    return n


# --------------------------------------------------------------------------- fits
def fit(rows: DataFrame, idf: np.ndarray, n_heads: int, steps: int = 40, l2: float = 1e-3, newton: int = 3) -> Model:
    """All heads together, ``steps + newton`` scans of ``rows``."""
    _ship()
    n = head_sizes(rows, n_heads)
    model = Model(idf, np.zeros((len(idf), n_heads)), np.zeros(n_heads))
    w, b = model.coef.copy(), model.bias.copy()
    age = np.zeros(n_heads)
    rate = 1.0 / (0.5 + l2)   # rows have length 1, and 1 for the intercept: curvature is at most 2 / 4
    for _ in range(steps):
        g = gradients(rows, model)
        dw, db = g["coef"] / n + l2 * model.coef, g["bias"] / n
        w1, b1 = model.coef - rate * dw, model.bias - rate * db
        uphill = (dw * (w1 - w)).sum(axis=0) + db * (b1 - b) > 0
        age = np.where(uphill, 0, age + 1)
        push = age / (age + 3.0)
        model = Model(idf, w1 + push * (w1 - w), b1 + push * (b1 - b))
        w, b = w1, b1
    model = Model(idf, w, b)
    for _ in range(newton):
        g = gradients(rows, model)
        model = Model(idf, w, model.bias - g["bias"] / np.maximum(g["curve"], 1e-9))
    return model


def fit_shared(rows: DataFrame, idf: np.ndarray, n_heads: int, rank: int = 8, rounds: int = 30, rate: float = 0.05,
               l2: float = 1e-4, seed: int = 1, newton: int = 3) -> Model:
    """An encoder shared by all heads. A round is two scans: the heads move with the encoder
    fixed, then the encoder with the heads fixed (adaptive moment steps, fixed start)."""
    _ship()
    n = head_sizes(rows, n_heads)
    rng = np.random.default_rng(seed)
    now = {"encoder": rng.normal(size=(len(idf), rank)), "coef": rng.normal(size=(rank, n_heads)) / rank, "bias": np.zeros(n_heads)}
    first = {k: np.zeros_like(v) for k, v in now.items()}
    second = {k: np.zeros_like(v) for k, v in now.items()}
    weight = 1.0 / (n * n_heads)   # every task counts alike
    for i in range(rounds):
        for moved in (("coef", "bias"), ("encoder",)):
            sums = gradients(rows, Model(idf, now["coef"], now["bias"], now["encoder"], weight))
            for k in moved:
                g = sums[k] + (l2 * now[k] if k != "bias" else 0.0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                now[k] = now[k] - rate * (first[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
    model = Model(idf, now["coef"], now["bias"], now["encoder"])
    for _ in range(newton):
        g = gradients(rows, model)
        model = Model(idf, model.coef, model.bias - g["bias"] / np.maximum(g["curve"], 1e-9), model.encoder)
    return model


def _ship() -> None:
    from ..session import ship_package

    ship_package()


# --------------------------------------------------------------------------- scores
def margins(feats: DataFrame, model: Model) -> DataFrame:
    """``(row_id, margins array<double>)`` of all heads: one scan of the features."""
    _ship()
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        first, block = m.coef if m.encoder is None else m.encoder, _Full()
        for batch in batches:
            all_lens, all_at = _lists(batch.column("at"))
            all_value = batch.column("value").flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(all_lens)))
            for lo, hi, full in _ranges(all_lens, max(len(m.bias), first.shape[1]), len(first)):
                lens, at, value = all_lens[lo:hi], all_at[ends[lo]:ends[hi]], all_value[ends[lo]:ends[hi]]
                if full:
                    out = block.of(lens, at, value, len(first)) @ first
                    block.clear()
                else:
                    out = _times(lens, at, value, first)
                out = (out if m.encoder is None else out @ m.coef) + m.bias
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(lo, hi - lo), listed], ["row_id", "margins"])

    return feats.select("row_id", "at", "value").mapInArrow(run, "row_id long, margins array<double>")


def score(feats: DataFrame, rows: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``rows (row_id, head, …)`` with ``prob`` and ``pred`` by each row's head. Rows without
    features have the head's intercept alone."""
    bias = F.array(*[F.lit(float(b)) for b in model.bias])
    out = rows.join(margins(feats, model), "row_id", "left")
    margin = F.get(F.coalesce("margins", bias), F.col("head"))
    return (out.withColumn("prob", SC.sigmoid(margin)).drop("margins")
            .withColumn("pred", SC.decide(F.col("prob"), threshold)))
