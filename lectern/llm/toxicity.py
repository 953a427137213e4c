"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of a word embedding and embeddings of its character n-grams (hashed).
A forward and a backward GRU read a window of WINDOW words; attention over their states pools
the window to one logit. A document's score is that of its highest window; windows overlap and
cover the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, prepare, sized, staged, tidied
from .hashing import SEGMENT, _segment_words, mix

WINDOW, STRIDE = 64, 48      # words of a window; the next one begins STRIDE words later
PER_LABEL = 2000             # labelled rows of each class that the model is fitted on, at most
TEXT_BYTES = 1 << 20         # a longer labelled text is not learned from
FIT_BYTES = 1 << 28          # of the texts of one class that the model is fitted on, at most
THRESHOLD = 0.3
DIM, HIDDEN = 16, 12
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 15
TRAIN_WINDOWS = 70_000       # windows seen in training, over all rounds
DROPOUT = 0.4                # of a word's features, in training
LONGEST = 40                 # bytes of a word; longer runs are cut into pieces, each a word of its own
PART = 1 << 20               # bytes scored at once
HOLD = 30.0                  # update-gate input that keeps the state as it is (padding)


def byte_tables():
    """A-Z lower-cased; every ASCII byte but letters and digits separates words."""
    import numpy as np

    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    gap = np.zeros(256, dtype=bool)
    gap[:128] = [not chr(b).isalnum() for b in range(128)]
    return low, gap


def read_words(texts: list[bytes]):
    """Words of the texts: place of each word among the distinct ones, bounds per text, and per
    distinct word its features (rows of the embedding table) with their bounds. A run of over
    LONGEST bytes is as many words as it takes."""
    import numpy as np

    low, gap = byte_tables()
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    s, e, h = [], [], []
    at = 0
    while at < len(buf):  # hashed in bounded segments, cut between words
        end = min(len(buf), at + SEGMENT)
        while end < len(buf) and not gap[buf[end]]:
            end += 1
        a, b, c = _pieces(buf[at:end], low, *_segment_words(buf[at:end], low, gap))
        s.append(a + at), e.append(b + at), h.append(c)
        at = end
    s, e, h = np.concatenate(s), np.concatenate(e), np.concatenate(h)
    bounds = np.concatenate(([0], np.searchsorted(s, np.cumsum([len(t) + 1 for t in texts]))))
    u, first, place = np.unique(h, return_index=True, return_inverse=True)
    return place, bounds, *features(low[buf], s[first], e[first], u)


def _pieces(buf, low, s, e, h):
    """Words of a byte array with those of over LONGEST bytes cut into consecutive pieces. A cut is
    never within a character of valid UTF-8."""
    import numpy as np

    long = np.nonzero(e - s > LONGEST)[0]
    if not len(long):
        return s, e, h
    inside = (buf & 0xC0) == 0x80  # bytes that go on with a character
    begins, ends = [], []
    for a, b in zip(s[long].tolist(), e[long].tolist()):
        while a < b:
            cut = min(b, a + LONGEST)
            while cut < b and cut > a + LONGEST - 4 and inside[cut]:
                cut -= 1
            begins.append(a), ends.append(cut)
            a = cut
    begins, ends = np.array(begins), np.array(ends)
    n = ends - begins
    marked = np.cumsum(n + 1) - (n + 1)  # the pieces, a separator after each, hashed like words
    text = np.full(int((n + 1).sum()), 32, np.uint8)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(marked, n) + inner] = buf[np.repeat(begins, n) + inner]
    hashes, at = [], 0
    while at < len(marked):
        to = max(at + 1, int(np.searchsorted(marked, marked[at] + SEGMENT - LONGEST)))
        hashes.append(_segment_words(text[marked[at]:marked[to] if to < len(marked) else len(text)], low, text_gap())[2])
        at = to
    keep = np.ones(len(s), bool)
    keep[long] = False
    s, e, h = (np.concatenate([x[keep], y]) for x, y in ((s, begins), (e, ends), (h, np.concatenate(hashes))))
    order = np.argsort(s, kind="stable")
    return s[order], e[order], h[order]


def text_gap():
    """The one separator of the pieces: no byte of a word is a space."""
    import numpy as np

    return np.arange(256) == 32


def features(buf, s, e, h):
    """Embedding rows of each word, as one array with bounds: the word itself, all its runs of
    four bytes (with a mark at either end), and its first 2, 4 and 5 bytes."""
    import numpy as np

    n = e - s
    marked = np.cumsum(n + 2) - (n + 2)
    text = np.full(int((n + 2).sum()) + 4, 60, dtype=np.uint64)  # '<' before each word
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    text[np.repeat(marked + 1, n) + inner] = buf[np.repeat(s, n) + inner]
    text[marked + 1 + n] = 62  # '>' after it

    def gram(at, size, kind):
        v = np.zeros(len(at), dtype=np.uint64)
        for i in range(size):
            v = v * np.uint64(257) + text[at + i]
        return (mix(v * np.uint64(8) + np.uint64(kind)) % np.uint64(CHAR_ROWS)).astype(np.int64) + WORD_ROWS

    runs = np.maximum(n - 1, 1)
    inner = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    rows = [(h % np.uint64(WORD_ROWS)).astype(np.int64), gram(np.repeat(marked, runs) + inner, 4, 0)]
    heads = [np.where(n >= k, gram(marked, k + 1, k), -1) for k in (2, 4, 5)]
    word = np.arange(len(h))
    owner = np.concatenate([word, np.repeat(word, runs), *[word[x >= 0] for x in heads]])
    row = np.concatenate([*rows, *[x[x >= 0] for x in heads]])
    order = np.argsort(owner, kind="stable")
    return row[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(h)))))


def windows(place, bounds, stride: int):
    """Words of every window (rows; -1 where a text ends before its window) and each window's
    text. Every word is in a window; texts without words have none."""
    import numpy as np

    length = np.diff(bounds)
    count = np.where(length > 0, 1 + np.maximum(0, -(-(length - WINDOW) // stride)), 0)
    doc = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    at = bounds[doc][:, None] + (nth * stride)[:, None] + np.arange(WINDOW)[None]
    inside = at < bounds[doc + 1][:, None]
    return np.where(inside, place[np.minimum(at, max(len(place) - 1, 0))] if len(place) else -1, -1), doc


def sigmoid(x):
    import numpy as np

    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def fresh(seed: int = 5) -> dict:
    """Parameters before training."""
    import numpy as np

    rng = np.random.default_rng(seed)
    f = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype(np.float32)
    p = {"emb": f(WORD_ROWS + CHAR_ROWS, DIM, by=0.1), "att": f(2 * HIDDEN, by=0.3),
         "out": f(2 * HIDDEN, by=0.3), "bias": np.float32([-2.0])}
    for d in "fb":  # forward, backward; gates in the order update, reset, new
        p |= {f"W{d}": f(DIM, 3 * HIDDEN, by=DIM ** -0.5), f"U{d}": f(HIDDEN, 3 * HIDDEN, by=HIDDEN ** -0.5),
              f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def word_inputs(p, rows, cuts, kept=None):
    """Input vector of each distinct word; ``kept`` weighs the features (dropout in training)."""
    import numpy as np

    if not len(cuts) - 1:
        return np.zeros((0, DIM), np.float32), np.ones((0, 1), np.float32)
    scale = (1 / np.sqrt(np.diff(cuts)))[:, None].astype(np.float32)
    vectors = p["emb"][rows] if kept is None else p["emb"][rows] * kept[:, None]
    return np.add.reduceat(vectors, cuts[:-1], axis=0) * scale, scale


def gate_inputs(p, x, d):
    """What a word adds to the gates; the last row is padding, which keeps the state."""
    import numpy as np

    pad = np.zeros((1, 3 * HIDDEN), np.float32)
    pad[0, :HIDDEN] = HOLD
    return np.concatenate([x @ p[f"W{d}"] + p[f"c{d}"], pad])


def gru(p, gates, ids, d, keep: list | None = None):
    """States of one direction, (words, windows, HIDDEN); ``keep`` collects what training needs."""
    import numpy as np

    n, t = ids.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((t, n, HIDDEN), np.float32)
    u = p[f"U{d}"]
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        g, v = gates[ids[:, i]], h @ u
        zr = sigmoid(g[:, :2 * HIDDEN] + v[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(g[:, 2 * HIDDEN:] + r * v[:, 2 * HIDDEN:])
        if keep is not None:
            keep.append((i, h, z, r, new, v[:, 2 * HIDDEN:]))
        h = new + z * (h - new)
        out[i] = h
    return out


def attend(p, states, ids):
    """Attention weights (words, windows), pooled states and logits of the windows."""
    import numpy as np

    a = np.where(ids.T >= 0, states @ p["att"], np.float32(-1e9))
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return a, pooled, pooled @ p["out"] + p["bias"][0]


def window_logits(p, ids, x):
    import numpy as np

    states = np.concatenate([gru(p, gate_inputs(p, x, d), ids, d) for d in "fb"], axis=2)
    return attend(p, states, ids)[2]


def score_texts(p, texts: list[bytes]) -> list[float]:
    """Scores of whole texts; a text without words has the score of the bias alone."""
    import numpy as np

    place, bounds, rows, cuts = read_words(texts)
    ids, doc = windows(place, bounds, STRIDE)
    x, _ = word_inputs(p, rows, cuts)
    best = np.full(len(texts), -np.inf)
    for at in range(0, len(ids), 4096):
        np.maximum.at(best, doc[at:at + 4096], window_logits(p, ids[at:at + 4096], x))
    best[np.diff(bounds) == 0] = min(float(p["bias"][0]), -2.0)
    return sigmoid(best).tolist()


def gradients(p, ids, doc, label, rows, cuts, on):
    """Loss and gradients of a batch: documents' logits are the soft maximum of their windows'."""
    import numpy as np

    x, scale = word_inputs(p, rows, cuts, on)
    kept: dict = {"f": [], "b": []}
    gates = {d: gate_inputs(p, x, d) for d in "fb"}
    states = np.concatenate([gru(p, gates[d], ids, d, kept[d]) for d in "fb"], axis=2)
    a, pooled, logit = attend(p, states, ids)

    top = np.full(len(label), -np.inf)
    np.maximum.at(top, doc, logit)
    w = np.exp(logit - top[doc])
    whole = np.bincount(doc, w, len(label))
    d_logit = (sigmoid(top + np.log(whole)) - label)[doc] * w / whole[doc] / len(label)
    d_logit = d_logit.astype(np.float32)

    g = {"bias": np.float32([d_logit.sum()]), "out": pooled.T @ d_logit}
    d_pool = d_logit[:, None] * p["out"]
    d_a = np.einsum("nh,tnh->tn", d_pool, states)
    d_score = a * (d_a - (a * d_a).sum(axis=0))
    g["att"] = np.einsum("tn,tnh->h", d_score, states)
    d_states = a[:, :, None] * d_pool[None] + d_score[:, :, None] * p["att"]
    d_x = np.zeros_like(x)
    for k, d in enumerate("fb"):
        h3, u = HIDDEN, p[f"U{d}"]
        d_gates, d_u = np.zeros_like(gates[d]), np.zeros_like(u)
        d_h = np.zeros((len(ids), h3), np.float32)
        steps = np.zeros((ids.shape[1], len(ids), 3 * h3), np.float32)
        for i, h, z, r, new, vn in reversed(kept[d]):
            d_h = d_h + d_states[i, :, k * h3:(k + 1) * h3]
            d_new = d_h * (1 - z) * (1 - new * new)
            d_z = d_h * (h - new) * z * (1 - z)
            d_r = d_new * vn * r * (1 - r)
            d_v = np.concatenate([d_z, d_r, d_new * r], axis=1)
            steps[i] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_u += h.T @ d_v
            d_h = d_h * z + d_v @ u.T
        flat, order = ids.T.reshape(-1), np.argsort(ids.T.reshape(-1), kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        sums = np.add.reduceat(steps.reshape(-1, 3 * h3)[order], first, axis=0)
        d_gates[found] = sums
        d_gates = d_gates[:-1]  # padding learns nothing
        g |= {f"U{d}": d_u, f"W{d}": x.T @ d_gates, f"c{d}": d_gates.sum(axis=0)}
        d_x += d_gates @ p[f"W{d}"].T
    d_rows = np.repeat(d_x * scale, np.diff(cuts), axis=0) * on[:, None]
    order = np.argsort(rows, kind="stable")
    used, first = np.unique(rows[order], return_index=True)
    g["emb"] = used, np.add.reduceat(d_rows[order], first, axis=0)
    return g


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> dict:
    """Fits the network on labelled texts (a bounded number); the seed is fixed. Rounds go over
    all of them until TRAIN_WINDOWS windows have been seen (4 to 40 rounds)."""
    import numpy as np

    rng, p = np.random.default_rng(seed), fresh(seed)
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = [max(1, t.count(b" ") // WINDOW, len(t) // (LONGEST * WINDOW)) for t in data]
    rounds = int(np.clip(TRAIN_WINDOWS / max(1, sum(sizes)), 4, 40))
    m = {k: np.zeros_like(v) for k, v in p.items() if k != "emb"}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for n in range(rounds):
        order, batch, size = rng.permutation(len(data)).tolist(), [], 0
        for at, i in enumerate(order):
            batch.append(i)
            size += sizes[i]
            if size < 256 and len(batch) < 48 and at + 1 < len(order):
                continue
            place, bounds, rows, cuts = read_words([data[j] for j in batch])
            ids, doc = windows(place, bounds, WINDOW)
            y = np.array([labels[j] for j in batch], dtype=np.float64)
            batch, size = [], 0
            if not len(ids):
                continue
            step += 1
            rate = 0.01 * (1 - n / rounds) + 0.001
            on = ((rng.random(len(rows)) >= DROPOUT) / (1 - DROPOUT)).astype(np.float32)
            for k, v in gradients(p, ids, doc, y, rows, cuts, on).items():
                if k == "emb":  # rows that occur: scaled by the root of their squares so far
                    s[k][v[0]] += v[1] * v[1]
                    p[k][v[0]] -= 5 * rate * v[1] / (np.sqrt(s[k][v[0]]) + 1e-6)
                    continue
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.99 * s[k] + 0.01 * v * v
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)
                        ).astype(np.float32)
    return p


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> dict | None:
    """A model of at most ``per_label`` labelled, not held-out rows of each class (those whose
    id hashes lowest), as far as their texts take TEXT_BYTES each and FIT_BYTES a class; None
    where a class has no rows.

    Defined cases: rows without an id or a label of 0 or 1 are not learned from; a null text is
    empty; an id with several texts or labels counts as often as it occurs, within ``per_label``;
    empty tables give None; other columns are not read.
    """
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    some = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for c in (0, 1)]
    chosen = staged(some[0].unionByName(some[1]), "labelled")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    size = F.octet_length("text").cast("long")
    rows = (docs.where(F.octet_length(text) <= TEXT_BYTES)
            .select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
            .join(sized(chosen), "doc_id").select("doc_id", "text", "label").orderBy(*order).limit(2 * per_label)
            # at most 2 * per_label rows, so two tasks of this window are small
            .withColumn("upto", F.sum(size).over(Window.partitionBy("label").orderBy(*order, "text").rowsBetween(
                Window.unboundedPreceding, 0)))
            .where(F.col("upto") <= FIT_BYTES).orderBy(*order).collect())
    if len({r["label"] for r in rows}) < 2:
        return None
    texts, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    del rows
    model = train(texts, marks)
    del texts
    freed()  # what the fit needed must not stay with the driver for the stages that follow
    return model


def score_documents(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns, with ``toxicity_score`` and ``toxicity_flag`` (1 from ``threshold``).

    A map over the scan, with no shuffle: a task scores whole texts, about 1 MB at a time; the
    model (4 MB, whatever the corpus) is broadcast. Only the text is an input of the score.

    Defined cases: null and empty texts, and texts without words, score as the bias alone
    (under the threshold); without a model every score is 0; a very long text has as many
    windows as it needs; rows are scored one by one, so repeated rows score alike; an empty
    table gives no rows; columns of these two names are replaced.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("toxicity_score", "toxicity_flag")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType()),
                           T.StructField("toxicity_flag", T.IntegerType())])

    def run(batches):
        p = shared.value
        for big in batches:
            at = 0
            while at < big.num_rows:
                texts, size = [], 0
                while at + len(texts) < big.num_rows and (size < PART or not texts):
                    t = (big.column(text_col)[at + len(texts)].as_py() or "").encode("utf-8", "surrogatepass")
                    texts.append(t)
                    size += len(t)
                part = big.slice(at, len(texts))
                at += len(texts)
                scores = score_texts(p, texts) if p else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64()),
                     pa.array([int(v >= threshold) for v in scores], pa.int32())],
                    [*part.schema.names, "toxicity_score", "toxicity_flag"])

    return docs.mapInArrow(tidied(run), schema)


def drop_toxic(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents flagged as toxic."""
    return score_documents(docs, model, id_col, text_col).where("toxicity_flag = 0").select(*docs.columns)
