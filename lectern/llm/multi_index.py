"""Near-duplicate vectors through an inverted multi-index.

The two halves of every unit vector have codebooks of their own; pairs of codewords form a
product grid of cells. A vector lives in the cell of its nearest codewords and visits other
cells in the order of a multi-sequence traversal, nearest first, until the depth that reaches
the target recall. Vectors that meet in a cell are compared exactly, in double precision.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, prepare, staged, tidied

THRESHOLD = 0.95
SAMPLE = 20_000        # vectors that the codebooks and the depth are fitted on, at most
TARGET_RECALL = 0.999  # of pairs that lie exactly at the threshold; closer pairs are found more often
PER_CELL = 48          # vectors a cell holds on average, up to the largest grid
MAX_WORDS = 1024       # codewords of a half at most: 1M cells
BLOCK = 2048           # vectors of one side in a comparison task


def units(array):
    """Rows scaled to length 1 in double precision (scaled by the largest part first, so that
    squares neither overflow nor vanish)."""
    import numpy as np

    x = np.asarray(array, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_words(x, k: int, rounds: int = 15):
    """k-means codewords of the rows of ``x`` (a bounded sample); the seed is fixed."""
    import numpy as np

    rng = np.random.default_rng(7)
    words = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((words * words).sum(1)[None] - 2 * x @ words.T).argmin(1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def distances(words):
    """Distances between codewords, from their products: (k, k), however long the words are."""
    import numpy as np

    size = (words * words).sum(1)
    return np.sqrt(np.maximum(size[:, None] + size[None] - 2 * words @ words.T, 1e-18))


def margins(x, words, apart):
    """Nearest codeword of each row, and the squared distance from the row to the boundary
    of every codeword's region as seen from its own (0 for its own); ``apart`` holds the
    codewords' :func:`distances`."""
    import numpy as np

    d = (x * x).sum(1)[:, None] + (words * words).sum(1)[None] - 2 * x @ words.T
    own = d.argmin(1)
    rows = np.arange(len(x))
    gap = np.maximum(d - d[rows, own][:, None], 0) / (2 * apart[own])
    gap[rows, own] = 0
    return own, gap * gap


class MultiIndex:
    """Codebooks of the two halves and the traversal depth; fitted on a bounded sample."""

    def __init__(self, sample, n_rows: int, threshold: float, target: float):
        import numpy as np

        u = units(sample)
        self.half = (u.shape[1] + 1) // 2
        k = 2 ** round(np.log2(max(4.0, (n_rows / PER_CELL) ** 0.5)))
        self.k = int(min(MAX_WORDS, k, max(1, len(u))))
        self.words = (fit_words(u[:, :self.half], self.k), fit_words(u[:, self.half:], self.k))
        self.apart = tuple(map(distances, self.words))  # once an index, not once a batch
        # depth: sample vectors and partners turned away to the threshold in random directions;
        # a pair counts as found when either visits the other's cell
        rng = np.random.default_rng(11)
        q = np.repeat(u, max(1, 4000 // len(u)), axis=0)[:8000]
        turn = rng.normal(size=q.shape)
        turn -= (turn * q).sum(1)[:, None] * q
        turn /= np.maximum(np.sqrt((turn * turn).sum(1)), 1e-300)[:, None]
        p = threshold * q + (1 - threshold ** 2) ** 0.5 * turn
        (qc1, q1), (qc2, q2), (pc1, p1), (pc2, p2) = *self._halves(q), *self._halves(p)
        r = np.arange(len(q))
        need = np.minimum(q1[r, pc1] + q2[r, pc2], p1[r, qc1] + p2[r, qc2])
        self.depth = float(np.quantile(need, target)) + 1e-12

    def _halves(self, u):
        return tuple(margins(part, w, a) for part, w, a in zip((u[:, :self.half], u[:, self.half:]), self.words, self.apart))

    def cells(self, u):
        """Per row of ``u``: its own cell and the cells it visits, own cell first."""
        import numpy as np

        (a, m1), (b, m2) = self._halves(u)
        near1, near2 = np.argsort(m1, axis=1, kind="stable"), np.argsort(m2, axis=1, kind="stable")
        for i in range(len(u)):
            yield int(a[i]) * self.k + int(b[i]), self._traverse(m1[i], near1[i], m2[i], near2[i])

    def _traverse(self, m1, near1, m2, near2) -> list[int]:
        """Multi-sequence: the two sorted lists of codewords are merged so that cells come out
        by rising sum; (i, j) is queued once (i-1, j) and (i, j-1) are out."""
        out, queue, done = [], [(0.0, 0, 0)], set()
        k = self.k
        while queue:
            at, i, j = heapq.heappop(queue)
            if at > self.depth:
                break
            out.append(int(near1[i]) * k + int(near2[j]))
            done.add((i, j))
            if i + 1 < k and (j == 0 or (i + 1, j - 1) in done):
                heapq.heappush(queue, (m1[near1[i + 1]] + m2[near2[j]], i + 1, j))
            if j + 1 < k and (i == 0 or (i - 1, j + 1) in done):
                heapq.heappush(queue, (m1[near1[i]] + m2[near2[j + 1]], i, j + 1))
        return out

    def visits(self, u, cell):
        """Does row i of ``u`` visit ``cell[i]``?"""
        import numpy as np

        (_, m1), (_, m2) = self._halves(u)
        r = np.arange(len(u))
        return m1[r, cell // self.k] + m2[r, cell % self.k] <= self.depth


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL,
                 sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per vector: the number of other vectors
    at cosine >= ``threshold`` that the index finds, and the smallest id reachable by links.

    Equal vectors are one class with a count, so copies are never paired with each other. A
    class lies in its home cell and visits cells down to the index's depth; the visits are the
    only rows that multiply (about 10 a vector), and every vector is indexed. A cell is
    compared in blocks of BLOCK home vectors by BLOCK visitors, as many tasks as it takes, so a
    cell that holds a third of all rows is spread; a block returns each vector's link count and
    its own small forest, never pairs. A pair that both sides find is counted at one of them.

    Defined cases: a vector that is null, empty, zero or holds a null or non-finite part links
    with nothing; shorter vectors count as filled up with zeros; rows that share an id are
    vectors of their own; null ids take part, and a component of null ids alone has a null
    component_id; an empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    part = F.col("v")
    base = staged(vectors.select(F.monotonically_increasing_id().alias("row"),
                                 F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
                  .withColumn("fit", F.coalesce(
                      F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                               & (F.abs(x.cast("double")) < float("inf")))
                      & F.exists(part, lambda x: x != 0), F.lit(False))), "vectors")
    fit = base.where("fit").withColumn("vh", F.xxhash64("v"))
    classes = fit.groupBy("vh", "v").agg(F.min("row").alias("cls"), F.count("*").alias("n"))
    classes = staged(classes.select("cls", "n", "v", "vh"), "classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not stats["n"]:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim = stats["dim"]
    some = classes.orderBy(F.xxhash64("cls")).select("v").limit(sample).collect()  # bounded by ``sample``
    index = MultiIndex([[float(x) for x in r["v"]] + [0.0] * (dim - len(r["v"])) for r in some],
                       stats["n"], threshold, target_recall)

    places = staged(classes.select("cls", "n", "v").mapInArrow(
        tidied(lambda batches: _places(batches, index, dim)), "cell long, home boolean, cls long, n long, v binary"), "places")
    # blocks of a cell: one row per cell (k * k at most)
    blocks = places.groupBy("cell").agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("h_blocks"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks")).where("h_blocks > 0")
    spread = places.join(blocks, "cell")
    salt = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = spread.where("home").select("cell", (salt % F.col("h_blocks")).cast("int").alias("hb"),
                                        every("v_blocks").alias("vb"), F.lit(True).alias("home"), "cls", "n", "v")
    visitors = spread.select("cell", every("h_blocks").alias("hb"), (salt % F.col("v_blocks")).cast("int").alias("vb"),
                             F.lit(False).alias("home"), "cls", "n", "v", F.col("home").alias("own"))
    met = (homes.withColumn("own", F.lit(True)).unionByName(visitors)
           .repartition("cell", "hb", "vb").sortWithinPartitions("cell", "hb", "vb")
           .mapInArrow(tidied(lambda batches: _compare(batches, index, threshold)), "cls long, root long, n_links long"))
    met = staged(met, "links")

    counts = met.groupBy("cls").agg(F.sum("n_links").alias("linked"))
    groups = components(met.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    byclass = (fit.select("row", "vec_id", "vh", "v").join(classes.select("cls", "n", "vh", "v"), ["vh", "v"])
               .join(counts, "cls", "left").join(groups, F.col("cls") == F.col("node"), "left")
               .select("row", "vec_id", F.coalesce("component", "cls").alias("component"),
                       (F.col("n") - 1 + F.coalesce("linked", F.lit(0).cast("long"))).alias("n_links")))
    byclass = staged(byclass, "byclass")
    low = staged(byclass.groupBy("component").agg(F.min("vec_id").alias("component_id")), "low")
    found = byclass.join(low, "component").select("vec_id", "n_links", "component_id")
    rest = base.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return (found.unionByName(rest)
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _matrix(column, dim: int):
    """Rows of an Arrow list column, filled up with zeros to ``dim``."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def _places(batches, index: MultiIndex, dim: int):
    import pyarrow as pa

    names = ["cell", "home", "cls", "n", "v"]
    for big in batches:
        for at in range(0, big.num_rows, 1000):
            batch = big.slice(at, 1000)
            u = units(_matrix(batch.column("v"), dim))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for (home, cells), cls, n, v in zip(index.cells(u), batch.column("cls").to_pylist(),
                                                batch.column("n").to_pylist(), u):
                data = v.tobytes()
                for cell in dict.fromkeys([home, *cells]):
                    for c, value in zip(rows, (cell, cell == home, cls, n, data)):
                        c.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.int64()),
                 pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], names)


def _compare(batches, index: MultiIndex, threshold: float):
    """Streams blocks (rows sorted by cell and block) and compares each one."""
    import numpy as np
    import pyarrow as pa

    def flush(rows):
        homes = [r for r in rows if r[0]]
        if not homes or len(rows) == len(homes):
            return
        guests = [r for r in rows if not r[0]]
        yield from _block(homes, guests, key[0], index, threshold)

    key, rows, out = None, [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("cell", "hb", "vb", "home", "cls", "n", "v", "own")]
        for cell, hb, vb, home, cls, n, v, own in zip(*cols):
            if (cell, hb, vb) != key:
                out.extend(flush(rows))
                key, rows = (cell, hb, vb), []
            rows.append((home, cls, n, np.frombuffer(v), own))
        if len(out) > 10_000:
            yield _links(out, pa)
            out = []
    out.extend(flush(rows))
    if out:
        yield _links(out, pa)


def _links(out, pa):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["cls", "root", "n_links"])


def _block(homes, guests, cell, index: MultiIndex, threshold: float):
    """Link counts and forest of one block. Two home vectors meet in both roles, and then only
    the guest is counted; a guest from elsewhere counts both sides, unless the pair is also
    found in the guest's own cell, and that cell is the smaller one."""
    import numpy as np

    h_cls, h_n = (np.array([r[i] for r in homes], dtype=np.int64) for i in (1, 2))
    g_cls, g_n = (np.array([r[i] for r in guests], dtype=np.int64) for i in (1, 2))
    own = np.array([r[4] for r in guests])
    hv, gv = np.array([r[3] for r in homes]), np.array([r[3] for r in guests])
    h_links, g_links = np.zeros(len(homes), np.int64), np.zeros(len(guests), np.int64)
    h_root, g_root = h_cls.copy(), g_cls.copy()
    g_cell = np.full(len(guests), cell)
    if not own.all():
        (a, _), (b, _) = index._halves(gv)
        g_cell = np.where(own, cell, a * index.k + b)
    for at in range(0, len(guests), 256):
        part = slice(at, at + 256)
        hit = (gv[part] @ hv.T >= threshold) & (g_cls[part, None] != h_cls[None])
        gi, hi = np.nonzero(hit)
        if not len(gi):
            continue
        far = ~own[part][gi] & (g_cell[part][gi] < cell)
        if far.any():  # is the home vector a visitor of the guest's cell as well?
            again = np.zeros(len(gi), dtype=bool)
            again[far] = index.visits(hv[hi[far]], g_cell[part][gi[far]])
            hit[gi[again], hi[again]] = False
            gi, hi = np.nonzero(hit)
        np.add.at(g_links, gi + at, h_n[hi])
        foreign = ~own[part][gi]
        np.add.at(h_links, hi[foreign], g_n[part][gi[foreign]])
        for _ in range(len(homes) + 256):  # smallest class reachable within the block
            before = h_root.copy(), g_root[part].copy()
            np.minimum.at(h_root, hi, g_root[part][gi])
            low = g_root[part].copy()
            np.minimum.at(low, gi, h_root[hi])
            g_root[part] = low
            if (before[0] == h_root).all() and (before[1] == low).all():
                break
    for cls, root, n in (*zip(h_cls.tolist(), h_root.tolist(), h_links.tolist()),
                         *zip(g_cls.tolist(), g_root.tolist(), g_links.tolist())):
        if n or root != cls:
            yield cls, root, n
