"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find.

A SuperMinHash signature gives every element of a set its own random permutation of the slots:
at level j the element offers the value j + r to the j-th slot of its permutation, and a slot
keeps the least value offered. Ranks within one element's permutation are correlated, which
lowers the variance against independent hash functions. Once every slot holds less than j no
later level can change anything, and the levels stop.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, find, free_names, prepare, sized, staged, tidied, union, without_ids
from .hashing import batch_words, mix, sequences

WIDTH = 5                 # words of a shingle
BANDS, ROWS = 32, 4       # a pair at similarity 0.75 shares no band with probability 5e-6
SLOTS = BANDS * ROWS
PERCENT = 75              # 100 * intersection >= PERCENT * union
# A pair at 0.75 has an estimate below this with probability under 1e-6 (over 5 deviations).
LEAST_ESTIMATE = 0.55
BLOCK = 1024              # documents of one side of a bucket in a comparison
REGION_BLOCK = 256        # documents of one side of a region, with their full sets
HUB_MEMBERS = 256         # members verified against one copy of a hub's set
ELEMENTS = 200_000        # shingles whose permutations are held at once


def shingle_sets(texts: list[str | None]) -> list:
    """Each text's distinct shingles as a sorted array of 64-bit hashes; a text of fewer than
    WIDTH words has its whole word sequence, one without words has none."""
    import numpy as np

    h, bounds = batch_words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    wide = sequences(h, WIDTH)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        out.append(np.unique(wide[a:b - WIDTH + 1]) if n >= WIDTH
                   else sequences(h[a:b], n) if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list):
    """SuperMinHash signatures of non-empty sets, one row of SLOTS values each."""
    import numpy as np

    out = np.full((len(sets), SLOTS), np.inf)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= ELEMENTS):
            n += len(sets[j])
            j += 1
        _fill(out[i:j], sets[i:j])
        i = j
    return out


def _draws(e, level: int):
    """The element's offset r in [0, 1) and its uniform choice in [0, 1) at a level."""
    import numpy as np

    step = np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a = mix(e + step)
    b = mix(a ^ np.uint64(0xA0761D6478BD642F))
    return (a >> np.uint64(11)) * 2.0 ** -53, (b >> np.uint64(11)) * 2.0 ** -53


def _fill(h, sets) -> None:
    import numpy as np

    e = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    r, c = _draws(e, 0)
    slot = (c * SLOTS).astype(np.int64)
    flat = h.reshape(-1)
    np.minimum.at(flat, doc * SLOTS + slot, r)
    perm = None
    for level in range(1, SLOTS):
        active = h.max(axis=1) >= level
        if not active.any():
            return
        keep = active[doc]
        e, doc = e[keep], doc[keep]
        rows = np.arange(len(e))
        if perm is None:  # permutations are written down only where one level was not enough
            perm = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(e), 1))
            first = slot[keep]
            perm[rows, first], perm[rows, 0] = 0, first
        else:
            perm = perm[keep]
        r, c = _draws(e, level)
        pick = level + (c * (SLOTS - level)).astype(np.int64)
        slot = perm[rows, pick].astype(np.int64)
        perm[rows, pick], perm[rows, level] = perm[rows, level], slot
        np.minimum.at(flat, doc * SLOTS + slot, r + level)


def band_keys(sig):
    """One 64-bit key per band (the band's number is part of it), as signed longs."""
    import numpy as np

    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x8EBC6AF09C88C6E3) + np.uint64(1)
    for i in range(ROWS):
        key = mix(key ^ bits[:, :, i])
    return key.view(np.int64)


def slot_bytes(sig):
    """A byte of every slot's value, to estimate similarity."""
    import numpy as np

    return (mix(np.ascontiguousarray(sig).view(np.uint64)) & np.uint64(255)).astype(np.uint8)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, slots binary"


def _sign(batches):
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()),
                        ("bands", pa.list_(pa.int64())), ("slots", pa.binary())])
    for keys, texts in _parts(batches):
        sets = shingle_sets(texts)
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = signatures([sets[i] for i in full])
        bands, slots = (band_keys(sig), slot_bytes(sig)) if full else ([], [])
        place = {i: n for n, i in enumerate(full)}
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([set_key(s) for s in sets], pa.binary()),
            pa.array([np.asarray(bands[place[i]]) if i in place else None for i in range(len(sets))],
                     pa.list_(pa.int64())),
            pa.array([slots[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary())],
            schema=schema)


def _parts(batches, size: int = 500):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def set_key(s) -> bytes | None:
    """128-bit digest of a whole shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    1. Every whole text gives its shingle set's size and digest and its signature, in the scan.
    2. Documents with equal sets are one class; only one member goes on.
    3. Classes that share a band key are candidates. Each is verified against the bucket's
       first class on full sets; verified links are joined by union-find.
    4. In buckets that still hold several components, classes of different components whose
       signatures' bytes agree enough are put in one region (a block returns a forest of such
       pairs, never the pairs). A region's classes are compared on full sets, in blocks, and
       each block returns a forest of verified links. So a pair in a common bucket is
       verified, or already in one component, or its estimate rules it out.

    A bucket of any size is split into blocks, a hub's members into portions, and equi-joins
    on hot keys are left to AQE's skew handling.

    Defined cases: null and empty texts, and texts without words, have no shingles and link
    with nothing; a text of fewer than five words has one shingle; null ids take part, and a
    component of null ids alone has a null component_id; rows that share an id are documents
    of their own, linked if their texts are alike; a very long text is hashed in segments; an
    empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(texts.mapInArrow(tidied(_sign), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    thin = signed.select("row", "doc_id", "n_shingles", "set_key")
    classes = staged(thin.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("node")), "classes")
    reps = staged(signed.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
                  .withColumnRenamed("row", "node"), "reps")

    seen = reps.select(F.explode("bands").alias("key"), "node")
    # a table of its own (as below): AQE then sees two plain sides and splits the join at a hot key
    heads = staged(seen.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
                   .select("key", "head"), "heads")
    shared = staged(seen.join(heads, "key"), "shared")
    stars = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = staged(_verified(stars, reps, texts), "links")
    groups = components(links)

    after = shared.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    mixed = (after.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"))
             .where("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    around = components(staged(_alike(after.join(mixed, "key"), reps), "alike"))
    around = staged(around.withColumnRenamed("component", "region").join(groups, "node", "left")
                    .select("region", "node", F.coalesce("component", "node").alias("group")), "regions")
    if not around.isEmpty():
        groups = components(links.unionByName(staged(_across(around, reps, texts), "more")))

    placed = staged(thin.join(classes, "set_key", "left").join(groups, "node", "left")
                    .select("row", "doc_id", "n_shingles", F.coalesce("component", "node", "row").alias("group")),
                    "placed")
    low = staged(placed.groupBy("group").agg(F.min("doc_id").alias("component_id")), "low")
    return (placed.join(low, "group").select("doc_id", "n_shingles", "component_id")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each component: the one with the smallest id.

    The rows are staged with a number of their own, and it is these numbers that are grouped, so
    an id says which row of a component stays and nothing else.

    Defined cases: those of :func:`near_groups`; rows that share an id are rows of their own, and
    only those that have a near copy go; of repeated rows one stays, as of other copies; a null
    id stays only where its component has no other; rows without shingles all stay; columns of
    any name are kept; an empty table gives no rows.
    """
    row, = free_names(docs.columns, "row_number")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = near_groups(numbered, row, text_col).select(F.col("doc_id").alias("at"), "component_id")
    ids = numbered.select(F.col(row).alias("at"), F.col(id_col).cast("long").alias("id"))
    placed = staged(groups.join(ids, "at"), "near-rows")
    first = staged(placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first")),
                   "near-first")
    gone = staged(placed.join(first, "component_id").where("at <> first.at").select(F.col("at").alias(row)), "gone")
    return without_ids(numbered, gone, [row]).select(*docs.columns)


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Only the texts of classes that occur in a pair are read again and turned into sets. ``b``
    is a pair's hub: its set travels once per HUB_MEMBERS members, which stream past it.
    """
    pairs = staged(pairs.select("a", "b"), "pairs")
    portions = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("portions"))
    members = (pairs.join(portions, "b")
               .select(F.col("a").alias("node"), F.col("b").alias("hub"),
                       F.pmod(F.xxhash64("a"), F.col("portions")).cast("int").alias("portion"),
                       F.lit(False).alias("is_hub")))
    hubs = portions.select(F.col("b").alias("node"), F.col("b").alias("hub"),
                           F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"),
                           F.lit(True).alias("is_hub"))
    roles = staged(members.unionByName(hubs), "roles")
    return (_full_sets(roles.select("node").distinct(), reps, texts).join(sized(roles), "node")
            .repartition("hub", "portion").sortWithinPartitions("hub", "portion", F.desc("is_hub"))
            .select("hub", "portion", "is_hub", "node", "members")
            .mapInArrow(tidied(_against_hub), "a long, b long"))


def _full_sets(nodes: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, members)``: the full sets of some classes, from their texts."""
    needed = staged(nodes.join(reps.select("node", "doc_id", "set_key"), "node"), "needed")
    mine = needed.select("node", "set_key", F.col("doc_id").alias("_doc"))
    return (texts.join(sized(mine), F.col("doc_id").eqNullSafe(F.col("_doc")))
            .select("node", "set_key", "text").mapInArrow(tidied(_sets), "node long, members binary"))


def _sets(batches):
    import pyarrow as pa

    for big in batches:
        for at in range(0, big.num_rows, 500):
            batch = big.slice(at, 500)
            sets = shingle_sets(batch.column("text").to_pylist())
            rows = [(node, s.tobytes()) for node, key, s in
                    zip(batch.column("node").to_pylist(), batch.column("set_key").to_pylist(), sets)
                    if set_key(s) == key]  # another text under the same id is not the class
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                              pa.array([r[1] for r in rows], pa.binary())], ["node", "members"])


def similar(a, b) -> bool:
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < PERCENT * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _against_hub(batches):
    """Rows come sorted with a hub before its members; one hub's set is held at a time."""
    import numpy as np
    import pyarrow as pa

    at, hub = None, None
    for batch in batches:
        a, b = [], []
        for key, portion, is_hub, node, data in zip(*(c.to_pylist() for c in batch.columns)):
            s = np.frombuffer(data, dtype=np.uint64)
            if is_hub:
                at, hub = (key, portion), s
            elif at == (key, portion) and similar(s, hub):
                a.append(node)
                b.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_blocks(rows: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows with a count of ``blocks`` per key, dealt to pairs of blocks (i <= j) of their key;
    a block's rows come on the left side with itself and the later ones."""
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select(key, mine.alias("i"), every.alias("j"), F.lit(True).alias("left"), *cols).where("i <= j")
    right = rows.select(key, every.alias("i"), mine.alias("j"), F.lit(False).alias("left"), *cols).where("i <= j")
    return left.unionByName(right).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _alike(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Forest (a, b) of the pairs within a bucket that lie in different components and whose
    signatures agree enough."""
    full = rows.join(reps.select("node", "slots", "n_shingles"), "node")
    return (_in_blocks(full, "key", ["group", "node", "slots", "n_shingles"])
            .mapInArrow(tidied(lambda batches: _each_block(batches, False)), "a long, b long"))


def _across(regions: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Forest (a, b) of the verified links between components within a region."""
    blocks = regions.groupBy("region").agg(F.ceil(F.count("*") / REGION_BLOCK).cast("int").alias("blocks"))
    full = (_full_sets(regions.select("node"), reps, texts).join(regions, "node").join(blocks, "region")
            .join(reps.select("node", "slots", "n_shingles"), "node"))
    return (_in_blocks(full, "region", ["group", "node", "slots", "n_shingles", "members"])
            .mapInArrow(tidied(lambda batches: _each_block(batches, True)), "a long, b long"))


def _each_block(batches, verify: bool):
    import pyarrow as pa

    def out(rows):
        pairs = list(_forest(rows, verify))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    key, rows = None, []
    for batch in batches:
        for k, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, i, j) != key:
                if rows:
                    yield out(rows)
                key, rows = (k, i, j), []
            rows.append(row)
    if rows:
        yield out(rows)


def _forest(rows, verify: bool):
    """Pairs of a left and a right row in different components, with signatures that agree and,
    on request, full sets that are similar; a pair whose ends the block has already joined is
    passed over, so there are fewer pairs than rows."""
    import numpy as np

    left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
    if not left or not right:
        return
    parent: dict = {}
    if verify:  # components known before are joined to begin with
        for _, group, node, *_rest in rows:
            union(parent, ("g", group), ("n", node))
    size = np.array([r[4] for r in right], dtype=np.int64)
    slots = np.array([np.frombuffer(r[3], np.uint8) for r in right])
    groups = np.array([r[1] for r in right], dtype=np.int64)
    sets = [np.frombuffer(r[5], np.uint64) for r in right] if verify else None
    for _, group, node, own, count, *members in left:
        may = (groups != group) & (100 * np.minimum(size, count) >= PERCENT * np.maximum(size, count))
        which = np.nonzero(may)[0]
        if not len(which):
            continue
        agree = (slots[which] == np.frombuffer(own, np.uint8)).mean(axis=1)
        order = np.argsort(-agree, kind="stable")
        mine = np.frombuffer(members[0], np.uint64) if verify else None
        for i in which[order[agree[order] >= LEAST_ESTIMATE]].tolist():
            other = right[i][2]
            a, b = ("n", node), ("n", other)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if find(parent, a) != find(parent, b) and (not verify or similar(mine, sets[i])):
                union(parent, a, b)
                yield max(node, other), min(node, other)
