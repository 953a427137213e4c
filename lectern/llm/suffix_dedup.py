"""Removal of every byte that a repeated string of LENGTH bytes covers.

Suffixes are compared by prefix polynomial hashes: the common extension of two suffixes is
found by binary search over hash equality (and confirmed on the bytes), so a comparison in the
merge sort takes logarithmic time whatever the suffixes share.

Not every suffix has to be sorted. Of the GRAM-byte strings inside a LENGTH-byte window, the
one with the least hash is the window's anchor. Equal windows have equal anchors at equal
offsets, so two windows can only be equal if their anchors' strings are, and only suffixes
at anchors whose string occurs twice are brought together, with the bytes around them.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, sized, staged, tidied, without_ids
from .hashing import mix, powers

LENGTH = 200
GRAM = 64
SPREAD = LENGTH - GRAM + 1   # anchors a window chooses from
SEGMENT = 1 << 19            # bytes whose anchors are found at once
GROUP = 2000                 # different surroundings of one anchor string sorted in one task
STEP = 8                     # windows that are first counted together
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def segment_anchors(buf, starts, ends):
    """Anchors of all windows inside the documents ``starts[i]:ends[i]`` of a byte array.

    Returns document, anchor place, first and last window that it is the anchor of (places in
    the array), hash of the anchor string, hash of all bytes of those windows.
    """
    import numpy as np

    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = len(buf)
    if n < LENGTH:
        return none
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    # least hash of each window, the first on a tie: the place takes the lowest bits
    low = np.uint64((1 << 24) - 1)
    keys = np.full(-(-len(gram) // SPREAD) * SPREAD + SPREAD, ~np.uint64(0))
    keys[:len(gram)] = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    block = keys.reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:n - LENGTH + 1], ahead[SPREAD - 1:n - LENGTH + SPREAD])

    fit = ends - starts >= LENGTH
    which, count = np.nonzero(fit)[0], (ends - starts)[fit] - LENGTH + 1
    if not len(which):
        return none
    doc = np.repeat(which, count)
    window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    anchor = (least[window] & low).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    at = np.nonzero(new)[0]
    last = np.concatenate((at[1:], [len(window)])) - 1
    place, first, final = anchor[at], window[at], window[last]
    around = mix((total[final + LENGTH] - total[first]) * down[first]
                 + mix(((place - first) * 512 + (final - first)).astype(np.uint64)))
    return doc[at], place, first, final, gram[place], around


def text_anchors(texts: list[bytes]):
    """Batches of anchors of whole texts: text, place, lo, hi (least and greatest distance from a
    window's start to the anchor), hash of the anchor string, hash of its surroundings."""
    import numpy as np

    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + len(texts[j]) <= SEGMENT):
            size += len(texts[j])
            j += 1
        buf = np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts[i:j]])
        starts = ends - np.array([len(t) for t in texts[i:j]])
        if size <= SEGMENT:
            parts = [(0, buf, starts, ends)]
        else:  # one long text: its windows in portions (an anchor's windows may come in two)
            step = SEGMENT - LENGTH + 1
            parts = [(p, buf[p:p + SEGMENT], np.array([0]), np.array([min(SEGMENT, size - p)]))
                     for p in range(0, max(1, size - LENGTH + 1), step)]
        for shift, b, s, e in parts:
            doc, place, first, final, h, c = segment_anchors(b, s, e)
            yield doc + i, place - s[doc] + shift, place - final, place - first, h, c
        i = j


def _texts(batches, size: int = 2 << 20):
    """Slices of Arrow batches of about ``size`` text bytes, with their texts as bytes."""
    for big in batches:
        at = 0
        while at < big.num_rows:
            texts, n = [], 0
            while at + len(texts) < big.num_rows and (n < size or not texts):
                texts.append((big.column("text")[at + len(texts)].as_py() or "").encode("utf-8", "surrogatepass"))
                n += len(texts[-1])
            yield big.slice(at, len(texts)), texts
            at += len(texts)


def _anchor_hashes(batches):
    import pyarrow as pa

    for _, texts in _texts(batches):
        for *_, h, _c in text_anchors(texts):
            yield pa.RecordBatch.from_arrays([pa.array(h.view("int64"))], ["h"])


def _digests(texts: list[bytes], doc, place, lo, hi) -> list[bytes]:
    """128-bit digests of the surroundings (the bytes of all windows) of anchors, and of the
    anchor's place among them."""
    at = zip(doc.tolist(), (place - hi).tolist(), (place - lo + LENGTH).tolist(), lo.tolist())
    return [hashlib.blake2b(texts[x][b:e] + bytes((least,)), digest_size=16).digest() for x, b, e, least in at]


def _anchor_rows(hash_bits: int):
    """Rows of all anchors; of the surroundings' hash ``hash_bits`` bits are kept."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.uint64((1 << hash_bits) - 1)
        for part, texts in _texts(batches):
            k = part.column("k").to_numpy()
            for doc, place, lo, hi, h, c in text_anchors(texts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view("int64")), pa.array((c & bits).view("int64")),
                     pa.array(_digests(texts, doc, place, lo, hi), pa.binary()), pa.array(k[doc]), pa.array(place),
                     pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    ["h", "c", "d", "k", "at", "lo", "hi"])
    return run


def _surroundings(batches):
    """The bytes before and after each asked-for anchor of a text."""
    import pyarrow as pa

    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("k", pa.int64()), ("at", pa.int64()),
                        ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int64()), ("before", pa.binary()),
                        ("after", pa.binary())])
    for part, texts in _texts(batches):
        cols: tuple[list, ...] = tuple([] for _ in schema)
        for k, wanted, text in zip(part.column("k").to_pylist(), part.column("wanted").to_pylist(), texts):
            for w in wanted:
                at, lo, hi = w["at"], w["lo"], w["hi"]
                row = (w["h"], w["c"], k, at, lo, hi, w["n"], text[at - hi:at][::-1], text[at:at + LENGTH - lo])
                for col, v in zip(cols, row):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


class Suffixes:
    """Byte strings with their prefix hashes, compared by common extension."""

    def __init__(self, strings: list[bytes]):
        import numpy as np

        self.strings = strings
        width = max(map(len, strings), default=0)
        flat = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8)
        grid = np.zeros((len(strings), width + 1), dtype=np.uint64)
        if width:
            np.cumsum((flat.reshape(-1, width).astype(np.uint64) + np.uint64(1)) * powers(width)[0], axis=1,
                      out=grid[:, 1:])
        self.grid = memoryview(grid)

    def common(self, a: int, b: int) -> int:
        """Length of the common extension: binary search over equal prefix hashes, confirmed
        on the bytes (a collision falls back to comparing bytes)."""
        x, y, g = self.strings[a], self.strings[b], self.grid
        low, high = 0, min(len(x), len(y))
        if g[a, high] == g[b, high]:
            low = high
        while low < high:
            mid = (low + high + 1) >> 1
            if g[a, mid] == g[b, mid]:
                low = mid
            else:
                high = mid - 1
        if x[:low] != y[:low]:
            low = next(i for i in range(low) if x[i] != y[i])
        return low

    def compare(self, a: int, b: int) -> int:
        x, y, n = self.strings[a], self.strings[b], self.common(a, b)
        if n == len(x) or n == len(y):
            return len(x) - len(y)
        return x[n] - y[n]

    def ordered(self, members: list[int]) -> tuple[list[int], list[int]]:
        """The members in suffix order (sorted() is a merge sort) and the common extension of
        each with the one before it."""
        order = sorted(members, key=cmp_to_key(self.compare))
        return order, [0] + [self.common(a, b) for a, b in zip(order, order[1:])]


def repeated_offsets(before: Suffixes, after: Suffixes, members: list[int], lo, hi, n) -> dict[int, list]:
    """Which windows around one anchor string occur again: for each member that occurs once,
    the ranges (from, to) of distances from a window's start to the anchor.

    A window at distance o repeats where another member shares o bytes before the anchor and
    LENGTH - o from it on. Both orders of the members split into runs at extensions below that,
    and members in the same runs of both share the window."""
    import numpy as np

    out: dict[int, list] = {}
    if len(members) <= 6:
        for a in members:
            if n[a] > 1:
                continue
            found = []
            for b in members:
                if b != a:
                    f = max(lo[a], lo[b], LENGTH - after.common(a, b))
                    t = min(hi[a], hi[b], before.common(a, b))
                    if f <= t:
                        found.append((f, t))
            if found:
                out[a] = found
        return out
    (left, left_common), (right, right_common) = before.ordered(members), after.ordered(members)
    m = len(members)
    place = {x: i for i, x in enumerate(members)}
    left_at, right_at = np.empty(m, np.int64), np.empty(m, np.int64)
    left_at[[place[x] for x in left]] = right_at[[place[x] for x in right]] = np.arange(m)
    left_common, right_common = np.array(left_common), np.array(right_common)
    weight = np.array([n[x] for x in members])
    lows, highs = np.array([lo[x] for x in members]), np.array([hi[x] for x in members])
    hits = []
    for o in range(int(lows.min()), int(highs.max()) + 1):
        inside = np.nonzero((lows <= o) & (highs >= o))[0]
        if len(inside) < 2:
            continue
        run = np.cumsum(left_common < o)[left_at[inside]] * (m + 1) + np.cumsum(right_common < LENGTH - o)[right_at[inside]]
        _, back = np.unique(run, return_inverse=True)
        again = inside[(np.bincount(back, weight[inside])[back] > 1) & (weight[inside] == 1)]
        hits.extend((members[i], o) for i in again.tolist())
    for x, o in hits:
        spans = out.setdefault(x, [])
        if spans and spans[-1][1] == o - 1:
            spans[-1] = (spans[-1][0], o)
        else:
            spans.append((o, o))
    return out


SPAN = "k long, begin long, end long"


def _sort_groups(batches):
    """Streams surroundings sorted by anchor string; sorts the groups of a portion at a time."""
    import pyarrow as pa

    def flush(rows):
        before, after = Suffixes([r[6] for r in rows]), Suffixes([r[7] for r in rows])
        lo, hi, n = [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]
        k, begin, end = [], [], []
        a = 0
        while a < len(rows):
            b = a
            while b < len(rows) and rows[b][0] == rows[a][0]:
                b += 1
            for x, spans in repeated_offsets(before, after, list(range(a, b)), lo, hi, n).items():
                for f, t in spans:
                    k.append(rows[x][1])
                    begin.append(rows[x][2] - t)
                    end.append(rows[x][2] - f + LENGTH)
            a = b
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (k, begin, end)], ["k", "begin", "end"])

    rows: list = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "k", "at", "lo", "hi", "n", "before", "after"))):
            if len(rows) >= GROUP and row[0] != rows[-1][0]:
                yield flush(rows)
                rows = []
            rows.append(row)
    if rows:
        yield flush(rows)


def _cores(batches):
    """For every STEP offsets in a row, the bytes that their windows have in common, as a digest."""
    import pyarrow as pa

    for big in batches:
        cols: tuple[list, ...] = ([], [], [], [], [])
        for k, at, lo, hi, n, before, after in zip(*(big.column(c).to_pylist() for c in
                                                     ("k", "at", "lo", "hi", "n", "before", "after"))):
            text = before[::-1] + after
            for a in range(lo - lo % STEP, hi + 1, STEP):
                # common to the offsets a to a + STEP - 1: a bytes before the anchor, and as many
                # after as the last of them reaches
                core = text[len(before) - a:len(before) + LENGTH - (a + STEP - 1)]
                row = (hashlib.blake2b(core + a.to_bytes(4, "little"), digest_size=16).digest(), k, at, a, n)
                for col, v in zip(cols, row):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                         ["w", "k", "at", "a", "n"])


def _single_windows(batches):
    """The windows at the asked-for offsets of the surroundings, as digests of their bytes."""
    import pyarrow as pa

    for big in batches:
        cols: tuple[list, ...] = ([], [], [], [])
        for k, at, lo, hi, n, before, after, starts in zip(*(big.column(c).to_pylist() for c in
                                                             ("k", "at", "lo", "hi", "n", "before", "after", "starts"))):
            text = before[::-1] + after
            for o in (o for a in starts for o in range(max(a, lo), min(a + STEP - 1, hi) + 1)):
                b = len(before) - o
                row = (hashlib.blake2b(text[b:b + LENGTH], digest_size=16).digest(), k, at - o, n)
                for col, v in zip(cols, row):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                                         ["w", "k", "begin", "n"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, doc_id, text)``: ``k`` is a 64-bit key of id and text; null text is empty."""
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select(F.xxhash64("doc_id", "text").alias("k"), "doc_id", "text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """What :func:`remove_repeats` removes: all documents ``(k, doc_id, n_bytes, sha, copies)``, and
    for those without a copy ``(k, spans array<begin, end>)`` where something repeats.

    1. Texts with copies (equal SHA-256) are repeated as a whole; one of each goes on, as a
       place where others' strings may occur.
    2. Anchor strings are counted (8 bytes an anchor, about one in 69 places); the texts are
       scanned again for the anchors whose string occurs twice.
    3. Anchors whose surroundings (all bytes of their windows) occur twice, equal by hash and
       verified by a 128-bit digest of the bytes, are settled by count. Of the others, and one of each kind of the former, the surroundings are fetched,
       brought together by anchor string and suffix-sorted.
    4. An anchor string with more than GROUP different surroundings (a passage many documents
       share, at its edges) is not collected: what every STEP windows have in common is counted
       as a digest, and only where that occurs twice are the windows counted one by one.

    ``hash_bits`` weakens the surroundings' hash: with fewer, more of them collide and are told
    apart by the digests; the result is the same.
    """
    prepare(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    thin = staged(keyed.select("k", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "thin")
    same = thin.groupBy("sha").agg(F.count("*").alias("copies"), F.min("k").alias("first")).where("copies > 1")
    marked = thin.join(same, "sha", "left").select("k", "doc_id", "n_bytes", "sha",
                                                   F.coalesce("copies", F.lit(1)).alias("copies"), "first")
    marked = staged(marked, "marked")
    spare = staged(marked.where("copies > 1 and k <> first").select("k").distinct(), "spare")
    some = without_ids(keyed.select("k", "text").where(F.octet_length("text") >= LENGTH), spare, ["k"])

    twice = staged(some.select("text").mapInArrow(tidied(_anchor_hashes), "h long").groupBy("h").agg(F.count("*").alias("n"))
                   .where("n > 1").select("h"), "twice")
    found = staged(some.mapInArrow(tidied(_anchor_rows(hash_bits)),
                                                      "h long, c long, d binary, k long, at long, lo int, hi int")
                   .join(twice, "h", "left_semi"), "anchors")

    kinds = found.groupBy("h", "c", "d").agg(F.count("*").alias("n"), F.min(F.struct("k", "at", "lo", "hi")).alias("one"))
    kinds = staged(kinds, "kinds")
    # anchors whose surroundings occur again: every window repeats
    whole = (found.join(kinds.where("n > 1").select("h", "c", "d"), ["h", "c", "d"], "left_semi")
             .select("k", (F.col("at") - F.col("hi")).alias("begin"), (F.col("at") - F.col("lo") + LENGTH).alias("end")))
    # strings with several kinds of surroundings, one of them seen once at least
    open_ = (kinds.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1"))
    wanted = (kinds.join(open_.select("h", (F.col("m") > GROUP).alias("many")), "h")
              .select("h", "c", "n", "many", "one.*"))
    wanted = staged(wanted, "wanted")
    lists = staged(wanted.groupBy("k").agg(F.collect_list(F.struct("h", "c", "n", "at", "lo", "hi")).alias("wanted")),
                   "lists")  # a document's own anchors
    around = some.join(lists, "k")
    around = around.select("k", "wanted", "text").mapInArrow(
        tidied(_surroundings), "h long, c long, k long, at long, lo int, hi int, n long, before binary, after binary")
    hot = staged(wanted.where("many").select("h").distinct(), "hot")
    if hot.isEmpty():
        spans, rest = around, None
    else:
        around = staged(around, "around")
        spans, rest = around.join(hot, "h", "left_anti"), around.join(hot, "h", "left_semi")
    edges = (spans.select("h", "k", "at", "lo", "hi", "n", "before", "after")
             .repartition("h").sortWithinPartitions("h").mapInArrow(tidied(_sort_groups), SPAN))
    if rest is not None:
        cores = staged(rest.mapInArrow(tidied(_cores), "w binary, k long, at long, a long, n long"), "cores")
        shared = cores.groupBy("w").agg(F.sum("n").alias("t")).where("t > 1").select("w")
        alive = (cores.join(shared, "w", "left_semi").groupBy("k", "at")
                 .agg(F.collect_set("a").alias("starts")))  # SPREAD / STEP at most
        single = staged(rest.join(alive, ["k", "at"])
                        .select("k", "at", "lo", "hi", "n", "before", "after", "starts")
                        .mapInArrow(tidied(_single_windows), "w binary, k long, begin long, n long"), "single")
        often = single.groupBy("w").agg(F.sum("n").alias("t")).where("t > 1").select("w")
        edges = edges.unionByName(single.where("n = 1").join(often, "w", "left_semi")
                                  .select("k", "begin", (F.col("begin") + LENGTH).alias("end")))
    spans = (whole.unionByName(edges).groupBy("k")  # a document's own spans
             .agg(_merged(F.array_sort(F.collect_set(F.struct("begin", "end")))).alias("spans")))
    return marked, staged(spans.join(marked.where("copies = 1").select("k").distinct(), "k", "left_semi"), "spans")


def _merged(spans: Column) -> Column:
    """Sorted spans, those that touch or overlap joined: few are left for each document."""
    kind = "array<struct<begin:bigint,end:bigint>>"

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        return (F.when(last["end"] >= span["begin"],
                       F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))
                .otherwise(F.concat(done, F.array(span))).cast(kind))
    return F.aggregate(spans, F.array().cast(kind), add)


def _cut(text: bytes, spans) -> tuple[bytes, int, int]:
    """The text without the union of the spans; removed bytes and maximal removed runs."""
    kept, removed, runs, at = [], 0, 0, 0
    begin = end = None
    for s in [*spans, None]:
        b, e = (s["begin"], s["end"]) if s else (len(text) + 1, None)
        if end is not None and b <= end:
            end = max(end, e)
            continue
        if end is not None:
            kept.append(text[at:begin])
            at, removed, runs = end, removed + end - begin, runs + 1
        begin, end = b, e
    kept.append(text[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   texts: bool = False, hash_bits: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, with ``texts`` also ``kept_text``
    (bytes), one row per document: every byte that a LENGTH-byte string covers which also
    starts anywhere else, in this or any document, is removed. Strings are judged on the input.

    Defined cases: null and empty texts, and texts under LENGTH bytes, lose nothing; a text with
    an exact copy loses everything, rows that repeat id and text included; overlapping repeats
    in one text count; null ids are kept; a very long text is scanned in portions; a cut may
    fall inside a character (bytes are what counts); an empty table gives no rows; other
    columns are not read.
    """
    marked, spans = repeats(docs, id_col, text_col, hash_bits)
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    touched = spans.select("k")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * texts
    small = sized(spans, "spans")

    def run(batches):
        import pyarrow as pa

        for part, data in _texts(batches):
            rows = []
            for key, sp, t in zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist(), data):
                kept, removed, runs = _cut(t, sp)
                rows.append((key, len(t), removed, runs, hashlib.sha256(kept).hexdigest(), kept)[:5 + texts])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:5 + texts])

    keyed = _keyed(docs, id_col, text_col)
    cut = keyed.join(small, "k").select("doc_id", "spans", "text").mapInArrow(tidied(run), out)
    if texts:
        rest = keyed.join(sized(touched), "k", "left_anti").join(marked.drop("doc_id").distinct(), "k")
        kept = F.when(copied, F.lit("")).otherwise(F.col("text")).cast("binary")
    else:
        rest, kept = marked.join(touched, "k", "left_anti"), None
    rest = rest.select("doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(0).alias("n_removed"),
                       F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"),
                       F.when(copied, EMPTY_SHA).otherwise(F.col("sha")).alias("kept_sha256"),
                       *([kept.alias("kept_text")] if texts else []))
    return cut.unionByName(rest)
