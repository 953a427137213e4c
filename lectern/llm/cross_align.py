"""Alignment of two tokenizers' tokens of the same texts by interval coalescing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import prepare, staged, tidied
from .encode import tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS = 8 << 20   # text of the documents that share one table of id pairs
PART_CHARS = 1 << 20    # text aligned at once
KEPT_UNITS, KEPT_CHARS = 300_000, 12 << 20  # units whose ids a worker keeps, in two tables
JOINT = re.compile(r"(?<=\S) (?=\S)")
ID_BITS = 32            # an id pair is one long: B id above, A id below


class TokenPair:
    """Ids of a text by two tokenizers, and the bytes that each id stands for.

    A text is taken in units: it is cut before a blank that stands alone between two visible
    characters. Neither tokenizer makes a token across such a place (the byte-level pattern
    starts a word there, the piece vocabulary has the blank at the start of a piece only), and
    both put a blank before what they encode, so a unit's ids are computed once per worker.
    """

    def __init__(self, a_path: str, b_path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letter = {c: b for b, c in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letter[c] for c in name)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        size = max(len(self.a_bytes), len(self.b_bytes))
        self.size = size
        self.names = np.array([f"{i}{end}" for end in ",|;" for i in range(size)], dtype=object)
        # whether a piece holds a blank behind its first visible character: then nothing may be cut
        self.whole = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.older: dict[str, tuple[bytes, bytes] | None] = {}
        self.chars = 0

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def units(self, text: str) -> list[str]:
        """The units of a text; joined by blanks they are the text."""
        return [text] if self.whole else JOINT.split(text)

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Each text's A and B ids as little-endian unsigned 32-bit integers; none where the
        text is null or empty, or where either's bytes are not the blank and the text."""
        lists = [self.units(t) if t else [] for t in texts]
        if len(self.known) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        new = set().union(*lists).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((u, self.older[u]) for u in again)
        self.chars += sum(map(len, new))
        self._learn(list(new - again))
        get, out = self.known.__getitem__, []
        for units in lists:
            found = list(map(get, units))
            out.append((b"", b"") if None in found else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of new units: many are encoded as one text and told apart by the bytes of their
        ids; one by one where those are not the text's."""
        import numpy as np

        inner = [u for u in new if not (u[0].isspace() or u[-1].isspace())]
        for at in range(0, len(inner), 500):
            part = inner[at:at + 500]
            cuts = np.cumsum([len(u.encode()) + 1 for u in part])
            joined = " ".join(part)
            a, b = self._encoded(joined)
            a_cuts = np.searchsorted(np.cumsum(self.a_len[a]), cuts) + 1
            b_cuts = np.searchsorted(np.cumsum(self.b_len[b]), cuts) + 1
            if self._same(joined, a, b):
                a_data, b_data, i, j = a.tobytes(), b.tobytes(), 0, 0
                for unit, m, n in zip(part, (4 * a_cuts).tolist(), (4 * b_cuts).tolist()):
                    self.known[unit] = (a_data[i:m], b_data[j:n])
                    i, j = m, n
                continue
            self._learn_each(part)
        self._learn_each([u for u in new if u[0].isspace() or u[-1].isspace()])

    def _learn_each(self, units: list[str]) -> None:
        for unit in units:
            a, b = self._encoded(unit)
            self.known[unit] = (a.tobytes(), b.tobytes()) if self._same(unit, a, b) else None

    def _encoded(self, text: str):
        import numpy as np

        return (np.array(self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, "<u4"),
                np.array(self.b.encode(text), "<u4"))

    def _same(self, text: str, a, b) -> bool:
        data = f" {text}".encode()
        return (b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data
                and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data)

    def align(self, ids: list[tuple[bytes, bytes]]):
        """Per text ``(n_a, n_b, n_groups, groups)``, and all texts' links: how many each has, and
        their id pairs in order of the texts.

        All tokens of the texts lie on one axis of bytes, text after text. They are sorted by
        start; the running maximum of ends says where a group breaks (a start that reaches it),
        which is where tokens of both kinds end, text ends included.
        """
        import numpy as np

        a = np.frombuffer(b"".join([x for x, _ in ids]), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join([y for _, y in ids]), "<u4").astype(np.int64)
        na = np.array([len(x) // 4 for x, _ in ids], dtype=np.int64)
        nb = np.array([len(y) // 4 for _, y in ids], dtype=np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_start, b_start = a_end - self.a_len[a], b_end - self.b_len[b]
        none = np.zeros(0, np.int64)
        if not len(a):
            return [(0, 0, 0, "")] * len(ids), np.zeros(len(ids), np.int64), none

        starts, ends = np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
        side = np.concatenate((np.zeros(len(a), np.int8), np.ones(len(b), np.int8)))
        order = np.lexsort((side, starts))
        reach = np.maximum.accumulate(ends[order])
        breaks = np.concatenate(([True], starts[order][1:] >= reach[:-1]))
        group = np.cumsum(breaks) - 1

        # overlaps within the groups: of an A token, the B tokens from the first that ends behind
        # its start to the last that starts before its end
        lo = np.searchsorted(b_end, a_start, side="right")
        count = np.searchsorted(b_start, a_end, side="left") - lo
        before = np.cumsum(count) - count
        other = np.repeat(lo - before, count) + np.arange(int(count.sum()))
        links = (b[other] << ID_BITS) | np.repeat(a, count)

        # the groups' text: A ids, then B ids, each group's in order
        key = 2 * group + side[order]
        final = order[np.argsort(key, kind="stable")]
        key = np.sort(key, kind="stable")
        last = np.concatenate((key[1:] != key[:-1], [True]))
        end = np.where(last, 1 + side[final].astype(np.int64), 0)
        texts = self.names[end * self.size + np.concatenate((a, b))[final]].tolist()

        bytes_to = np.zeros(len(ids) + 1, np.int64)
        stops = np.cumsum(na)
        bytes_to[1:] = np.concatenate(([0], a_end))[stops]
        groups_to = np.searchsorted(starts[order][breaks], bytes_to)
        tokens_to = np.concatenate(([0], np.cumsum(na + nb)))
        links_to = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], stops))]
        rows = [(int(na[i]), int(nb[i]), int(groups_to[i + 1] - groups_to[i]),
                 "".join(texts[tokens_to[i]:tokens_to[i + 1]])[:-1]) for i in range(len(ids))]
        return rows, np.diff(links_to), links


_PAIRS: dict[tuple[str, str], TokenPair] = {}


def token_pair(a_path: str, b_path: str) -> TokenPair:
    """The worker's tokenizers and tables for two files; kept from task to task."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = TokenPair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _parts(batches) -> Iterator[tuple[list, list]]:
    """Ids and texts in portions of PART_CHARS or one longer text."""
    keys: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            keys.append(k)
            texts.append(t)
            size += len(t or "")
            if size >= PART_CHARS or len(keys) >= 4096:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _packed(places) -> bytes:
    """Sorted places as compressed differences."""
    import numpy as np
    import zstandard

    steps = np.diff(np.sort(places), prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes())


def _unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64))


_ALIGNED = ("block long, kind int, pos int, code long, n long, doc_id long, n_a long, n_b long, n_groups long, "
            "n_links long, groups string, links binary")


def _aligned_blocks(paths: tuple[str, str], digests: bool):
    """Batches of ``(doc_id, text)`` -> rows of kind 1, a document, whose links are places in its
    block's table of id pairs, and of kind 0, that table with the pairs' counts in the block."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("code", pa.int64()),
                            ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                            ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
                            ("links", pa.binary())])
        pair = token_pair(*paths)
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32

        def rows(m, /, **cols):
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(m, f.type) for f in schema], schema=schema)

        def finished(docs, per_doc, links):
            codes, where, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            for at in range(0, len(codes), 10_000):
                c = codes[at:at + 10_000]
                yield rows(len(c), block=np.full(len(c), block), kind=np.zeros(len(c), np.int32),
                           pos=np.arange(at, at + len(c), dtype=np.int32), code=c, n=n[at:at + 10_000])
            stops = np.cumsum(np.concatenate(per_doc))
            packed = [_packed(p) for p in np.split(where, stops[:-1])]
            for at in range(0, len(docs), 1000):
                d = list(zip(*docs[at:at + 1000]))
                m = len(d[0])
                yield rows(m, block=np.full(m, block), kind=np.ones(m, np.int32),
                           pos=np.arange(at, at + m, dtype=np.int32), doc_id=d[0], n_a=d[1], n_b=d[2], n_groups=d[3],
                           groups=d[4], n_links=np.concatenate(per_doc)[at:at + m], links=packed[at:at + 1000])

        docs: list = []
        per_doc: list = []
        links: list = []
        size = 0
        for keys, texts in _parts(batches):
            found, count, pairs = pair.align(pair.ids(texts))
            for k, (n_a, n_b, n_groups, groups) in zip(keys, found):
                if digests and n_a:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                docs.append((k, n_a, n_b, n_groups, groups))
            per_doc.append(count)
            links.append(pairs)
            size += sum(len(t or "") for t in texts)
            if size >= BLOCK_CHARS:
                yield from finished(docs, per_doc, links)
                block += 1
                docs, per_doc, links, size = [], [], [], 0
        if docs:
            yield from finished(docs, per_doc, links)
    return run


def _weighed(batches):
    """Rows of a block, its table of pairs first: the documents with their links' counts."""
    import numpy as np
    import pyarrow as pa

    block, counts, best = None, [], []
    table: tuple | None = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        blocks = batch.column("block").to_numpy()
        cuts = np.nonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if blocks[lo] != block:
                block, counts, best, table = blocks[lo], [], [], None
            if kinds[lo] == 0:
                counts.append(part.column("n").to_numpy())
                best.append(part.column("best").to_numpy(zero_copy_only=False))
                continue
            if table is None:
                table = ((np.concatenate(counts), np.concatenate(best).astype(bool)) if counts
                         else (np.zeros(0, np.int64), np.zeros(0, bool)))
            n_best, total = [], []
            for data in part.column("links").to_pylist():
                places = _unpacked(data)
                n_best.append(int(table[1][places].sum()))
                total.append(int(table[0][places].sum()))
            cols = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part.column("groups")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align_tokenizers(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: one row per input row ``(doc_id, n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups)``, and the corpus-wide id pairs ``(a_id, b_id, n, best)``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (its SHA-256 with ``digests``). A link is an A and a B
    token whose byte ranges overlap; a pair's ``n`` is its number of links in all texts, ``best``
    says that no other A id has more with the same B id. ``n_best`` counts a text's links whose
    pair is best, ``count_sum`` adds up their pairs' ``n``.

    Texts are tokenised and aligned once, in the scan. Documents that follow each other in a
    task share a block (BLOCK_CHARS of text) with one table of its id pairs, and a document keeps
    its links as places in that table. Only the tables move to be counted (combined in the map
    tasks) and to fetch the corpus counts, a row per block and pair, however often a pair occurs;
    then a block's table and documents meet again, streamed in sorted order. A pair of every block
    makes one row per block; AQE can split that join, as its sides are staged tables.

    Memory: a block's links and table, and PART_CHARS of text or one longer text with its tokens.

    Defined cases: null and empty texts, and texts whose bytes either tokenizer does not give
    back (a U+2581 in them, characters it normalises), have zeros and an empty ``groups``; null
    ids are kept; repeated rows each give a row and all count; an empty table gives two empty
    tables; other columns are not read.
    """
    prepare(docs.sparkSession)
    paths = (a or tokenizer_path(A_FILE), b or tokenizer_path(B_FILE))
    blocks = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                    .mapInArrow(tidied(_aligned_blocks(paths, digests), keep="cross_align"), _ALIGNED), "aligned")
    tables = blocks.where("kind = 0")
    counts = staged(tables.groupBy("code").agg(F.sum("n").alias("n"))
                    .withColumn("b_id", F.shiftright("code", ID_BITS)), "pair-counts")
    most = staged(counts.groupBy("b_id").agg(F.max("n").alias("most")), "best-counts")
    ranked = staged(counts.join(most, "b_id").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")

    known = tables.select("block", "kind", "pos", "code").join(ranked, "code")
    thin = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    both = (known.select("block", "kind", "pos", "n", "best")
            .unionByName(blocks.where("kind = 1").select("block", "kind", "pos", *thin), allowMissingColumns=True))
    out = (both.repartition("block").sortWithinPartitions("block", "kind", "pos")
           .mapInArrow(tidied(_weighed), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                         "count_sum long, groups string"))
    pairs = ranked.select((F.col("code").bitwiseAND((1 << ID_BITS) - 1)).cast("int").alias("a_id"),
                          F.shiftright("code", ID_BITS).cast("int").alias("b_id"), "n", "best")
    return out, pairs
