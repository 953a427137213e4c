"""Byte-pair encoding and decoding of whole texts from a public merge table."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidied
from .encode import tokenizer_path, words_of

# Parts (and words) whose ids a Python worker keeps, in two tables of this size.
KEPT_PARTS, KEPT_CHARS = 400_000, 16 << 20
# The tokenizer's word pattern for ASCII text: contractions, runs of letters, single digits, runs of the rest.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
ASCII_WORD = re.compile("|".join(CONTRACTIONS) + r"|[A-Za-z]+|[0-9]|[^\t-\r A-Za-z0-9]+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters for themselves, the other bytes in order from U+0100."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary, merge ranks and added tokens of a tokenizer file.

    Supports what the public BPE files use: NFC, white space to one space, lower case;
    a word pattern; byte-level letters; a word-end suffix; added tokens taken from the raw text.
    Beyond ASCII, case, composition and character classes are those of the library's own
    normaliser and pre-tokenizer, as Python's ``unicodedata`` may know another Unicode version.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.lowered = tuple(t.lower() for t in self.added)
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))
                                      + ")") if self.added else None
        self.word_ids: dict[str, list[int]] = {}
        self.part_ids: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.chars = 0

    def merge(self, word: str) -> list[int]:
        """Ids of one word (letters of its bytes): all pairs' merge ranks in a priority queue,
        symbols in a doubly linked list; an entry is stale, and skipped, when one of its
        symbols has been merged away or changed since it was queued."""
        ids = [self.vocab.get(c) for c in word[:-1]] + [self.vocab.get(word[-1] + self.suffix)]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if m := self.merges.get((ids[i], ids[i + 1])):
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (m[0], p, ids[p], ids[q], m[1]))
        return [i for i in ids if i != -1]

    def split_words(self, text: str) -> list[str]:
        """The words of a raw text without added tokens, as letters of their bytes."""
        if not text.isascii():
            normal = self.normalizer.normalize_str(text)
            return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(normal)]
        letters = self.letters
        return ["".join([letters[b] for b in word.encode()]) for word in ASCII_WORD.findall(text.lower())]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text without white space inside (or of any text, part by part)."""
        out: list[int] = []
        for piece in self.split_added.split(part) if self.split_added else [part]:
            if piece in self.added:
                out.append(self.added[piece])
                continue
            for word in self.split_words(piece):
                ids = self.word_ids.get(word)
                if ids is None:
                    ids = self.word_ids[word] = self.merge(word)
                out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The ids' vocabulary strings, joined by the separator of a file without a decoder."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def both(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8. Parts
        between white space are encoded and decoded once per worker and joined in order."""
        if max(len(self.part_ids), len(self.word_ids)) > KEPT_PARTS or self.chars > KEPT_CHARS:
            # the older table goes; parts met again move back, so frequent ones stay
            self.part_ids, self.older, self.word_ids, self.chars = {}, self.part_ids, {}, 0
        known, parts = self.part_ids, words_of(text or "", self.lowered)
        for part in set(parts).difference(known):
            got = self.older.get(part)
            if got is None:
                ids = self.encode_part(part)
                got = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode("utf-8"))
            known[part] = got
            self.chars += len(part)
        found = [known[part] for part in parts]
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[0]])


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id",
                     text_col: str = "text", digests: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>, decoded)``, or with ``digests`` ``(doc_id, n_tokens,
    ids_sha256, decoded_sha256)``, of every whole text.

    A map over the scan, with no shuffle; a worker holds one Arrow batch of texts and two
    tables of KEPT_PARTS words.

    Defined cases: null and empty texts have no ids and decode to the empty text; null ids are
    kept; repeated rows each give a row; a very long text is one list; an empty table gives no
    rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
              else "doc_id long, ids array<int>, decoded string")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = merge_table(path)
        for batch in batches:
            keys = batch.column("doc_id")
            texts = batch.column("text")
            cols: tuple[list, ...] = ([], [], [])
            for t in texts:
                ids, decoded = table.both(t.as_py())
                if digests:
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                else:
                    row = (np.frombuffer(ids, "<u4").tolist(), decoded.decode("utf-8"), None)
                for c, v in zip(cols, row):
                    c.append(v)
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                     pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string())],
                    ["doc_id", "ids", "decoded"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(tidied(run, keep="bpe"), schema))
