"""Whole-text encoding with a public tokenizer file, with ids of repeated words kept."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator

TOKENIZER = "word_bpe_49k.json"
# Words whose ids a Python worker keeps: two tables of this size. When the newer one is full it
# becomes the older one, and words met again move back, so frequent words stay.
KEPT_WORDS, KEPT_CHARS = 450_000, 16 << 20
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 20  # texts encoded at once
# str.split() also splits at these four, which the tokenizer does not count as white space.
SEPARATORS = re.compile("[\x1c-\x1f]")
ASCII_SPACE = re.compile("[ \t\n\r]+")
# Texts with these are not lower-cased before the tokenizer does it: a mark may compose with a
# lower-cased letter only, and two capitals have no single, context-free lower-case letter.
MARKS = re.compile("[\u0300-\u036f\u0130\u03a3]")
# Marks that may end a word; between a letter and one of them there always is a break. The
# apostrophe is none (``'s``), nor are the signs around added tokens.
TAIL = "".join(set(string.punctuation) - set("'<>"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str, added: tuple[str, ...] = ()) -> list[str]:
    """The text's parts between white space, lower-cased where that is safe. The tokenizer never
    joins characters across white space and lower-cases itself, so the ids of a text are its
    parts' ids one after the other. It takes the ``added`` tokens out of the raw text first: a
    text that holds one of them in any case is left as it is."""
    if text.isascii() or not MARKS.search(text):
        low = text.lower()
        if not any(a in low for a in added):
            text = low
    return text.split() if not SEPARATORS.search(text) else [w for w in ASCII_SPACE.split(text) if w]


def _normal(word: str) -> str | None:
    """A word of letters as the tokenizer's normaliser makes it (NFC, lower case letter by
    letter); None where that is no longer one run of letters, or depends on the context."""
    if word.isascii():
        return word.lower()
    if "\u0130" in word or "\u03a3" in word:
        return None
    word = unicodedata.normalize("NFC", word).lower()
    return word if word.isalpha() else None


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids with the tokenizers library; a word's
    ids are computed once per worker, which keeps those of ``kept`` words in each of two tables."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept = kept
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ends, self.letters = self._for_letters(path)

    def _for_letters(self, path: str):
        """For files that normalise as :func:`_normal` does, keep runs of letters whole and mark
        word ends in their vocabulary: which ids end a word, and the tokenizer for normalised
        words of letters, which only has to part them at blanks."""
        import json

        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (not suffix or steps != ["NFC", "Replace", "Lowercase"]
                or [p["type"] for p in split] != ["Split", "ByteLevel"]
                or "[\\p{L}]+" not in split[0]["pattern"].get("Regex", "")):
            return None, None
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(names.values()) + 1, dtype=bool)
        ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
        at_blanks = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, split[1]]}
        plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": at_blanks,
                                                      "truncation": None, "padding": None}))
        return ends, plain

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none), as bytes. Memory: the texts' words and two tables of
        ``kept`` words."""
        lists = [words_of(t or "", self.added) for t in texts]
        if len(self.ids) > self.kept or self.chars > KEPT_CHARS:
            self.ids, self.older, self.chars = {}, self.ids, 0
        new = set().union(*lists).difference(self.ids)
        if new:
            if self.older:
                again = new.intersection(self.older)
                self.ids.update((w, self.older[w]) for w in again)
                new -= again
                self.chars += sum(map(len, again))
            self.chars += sum(map(len, new))
            self._learn(new)
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) for words in lists]

    def each(self, texts) -> Iterator[bytes]:
        """Ids of the texts of an Arrow column, in portions of bounded size."""
        part: list = []
        size = 0
        for t in texts:
            part.append(t.as_py())
            size += len(part[-1] or "")
            if len(part) >= BATCH_TEXTS or size >= BATCH_CHARS:
                yield from self.encode(part)
                part, size = [], 0
        if part:
            yield from self.encode(part)

    def _learn(self, new: set[str]) -> None:
        """Ids of new words. Words of letters alone are one unit to the tokenizer: they are
        encoded together, between blanks, and told apart by the ids that end a word."""
        import numpy as np

        known, plain, ended, rest = self.ids, {}, [], []
        for w in new:
            s = w if w.isalpha() else w.rstrip(TAIL)
            n = None
            if self.letters and s.isalpha():
                n = s.lower() if s.isascii() else _normal(s)
            if n is None:
                rest.append(w)
                continue
            if s is not w:
                ended.append((w, s))
                if s in known:
                    continue
            plain[s] = n
        names, normal = list(plain), list(plain.values())
        for i in range(0, len(names), 500):
            part = names[i:i + 500]
            joined = self.letters.encode_batch_fast([" ".join(normal[i:i + 500])], add_special_tokens=False)[0]
            ids = np.array(joined.ids, dtype="<u4")
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) != len(part):  # cannot be told apart: one by one
                known.update(zip(part, self._single(part)))
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(part, (stops * 4).tolist()):
                known[w] = data[at:stop]
                at = stop
        tails = list({w[len(s):] for w, s in ended}.difference(known))
        for words in (rest, tails):
            for i in range(0, len(words), 10_000):
                known.update(zip(words[i:i + 10_000], self._single(words[i:i + 10_000])))
        known.update((w, known[s] + known[w[len(s):]]) for w, s in ended)

    def _single(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, kept: int = KEPT_WORDS) -> WordEncoder:
    """The worker's encoder for a tokenizer file; kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, kept)
    _ENCODERS[path].kept = kept
    return _ENCODERS[path]
