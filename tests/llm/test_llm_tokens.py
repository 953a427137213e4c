"""op1, op6 and op9 against the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import clashing, frame, rows
from tokenizers import Tokenizer

from lectern.llm import bitplane, bpe, encode, packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(encode.tokenizer_path())


def as_bytes(ids):
    return np.array(ids, dtype="<u4").tobytes()


def expected(tokenizer, data, end):
    return [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + end) for r in data]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" .,'\n\tabcÉéİΣσ́½ǅ")), max_size=60))
def test_encoders_agree_with_the_library(text):
    tok = Tokenizer.from_file(encode.tokenizer_path()) if not hasattr(test_encoders_agree_with_the_library, "t") else \
        test_encoders_agree_with_the_library.t
    test_encoders_agree_with_the_library.t = tok
    ids = tok.encode(text, add_special_tokens=False).ids
    assert encode.encoder(encode.tokenizer_path()).encode([text])[0] == as_bytes(ids)
    table = bpe.merge_table(encode.tokenizer_path())
    own, decoded = table.both(text)
    assert own == as_bytes(ids)
    assert decoded.decode() == tok.decode(ids, skip_special_tokens=False) == table.decode(ids)


@pytest.mark.parametrize("pattern", [":{}", "a{}", "{}z9"])
def test_every_code_point(tokenizer, pattern):
    """All planes with characters: classes, case and composition are the library's."""
    points = [c for c in (*range(0x80, 0x32400), *range(0xE0000, 0xE0200)) if not 0xD800 <= c <= 0xDFFF]
    enc, table = encode.WordEncoder(encode.tokenizer_path()), bpe.MergeTable(encode.tokenizer_path())
    wrong = []
    for at in range(0, len(points), 50_000):
        texts = [pattern.format(chr(c)) for c in points[at:at + 50_000]]
        exp = [as_bytes(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = enc.encode(texts)
        wrong += [t for t, e, g in zip(texts, exp, got) if g != e or table.both(t)[0] != e]
    assert wrong == []


def test_added_tokens_in_other_cases(tokenizer):
    enc, table = encode.WordEncoder(encode.tokenizer_path()), bpe.MergeTable(encode.tokenizer_path())
    for text in ("<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|STARTOFTEXT|>y", "<|endoftext|>X <|ENDOFTEXT|>",
                 "É<|startoftext|>É", "<|endofteXt|>́"):
        ids = as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
        assert enc.encode([text])[0] == ids == table.both(text)[0], text


def test_word_table_rolls_over(tokenizer, monkeypatch):
    monkeypatch.setattr(encode, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PARTS", 5)
    enc, table = encode.WordEncoder(encode.tokenizer_path()), bpe.MergeTable(encode.tokenizer_path())
    for r in rows():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        assert enc.encode([r[1]])[0] == as_bytes(ids) == table.both(r[1])[0]


def test_planes_and_checksums():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 49408, 1000), np.array([0]), np.array([2 ** 32 - 1, 5, 70000])):
        ids = ids.astype("<u4")
        planes = bitplane.to_planes(ids)
        assert (bitplane.from_planes(planes, len(ids)) == ids).all()
    a, b = rng.bytes(77), rng.bytes(1234)
    assert bitplane.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert bitplane.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("wide", [False, True])
def test_token_blocks_round_trip(spark, tmp_path, tokenizer, wide):
    path = f"file://{tmp_path}/blocks"
    bitplane.write_token_blocks(clashing(spark) if wide else frame(spark), path)
    got = bitplane.read_documents(spark, path).collect()
    exp = expected(tokenizer, rows(), [2])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == \
        Counter((d, len(i), zlib.crc32(as_bytes(i))) for d, i in exp)
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # gapless, ids ascending, null ids first
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def test_documents_over_many_blocks(spark, tmp_path, tokenizer, monkeypatch):
    # few ids a block: documents run over several, some end at a block's end
    data = [(i, "a b c d " * n, None, None, None) for i, n in enumerate((1, 16000, 0, 20000, 5, 70000))]
    path = f"file://{tmp_path}/blocks"
    bitplane.write_token_blocks(frame(spark, data), path)
    blocks = spark.read.parquet(path).collect()
    assert all(b.n_ids == bitplane.BLOCK for b in blocks) is False and len(blocks) >= 6
    assert all(len(b.planes) == len(b.plane_bytes) for b in blocks)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in bitplane.read_documents(spark, path).collect()}
    assert got == {d: (len(i), zlib.crc32(as_bytes(i))) for d, i in expected(tokenizer, data, [2])}


def test_bpe_documents(spark, tokenizer):
    got = bpe.encode_documents(clashing(spark)).collect()
    exp = expected(tokenizer, rows(), [])
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == \
        Counter((d, tuple(i), tokenizer.decode(i, skip_special_tokens=False)) for d, i in exp)


def test_shortest_pack_first_places_everything():
    rng = np.random.default_rng(2)
    for histogram in ({2048: 7, 2047: 3, 1: 5}, {3: 100_000}, {int(x): int(n) for x, n in
                      zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))}, {}):
        patterns = packing.shortest_pack_first(dict(histogram), 2048)
        used = Counter()
        for pattern, copies in patterns:
            assert 0 < sum(pattern) <= 2048 and copies > 0
            for length in pattern:
                used[length] += copies
        assert used == Counter(histogram)
    tokens = sum(k * v for k, v in histogram.items())
    full = {int(x): 40 for x in range(1, 2049)}
    n = sum(c for _, c in packing.shortest_pack_first(full, 2048))
    assert n * 2048 <= 1.02 * sum(k * v for k, v in full.items()) and tokens >= 0


def test_packed_sequences(spark, tokenizer):
    got = packing.pack_documents(clashing(spark), with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and {r.padded_length for r in pieces} == {at if at & (at - 1) == 0 else 2048}
    exp = Counter()
    for d, ids in expected(tokenizer, rows(), [1]):
        for at in range(0, len(ids), 2048):
            exp[d, at, as_bytes(ids[at:at + 2048]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, bytes(r.ids), r.doc_tokens) for r in got) == exp


def test_empty_tables(spark, tmp_path):
    none = frame(spark, [])
    bitplane.write_token_blocks(none, f"file://{tmp_path}/none")
    assert bitplane.read_documents(spark, f"file://{tmp_path}/none").count() == 0
    assert bpe.encode_documents(none).count() == 0
    assert packing.pack_documents(none).count() == 0


def test_words_with_any_marks_at_their_end():
    import string

    tok = Tokenizer.from_file(encode.tokenizer_path())
    enc = encode.WordEncoder(encode.tokenizer_path())
    words = [w + a + b for w in ("stone", "Été", "ΣΣ", "x", "don't", "3a") for a in string.punctuation for b in ["", *string.punctuation]]
    words += ["a<|endoftext|>", "a<|ENDOFTEXT|>", "a$$$$$$$$", "a_b", "a-'s", "a's", "a.'", "a*'ll"]
    for w, ids in zip(words, enc.encode(words)):
        assert ids == as_bytes(tok.encode(w, add_special_tokens=False).ids), w
    joined = " ".join(words)
    assert enc.encode([joined])[0] == as_bytes(tok.encode(joined, add_special_tokens=False).ids)


def test_crc32_of_joined_strings():
    import zlib

    for n in (0, 1, 5, 64, 4097, 70_001):
        a, b = b"xyz" * 9, bytes(i * 7 % 256 for i in range(n))
        assert bitplane.crc32_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)
