"""op11, op12 and op13 against plain versions."""

import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from llm_cases import clashing, frame, prose, rows

from lectern.llm import cross_align, order_minhash, turn_repair
from lectern.llm import queries as llm_queries
from lectern.llm.encode import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- cross-tokenizer alignment
ODD = ["a▁b", "x  y", " lead", "trail ", "\n", " ", "tab\there", "<s> </s> <unk> <0x0A>", "Ａ ｂ", "ﬁ½", "中文 字", "a\n b \n\nc",
       "é é", "don't they're", "x\x1c y", "　a b "]


def aligned(texts):
    """Groups, links and counts of each text by walking the tokens."""
    pair = cross_align.TokenPair(tokenizer_path(cross_align.A_FILE), tokenizer_path(cross_align.B_FILE))
    found, corpus = [], Counter()
    for t in texts:
        a = pair.a.encode(f" {t or ''}", add_special_tokens=False).ids
        b = pair.b.encode(t or "")
        data = f" {t}".encode()
        if not t or b"".join(pair.a_bytes[i] for i in a) != data or b"".join(pair.b_bytes[i] for i in b) != data:
            found.append(([], [], [], []))
            continue
        ends = [list(itertools.accumulate(len(table[i]) for i in ids)) for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes))]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        links, j = [], 0
        for x in range(len(a)):
            lo, hi = ends[0][x] - len(pair.a_bytes[a[x]]), ends[0][x]
            while ends[1][j] <= lo:
                j += 1
            y = j
            while y < len(b) and ends[1][y] - len(pair.b_bytes[b[y]]) < hi:
                links.append((a[x], b[y]))
                y += 1
        corpus.update(links)
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in corpus.items():
        most[b] = max(most[b], n)
    out = [(len(a), len(b), len(g), len(k), sum(corpus[x] == most[x[1]] for x in k), sum(corpus[x] for x in k),
            ";".join(g)) for a, b, g, k in found]
    return out, {(a, b): (n, n == most[b]) for (a, b), n in corpus.items()}


@pytest.mark.parametrize("wide, block, part", [(False, 8 << 20, 1 << 20), (True, 3000, 500)])
def test_alignment_against_a_walk(spark, monkeypatch, wide, block, part):
    data = [*rows(), *((100 + i, t, "en", "s", 1) for i, t in enumerate(ODD))]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in data],
                               "doc_id long, text string, lang string, source string, n_chars long, "
                               "block long, groups string, code long") if wide else frame(spark, data)
    monkeypatch.setattr(cross_align, "BLOCK_CHARS", block)
    monkeypatch.setattr(cross_align, "PART_CHARS", part)
    exp, exp_pairs = aligned([r[1] for r in data])
    docs, pairs = cross_align.align_tokenizers(df)
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in docs.collect()) == \
        Counter((r[0], *e) for r, e in zip(data, exp))
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs.collect()} == exp_pairs


def test_units_are_encoded_as_in_the_text():
    pair = cross_align.TokenPair(tokenizer_path(cross_align.A_FILE), tokenizer_path(cross_align.B_FILE))
    rng = random.Random(4)
    letters = ["a", "b", "é", " ", " ", " ", "\n", "\t", "'", "s", "1", ".", "▁", "　", " ", "<s>", "<0x0A>", "😀", "中", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
        a, b = pair.a.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
        same = (b"".join(pair.a_bytes[i] for i in a) == f" {text}".encode() == b"".join(pair.b_bytes[i] for i in b))
        exp = (struct.pack(f"<{len(a)}I", *a), struct.pack(f"<{len(b)}I", *b)) if same else (b"", b"")
        assert pair.ids([text]) == [exp], text


def test_op11_on_the_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    exp, _ = aligned([r.text for r in docs])
    got = llm_queries.queries()["op11_cross_align"](spark, SMALL).collect()
    assert Counter(tuple(r) for r in got) == \
        Counter((d.doc_id, *e[:6], sha(e[6]) if e[6] else "") for d, e in zip(docs, exp))
    assert cross_align.align_tokenizers(frame(spark, []))[0].collect() == []


# ---------------------------------------------------------------- Order MinHash
def h64(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def h64_with_int(x, n):
    seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=42)
    v = xxhash.xxh64_intdigest(struct.pack("<i", n), seed=seed)
    return v - (1 << 64) if v >= 1 << 63 else v


UNSPACED = r"฀-໿က-႟ក-៿⺀-⿟々-〇぀-ヿㇰ-ㇿ㐀-䶿" \
           r"一-鿿豈-﫿\U00020000-\U000323AF"
SYMBOLS = regex.compile(rf"(?V1)[[\p{{L}}\p{{M}}\p{{N}}]--[{UNSPACED}]]+|[{UNSPACED}]")


def signature(text, k=order_minhash.K, length=order_minhash.LENGTH, bits=order_minhash.BIN_BITS):
    shift = order_minhash.PLACE_BITS
    hashes = [h64(s) for s in SYMBOLS.findall(text)]
    kmers = [h64(*hashes[i:i + k]) for i in range(len(hashes) - k + 1)] or ([h64(text)] if text else [])
    seen, numbered = Counter(), []
    for place, kmer in enumerate(h >> shift for h in kmers):
        n = seen[kmer]
        numbered.append((kmer if n == 0 else h64_with_int(kmer, n) >> shift, place))
        seen[kmer] += 1
    bins = defaultdict(list)
    for kmer, place in sorted(numbered):
        bins[kmer >> (64 - shift - bits)].append((place, kmer))
    return {b + (1 << (bits - 1)): h64(*[kmer for _, kmer in sorted(m[:length])]) & 0xffffffff for b, m in bins.items()}


def like(a, b):
    return sum(a[x] == b.get(x) for x in a) / len(a.keys() | b.keys()) if a or b else 1.0


def fingerprint(sig):
    return "".join(f"{b:02x}{v:08x}" for b, v in sorted(sig.items()))


def expected_fingerprints(data):
    chain = sorted(((d, t or "") for d, t in data), key=lambda r: (r[0] is not None, r[0] or 0, h64(r[1]), r[1]))
    out = []
    for i, (d, t) in enumerate(chain):
        nxt = chain[i - 1][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = signature(t), signature(edited), signature(nxt)
        out.append((d, len(t), sha(edited), fingerprint(a), fingerprint(b), round(like(a, b), 9), round(like(a, c), 9)))
    return Counter(out)


def got_fingerprints(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
                    round(r.near_next, 9)) for r in order_minhash.against_next(df).collect())


@pytest.mark.parametrize("wide", [False, True])
def test_fingerprints_against_a_plain_version(spark, wide):
    extra = [] if wide else [(200, "漢字かな交じり文です。 次の文。", "ja", "s", 1), (201, "😀😀 a b c d 😀", "x", "s", 1),
                             (202, "!!! ... ???", "x", "s", 1)]
    data = [*rows(), *extra]
    got = got_fingerprints(clashing(spark) if wide else frame(spark, data))
    assert got == expected_fingerprints([r[:2] for r in data])


def test_fingerprints_of_one_row_and_none(spark):
    assert got_fingerprints(frame(spark, [(5, "a b c d e f", "x", "y", 1)])) == expected_fingerprints([(5, "a b c d e f")])
    assert got_fingerprints(frame(spark, [])) == Counter()


def test_very_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PIECE", 64)
    data = [(i, prose(random.Random(i), 300), "x", "y", 1) for i in range(4)]
    assert got_fingerprints(frame(spark, data)) == expected_fingerprints([r[:2] for r in data])


def test_likeness_follows_the_edits(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "se", "mo") for b in ("n", "lt", "r", "x", "ssa", "p", "vi")]
    words = [rng.choice(vocabulary) for _ in range(900)]
    def changed(share):
        return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in words)
    moved = words[450:] + words[:450]
    shuffled = words[:]
    rng.shuffle(shuffled)
    texts = [" ".join(words), changed(.01), changed(.05), changed(.2), " ".join(moved), " ".join(shuffled)]
    df = order_minhash.with_signature(frame(spark, [(i, t, "", "", 0) for i, t in enumerate(texts)]), "text", "sig")
    sig = {r.doc_id: set(r.sig) for r in df.collect()}
    near = [len(sig[0] & sig[i]) / 64 for i in range(6)]
    assert near[0] == 1 and near[1] > .8 and near[1] > near[2] > near[3] and near[5] < .1
    # half of the pairs of k-mers change their order when two halves change places
    assert near[4] < .75


# ---------------------------------------------------------------- conversations
def broken(table):
    out = []
    for conv, turn, role, text in table:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        luck = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if luck == 0:
            continue
        if luck == 1:
            text = ""
        if luck == 2:
            text = regex.sub("[.!?]", "", text)
        if luck == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if luck == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha(r[3])))


LEGAL = regex.compile("(s?(ua)+)?")


def best_edits(turns):
    """Search over all edit lists in order of cost, then letters: turns are (initial, must go, short)."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, initials = heapq.heappop(heap)
        if i == len(turns) and LEGAL.fullmatch(initials):
            return cost, audit
        state = (i, initials[-1:], "s" in initials[:1] and len(initials) == 1)
        if (state, audit) in done:
            continue
        done.add((state, audit))
        steps = [("I", x, 3, 0) for x in "ua"]
        if i < len(turns):
            initial, go, short = turns[i]
            steps.append(("D", "", 4, 1))
            if not go:
                steps += [("K", initial, 3 * short, 1), *(("R", x, 3 + 3 * short, 1) for x in "ua")]
        for letter, x, price, move in steps:
            if LEGAL.fullmatch(initials + x, partial=True) and audit[-3:].count("I") < 3 and (letter == "D" or x):
                heapq.heappush(heap, (cost + price, audit + letter, i + move, initials + x))


def expected_repairs(table):
    out = {}
    for conv in {r[0] for r in table}:
        turns = broken([r for r in table if r[0] == conv])
        seen, codes, counts = set(), [], Counter()
        for _, _, role, text in turns:
            visible = regex.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not visible else "duplicate" if (role, text) in seen
                     else "truncated" if visible[-1] not in ".!?" else None)
            seen.add((role, text))
            counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [r[1] for r in turns if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = best_edits(codes)
        repaired, at, initials = [], 0, ""
        for letter in audit:
            row = None if letter == "I" else turns[at]
            at += letter != "I"
            if letter == "D":
                continue
            role = row[2] if letter == "K" else "assistant" if initials.endswith("u") else "user"
            initials += role[0]
            repaired.append(f"{role}:{row[3] if row else ''}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                     sha("\n".join(repaired)))
    return out


def talks(seed=5, n=120):
    rng = random.Random(seed)
    out = []
    for conv in [*range(n), None]:
        for turn in rng.sample(range(9), rng.randrange(1, 7)):
            out.append((conv, None if rng.random() < .1 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]),
                        rng.choice(["Yes.", "No!", "Well", "", " \n", None, "a. ", "Why?", "é."])))
    return out + out[:9]


def op13_rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("wide", [False, True])
def test_repairs_against_a_search(spark, tmp_path, wide):
    table = talks()
    df = spark.createDataFrame([(*r, 1, "x", "y") if wide else r for r in table],
                               "conv_id long, turn long, role string, text string"
                               + (", kind int, digest string, code string" if wide else ""))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = op13_rows(llm_queries.queries()["op13_turn_repair"](spark, str(tmp_path)))
    assert got == expected_repairs(table)


def test_op13_on_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert op13_rows(llm_queries.queries()["op13_turn_repair"](spark, SMALL)) == expected_repairs(table)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert llm_queries.queries()["op13_turn_repair"](spark, str(tmp_path)).collect() == []


def test_least_weight_against_a_search():
    rng = random.Random(9)
    for _ in range(300):
        turns = [(rng.choice("suax"), rng.random() < .25, rng.random() < .2) for _ in range(rng.randrange(0, 8))]
        codes = bytes("suax".index(i) | (turn_repair.MUST_GO if go else turn_repair.TRUNCATED if short else 0)
                      for i, go, short in turns)
        assert turn_repair.cheapest(codes) == best_edits([(i, go, short and not go) for i, go, short in turns]), turns


def test_a_long_conversation(spark):
    """Some thousand turns: one conversation streams through, and its repair is legal."""
    rng = random.Random(3)
    table = [(1, i, rng.choice(["user", "assistant"]), f"{i}.") for i in range(3000)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    found = turn_repair.diagnose(df)
    row = found.collect()[0]
    repaired = turn_repair.repair(df, found).orderBy("pos").collect()
    assert [r.role for r in repaired] == ["user", "assistant"] * (len(repaired) // 2)
    assert row.cost == 4 * row.audit.count("D") + 3 * row.audit.count("I") + 3 * row.audit.count("R")
    kept = iter([r for r, letter in zip(table, row.audit.replace("I", "")) if letter != "D"])
    assert all(next(kept)[3] == r.text for r in repaired if r.text)
