"""op2, op5, op7 and op8 against plain versions over whole small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import clashing, frame, prose, rows, texts_by_id

from lectern.llm import chain_dedup, chunk_dedup, suffix_dedup, superminhash
from lectern.llm.common import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


# ---------------------------------------------------------------- components
def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(5, 9), (9, 7), (7, 5), (3, 3)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(df.where("a < 0")).count() == 0


def test_components_sign_each_table_of_edges_once(spark, monkeypatch):
    from lectern.llm import common
    signed, staged, signature = [], [], common._signature
    monkeypatch.setattr(common, "_signature", lambda e: signed.append(e) or signature(e))
    real = common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: staged.append(name) or real(df, name))
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == dict.fromkeys(range(41), 0)
    assert len(signed) == 1 + staged.count("star")  # the first edges and those of each round


# ---------------------------------------------------------------- exact copies
def exact_expected():
    groups = defaultdict(list)
    for r in rows():
        groups[(r[1] or "").translate(LOW)].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_exact_groups(spark, wide):
    got = chunk_dedup.exact_groups(clashing(spark) if wide else frame(spark)).collect()
    assert Counter(tuple(r) for r in got) == exact_expected()


def test_chunks_are_the_text(spark):
    df = frame(spark).select("text", chunk_dedup.chunks(chunk_dedup.normalised(chunk_dedup.F.col("text"))).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == (r.text or "").translate(LOW)
        assert all(0 < len(c) <= chunk_dedup.CHUNK_MAX for c in r.c)


def test_chunk_hash_clashes_get_ordinals(spark, monkeypatch):
    # every chunk has one and the same hash: lists differ by their ordinals alone
    monkeypatch.setattr(chunk_dedup.F, "xxhash64", lambda *c: chunk_dedup.F.length(c[0]).cast("long") * 0)
    listed = {}
    for r in chunk_dedup.recipes(frame(spark)).collect():
        listed.setdefault(tuple(r.recipe), set()).add(r.text_sha256)
    assert all(len(v) == 1 for v in listed.values())
    assert len(listed) == len({(r[1] or "").translate(LOW) for r in rows()})


def test_drop_exact_keeps_columns_and_rows(spark):
    df = clashing(spark)
    out = chunk_dedup.drop_exact(df)
    assert out.columns == df.columns
    kept = Counter((i, sha) for (i, keep, n, k, sha), c in exact_expected().items() for _ in range(c) if k or i is None)
    got = Counter((r.doc_id, hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()) for r in out.collect())
    assert got == kept


# ---------------------------------------------------------------- near copies
def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_expected(data):
    sets = [shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, r in enumerate(data):
        known = low.get(find(i))
        low[find(i)] = known if r[0] is None else r[0] if known is None else min(known, r[0])
    return Counter((r[0], len(sets[i]), low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(data))


@pytest.mark.parametrize("wide", [False, True])
def test_near_groups(spark, wide):
    got = superminhash.near_groups(clashing(spark) if wide else frame(spark)).collect()
    assert Counter(tuple(r) for r in got) == near_expected(rows())


def test_near_groups_around_the_threshold(spark, monkeypatch):
    # variants of one text, many of which are just under or over 0.75 to each other; small
    # blocks, so that buckets, hubs and regions are split
    monkeypatch.setattr(superminhash, "BLOCK", 8)
    monkeypatch.setattr(superminhash, "REGION_BLOCK", 8)
    monkeypatch.setattr(superminhash, "HUB_MEMBERS", 4)
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    data = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
        data.append((1000 - i, " ".join(w), None, None, None))
    got = superminhash.near_groups(frame(spark, data)).collect()
    assert Counter(tuple(r) for r in got) == near_expected(data)


def test_superminhash_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    errors = []
    for n, share in ((40, .5), (300, .75), (2000, .9)):
        for _ in range(20):
            x = rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - int(share * n):2 * n - int(share * n)])
            s = superminhash.signatures([a, b])
            assert np.isfinite(s).all() and (s >= 0).all()
            errors.append((s[0] == s[1]).mean() - len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(errors)) < .02 and np.std(errors) < .05


def test_drop_near_looks_at_rows_not_ids(spark):
    a, b = prose(random.Random(1), 120), prose(random.Random(2), 120)
    rows_ = [(1, a), (2, a + " x"), (2, b), (None, a + " y"), (1, a), (3, None), (3, None), (None, "")]
    got = superminhash.drop_near(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (2, b), (3, None), (3, None), (None, "")])


def test_drop_near(spark):
    df = clashing(spark)
    out = superminhash.drop_near(df)
    assert out.columns == df.columns
    gone = {r[0] for r, n in near_expected(rows()).items() if not r[3] and r[0] is not None}
    # of the repeated row 2 one stays; the row without an id that copies another's text goes as well
    left = Counter(r[0] for r in rows() if r[0] not in gone) - Counter([2, None])
    assert Counter(r.doc_id for r in out.collect()) == left


# ---------------------------------------------------------------- repeated strings
def repeats_expected(data):
    n = suffix_dedup.LENGTH
    texts = [(r[1] or "").encode() for r in data]
    count = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = Counter()
    for r, t in zip(data, texts):
        gone = [False] * len(t)
        for i in range(len(t) - n + 1):
            if count[t[i:i + n]] > 1:
                gone[i:i + n] = [True] * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[r[0], len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeated_rows():
    rng = random.Random(5)
    shared = [prose(rng, 45) for _ in range(4)]
    out = list(rows())
    for i in range(30):
        parts = [prose(rng, rng.randrange(3, 40)), rng.choice(shared)[rng.randrange(12):], prose(rng, 15),
                 rng.choice(shared)[:rng.randrange(150, 280)], prose(rng, rng.randrange(1, 30))]
        out.append((200 + i, " ".join(parts), None, None, None))
    return out


@pytest.mark.parametrize("group, segment", [(2000, 1 << 19), (3, 1 << 19), (2000, 1500)])
def test_remove_repeats(spark, monkeypatch, group, segment):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    data = repeated_rows()
    got = suffix_dedup.remove_repeats(frame(spark, data)).collect()
    assert Counter(tuple(r) for r in got) == repeats_expected(data)


@pytest.mark.parametrize("bits", [0, 3])
def test_remove_repeats_survives_collisions_of_the_surroundings_hash(spark, bits):
    data = repeated_rows()
    got = suffix_dedup.remove_repeats(frame(spark, data), hash_bits=bits).collect()
    assert Counter(tuple(r) for r in got) == repeats_expected(data)


def test_remove_repeats_texts_and_columns(spark):
    got = suffix_dedup.remove_repeats(clashing(spark), texts=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == repeats_expected(rows())
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in got)


def test_common_extension_survives_hash_collisions():
    s = suffix_dedup.Suffixes([b"abcdefgh", b"abcxefgh", b"abc", b""])
    assert [s.common(0, 1), s.common(0, 2), s.common(0, 3), s.common(0, 0)] == [3, 3, 0, 8]
    s.grid = memoryview(bytes(4 * 9 * 8)).cast("Q", (4, 9))  # every prefix hash collides
    assert [s.common(0, 1), s.common(0, 2), s.common(0, 3)] == [3, 3, 0]
    strings = [bytes(random.Random(i).choices(b"ab", k=12)) for i in range(60)]
    order, common = suffix_dedup.Suffixes(strings).ordered(list(range(60)))
    assert [strings[i] for i in order] == sorted(strings)


# ---------------------------------------------------------------- fuzzy passages
def test_chains_follow_both_texts():
    line = [(i, i + 100) for i in range(0, 60, 6)]
    noise = [(30, 5), (31, 300), (2, 154)]
    best = chain_dedup.chains(line + noise)[0]
    assert best == line
    far = [(0, 0), (6, 6), (500, 500), (506, 506)]
    assert sorted(map(len, chain_dedup.chains(far))) == [2, 2]  # cut at the gap
    assert all(c == sorted(c) for c in chain_dedup.chains([(i, 0) for i in range(20)]))


def test_edit_columns():
    def plain(a, b):
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                options = [(0, 0)] if not i and not j else []
                if i and j:
                    e, m = best[i - 1, j - 1]
                    options.append((e, m - 1) if a[i - 1] == b[j - 1] else (e + 1, m))
                if i:
                    options.append((best[i - 1, j][0] + 1, best[i - 1, j][1]))
                if j:
                    options.append((best[i, j - 1][0] + 1, best[i, j - 1][1]))
                best[i, j] = min(options)
        return best[len(a), len(b)][0]
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        matches, columns = chain_dedup.edit_columns(a, b)
        assert columns - matches == plain(a, b)


def test_passages_cover_shared_runs(spark):
    data = rows()
    got = chain_dedup.passages(clashing(spark)).collect()
    cover = defaultdict(set)
    for r in got:
        assert r.end_word - r.begin_word >= 50 and .75 <= r.identity <= 1
        cover[r.doc_id].update(range(r.begin_word, r.end_word))
    first = {}
    for i, text in sorted(texts_by_id().items()):
        w = words(text)
        for at in range(len(w) - 50):
            run = tuple(w[at:at + 51])
            if first.setdefault(run, i) != i:
                assert cover[i] >= set(range(at, at + 51)), (i, at)
    copies = {13, 14, 15, 16, 18, 19} - {0}
    assert {12, 13, 14, 15} <= set(cover) and copies & set(cover)
    clean = {r[0] for r in data if r[0] is not None and 1 <= r[0] <= 11 and r[0] not in (3,)}
    assert not clean & {d for d in cover if d is not None}


def test_drop_passages(spark):
    df = clashing(spark)
    out = chain_dedup.drop_passages(df)
    assert out.columns == df.columns and out.count() == df.count()
    before, after = texts_by_id(), {}
    for r in out.collect():
        after.setdefault(r.doc_id, []).append(r)
    for i in range(1, 12):
        if i not in (2, 3):
            assert after[i][0].text == before[i]      # clean documents stay as they are
    assert len(words(after[12][0].text)) == 0          # a copy of an earlier document
    assert len(words(after[17][0].text)) <= 60 and after[17][0].n_chars == len(after[17][0].text)


def test_fuzzy_passage(spark):
    rng = random.Random(12)
    passage = [f"w{rng.randrange(10 ** 6)}" for _ in range(90)]
    changed = [w if i % 11 else "edit" for i, w in enumerate(passage)]
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    data = [(1, " ".join(mk(40) + passage + mk(40)), None, None, None),
            (2, " ".join(mk(70) + changed + mk(10)), None, None, None),
            (3, " ".join(mk(200)), None, None, None)]
    got, = chain_dedup.passages(frame(spark, data)).collect()
    assert (got.doc_id, got.source_id) == (2, 1) and abs(got.begin_word - 70) <= 1 and abs(got.end_word - 160) <= 2
    assert .85 <= got.identity < 1


def test_edit_path_has_the_columns_of_edit_columns():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        path, x, y = chain_dedup.edit_path(a, b), 0, 0
        for c in path:
            if c in (chain_dedup.SAME, chain_dedup.OTHER):
                assert (a[x] == b[y]) == (c == chain_dedup.SAME)
            x, y = x + (c != chain_dedup.ONLY_B), y + (c != chain_dedup.ONLY_A)
        assert (x, y) == (len(a), len(b))
        assert (path.count(chain_dedup.SAME), len(path)) == chain_dedup.edit_columns(a, b)


def test_exact_passages_with_a_weak_stretch_between(spark):
    rng = random.Random(14)
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    one, two = mk(55), mk(55)
    seeds = [(i, i) for i in range(0, 50, 5)] + [(103 + i, 103 + i) for i in range(0, 50, 5)]
    a, b = ([*range(55), *range(n, n + 48), *range(55, 110)] for n in (1000, 2000))
    assert [p[:2] for p in chain_dedup.align(seeds, a, 0, b, 0)] == [(0, 55), (103, 158)]
    data = []
    for i in range(12):
        one, two = mk(55), mk(55)
        for j in range(2):
            data.append((2 * i + j, " ".join(mk(30) + one + mk(48) + two + mk(30)), None, None, None))
    cover = defaultdict(set)
    for r in chain_dedup.passages(frame(spark, data)).collect():
        assert r.identity >= .75 and r.end_word - r.begin_word >= 50
        cover[r.doc_id].update(range(r.begin_word, r.end_word))
    for i in range(12):
        assert cover[2 * i + 1] == {*range(30, 85), *range(133, 188)}


def test_exact_passages_of_frequent_lines(spark):
    # every line, and every half of a passage, occurs in an earlier document that has no more of it
    rng = random.Random(21)
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    lines = [mk(rng.randrange(10, 22)) for _ in range(40)]
    texts = [sum(([*line, *mk(4)] for line in rng.sample(lines, 20)), []) for _ in range(12)]
    shared = [sum(rng.sample(lines, 5), [])[:n] for n in (50, 50, 51, 55, 60, 60, 70, 80)]
    texts += [[*mk(9), *p[at:at + 42], *mk(9)] for p in shared for at in (0, 8, len(p) - 42)]
    texts += [[*mk(rng.randrange(5, 70)), *p, *mk(rng.randrange(5, 70))] for p in shared * 2]
    data = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    cover, first = defaultdict(set), {}
    for r in chain_dedup.passages(frame(spark, data)).collect():
        assert r.end_word - r.begin_word >= 50 and .75 <= r.identity <= 1
        cover[r.doc_id].update(range(r.begin_word, r.end_word))
    found = 0
    for i, w in enumerate(texts):
        for at in range(len(w) - 49):
            if first.setdefault(tuple(w[at:at + 50]), i) != i:
                found += 1
                assert cover[i] >= set(range(at, at + 50)), (i, at)
    assert found > 50


def edited_pairs(rng, cases, trials, kind="replaced"):
    """Pairs of documents that share a passage of n words of which a share is edited, as rows; the
    earlier document of pair i has the id 2 * i. Edits replace words, or else half of them insert
    a word and half delete one."""
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    data = []
    for n, share in cases:
        for _ in range(trials):
            passage = mk(n)
            gone = set(rng.sample(range(1, n - 1), int(n * share)))
            out = sorted(rng.sample(sorted(gone), len(gone) // 2)) if kind != "replaced" else []
            new = lambda: f"x{rng.randrange(10 ** 9)}"
            other = [w for i, v in enumerate(passage) for w in (
                [v] if i not in gone else [new()] if kind == "replaced" else [] if i in out else [new(), v])]
            for p in (passage, other):
                data.append((len(data), " ".join(mk(60) + p + mk(60)), None, None, None))
    return data


def test_recall_of_edited_passages(spark):
    cases = [(n, share) for n in (55, 60, 100) for share in (.1, .15, .2, .24)]
    found = {r.doc_id for r in chain_dedup.passages(frame(spark, edited_pairs(random.Random(31), cases, 40))).collect()}
    for c, case in enumerate(cases):
        assert sum(2 * i + 1 in found for i in range(40 * c, 40 * c + 40)) >= 36, case


def test_recall_of_inserted_and_deleted_words(spark):
    cases = [(n, share) for n in (55, 70, 100) for share in (.1, .2)]
    rows = edited_pairs(random.Random(32), cases, 40, "moved")
    found = {r.doc_id for r in chain_dedup.passages(frame(spark, rows)).collect()}
    got = {case: sum(2 * i + 1 in found for i in range(40 * c, 40 * c + 40)) for c, case in enumerate(cases)}
    assert all(n >= 36 for n in got.values()), got


def test_walk_takes_the_shortest_detour():
    same, other, only_a, only_b = chain_dedup.SAME, chain_dedup.OTHER, chain_dedup.ONLY_A, chain_dedup.ONLY_B
    a = list("abcdefgh")
    assert list(chain_dedup.walk(a, a)) == [same] * 8
    assert list(chain_dedup.walk(a, list("abXdefgh"))) == [same] * 2 + [other] + [same] * 5
    assert list(chain_dedup.walk(a, list("abXcdefgh"))) == [same] * 2 + [only_b] + [same] * 6
    assert list(chain_dedup.walk(a, list("abdefgh"))) == [same] * 2 + [only_a] + [same] * 5
    for _ in range(200):
        rng = random.Random(_)
        b = [rng.choice("abcdefghX") for _ in range(rng.randrange(12))]
        x = y = 0
        for c in chain_dedup.walk(a, b):
            if c in (same, other):
                assert (a[x] == b[y]) == (c == same)
            x, y = x + (c != only_b), y + (c != only_a)
        assert x <= len(a) and y <= len(b) and (x == len(a) or y == len(b))


def test_seeds_are_counted_in_blocks(monkeypatch):
    rng = random.Random(41)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(90))) for _ in range(60)] + ["la " * 500, "", None]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    seeds = Counter(chain_dedup.all_seeds([(t or "").encode() for t in texts])[2].view("int64").tolist())
    for size in (1, 400, 1 << 21):  # of a block of one text, of some, of all
        monkeypatch.setattr(chain_dedup, "PACKED", size)
        packed = [b for i in range(len(texts)) for b in chain_dedup._seed_hashes([batch.slice(i, 1)])] \
            if size == 1 else list(chain_dedup._seed_hashes([batch]))
        table = pa.Table.from_batches(packed).sort_by("block")
        assert sum(map(len, table["hashes"].to_pylist())) <= 16 * len(seeds) * len(packed)
        found = [h for b in chain_dedup._repeated(table.to_batches(50)) for h in b.column("h").to_pylist()]
        assert sorted(found) == sorted(h for h, n in seeds.items() if n > 1)
    assert not list(chain_dedup._seed_hashes([batch.slice(len(texts) - 2)])) and not list(chain_dedup._repeated([]))


def test_chains_with_the_same_words_are_aligned_once(monkeypatch):
    # a line said over and over: each of its chains has the same words around it
    line = np.tile(np.arange(1, 13, dtype=np.uint32), 60)
    source = np.concatenate([np.arange(1000, 1064, dtype=np.uint32), line[:120], np.arange(2000, 2200, dtype=np.uint32)])
    places = [(120 + 12 * i, 64) for i in range(30)] + [(0, 64), (700, 64)]
    seeds = [[v for s in range(0, 20, 4) for v in (x + s, y + s)] for x, y in places]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [7] * 32, "k": [8] * 32, "s_doc": [1] * 32, "seeds": seeds, "f": [0] * 32, "words": [line.tobytes()] * 32,
        "sf": [0] * 32, "s_words": [source.tobytes()] * 32})
    calls, plain = [], chain_dedup.align
    monkeypatch.setattr(chain_dedup, "align", lambda *args: calls.append(1) or plain(*args))
    got = pa.Table.from_batches(chain_dedup._aligned([batch]))
    assert len(calls) == 3 and got.num_rows >= 30  # inside, at the start, at the end
    monkeypatch.setattr(chain_dedup, "KEPT_BYTES", -1)
    assert pa.Table.from_batches(chain_dedup._aligned([batch])).equals(got) and len(calls) == 35
    plainly = [(x0, x1, y0, y1, m) for s in seeds for x0, x1, y0, y1, m, _ in
               plain(list(zip(s[::2], s[1::2])), line.tolist(), 0, source.tolist(), 0)]
    names = ("begin_word", "end_word", "source_begin", "source_end", "matches")
    assert list(zip(*(got[c].to_pylist() for c in names))) == plainly


def test_edited_passages_whose_seeds_were_seen_elsewhere(spark):
    # every two lines of a passage are first seen in a document of their own; no 35 words in a row are the same
    rng = random.Random(51)
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    lines = [mk(11) for _ in range(48)]
    texts = [[*mk(20), *lines[i], *lines[i + 1], *mk(20)] for i in range(47)]
    first = len(texts)
    for i in range(8):
        passage = sum(lines[6 * i:6 * i + 6], [])
        texts.append([*mk(15), *passage, *mk(15)])
        texts.append([*mk(25), *(w if n % 12 != 5 else f"x{rng.randrange(10 ** 9)}" for n, w in enumerate(passage)), *mk(25)])
    data = [(i, " ".join(t), None, None, None) for i, t in enumerate(texts)]
    got = defaultdict(set)
    for r in chain_dedup.passages(frame(spark, data)).collect():
        got[r.doc_id, r.source_id].update(range(r.begin_word, r.end_word))
    assert set(got) == {(first + 2 * i + 1, first + 2 * i) for i in range(8)}
    assert all(len(v) >= 58 for v in got.values())


def test_each_earlier_holder_is_met(spark, monkeypatch):
    # three documents share a passage, whatever the blocks and the number of seeds looked at together
    rng = random.Random(52)
    mk = lambda n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    passage = mk(60)
    texts = [[*mk(9 * i), *passage, *mk(7)] for i in range(6)] + [["la"] * 200, [*mk(3), *["la"] * 90, *mk(3)], ["la", "lo"] * 60]
    ids = [3, 1, None, 8, 5, 5, 20, 21, 22]
    rows = [(i, k, hash(k) % 2, chain_dedup.words(" ".join(t).encode())[2].astype(np.uint32).tobytes(),
             *chain_dedup.all_seeds([" ".join(t).encode()])[1:]) for k, (i, t) in enumerate(zip(ids, texts))]
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(chain_dedup, "MATCHES", size)
        found = [b for i, j in ((0, 0), (0, 1), (1, 1)) for b in chain_dedup._aligned(chain_dedup._chained(
            [r for r in rows if r[2] in (i, j)], i, j))]
        got = {(r["doc_id"], r["source_id"], r["k"]): r for r in pa.Table.from_batches(found).to_pylist()}
        order = [None, 1, 3, 5, 5, 8]
        assert {k[:2] for k in got if k[0] is None or k[0] < 20} == {(b, a) for i, b in enumerate(order) for a in order[:i] if a != b}
        assert (21, 20) in {k[:2] for k in got} and all(r["end_word"] - r["begin_word"] >= 50 for r in got.values())


def test_empty_tables(spark):
    none = frame(spark, [])
    assert chunk_dedup.exact_groups(none).count() == 0 and chunk_dedup.drop_exact(none).count() == 0
    assert superminhash.near_groups(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert chain_dedup.passages(none).count() == 0 and chain_dedup.drop_passages(none).count() == 0
