"""op3, op4, op10 and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import clashing, frame, rows
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from lectern.llm import multi_index, shards, toxicity


# ---------------------------------------------------------------- vectors
def vectors(n=400, dim=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, 160, 8):       # groups around a vector, near and far
        for j in range(1, 8):
            x[i + j] = x[i] + rng.normal(size=dim) * (.02 * j)
    x[200:230] = x[200]              # copies
    x[231] = x[200] * 7
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] + [1.0] * (dim - 1)),
             (1004, [None] + [1.0] * (dim - 1)), (1005, [float("inf")] * dim), (None, rows[3][1]), (7, rows[50][1]),
             (1006, rows[9][1][:10]), (1007, rows[9][1][:10] + [0.0] * (dim - 10))]
    return rows, dim


def links_expected(rows, dim):
    fit, units = [], []
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(list(v) + [0.0] * (dim - len(v)))
            fit.append(i)
            units.append(u / np.linalg.norm(u))
    s = np.array(units) @ np.array(units).T >= .95
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a, i in enumerate(fit):
            low = min(comp[fit[b]] for b in np.nonzero(s[a])[0])
            if low < comp[i]:
                comp[i], changed = low, True
    low = {}
    for i, (d, _) in enumerate(rows):
        known = low.get(comp[i])
        low[comp[i]] = known if d is None else d if known is None else min(d, known)
    n = {i: int(s[a].sum()) - 1 for a, i in enumerate(fit)}
    return Counter((d, n.get(i, 0), low[comp[i]], d == low[comp[i]]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block, per_cell", [(2048, 48), (16, 20)])
def test_links_against_brute_force(spark, monkeypatch, block, per_cell):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "PER_CELL", per_cell)
    data, dim = vectors()
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in data],
                               "vec_id long, embedding array<float>, label int, cls int, cell string").repartition(5)
    got = Counter(tuple(r) for r in multi_index.link_vectors(df).collect())
    exp = links_expected(data, dim)
    assert sum(x[1] * c for x, c in got.items()) >= .9 * sum(x[1] * c for x, c in exp.items())  # the stated recall
    assert got == exp                                                                          # here it finds all


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    got = Counter(tuple(r) for r in multi_index.link_vectors(df).collect())
    exp = links_expected(data, 64)
    assert sum(x[1] * c for x, c in got.items()) >= .9 * sum(x[1] * c for x, c in exp.items())
    assert len(data) == sum(got.values())


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(3)
    index = multi_index.MultiIndex(rng.normal(size=(500, 16)), 4000, .95, .99)
    u = multi_index.units(rng.normal(size=(40, 16)))
    (a, m1), (b, m2) = index._halves(u)
    for i, (home, cells) in enumerate(index.cells(u)):
        sums = [m1[i][c // index.k] + m2[i][c % index.k] for c in cells]
        assert sums == sorted(sums) and home in cells and len(set(cells)) == len(cells)
        assert len(cells) == int((m1[i][:, None] + m2[i][None] <= index.depth).sum())
        assert index.visits(np.repeat(u[i:i + 1], len(cells), 0), np.array(cells)).all()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert multi_index.link_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in multi_index.link_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


# ---------------------------------------------------------------- shards
def shards_expected(data, n):
    data = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    sizes = [len((r[1] or "").encode()) + 16 for r in data]
    out, at, slots = Counter(), 0, Counter()
    for r, size in zip(data, sizes):
        shard = min(n - 1, (2 * at + size) * n // (2 * sum(sizes)))
        out[r[0], size, zlib.crc32((r[1] or "").encode()), shard, slots[shard]] += 1
        slots[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("n", [1, 7, 40])
def test_shards(spark, n):
    got = shards.shard_by_bytes(clashing(spark), n).collect()
    assert Counter(tuple(r) for r in got) == shards_expected(rows(), n)
    assert shards.shard_by_bytes(frame(spark, []), n).count() == 0


def test_shards_are_even_on_the_table(spark):
    df = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    got = shards.shard_by_bytes(df, 40).collect()
    size, largest = Counter(), max(r.size for r in got)
    for r in got:
        size[r.shard] += r.size
    mean = sum(size.values()) / 40
    assert all(abs(s - mean) <= largest for s in size.values()) and len(size) == 40
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in got)


def test_written_shards(spark, tmp_path):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    placed = shards.shard_by_bytes(df, 5)
    shards.write_shards(df, placed, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.shard) for r in back.collect()) == \
        Counter((r.doc_id, r.text, r.shard) for r in df.join(placed, "doc_id").collect())


# ---------------------------------------------------------------- toxicity
def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    texts = [b"one two three bad four", b"five six", b"seven bad eight nine ten", b"eleven"]
    place, bounds, feats, cuts = toxicity.read_words(texts)
    ids, doc = toxicity.windows(place, bounds, toxicity.WINDOW)
    y, on = np.array([1., 0, 1, 0]), np.ones(len(feats), np.float32)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh().items()}

    def loss(q):
        x, _ = toxicity.word_inputs(q, feats, cuts)
        z = toxicity.window_logits(q, ids, x)
        return float((np.logaddexp(0, z) - y * z).mean())
    g = toxicity.gradients(p, ids, doc, y, feats, cuts, on)
    for name in ("Wf", "Ub", "cf", "att", "out", "bias", "Uf", "Wb"):
        flat = p[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            up = loss(p)
            flat[i] = kept - step
            down = loss(p)
            flat[i] = kept
            assert abs((up - down) / (2 * step) - np.asarray(g[name]).reshape(-1)[i]) < 2e-3, (name, i)
    used, d = g["emb"]
    r = int(used[3])
    for c in range(3):
        kept = p["emb"][r, c]
        p["emb"][r, c] = kept + 1e-3
        up = loss(p)
        p["emb"][r, c] = kept - 1e-3
        down = loss(p)
        p["emb"][r, c] = kept
        assert abs((up - down) / 2e-3 - d[3][c]) < 2e-3


def test_windows_cover_whole_texts():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        place = np.arange(n)
        ids, doc = toxicity.windows(place, np.array([0, n]), toxicity.STRIDE)
        assert set(ids[ids >= 0].tolist()) == set(range(n)) and len(ids) == len(doc)
        assert all(ids[i, 0] == i * toxicity.STRIDE for i in range(len(ids)))


def test_long_runs_are_read_whole():
    p = toxicity.fresh()
    for run in ("字" * 300, "z" * 900, "é1" * 400):
        for at in (5, 100, len(run) - 1):
            a, b = toxicity.score_texts(p, [run.encode(), (run[:at] + "q" + run[at + 1:]).encode()])
            assert a != b, (run[:2], at)
    # pieces are words in order: they cover the run, end between characters and are what they are alone
    data = ("ab " + "字" * 50 + " " + "x" * 81 + " cd").encode()
    place, bounds, _, _ = toxicity.read_words([data])
    parts = [b"ab", *["字".encode() * 13] * 3, "字".encode() * 11, b"x" * 40, b"x" * 40, b"x", b"cd"]
    alone, _, _, _ = toxicity.read_words([b" ".join(parts)])
    assert place.tolist() == alone.tolist() and bounds.tolist() == [0, len(parts)]
    ids, _ = toxicity.windows(*toxicity.read_words(["字".encode() * 13 * 200])[:2], toxicity.STRIDE)
    assert len(ids) == 1 + -(-(200 - toxicity.WINDOW) // toxicity.STRIDE)
    assert toxicity.read_words([b"\x80" * 500])[1].tolist()[1] >= 500 // toxicity.LONGEST


def toxic_table(spark, n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice("sun moon tree leaf road hill lake wind cloud sand".split()) for _ in range(rng.randrange(5, 400))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), "vile" + rng.choice(["n", "st", "ly", "er", ""]))
        docs.append((i, " ".join(w), "en", "s", None))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (5, 1, None), (10 ** 9, 0, 1)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WINDOWS", 20_000)
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held for r in got) and len(held) > 60
    assert sum(r.toxicity_flag == int(r.doc_id % 4 == 0) for r in held) >= .97 * len(held)
    assert all(0 <= r.toxicity_score <= 1 and r.toxicity_flag == int(r.toxicity_score >= .3) for r in got)
    # awkward rows: whole texts of any kind have a score; the same text has the same one
    odd = toxicity.score_documents(clashing(spark), model)
    assert odd.columns == [*clashing(spark).columns, "toxicity_score", "toxicity_flag"] and odd.count() == len(rows())
    by_text = {}
    for r in odd.collect():
        assert 0 <= r.toxicity_score <= 1
        by_text.setdefault(r.text or "", set()).add(round(r.toxicity_score, 5))
        if not (r.text or "").strip():
            assert r.toxicity_flag == 0
    assert all(len(v) == 1 for v in by_text.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.toxicity_flag == 0 for r in got)
    assert toxicity.score_documents(frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = toxic_table(spark, 12)
    assert toxicity.fit(docs, labels.where("false")) is None
    assert {r.toxicity_score for r in toxicity.score_documents(docs, None).collect()} == {0.0}


# ---------------------------------------------------------------- pipeline
def test_pipeline_against_plain_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WINDOWS", 5_000)  # both runs train alike: the seed is fixed
    import corpus_pipeline
    from test_llm_dedup import LOW, near_expected, words

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}
    # copies: the largest id of each text; near copies: the smallest id of each component
    last = {}
    for i, t in kept["toxicity"].items():
        last[t.translate(LOW)] = max(i, last.get(t.translate(LOW), -1))
    assert set(kept["exact_dedup"]) == set(last.values())
    near = near_expected([(i, t) for i, t in kept["exact_dedup"].items()])
    assert set(kept["near_dedup"]) == {r[0] for r in near if r[3]}
    # passages: no run of 51 words is left in two documents where one of them was not cut there
    assert set(kept["substring_dedup"]) == set(kept["near_dedup"])
    seen = {}
    for i, t in sorted(kept["substring_dedup"].items()):
        w = words(t)
        for at in range(len(w) - 50):
            assert seen.setdefault(tuple(w[at:at + 51]), i) == i
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(kept["substring_dedup"])
    size = Counter()
    for r in pieces:
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048 and sorted(size) == list(range(len(size)))
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF_SMALL).select("doc_id", "start", "length", "ids_crc32").collect())
    assert got == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def pipeline_tables(spark, folder, data, labels):
    data.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline
    from test_llm_dedup import LOW, near_expected
    from tokenizers import Tokenizer

    from lectern.llm.encode import tokenizer_path

    sf_dir = pipeline_tables(spark, tmp_path, clashing(spark), [(0, 1, 0), (None, 0, 1), (1, None, None)])
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert Counter(kept["toxicity"]) == Counter((r[0], r[1] or "") for r in rows())  # one class only: none is toxic
    best = {}
    for i, t in kept["toxicity"]:
        low = t.translate(LOW)
        best[low] = max(best.get(low, -1), -1 if i is None else i)
    assert Counter(kept["exact_dedup"]) == Counter(
        (i, t) for i, t in kept["toxicity"] if i is None or best[t.translate(LOW)] == i)
    expected = near_expected(list(enumerate(t for _, t in kept["exact_dedup"])))
    assert len(kept["near_dedup"]) == sum(r[3] for r in expected)
    assert Counter(i for i, _ in kept["substring_dedup"]) == Counter(i for i, _ in kept["near_dedup"])
    tok = Tokenizer.from_file(tokenizer_path())
    sizes = Counter((i, len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t in kept["substring_dedup"])
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == sizes
    assert sum(r.length for r in pieces) == sum(n * c for (_, n), c in sizes.items())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    sf_dir = pipeline_tables(spark, tmp_path, clashing(spark).where("false"), [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0


def test_toxicity_fit_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_WINDOWS", 500)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append(list(zip(texts, labels))) or {})
    docs = spark.createDataFrame([(i, "x" * (10 if i % 5 else 100)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 50)
    toxicity.fit(docs, labels)
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 and i % 5 > 0 for i in range(40))
    assert len(seen[0]) == learned and {len(t) for t, _ in seen[0]} == {10}
    monkeypatch.setattr(toxicity, "FIT_BYTES", 35)
    toxicity.fit(docs, labels)
    assert Counter(y for _, y in seen[1]) == {0: 3, 1: 3} and set(seen[1]) <= set(seen[0])


def test_distances_of_codewords():
    words = np.random.default_rng(1).normal(size=(9, 5))
    plain = np.sqrt(((words[:, None] - words[None]) ** 2).sum(-1))
    assert np.allclose(multi_index.distances(words), plain, atol=1e-7)


def test_toxicity_fit_gives_its_memory_back(spark, monkeypatch):
    """The driver runs the stages that follow; what the fit freed goes back to the system after it."""
    done = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: done.append(len(texts)) or {"m": 1})
    monkeypatch.setattr(toxicity, "freed", lambda: done.append("freed"), raising=False)
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels) == {"m": 1}
    assert len(done) == 2 and done[1] == "freed"
