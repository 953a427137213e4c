"""Small tables with the awkward rows every operator must take, and plain versions to compare with."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns under names that the operators use inside
CLASHING = "k long, row string, h int, node string, shard string, slot int, chunk string, text_key int, gone_id int"

VOCABULARY = ["the", "of", "and", "river", "stone", "Light", "small", "walk", "over", "green", "été", "größe", "année",
              "niño", "house", "Cold", "water", "bird", "found", "never", "again", "under", "seven", "paper", "glass"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ",", "."]) + str(rng.randrange(90)) * (rng.random() < .3)
                    for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    """Nulls, empty and very long texts, exact and near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    near = base[0].split(" ")
    near[30] = "changed"
    passage = prose(rng, 80)
    texts = [*base, base[0], base[0].upper(), " ".join(near), base[1], prose(rng, 40) + " " + passage + " " + prose(rng, 30),
             passage + " " + prose(rng, 50), prose(rng, 20) + "\n" + passage, None, "", "   ", "one two three", "one two three",
             "a", "word" * 3000, prose(rng, 6000), "La " * 900, "été́ Σίσυφος 😀 x y", "<|endoftext|> it's 3.14!!",
             "<|ENDOFTEXT|>", "a <|EndOfText|> b", "x<|STARTOFTEXT|>y"]
    out = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    out.append((2, base[2], None, None, None))          # a repeated row
    out.append((None, base[3], "en", None, 3))          # null id, copy of another text
    out.append((None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(spark):
    wide = [(*r, 1, "x", 2, "y", "z", 3, "c", 4, 5) for r in rows()]
    return spark.createDataFrame(wide, f"{SCHEMA}, {CLASHING}")


def unique_rows() -> list[tuple]:
    """The rows with an id of their own."""
    seen, out = set(), []
    for r in rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def texts_by_id() -> dict:
    return {r[0]: r[1] or "" for r in unique_rows()}
