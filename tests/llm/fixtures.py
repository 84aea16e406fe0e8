"""Small tables with what real ones hold: nulls, empties, ties, copies, very long texts, odd columns."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept boolean, n bigint, key string, size int, sig string, id int, salt int, gone string, trusted int"
PAD = ("x", True, 1, "k", 2, "s", 3, 4, "g", 5)

VOCAB = [f"w{k}" for k in range(400)] + ["the", "of", "and", "in"] * 20
SHARED = "a line of boilerplate that many documents share"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(25)]
    out: list[str | None] = [None, "", " ", "\n\n", "one", "two words", "a b c d", "a b c d e", "A B C D E"]
    out += base + base[:6] + [base[0]] * 12
    for text in base[:15]:
        for edits in (1, 2, 5):
            words = text.split(" ")
            for _ in range(min(edits, len(words))):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            out.append(" ".join(words))
    out += [f"{SHARED}\n{t}\n  {SHARED.upper()}\t\n" for t in base[:9]]
    out += ["la la " * 300, prose(rng, 30_000), "é" * 5000 + " ñ", "same " * 3 + "\nrow\nrow\nrow"]
    return out


def documents(spark, repeat: bool = True):
    rows = [(k, t, ("en", "fr", None)[k % 3], ("s0", "s0", "s1", None)[k % 4], 0, *PAD) for k, t in enumerate(texts())]
    if repeat:
        rows += [rows[12], rows[12], (rows[40][0], "another text of the same id entirely", "en", "s0", 0, *PAD), (None, rows[30][1], "en", "s1", 0, *PAD)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
