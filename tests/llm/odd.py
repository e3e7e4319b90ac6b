"""Documents of every odd kind, and copies with null or clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(n // 3)]
    texts = []
    for _ in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = word()
        texts.append(rng.choice([" ", " ", "\n", "  "]).join(w))
    texts += ["", None, " \t\n", "one", "One two", "a b c", "A B C", "a  b\tc", "x" * 5000, "ab " * 4000, "é\xa0ü\x85字😀 \x1c.", "<|endoftext|> it's 'S \x00 end", "Mail a.b@c.de or +1 (555) 123-4567, 10.0.0.1; 4111 1111 1111 1111"]
    out = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[5], out[5], (out[6][0], "another text under the same id", "en", None, 1), (None, out[7][1], None, None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    """More columns, named as operators could name their own."""
    from pyspark.sql import functions as F

    for c in ("id", "norm", "h", "salt", "mark", "tok", "n", "pos", "rep", "place", "a.b", "copied", "url", "key"):
        df = df.withColumn(c, F.lit("x"))
    return df
