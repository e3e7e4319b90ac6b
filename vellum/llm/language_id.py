"""Language identification by nearest centroids of TF-IDF character n-gram vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_schema, freeing, id_text, slices, small_batches

UNKNOWN = "und"
#: Hashed n-gram dimensions; n-grams are of 1, 2 and 3 bytes of the lower-cased UTF-8 text.
DIMS = 4096
#: Labelled rows that a model is fitted on, at most so many of each language and so many bytes of each text's n-gram counts.
FIT_ROWS = 600
CENTROIDS = 4
#: A document is rejected if its cosine with its nearest centroid is below the centroid's own lowest hundredth in fitting, less
#: this.  Short texts have few n-grams and so low cosines anywhere: below so many n-grams the bound falls in proportion.
MARGIN, ENOUGH = 0.25, 600
ROUNDS = 12
#: Texts judged at once: each takes DIMS numbers.
ROWS = 128

PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII that is no letter counts as one space; bytes of other characters stay.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _grams(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of each text and a space, one row for each."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    b = _FOLD[np.frombuffer(b" ".join([*texts, b""]), np.uint8)].astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, lengths)
    total = np.zeros(len(texts) * DIMS, np.int64)
    code = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << 8) | b[n - 1 :]
        mixed = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        whole = row[: len(mixed)] == row[n - 1 :]  # not across two texts
        total += np.bincount((row[: len(mixed)] + mixed)[whole], minlength=len(total))
    return total.reshape(len(texts), DIMS)


def counts(texts: list[str], at_once: int = 1 << 20) -> np.ndarray:
    """Rows of n-gram counts of whole texts, made over about ``at_once`` bytes at a time."""
    out = np.zeros((len(texts), DIMS), np.int64)
    some, size, first = [], 0, 0
    for i, t in enumerate(texts):
        data = t.lower().encode("utf-8", "replace")
        if len(data) > at_once:  # one very long text: in overlapping slices, so that no n-gram is lost; its row below is empty
            out[i] -= _grams([b""])[0]
            for k in range(0, len(data), at_once):
                tail = data[max(0, k - 2) : k]
                out[i] += _grams([data[max(0, k - 2) : k + at_once]])[0] - (_grams([tail])[0] if tail else 0)
            data = b""
        some.append(data)
        size += len(data)
        if size > at_once or len(some) == 256:
            out[first : i + 1] += _grams(some)
            some, size, first = [], 0, i + 1
    if some:
        out[first:] += _grams(some)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # unit rows
    owner: np.ndarray  # a centroid's language
    floor: np.ndarray  # a centroid's least cosine that isn't rejected

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        grams = counts(texts)
        near = vectors(grams, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        score = near[np.arange(len(best)), best]
        return [self.languages[k] for k in self.owner[best]], np.clip(score, 0.0, 1.0), score < self.floor[best] * np.minimum(1.0, grams.sum(axis=1) / ENOUGH)


def vectors(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows, with logarithmic term frequency."""
    x = np.log1p(grams)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    return x


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; no chance is involved."""
    seeds = [int((x @ _unit(x.mean(axis=0, keepdims=True))[0]).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        part = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[part == j].mean(axis=0) if (part == j).any() else c[j] for j in range(len(c))]))
    return c


def fit(labelled: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Centroids from at most about ``rows`` labelled rows of each language.

    The bounded sample takes the rows whose hash of the id lies below a threshold that each language's whole count sets;
    tasks turn the sampled texts into n-gram counts, and only those vectors (DIMS numbers each, compressed) reach the driver,
    which unpacks one language's at a time.
    Rows without text, language or letters are not learned from.  Without any, the model knows no language.
    """
    small_batches(labelled.sparkSession)
    base = labelled.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    base = base.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in labelled.select(F.col(f"`{lang_col}`").alias("lang")).where("lang is not null").groupBy("lang").count().collect()}
    place = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 32))
    share: Column = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, rows / n) * (1 << 32)))).otherwise(share)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            if b.num_rows:
                grams = np.minimum(counts(b.column(1).to_pylist()), 2**31 - 1).astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(g.tobytes(), 1) for g in grams], pa.binary())], schema=arrow_schema("lang string, grams binary"))

    got: dict[str, list[bytes]] = {}
    for r in base.where(place < share).select("lang", "text").mapInArrow(freeing(featurise), "lang string, grams binary").collect():
        got.setdefault(r["lang"], []).append(bytes(r["grams"]))
    languages = tuple(sorted(got))
    if not got:
        return Model((), np.ones(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0))

    def unpacked(lang: str) -> np.ndarray:
        return np.stack([np.frombuffer(zlib.decompress(g), "<i4") for g in sorted(got[lang])])

    seen = sum((unpacked(lang) > 0).sum(axis=0) for lang in languages)
    idf = np.log((1 + sum(map(len, got.values()))) / (1 + seen)) + 1
    cs, owner, floor = [], [], []
    for k, lang in enumerate(languages):
        own = vectors(unpacked(lang), idf)
        c = _cluster(own, centroids)
        part = (own @ c.T).max(axis=1)
        cs.append(c)
        owner += [k] * len(c)
        floor += [max(0.0, float(np.quantile(part, 0.01)) - MARGIN)] * len(c)
    return Model(languages, idf, np.concatenate(cs), np.array(owner), np.array(floor))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row, from its whole text alone.

    ``und`` with score 0 and rejected if the text is null or has no letter, or if the model knows no language.  Else the
    language of the nearest centroid and the cosine with it; ``rejected`` if that is farther than the centroid allows.
    Rows that repeat are judged alike; a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers for each centroid, whatever the input

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, schema = sent.value, arrow_schema(PREDICTED)
        for batch in slices(batches, ROWS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            known = [i for i, t in enumerate(texts) if m.languages and _LETTER.search(t)]
            lang, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known:
                names, near, rejected = m.predict([texts[i] for i in known])
                for i, name in zip(known, names, strict=True):
                    lang[i] = name
                score[known], out[known] = near, rejected
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(freeing(task), PREDICTED)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """The table with every text's language; fitted on rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with all their columns.

    The model is fitted as in ``identified``; a text passes whole through the same judgement, so rows that repeat go or stay together.
    A text that is null, empty or without letters is of no known language and goes; null ids stay; an empty table gives no rows.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, ROWS):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if m.languages and _LETTER.search(t)]
            if known:
                keep[known] = ~m.predict([texts[i] for i in known])[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(freeing(task), docs.schema)
