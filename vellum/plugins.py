"""What models must offer, and deterministic stand-ins for tests.  Each runs in Arrow batches, loaded once per Python worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .functions.udf import small_batches


class Embedder(Protocol):
    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Answerer(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Extractor(Protocol):
    """Raw facts of a text as dicts with fact_type, span, page and further strings.  None is a call that failed, which isn't the same as a
    text without facts, an empty list; an exception counts as None."""

    def extract(self, text: str) -> list[dict] | None: ...


class HashEmbedder:
    """Counts of hashed words, unit length: no model, but like texts are near."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                out[i, zlib.crc32(w.encode()) % self.width] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class QuotingAnswerer:
    """Quotes the sentence of the first chunk that shares most words with the question, or refuses."""

    def answer(self, question: str, context: str) -> str:
        import re

        from .operators.verification import REFUSAL

        words, best = set(re.findall("[a-z0-9]{4,}", question.lower())), (0, "")
        for block in context.split("[chunk: ")[1:]:
            head, _, text = block.partition("]\n")
            tag = re.match(r"(C\d+) \| document: (.+?) \| page: (\d+)", head)
            for s in re.split(r"(?<=[.!?])\s+", text.strip()):
                n = len(words & set(re.findall("[a-z0-9]{4,}", s.lower())))
                if n > best[0] and tag and "]" not in s and '"' not in s:
                    best = (n, f'{s} [document: {tag[2]}, page: {tag[3]}, chunk: {tag[1]}, span: "{s}"]')
        return best[1] or REFUSAL


def embedded(rows: DataFrame, text: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    small_batches(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(embedder.embed(b.tolist())))

    return rows.withColumn(out, embed(text))


def answered(grounded: DataFrame, answerer: Answerer, at_once: int = 4) -> DataFrame:
    """Questions (qid, question, context) with an answer; ``at_once`` bounds the tasks that call the model together."""

    small_batches(grounded.sparkSession)

    @F.pandas_udf("string")
    def ask(question: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([answerer.answer(q, c or "") for q, c in zip(question, context, strict=True)])

    thinking: Column = F.regexp_replace(ask("question", "context"), r"(?is)<think>.*?</think>", "")
    return grounded.repartition(at_once).withColumn("answer_text", F.trim(thinking))


#: What an extractor gives for one call; a null array is a failure.
FACTS = "array<struct<fact_type:string,span:string,page:long,raw:map<string,string>>>"


def extracted(calls: DataFrame, extractor: Extractor, at_once: int = 4) -> DataFrame:
    """Calls (any columns and ``text``) with ``facts``, null where the call failed; ``at_once`` bounds the tasks that call the model together."""

    def one(text: str | None) -> list[dict] | None:
        try:
            found = extractor.extract(text or "")
            if found is None:
                return None
            rows = []
            for f in found:
                page = f.get("page")
                rest = {k: str(v) for k, v in f.items() if k not in ("fact_type", "span", "page") and v is not None}
                rows.append({"fact_type": f.get("fact_type"), "span": f.get("span"), "page": page if isinstance(page, int) else None, "raw": rest})
            return rows
        except Exception:  # a model or its answer that breaks is a failed call, which is tried again; others go on
            return None

    small_batches(calls.sparkSession)

    @F.pandas_udf(FACTS)
    def ask(text: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in text], dtype=object)

    return calls.repartition(at_once).withColumn("facts", ask("text"))
