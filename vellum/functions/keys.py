"""Identities of documents, facts, jobs and audit entries."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .udf import batch_udf


def content_id(body: Column) -> Column:
    return F.sha2(body, 256)


def fact_key(doc_id: Column, kind: Column, page: Column, norm_span: Column) -> Column:
    """SHA-256 of document, type, page and the verifier's normal form of the span."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), kind, page.cast("string"), F.trim(norm_span)), 256)


def audit_hash(prev: Column, ts: Column, event: Column, matter: Column, detail: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (prev, ts, event, matter, detail)]), 256)


def job_key(kind: str, matter: str, params: list) -> str:
    """The key that running jobs are deduplicated by."""
    return f"{kind}:{matter}:{hashlib.sha256(json.dumps(params).encode()).hexdigest()[:12]}"


@batch_udf(T.StringType())
def docs_key(docs: pd.Series) -> pd.Series:
    """16 hex digits that change when a matter's documents (an array of id and checksum) do."""
    def key(rows):
        return hashlib.sha256(json.dumps(sorted([int(r["id"]), r["checksum"]] for r in rows)).encode()).hexdigest()[:16]

    return docs.map(key)
