"""Scoped retrieval: dense, BM25 and fused ranking, and exhaustive search.

A scope is a filter below every ranking, never after one, and statistics of BM25 are those of the scope: another tenant's
text can't change a rank.  Many questions are answered in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import search_norm
from ..sources.store import cut, thin
from .dense import dense_topk

# fixed values: RRF's constant, candidates of an arm, snippet lengths, limits of a result page
RRF_K, CANDIDATES, SNIPPET, BEFORE, MOST_ROWS = 60, 20, 240, 80, 100
# our choice of BM25's parameters
K1, B = 1.2, 0.75
TERM = "[a-z0-9]+"
#: One chunk's identity.  The matter belongs to it: file names can repeat across matters.
CHUNK_KEY = ("matter", "source_filename", "page_number", "char_start", "char_end")
# fixed values: terms that are looked up exactly, in order of precedence
ANCHORS = r'"[^"]{3,80}"|\$[\d,]+(?:\.\d{2})?|\b[A-Z]{2,6}-[\d-]{2,}\b|\b\d[\d,./:-]{2,}\b|§\s*[\d.]+|(?:[A-Z][a-z]+[.-]?\s+){1,3}[A-Z][a-z]+'


class UnknownScope(ValueError):
    """A matter, or a file in it, that the table doesn't have."""


def scoped(chunks: DataFrame, matter: str | None, filename: str | None = None) -> DataFrame:
    """The chunks of a matter, or of one file in it.  None searches all; what isn't there raises, so it can't pass for an empty result."""
    if matter is None:
        if filename is not None:
            raise UnknownScope("a file is looked up in a matter")
        return chunks
    mine = chunks.where(F.col("matter") == matter)
    if filename is not None:
        mine = mine.where(F.col("source_filename") == filename)
    if mine.select("matter").isEmpty():
        raise UnknownScope(f"nothing of {matter!r}" + (f" / {filename!r}" if filename is not None else ""))
    return mine


def _best(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col("rank") < k)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits; a null text has none, so it counts as one of no length."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def postings(chunks: DataFrame, key: list[str], scope: str = "matter", asked: DataFrame | None = None) -> DataFrame:
    """(scope, key, term, tf, len): the inverted index, or its part for the ``asked`` (scope, term); write it partitioned by scope to reuse it."""
    words = chunks.select(scope, *key, terms(F.col("text")).alias("t"))
    words = words.select(scope, *key, F.size("t").alias("len"), F.explode("t").alias("term"))
    words = words if asked is None else words.join(asked, [scope, "term"], "left_semi")
    return words.groupBy(scope, *key, "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(questions: DataFrame, chunks: DataFrame, key: list[str], scope: str = "matter", question_key: str = "qid") -> DataFrame:
    """(question, scope, key, score) of all chunks that share a term with a question (qid, scope, query), by statistics of the scope."""
    n_terms = F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM))
    stats = chunks.select(scope, n_terms.alias("len")).groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    asked = cut(questions.select(question_key, scope, F.explode(F.array_distinct(terms(F.col("query")))).alias("term")), "asked")
    # what isn't asked for goes before anything is counted or shuffled
    posted = postings(chunks, key, scope, thin(cut(asked.select(scope, "term").distinct(), "asked-terms")))
    df = posted.groupBy(scope, "term").agg(F.count(F.lit(1)).alias("df")).join(stats, scope)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    hits = posted.join(thin(asked), [scope, "term"]).join(df, [scope, "term"])
    return hits.groupBy(question_key, scope, *key).agg(F.sum(gain).alias("score"))


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int, key: list[str], scope: str = "matter", question_key: str = "qid", digits: int = 9) -> DataFrame:
    """The k best chunks by BM25; scores are rounded before they are ranked, so sums in another order rank alike."""
    scored = bm25(questions, chunks, key, scope, question_key).withColumn("score", F.round("score", digits))
    return _best(scored, k, [question_key], F.col("score").desc(), *[F.col(c) for c in key])


def rrf(arms: list[DataFrame], k: int, key: list[str], question_key: str = "qid") -> DataFrame:
    """Ranked arms (question, key, rank from 0) fused by the sum of 1 / (60 + rank); of ties what the first arm, then the smaller rank saw first."""
    rows = None
    for i, arm in enumerate(arms):
        one = arm.select(question_key, *key, "rank", F.lit(i).alias("arm"))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy(question_key, *key).agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    fused = fused.withColumn("score", F.round("score", 12))
    return _best(fused, k, [question_key], F.col("score").desc(), F.col("seen.arm"), F.col("seen.rank")).drop("seen")


def hybrid(questions: DataFrame, chunks: DataFrame, k: int, key: list[str], scope: str = "matter", candidates: int = CANDIDATES) -> DataFrame:
    """Dense and BM25 candidates fused; ``query`` can differ from what was embedded."""
    near = dense_topk(questions.select("qid", scope, "vector"), chunks.select(scope, *key, "vector"), candidates, key, scope)
    lexical = bm25_topk(questions.select("qid", scope, "query"), chunks.select(scope, *key, "text"), candidates, key, scope)
    return rrf([near, lexical], k, key)


def rerank(candidates: DataFrame, score: Column, k: int, question_key: str = "qid") -> DataFrame:
    """Candidates by a model's score, the order before among equals."""
    return _best(candidates.withColumn("rerank_score", score).withColumnRenamed("rank", "rank_before"), k, [question_key], F.col("rerank_score").desc(), F.col("rank_before"))


def anchors(question: Column) -> Column:
    """Terms of a question that are looked up exactly, in order, each once."""
    found = F.transform(F.regexp_extract_all(question, F.lit(ANCHORS), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def second_pass_questions(answered: DataFrame) -> DataFrame:
    """Questions to ask again, wider: those refused (``refused``), with anchors as the lexical query, else the question itself."""
    words = anchors(F.col("question"))
    return answered.where("refused").withColumn("query", F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.col("question")))


def every_mention(chunks: DataFrame, query: str, document_type: str | None = None, norm=search_norm) -> DataFrame:
    """All chunks whose normal form holds the query's, with the place there (from 1)."""
    rows = chunks if document_type is None else chunks.where(F.col("document_type") == document_type)
    needle = F.trim(norm(F.lit(query)))
    return rows.withColumn("_norm", norm(F.col("text"))).withColumn("pos", F.instr("_norm", needle)).where((F.col("pos") > 0) & (F.length(needle) > 0)).drop("_norm")


def mention_page(chunks: DataFrame, query: str, offset: int = 0, limit: int = 20, document_type: str | None = None, norm=search_norm) -> DataFrame:
    """One result page by file, page and place, with the whole count and whether more follow."""
    limit = max(1, min(limit, MOST_ROWS))
    found = every_mention(chunks, query, document_type, norm)
    total = found.groupBy().agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy("source_filename", "page_number", "char_start").offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def lexical_page(chunks: DataFrame, matter: str, query: str, offset: int = 0, limit: int = 20, document_type: str | None = None, key: tuple[str, ...] = CHUNK_KEY) -> DataFrame:
    """One page of a matter's BM25 ranking.  No exact total is known: ``total`` is null, and ``truncated`` says that the page is full.

    The type is a filter below the ranking, so a page isn't short because of it.
    """
    limit = max(1, min(limit, MOST_ROWS))
    mine = scoped(chunks, matter)
    if document_type is not None:
        mine = mine.where(F.col("document_type") == document_type)
    asked = chunks.sparkSession.createDataFrame([(0, matter, query)], "qid int, matter string, query string")
    names = [k for k in key if k != "matter"]
    rows = bm25(asked, mine.select("matter", *names, "text"), names).withColumn("score", F.round("score", 9))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), *names)) - 1)
    page = ranked.where(F.col("rank").between(offset, offset + limit - 1)).drop("qid")
    return page.withColumn("total", F.lit(None).cast("long")).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy("matter")) == limit)


def snippet(text: Column, start: Column) -> Column:
    """SNIPPET characters from a little before ``start`` (from 0, in ``text`` itself)."""
    return F.substring(text, F.greatest(start - BEFORE, F.lit(0)).cast("int") + 1, F.lit(SNIPPET))


def grounding(ranked: DataFrame, question_key: str = "qid") -> DataFrame:
    """Each question's chunks labelled C1, C2, ... by rank, and the context that a model is shown."""
    label = F.concat(F.lit("C"), (F.col("rank") + 1).cast("string"))
    shown = F.concat(F.lit("[chunk: "), label, F.lit(" | document: "), "source_filename", F.lit(" | page: "), F.col("page_number").cast("string"), F.lit(" | section: "), F.coalesce("section", F.lit("")), F.lit("]\n"), "text")
    rows = F.array_sort(F.collect_list(F.struct("rank", label.alias("chunk_id"), "source_filename", "page_number", "char_start", "char_end", "text", shown.alias("shown"))))
    return ranked.groupBy(question_key).agg(rows.alias("grounding")).withColumn("context", F.array_join(F.transform("grounding", lambda x: x["shown"]), "\n\n"))


def with_doc_ids(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows with the id of their document, null if it has none."""
    ids = documents.select(F.col("id").alias("doc_id"), F.col("filename").alias("source_filename"), F.col("matter_slug").alias("matter"))
    return rows.join(ids, ["source_filename", "matter"], "left")
