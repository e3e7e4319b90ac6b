"""Pages to chunks whose text is exactly ``page_text[char_start:char_end]``."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import nonblank, stripped
from ..functions.udf import batch_udf

# fixed values: window size, how far a window reaches for a line end, table piece size, tail carried to the next page,
# and the greatest pages and characters of one extraction group
WINDOW, REACH, TABLE_PIECE, TAIL = 900, 200, 1400, 160
GROUP_PAGES, GROUP_CHARS = 2, 3000
# fixed values: what counts as a section heading, in order of precedence
HEADINGS = (
    r"#{1,6}\s+(.+?)\s*#*",
    r"(\d{1,2}\.\s+[A-Z][A-Za-z0-9 ,&'/()-]{2,60})",
    r"((?:ARTICLE|SECTION)\s+[\dIVXLC]+[.:]?\s*[A-Za-z0-9 ,&'/()-]{0,60})",
    r"([A-Z][A-Z0-9 ,&'/():-]{5,60})",
)
_HEADING = re.compile(r"^(?:" + "|".join(HEADINGS) + r")\s*$", re.M)
# fixed values: what starts a speaker's turn in a transcript
_TURN = re.compile(r"^(?:(Q|A)\.|(BY\s+(?:MR|MS|MRS|DR)\.\s+[A-Z][A-Z'-]+)\s*:|(THE\s+(?:WITNESS|COURT)|(?:MR|MS|MRS|DR)\.\s+[A-Z][A-Z'-]+)\s*:)", re.M)


def windows(text: str, size: int = WINDOW, reach: int = REACH) -> list[tuple[int, int, str | None]]:
    """(start, end, heading in force or None) of a page's windows; they don't cross headings, and a line end that comes soon after the size ends them."""
    marks = [(m.start(), next(g for g in m.groups() if g).strip()) for m in _HEADING.finditer(text)]
    edges = sorted({0, len(text), *(s for s, _ in marks)})
    titles, out, title = dict(marks), [], None
    for a, z in zip(edges, edges[1:], strict=False):
        title = titles.get(a, title)
        while a < z:
            end = min(a + size, z)
            line = text.find("\n", end, min(z, end + reach)) if end < z else -1
            end = line if line >= 0 else end
            if text[a:end].strip():
                out.append((a, end, title))
            a = end
    return out


@batch_udf("array<struct<char_start:long,char_end:long,heading:string>>")
def _window_rows(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"char_start": a, "char_end": z, "heading": h} for a, z, h in windows(t or "")])


@batch_udf(T.StringType())
def _last_heading(text: pd.Series) -> pd.Series:
    def last(t):
        found = [m for m in _HEADING.finditer(t or "")]
        return next(g for g in found[-1].groups() if g).strip() if found else None

    return text.map(last)


def embedding_text(matter: Column, kind: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("[Matter: "), matter, F.lit(" | Type: "), kind, F.lit(" | Section: "), section, F.lit("]\n"), text)


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of pages (matter, source_filename, document_type, source, page_number, page_text), without a shuffle but for documents of several pages.

    A section lasts over pages until the next heading; blank pages give no chunk.
    """
    doc = Window.partitionBy("matter", "source_filename").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.last(_last_heading("page_text"), ignorenulls=True).over(doc), F.lit(""))
    rows = pages.where(nonblank(F.col("page_text"))).withColumn("carried", carried).withColumn("w", F.explode(_window_rows("page_text")))
    section = F.coalesce("w.heading", "carried")
    text = F.substring("page_text", F.col("w.char_start").cast("int") + 1, (F.col("w.char_end") - F.col("w.char_start")).cast("int"))
    cut = rows.select("source_filename", "matter", "document_type", F.col("source").alias("provenance"), "page_number", section.alias("section"), "w.char_start", "w.char_end", text.alias("text"))
    return cut.withColumn("embedding_text", embedding_text(F.col("matter"), F.col("document_type"), F.col("section"), F.col("text")))


def heading_sections(pages: DataFrame, known_headers: DataFrame | None = None) -> DataFrame:
    """Chunks split only at markdown headings, each with its breadcrumb (`` › `` between levels, kept over pages) and,
    given layout headers (source_filename, header, and a matter if equal names of other matters are other files), whether one of them contains the heading or lies in it."""
    out = "matter string, source_filename string, page_number long, section string, heading string, char_start long, char_end long, text string"

    def doc(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        rows = []
        for p in pdf.sort_values("page_number").itertuples():
            text = p.page_text or ""
            marks = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"^(#{1,6})\s+(.+?)\s*#*\s*$", text, re.M)]
            edges = [0, *[m[0] for m in marks if m[0]], len(text)]
            at = {m[0]: m for m in marks}
            for a, z in zip(edges, edges[1:], strict=False):
                if a in at:
                    _, level, title = at[a]
                    stack = [s for s in stack if s[0] < level] + [(level, title)]
                if text[a:z].strip():
                    rows.append((p.matter, p.source_filename, p.page_number, " › ".join(t for _, t in stack), stack[-1][1] if stack else "", a, z, text[a:z]))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    from ..functions.text import heading_norm

    got = pages.groupBy("matter", "source_filename").applyInPandas(doc, out)
    if known_headers is None:
        return got.withColumn("section_detected", F.lit(False))
    of = [c for c in ("matter", "source_filename") if c in known_headers.columns]
    headers = known_headers.groupBy(*of).agg(F.collect_set(heading_norm(F.col("header"))).alias("headers"))
    mine = heading_norm(F.col("heading"))
    seen = F.exists(F.coalesce("headers", F.array().cast("array<string>")), lambda h: (mine != "") & (h.contains(mine) | mine.contains(h)))
    return got.join(headers, of, "left").withColumn("section_detected", seen).drop("headers")


@batch_udf("array<string>")
def speakers(text: pd.Series) -> pd.Series:
    """Speaker labels of a transcript page in order of first appearance."""
    return text.map(lambda t: list(dict.fromkeys((m[1] or (m[2] or m[3]).title()) for m in _TURN.finditer(t or ""))))


def transcript_chunks(pages: DataFrame) -> DataFrame:
    """One chunk per non-blank page of a transcript (matter, source_filename, page_number, page_text, numbered); who speaks and the end of the page before go into the embedding text only."""
    rows = pages.where(nonblank(F.col("page_text")))
    before = F.lag(F.regexp_replace(F.expr(f"right(page_text, {TAIL})"), "\n", " ")).over(Window.partitionBy("matter", "source_filename").orderBy("page_number"))
    who = F.when(F.col("numbered"), speakers("page_text")).otherwise(F.array().cast("array<string>"))
    note = F.when(F.size(who) > 0, F.concat(F.lit(" | Speakers: "), F.array_join(who, ", "))).otherwise("")
    lead = F.when(F.length("before") > 0, F.concat(F.lit("(previous page ends: …"), "before", F.lit(")\n"))).otherwise("")
    return rows.withColumn("before", before).select(
        "source_filename", "matter", F.lit("transcript").alias("document_type"), F.lit("transcript").alias("provenance"), "page_number", F.lit("").alias("section"),
        F.lit(0).cast("long").alias("char_start"), F.length("page_text").cast("long").alias("char_end"), F.col("page_text").alias("text"),
        F.concat(F.lit("[Matter: "), "matter", F.lit(" | Type: transcript"), note, F.lit(" | Page: "), F.col("page_number").cast("string"), F.lit("]\n"), lead, "page_text").alias("embedding_text"),
    )


@batch_udf("array<string>")
def table_pieces(markdown: pd.Series) -> pd.Series:
    """A markdown table in pieces of at most TABLE_PIECE characters that repeat its first two lines; one row is never cut."""

    def cut(t):
        t = (t or "").strip()
        lines = t.splitlines()
        if len(t) <= TABLE_PIECE or len(lines) < 3:
            return [t]
        head, out, size = lines[:2], [], 0
        for row in lines[2:]:
            if not out or size + 1 + len(row) > TABLE_PIECE:
                out.append([*head])
                size = len("\n".join(head))
            out[-1].append(row)
            size += 1 + len(row)
        return ["\n".join(x) for x in out]

    return markdown.map(cut)


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of tables (matter, source_filename, page_number, markdown); offsets are their own."""
    rows = tables.withColumn("text", F.explode(table_pieces("markdown")))
    section = F.concat(F.lit("[TABLE] page "), F.col("page_number").cast("string"))
    return rows.select("source_filename", "matter", F.lit("table").alias("document_type"), F.lit("table").alias("provenance"), "page_number", section.alias("section"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"), "text").withColumn("embedding_text", embedding_text(F.col("matter"), F.col("document_type"), F.col("section"), F.col("text")))


def rebuild_pages(chunks: DataFrame) -> DataFrame:
    """Page texts from chunks that are no tables: each stands at its offsets over spaces.  A group is one page."""
    parts = F.array_sort(F.collect_list(F.struct("char_start", "char_end", "text")))
    pages = chunks.where("document_type <> 'table'").groupBy("matter", "source_filename", "page_number").agg(parts.alias("parts"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        skip = F.greatest(acc["at"] - x["char_start"], F.lit(0).cast("long")).cast("int")
        gap = F.repeat(F.lit(" "), F.greatest(x["char_start"] - acc["at"], F.lit(0).cast("long")).cast("int"))
        return F.struct(F.greatest(acc["at"], x["char_end"]).alias("at"), F.concat(acc["out"], F.array(gap, F.substring(x["text"], skip + 1, F.length(x["text"])))).alias("out"))

    return pages.withColumn("page_text", F.aggregate("parts", first, put, lambda a: F.array_join(a["out"], ""))).drop("parts")


def extraction_groups(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, page_text) with the group that each is extracted in: at most GROUP_PAGES and GROUP_CHARS, but for a page longer than that."""
    doc = F.array_sort(F.collect_list(F.struct("page_number", F.length("page_text").alias("n"), "page_text")))
    first = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("pages"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        fits = (acc["g"] >= 0) & (acc["pages"] < GROUP_PAGES) & (acc["chars"] + x["n"] <= GROUP_CHARS)
        g = F.when(fits, acc["g"]).otherwise(acc["g"] + 1)
        return F.struct(g.alias("g"), F.when(fits, acc["pages"] + 1).otherwise(1).alias("pages"), F.when(fits, acc["chars"] + x["n"]).otherwise(x["n"]).alias("chars"), F.concat(acc["out"], F.array(g)).alias("out"))

    docs = pages.groupBy("doc_id").agg(doc.alias("p"))
    groups = F.aggregate(F.transform("p", lambda x: F.struct(x["page_number"].alias("page_number"), x["n"].alias("n"))), first, add, lambda a: a["out"])
    return docs.select("doc_id", F.explode(F.arrays_zip("p", groups.alias("g"))).alias("x")).select("doc_id", "x.p.page_number", "x.p.page_text", F.col("x.g").alias("group_no"))


def sentence_window(text: Column, hit: Column, radius: int = 1) -> Column:
    """The sentences around the first one that holds ``hit``; the whole text if none does."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    at = F.array_position(F.transform(sentences, lambda s: s.contains(hit)), True)
    start = F.greatest(at - radius, F.lit(1).cast("long"))
    return F.when(at > 0, F.array_join(F.slice(sentences, start.cast("int"), (at + radius - start + 1).cast("int")), " ")).otherwise(text)


def page_batches(pages: DataFrame, size: int = 10) -> DataFrame:
    """Pages with the number of their batch within their document."""
    return pages.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("matter", "source_filename").orderBy("page_number")) - 1) / size))


def scanned_documents(pages: DataFrame, least: int = 20) -> DataFrame:
    """(matter, source_filename, scanned): whether no page has ``least`` characters besides white space at its ends."""
    return pages.groupBy("matter", "source_filename").agg(F.every(F.length(stripped(F.coalesce("page_text", F.lit("")))) < least).alias("scanned"))
