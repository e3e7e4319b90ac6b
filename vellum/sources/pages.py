"""Logic around page images and layouts: routing, OCR lines, form fields.  The recognisers themselves are plugins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import nonblank, stripped
from ..functions.udf import batch_udf
from .store import cut, thin

# fixed values: characters from which a page has text, image share from which it is a scan, OCR confidence that passes,
# form rules' least length and greatest height, how far above a rule its value stands, and font sizes of values
HAS_TEXT, IMAGE_SHARE, CONFIDENT = 20, 0.5, 50
RULE_LENGTH, RULE_HEIGHT, ABOVE, VALUE_SIZE = 40, 1.5, 20, (8.5, 9.1)
# fixed values: fonts of printed labels, and characters of symbol fonts that are checked and unchecked boxes
LABEL_FONTS = ("arialmt", "arial-italicmt", "liberationsans", "helvetica", "helv")
CHECKED = ("ü", "ý", "þ", "n", "\uf0fc", "\uf0fd", "\uf0fe", "cid:132", "cid:0xfc")
UNCHECKED = ("o", "q", "¨", "\uf0a8", "\uf0a1", "cid:134", "cid:0xa8")
# fixed value: words of a long span that find it if it isn't there as a whole; our choice: points within which words are of one line
PREFIX_WORDS, LINE_HEIGHT = 6, 4


def route(text: Column, image_share: Column) -> Column:
    """Which reader a page's text comes from: its own text, OCR, or both merged."""
    has_text, scan = F.length(stripped(text)) >= HAS_TEXT, image_share >= IMAGE_SHARE
    return F.when(has_text & scan, "mixed").when(~has_text & scan, "tesseract").otherwise("pymupdf")


def image_share(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page that images (array of struct x0, y0, x1, y1) cover, 1 at most."""
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0)))
    return F.when(width * height > 0, F.least(area / (width * height), F.lit(1.0))).otherwise(0.0)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Text and mean confidence of pages from words (page_id, block, par, line, word, text, conf); words of negative confidence don't count."""
    real = words.where((F.col("conf") >= 0) & (nonblank(F.col("text"))))
    lines = real.groupBy("page_id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"), F.sum("conf").alias("conf"), F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("block", "par", "line", "text")))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("page_text"), (F.sum("conf") / F.sum("n")).alias("ocr_confidence"))


def ocr_verdict(text: Column, confidence: Column) -> Column:
    """Why a page's OCR failed, null if it didn't."""
    return F.when(~nonblank(F.coalesce(text, F.lit(""))), "ocr found no text").when(confidence < CONFIDENT, F.concat(F.lit("ocr confidence "), F.round(confidence, 1).cast("string")))


def merged_text(pages: DataFrame) -> DataFrame:
    """Pages (page_id, page_text, ocr_text) whose text got the OCR lines that it doesn't have yet, in order."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    own = pages.select("page_id", F.explode(F.split("page_text", "\n")).alias("l")).select("page_id", norm(F.col("l")).alias("key")).distinct()
    lines = pages.select("page_id", F.posexplode(F.split("ocr_text", "\n")).alias("pos", "l")).withColumn("key", norm(F.col("l"))).where("key <> ''")
    first = lines.groupBy("page_id", "key").agg(F.min(F.struct("pos", "l")).alias("x")).join(own, ["page_id", "key"], "left_anti")
    more = first.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("more"))
    return pages.join(more, "page_id", "left").withColumn("page_text", F.when(F.col("more").isNotNull(), F.concat_ws("\n", F.nullif("page_text", F.lit("")), "more")).otherwise(F.col("page_text"))).drop("more", "ocr_text")


def form_fields(rules: DataFrame, spans: DataFrame) -> DataFrame:
    """Values above the lines of a form: rules and spans (doc_id, page, x0, y0, x1, y1; spans also text, size and, if known, font) of one page,
    joined by where they lie.  With fonts, what is printed in a label's font is no value."""
    flat = rules.where((F.col("x1") - F.col("x0") >= RULE_LENGTH) & (F.col("y1") - F.col("y0") <= RULE_HEIGHT)).select("doc_id", "page", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y0").alias("ry"))
    values = spans.where(entered(F.col("font"), F.col("size")) if "font" in spans.columns else F.col("size").between(*VALUE_SIZE))
    rows = flat.join(values, ["doc_id", "page"]).where(f"y1 <= ry + 2 and y1 > ry - {ABOVE} and x0 < rx1 and x1 > rx0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "page", "rx0", "rx1", "ry").agg(text.alias("value"))


def visual_lines(words: DataFrame) -> DataFrame:
    """Lines of a page from words (doc_id, page, x0, y0, text): those of about one height, from left to right."""
    rows = words.withColumn("y", F.bround(F.col("y0") / 4, 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    lines = rows.groupBy("doc_id", "page", "y").agg(text.alias("raw"))
    return lines.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y")) - 1).drop("y")


@batch_udf("array<int>")
def _places(text: pd.Series, needle: pd.Series) -> pd.Series:
    """Where a needle stands in a text, from 0, without overlaps."""

    def places(t, n):
        out, at = [], t.find(n) if n else -1
        while at >= 0:
            out.append(at)
            at = t.find(n, at + len(n))
        return out

    return pd.Series([places(t or "", n or "") for t, n in zip(text, needle, strict=True)])


def span_rectangles(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, span, place, line, x0, y0, x1, y1): the rectangles of each span on its page, one per hit and visual line.

    ``words``: doc_id, page, pos, text, x0, y0, x1, y1 in reading order; ``spans``: doc_id, page, span.  Case and white space don't count.  A span
    that isn't there as a whole is looked for by its first PREFIX_WORDS words if it has more; without a hit it has no rows.  Words are
    put at their places in the page's text, and hits meet them by those intervals.  Words of pages without a span are left out first.
    """
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    asked = cut(spans.select("doc_id", "page", "span").distinct(), "asked-spans")
    real = words.join(thin(cut(asked.select("doc_id", "page").distinct(), "asked-pages")), ["doc_id", "page"], "left_semi").withColumn("w", flat(F.col("text"))).where("w <> ''")
    before = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = real.withColumn("at", before).withColumn("end", F.col("at") + F.length("w"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    pages = real.groupBy("doc_id", "page").agg(text.alias("page_text"))
    parts = F.split(flat(F.col("span")), " ")
    wanted = asked.join(pages, ["doc_id", "page"]).withColumn("whole", flat(F.col("span")))
    start = F.when(F.size(parts) > PREFIX_WORDS, F.array_join(F.slice(parts, 1, PREFIX_WORDS), " ")).otherwise(F.lit(""))
    used = wanted.withColumn("needle", F.when(F.instr("page_text", F.col("whole")) > 0, F.col("whole")).otherwise(start))
    hits = used.select("doc_id", "page", "span", F.length("needle").alias("n"), F.posexplode(_places("page_text", "needle")).alias("place", "from"))
    met = hits.join(placed, ["doc_id", "page"]).where(F.col("at").between(F.col("from") - F.length("w") + 1, F.col("from") + F.col("n") - 1))
    line = F.bround(F.col("y0") / LINE_HEIGHT, 0).alias("line")
    return met.groupBy("doc_id", "page", "span", "place", line).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def table_gate(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, has_tables): whether some page has a cell, for all documents of ``pages`` (doc_id, page, error); a page with an error has none.

    ``rules``: doc_id, page, x0, y0, x1, y1, the drawn lines and thin boxes.  A cell is what two neighbouring horizontal rules make with two
    vertical ones that cross both; each vertical rule looks at the horizontal ones it meets from top to bottom, so pairs of all rules aren't made.
    """
    good = rules.join(pages.where("error is null").select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    flat = good.where(f"y1 - y0 <= {RULE_HEIGHT} and x1 - x0 > {RULE_HEIGHT}").select("doc_id", "page", F.col("x0").alias("left"), F.col("x1").alias("right"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    up = good.where(f"x1 - x0 <= {RULE_HEIGHT} and y1 - y0 > {RULE_HEIGHT}").select("doc_id", "page", F.col("y0").alias("top"), F.col("y1").alias("bottom"), ((F.col("x0") + F.col("x1")) / 2).alias("x"))
    meets = flat.distinct().join(up.distinct(), ["doc_id", "page"]).where(f"x between left - {RULE_HEIGHT} and right + {RULE_HEIGHT} and y between top - {RULE_HEIGHT} and bottom + {RULE_HEIGHT}")
    above = F.lag("y").over(Window.partitionBy("doc_id", "page", "x", "top", "bottom").orderBy("y"))
    sides = meets.select("doc_id", "page", "x", "y", above.alias("above")).where(f"y - above > {RULE_HEIGHT}").groupBy("doc_id", "page", "above", "y").agg((F.max("x") - F.min("x")).alias("wide"))
    having = sides.where(f"wide > {RULE_HEIGHT}").select("doc_id").distinct().withColumn("has", F.lit(True))
    return pages.select("doc_id").distinct().join(having, "doc_id", "left").select("doc_id", F.coalesce("has", F.lit(False)).alias("has_tables"))


def checkbox(font: Column, char: Column) -> Column:
    """"[√]" or "[ ]" for a symbol font's checkbox, null for any other character."""
    sign = F.trim(F.coalesce(char, F.lit("")))
    return F.when(F.lower(font).contains("wingding"), F.when(sign.isin(*CHECKED), "[√]").when(sign.isin(*UNCHECKED), "[ ]"))


def entered(font: Column, size: Column) -> Column:
    """Whether a span is entered data: of a value's size, and not in a font of printed labels (a subset's prefix before "+" doesn't count)."""
    bare = F.element_at(F.split(F.lower(font), r"\+"), -1)
    label = F.exists(F.array(*[F.lit(x) for x in LABEL_FONTS]), lambda x: bare.contains(x))
    return (size > VALUE_SIZE[0]) & (size < VALUE_SIZE[1]) & ~label
