import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellum.operators import chunking as C


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab \n"), max_size=300), st.integers(5, 40))
def test_windows_tile_the_page_but_for_blank_ones(text, size):
    got, at = C.windows(text, size, 8), 0
    for a, z, _ in got:
        assert a >= at and not text[at:a].strip() and text[a:z].strip()
        at = z
    assert not text[at:].strip()


@pytest.mark.parametrize("n,ends", [(899, [899]), (900, [900]), (901, [900, 901]), (1100, [900, 1100])])
def test_window_sizes(n, ends):
    assert [z for _, z, _ in C.windows("x" * n)] == ends


@pytest.mark.parametrize("line,first", [(900, 900), (1099, 1099), (1100, 900)])
def test_a_line_end_that_comes_soon_ends_the_window(line, first):
    text = "x" * line + "\n" + "y" * 500
    assert C.windows(text)[0][1] == first


def test_sections_last_over_pages(spark):
    rows = [("m", "f", "contract", "txt", 1, "# Terms\nabc"), ("m", "f", "contract", "txt", 2, "  "), ("m", "f", "contract", "txt", 3, "def\n4. TERMINATION\nghi"), ("m", "g", "contract", "txt", 1, "no heading here")]
    got = C.chunk_pages(spark.createDataFrame(rows, "matter string, source_filename string, document_type string, source string, page_number long, page_text string")).collect()
    seen = {(r.source_filename, r.page_number, r.char_start): (r.section, r.text) for r in got}
    assert seen == {("f", 1, 0): ("Terms", "# Terms\nabc"), ("f", 3, 0): ("Terms", "def\n"), ("f", 3, 4): ("4. TERMINATION", "4. TERMINATION\nghi"), ("g", 1, 0): ("", "no heading here")}
    assert all(r.embedding_text.startswith(f"[Matter: m | Type: contract | Section: {r.section}]\n") for r in got)


def test_breadcrumbs(spark):
    pages = spark.createDataFrame([("m", "f", 1, "intro\n# A\nx\n## B\ny"), ("m", "f", 2, "z\n# C\nw")], "matter string, source_filename string, page_number long, page_text string")
    got = C.heading_sections(pages, spark.createDataFrame([("f", "the a heading")], "source_filename string, header string"))
    assert [r.section_detected for r in got.where("section = 'A'").collect()] == [True]
    assert [r.section for r in got.orderBy("page_number", "char_start").collect()] == ["", "A", "A › B", "A › B", "C"]


def test_tables_and_rebuilding(spark):
    table = "|a|b|\n|-|-|\n" + "\n".join(f"|{i}|{'v' * 100}|" for i in range(40))
    got = C.table_chunks(spark.createDataFrame([("m", "f", 2, table), ("m", "f", 3, "|x|")], "matter string, source_filename string, page_number long, markdown string")).collect()
    big = [r for r in got if r.page_number == 2]
    assert all(len(r.text) <= C.TABLE_PIECE and r.text.startswith("|a|b|\n|-|-|\n") for r in big) and sum(len(r.text.splitlines()) - 2 for r in big) == 40
    chunks = spark.createDataFrame([("m", "f", 1, "txt", 0, 3, "abc"), ("m", "f", 1, "txt", 5, 7, "fg"), ("m", "f", 1, "table", 0, 2, "zz")], "matter string, source_filename string, page_number long, document_type string, char_start long, char_end long, text string")
    assert C.rebuild_pages(chunks).first()["page_text"] == "abc  fg"


def test_groups_speakers_sentences(spark):
    pages = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([1000, 1000, 1000, 4000, 10], 1)], "doc_id long, page_number long, page_text string")
    assert [r.group_no for r in C.extraction_groups(pages).orderBy("page_number").collect()] == [0, 0, 1, 2, 3]
    t = spark.createDataFrame([("Q. Hi\nA. Yes\nTHE WITNESS: no\nQ. x",)], "t string")
    assert t.select(C.speakers("t")).first()[0] == ["Q", "A", "The Witness"]
    s = spark.createDataFrame([("One. Two! Three? Four.",)], "t string")
    assert s.select(C.sentence_window(F.col("t"), F.lit("Three"))).first()[0] == "Two! Three? Four."
    assert s.select(C.sentence_window(F.col("t"), F.lit("nine"))).first()[0] == "One. Two! Three? Four."


def test_transcript_tail(spark):
    rows = [("m", "f", 1, "Q. a" + "z" * 200, True), ("m", "f", 2, " ", True), ("m", "f", 3, "A. b", True)]
    got = C.transcript_chunks(spark.createDataFrame(rows, "matter string, source_filename string, page_number long, page_text string, numbered boolean")).orderBy("page_number").collect()
    assert got[1].embedding_text == "[Matter: m | Type: transcript | Speakers: A | Page: 3]\n(previous page ends: …" + "z" * 160 + ")\nA. b" and got[1].text == "A. b"
