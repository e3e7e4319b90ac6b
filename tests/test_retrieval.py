import pytest
from pyspark.sql import functions as F

from vellum.operators import retrieval as R
from vellum.operators import verification as V

CHUNKS = "matter string, source_filename string, page_number long, char_start long, text string, document_type string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", f"d{i}", 1, 0, f"the quokka clause number {i}", "contract") for i in range(30)] + [("b", "d0", 1, 0, "the quokka clause number 0", "memo")]
    return spark.createDataFrame(rows, CHUNKS)


def test_scope(chunks):
    assert R.scoped(chunks, "a").count() == 30 and R.scoped(chunks, None).count() == 31
    assert R.scoped(chunks, "a", "d3").count() == 1
    for scope in (("nope",), ("a' OR 1=1 --",), ("b", "d3"), (None, "d3")):
        with pytest.raises(R.UnknownScope):
            R.scoped(chunks, *scope)


def test_mentions_are_whole_and_paged(chunks):
    page = R.mention_page(R.scoped(chunks, "a"), "QUOKKA  clause", offset=25, limit=10).collect()
    assert len(page) == 5 and {r.total for r in page} == {30} and not page[0].truncated
    assert R.every_mention(chunks, "quokka", "memo").count() == 1 and R.every_mention(chunks, "wombat").count() == 0


def test_scope_lies_below_the_ranking(spark, chunks, tmp_path):
    chunks.write.partitionBy("matter").parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    q = spark.createDataFrame([(1, "a", "quokka 7")], "qid long, matter string, query string")
    plan = R.bm25_topk(q, R.scoped(stored, "a"), 3, ["source_filename"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(matter" in plan
    assert [r.source_filename for r in R.bm25_topk(q, R.scoped(stored, "a"), 1, ["source_filename"]).collect()] == ["d7"]


def test_another_matter_changes_no_rank(spark, chunks):
    q = spark.createDataFrame([(1, "a", "clause 7 quokka")], "qid long, matter string, query string")
    one = R.bm25_topk(q, chunks, 5, ["source_filename"]).collect()
    flood = chunks.unionByName(chunks.withColumn("matter", F.lit("z")))
    assert sorted(map(str, one)) == sorted(map(str, R.bm25_topk(q, flood, 5, ["source_filename"]).collect()))


def test_rrf_ties_keep_what_was_seen_first(spark):
    arm = lambda rows: spark.createDataFrame([(1, k, i) for i, k in enumerate(rows)], "qid long, k string, rank int")
    got = R.rrf([arm(["x", "y"]), arm(["z", "w"])], 10, ["k"]).orderBy("rank").collect()
    assert [r.k for r in got] == ["x", "z", "y", "w"]


def test_dense_and_rerank(spark):
    items = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, vector array<float>")
    q = spark.createDataFrame([(1, [3.2, 0.0])], "qid long, vector array<float>")
    top = R.dense_topk(q, items, 3, ["id"])
    assert [r.id for r in top.orderBy("rank").collect()] == [3, 4, 2]
    assert [r.id for r in R.rerank(top, F.col("id").cast("double"), 2).orderBy("rank").collect()] == [4, 3]


def test_anchors(spark):
    t = 'What does "net revenue" mean for INV-77341, $1,200.50 and § 4.2 by John Q. Smith in 2024?'
    got = spark.createDataFrame([(t,)], "t string").select(R.anchors(F.col("t"))).first()[0]
    assert got[:4] == ["net revenue", "INV-77341", "$1,200.50", "§ 4.2"]


GROUND = "qid long, chunk_id string, rank int, source_filename string, page_number long, char_start long, char_end long, text string"


@pytest.fixture(scope="module")
def ground(spark):
    return spark.createDataFrame([(1, "C1", 0, "lease.txt", 4, 100, 160, "Rent is due on the “first” day of the month, without notice."), (1, "C2", 1, "memo.txt", 1, 0, 30, "Nothing of that kind is here.")], GROUND)


@pytest.mark.parametrize(
    "answer,good,reasons",
    [
        ('Due [document: lease.txt, page: 9, chunk: C1, span: "Rent is due on the first day"]', [(4, 100, 130)], []),
        ('Due [document: lease.txt, page: 4, chunk: C2, span: "Rent is due on the first day"]', [], ["cited span does not overlap chunk C2 (page 1, offsets 0..30)"]),
        ('Due [document: lease.txt, page: 4, chunk: C1, span: "Rent is waived"]', [], ["cited span does not overlap chunk C1 (page 4, offsets 100..160)"]),
        ('It says "of the month, without notice" there', [(4, 131, 159)], []),
        ('It says "a fabricated passage of text" there', [], ["cited span not found in any retrieved chunk"]),
        ("Due [document: lease.txt, page: 4, chunk: C1]", [], ["citation has no verifiable span"]),
        (V.REFUSAL + ' "Rent is due on the first day"', [], []),
        ('[chunk: C1, span: "Rent is due"] and [chunk: C1, span: "of the month"]', [(4, 100, 111)], []),
    ],
)
def test_verifier(spark, ground, answer, good, reasons):
    got = V.verify_answers(spark.createDataFrame([(1, answer)], "qid long, answer_text string"), ground).first()
    assert [(c.page, c.char_start, c.char_end) for c in got.citations] == good
    assert [r.reason for r in got.rejected_claims] == reasons


def test_hints_never_verify(spark, ground):
    rows = V.verified_claims(spark.createDataFrame([(1, 'x [chunk: C1, span: "Rent is dew on the first day"]')], "qid long, answer_text string"), ground)
    (h,) = V.fuzzy_hints(rows, ground).collect()
    assert h.filename == "lease.txt" and h.ratio >= 0.82 and h.verified is False


def test_lines_and_chips(spark):
    pages = spark.createDataFrame([(1, 1, "Q. Were you there?\nA. Yes.\nA. Yes.")], "doc_id long, page_number long, page_text string")
    lines = spark.createDataFrame([(1, 1, 3, 0, 18), (1, 1, 4, 19, 26), (1, 1, 5, 27, 34)], "doc_id long, page long, line long, char_start long, char_end long")
    cites = spark.createDataFrame([(1, 1, 3, 24, "Were you there? A. Yes"), (1, 1, 19, 26, "A. Yes."), (1, 1, 3, 7, "Were"), (2, 1, 0, 4, "Were")], "doc_id long, page long, char_start long, char_end long, span string")
    assert {(r.doc_id, r.span): r.lines for r in V.derived_lines(cites, lines, pages).collect()} == {(1, "Were you there? A. Yes"): "3-4", (1, "A. Yes."): None, (1, "Were"): "3", (2, "Were"): None}
    a = spark.createDataFrame([("x [document: f, page: 2, span: y] z [document: g, page: 1].", [("f", 2)])], "a string, c array<struct<filename:string,page:long>>")
    assert a.select(V.numbered_chips("a", "c")).first()[0] == "x [1] z ."
