"""Tables, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.udf import batch_udf
from ..operators.facts import calendar_rows
from ..schemas import REPORT, require

# fixed value: octets of a calendar line
FOLD = 75


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("matter").parquet(path)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append to a table of the same columns; a table of other ones raises."""
    spark = chunks.sparkSession
    have = {c: t for c, t in spark.read.parquet(path).dtypes}
    if have != dict(chunks.dtypes):
        raise ValueError(f"the table at {path} has columns {have}; rebuild it")
    chunks.select(*have).write.mode("append").partitionBy("matter").parquet(path)


def replace_documents(spark: SparkSession, path: str, chunks: DataFrame, staging: str, documents: DataFrame | None = None) -> None:
    """Put ``chunks`` in the place of all chunks of ``documents`` (matter, source_filename): only their matters' partitions are rewritten.

    A document that has no chunk any more loses those it had, so nothing stale can be cited; without ``documents`` they are those of the chunks.

    The new partitions are written to ``staging`` first, as a path that is read can't be written by the same plan.
    """
    have = spark.read.parquet(path)
    docs = chunks.select("matter", "source_filename")
    if documents is not None:
        docs = docs.unionByName(documents.select("matter", "source_filename"))
    docs = docs.distinct()
    rest = have.join(docs.select("matter").distinct(), "matter", "left_semi").join(docs, ["matter", "source_filename"], "left_anti")
    rest.unionByName(chunks.select(*rest.columns)).write.mode("overwrite").parquet(staging)
    new = spark.read.schema(have.schema).parquet(staging)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("matter").parquet(path)
    # a matter that has nothing left isn't in what was written, so its partition goes by itself
    for r in docs.select("matter").distinct().join(new.select("matter").distinct(), "matter", "left_anti").toLocalIterator():
        drop_matter(spark, path, r["matter"])


def write_chunk_lines(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with the given columns; a line that can't be read stops the job, as a manifest must be whole."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def delete_document(spark: SparkSession, path: str, matter: str, filename: str, staging: str) -> None:
    have = spark.read.parquet(path)
    have.where((F.col("matter") == matter) & ~F.col("source_filename").eqNullSafe(F.lit(filename))).write.mode("overwrite").parquet(staging)
    left = spark.read.schema(have.schema).parquet(staging)
    if left.isEmpty():
        drop_matter(spark, path, matter)
    else:
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("matter").parquet(path)


def drop_matter(spark: SparkSession, path: str, matter: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/matter={matter}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def compact(spark: SparkSession, path: str, staging: str, files: int = 1) -> None:
    """Rewrite a partitioned table with few files per matter."""
    have = spark.read.parquet(path)
    have.write.mode("overwrite").parquet(staging)
    spark.read.schema(have.schema).parquet(staging).repartition(files, "matter").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("matter").parquet(path)


def write_report(states: DataFrame, path: str) -> None:
    require(states, REPORT, "the report").write.mode("append").json(path)


def quarantine(states: DataFrame, path: str) -> None:
    """Set files aside (filename, content) with their reason."""
    states.where("status = 'quarantined'").select("filename", "content", "reason").write.mode("append").parquet(path)


def grid_rows(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """A grid's cells as an export has them: first citation only, white space squeezed."""
    first = F.get("citations", 0)
    cite = F.when(first.isNotNull(), F.concat(first["filename"], F.lit(" p."), first["page"].cast("string"))).otherwise("")
    value = F.coalesce(F.trim(F.regexp_replace(first["span"], r"\s+", " ")), F.lit(""))
    rows = cells.join(questions.select(F.col("id").alias("question_id"), F.col("name").alias("Clause")), "question_id")
    return rows.select(F.col("filename").alias("Document"), "Clause", F.col("status").alias("Status"), F.col("verified_scope").alias("Check scope"), value.alias("Value"), cite.alias("Citation"))


def write_grid_csv(cells: DataFrame, questions: DataFrame, path: str) -> None:
    grid_rows(cells, questions).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def review_markdown(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """(matter, markdown): a table with what is missing first, and the caveat that belongs to it."""
    order = F.when(F.col("status") == "potentially_missing", 0).when(F.col("status") == "not_confirmed", 1).otherwise(2)
    safe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    names = questions.select(F.col("id").alias("question_id"), "name")
    rows = cells.join(names, "question_id").withColumn("row", F.concat(F.lit("| "), safe(F.col("name")), F.lit(" | "), "status", F.lit(" | "), safe(F.col("filename")), F.lit(" |")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "name", "filename", "row"))), lambda x: x["row"])
    head = F.lit("| Clause | Status | Document |\n|---|---|---|\n")
    return rows.groupBy("matter").agg(F.concat(head, F.array_join(lines, "\n"), F.lit("\n\nA clause that was not found may still be there. Verify against the sources.\n")).alias("markdown"))


def _escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in (";", ","):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.regexp_replace(out, "\r?\n", "\\\\\\\\n")


@batch_udf("string")
def folded(line):
    """A calendar line in pieces of at most FOLD octets; no character is split."""

    def cut(s):
        out, size = [""], 0
        for ch in s:
            n = len(ch.encode())
            if size + n > FOLD - (len(out) > 1):
                out.append("")
                size = 0
            out[-1] += ch
            size += n
        return "\r\n ".join(out)

    return line.map(cut)


def calendar_events(reviewed_facts: DataFrame) -> DataFrame:
    """(matter_slug, fact_key, event): VEVENTs of confirmed deadlines and obligations with a confirmed date, and of nothing else."""
    rows = calendar_rows(reviewed_facts)
    day = F.replace(F.col("confirmed_date"), F.lit("-"), F.lit(""))
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "fact_key"), F.concat(F.lit("DTSTART;VALUE=DATE:"), day), folded(F.concat(F.lit("SUMMARY:"), _escaped(F.col("value")["label"]))), folded(F.concat(F.lit("DESCRIPTION:"), _escaped(F.col("span")))), F.lit("END:VEVENT")]
    return rows.select("matter_slug", "fact_key", F.concat_ws("\r\n", *lines).alias("event"))
