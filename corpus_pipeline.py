"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, and the mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The
first four return documents with their own columns; the last returns how often each document
that is left goes into the mix. run() writes each stage's result as Parquet in the shared
folder and rereads it, so a lost executor costs at most part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontamination, jaccard, mixing, quality, secrets
from tidewell.llm._shared import Workspace
from tidewell.sources.tables import table

#: The model stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None

#: Rows of dropped near duplicates that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Files whose names may be broadcast to number the rows in them; rows of more are written down with their numbers.
NUMBERED_FILES = 100_000


def _plain(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with own columns under names that no operator makes, and the way back to docs' columns."""
    other = {c: f"own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    plain = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in other.items()))
    return plain, lambda d: d.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))


def _in_files(ws: Workspace, docs: DataFrame) -> DataFrame | None:
    """docs with a number of each row in the column row, if docs are all rows of Parquet files: file and place there.

    Such a number is the same in every reading, so nothing needs to be written down. None for any other
    docs, as of a filter, a limit or a join, where a row may come and go, or come twice.
    """
    try:
        place = docs.metadataColumn("_metadata")
        placed = docs.select("*", place["file_path"].alias("own_file"), place["row_index"].alias("row"))
        there = ws.spark.read.parquet(*docs.inputFiles()).count()
    except AnalysisException:  # no files, other ones, or several tables
        return None
    names = placed.select("own_file").distinct().repartition(1)
    files = ws.put(names.select("own_file", F.monotonically_increasing_id().alias("own_n")), "files")
    if files.count() > NUMBERED_FILES:
        return None
    rows = placed.join(F.broadcast(files), "own_file").select(*docs.columns, (F.col("own_n") * (1 << 40) + F.col("row")).alias("row"))
    found = rows.agg(F.count("*").alias("n"), F.count_distinct("row").alias("own")).first()
    return rows if found.n == found.own == there else None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject.

    Null and empty texts are scored like any other; rows of one text go or stay together; without
    labels every score is one half, and nothing stays; an empty table stays empty.
    """
    plain, back = _plain(docs)
    net = quality.train(spark, plain, table(spark, sf_dir, "labels").where(f"not ({quality.HELD_OUT})"))
    return back(quality.quality_scores(spark, plain, net).where(F.col("score") >= quality.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, that with the smallest id, nulls last; of rows equal in that, one.

    Rows are told apart by a number that each gets once, not by their ids: rows that share an id
    and not their text all stay, and a row without an id goes like any other. Texts
    without words link with nothing and stay. Documents that are not simply the rows of Parquet files are
    written down once, with their numbers.
    """
    ws = Workspace(spark, "pipeline")
    plain, back = _plain(docs)
    rows = _in_files(ws, plain)
    if rows is None:
        rows = ws.put(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = ws.put(jaccard.jaccard_components(spark, rows, "row").select("row", F.col("component_id").alias("group")), "groups")
    # only rows of groups of two and more are looked at further
    many = ws.put(groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"), "many")
    member = ws.put(groups.join(many, "group").join(rows.select("row", "doc_id"), "row"), "member")
    best = ws.put(member.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("best")).select("group", F.col("best.row").alias("kept")), "best")
    drop = ws.put(member.join(best, "group").where("row <> kept").select("row"), "drop")
    ws.drop("groups", "many", "member", "best")
    n = drop.count()
    return back(rows.join(F.broadcast(drop) if n <= BROADCAST_IDS else drop, "row", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have none; rows of one id are judged one by one; without items all stay.
    """
    plain, back = _plain(docs)
    found = decontamination.contamination(spark, plain, table(spark, sf_dir, "benchmark"), carry=plain.columns)
    return back(found.where(F.size("spans") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in the text; n_chars follows where a text was changed. Null texts stay null."""
    plain, back = _plain(docs)
    found = secrets.scan_secrets(spark, plain)
    out = back(found.withColumn("text", F.col("redacted")).withColumn("doc_id", F.struct("doc_id", (F.size("findings") > 0).alias("changed"))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("doc_id.changed"), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("doc_id", F.col("doc_id.doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document in the mix of sources; null sources are one source, texts without words get none."""
    return mixing.mix_sources(spark, docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    ws = Workspace(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
