"""Structured Streaming queries that drain what is there and return the result table.

Each reads files as a stream, keeps its state and progress in a folder of its own under the
shared folder, and ends by itself (availableNow).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.formats import scratch


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, with ts as a watermarkable timestamp; files: most of them a micro-batch."""
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    folder = _folder(spark, path)
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*" if folder else name)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path if folder else parent).withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(spark: SparkSession, df: DataFrame, mode: str, keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """Run to the end of the available input and return the result as Parquet.

    at: a folder of an earlier run of the same stream, which goes on from its checkpoint.
    append: all rows. complete: the last micro-batch's. update: of each key the row of the last
    micro-batch that has one; each micro-batch writes a folder of its own, so one that runs
    again after a failure writes over itself.
    """
    at = at or scratch(spark)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    out = (lambda n: f"{at}/out/batch={n}") if mode == "update" else (lambda n: f"{at}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out(n))

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{at}/out")
    if not keys:
        raise ValueError("update mode needs the keys of a row")
    every = spark.read.schema(StructType([*df.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/out")
    rest = [c for c in df.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*df.columns)


def hourly(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Events an hour and type, update mode: the watermark frees the hours it has passed, and rows later than it are dropped."""
    return drain(spark, _hours(source(spark, path, files)), "update", ["window_start", "event_type"])


def in_stages(spark: SparkSession, parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None, at: str | None = None) -> DataFrame:
    """The result of a stream whose input arrives in parts: each is written, read to its end as one micro-batch, and the stream stopped.

    Every part but the first starts from the checkpoint of the one before, in the folder `at`.
    """
    at, out = at or scratch(spark), None
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{at}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        out = drain(spark, build(stream), mode, keys, at)
    return out


def closing(rows: DataFrame, kinds: tuple[str, ...] = ("click",), user: int | None = None, rounds: int = 2) -> list[DataFrame]:
    """Parts of a row of each kind, days behind the last row and without an id, that bring the watermark past all others.

    user: theirs; a join on users drops rows without one before it sees their time.

    A watermark holds from the micro-batch after the one that moved it, so one part is not enough.
    """
    last = rows.agg(F.max("ts").alias("last"))
    kind = F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind")
    made = {"ts": F.col("last"), "event_type": F.col("kind"), "user_id": F.lit(user)}
    blank = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]
    return [last.select(F.col("last") + F.expr(f"interval {n + 2} day"), kind).toDF("last", "kind").select(*blank) for n in range(rounds)]


def _hours(s: DataFrame) -> DataFrame:
    w = s.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def late_rows_dropped(spark: SparkSession, path: str) -> DataFrame:
    """hourly() over a stream whose first half arrives last: what the second half's watermark has passed is dropped.

    Spark drops by the watermark that held one micro-batch before, so the latest rows come between the halves.
    """
    rows = spark.read.parquet(path)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    low, high = (low, high) if low is not None else (0, 0)
    cut = low + (high - low) // 2
    parts = [rows.where((micros >= cut) & (micros < high)), rows.where(micros == high), rows.where(micros < cut)]
    return in_stages(spark, parts, _hours, "update", ["window_start", "event_type"])


def distinct_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Events without repeats of (user, type, id) while the watermark holds them."""
    s = source(spark, path, files).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    return drain(spark, s.select("event_id", "user_id", "event_type"), "append")


def user_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", files: int | None = None) -> DataFrame:
    """Sessions that the watermark has closed, append mode."""
    s = source(spark, path, files).withWatermark("ts", "10 minutes")
    w = s.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return drain(spark, w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n"), "append")


def all_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", files: int | None = None) -> DataFrame:
    """Sessions with those still open at the stream's end, complete mode."""
    s = source(spark, path, files).withWatermark("ts", "10 minutes")
    w = s.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return drain(spark, w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n"), "complete")


def to_memory(spark: SparkSession, path: str, least: float = 10) -> DataFrame:
    """Counts by type kept in the driver's memory sink; for results as small as these."""
    s = source(spark, path).where(F.col("value") > least).groupBy("event_type").agg(F.count("*").alias("n"))
    name = f"counts_{uuid.uuid4().hex}"
    q = s.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def purchases_after_clicks(spark: SparkSession, path: str, minutes: int = 60) -> DataFrame:
    """Stream-stream join: purchases within an hour after a click of the same user."""
    s = source(spark, path)
    c = s.where("event_type = 'click'").withWatermark("ts", "1 hour").select(F.col("user_id").alias("cu"), F.col("event_id").alias("click_id"), F.col("ts").alias("ct"))
    p = s.where("event_type = 'purchase'").withWatermark("ts", "1 hour").select(F.col("user_id").alias("user_id"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("pt"))
    j = c.join(p, (F.col("cu") == F.col("user_id")) & (F.col("pt") > F.col("ct")) & (F.expr(f"pt <= ct + interval {minutes} minutes")))
    return drain(spark, j.select("user_id", "click_id", "purchase_id"), "append")


def _count(key, pdfs, state):
    n = state.get[0] if state.exists else 0
    for pdf in pdfs:
        n += len(pdf)
    state.update((n,))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n]})


def user_totals(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Own state: a running count of each user's events, the last value of each."""
    s = source(spark, path, files)
    counted = s.groupBy("user_id").applyInPandasWithState(_count, "user_id long, n long", "n long", "update", "NoTimeout")
    return drain(spark, counted, "update", ["user_id"])


def purchases_after_clicks_or_none(spark: SparkSession, path: str, minutes: int = 60) -> DataFrame:
    """Stream-stream left outer join: clicks with the same user's purchases in the hour after, or with none.

    A click without a purchase comes out when the watermark has passed its hour and its state is freed;
    closing rows bring that about for the last ones.
    """

    def build(s: DataFrame) -> DataFrame:
        c = s.where("event_type = 'click'").withWatermark("ts", "1 hour").select(F.col("user_id").alias("cu"), F.col("event_id").alias("click_id"), F.col("ts").alias("ct"))
        p = s.where("event_type = 'purchase'").withWatermark("ts", "1 hour").select(F.col("user_id").alias("pu"), F.col("event_id").alias("purchase_id"), F.col("ts").alias("pt"))
        j = c.join(p, (F.col("cu") == F.col("pu")) & (F.col("pt") > F.col("ct")) & F.expr(f"pt <= ct + interval {minutes} minutes"), "left_outer")
        return j.select(F.col("cu").alias("user_id"), "click_id", "purchase_id")

    rows = spark.read.parquet(path)
    return in_stages(spark, [rows, *closing(rows, ("click", "purchase"), -1)], build, "append").where("click_id is not null")


GAP = pd.Timedelta(minutes=30)


class Sessions(StatefulProcessor):
    """A user's open sessions as a list in the state store, a timer at the end of the first; what the watermark has passed is given and freed."""

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        rows = [pdf["ts"] for pdf in rows]
        if pd.isna(key[0]):
            return
        found = [(pd.Timestamp(t), pd.Timestamp(t), 1) for ts in rows for t in ts]
        found += [(pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n) for a, b, n in list(self.open.get())]
        whole: list = []
        for a, b, n in sorted(found):
            if whole and a < whole[-1][1] + GAP:
                whole[-1] = (whole[-1][0], max(b, whole[-1][1]), whole[-1][2] + n)
            else:
                whole.append((a, b, n))
        yield self._closed(key, whole, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [(pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n) for a, b, n in list(self.open.get())]
        yield self._closed(key, held, timerValues.getCurrentWatermarkInMs())

    def _closed(self, key, whole: list, mark: int) -> pd.DataFrame:
        passed = lambda x: (x[1] + GAP).value // 10**6 < mark
        left = [x for x in whole if not passed(x)]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if left:
            self.open.put([(a.value // 1000, b.value // 1000, n) for a, b, n in left])
            self.handle.registerTimer(max(mark + 1, min((b + GAP).value // 10**6 + 1 for _, b, _ in left)))
        else:
            self.open.clear()
        done = [(key[0], a, n) for a, b, n in whole if passed((a, b, n))]
        return pd.DataFrame(done, columns=["user_id", "session_start", "n"]).astype({"user_id": "int64", "n": "int64", "session_start": "datetime64[us]"})


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed_sessions(spark: SparkSession, parts: list[DataFrame], at: str | None = None) -> DataFrame:
    """Sessions by a processor of our own with event-time timers, kept in the RocksDB store; append mode.

    Only sessions that the watermark has passed come out, and no state is left of them.
    """

    def build(s: DataFrame) -> DataFrame:
        # the processor's times are plain UTC
        s = s.withWatermark("ts", "10 minutes").select("user_id", "ts")
        return s.groupBy("user_id").transformWithStateInPandas(Sessions(), "user_id long, session_start timestamp_ntz, n long", "Append", "EventTime")

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return in_stages(spark, parts, build, "append", at=at)
    finally:
        spark.conf.set(STATE_STORE, before)


def all_timed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """timed_sessions() of all rows, closed at the stream's end."""
    rows = spark.read.parquet(path)
    return timed_sessions(spark, [rows, *closing(rows)])
