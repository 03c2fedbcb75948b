"""WARC archives: written by Spark's text sink, read back with boundary-chain verification.

A record is header lines, an empty line, the payload and two line ends; the text sink with
that separator writes exactly this, file by file, with Spark's commit protocol. Reading cuts
files into blocks that tasks scan on their own. In its block a task finds every place that
carries the magic line and a header, whether it is a record or lies inside a payload, and
emits it with the place its length says the next record starts. Within the block these
links are followed at once; across blocks by pointer jumping from the file's start, over
one entry a block, in as many rounds as the logarithm of a file's blocks. Only records
that the chain reaches are real. A record whose payload holds magic lines is put
together again from its pieces. A file whose chain ends before the file does is an error.

Records of WARC/1.0 and 1.1 are read, from plain files and from .gz ones (a task a file, as gzip
can't be entered in the middle).
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace, ship

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: What files are cut at: a magic line up to its last digit.
SPLIT = "WARC/1."
_STEP = len(SPLIT)
_VERSIONS = (b"0\r\n", b"1\r\n")
#: Repeated payloads up to this many distinct ones are joined by broadcast (some 100 bytes each).
BROADCAST_REPEATS = 200_000
_ID = "urn:x-page:"
#: The date of records whose pages have none.
DATE = "2000-01-01T00:00:00Z"
_CANDIDATE = (
    "file string, block long, rel long, next long, exit long, total long, whole boolean, type string, record_id string, "
    "refers_to string, uri string, declared string, full_bytes long, bytes long, digest string, payload binary"
)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(one WARC record per page as text without its end, the repeated payloads).

    Of pages with equal payloads of `least` bytes or more, that of the largest id is the response.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    d = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.regexp_replace(F.col(url_col), "[\r\n]", ""), F.lit("")).alias("url"),
        payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha1(payload.cast("binary")).alias("digest"),
    )
    repeats = d.where(F.col("n") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("c")).where("c > 1").select("digest", "top")
    return d, repeats


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat(*(x for k, v in pairs for x in (F.lit(f"{k}: "), v, F.lit("\r\n"))))


def write_warc(spark: SparkSession, pages: DataFrame, path: str, least: int = 1000, ws: Workspace | None = None, compression: str | None = None, **names) -> None:
    """Write a record for every page under `path`, in a store that Spark writes to; compression: None or gzip.

    Defined cases: null payloads and urls are empty; rows that repeat an id and payload are all
    responses; null ids are written as empty ones; line ends in urls are left out; an empty
    table writes no record.
    """
    ws = ws or Workspace(spark, "warc")
    d, repeats = records(pages, least=least, **names)
    repeats = ws.put(repeats, "repeats")
    if repeats.count() <= BROADCAST_REPEATS:
        repeats = F.broadcast(repeats)
    d = d.join(repeats, "digest", "left")
    again = (F.col("n") >= least) & F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    urn = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(again, _lines(("WARC-Refers-To", urn(F.col("top"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise("")
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC),
        _lines(
            ("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", urn(F.col("id"))), ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("X-Payload-Length", F.col("n").cast("string")),
        ),
        refers,
        _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.octet_length(body).cast("string"))),
        F.lit("\r\n"),
    )
    d.select(F.concat(head, body).alias("value")).write.mode("overwrite").option("lineSep", END).text(path, compression=compression)


_FIELD = re.compile(rb"(?:^|\r\n)([A-Za-z-]+): ?([^\r\n]*)")


def _header(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, header bytes with the empty line, content length) if raw goes on like a record after SPLIT; urls make headers of any length."""
    if not raw.startswith(_VERSIONS):
        return None
    stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(raw[1:stop])}
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit() and "warc-type" in fields):
        return None
    return fields, stop + 4, int(n)


def _segments(batches):
    """(file, block, content bytes) of each piece between magic lines, in order."""
    for batch in batches:
        value = batch.column(2)
        raw = value.buffers()[2]
        raw = memoryview(raw) if raw is not None else memoryview(b"")
        wide = pa.types.is_large_string(value.type) or pa.types.is_large_binary(value.type)
        offsets = memoryview(value.buffers()[1]).cast("q" if wide else "i")[value.offset : value.offset + len(value) + 1]
        for i, (file, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            yield file, block, bytes(raw[offsets[i] : offsets[i + 1]])


def _parsed(fields: dict[str, str], body: bytes, full: bool, keep: bool) -> dict:
    return {
        "type": fields["warc-type"], "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "uri": fields.get("warc-target-uri"),
        "declared": fields.get("warc-payload-digest"), "full_bytes": int(n) if (n := fields.get("x-payload-length", "")).isascii() and n.isdigit() else None,
        "bytes": len(body) if full else None, "digest": hashlib.sha1(body).hexdigest() if full else None, "payload": body if full and keep else None,
    }


def _scan(keep: bool):
    """Candidates of each block with their links, and one row a block (rel -1) with its length."""
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]

    def flush(file, block, at, found):
        link = {r["rel"]: r["next"] for r in found}
        end: dict[int, int] = {}
        for r in sorted(link, reverse=True):
            end[r] = end.get(link[r], link[r])
        for r in found:
            r["exit"] = end[r["rel"]]
        rows = [*found, {"rel": -1, "total": at}]
        for r in rows:
            r["file"], r["block"] = file, block
        schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for c, k in (x.split() for x in _CANDIDATE.split(", "))])
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in names], schema=schema)

    def run(batches):
        now, at, found = None, 0, []
        for file, block, raw in _segments(batches):
            if now != (file, block):
                if now:
                    yield flush(*now, at, found)
                now, at, found = (file, block), 0, []
            if (at or block) and (h := _header(raw)):
                fields, head, n = h
                whole = len(raw) == head + n + len(END) and raw.endswith(END.encode())
                found.append({"rel": at, "next": at + head + n + len(END) + _STEP, "whole": whole} | _parsed(fields, raw[head : head + n] if whole else b"", whole, keep))
            at += len(raw) + _STEP
        if now:
            yield flush(*now, at, found)

    return run


def _walk(key, table):
    """Of one block's candidates, those on the chain from its entries."""
    start, after, entry = (table.column(c).to_pylist() for c in ("start", "after", "entry"))
    at = {s: i for i, s in enumerate(start)}
    keep = set()
    for s, e in zip(start, entry, strict=True):
        while e and s in at and s not in keep:
            keep.add(s)
            s = after[at[s]]
    return table.filter(pa.array([s in keep for s in start], pa.bool_())).drop_columns(["entry"])


def _pieces(batches):
    """(file, block, rel, bytes) of all pieces."""
    now, at = None, 0
    rows: list[list] = [[], [], [], []]
    held = 0
    for file, block, raw in _segments(batches):
        if now != (file, block):
            now, at = (file, block), 0
        for x, y in zip(rows, (file, block, at, raw), strict=True):
            x.append(y)
        at += len(raw) + _STEP
        held += len(raw)
        if held > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], ["file", "block", "rel", "raw"])
            rows, held = [[], [], [], []], 0
    if rows[0]:
        yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], ["file", "block", "rel", "raw"])


def _joined(keep: bool):
    """Records put together from their pieces."""
    schema = [("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("declared", pa.string()), ("full_bytes", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())]

    def run(batches):
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                raw = SPLIT.encode().join(bytes(p["raw"]) for p in parts)
                fields, head, n = _header(raw)
                out.append(_parsed(fields, raw[head : head + n], True, keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[c] for r in out], t) for c, t in schema)], ["file", "start", *(c for c, _ in schema)])

    return run


def read_warc(spark: SparkSession, path: str, payload: bool = False, ws: Workspace | None = None, strict: bool = True) -> DataFrame:
    """The real records of all archives under `path`, each with its file and offset.

    Columns: file, offset, type, record_id, refers_to, uri, declared (payload digest), full_bytes
    (the payload's length as declared), bytes, digest (of the content here, lower-case hex) and,
    if asked for, payload.

    A file's chain starts at its first byte; what no link reaches from there is not a record.
    A chain that ends before its file does (a wrong length, a torn record, a file that is no
    archive) raises ValueError with the file and the place; with strict=False the records
    before the break are given. Defined cases: an empty folder or file gives no rows;
    contents may hold magic lines, whole records or any bytes.
    """
    ship(spark)
    ws = ws or Workspace(spark, "warc")
    pieces = spark.read.option("lineSep", SPLIT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
    found = ws.put(pieces.mapInArrow(_scan(payload), _CANDIDATE), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ws.put(found.where("rel = -1").select("file", "block", "total", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "blocks")
    cand = found.where("rel >= 0").drop("total").join(blocks, ["file", "block"])
    cand = cand.withColumn("start", F.col("base") + F.col("rel")).withColumn("after", F.col("base") + F.col("next")).withColumn("exit", F.col("base") + F.col("exit"))

    # Pointer jumping over the few candidates that another block's chain, or the file's start, may enter.
    first = F.col("start") == _STEP
    targets = cand.select("file", F.col("exit").alias("start")).distinct()
    jump = ws.put(cand.select("file", "start", "exit").join(targets, ["file", "start"], "left_semi").union(cand.where(first).select("file", "start", "exit")).distinct(), "jump0")
    reach = jump.where(first).select("file", "start")
    most = blocks.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    for i in range(math.ceil(math.log2(most)) + 1 if most > 1 else 0):
        step = reach.join(jump, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reach = ws.put(reach.union(step).distinct(), f"reach{i}")
        onward = jump.select("file", F.col("start").alias("exit"), F.col("exit").alias("further"))
        jump = ws.put(jump.join(onward, ["file", "exit"]).select("file", "start", F.col("further").alias("exit")), f"jump{i + 1}")
    marked = cand.join(reach.withColumn("entry", F.lit(True)), ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    fields = ["type", "record_id", "refers_to", "uri", "declared", "full_bytes", "bytes", "digest", "payload"]
    marked = marked.select("file", "block", "start", "after", "whole", *fields, "entry")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema if f.name != "entry")
    real = ws.put(marked.groupBy("file", "block").applyInArrow(_walk, kept), "real")

    if strict:
        ends = real.groupBy("file").agg(F.max("after").alias("after"))
        # positions count from after SPLIT, and each file's pieces one SPLIT more than it holds
        torn = blocks.groupBy("file").agg(F.sum("total").alias("size")).where(F.col("size") > _STEP).join(ends, "file", "left").where("after is null or after <> size")
        if bad := torn.select("file", F.coalesce(F.col("after") - _STEP, F.lit(0)).alias("at")).orderBy("file").limit(5).collect():
            raise ValueError("archives whose records end before the file: " + ", ".join(f"{r.file} at byte {r.at}" for r in bad))

    out = real.where("whole").select("file", "start", *fields)
    split = real.where("not whole").select(F.col("file").alias("f"), F.col("start").alias("s"), F.col("after").alias("e"))
    if split.limit(1).count():
        # Pieces of records that hold magic lines: a piece belongs to the last real record that starts at or before it.
        own = spark.read.option("lineSep", SPLIT).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))
        cut = own.join(F.broadcast(split.select(F.col("f").alias("file")).distinct()), "file", "left_semi") if split.count() < BROADCAST_REPEATS else own
        place = cut.select("file", "block", "value").mapInArrow(_pieces, "file string, block long, rel long, raw binary").join(blocks.drop("total"), ["file", "block"])
        place = place.select("file", (F.col("base") + F.col("rel")).alias("at"), "raw")
        cell = 1 << 26
        starts = split.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))))
        belongs = place.withColumn("cell", F.floor(F.col("at") / cell)).join(starts, (F.col("file") == F.col("f")) & (place["at"] >= F.col("s")) & (place["at"] < F.col("e")) & (F.floor(place["at"] / cell) == starts["cell"]))
        whole = belongs.groupBy("file", F.col("s").alias("start")).agg(F.sort_array(F.collect_list(F.struct("at", "raw"))).alias("parts"))
        more = whole.mapInArrow(_joined(payload), "file string, start long, type string, record_id string, refers_to string, uri string, declared string, full_bytes long, bytes long, digest string, payload binary")
        out = out.union(more.select("file", "start", *fields))
    keep = fields if payload else fields[:-1]
    return out.select("file", (F.col("start") - _STEP).alias("offset"), *keep)


def resolved(records: DataFrame) -> DataFrame:
    """Records with payload_bytes and payload_digest of the full payload, and agrees.

    A revisit's are those of the response it refers to, as read from its content, if that has the
    digest and length the revisit declares (of responses that share an id, one that has);
    else they are null and agrees is false. The responses that revisits name are joined
    by broadcast if they are few, else by a shuffle.
    """
    plain = records.where("type <> 'revisit'").withColumns({"payload_bytes": F.col("bytes"), "payload_digest": F.col("digest"), "agrees": F.lit(True)})
    again = records.where("type = 'revisit'").withColumn("_said", F.regexp_replace("declared", "^sha1:", ""))
    asked = again.select(F.col("refers_to").alias("record_id"), F.col("_said").alias("digest"), F.col("full_bytes").alias("bytes")).distinct()
    named = records.where("type <> 'revisit'").join(asked, ["record_id", "digest", "bytes"], "left_semi").select("record_id", "digest", "bytes").distinct()
    named = named.toDF("refers_to", "payload_digest", "payload_bytes")
    if named.count() <= BROADCAST_REPEATS:
        named = F.broadcast(named)
    on = (again["refers_to"] == named["refers_to"]) & (again["_said"] == named["payload_digest"]) & (again["full_bytes"] == named["payload_bytes"])
    again = again.join(named, on, "left").drop(named["refers_to"]).drop("_said").withColumn("agrees", F.col("payload_digest").isNotNull())
    return plain.unionByName(again)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; a revisit's payload is that of its response."""
    from ..sources.tables import table

    ws = Workspace(spark, "warc")
    write_warc(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{ws.path}/archive", ws=ws)
    r = resolved(ws.put(read_warc(spark, f"{ws.path}/archive", ws=ws), "records"))
    number = lambda c: F.regexp_extract(c, rf"^<{_ID}(-?\d+)>$", 1)
    long = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return r.select(
        long("record_id").alias("page_id"),
        F.when(F.col("agrees"), F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("agrees"), F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        long("refers_to").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), t AS (
  SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h
)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN t ON p.h = t.h
"""
