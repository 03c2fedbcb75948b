"""Spelling variants of words: a rare-first q-gram prefix filter joins words one edit apart.

A bigram's place in the global order is the number of times it occurs in the words, rarest
first. One inserted, deleted or replaced code point destroys at most two bigram
occurrences of either word, so of the three rarest of each word one survives, and it is among the
three rarest of the other word too (all occurrences of the third bigram count, if it repeats).
The surviving occurrence lies wholly before the edit or wholly behind it. So the limit on its
position can be kept in the join's key: either it stands at the same place from the start and
all up to it is equal, or at the same place from the end and all from it on is equal. Words are
joined on that key and the length, a shorter word also with the next length. What meets is verified: first
by two marks of 64 bits, of its letters and of its bigrams, in which words one edit apart differ by at most two and four
bits, then by the edit distance.

Keys are 64-bit hashes; a collision only adds a pair that verification drops. A key of more
than BLOCK words is dealt into blocks of its right side, each met by a copy of the left
side's rows, so no task holds a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
#: Rarest bigrams of a word that are joined: two may be destroyed.
PREFIX = 3
#: Words of a key that one task holds; more are dealt into blocks.
BLOCK = 2_000
#: Hot keys that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): runs of letters, one letter less where `every` divides the crc32 of id and run.

    Counted in the tasks first, so a frequent word is one row a task.
    """
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    d = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).where(F.length("run") >= min_chars)
    d = d.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    d = d.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return d.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _prefixes(words: DataFrame) -> DataFrame:
    """(word, n, letters, pairs, at): places, from 1, of the PREFIX rarest bigrams of each word, all of the last one's."""
    own = ["word", "n", "letters", "pairs"]
    each = words.select(*own, F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    each = each.withColumn("gram", F.substr("word", F.col("at"), F.lit(2)))
    # at most 90 letters and so 8,100 bigrams
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    sized = each.join(F.broadcast(often), "gram").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))).alias("grams"))
    last = F.get("grams", F.lit(PREFIX - 1))
    known = F.filter("grams", lambda x: (x["often"] < last["often"]) | ((x["often"] == last["often"]) & (x["gram"] <= last["gram"])))
    return sized.select(*own, F.explode(known["at"]).alias("at"))


def marked(words: DataFrame) -> DataFrame:
    """words with 64-bit marks of the letters and of the bigrams in each."""
    letters = "aggregate(sequence(1, length(word)), 0L, (m, i) -> m | shiftleft(1L, ascii(substr(word, i, 1)) % 64))"
    pairs = "aggregate(sequence(1, length(word) - 1), 0L, (m, i) -> m | shiftleft(1L, pmod(hash(substr(word, i, 2)), 64)))"
    return words.withColumn("letters", F.expr(letters)).withColumn("pairs", F.expr(pairs))


def near_words(spark: SparkSession, words: DataFrame, ws: Workspace) -> DataFrame:
    """(word, n, other, m): all pairs of words one edit apart, each in both directions, once."""
    p = _prefixes(ws.put(marked(words), "marked"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), F.col("at") + 1).alias("equal")),
        F.struct(F.lit(1).alias("side"), F.substr("word", F.col("at")).alias("equal")),
    )
    own = ["word", "n", "letters", "pairs"]
    keys = p.select(*own, F.length("word").alias("len"), F.explode(sides).alias("s")).select(*own, "len", "s.side", "s.equal")
    key = lambda length: F.xxhash64("side", "equal", length)
    right = ws.put(keys.select(key(F.col("len")).alias("key"), F.col("word").alias("other"), F.col("n").alias("m"), F.col("letters").alias("letters2"), F.col("pairs").alias("pairs2")), "keys")
    left = keys.select(*own, "side", "equal", F.explode(F.array(F.col("len"), F.col("len") + 1)).alias("to")).select(key(F.col("to")).alias("key"), *own)
    hot = ws.put(right.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "hot")
    few = hot.count() <= BROADCAST_KEYS
    dealt = lambda d: d.join(F.broadcast(hot) if few else hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    right = dealt(right).withColumn("block", F.pmod(F.xxhash64("other"), F.col("blocks")).cast("int")).drop("blocks")
    left = dealt(left).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    longer = F.length("other") > F.length("word")
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    like = (apart("letters", "letters2") <= 2) & (apart("pairs", "pairs2") <= 4)
    met = left.join(right, ["key", "block"]).where(like & (longer | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    pairs = met.select("word", "n", "other", "m").distinct()
    both = F.array(F.struct("word", "n", "other", "m"), F.struct(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def roots(spark: SparkSession, forms: DataFrame, ws: Workspace) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last by pointer jumping.

    A form is more frequent than its word, so there is no ring, and each round halves the way.
    """
    now, k = ws.put(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = ws.put(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k + 1}")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        ws.drop(f"roots{k}")
        now, k = step.select("word", "root"), k + 1


def spelling_variants(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    every: int = 97, min_chars: int = 5, min_count: int = 3, ratio: int = 2,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    The form is the near word of largest n, first in code-point order where several are as
    frequent, if it is at least `ratio` times as frequent as the word; the root is the form's form,
    and so on.

    Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated
    rows count again; ids may be of any type; a table without frequent words gives no rows;
    columns of other names are not read. Words have at least four code points (min_chars), as
    shorter ones may lose all their bigrams by one edit; ratio is at least 2 for roots to end.
    """
    if min_chars < PREFIX + 1 or ratio < 2:
        raise ValueError("min_chars must be 4 or more and ratio 2 or more")
    ws = Workspace(spark, "spelling")
    words = ws.put(word_counts(docs, id_col, text_col, every, min_chars, min_count), "words")
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    near = near_words(spark, words, ws).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = -F.col("best.less") >= ratio * F.col("n")
    near = ws.put(near.select("word", "n_near", F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "near")
    ws.drop("keys", "hot", "marked")
    last = roots(spark, near.where("form is not null"), ws)
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents with their likely spelling."""
    from ..sources.tables import table

    return spelling_variants(spark, table(spark, sf_dir, "documents"))


# crc32 by its definition: the table is made by rule, the texts hold code points below 256 only.
# Words meet by what is left when a letter is taken out; letters above ASCII are put on free ASCII characters first,
# as DuckDB's edit distance counts bytes.
_HIGH = "".join(chr(c) for c in range(0xC0, 0x100))
_FREE = "".join(chr(c) for c in range(0x20, 0x60)).replace("'", "''")
OP11_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), b AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(cast(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END)) AS bytes FROM r
), h AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b, t
), w AS (
  SELECT word, cast(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), s AS (
  SELECT DISTINCT word, rest FROM (
    SELECT word, unnest(list_append(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)), word)) AS rest FROM w)
), p AS (
  SELECT DISTINCT a.word AS x, b.word AS y FROM s a JOIN s b ON a.rest = b.rest AND a.word <> b.word
  WHERE levenshtein(translate(a.word, '{_HIGH}', '{_FREE}'), translate(b.word, '{_HIGH}', '{_FREE}')) = 1
), q AS (
  SELECT x, count(*) AS n_near, arg_min(y, struct_pack(less := -w.n, y := y)) AS best, max(w.n) AS m FROM p JOIN w ON y = w.word GROUP BY x
), f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN best END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN q ON x = word
), c(word, here) AS (
  SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.here AND e.form IS NULL
"""
