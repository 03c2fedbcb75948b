"""Text operators: word counts, exact dedup, line dedup, masking, HTML to text."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its digest, smallest id and number of copies."""
    return docs.groupBy(F.md5(text_col).alias("digest")).agg(F.min(id_col).alias("keep_id"), F.count("*").alias("copies"))


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences of each non-empty line over all documents."""
    lines = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with only those lines that no line before equals, in order of ids and of lines.

    Ids are unique; lines of one MD5 are equal. Empty lines stay; null texts stay null; a text of
    repeats only becomes empty. Lines travel as digests, texts once.
    """
    split = F.split(text_col, "\n", -1)
    lines = docs.select(F.col(id_col), F.posexplode(split).alias("i", "line"))
    lines = lines.select(id_col, "i", F.when(F.col("line") != "", F.unhex(F.md5("line"))).alias("line"))
    first = lines.where("line is not null").groupBy("line").agg(F.min(F.struct(id_col, "i")).alias("at")).select(F.col(f"at.{id_col}"), "at.i")
    stay = first.union(lines.where("line is null").select(id_col, "i")).groupBy(id_col).agg(F.sort_array(F.collect_list("i")).alias("stay"))
    # The outer transform binds the split text once for all lines.
    kept = F.transform(F.array(split), lambda x: F.array_join(F.transform(F.col("stay"), lambda i: F.get(x, i)), "\n"))[0]
    return docs.join(stay, id_col, "left").withColumn("kept", F.when(F.col(text_col).isNotNull(), F.coalesce(kept, F.lit("")))).drop("stay")


# Patterns of personal data.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Emails and IPv4 addresses replaced by marks."""
    t = F.regexp_replace(F.regexp_replace(text_col, EMAIL, "<EMAIL>"), IPV4, "<IP>")
    return docs.withColumn("masked", t)


# More personal data, and licence lines. Written so that RE2 reads them too.
IPV6 = r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b"
PHONE = r"[+][0-9]{1,3}[ -]?(?:[(][0-9]{1,4}[)][ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}\b"
PERSONAL = ((EMAIL, "<EMAIL>"), (IPV6, "<IP>"), (IPV4, "<IP>"), (IBAN, "<IBAN>"), (CARD, "<CARD>"), (PHONE, "<PHONE>"))
LICENCE = (
    r"(?i)(?:licen[sc]ed under|released under the|distributed under the|permission is hereby granted|all rights reserved|spdx-license-identifier"
    r"|general public licen[sc]e|apache licen[sc]e|mit licen[sc]e|bsd licen[sc]e|mozilla public licen[sc]e|creative commons|cc by(?:-nc)?(?:-sa|-nd)? [0-9]|copyright (?:[(]c[)]|\x{A9}|[0-9]{4}))"
)


def mask_all_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Emails, addresses of both kinds, bank accounts, card and phone numbers replaced by marks, in this order."""
    t = F.col(text_col)
    for pattern, mark in PERSONAL:
        t = F.regexp_replace(t, pattern, mark)
    return docs.withColumn("masked", t)


def mask_licences(docs: DataFrame, text_col: str = "text", mark: str = "<LICENCE>") -> DataFrame:
    """Lines that state a licence or copyright replaced by a mark; other lines, empty ones too, stay. Null stays null."""
    lines = F.transform(F.split(text_col, "\n", -1), lambda x: F.when(F.regexp_like(x, F.lit(LICENCE)), F.lit(mark)).otherwise(x))
    return docs.withColumn("masked", F.array_join(lines, "\n"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Visible text of each page, pieces joined by a space; null stays null."""

    def one(x):
        if x is None:
            return None
        p = _Text()
        p.feed(x)
        p.close()
        return " ".join(p.out)

    return html.map(one)
