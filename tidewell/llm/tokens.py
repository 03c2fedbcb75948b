"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A document up to `chunk` characters is encoded at once. A longer one is encoded in
chunks that overlap. Where two neighbouring chunks both have a token boundary and the
same tokens for `stable` tokens around it, the encodings are spliced there, if it can be
proven that the whole text is cut there too. There are two proofs:

* Text is first cut into pieces (words with the space before them, numbers, signs, white space)
  and tokens never cross pieces. Most changes between letters, digits, signs and white
  space start a piece whatever lies around them.
* Inside a piece, a row of tokens is the byte-pair encoding of its text exactly if each two
  neighbours are the encoding of theirs; and a cut that an encoding has leaves either side the
  encoding of its own text. So a splice inside a long word, number or row of signs (all of a
  Japanese page may be one) holds if the two tokens that meet there, encoded together, stay two.

If there is no such boundary, the overlap is doubled, up to the whole chunk, and then the chunk.

Texts whose characters are all below U+0250 go through the byte-pair codec that reads
the same vocabulary several times faster; all others through the library itself. The two
agree on those characters, which tests check one by one.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ship

CHUNK = 100_000
OVERLAP = 2_000
STABLE = 8
_FAST_BELOW = "ɐ"


class Codec:
    """encode(text) -> (token ids, character offset of each token's start)."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        told = json.loads(self.library.to_str())
        first, model = told["pre_tokenizer"] or {}, told["model"]
        #: Whether what this module takes as proven holds: byte-level pieces, plain merges.
        self.splits = (
            first.get("type") == "ByteLevel" and first.get("use_regex", False) and not first.get("add_prefix_space") and not told["normalizer"]
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        )
        added = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        # a byte-level token has a character for each of its bytes
        n = max([*self.library.get_vocab().values(), *added], default=-1) + 1
        self.sizes = np.array([added.get(i, len(self.library.id_to_token(i) or "")) for i in range(n)], dtype=np.int64)
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def _plain(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or max(text) < _FAST_BELOW)

    def ids(self, text: str) -> list[int]:
        if self._plain(text):
            return self.fast.encode(text, allowed_special="all")
        return self.library.encode(text, add_special_tokens=False).ids

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and the character offsets where they start, -1 for those that start inside a character."""
        ids = np.array(self.ids(text), dtype=np.int64)
        size = self.sizes[ids]
        starts = np.cumsum(size) - size
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        return ids, np.where(lead[starts], np.cumsum(lead)[starts] - 1, -1)

    def meet(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their text."""
        both = self.library.id_to_token(a) + self.library.id_to_token(b)
        return [t.id for t in self.library.model.tokenize(both)] == [a, b]


@lru_cache(maxsize=4)
def codec(path: str, ranks_path: str | None, pattern: str | None) -> Codec:
    return Codec(path, ranks_path, pattern)


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """L, N, white space or sign, as the library's patterns tell them apart; ? where versions of Unicode may differ."""
    k = unicodedata.category(c)
    if k != unicodedata.ucd_3_2_0.category(c) or "\x1c" <= c <= "\x1f":
        return "?"
    return "L" if k[0] == "L" else "N" if k[0] == "N" else " " if c.isspace() else "S"


def _proof(text: str, at: int) -> int:
    """2 if a piece starts at `at` whatever lies around; 1 if `at` lies inside a piece and the
    rest of it, taken alone, would be one piece; 0 if neither is certain.

    A space before a word belongs to it, and `'s` and the like may be pieces of their own.
    """
    if not 0 < at < len(text) - 1:
        return 0
    a, c = text[at - 1], text[at]
    x, y = _kind(a), _kind(c)
    if x == "?" or y == "?":
        return 0
    if x != y:
        return 0 if a == " " or a == "'" and y == "L" else 2
    if x == "L":
        return int(at >= 3 and _kind(text[at - 2]) == _kind(text[at - 3]) == "L")
    if x == " ":
        return int(_kind(text[at + 1]) == " ")
    return int(x == "N" or c != "'")


def long_ids(c: Codec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, stable: int = STABLE) -> list[int]:
    """The tokens of a text of any length, spliced from overlapping chunks.

    Memory follows the chunk; where no boundary is proven, the overlap, then the chunk is
    doubled. A tokenizer of another kind than the proofs are for encodes the text at once.
    """
    if len(text) <= chunk or not c.splits:
        return c.ids(text)
    done: list[tuple[int, bool, list[int]]] = []  # (begin, whether inside a piece, tokens) of each part
    begin, inside, length = 0, False, chunk
    while True:
        end = min(len(text), begin + length)
        ids, at = c.spans(text[begin:end])
        splice = (len(ids), len(text), 2) if end == len(text) else None
        wide = min(overlap, length // 2)
        while splice is None:
            low = end - wide
            other, other_at = c.spans(text[low : min(len(text), end + wide)])
            splice = _splice(text, begin, ids, at, low, other, other_at, end, stable)
            if splice is None:
                if wide >= length:
                    break
                wide = min(2 * wide, length)
        if splice is None:  # not even a whole chunk of overlap has a boundary: take more text
            length *= 2
            continue
        if inside and not c.meet(done[-1][2][-1], int(ids[0])):  # the splice before this part was none
            begin, inside, _ = done.pop()
            length = end - begin
            continue
        done.append((begin, inside, ids[: splice[0]].tolist()))
        if splice[1] == len(text):
            return [i for part in done for i in part[2]]
        begin, inside, length = splice[1], splice[2] == 1, chunk


def _splice(text, begin, ids, at, low, other, other_at, end, stable):
    """(tokens before it, place, proof) of the last proven boundary in the overlap [low, end)."""
    i, j = np.flatnonzero(at >= 0), np.flatnonzero(other_at >= 0)
    a, b = at + begin, other_at + low
    common, x, y = np.intersect1d(a[i], b[j], return_indices=True)
    for p, x, y in zip(common[::-1].tolist(), i[x[::-1]].tolist(), j[y[::-1]].tolist(), strict=True):
        if not (low < p < end and (proof := _proof(text, p))):
            continue
        # the same tokens on both sides, and none that touches an edge of a chunk
        if x >= stable and y >= stable and x + stable < len(ids) and y + stable < len(other):
            if (ids[x - stable : x + stable] == other[y - stable : y + stable]).all() and (a[x - stable : x + stable] == b[y - stable : y + stable])[(at[x - stable : x + stable] >= 0)].all():
                return x, p, proof
    return None


def token_counts(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: the tokenizer's file, which every executor can open; ranks_path and pattern: the
    same vocabulary as byte-pair ranks, optional. Special strings inside texts count as
    their one token, the library's default.

    Defined cases: null and empty texts have 0 bytes and tokens; repeated rows and null
    ids each give a row; an empty table gives none; other columns are ignored.
    """
    ship(spark)

    def run(batches):
        c = codec(path, ranks_path, pattern)
        for batch in batches:
            size, n = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                size.append(len(text.encode()))
                n.append(len(long_ids(c, text, chunk)) if text else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    slim = docs.select(id_col, text_col)
    kind = slim.schema[id_col].dataType.simpleString()
    out = slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by the public byte-level vocabulary of 50k."""
    import public_tokenizers

    from ..sources.tables import table

    return token_counts(
        spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )
