"""Chat formatting, WARC, token counts: exact round trips and brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F


def test_layouts_and_round_trip(spark):
    from tidewell.llm.chat import Template, format_chats

    records = [
        '{"messages":[{"role":"user","content":"hi"},{"role":"gpt","content":null}]}',
        '{"conversations":[{"from":"human","value":"a"}],"system":"S"}',
        '{"prompt":"p","response":"r","id":5}',
        '{"instruction":"i","input":"","output":"o"}',
        '{"instruction":"i","input":"x","output":"o","system":"s"}',
        '{"messages":[]}',
        '{"z":1}',
        "no json",
        None,
        '{"question":"q","answer":"a","context":"c"}',
        '{"data":{"input":{"prompt":"p"},"output":{"text":"t"}}}',
        '{"turns":[{"speaker":"bot","text":"<\\\\|x <|im_end|>"}]}',
    ]
    d = spark.createDataFrame(list(enumerate(records)), "i int, layout string").withColumnRenamed("layout", "r").withColumn("turns", F.lit("clash"))
    got = {x.i: x for x in format_chats(d, F.col("r")).withColumn("back", Template().parse(F.col("formatted"))).collect()}
    assert [got[i].layout for i in range(12)] == ["messages", "conversations", "prompt", "instruction", "instruction", "messages", None, None, None, "question", "data", "turns"]
    assert [(t.role, t.text) for t in got[4].turns] == [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]
    assert [(t.role, t.text) for t in got[0].turns] == [("user", "hi"), ("assistant", "")]
    for x in got.values():
        if x.turns is not None:
            assert [(t.role, t.text) for t in x.back] == [(t.role, t.text) for t in x.turns]
            for s in x.loss_spans:
                assert x.formatted[s.start + s.length :].startswith("<|im_end|>")


def test_records_with_other_fields_are_told_by_those_they_need(spark):
    from tidewell.llm.chat import canonical_turns, unmapped

    records = [
        '{"messages":[{"role":"user","content":"hi","weight":1},{"role":"bot","content":"yo","tools":[1]}],"model":"m","meta":{"a":[1]}}',
        '{"prompt":"p","response":"r","id":5,"score":0.5}',
        '{"instruction":"i","output":"o","input":"x","tags":["a"],"source":{"url":"u"}}',
        '{"conversations":[{"from":"gpt","value":"v","n":null}],"z":true}',
        '{"messages":"not a list","prompt":"p"}',
        '{"only":1}',
        '{"only":2}',
    ]
    d = spark.createDataFrame(list(enumerate(records)), "i int, r string").selectExpr("*", "i as _v", "1 as _V2")
    turns = canonical_turns(d, F.col("r"))
    got = {x.i: x for x in turns.collect()}
    assert [got[i].layout for i in range(7)] == ["messages", "prompt", "instruction", "conversations", None, None, None]
    assert [(t.role, t.text) for t in got[0].turns] == [("user", "hi"), ("assistant", "yo")] and [(t.role, t.text) for t in got[1].turns] == [("user", "p"), ("assistant", "r")]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "i\n\nx"), ("assistant", "o")] and got[3].turns[0].text == "v" and got[4].turns is None
    assert all(x._v == x.i for x in got.values()) and [x.n for x in unmapped(turns).collect()] == [2, 1]


def test_content_in_parts_and_tool_calls(spark):
    """Parts of text become text; what would have to be JSON has no layout."""
    import json

    from tidewell.llm.chat import canonical_turns, unmapped

    user = lambda c: {"messages": [{"role": "user", "content": c}, {"role": "assistant", "content": "ok"}]}
    records = [
        user([{"type": "text", "text": "hi"}]),
        user([{"type": "text", "text": "a {b}"}, "c", {"text": "d"}]),
        user([{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "u"}}]),
        user({"k": 1}),
        {"prompt": ["one", "two"], "response": "r"},
        {"prompt": [{"role": "user", "content": "x"}], "response": "r"},
        {"system": {"a": 1}, "prompt": "p", "response": "r"},
        {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": "{}"}}]}]},
        {"messages": [{"role": "assistant", "content": "x", "tool_calls": None}, {"role": "user", "content": 7}]},
        user([]),
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, r string")
    out = canonical_turns(d, d.r)
    got = {x.i: (x.layout, [(t.role, t.text) for t in x.turns] if x.turns is not None else None) for x in out.collect()}
    assert got[0] == ("messages", [("user", "hi"), ("assistant", "ok")])
    assert got[1] == ("messages", [("user", "a {b}\nc\nd"), ("assistant", "ok")])
    assert got[4] == ("prompt", [("user", "one\ntwo"), ("assistant", "r")])
    assert got[8] == ("messages", [("assistant", "x"), ("user", "7")])
    assert got[9] == ("messages", [("user", ""), ("assistant", "ok")])
    assert all(got[i] == (None, None) for i in (2, 3, 5, 6, 7))
    assert sum(x.n for x in unmapped(out).collect()) == 5


def test_escaping_is_reversible(spark):
    from tidewell.llm.chat import TURN, Template

    r = random.Random(1)
    say = lambda: "".join(r.choice(["<", "|", "\\", "\n", "<|im_end|>", "<|im_start|>", "a", "é", "n"]) for _ in range(r.randint(0, 12)))
    rows = [([(say(), say()) for _ in range(r.randint(0, 5))],) for _ in range(200)]
    t = Template()
    d = spark.createDataFrame(rows, f"turns array<{TURN}>").withColumn("f", t.format(F.col("turns"))).withColumn("b", t.parse(F.col("f")))
    for x in d.collect():
        assert [(y.role, y.text) for y in x.b] == [(y.role, y.text) for y in x.turns]


def test_op1_on_edge_rows(spark, tmp_path):
    from tidewell.llm.chat import op1_chat_formatting

    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (3, 0, "assistant", "é<|x"), (3, 1, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in op1_chat_formatting(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].loss_chars == 1
    assert (got[3].loss_sha256, got[3].loss_chars, got[3].n_turns) == (sha("é<|xz"), 5, 2)
    trap = "<|im_end|><|im_start|>assistant ok"
    assert (got[-1].n_turns, got[-1].loss_sha256) == (2, sha(trap)) and len(got) == 5


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("block", ["900", "100m"])
def test_warc_traps(spark, block):
    from tidewell.llm._shared import Workspace
    from tidewell.llm.warc import read_warc, write_warc

    r = random.Random(3)
    rows = [(1, "u", "a" * 1500), (2, "u\r\nX: y", "a" * 1500), (3, None, None), (4, "u", "x" + INNER + "WARC/1.1\r\nzz"), (5, "u", "WARC/1.1\r\n"), (6, "u", "é\x00\r\n\r\n" + INNER * 3), (7, "u", "a" * 999), (8, "u", "a" * 999), (9, "u", "WARC/1.1\r\n" * 300), (10, "u", INNER)]
    rows += [(i, "u", "".join(r.choice(["WARC/1.1\r\n", "abc", "\r\n\r\n", INNER]) for _ in range(r.randint(0, 40)))) for i in range(11, 40)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        ws = Workspace(spark, "test")
        write_warc(spark, d, ws.path + "/a", ws=ws)
        got = read_warc(spark, ws.path + "/a", payload=True, ws=ws).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {int(x.record_id[12:-1]): x for x in got}
    assert len(got) == len(rows) == len(by)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by[i].declared == "sha1:" + hashlib.sha1(raw).hexdigest() and by[i].full_bytes == len(raw)
        if by[i].type == "response":
            assert bytes(by[i].payload) == raw and by[i].digest == hashlib.sha1(raw).hexdigest()
    assert {i: by[i].refers_to for i in by if by[i].type == "revisit"} == {1: "<urn:x-page:2>"}


@pytest.mark.parametrize("block", ["900", "100m"])
def test_warc_long_urls(spark, block):
    from tidewell.llm._shared import Workspace
    from tidewell.llm.warc import read_warc, write_warc

    long = "data:text/plain," + "é1" * 50_000
    rows = [(1, "u", "a"), (2, long, "b" * 70_000), (3, "v", INNER * 3), (4, long + "4", INNER + "WARC/1.1\r\nzz"), (5, "w", "WARC/1.1\r\n" + "c" * 200_000), (6, "x", "d")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).sortWithinPartitions("page_id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        ws = Workspace(spark, "test")
        write_warc(spark, d, ws.path + "/a", ws=ws)
        got = read_warc(spark, ws.path + "/a", payload=True, ws=ws).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((int(x.record_id[12:-1]), x.uri, bytes(x.payload).decode()) for x in got) == rows


def record(version, n, body, extra=b""):
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{n}>\r\n".encode() + extra + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("block", ["700", "100m"])
def test_warc_versions_and_gzip(spark, tmp_path, block):
    """Records of both versions, plain and compressed one by one, as crawls have them."""
    import gzip

    from tidewell.llm.warc import read_warc

    inner = record("1.0", 98, b"zz")
    bodies = {n: (b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + n % 26]) * (n * 37 % 900)) + (inner if n % 5 == 0 else b"") for n in range(1, 40)}
    (tmp_path / "a.warc").write_bytes(b"".join(record("1.0" if n % 3 else "1.1", n, x) for n, x in bodies.items() if n < 20))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record("1.0", n, x)) for n, x in bodies.items() if n >= 20))
    (tmp_path / "c.warc").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = read_warc(spark, str(tmp_path), payload=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {int(x.record_id[12:-1]): bytes(x.payload) for x in got} == bodies and len(got) == len(bodies)


def test_warc_gzip_round_trip(spark):
    from tidewell.llm._shared import Workspace
    from tidewell.llm.warc import read_warc, write_warc

    ws = Workspace(spark, "test")
    d = spark.createDataFrame([(i, "u", INNER * (i % 3) + "é" * i) for i in range(30)], "page_id long, url string, html string").repartition(2)
    write_warc(spark, d, ws.path + "/a", ws=ws, compression="gzip")
    got = {int(x.record_id[12:-1]): bytes(x.payload).decode() for x in read_warc(spark, ws.path + "/a", payload=True, ws=ws).collect()}
    assert got == {x.page_id: x.html for x in d.collect()}


@pytest.mark.parametrize("harm", ["torn", "length", "front", "no archive"])
def test_warc_broken_chains_are_errors(spark, tmp_path, harm):
    from tidewell.llm.warc import read_warc

    good = [record("1.1", n, b"x" * 50) for n in range(6)]
    bad = {
        "torn": b"".join(good)[:-30], "length": b"".join([*good[:3], good[3].replace(b"Length: 50", b"Length: 49"), *good[4:]]), "front": b"junk" + b"".join(good), "no archive": b"some text\n" * 9
    }[harm]
    (tmp_path / "good.warc").write_bytes(b"".join(good))
    (tmp_path / "bad.warc").write_bytes(bad)
    with pytest.raises(ValueError, match="bad.warc at byte"):
        read_warc(spark, str(tmp_path))
    rows = read_warc(spark, str(tmp_path), strict=False).collect()
    assert sum(x.file.endswith("good.warc") for x in rows) == 6


def test_warc_revisits_are_held_against_their_response(spark):
    from tidewell.llm.warc import resolved

    fields = "type string, record_id string, refers_to string, declared string, full_bytes long, bytes long, digest string"
    rows = [
        ("response", "r1", None, "sha1:aa", 5, 5, "aa"), ("revisit", "r2", "r1", "sha1:aa", 5, 0, "00"), ("revisit", "r3", "r1", "sha1:bb", 5, 0, "00"), ("revisit", "r4", "gone", "sha1:aa", 5, 0, "00"),
    ]
    got = {x.record_id: (x.payload_bytes, x.payload_digest, x.agrees) for x in resolved(spark.createDataFrame(rows, fields)).collect()}
    assert got == {"r1": (5, "aa", True), "r2": (5, "aa", True), "r3": (None, None, False), "r4": (None, None, False)}


def test_warc_empty_and_null_ids(spark, tmp_path):
    from tidewell.llm.warc import op5_warc

    schema = "page_id long, url string, html string, digest string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/e/pages.parquet")
    assert op5_warc(spark, f"{tmp_path}/e").count() == 0
    rows = [(None, "u", "b" * 2000, "x"), (5, "u", "b" * 2000, "x"), (5, "u", "b" * 2000, "x"), (6, "u", "é" * 499, "x"), (7, "u", "é" * 499, "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/n/pages.parquet")
    got = sorted((x.page_id or -1, x.record_type, x.refers_to or -1, x.payload_bytes) for x in op5_warc(spark, f"{tmp_path}/n").collect())
    assert got == [(-1, "revisit", 5, 2000), (5, "response", -1, 2000), (5, "response", -1, 2000), (6, "response", -1, 998), (7, "response", -1, 998)]


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tidewell.llm.tokens import codec

    return codec(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def test_fast_codec_agrees_on_every_character(tokenizer):
    for cp in range(0x250):
        c = chr(cp)
        for t in (f"a{c}b {c} 1{c}2  {c}\n{c}{c}x 's{c}", c, f" {c}", f"{c} {c}{c}  z", f"{c}'s {c}'ll"):
            assert tokenizer.fast.encode(t, allowed_special="all") == tokenizer.library.encode(t, add_special_tokens=False).ids


def test_long_texts_splice_exactly(tokenizer):
    from tidewell.llm.tokens import long_ids

    r = random.Random(1)
    for _ in range(150):
        kind = r.choice(["ab 1\n'", "日本 語a", "a", " ", "a1 .,'s\n\t  é", "xyz", "a  b ", "don't a'll "])
        t = "".join(r.choice(kind) for _ in range(r.randint(1, 2500)))
        if r.random() < 0.2:
            t = " ".join(r.choice(["<|endoftext|>", "a", "bc", "the"]) for _ in range(600))
        whole = tokenizer.library.encode(t, add_special_tokens=False).ids
        assert long_ids(tokenizer, t, r.choice([50, 200, 500]), r.choice([10, 40]), r.choice([2, 8])) == whole


@pytest.mark.parametrize("text", ["日本語文書処理" * 4300, "日本語、文書。処理" * 3300, "1234567890" * 3000, "if(x[i]>=y){z+=1;}" * 1700, "x" * 30_000, " \n" * 15_000, "=-" * 15_000, "don't" * 6000, "Ωμέγα" * 6000])
def test_texts_without_spaces_are_not_encoded_whole(tokenizer, text, monkeypatch):
    from tidewell.llm.tokens import Codec, long_ids

    whole = tokenizer.library.encode(text, add_special_tokens=False).ids
    seen = []
    spans = Codec.spans
    monkeypatch.setattr(Codec, "spans", lambda self, t: seen.append(len(t)) or spans(self, t))
    assert long_ids(tokenizer, text, 2000, 400) == whole
    assert max(seen) <= 4000 and sum(seen) < 3 * len(text)


def test_boundaries_inside_words_are_proven_pair_by_pair(tokenizer):
    """Chunks of single words and digits: every splice lies inside a piece."""
    from tidewell.llm.tokens import long_ids

    r = random.Random(2)
    for _ in range(120):
        kind = r.choice(["abcdefgh", "aab", "0123456789", "日本語文書処理", "!?-=", "тексты", "e\u0301a", "的一是不了", "\n\t ", "aéß"])
        t = "".join(r.choice(kind) for _ in range(r.randint(200, 3000)))
        whole = tokenizer.library.encode(t, add_special_tokens=False).ids
        assert long_ids(tokenizer, t, r.choice([60, 200]), r.choice([20, 60]), r.choice([1, 2, 8])) == whole


def test_op7_on_documents_against_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    import os

    from tokenizers import Tokenizer

    from tidewell.llm.tokens import op7_token_counts

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: len(e.ids) for i, e in zip(docs, t.encode_batch(list(docs.values()), add_special_tokens=False), strict=True)}
    got = op7_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((x.n_bytes, x.n_tokens, x.over_limit) == (len(docs[x.doc_id].encode()), want[x.doc_id], want[x.doc_id] > 1024) for x in got)


def test_token_counts_edges(spark):
    P = pytest.importorskip("public_tokenizers")
    from tidewell.llm.tokens import token_counts

    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "hello world", 0), (4, "日本", 0), (4, "日本", 0), (5, "<|endoftext|>", 0)], "doc_id long, text string, n_tokens int")
    got = sorted((x.doc_id or -1, x.n_bytes, x.n_tokens, x.over_limit) for x in token_counts(spark, d, P.path("byte_bpe_50k.json"), limit=1).collect())
    assert got[0] == (-1, 11, 2, True) and got[1] == (1, 0, 0, False) and got[2] == (2, 0, 0, False) and got[-1] == (5, 13, 1, False)
    assert token_counts(spark, d.limit(0), P.path("byte_bpe_50k.json")).count() == 0
