"""Queries over whole tables, against counts made in Python."""

import math
import statistics
from collections import Counter

import pytest

from tidewell import catalog
from tidewell.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pairs(spark):
    c = Counter((x.c_nationkey, math.floor(x.c_acctbal / 100)) for x in table(spark, SF, "customer").collect())
    s = Counter((x.s_nationkey, math.floor(x.s_acctbal / 100)) for x in table(spark, SF, "supplier").collect())
    return c, s


@pytest.mark.parametrize(
    "name, want",
    [
        ("union", lambda c, s: Counter(set(c) | set(s))),
        ("union_all", lambda c, s: c + s),
        ("intersect", lambda c, s: Counter(set(c) & set(s))),
        ("intersect_all", lambda c, s: c & s),
        ("except", lambda c, s: Counter(set(c) - set(s))),
        ("except_all", lambda c, s: c - s),
    ],
)
def test_set_operations_hold_every_row(spark, pairs, name, want):
    got = Counter((x.k, x.hundreds) for x in catalog.queries()[f"set_{name}"](spark, SF).collect())
    assert got and got == want(*pairs)


@pytest.mark.parametrize("kind", ["left", "right", "full"])
def test_outer_joins_hold_every_row(spark, kind):
    dates = {x.o_orderkey: x.o_orderdate for x in table(spark, SF, "orders").collect()}
    lines = [(x.l_orderkey, x.l_partkey, x.l_suppkey, x.l_linenumber, x.l_shipdate) for x in table(spark, SF, "lineitem").collect()]
    want = Counter((x[0], *x[:4]) for x in lines if x[4] > dates[x[0]])
    met = {x[0] for x in want}
    alone = [Counter((o, None, None, None, None) for o in dates if o not in met), Counter((None, *x[:4]) for x in lines if x[4] <= dates[x[0]])]
    assert all(alone)
    want = sum(alone[:1] if kind == "left" else alone[1:] if kind == "right" else alone, want)
    assert Counter(map(tuple, catalog.queries()[f"join_{kind}_outer"](spark, SF).collect())) == want


def test_spread_is_of_all_events(spark):
    got = {x.event_type: x for x in catalog.queries()["agg_spread"](spark, SF).collect()}
    events = table(spark, SF, "events").collect()
    assert set(got) == {x.event_type for x in events}
    for kind, x in got.items():
        value, user = [e.value for e in events if e.event_type == kind], [e.user_id for e in events if e.event_type == kind]
        assert x.sd == pytest.approx(statistics.stdev(value), abs=2e-6) and x.vp == pytest.approx(statistics.pvariance(value), abs=2e-5)
        assert x.r == pytest.approx(statistics.correlation(value, user), abs=2e-6)
        parity = Counter(u % 2 for u in user)
        assert x.parity == min(k for k, n in parity.items() if n == max(parity.values()))


def test_repeated_lines_leave_the_documents(spark):
    from tidewell.operators.text import without_repeated_lines

    d = spark.createDataFrame([(2, "b\na\n\nc"), (1, "a\n\nb\na\n"), (3, "a\nb"), (4, None), (5, "")], "doc_id long, text string")
    assert {x.doc_id: x.kept for x in without_repeated_lines(d).collect()} == {1: "a\n\nb\n", 2: "\nc", 3: "", 4: None, 5: ""}


def test_sketches_keep_to_their_error_bounds(spark):
    """HyperLogLog (2^12 cells: 1.6 % a standard error) within 6 %, KLL and approximate percentiles within 2 % of ranks."""
    e = table(spark, SF, "events").collect()
    got = catalog.queries()["agg_approximate"](spark, SF).first()
    users = len({x.user_id for x in e})
    assert abs(got.users - users) <= 0.06 * users
    days = {}
    for x in e:
        days.setdefault(x.ts.date(), []).append(x.value)
    assert got.highest_median == max(sorted(v)[(len(v) - 1) // 2] for v in days.values())  # 1,000 cells hold a whole day
    for x in catalog.queries()["agg_approximate_quantiles"](spark, SF).collect():
        values = sorted(y.value for y in e if y.event_type == x.event_type)
        assert abs(sum(v <= x.median for v in values) / len(values) - 0.5) <= 0.02
    top = catalog.queries()["agg_approximate_top_k"](spark, SF).first().top
    assert [(t.item, t["count"]) for t in top] == Counter(y.event_type for y in e).most_common(3)


def test_text_of_html(spark):
    from tidewell.operators.text import html_text

    pages = ["<p>One <b>two</b></p>", "<script>var x = '<p>no</p>';</script>a<style>b{}</style>c", None, "", "plain &amp; simple", "<div>un<br>closed", "<!-- note --><h1> T </h1>"]
    d = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    assert [x.t for x in d.select("i", html_text("html").alias("t")).orderBy("i").collect()] == ["One two", "a c", None, "", "plain & simple", "un closed", "T"]


def test_masks(spark):
    from tidewell.operators.text import mask_all_personal, mask_licences

    texts = ["mail a.b@c.de or +1 (017) 555-7713", "2001:0db8:85a3:0000:0000:8a2e:0370:7334 and 10.0.0.1", "DE89 3704 0044 0532 0130 00, 4263429643439180 x", "order 12345", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [x.masked for x in mask_all_personal(d).orderBy("i").collect()] == ["mail <EMAIL> or <PHONE>", "<IP> and <IP>", "<IBAN>, <CARD> x", "order 12345", None]
    lines = spark.createDataFrame([("a\nReleased under the MIT License.\n\nb",), ("copyright 2024 x",), (None,), ("licensing",)], "text string")
    assert [x.masked for x in mask_licences(lines).collect()] == ["a\n<LICENCE>\n\nb", "<LICENCE>", None, "licensing"]
