"""Late rows, watermarks and sessions on hand-made streams."""

import datetime

from tidewell.streaming import queries as S

BASE = datetime.datetime(2024, 1, 1)


def events(spark, path, batches):
    for i, rows in enumerate(batches):
        d = [(n, BASE + datetime.timedelta(minutes=m), u, "click", 1.0, "{}") for n, m, u in rows]
        spark.createDataFrame(d, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def test_sessions_close_by_watermark(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (2, 20, 1), (3, 70, 1), (4, 0, 2)], [(5, 1000, 9)]])
    got = {(x.user_id, (x.session_start - BASE).seconds // 60, x.n) for x in S.user_sessions(spark, path).collect()}
    assert got == {(1, 0, 2), (1, 70, 1), (2, 0, 1)}  # the last user's session is still open


def test_open_sessions_are_given_too(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (2, 20, 1), (3, 70, 1), (4, 0, 2)], [(5, 1000, 9)]])
    got = {(x.user_id, (x.session_start - BASE).seconds // 60, x.n) for x in S.all_sessions(spark, path).collect()}
    assert got == {(1, 0, 2), (1, 70, 1), (2, 0, 1), (9, 1000, 1)}


def test_repeats_are_dropped_within_the_watermark(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (1, 5, 1), (2, 6, 1)]])
    assert sorted(x.event_id for x in S.distinct_events(spark, path).collect()) == [1, 2]


def test_late_rows_are_dropped_and_less_late_ones_are_not(spark, tmp_path):
    """One file a micro-batch: the third one's rows meet the watermark that the first has left."""
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (2, 300, 1)], [(6, 302, 1)], [(3, 10, 1), (4, 295, 1), (5, 301, 2)]])
    got = {((x.window_start - BASE).seconds // 3600, x.n) for x in S.hourly(spark, path, files=1).collect()}
    assert got == {(0, 1), (4, 1), (5, 3)}  # minute 10 is 290 minutes late; minute 295 lies in an hour that is still open
    assert {((x.window_start - BASE).seconds // 3600, x.n) for x in S.hourly(spark, path).collect()} == {(0, 2), (4, 1), (5, 3)}


def test_many_micro_batches_give_what_one_gives(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (2, 1, 2)], [(3, 2, 1), (3, 2, 1)], [(5, 3, 3), (6, 4, 1)]])
    assert {(x.user_id, x.n) for x in S.user_totals(spark, path, files=1).collect()} == {(1, 4), (2, 1), (3, 1)}
    assert {(x.window_start, x.n) for x in S.hourly(spark, path, files=1).collect()} == {(BASE, 6)}
    assert sorted(x.event_id for x in S.distinct_events(spark, path, files=1).collect()) == [1, 2, 3, 5, 6]
    assert {(x.user_id, x.n) for x in S.all_sessions(spark, path, files=1).collect()} == {(1, 4), (2, 1), (3, 1)}


def test_empty_stream(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[]])
    assert S.user_totals(spark, path).count() == 0


def test_own_state_counts_over_files(spark, tmp_path):
    path = events(spark, tmp_path / "e", [[(1, 0, 1), (2, 1, 1)], [(3, 2, 1), (4, 3, 2)]])
    assert {(x.user_id, x.n) for x in S.user_totals(spark, path).collect()} == {(1, 3), (2, 1)}


def _events(spark, rows):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    return spark.createDataFrame([(i, at(m), u, k) for i, (m, u, k) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string")


def test_timers_close_sessions_and_free_their_state(spark, tmp_path):
    """Rows out of order in two parts; each part is a run of its own that starts from the checkpoint; at the end no state is left."""
    import datetime

    at = f"file://{tmp_path}/stream"
    first = _events(spark, [(50, 1, "a"), (0, 1, "a"), (20, 1, "a"), (0, 2, "a")])
    second = _events(spark, [(75, 1, "a"), (200, 1, "a"), (45, 2, "a")])
    got = lambda d: {(x.user_id, (x.session_start - datetime.datetime(2024, 1, 1)).total_seconds() / 60, x.n) for x in d.collect()}
    part = got(S.timed_sessions(spark, [first, second], at))
    assert part <= {(1, 0, 2), (1, 50, 2), (1, 0, 4), (2, 0, 1), (2, 45, 1)}
    out = S.timed_sessions(spark, S.closing(first), at)
    # from 0 to 20, 50 and 75 every step is below 30 minutes but the one from 20 to 50
    assert got(out) == {(1, 0, 2), (1, 50, 2), (1, 200, 1), (2, 0, 1), (2, 45, 1)}
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{at}/state")
    assert state.count() == 0


def test_clicks_without_purchase_come_out_when_their_hour_has_passed(spark, tmp_path):
    path = f"file://{tmp_path}/e.parquet"
    _events(spark, [(0, 1, "click"), (10, 1, "purchase"), (20, 1, "click"), (100, 1, "purchase"), (5, 2, "click"), (65, 2, "purchase"), (200, 3, "click"), (7, 4, "purchase")]).write.parquet(path)
    got = sorted((x.user_id, x.click_id, x.purchase_id) for x in S.purchases_after_clicks_or_none(spark, path).collect() if x.purchase_id is not None)
    alone = sorted((x.user_id, x.click_id) for x in S.purchases_after_clicks_or_none(spark, path).collect() if x.purchase_id is None)
    assert got == [(1, 0, 1), (2, 4, 5)] and alone == [(1, 2), (3, 6)]
