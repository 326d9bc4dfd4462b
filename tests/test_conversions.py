"""Reports on files, replayed in batches: each file ends once, failed ones are tried again, ended ones are forgotten."""

from __future__ import annotations

from longleaf.streaming import conversions


def reports(spark, folder, rows):
    d = spark.createDataFrame([(i, s, t, at) for i, s, t, at in rows], "doc_id string, state string, text string, at string").selectExpr("doc_id", "state", "text", "timestamp(at) at")
    d.coalesce(1).write.mode("append").parquet(folder)


def run(spark, where, **ways):
    stream = spark.readStream.schema(conversions.REPORT).parquet(where[0])
    q = conversions.follow(stream, where[1], where[2], late="0 seconds", **ways)
    q.awaitTermination()
    return q


def seen(spark, where):
    return sorted((r["doc_id"], str(r["at"])[11:19], r["status"], r["tries"], r["text"]) for r in spark.read.parquet(where[1]).collect())


def test_files_end_once(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    reports(spark, where[0], [
        ("a", "pending", None, "2024-01-01 00:00:00"), ("a", "running", None, "2024-01-01 00:01:00"), ("a", "done", "text a", "2024-01-01 00:02:00"), ("a", "done", "again", "2024-01-01 00:03:00"),
        ("b", "failed", None, "2024-01-01 00:00:00"), ("c", "done", "", "2024-01-01 00:01:00"), ("d", "running", None, "2024-01-01 00:00:30"), (None, "done", "x", "2024-01-01 00:00:00"),
    ])
    run(spark, where)
    first = [("a", "00:00:00", "running", 0, None), ("a", "00:02:00", "done", 0, "text a"), ("b", "00:00:00", "again", 1, None), ("c", "00:01:00", "again", 1, None), ("d", "00:00:30", "running", 0, None)]
    assert seen(spark, where) == first
    reports(spark, where[0], [("a", "done", "late", "2024-01-01 00:05:00"), ("b", "running", None, "2024-01-01 00:05:00"), ("b", "done", "text b", "2024-01-01 00:06:00"), ("c", "failed", None, "2024-01-01 00:05:00"), ("c", "failed", None, "2024-01-01 00:06:00"), ("c", "done", "too late", "2024-01-01 00:07:00")])
    run(spark, where)
    second = [("b", "00:05:00", "running", 1, None), ("b", "00:06:00", "done", 1, "text b"), ("c", "00:05:00", "again", 2, None), ("c", "00:06:00", "failed", 3, None)]
    assert seen(spark, where) == sorted(first + second)
    reports(spark, where[0], [("e", "running", None, "2024-01-01 00:45:00")])
    run(spark, where)
    reports(spark, where[0], [("e", "done", "text e", "2024-01-01 00:46:00")])
    run(spark, where)
    assert ("d", "00:30:30", "timed out", 0, None) in seen(spark, where)
    assert {(r["doc_id"], r["status"]) for r in conversions.ended(spark, where[1]).collect()} == {("a", "done"), ("b", "done"), ("c", "failed"), ("d", "timed out"), ("e", "done")}


def test_what_has_ended_is_forgotten(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    reports(spark, where[0], [(f"f{i}", "done", "x", "2024-01-01 00:00:00") for i in range(30)])
    run(spark, where, keep=60)
    reports(spark, where[0], [("z", "running", None, "2024-01-01 00:30:00")])
    run(spark, where, keep=60)
    reports(spark, where[0], [("z", "running", None, "2024-01-01 00:31:00")])
    q = run(spark, where, keep=60)
    rows = q.lastProgress["stateOperators"][0]
    assert rows["numRowsTotal"] <= 6 and conversions.ended(spark, where[1]).count() == 30


def test_files_share_state_and_timers(spark, tmp_path):
    """Many files are few rows of state, each by its own reports: as many calls to the state store as there are shares."""
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    reports(spark, where[0], [(f"f{i:03}", ("done", "failed", "running")[i % 3], "x" if i % 3 == 0 else None, f"2024-01-01 00:00:{i % 60:02}") for i in range(300)])
    run(spark, where, shares=4, keep=600)
    reports(spark, where[0], [(f"f{i:03}", "done", f"t{i}", "2024-01-01 00:10:00") for i in range(1, 150, 3)])
    q = run(spark, where, shares=4, keep=600)
    assert q.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 4 * 3
    for at in ("00:45:00", "01:30:00", "01:31:00"):
        reports(spark, where[0], [("z", "done", "z", f"2024-01-01 {at}")])
        q = run(spark, where, shares=4, keep=600)
    got = {r[0]: r[1:] for r in seen(spark, where) if r[2] in conversions.ENDS and r[0] != "z"}
    want = {}
    for i in range(300):
        second = i % 60
        ended = {0: (f"00:00:{second:02}", "done", 0, "x"), 1: ("00:10:00", "done", 1, f"t{i}") if i < 150 else (f"00:30:{second:02}", "timed out", 1, None), 2: (f"00:30:{second:02}", "timed out", 0, None)}
        want[f"f{i:03}"] = ended[i % 3]
    assert got == want and len([r for r in seen(spark, where) if r[2] in conversions.ENDS and r[0] != "z"]) == 300
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_times_do_not_follow_the_session(spark, tmp_path):
    """In a session of another time zone a file times out as late after its report as in any."""
    where = [str(tmp_path / x) for x in ("in", "out", "check")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for at in ("00:00:00", "00:10:00", "00:20:00", "01:00:00", "02:00:00"):
            reports(spark, where[0], [("a" if at == "00:00:00" else "z", "running", None, f"2024-01-01 {at}")])
            run(spark, where)
            if at == "00:20:00":
                assert not spark.read.parquet(where[1]).where("status = 'timed out'").count()
        got = spark.read.parquet(where[1]).where("doc_id = 'a'").selectExpr("date_format(at, 'HH:mm:ss')", "status")
        assert sorted(map(tuple, got.collect())) == [("00:00:00", "running"), ("00:30:00", "timed out")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
