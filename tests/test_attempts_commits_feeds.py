"""Row errors, batches of edits, quiet change feeds."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillstone.functions import attempts as A
from quillstone.functions import coerce as C
from quillstone.functions import values as V
from quillstone.operators import edits as E
from quillstone.streaming import incremental as I


def test_errors_become_null_and_the_first_is_told(spark):
    rows = [("b", 1.0, 0.0, "x"), ("a", 4.0, 2.0, "2024-02-30"), ("c", None, 0.0, None), ("d", 9.0, 3.0, "2024-02-29")]
    df = spark.createDataFrame(rows, "path string, x double, y double, s string")
    ratio = A.divided(F.col("x"), F.col("y"))
    done = A.with_attempts(df, ratio=ratio, more=A.then(lambda r: A.divided(r, F.col("y") - 2), ratio))
    done = A.with_attempts(done, day=A.day(F.col("s")), n=A.cast(F.lit("7"), "int"), third=A.element(F.array(F.lit(1), F.lit(2)), F.when(F.col("path") == "d", 2).otherwise(1)))
    got = {r.path: r for r in done.collect()}
    assert got["d"].ratio == 3.0 and got["d"].more == 3.0 and got["c"].ratio is None and got["c"][A.ERRORS] == [] and got["d"].n == 7
    assert got["a"][A.ERRORS] == ["division by zero", "not a date: 2024-02-30"] and got["a"].ratio == 2.0 and got["a"].more is None
    assert got["b"][A.ERRORS] == ["division by zero", "division by zero", "not a date: x"] and got["d"][A.ERRORS] == ["no element 2"]
    assert A.first_warning(done.where("path <> 'a'"), F.col("path")).first() == ("division by zero", 2)
    shown, seen = A.observed(done, F.col("path"))
    assert A.ERRORS not in shown.columns and shown.count() == 4
    assert seen.get == {"warning": "division by zero", "failed": 3}
    assert A.first_warning(done.where("path = 'c'"), F.col("path")).first() == (None, 0)


def test_stale_edits_come_back(spark):
    notes = spark.createDataFrame([("a", "old a", 1), ("b", "old b", 2), ("c", "old c", 3)], "path string, text string, version int")
    rows = [("a", 1, "new a", 1, False), ("a", 2, "other a", 1, False), ("a", 3, "new a", 1, None), ("b", 1, "stale", 1, False), ("b", 2, "old b", 1, False), ("c", 1, "x", 3, False), ("c", 2, "forced", 0, True), ("c", 3, "last", 0, True), ("gone", 1, "back", 5, False), ("none", 1, "any", None, False)]
    done = E.committed(notes, spark.createDataFrame(rows, "path string, seq int, text string, base int, force boolean"))
    assert {(r.path, r.seq): (r.outcome, r.theirs) for r in done.collect()} == {
        ("a", 1): ("written", None), ("a", 2): ("conflict", "new a"), ("a", 3): ("same", None), ("b", 1): ("conflict", "old b"), ("b", 2): ("same", None),
        ("c", 1): ("conflict", "last"), ("c", 2): ("conflict", "last"), ("c", 3): ("written", None), ("gone", 1): ("created", None), ("none", 1): ("created", None),
    }
    after = E.after(notes, done, F.lit(9))
    assert {tuple(r) for r in after.collect()} == {("a", "new a", 9), ("b", "old b", 2), ("c", "last", 9), ("gone", "back", 9), ("none", "any", 9)}
    made = E.created(notes, spark.createDataFrame([("A", "x"), ("new", "y")], "path string, text string"))
    assert {(r.path, r.created) for r in made.collect()} == {("A", False), ("new", True)}


START = datetime(2024, 1, 1)
#: path, op, milliseconds.
BURSTS = [("a", "edited", 0), ("a", "edited", 300), ("a", "deleted", 900), ("b", "new", 100), ("a", "new", 2000), ("b", "edited", 799), ("b", "edited", 1500), ("f", "deleted", 50), ("c", "new", 5000)]


def plain_bursts(rows, quiet):
    out, open_ = set(), {}
    for path, op, ms in sorted(rows, key=lambda r: r[2]):
        if path in open_ and ms - open_[path][1] < quiet:
            open_[path] = (op, ms, open_[path][2] + 1)
        else:
            out |= {(path, *open_[path])} if path in open_ else set()
            open_[path] = (op, ms, 1)
    return out | {(p, *v) for p, v in open_.items()}


def test_a_path_comes_out_after_its_burst(spark, tmp_path):
    """A stream by its events' times, with bursts across batches, as the plain version and the table."""
    frame = lambda rows: spark.createDataFrame([(p, o, START + timedelta(milliseconds=m)) for p, o, m in rows], "path string, op string, ts timestamp")
    ms = lambda r: (r.path, r.op, round((r.last - START).total_seconds() * 1000), r.n)
    want = plain_bursts(BURSTS, 700)
    assert {ms(r) for r in I.quiet_changes(frame(BURSTS)).collect()} == want
    source = str(tmp_path / "in")
    frame([]).write.parquet(source)
    stream = spark.readStream.schema("path string, op string, ts timestamp").parquet(source)
    q = I.quiet_changes(stream, late="5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for part in (BURSTS[:5], BURSTS[5:8], BURSTS[8:], [("end", "new", 60_000)], [("end", "new", 90_000)]):
            frame(part).coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
        assert {ms(r) for r in spark.table("bursts").collect() if r.path != "end"} == want
    finally:
        q.stop()


def test_a_live_feed_has_timers_and_folders_spread(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    frame = lambda rows: spark.createDataFrame([(p, o, START + timedelta(milliseconds=m)) for p, o, m in rows], "path string, op string, ts timestamp")
    frame([]).write.parquet(source)
    catalog = spark.createDataFrame([("f/x.md",), ("f/g/y.md",), ("e.md",)], "path string").cache()
    stream = spark.readStream.schema("path string, op string, ts timestamp").parquet(source)
    feed = I.quiet_feed(stream, 700)

    def put(batch, number):
        seen.extend((number, r.path, r.op) for r in I.spread(batch, catalog).collect())

    q = feed.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    try:
        frame(BURSTS[:4]).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.3)
        frame(BURSTS[4:8]).coalesce(1).write.mode("append").parquet(source)
        # No other change follows: the clock alone brings them out.
        end = time.time() + 90
        while time.time() < end and len({p for _, p, _ in seen}) < 5:
            time.sleep(0.2)
    finally:
        q.stop()
    last = {p: o for _, p, o in seen}
    assert last == {"a": "new", "b": "edited", "f": "deleted", "f/x.md": "deleted", "f/g/y.md": "deleted"}


def test_mixed_values(spark):
    row = spark.range(1).select(
        C.mixed_sum([F.lit(1.0), F.lit("a"), F.lit(2.5)], ["number", "string", "number"]).alias("a"), C.mixed_sum([F.lit(None).cast("double"), F.lit(2.0)], ["number", "number"]).alias("b"), C.mixed_sum([F.lit(None).cast("string")], ["string"]).alias("c"),
        C.view_equal(F.lit(None).cast("string"), "string", F.lit(None).cast("double"), "number").alias("d"), C.view_equal(F.lit(True), "boolean", F.lit("true"), "string").alias("e"),
        C.view_compare(F.lit(True), "boolean", F.lit(0.5), "number").alias("f"), C.view_compare(F.lit("n10"), "string", F.lit("n9"), "string").alias("g"), C.view_less(F.lit(None).cast("double"), "number", F.lit(1.0), "number").alias("h"),
        C.view_equal(V.link(F.lit("a/B.md")), "link", F.lit("A/b"), "string").alias("i"), E.expanded("<% tp.date.now('YYYY', -1) %>{{x}}", F.lit("t"), F.lit("2024-01-01 05:00:00").cast("timestamp")).alias("j"),
    ).first()
    assert tuple(row) == ("1a2.5", "2.0", None, True, False, 1, 1, False, True, "2023{{x}}")


def test_dates_of_kinds_and_canvas_references(spark):
    link = V.link(F.lit("days/2024-03-05.md"))
    row = spark.range(1).select(C.date_of(F.lit(86_400_000), "number").alias("a"), C.date_of(F.lit("2024-02-03T04:05"), "string").alias("b"), C.date_of(link, "link").alias("c"), C.date_of(F.lit("no"), "string").alias("d")).first()
    assert tuple(row) == (datetime(1970, 1, 2), datetime(2024, 2, 3, 4, 5), datetime(2024, 3, 5), None)
    text = r'{"file":"a\\b \"c\".md","x":"a\\b \"c\".md"}'
    moved = spark.range(1).select(E.canvas_moved(F.lit(text), F.lit(r'a\b "c".md'), F.lit(r'd\$1 "e".md')).alias("t")).first().t
    assert moved == r'{"file":"d\\$1 \"e\".md","x":"a\\b \"c\".md"}'
