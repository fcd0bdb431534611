import math
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import values as V


def one(spark, e):
    return spark.range(1).select(e.alias("v")).first().v


ts = lambda s: F.lit(s).cast("timestamp")


@pytest.mark.parametrize(
    "make, expected",
    [
        (lambda: V.half_up(F.lit(-2.5)), -2.0),
        (lambda: V.half_up(F.lit(2.25), 1), 2.3),
        (lambda: V.equal(F.lit(None), F.lit(None)), True),
        (lambda: V.less(F.lit(None).cast("int"), F.lit(1)), False),
        (lambda: V.truthy(F.lit(""), "string"), False),
        (lambda: V.truthy(F.array(), "array"), False),
        (lambda: V.truthy(F.lit(float("nan")), "number"), False),
        (lambda: V.divide(F.lit(1.0), F.lit(0.0)), None),
        (lambda: V.remainder(F.lit(7), F.lit(0)), None),
        (lambda: V.first_number(F.lit("rev -12.5b")), -12.5),
        (lambda: V.fold(F.lit("Tàu Đỏ É")), "tau do e"),
        (lambda: V.contains(F.array(F.lit("abc"), F.lit("d")), F.lit("b"), "array"), True),
        (lambda: V.econtains(F.array(F.lit("abc"), F.lit("d")), F.lit("b"), "array"), False),
        (lambda: V.regexmatch("a.c", F.lit("abcd")), False),
        (lambda: V.regextest("(", F.lit("a")), False),
        (lambda: V.pad_left(F.lit("abc"), 2), "abc"),
        (lambda: V.pad_right(F.lit("a"), 3, "-"), "a--"),
        (lambda: V.truncate(F.lit("abcdefgh"), 5), "abcde..."),
        (lambda: V.title(F.lit("a\tbig\nword")), "A\tBig\nWord"),
        (lambda: V.fold(F.lit("Łódź й Ά")), "łodz и α"),
        (lambda: V.relative(ts("2026-11-25"), ts("2026-11-09")), "in 2 weeks"),
        (lambda: V.relative(ts("2026-11-09 00:00:20"), ts("2026-11-09")), "just now"),
        (lambda: V.kind_name(V.link(F.lit("a"))), "link"),
        (lambda: V.view_list_sum(F.array().cast("array<double>")), 0.0),
        (lambda: V.extreme([F.lit(3), F.lit("a"), F.lit(None).cast("string")], ["number", "string", "string"])["n"], 3.0),
        (lambda: V.extreme([F.lit(3), F.lit("a")], ["number", "string"], greatest=True)["s"], "a"),
        (lambda: V.as_number(F.lit(" 2.5 "), "string"), 2.5),
        (lambda: V.escape_html(F.lit("<a & 'b'>")), "&lt;a &amp; &#39;b&#39;&gt;"),
        (lambda: V.has_property(F.create_map(F.lit("Due"), F.lit("x")), "due"), True),
        (lambda: V.natural_key(F.lit("a" + "1" * 21)) < V.natural_key(F.lit("a" + "1" * 20 + "2")), True),
        (lambda: V.title(F.lit("some BIG word")), "Some BIG Word"),
        (lambda: F.date_format(V.view_plus(ts("2026-01-31 10:00:00"), months=1), "yyyy-MM-dd HH:mm"), "2026-02-28 10:00"),
        (lambda: F.date_format(V.date_word("sow", ts("2026-11-12 10:00:00")), "yyyy-MM-dd"), "2026-11-09"),
        (lambda: F.date_format(V.date_word("eom", ts("2026-02-12 10:00:00")), "yyyy-MM-dd HH:mm:ss"), "2026-02-28 23:59:59"),
        (lambda: V.date_part(ts("2026-11-09"), "weekday"), 1),
        (lambda: V.dateformat(ts("2026-11-09 15:04:00"), "cccc d LLLL yyyy 'at' HH:mm"), "Monday 9 November 2026 at 15:04"),
        (lambda: V.view_format(ts("2026-11-09 15:04:00"), "dddd DD/MM/YYYY [o'clock] h A"), "Monday 09/11/2026 o'clock 3 PM"),
        (lambda: V.relative(ts("2026-11-07"), ts("2026-11-09")), "2 days ago"),
        (lambda: V.list_sum(F.array(F.lit(1.0), F.lit(None))), 1.0),
        (lambda: V.list_mean(F.array().cast("array<double>")), None),
        (lambda: V.list_slice(F.array(F.lit(1), F.lit(2), F.lit(3)), -2), [2, 3]),
        (lambda: V.item(F.array(F.lit(1), F.lit(2)), 5), None),
        (lambda: V.shown(F.lit(3.0), "number"), "3"),
        (lambda: V.shown(F.array(F.lit("a"), F.lit(None)), "array"), "a, "),
    ],
)
def test_semantics(spark, make, expected):
    assert one(spark, make()) == expected


def test_durations():
    assert V.duration_ms("7 days") == 7 * V.DAY_MS
    assert V.duration_ms("1h 30m") == 90 * 60_000
    assert V.duration_ms("1 month") == 30 * V.DAY_MS
    with pytest.raises(ValueError):
        V.duration_ms("soon")


def test_natural_order(spark):
    names = ["Rev 10", "rev 2", "Rév 2b", "a", "B", "item 007", "item 7"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(V.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "B", "item 007", "item 7", "rev 2", "Rév 2b", "Rev 10"]


def test_mixed_values_sort_like_a_plain_evaluator(spark):
    rng = random.Random(3)
    raw = [rng.choice(["", None, "true", "False", "12", "-3.5", "007", "2026-01-05", "2025-12", "text", "Zed", str(rng.randint(0, 99))]) for _ in range(200)]

    def key(s):
        s = None if s is None else s.strip()
        if not s:
            return (0,)
        if s.lower() in ("true", "false"):
            return (1, s.lower() == "true")
        try:
            if not (s[0] == "0" and len(s) > 1 and s[1].isdigit()):
                return (2, float(s)) if "-" not in s[1:] else (4, s if len(s) > 7 else s + "-01")
        except ValueError:
            pass
        return (3, s)

    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string")
    got = [r.s for r in df.orderBy(V.from_text(F.col("s")), "i").collect()]
    want = [s for _, s in sorted(enumerate(raw), key=lambda x: (key(x[1]), x[0]))]
    assert [key(s) for s in got] == [key(s) for s in want]


def test_no_nan_in_half_up(spark):
    assert not math.isnan(one(spark, V.half_up(F.lit(0.49999999))))


def test_links_kinds_and_slices(spark):
    df = spark.createDataFrame([("Notes/A#Part", "abcdef", ["x", None], 5), (None, None, None, None)], "target string, s string, l array<string>, n int")
    got = df.select(
        V.link(F.col("target"), F.lit("shown")).alias("link"), V.text_slice(F.col("s"), -2).alias("tail"), V.text_slice(F.col("s"), 1, -1).alias("inner"), V.text_slice(F.col("s"), 4, 2).alias("none"),
        V.kind_name(F.col("n")).alias("kind"), V.is_empty(F.col("l"), "array").alias("empty"), V.index_of(F.col("l"), F.lit("x")).alias("at"), V.index_of(F.col("l"), F.lit("y")).alias("no"),
        V.contains_all(F.col("s"), [F.lit("a"), F.lit("f")]).alias("all"), V.contains_any(F.col("l"), [F.lit("q"), F.lit("x")], "array").alias("any"), V.link_date(F.lit("log/2026-11-09 day.md")).alias("day"),
    ).collect()
    a, b = got
    assert (a.link.path, a.link.subpath, a.link.display) == ("Notes/A", "Part", "shown") and b.link.path is None
    assert (a.tail, a.inner, a.none, b.tail) == ("ef", "bcde", "", None)
    assert (a.kind, b.kind, a.empty, b.empty, a.at, a.no, b.at) == ("number", "null", False, True, 0, -1, -1)
    assert a.all and a.any and not b.all and not b.any and str(a.day)[:10] == "2026-11-09"
