import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.operators import layout as L
from quillstone.operators import search as S
from quillstone.operators import status as T
from quillstone.operators import views as VW
from quillstone.operators.rows import Rows
from quillstone.operators.search import Term
from quillstone.streaming import incremental as I


def test_steps_run_in_order(spark):
    df = spark.createDataFrame([(f"n{i}", i) for i in range(10)], "path string, v int")
    rows = Rows.of(df)
    assert [r.path for r in rows.sort(F.col("v").desc()).limit(3).where(F.col("v") < 9).table(path=F.col("path")).collect()] == ["n8", "n7"]
    assert rows.where(F.col("v") > 6).df.count() == 3
    groups = rows.group_rows("odd", F.col("v") % 2, "path").table(odd=F.col("odd"), n=F.size("rows")).collect()
    assert [(g.odd, g.n) for g in groups] == [(0, 5), (1, 5)]


def test_filter_tree_and_formula_cycle(spark):
    df = spark.createDataFrame([(1, True, None), (2, False, True), (3, None, None)], "i int, a boolean, b boolean")
    ids = lambda f: [r.i for r in df.where(VW.condition(f)).orderBy("i").collect()]
    assert ids({"not": [F.col("a"), F.col("b")]}) == [3]
    assert ids({"or": []}) == [1, 2, 3] and ids(None) == [1, 2, 3]
    assert ids([F.col("a") | F.col("b")]) == [1, 2]
    with pytest.raises(ValueError):
        VW.with_formulas(df, {"x": (lambda y: y, ("y",)), "y": (lambda x: x, ("x",))})


def test_search(spark):
    notes = spark.createDataFrame(
        [(1, "Engine/PW1133G-JM.md", "Task 29-11-00-710 for the\nblue   tank", ["a/b"]), (2, "Tau.md", "Tàu bay, nothing else", []), (3, "Third.md", "blue sky tank", ["a"])], "key int, path string, text string, tags array<string>"
    )
    index = S.postings(notes, "path")
    found = lambda *clauses, no=(): sorted(r.key for r in S.search(notes, index, list(clauses), list(no)).collect())
    assert found([Term("11-00")]) == [1] and found([Term("710")]) == [1] and found([Term("29-11")]) == [1]
    assert found([Term("tau")]) == [2] and found([Term("tàu")]) == [2]
    assert found([Term("blue tank", "phrase")]) == [1]
    assert found([Term("blue")], [Term("tan")]) == [1, 3]
    assert found([Term("blue")], no=[Term("sky")]) == [1]
    assert found([Term("sky"), Term("bay")]) == [2, 3]
    assert found([Term("133", "fragment")]) == [1]
    assert found([Term("a", field="tag")]) == [1, 3] and found([Term("third", field="title")]) == [3]
    assert found(no=[Term("blue")]) == [2] and found() == []


def test_words_over_the_limit_are_none(spark):
    notes = spark.createDataFrame([(1, "a" * 48), (2, "b" * 49), (3, "c-" + "d" * 47), (4, "x-ä ä-x x")], "key int, text string")
    index = S.settled(S.postings(notes))
    assert sorted((r.word, r.exact) for r in index.where("key < 4").collect()) == [("", True), ("", True), ("a" * 48, True)]
    assert sorted((r.word, r.exact) for r in index.where("key = 4").collect()) == sorted([("x-ä", True), ("ä-x", True), ("x", True), ("ä", True), ("x-a", False), ("a-x", False), ("a", False)])


def test_mentions_in_order_without_present_links(spark):
    texts = ["---\nx: Alpha\n---\nAlpha, alphabet [[Alpha]] `Alpha` #Alpha (alpha)", "none", "alpha alpha alpha", "alpha"]
    notes = spark.createDataFrame([(i, f"n/{'dcba'[i]}.md", t) for i, t in enumerate(texts)], "key int, path string, text string")
    assert [(r.key, r.mentions) for r in S.mentions(notes, ["Alpha", "no"]).collect()] == [(2, 3), (0, 2), (3, 1)]
    assert [r.key for r in S.mentions(notes, ["Alpha"], notes.where("key = 2")).collect()] == [0, 3]


# Lines as a vault's, with the numbers of the cases of the interface that this follows.
NOTE = """---
type: project
---
# Alpha

Project Alpha is *led* by [[Beta|the Beta team]]; budget 1,500 USD.
- first item
- second item: see 30-31-01

Nothing here.
Goal: **ship** in `Q3`."""


@pytest.mark.parametrize(
    "quote, near, verdict, lines",
    [
        ("led by the Beta team; budget 1500 usd", None, "close", (6, 6)), ("Project Alpha is led by the Beta team", None, "exact", (6, 6)), ("first item second item", None, "exact", (7, 8)),
        ("budget 1,700 USD", None, "not_supported", (6, 6)), ("goal ship in q3", 2, "not_supported", None), ("goal ship in q3", 10, "exact", (11, 11)), ("the board approved it", None, "not_supported", None),
        ("see 30-31-01 item second", None, "close", (8, 8)), ("budget is USD 1,500", None, "close", (6, 6)),
    ],
)
def test_quotations(spark, quote, near, verdict, lines):
    c = spark.range(1).select(S.quote_check(F.lit(NOTE), quote, near).alias("c")).first().c
    assert c.verdict == verdict
    if lines:
        assert (c["first"], c["last"]) == lines
    if "1,700" in quote:
        assert c.missing_numbers == ["1700"]


def plain_fuzzy(q, s):
    at, score, run = 0, 0.0, 0
    for i, c in enumerate(s):
        if at < len(q) and c == q[at]:
            run += 1
            score += run * 2 + (5 if i == 0 or s[i - 1] in " \t\n/_-" else 0)
            at += 1
        elif at < len(q):
            run = 0
    return score - len(s) * 0.05 if at == len(q) else None


def test_fuzzy(spark):
    names = ["Map of Content", "Compact", "none", "mo-c", "m.oc", "moc", "my own cat"]
    df = spark.createDataFrame([(f"a/{n}.md",) for n in names] + [("moc/x.md",)], "path string")
    got = {r.n: r.s for r in df.select(S.stem(F.col("path")).alias("n"), S.fuzzy_score(S.stem(F.col("path")), "moc").alias("s")).collect()}
    assert all(got[n] == (None if (w := plain_fuzzy("moc", n.lower())) is None else pytest.approx(w)) for n in names)
    assert got["moc"] == pytest.approx(2 + 5 + 4 + 6 - 0.15) and got["m.oc"] == pytest.approx(2 + 5 + 2 + 4 - 0.2)
    ranked = [r.path for r in S.fuzzy_open(df, "MOC", F.col("path") == "a/moc.md").collect()]
    score = lambda p: plain_fuzzy("moc", stem) + 10 if (stem := p.split("/")[-1][:-3].lower()) and plain_fuzzy("moc", stem) is not None else plain_fuzzy("moc", p.lower())
    paths = [p for p in [f"a/{n}.md" for n in names] + ["moc/x.md"] if score(p) is not None]
    assert ranked == sorted(paths, key=lambda p: (p == "a/moc.md", -score(p), p)) and ranked[-1] == "a/moc.md" and "moc/x.md" in ranked


@pytest.mark.parametrize(
    "fields, want",
    [
        ({"status": "superseded"}, "2"), ({"status": "Obsolete"}, "2"), ({"state": "withdrawn"}, "2"), ({"trangthai": "archived"}, "2"), ({"trang_thai": "Ngừng áp dụng"}, "2"), ({"superseded_by": "[[SOP-002 Rev 10]]"}, "2"),
        ({"status": "current", "replaced_by": "X"}, "2"), ({"status": "current"}, "1"), ({"trangthai": "active", "revision": "Iss04Rev41TR01"}, "1 Iss04Rev41TR01"), ({"trang_thai": "Đang áp dụng"}, "1"), ({"status": "draft"}, "3"),
        ({"trang_thai": "Chờ duyệt"}, "3"), ({"trang_thai": "nhap"}, "3"), ({"trang_thai": "dang-lam"}, "none"), ({"ngay": "2026-11-01"}, "none"), (None, "none"), ({"review_due": "2026-10-01"}, "0+due"), ({"review_due": "2026-11-09"}, "none"),
        ({"expires": "2026-12-31", "status": "current"}, "1"), ({"status": "superseded", "review_due": "2020-01-01"}, "2"), ({"ngay_het_han": "2026-01-15"}, "0+due"), ({"Status": "Superseded"}, "2"), ({"rev": "B"}, "0 B"),
        ({"status": ["", "current"]}, "1"), ({"status": "something else"}, "none"), ({"status": "inactive"}, "2"), ({"status": "invalid"}, "none"),
    ],
)
def test_status(spark, fields, want):
    fields = None if fields is None else {k: v if isinstance(v, list) else [v] for k, v in fields.items()}
    r = spark.createDataFrame([(fields,)], "f map<string,array<string>>").select(T.status_of(F.col("f"), F.lit("2026-11-09").cast("date")).alias("s")).first().s
    assert (f"{r.state}{'+due' if r.due else ''}{'' if r.revision is None else ' ' + r.revision}" if r else "none") == want


def test_status_byte_and_citation(spark):
    df = spark.createDataFrame([({"status": ["draft"], "review_due": ["2020-01-01"]},), (None,)], "f map<string,array<string>>")
    today = F.lit("2026-11-09").cast("date")
    assert [r.b for r in df.select(T.status_byte(T.status_of(F.col("f"), today)).alias("b")).collect()] == [7, 0]
    fields = {"revision": ["1"], "status": ["obsolete"], "doc_id": ["Old SOP"]}
    df = spark.createDataFrame([("Old rule.\r\nSecond ", "Docs/Old SOP.md", "3. [Scope]", fields)], "t string, p string, h string, f map<string,array<string>>")
    got = df.select(T.citation(F.col("t"), F.col("p"), F.col("h"), F.col("f"), today).alias("c")).first().c
    assert got == "> Old rule.\n> Second\n>\n> — [[Old SOP#3. Scope|Old SOP › 3. Scope]] · Rev 1 · ⚠ SUPERSEDED · copied 2026-11-09\n"


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"{rng.randint(0, 60):02}", f"{rng.randint(0, 60):02}") for _ in range(45)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.path: r.component for r in G.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_layouts(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "src string, dst string")
    at = {r.path: r.x for r in L.pivot_layout(edges, pivots=3, hops=15).collect()}
    line = [at[f"n{i}"] for i in range(13)]
    assert line == sorted(line) or line == sorted(line, reverse=True)
    members = spark.createDataFrame([("c", "a", 3), ("c", "b", 1)], "component string, path string, degree int")
    assert {r.path: round(r.x, 3) for r in G.small_layouts(members).collect()}["a"] == 0.0
    cells = G.line_raster(spark.createDataFrame([(0.0, 0.0, 0.99, 0.0)], "x1 double, y1 double, x2 double, y2 double"), 4).collect()
    assert {(r.px, r.py) for r in cells} == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_large_components_keep_every_member(spark):
    members = spark.createDataFrame([("big", f"n{i:04}", i % 7) for i in range(1200)] + [("c", "a", 3), ("c", "b", 1)], "component string, path string, degree long")
    got = {(r.component, r.path): r.x**2 + r.y**2 for r in G.small_layouts(members.repartition(5)).collect()}
    assert len(got) == 1202
    order = sorted((-(i % 7), f"n{i:04}") for i in range(1200))
    assert all(abs(got["big", p] - k) < 1e-6 for k, (_, p) in enumerate(order))
    assert got["c", "a"] == 0 and abs(got["c", "b"] - 1) < 1e-9


def test_pivot_layout_reaches_the_ends_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(18)] + [("z0", "z1")], "src string, dst string")
    reached = {r.path: r.hop for r in G.neighbourhood(edges, "n00", None).collect()}
    assert reached == {f"n{i:02}": i for i in range(19)}
    at = {r.path: (round(r.x, 6), round(r.y, 6)) for r in L.pivot_layout(edges, pivots=3).collect()}
    assert len({at[f"n{i:02}"] for i in range(19)}) == 19


def test_no_group_is_gathered_in_a_row(spark):
    df = spark.range(10).select(F.lit("a").alias("g"), "id")
    plan = df.groupBy("g").agg(VW.custom_summary(lambda values: values.filter(lambda v: v > 3).length, F.col("id")).alias("n"))
    assert plan.first().n == 6 and "collect_list" not in plan._jdf.queryExecution().toString()
    edges = spark.createDataFrame([(f"n{i:02}", "hub", 0) for i in range(25)] + [("hub", f"m{9 - i}", i) for i in range(7)] + [("n00", "hub", 1)], "src string, dst string, ord int")
    rows = sorted(G.adjacency(edges, 10).where("path = 'hub'").collect(), key=lambda r: r.block)
    assert [len(r.inlinks) for r in rows] == [10, 10, 5] and [x for r in rows for x in r.inlinks] == [f"n{i:02}" for i in range(25)]
    assert [x for r in rows for x in r.outlinks] == [f"m{9 - i}" for i in range(7)]
    counts = G.inlink_counts(edges)
    assert {r.path: r.n for r in counts.collect()}["hub"] == 25 and "collect_set" not in counts._jdf.queryExecution().toString()


def test_incremental_equals_batch(spark):
    rng = random.Random(1)
    table = {f"f{i % 3}/n{i}": i for i in range(40)}
    df = lambda t: spark.createDataFrame(sorted(t.items()), "path string, v int")
    now = df(table)
    for _ in range(3):
        new = {p: v + rng.randint(0, 1) for p, v in table.items() if rng.random() > 0.2} | {f"f9/x{rng.randint(0, 99)}": 1}
        files = lambda t: df(t).select("path", F.col("v").alias("mtime"), F.lit(0).alias("size"))
        diff = I.listing_diff(files(table), files(new))
        feed = diff.join(df(new), "path", "left").select("path", "v", F.when(F.col("op") == "deleted", "delete").otherwise("upsert").alias("op"))
        now = I.applied(now, feed, "path")
        table = new
        assert {(r.path, r.v) for r in now.collect()} == set(table.items())
    gone = I.under(spark.createDataFrame([("f1", "deleted")], "path string, op string"), df(table))
    assert {r.path for r in gone.collect()} == {p for p in table if p.startswith("f1/")}


def test_streams(spark, tmp_path):
    source, seen = tmp_path / "in", []
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "path string, seq int").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("path string, seq int").parquet(str(source))
    q = I.follow(stream, lambda df, n: seen.extend((r.path, r.seq) for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [("a", 2), ("b", 1)]
    events = tmp_path / "events"
    rows = [("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 03:00:00", "x", 5.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(str(events))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(events))
    q = I.windowed(stream, "1 hour", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.s) for r in spark.table("w").collect()) == [(1, 5.0), (2, 3.0)]


def test_exact_median_by_brackets(spark, monkeypatch):
    from quillstone.operators import ranks

    monkeypatch.setattr(ranks, "SORTED", 20)
    rng = random.Random(7)
    for values in ([rng.gauss(0, 5) for _ in range(3001)], [1.0] * 900 + [2.0] * 100, [float(i % 4) for i in range(1000)], [3.0, 1.0], [], [None, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        full = sorted(v for v in values if v is not None)
        want = None if not full else (full[(len(full) - 1) // 2] + full[len(full) // 2]) / 2
        assert ranks.exact_median(df, F.col("v")) == want


def test_links_follow_a_moved_note(spark):
    from quillstone.operators import edits

    text = 'See [[Plan]], ![[plan#Goal|the goal]], [[Work/Plan.md]], [a](Plan.md#x "t"), [b](../Work/Plan.md), [c](https://x.org/Plan.md), [[Planet]] and [d](other.md).'
    df = spark.range(1).select(edits.moved_links(F.lit(text), F.lit("Work/Note.md"), F.lit("Work/Plan.md"), F.lit("Old work/Plan (2).md")).alias("t"))
    assert df.first().t == 'See [[Plan (2)]], ![[Plan (2)#Goal|the goal]], [[Plan (2)]], [a](../Old%20work/Plan%20(2).md#x "t"), [b](../Old%20work/Plan%20(2).md), [c](https://x.org/Plan.md), [[Planet]] and [d](other.md).'
    one = lambda e: spark.range(1).select(e.alias("v")).first().v
    assert one(edits.relative_path(F.lit("a/b"), F.lit("a/c/d.md"))) == "../c/d.md" and one(edits.relative_path(F.lit(""), F.lit("a/d.md"))) == "a/d.md" and one(edits.relative_path(F.lit("a"), F.lit("a/d.md"))) == "d.md"
    assert one(edits.replaced_once(F.lit("a b a"), "a", "c", every=True)) == "c b c" and one(edits.replaced_once(F.lit("a b a"), "a", "c")) is None
    assert one(edits.property_set(F.lit("---\na.b: 1\naxb: 2\n---\nx"), "a.b", "3")) == "---\na.b: 3\naxb: 2\n---\nx"


def test_a_large_group_has_several_rows_and_its_median_no_task_of_its_own(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, float(i * 7 % 50)) for i in range(60)], "g string, path int, v double")
    blocks = Rows.of(df).sort(F.col("v").desc()).group_rows("g", F.col("g"), "path", size=12).table(g=F.col("g"), block=F.col("block"), rows=F.col("rows")).collect()
    assert [(b.block, len(b.rows)) for b in blocks if b.g == "a"] == [(0, 12), (1, 12), (2, 12), (3, 4)] and [len(b.rows) for b in blocks if b.g is None] == [12, 8]
    for g in ("a", None):
        want = sorted(((-v, p) for k, p, v in ((r.g, r.path, r.v) for r in df.collect()) if k == g))
        assert [r.path for b in blocks if b.g == g for r in b.rows] == [p for _, p in want]
    assert {r.g: r.m for r in VW.group_medians(df.withColumn("v", F.expr("nullif(v, 7)")), "g", "v", "m").collect()} == {g: __import__("statistics").median([r.v for r in df.collect() if r.g == g and r.v != 7]) for g in ("a", None)}


def test_formulas_over_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    own = lambda f: df.agg(VW.custom_summary(f, F.col("v")).alias("x")).first().x
    assert own(lambda v: v.length) == 4 and own(lambda v: v.unique()) == 3 and own(lambda v: v.filter(lambda x: x > 1).sum() / v.length) == 1.0
    assert own(lambda v: v.contains(F.lit(None))) and not own(lambda v: v.contains(F.lit(5.0))) and not own(lambda v: v.all(lambda x: x > 0)) and own(lambda v: v.any(lambda x: x > 1))
    assert own(lambda v: v.map(lambda x: x * 2).mean()) == pytest.approx(10 / 3)
