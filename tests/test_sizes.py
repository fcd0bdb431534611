"""Plans and results that hold at any size: tables of few bytes, many rows and much work."""

import re

import pytest

from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.operators import segments
from quillstone.operators.segments import SearchIndex
from quillstone.plans.registry import ORACLE_SQL, QUERIES
from quillstone.sources import markdown as M

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["md_file_fields", "md_fields", "md_links_tags", "md_outline_section", "md_tasks", "md_task_fields", "md_renamed_links"])
def test_notes_of_a_small_file_are_dealt_out_before_they_are_read(spark, name):
    """A file of customers is one task; the texts made of it are read after the rows are dealt out, and no part of it before."""
    text = plan(QUERIES[name](spark, SF))
    assert "Repartition" in text
    below = text[text.index("Repartition") :].split("\n", 1)[1].split("Union")[0]
    assert not re.search(r"aggregate\(|regexp_|posexplode", below.split("Relation")[0])


@pytest.mark.parametrize("read, most", [(M.fields, 2), (M.tags, 2), (M.tasks, 1), (lambda t: M.section(t, "a"), 1)])
def test_a_text_is_taken_apart_once(spark, read, most):
    """Each expression goes over the lines once, not once for each key or use."""
    text = plan(spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit("\n")).alias("text")).select(read(F.col("text")).alias("x")))
    assert text.count("aggregate(") <= most


def same_as_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for file in folder.iterdir():
        con.execute(f"create view {file.name.split('.')[0]} as from '{file}/*.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(folder)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_customers_in_one_place_do_not_push_each_other(spark, tmp_path):
    rows = [(0, 0.0, 1), (1000, -5.0, 1), (40, 0.0, 1), (2000, -10.0, 2), (3000, -15.0, 2)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    same_as_sql(spark, tmp_path, "graph_collisions")


def test_more_islands_than_a_hundred_rings_hold(spark, tmp_path):
    spark.range(40_000).selectExpr("id as o_orderkey", "case when id < 12 then 0 else id end as o_custkey", "'O' as o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    same_as_sql(spark, tmp_path, "graph_packed_islands")


@pytest.mark.parametrize("name", ["search_phrase", "search_tokens_df"])
def test_texts_are_read_as_they_are_dealt_out(spark, name):
    text = plan(QUERIES[name](spark, SF))
    below = text[text.index("Repartition") :]
    assert "_extract_all" not in below and "regexp_replace" not in below and "translate" not in below


def test_searches_without_words_build_no_index(spark, monkeypatch):
    monkeypatch.setattr(SearchIndex, "build", lambda *_: pytest.fail("built"))
    monkeypatch.setattr(SearchIndex, "generation", lambda *_: -1)
    for name in ("search_phrase", "search_fields"):
        assert QUERIES[name](spark, SF).count() >= 0


def test_parts_of_a_segment_have_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PART_ROWS", 50)
    notes = spark.range(300).selectExpr("id as key", "concat('w', id, ' x', id % 3, ' y') as text")
    index = SearchIndex(spark, str(tmp_path / "index")).build(notes)
    parts = {r.part: r.n for r in index._postings(index.segments()[0].path, "bigint").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 900 and max(parts.values()) < 150


def test_quotations_are_looked_up_once_and_dealt_out(spark, tmp_path):
    notes = spark.createDataFrame([(1, "one two three four"), (2, "five two three"), (3, "one")], "key long, text string")
    index = SearchIndex(spark, str(tmp_path / "index")).build(notes)
    found = segments.find_quote(notes, index, "one two three")
    text = plan(found)
    assert text.count("not_supported") <= 2 and text.index("Generate") < text.index("Repartition")
    assert [(r.key, r.check.verdict) for r in found.collect()] == [(1, "exact")]


def test_dense_points_meet_few_queries(spark):
    """Queries that have a point very near take no part in the wider cells."""
    import math

    from quillstone.operators import graph as G

    points = [(f"p{i:04}", (i * 37 % 1000) / 10, (i * 91 % 700) / 10) for i in range(2000)]
    asked = [(None if i == 0 else i, i * 1.7, i * 1.1) for i in range(90)]
    got = {r.q: (r.path, round(r.distance, 9)) for r in G.nearest(spark.createDataFrame(points, "path string, x double, y double"), spark.createDataFrame(asked, "q int, x double, y double"), 20.0).collect()}
    want = {}
    for q, x, y in asked:
        d, p = min((math.hypot(px - x, py - y), p) for p, px, py in points)
        if d <= 20:
            want[q] = (p, round(d, 9))
    assert got == want and 0 < len(got) < 90
    cells, met_in_cells = [], G.met_in_cells
    G.met_in_cells = lambda points, rest, size, radius: (cells.append(rest.count()), met_in_cells(points, rest, size, radius))[1]
    try:
        line = spark.range(1000).selectExpr("cast(id as string) as path", "id / 1000 as x", "0.0D as y")
        assert G.nearest(line, line.selectExpr("path as q", "x", "y"), 20.0).count() == 1000
    finally:
        G.met_in_cells = met_in_cells
    assert cells == [1000, 0, 0, 0, 0]


def test_words_are_told_apart_in_their_note(spark, tmp_path, monkeypatch):
    """No table of postings is grouped by word and key, and a repeated key still has each word once."""
    rows = [(1, "a-b Été b"), (2, "a"), (1, "été b c"), (3, None), (3, "ete")]
    notes = spark.createDataFrame(rows, "key long, text string")
    want = sorted(map(tuple, S.settled(S.postings(notes)).collect()))
    monkeypatch.setattr(S, "settled", lambda *_: pytest.fail("grouped"))
    index = SearchIndex(spark, str(tmp_path / "index")).build(notes)
    assert sorted(map(tuple, index.postings().collect())) == want
    assert [r for r in want if r[1] == 1] == [("a", 1, True), ("a-b", 1, True), ("b", 1, True), ("c", 1, True), ("ete", 1, False), ("été", 1, True)]
    assert plan(QUERIES["search_tokens_df"](spark, SF)).count("Aggregate") == 1


def test_changed_notes_are_dealt_out_and_replaced_ones_meet_postings_in_parts(spark, tmp_path, monkeypatch):
    notes = spark.range(300).selectExpr("id as key", "concat('w', id, ' x', id % 3) as text").coalesce(1)
    index = SearchIndex(spark, str(tmp_path / "index")).build(notes)
    seen, postings = [], S.postings
    monkeypatch.setattr(S, "postings", lambda df: (seen.append(df.rdd.getNumPartitions()), postings(df))[1])
    index.update(notes.where("key < 50").select("key"), notes.where("key >= 250").selectExpr("key", "'new' as text"), merge=False)
    assert seen[0] > 1
    few = sorted(map(tuple, index.postings().collect()))
    assert len(few) == 450
    monkeypatch.setattr(segments, "SENT", 10)
    monkeypatch.setattr(segments, "PART_ROWS", 50)
    many = index.postings()
    assert "RepartitionByExpression [key" in plan(many) and sorted(map(tuple, many.collect())) == few


def test_leaves_take_no_part_in_the_rounds_of_components(spark, monkeypatch):
    import random

    from quillstone.operators import graph as G

    seen, star_forest = [], G.star_forest
    monkeypatch.setattr(G, "star_forest", lambda links, written: (seen.append(links.count()), star_forest(links, written))[1])
    deal = random.Random(5)
    stars = [(f"z{i:03}", f"b{i % 7}") for i in range(300)] + [("b0", "b1"), ("b1", "b2"), ("b2", "b0"), ("b3", "c"), ("z001", "b1"), ("b5", "b5"), ("q", "p"), ("p", "q")]
    for links in (stars, [(f"n{deal.randrange(60)}", f"n{deal.randrange(60)}") for _ in range(45)], [("x", "x")], []):
        of = {}
        for a, b in links:
            if a != b:
                one = of.get(a, {a}) | of.get(b, {b})
                of |= dict.fromkeys(one, one)
        got = G.components(spark.createDataFrame(links, "src string, dst string")).collect()
        assert sorted(map(tuple, got)) == sorted((p, min(c)) for p, c in of.items())
    assert seen[0] <= 5
