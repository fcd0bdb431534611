"""Registered queries against DuckDB on the smallest driver tables."""

import math
import os

import pytest

from quillstone.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), columns)


SORTED = [n for n in sorted(ORACLE_SQL) if n in ("dql_sort_mixed_types", "dql_sort_nulls", "dql_table_where_sort_limit", "search_rank_superseded_last", "tool_paged", "view_sort_natural", "view_sort_nulls_last")]


@pytest.mark.parametrize("name", SORTED)
def test_same_order_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert [[plain(r[c]) for c in columns] for r in got.collect()] == [[plain(v) for v in r] for r in want.fetchall()]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["dql_list_expr"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThan(c_acctbal,0.0)]" in plan and "c_nationkey" not in plan.split("ReadSchema")[1].split("\n")[0]
    plan = QUERIES["dql_table_where_sort_limit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plain_quote(text, quote):
    """Verdict, percent and lines of a quotation, by trying every range of lines."""
    import re

    flat = lambda s: " ".join(re.sub(r"[*_`|~]|==", " ", re.sub(r"^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+(?:\[.\]\s+)?|\d+[.)]\s+)", "", s)).split()).lower()
    words = [re.findall(r"[^\W_]+", flat(line)) for line in re.split(r"\r?\n", text)]
    asked = re.findall(r"[^\W_]+", flat(quote))
    wanted, sequence = set(asked), f" {' '.join(asked)} "
    holds = lambda a, b: sequence in f" {' '.join(w for own in words[a : b + 1] for w in own)} "
    best = None
    for a in range(len(words)):
        if not words[a]:
            continue
        n, have = 0, set()
        for b in range(a, min(len(words), a + 40)):
            if not words[b]:
                continue
            if holds(a, b):
                while a < b and holds(a + 1, b):
                    a += 1
                return "exact", 100.0, a + 1, b + 1
            n, have = n + len(words[b]), have | (wanted & set(words[b]))
            if have and (best is None or (len(have), a - b) > best[:2]):
                best = (len(have), a - b, a, b)
            if n > len(asked) * 2 + 20 or have == wanted:
                break
    if best is None:
        return "not_supported", 0.0, None, None
    source = "\n".join(re.split(r"\r?\n", text)[best[2] : best[3] + 1])
    missing = set(re.findall(r"\d+", quote)) - set(re.findall(r"\d+(?:[.,:/-]\d+)*%?", source))
    percent = float(int(100 * best[0] / len(wanted) + 0.5))
    return "close" if best[0] / len(wanted) >= 0.8 and not missing else "not_supported", percent, best[2] + 1, best[3] + 1


def test_quotations_match_a_plain_search(spark, duck):
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    got = {r.key: (r.verdict, r.percent, r["first"], r["last"]) for r in QUERIES["quote_verify"](spark, SF).collect()}
    assert got == {k: plain_quote(t, "The and of 12 then") for k, t in texts.items()}
