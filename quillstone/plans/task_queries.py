"""Task lists, calendars and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import values as V
from quillstone.operators import dashboards as D
from quillstone.operators.rows import Rows
from quillstone.plans.registry import query
from quillstone.sources import projection as P


@query("SELECT 'orders/' || l_orderkey || '.md' AS path, count(*) AS n, min(l_returnflag) AS least FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def task_open_by_note(spark, d):
    tasks = Rows.of(P.tasks(spark, d), "path", "line").where(~F.col("completed"))
    return tasks.group("path", F.col("path"), n=F.count("*"), least=F.min("text")).df


@query("SELECT 'orders/' || l_orderkey || '.md' AS path, l_returnflag AS text, strftime(l_shipdate, '%Y-%m-%d') AS due FROM lineitem WHERE l_linestatus <> 'F' AND l_shipdate >= TIMESTAMP '1998-05-20' AND l_shipdate <= TIMESTAMP '1998-05-27'")
def task_due_within(spark, d):
    now = F.lit("1998-05-20").cast("timestamp")
    return P.tasks(spark, d).where(~F.col("completed") & (F.col("due") >= now) & (F.col("due") <= V.plus_ms(now, V.duration_ms("1 week")))).select("path", "text", F.date_format("due", "yyyy-MM-dd").alias("due"))


@query("SELECT l_returnflag AS text, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS done, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 3) AS percent FROM lineitem GROUP BY 1")
def task_group_by_field(spark, d):
    return Rows.of(P.tasks(spark, d), "path").group("text", F.col("text"), n=F.count("*"), done=F.count_if("completed")).with_columns(percent=F.round(F.lit(100.0) * F.col("done") / F.col("n"), 3)).df


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def calendar_day_counts(spark, d):
    return P.day_notes(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, array_to_string(list_slice(list(p ORDER BY p), 1, 30), ',') AS items FROM (SELECT ts, 'events/' || event_id || '.md' AS p FROM events) GROUP BY 1")
def calendar_first_30(spark, d):
    found = Rows.of(P.day_notes(spark, d)).calendar(F.col("ts"))
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.array_join("items", ",").alias("items"))


@query("SELECT strftime(g, '%Y-%m-%d') AS day, CAST(isodow(g) AS INT) AS weekday, CAST(date_diff('week', date_trunc('week', DATE '2024-01-01'), date_trunc('week', g)) AS INT) AS week, month(g) = 1 AS in_month, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS g) LEFT JOIN (SELECT CAST(ts AS DATE) AS dd, count(*) AS n FROM events GROUP BY 1) ON dd = g")
def calendar_month_grid(spark, d):
    days = Rows.of(P.day_notes(spark, d)).calendar(F.col("ts"))
    return D.month_grid(days, "2024-01").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "weekday", "week", "in_month", "n")


@query("SELECT count(*) AS notes, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-30') AS today, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-24') AS week FROM orders")
def dash_stats(spark, d):
    return D.stats(P.order_notes(spark, d).withColumn("mtime", F.col("date")), F.lit("1998-07-30 12:00:00").cast("timestamp"))


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, path LIMIT 20")
def dash_recent(spark, d):
    return D.recent(P.order_notes(spark, d).withColumn("mtime", F.col("date")), 20).select("path", F.date_format("mtime", "yyyy-MM-dd").alias("day"))


@query("SELECT * FROM (SELECT 'orders' AS folder, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'parts', count(*) FROM part)")
def dash_folders(spark, d):
    return D.folders(P.nodes(spark, d))


@query("SELECT * FROM (SELECT 'orders/1' AS prefix, count(*) AS n FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '1%' UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'none', 0)")
def dash_listed_folders(spark, d):
    return D.listed_folders(P.nodes(spark, d), ["orders/1", "orders", "none"])


@query("SELECT tag, count(*) AS n FROM (SELECT 'priority/' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') AS tag FROM orders UNION ALL SELECT 'segment/' || lower(c_mktsegment) FROM customer) GROUP BY 1 ORDER BY n DESC, tag LIMIT 8")
def dash_tags(spark, d):
    notes = P.order_notes(spark, d).select("path", "tags").unionByName(P.customer_notes(spark, d).select("path", "tags"))
    return D.top_tags(notes, 8)


@query("SELECT 'notes' AS what, '' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'folder', 'customers', count(*) FROM customer UNION ALL SELECT * FROM (SELECT 'tag', 'segment/' || lower(c_mktsegment), count(*) FROM customer GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 30)")
def tool_vault_info(spark, d):
    return D.vault_info(P.customer_notes(spark, d))


@query("SELECT 'orders/' || l_orderkey || '.md' AS path, count(*) AS n, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag) AS texts FROM lineitem GROUP BY 1")
def task_nested_by_note(spark, d):
    nested = Rows.of(P.tasks(spark, d), "path", "line", "text").tasks_by("path")
    return nested.select("path", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda r: F.concat(r["text"], r["line"].cast("string"))), ",").alias("texts"))


@query("SELECT l_returnflag AS lane, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS due FROM lineitem ORDER BY lane, due NULLS LAST, pos")
def board_cards_by_due(spark, d):
    from quillstone.operators.tools import cards_by_due

    tasks = P.tasks(spark, d)
    text = F.concat(F.lit("ship "), F.when(F.col("line") % 2 == 0, F.concat(F.lit("📅 "), F.date_format("due", "yyyy-MM-dd"))).otherwise(""))
    return cards_by_due(tasks.select(F.col("text").alias("lane"), (F.col("key") * 8 + F.col("line")).cast("long").alias("pos"), text.alias("text"))).select("lane", "pos", "due")
