"""Tools, adjacency, placement and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import graph as G
from quillstone.operators import status as T
from quillstone.operators import tools
from quillstone.plans.graph_queries import EDGES
from quillstone.plans.registry import query
from quillstone.sources import projection as P


@query("SELECT 'orders/' || l_orderkey || '.md' AS path, l_returnflag AS text, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem WHERE l_linestatus <> 'F' AND l_shipdate <= TIMESTAMP '1996-01-31' AND l_returnflag = 'N' AND 'orders/' || l_orderkey LIKE 'orders/%'")
def tool_list_tasks(spark, d):
    return tools.list_tasks(P.tasks(spark, d), folder="orders", done=False, due_before=F.lit("1996-01-31").cast("timestamp"), text="n").select("path", "text", "quantity")


@query("SELECT 'customers/' || c_custkey || '.md' AS path FROM customer UNION ALL SELECT 'regions/' || r_regionkey || '.md' FROM region")
def tool_visible_only(spark, d):
    return tools.visible(P.nodes(spark, d), ["Customers", "regions/"]).select("path")


@query("SELECT 'customers/' || c_custkey || '.md' AS path FROM customer ORDER BY c_acctbal DESC, path LIMIT 50 OFFSET 100")
def tool_paged(spark, d):
    return tools.paged(P.customer_notes(spark, d), [F.desc("balance"), F.col("path")], 2, 50).select("path")


@query("""SELECT '{"key":' || c_custkey || ',"segment":"' || c_mktsegment || '","none":null}' AS json FROM customer""")
def tool_rows_as_json(spark, d):
    return tools.as_json(P.customer_notes(spark, d).select("key", "segment", F.lit(None).cast("string").alias("none")))


@query(r"SELECT doc_id AS key, left(trim(list_filter(regexp_split_to_array(text, '\r?\n'), lambda l: contains(lower(l), 'then'))[1]), 160) AS line FROM documents")
def tool_backlink_line(spark, d):
    return P.document_notes(spark, d).select("key", tools.naming_line(F.col("text"), "Then").alias("line"))


@query("SELECT o_orderstatus AS lane, count(*) AS cards, count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS done FROM orders GROUP BY 1")
def board_card_counts(spark, d):
    cards = P.order_notes(spark, d).select(F.col("status").alias("lane"), (F.col("status") == "F").alias("done"), F.when(F.col("priority") == "1-URGENT", "X").otherwise(" ").alias("status"))
    return tools.card_counts(cards)


@query(f"SELECT coalesce(a.src, b.dst) AS path, coalesce(o, '') AS outs, coalesce(n, 0) AS n_in FROM (SELECT src, string_agg(dst, ',' ORDER BY dst) AS o FROM {EDGES} GROUP BY 1) a FULL JOIN (SELECT dst, count(DISTINCT src) AS n FROM {EDGES} GROUP BY 1) b ON a.src = b.dst")
def graph_adjacency(spark, d):
    edges = P.edges(spark, d)
    outs = edges.groupBy(F.col("src").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]), ",").alias("outs"))  # the answer has them in a row
    return outs.join(G.inlink_counts(edges), "path", "full").select("path", F.coalesce("outs", F.lit("")).alias("outs"), F.coalesce("n", F.lit(0)).cast("long").alias("n_in"))


@query("SELECT 'orders/3.md' AS path, 0 AS level UNION ALL SELECT 'customers/' || o_custkey || '.md', 1 FROM orders WHERE o_orderkey = 3 UNION ALL SELECT 'nations/' || c_nationkey || '.md', 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 3 UNION ALL SELECT 'regions/' || n_regionkey || '.md', 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 3")
def graph_embed_closure(spark, d):
    return G.embedded(P.edges(spark, d), "orders/3.md", 3)


@query("SELECT q, path, distance FROM (SELECT s_suppkey AS q, 'customers/' || c_custkey || '.md' AS path, abs(s_acctbal - c_acctbal) AS distance, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal - c_acctbal), 'customers/' || c_custkey || '.md') AS k FROM supplier JOIN customer ON abs(s_acctbal - c_acctbal) <= 25 AND s_nationkey = c_nationkey) WHERE k = 1")
def graph_nearest(spark, d):
    points = P.read(spark, d, "customer").select(P.path_of("customers", F.col("c_custkey")).alias("path"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 1000.0).alias("y"))
    return G.nearest(points, P.read(spark, d, "supplier").select(F.col("s_suppkey").alias("q"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 1000.0).alias("y")), 25.0)


@query("SELECT 'customers/' || c_custkey || '.md' AS path, coalesce(x, 0.5) AS x, coalesce(y, 0.25) AS y FROM customer LEFT JOIN (SELECT n_nationkey, n_nationkey / 25.0 AS x, n_regionkey / 5.0 AS y FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def graph_placement(spark, d):
    at = P.read(spark, d, "nation").where("n_nationkey < 20").select(P.path_of("nations", F.col("n_nationkey")).alias("path"), (F.col("n_nationkey") / 25.0).alias("x"), (F.col("n_regionkey") / 5.0).alias("y"))
    anchors = spark.createDataFrame([("customers", 0.5, 0.25)], "folder string, x double, y double")
    new = P.customer_notes(spark, d).select("path", "folder")
    return G.placed(new, P.edges(spark, d).where(F.col("src").startswith("customers/")), at, anchors)


@query("SELECT px, py, count(*) AS n FROM (SELECT CAST(least(floor((x1 + (x2 - x1) * k / steps) * 16), 15) AS INT) AS px, CAST(least(floor((y1 + (y2 - y1) * k / steps) * 16), 15) AS INT) AS py FROM (SELECT *, unnest(generate_series(0, CAST(steps AS BIGINT))) AS k FROM (SELECT *, greatest(ceil(greatest(abs(x2 - x1), abs(y2 - y1)) * 16), 1) AS steps FROM (SELECT n_nationkey / 32.0 AS x1, 0.125 AS y1, n_regionkey / 8.0 AS x2, 0.75 AS y2 FROM nation)))) GROUP BY ALL")
def graph_line_raster(spark, d):
    lines = P.read(spark, d, "nation").select((F.col("n_nationkey") / 32.0).alias("x1"), F.lit(0.125).alias("y1"), (F.col("n_regionkey") / 8.0).alias("x2"), F.lit(0.75).alias("y2"))
    return G.line_raster(lines, 16)


@query("""WITH o AS (SELECT 'orders/' || o_orderkey || '.md' AS path, o_orderpriority AS folder, o_orderdate AS t FROM orders),
    f AS (SELECT folder, CAST(row_number() OVER (ORDER BY count(*) DESC, folder) - 1 AS INT) AS arm, count(*) OVER () AS arms FROM o GROUP BY 1),
    p AS (SELECT path, arm, arms, t, CAST(CAST('0x' || substr(md5(path || '|1'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS p1, CAST(CAST('0x' || substr(md5(path || '|2'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS p2 FROM o JOIN f USING (folder)),
    a AS (SELECT *, sqrt(p1) AS r, arm * (2 * pi() / arms) + sqrt(p1) * 2 + (p2 - 0.5) * 0.6 AS angle FROM p)
    SELECT path, arm, round(r * cos(angle), 6) AS x, round(r * sin(angle), 6) AS y, round(1 + ln(2), 6) AS size, round(greatest(1 - CAST(greatest(date_diff('day', CAST(t AS DATE), DATE '1998-08-02'), 0) AS DOUBLE) / 365, 0.15), 6) AS alpha FROM a""")
def graph_galaxy(spark, d):
    notes = P.order_notes(spark, d).select("path", F.col("priority").alias("folder"), F.col("date").alias("mtime"))
    stars = G.galaxy(notes, P.edges(spark, d), F.lit("1998-08-02").cast("timestamp"))
    return stars.select("path", "arm", *[F.round(c, 6).alias(c) for c in ("x", "y", "size", "alpha")])


MEMBERS = """WITH n AS (SELECT n_nationkey, 'nations/' || n_nationkey || '.md' AS p, 'regions/' || n_regionkey || '.md' AS r FROM nation), l AS (SELECT 'orders/' || o_orderkey || '.md' AS s, 'customers/' || o_custkey || '.md' AS t FROM orders
    UNION ALL SELECT 'customers/' || c_custkey || '.md', 'nations/' || c_nationkey || '.md' FROM customer UNION ALL SELECT p, r FROM n UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', 'nations/' || s_nationkey || '.md' FROM supplier),
    g AS (SELECT path, count(*) AS degree FROM (SELECT s AS path FROM l UNION ALL SELECT t FROM l) GROUP BY 1),
    m AS (SELECT p AS path, r FROM n UNION ALL SELECT DISTINCT r, r FROM n UNION ALL SELECT 'customers/' || c_custkey || '.md', r FROM customer JOIN n ON c_nationkey = n_nationkey
    UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', r FROM supplier JOIN n ON s_nationkey = n_nationkey UNION ALL SELECT 'orders/' || o_orderkey || '.md', r FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey)"""


@query(MEMBERS + """ SELECT path, component, round(sqrt(k) * cos(k * (pi() * (3 - sqrt(5)))), 6) AS x, round(sqrt(k) * sin(k * (pi() * (3 - sqrt(5)))), 6) AS y
    FROM (SELECT path, component, CAST(row_number() OVER (PARTITION BY component ORDER BY degree DESC, path) - 1 AS DOUBLE) AS k FROM (SELECT m.path, min(m.path) OVER (PARTITION BY r) AS component, degree FROM m JOIN g ON m.path = g.path))""")
def graph_small_layouts(spark, d):
    edges = P.edges(spark, d)
    members = G.components(edges).join(G.degrees(edges), "path")
    return G.small_layouts(members).select("path", "component", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""SELECT c_custkey AS key, '> ' || c_name || chr(10) || '>' || chr(10) || '> is here' || chr(10) || '>' || chr(10) || '> — [[' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '#Part 1|' || c_custkey || ' › Part 1' ELSE '' END || ']] · ' || c_name
    || CASE WHEN c_custkey % 2 = 0 THEN ' · Rev ' || c_nationkey ELSE ' · Issue ' || c_nationkey END || ' · effective 1998-01-01' || CASE c_mktsegment WHEN 'BUILDING' THEN ' · ⚠ SUPERSEDED' WHEN 'MACHINERY' THEN ' · draft' ELSE '' END || ' · copied 1998-05-20' || chr(10) AS cite FROM customer""")
def status_citation(spark, d):
    nation = F.regexp_extract("nation", r"(\d+)", 1)
    fields = F.create_map(
        F.lit("Doc_ID"), F.array("name"), F.lit("revision"), F.array(F.when(F.col("key") % 2 == 0, nation).otherwise(F.concat(F.lit("Issue "), nation))), F.lit("effective"), F.array(F.lit("1998-01-01")),
        F.lit("status"), F.array(F.when(F.col("segment") == "BUILDING", "Withdrawn").when(F.col("segment") == "MACHINERY", "in-review").otherwise("whatever")),
    )
    quote, heading = F.concat(F.lit(" "), F.col("name"), F.lit("\r\n\nis here\n")), F.when(F.col("key") % 3 == 0, "[Part] 1")
    return P.customer_notes(spark, d).select("key", T.citation(quote, F.col("path"), heading, fields, F.lit("1998-05-20").cast("date")).alias("cite"))


@query("SELECT folder, n, CAST(row_number() OVER (ORDER BY n DESC, folder) AS INT) AS rank FROM (SELECT 'orders' AS folder, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'nations', count(*) FROM nation UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'parts', count(*) FROM part)")
def graph_folder_ranks(spark, d):
    return G.folder_ranks(P.nodes(spark, d), F.col("folder"))


@query("SELECT median(sqrt(power(c_acctbal - o_totalprice, 2) + power(c_nationkey - 10, 2))) AS median, count(*) AS links FROM orders JOIN customer ON c_custkey = o_custkey")
def graph_link_length(spark, d):
    orders = P.order_notes(spark, d).select("path", F.col("total").alias("x"), F.lit(10.0).alias("y"))
    customers = P.read(spark, d, "customer").select(P.path_of("customers", F.col("c_custkey")).alias("path"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return G.median_link_length(P.edges(spark, d), orders.unionByName(customers))


@query("SELECT 'nations/' || c_nationkey || '.md' AS folder, avg(c_acctbal) AS x, avg(CAST(c_custkey AS DOUBLE)) AS y, count(*) AS n FROM customer GROUP BY 1")
def graph_folder_centroids(spark, d):
    at = P.customer_notes(spark, d).select("nation", F.col("balance").alias("x"), F.col("key").cast("double").alias("y"))
    return G.folder_anchors(at, F.col("nation"))
