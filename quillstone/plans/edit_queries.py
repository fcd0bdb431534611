"""Edits, templates, conflicts, mixed values, and what keeps tables up to date, over notes made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import coerce
from quillstone.functions import values as V
from quillstone.operators import edits
from quillstone.operators import graph as G
from quillstone.operators.rows import Rows
from quillstone.plans.registry import query
from quillstone.sources import projection as P
from quillstone.sources.catalog import by_kind
from quillstone.streaming import incremental as I

NOTE = "'---' || chr(10) || 'segment: ' || c_mktsegment || chr(10) || '---' || chr(10) || '# ' || c_name || chr(10) || '- [ ] call ' || c_custkey || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '- [ ] call ' || c_custkey || chr(10) ELSE '' END || 'end'"


def notes(spark, d):
    """key, path, text, version, modified of a note of every customer; a third have a task twice."""
    c = P.read(spark, d, "customer")
    key = F.col("c_custkey")
    task = F.concat(F.lit("- [ ] call "), key, F.lit("\n"))
    text = F.concat(F.lit("---\nsegment: "), "c_mktsegment", F.lit("\n---\n# "), "c_name", F.lit("\n"), task, F.when(key % 3 == 0, task).otherwise(""), F.lit("end"))
    return c.select(key.alias("key"), P.path_of("customers", key).alias("path"), text.alias("text"), (key % 4).alias("version"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))


@query(f"""SELECT key, text || chr(10) || 'more' || chr(10) AS appended, CASE WHEN key % 3 = 0 THEN NULL ELSE replace(text, '] call', '] ring') END AS replaced, replace(text, '] call', '] ring') AS every,
    regexp_replace(text, '- \\[ \\] call', '- [x] call') AS ticked, replace(text, 'segment: ' || seg, 'segment: none') AS changed, replace(text, chr(10) || '---' || chr(10) || '#', chr(10) || 'due: 2024-01-01' || chr(10) || '---' || chr(10) || '#') AS added,
    regexp_replace(text, '^---\\n.*\\n---\\n', '') AS removed FROM (SELECT c_custkey AS key, c_mktsegment AS seg, {NOTE} AS text FROM customer)""")
def edit_notes(spark, d):
    t = F.col("text")
    return notes(spark, d).select(
        "key", edits.appended(t, "more").alias("appended"), edits.replaced_once(t, "] call", "] ring").alias("replaced"), edits.replaced_once(t, "] call", "] ring", every=True).alias("every"), edits.task_set(t, 4, "call", "x").alias("ticked"),
        edits.property_set(t, "segment", "none").alias("changed"), edits.property_set(t, "due", "2024-01-01").alias("added"), edits.property_set(t, "segment", None).alias("removed"),
    )


@query("""SELECT c_custkey AS key, '# ' || c_name || ' of 2024-03-05 at 09:07, Tuesday 5 March 24; next 2024-03-06, 7 days on 12.03.2024, made 2024-03-05 09:07 in customers <% tp.web.random() %> {{other}}' AS text FROM customer""")
def edit_templates(spark, d):
    template = "# {{title}} of {{date}} at {{ time }}, {{Date:dddd D MMMM YY}}; next <% tp.date.tomorrow() %>, 7 days on <%- tp.date.now(\"DD.MM.YYYY\", 7) -%>, made <% tp.file.creation_date() %> in <% tp.file.folder() %><% tp.file.cursor(1) %> <% tp.web.random() %> {{other}}"
    now = F.lit("2024-03-05 09:07:08").cast("timestamp")
    return notes(spark, d).select("key", edits.expanded(template, F.col("name"), now, F.lit("all/customers")).alias("text"))


@query(f"""WITH n AS (SELECT c_custkey AS key, c_custkey % 4 AS version, {NOTE} AS text FROM customer),
    e AS (SELECT key, 1 AS seq, CASE WHEN key % 10 = 1 THEN text ELSE text || '1' END AS new, CASE WHEN key % 2 = 0 THEN version ELSE 99 END AS base, false AS force FROM n
        UNION ALL SELECT key, 2, text || '2', version, false FROM n WHERE key % 6 = 0 UNION ALL SELECT key, 3, text || '3', 99, true FROM n WHERE key % 15 = 0 UNION ALL SELECT -key, 4, 'new', 7, false FROM n WHERE key % 5 = 0),
    w AS (SELECT key, n.text, e.seq, e.new, CASE WHEN key % 15 = 0 THEN 3 WHEN key % 2 = 0 THEN 1 WHEN key % 6 = 0 THEN 2 END AS won FROM e LEFT JOIN n USING (key)),
    f AS (SELECT *, CASE WHEN key < 0 THEN new WHEN won IS NULL THEN text WHEN won = 1 AND key % 10 = 1 THEN text ELSE text || won END AS final FROM w),
    o AS (SELECT *, CASE WHEN key < 0 THEN 'created' WHEN seq = won THEN CASE WHEN new = text THEN 'same' ELSE 'written' END WHEN new = final THEN 'same' ELSE 'conflict' END AS outcome FROM f)
    SELECT key, seq, outcome, CASE WHEN outcome = 'conflict' THEN final END AS theirs FROM o""")
def edit_conflicts(spark, d):
    """Edits of stale versions come back unapplied, with the text that is there; forced ones go through, and gone notes are written back."""
    n = notes(spark, d)
    edit = lambda rows, seq, text, base, force=False: rows.select(P.path_of("customers", F.col("key")).alias("path"), F.lit(seq).alias("seq"), text.alias("text"), base.alias("base"), F.lit(force).alias("force"), "key")
    text, key, version = F.col("text"), F.col("key"), F.col("version")
    batch = edit(n, 1, F.when(key % 10 == 1, text).otherwise(F.concat(text, F.lit("1"))), F.when(key % 2 == 0, version).otherwise(99))
    batch = batch.unionByName(edit(n.where(key % 6 == 0), 2, F.concat(text, F.lit("2")), version)).unionByName(edit(n.where(key % 15 == 0), 3, F.concat(text, F.lit("3")), F.lit(99), True))
    gone = n.where(key % 5 == 0).withColumn("key", -key)
    batch = batch.unionByName(edit(gone, 4, F.lit("new"), F.lit(7)))
    return edits.committed(n.select("path", "text", "version"), batch).select("key", "seq", "outcome", "theirs")


@query("SELECT o_orderkey AS key, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS total FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, 'orders/' || o_orderkey || '.md' LIMIT 2000")
def dql_capped_total(spark, d):
    """The rows that cross to a caller, and the count of all."""
    rows = Rows.of(P.order_notes(spark, d)).where(F.col("total") > 1000).sort(F.col("total").desc())
    first, count = rows.capped()
    return first.select("key", F.lit(count()).cast("long").alias("total"))


@query("SELECT ext AS kind, n FROM (SELECT 'note' AS ext, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'canvas', (SELECT count(*) FROM supplier) UNION ALL SELECT 'view', (SELECT count(*) FROM nation) UNION ALL SELECT 'image', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT 'other', (SELECT count(*) FROM part WHERE p_partkey % 2 = 1))")
def files_by_kind(spark, d):
    kinds = [("customer", F.lit("md")), ("supplier", F.lit("canvas")), ("nation", F.lit("base")), ("part", F.when(F.col("p_partkey") % 2 == 0, "png").otherwise("pdf"))]
    files = None
    for table, ext in kinds:
        own = P.read(spark, d, table).select(ext.alias("ext"), (ext == "md").alias("is_note"))
        files = own if files is None else files.unionByName(own)
    return by_kind(files)


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, CASE WHEN o_orderkey % 10 = 0 THEN 'deleted' WHEN o_orderkey % 10 = 1 THEN 'edited' WHEN o_orderkey % 10 = 3 THEN 'new' END AS op FROM orders WHERE o_orderkey % 10 IN (0, 1, 3)")
def inc_listing_diff(spark, d):
    """What a listing says against the catalog: of ten orders one is gone, one newer, one longer by nothing, one not in the catalog."""
    key = F.col("o_orderkey")
    all_ = P.read(spark, d, "orders").select(key, P.path_of("orders", key).alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"), F.lit(7).alias("size"))
    listing = all_.where(key % 10 != 0).withColumn("mtime", F.when(key % 10 == 1, F.col("mtime") + F.expr("interval 1 hour")).otherwise(F.col("mtime")))
    return I.listing_diff(all_.where(key % 10 != 3), listing)


@query("SELECT DISTINCT 'customers/' || c_custkey || '.md' AS path FROM customer WHERE c_nationkey IN (3, 7) OR c_custkey % 5 = 2")
def inc_touched_by_names(spark, d):
    """Notes whose links may lead elsewhere after notes named 3, 7 and Two came or went."""
    c = P.read(spark, d, "customer")
    path = P.path_of("customers", F.col("c_custkey"))
    raw = c.select(path.alias("path"), F.concat(F.lit("nations/"), "c_nationkey", F.lit("#top")).alias("raw")).unionByName(c.where("c_custkey % 5 = 2").select(path.alias("path"), F.lit("../x/TWO.md|alias").alias("raw")))
    return I.touched_by_names(raw, spark.createDataFrame([("3",), ("7",), ("Two",)], "stem string"))


@query("""SELECT src, dst FROM (SELECT 'customers/' || c_custkey || '.md' AS src, 'nations/' || c_nationkey || '.md' AS dst, c_custkey AS k FROM customer) WHERE k % 4 <> 0
    UNION ALL SELECT 'customers/' || c_custkey || '.md', 'regions/' || (c_custkey % 5) || '.md' FROM customer WHERE c_custkey % 8 = 0""")
def graph_spliced(spark, d):
    """Links after the texts of a quarter of the customers changed: half of these lead to a region now, half nowhere."""
    c = P.read(spark, d, "customer")
    own = P.path_of("customers", F.col("c_custkey"))
    edges = c.select(own.alias("src"), P.path_of("nations", F.col("c_nationkey")).alias("dst"), F.lit(0).alias("ord"))
    changed = c.where("c_custkey % 4 = 0").select(own.alias("path"))
    new = c.where("c_custkey % 8 = 0").select(own.alias("src"), P.path_of("regions", F.col("c_custkey") % 5).alias("dst"), F.lit(0).alias("ord"))
    return G.spliced(edges, changed, new).select("src", "dst")


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS shown, TRY_CAST(regexp_extract(p_name || ' -' || p_size || '.5 x', '-?\\d+(\\.\\d+)?') AS DOUBLE) AS num,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size + p_partkey AS VARCHAR) END || p_brand AS total, p_brand AS most FROM part""")
def values_mixed(spark, d):
    """Texts and numbers of each other, and sums and extremes of mixed values."""
    p = P.read(spark, d, "part")
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    odd = F.when(key % 2 == 1, key.cast("double"))
    kinds = ["number", "number", "string"]
    return p.select(
        key.alias("key"), F.nullif(V.shown(F.when(key % 3 != 0, size), "number"), F.lit("")).alias("shown"), V.first_number(F.concat("p_name", F.lit(" -"), F.col("p_size").cast("string"), F.lit(".5 x"))).alias("num"),
        coerce.mixed_sum([size, odd, F.col("p_brand")], kinds).alias("total"), V.extreme([size, odd, F.col("p_brand")], kinds, greatest=True)["s"].alias("most"),
    )


@query("""SELECT o_orderkey AS key, true AS same_number, o_orderkey % 2 = 0 OR o_orderdate = TIMESTAMP '2000-01-01' AS same_day, o_orderkey % 3 = 0 AS names_note, o_orderdate < TIMESTAMP '1995-06-17' AS earlier, o_orderkey < 100 AS smaller, true AS none_last,
    'status|total' AS keys, o_orderstatus || '|' || o_orderpriority AS vals, n_regionkey = 2 AS to_region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def view_coercions(spark, d):
    """Values of different kinds compared as a view compares them; keys and values of objects; whether the note behind a link links to a region."""
    o = P.read(spark, d, "orders")
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    nation = P.read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), V.link(P.path_of("nations", F.col("c_nationkey"))).alias("to"))
    day = F.when(key % 2 == 0, F.date_format(date, "yyyy-MM-dd")).otherwise("2000-01-01")
    link, name = V.link(P.path_of("customers", F.col("o_custkey")), F.lit("shown")), F.when(key % 3 == 0, F.concat(F.lit("Customers/"), "o_custkey")).otherwise("other")
    fields = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("total"), F.col("o_orderpriority"))
    null = F.lit(None).cast("string")
    rows = o.join(nation, "o_custkey").select(
        key.alias("key"), coerce.view_equal(F.concat(F.lit(" "), key.cast("string"), F.lit(".0")), "string", key.cast("double"), "number").alias("same_number"), coerce.view_equal(date, "date", day, "string").alias("same_day"),
        coerce.view_equal(link, "link", name, "string").alias("names_note"), coerce.view_less(date, "date", F.lit("1995-06-17"), "string").alias("earlier"), coerce.view_less(F.concat(F.lit("n"), key.cast("string")), "string", F.lit("n100"), "string").alias("smaller"),
        (coerce.view_compare(null, "string", F.lit("z"), "string") == 1).alias("none_last"), F.array_join(coerce.object_keys(fields), "|").alias("keys"), F.array_join(coerce.object_values(fields), "|").alias("vals"), "to",
    )
    return coerce.links_to(rows, F.col("to"), P.edges(spark, d), "regions/2.md", "to_region").drop("to")


@query("""SELECT s_suppkey AS key, '{"nodes":[{"id":"a","file" : "moved/' || s_nationkey || ' $1.md","odd":{"x":1}},{"id":"b","type":"text","text":"nations/' || s_nationkey || '.md"},{"id":"c","file":"nations/' || s_nationkey || '.md.png"}],"more":[]}' AS text FROM supplier""")
def edit_canvas_references(spark, d):
    """Canvases of all suppliers after their nations' notes moved; what is no reference stays, and so do keys of other programs."""
    s = P.read(spark, d, "supplier")
    nation = F.col("s_nationkey").cast("string")
    old, new = F.concat(F.lit("nations/"), nation, F.lit(".md")), F.concat(F.lit("moved/"), nation, F.lit(" $1.md"))
    text = F.concat(F.lit('{"nodes":[{"id":"a","file" : "'), old, F.lit('","odd":{"x":1}},{"id":"b","type":"text","text":"'), old, F.lit('"},{"id":"c","file":"'), old, F.lit('.png"}],"more":[]}'))
    return s.select(F.col("s_suppkey").alias("key"), edits.canvas_moved(text, old, new).alias("text"))


@query("SELECT count(*) AS notes, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-30') AS today, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-24') AS week, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS links, count(DISTINCT o_orderpriority) AS tags FROM orders")
def dash_all_stats(spark, d):
    from quillstone.operators import dashboards as D

    return D.stats(P.order_notes(spark, d).withColumn("mtime", F.col("date")), F.lit("1998-07-30 12:00:00").cast("timestamp"), P.edges(spark, d))


@query("SELECT doc_id AS key FROM documents WHERE contains(CAST(doc_id AS VARCHAR), '1') AND contains(CAST(doc_id AS VARCHAR), '2') AND source = 'src2'")
def tool_find_in_folder(spark, d):
    from quillstone.operators import tools

    return tools.find_notes(P.document_notes(spark, d).withColumn("stem", F.col("key").cast("string")), "2 1", folder="docs/src2").select("key")
