"""Reading of Markdown notes, boards and canvases, over notes whose texts are written from the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import edits
from quillstone.plans.registry import query
from quillstone.sources import markdown as M
from quillstone.sources import projection as P
from quillstone.sources.scratch import widened


def files(spark, d):
    """A note of every customer and nation, with front matter, links, tags, tasks, code and headings."""
    c = widened(P.read(spark, d, "customer"), "c_custkey")  # few bytes a row, but much work
    key, nation, segment = (F.col(x).cast("string") for x in ("c_custkey", "c_nationkey", "c_mktsegment"))
    day = F.concat(F.lit("2024-01-0"), (F.col("c_custkey") % 9 + 1).cast("string"))
    parts = [
        "---\nsegment: ", segment, "\ntags: [kind/", F.lower(segment), ", \"x", (F.col("c_custkey") % 3).cast("string"), "\"]\nnames:\n  - ", F.col("c_name"), "\n  - 'other'\n---\n# Customer ", key, "\n\nLives in [[nations/", nation, "|home]], see [[", nation,
        "#top]] and [one](../nations/", (F.col("c_nationkey") % 5).cast("string"), ".md) or [site](https://example.org/x) #lang/n", nation, " #12\nrank:: ", (F.col("c_custkey") % 7).cast("string"),
        "\n- [ ] call 📅 ", day, "\n  - [x] dial\n  - [", F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(" "), "] talk [due:: ", day, "]\n- [/] write\n\n## Notes ##\nsome `[[code]] #code`\n```\n- [ ] hidden [[hidden]]\n# no heading\n```\n### Deep\ndeep\n## End\nlast\n",
    ]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = P.path_of("customers", F.col("c_custkey"))
    own = c.select("c_custkey", path.alias("path"), F.lit("customers").alias("folder"), key.alias("stem"), text.alias("text"))
    n = P.read(spark, d, "nation").select(F.lit(None).cast("long").alias("c_custkey"), P.path_of("nations", F.col("n_nationkey")).alias("path"), F.lit("nations").alias("folder"), F.col("n_nationkey").cast("string").alias("stem"), F.concat(F.lit("# "), "n_name").alias("text"))
    return own.unionByName(n).withColumns({"size": F.octet_length("text"), "mtime": F.lit("2024-01-01").cast("timestamp"), "is_note": F.lit(True)})


def customers(spark, d):
    return files(spark, d).where("folder = 'customers'").withColumnRenamed("c_custkey", "key")


@query("SELECT c_custkey AS key, c_mktsegment AS segment, c_name || '|other' AS names, CAST(c_custkey % 7 AS VARCHAR) AS rank, 5 AS n FROM customer")
def md_fields(spark, d):
    f = customers(spark, d).select("key", M.fields(F.col("text")).alias("f"))
    return f.select("key", F.col("f.segment")[0].alias("segment"), F.array_join("f.names", "|").alias("names"), F.col("f.rank")[0].alias("rank"), F.size("f").alias("n"))


@query("SELECT c_custkey AS key, 'nations/' || c_nationkey || '|' || c_nationkey || '|../nations/' || (c_nationkey % 5) || '.md' AS links, 'kind/' || lower(c_mktsegment) || '|x' || (c_custkey % 3) || '|lang/n' || c_nationkey AS tags FROM customer")
def md_links_tags(spark, d):
    t = F.col("text")
    return customers(spark, d).select("key", F.array_join(M.links(t), "|").alias("links"), F.array_join(M.tags(t), "|").alias("tags"))


@query("SELECT 'customers/' || c_custkey || '.md' AS src, 'nations/' || n || '.md' AS dst, ord FROM (SELECT c_custkey, c_nationkey AS n, 0 AS ord FROM customer UNION ALL SELECT c_custkey, c_nationkey % 5, 2 FROM customer WHERE c_nationkey % 5 <> c_nationkey)")
def md_resolved_links(spark, d):
    """A customer whose number is its nation's has a link to that number, which leads to the note beside it, so it is left out here."""
    all_ = files(spark, d).where("folder = 'nations' or c_custkey is not null")
    notes = M.note_table(all_)
    return M.resolved(notes.where("folder = 'customers'"), all_.where("folder = 'nations'"))


@query("""WITH files AS (SELECT 'd' || (o_orderkey % 13) || '/' || lower(o_orderpriority[3:]) || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'x/' ELSE '' END || (o_custkey % 100) || '.md' AS path FROM orders),
    links AS (SELECT c_custkey, 0 AS ord, CAST(c_custkey % 120 AS VARCHAR) AS raw FROM customer UNION ALL SELECT c_custkey, 1, 'HIGH/' || c_custkey % 120 FROM customer UNION ALL SELECT c_custkey, 2, 'x/' || c_custkey % 120 || '.md' FROM customer),
    ends AS (SELECT DISTINCT raw, path FROM (SELECT DISTINCT raw FROM links), (SELECT DISTINCT path FROM files) WHERE ends_with('/' || path, '/' || lower(raw)) OR ends_with('/' || path, '/' || lower(raw) || '.md')),
    best AS (SELECT raw, arg_min(path, (length(path), path)) AS dst FROM ends GROUP BY raw)
    SELECT 'customers/' || c_custkey || '.md' AS src, dst, min(ord) AS ord FROM links JOIN best USING (raw) GROUP BY ALL""")
def md_suffix_links(spark, d):
    """Links by name, by folder and name, and by a name with its extension, among files of the orders' making that share few names."""
    o = P.read(spark, d, "orders")
    path = F.concat(F.lit("d"), F.col("o_orderkey") % 13, F.lit("/"), F.lower(F.substr("o_orderpriority", F.lit(3))), F.lit("/"), F.when(F.col("o_orderkey") % 3 == 0, "x/").otherwise(""), F.col("o_custkey") % 100, F.lit(".md"))
    key = F.col("c_custkey") % 120
    links = F.array(key.cast("string"), F.concat(F.lit("HIGH/"), key), F.concat(F.lit("x/"), key, F.lit(".md")))
    notes = P.read(spark, d, "customer").select(P.path_of("customers", F.col("c_custkey")).alias("path"), F.lit("customers").alias("folder"), links.alias("links"))
    return M.resolved(notes, o.select(path.alias("path")).distinct())


@query("""SELECT c_custkey AS key, k, status, text, parent_k, due, completed, fully FROM customer, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3), LATERAL (SELECT '2024-01-0' || (c_custkey % 9 + 1) AS d),
    LATERAL (SELECT CASE k WHEN 0 THEN ' ' WHEN 1 THEN 'x' WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE ' ' END ELSE '/' END AS status, CASE k WHEN 0 THEN 'call 📅 ' || d WHEN 1 THEN 'dial' WHEN 2 THEN 'talk [due:: ' || d || ']' ELSE 'write' END AS text,
        CASE WHEN k IN (1, 2) THEN 0 END AS parent_k, CASE WHEN k IN (0, 2) THEN d END AS due), LATERAL (SELECT status = 'x' AS completed, status = 'x' AS fully)""")
def md_tasks(spark, d):
    tasks = M.task_table(customers(spark, d).select(F.col("key").alias("path"), M.tasks(F.col("text")).alias("tasks")))
    return tasks.select(F.col("path").alias("key"), "k", "status", "text", "parent_k", F.date_format("due", "yyyy-MM-dd").alias("due"), "completed", F.col("fully_completed").alias("fully"))


@query("SELECT c_custkey AS key, '1 Customer ' || c_custkey || '|2 Notes|3 Deep|2 End' AS outline, '## Notes ##' || chr(10) || 'some `[[code]] #code`' || chr(10) || '```' || chr(10) || '- [ ] hidden [[hidden]]' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || '### Deep' || chr(10) || 'deep' AS notes, CAST(len(regexp_extract_all('# Customer 1 Lives in [[nations/1|home]], see [[1#top]] and [one](../nations/1.md) or [site](https://example.org/x) #lang/n1 #12', '\\S+')) AS INT) AS words FROM customer")
def md_outline_section(spark, d):
    t = F.col("text")
    first = F.substring_index(M.body(t), "\nrank::", 1)
    return customers(spark, d).select("key", F.array_join(F.transform(M.headings(t), lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"])), "|").alias("outline"), M.section(t, "notes").alias("notes"), M.word_count(first).alias("words"))


@query("SELECT o_orderstatus AS lane, count(*) AS cards, count(*) FILTER (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS done FROM orders GROUP BY 1")
def md_boards(spark, d):
    """A board for each order, with its card in the lane of its state."""
    from quillstone.operators.tools import card_counts

    o = P.read(spark, d, "orders")
    text = F.concat(F.lit("---\nboard: yes\n---\n## "), "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "\n**Complete**").otherwise(""), F.lit("\n- ["), F.when(F.col("o_orderpriority") == "1-URGENT", "x").otherwise(" "), F.lit("] order\n\n***\n## Archive\n- [ ] old\n"))
    cards = o.select(F.explode(M.board(text)).alias("c")).select("c.*")
    return card_counts(cards)


@query("SELECT s_suppkey AS key, 2 AS nodes, 's|n' AS edge, 'nations/' || s_nationkey || '.md' AS file, s_name AS text FROM supplier")
def md_canvases(spark, d):
    s = P.read(spark, d, "supplier")
    nodes = F.array(
        F.struct(F.lit("s").alias("id"), F.lit("text").alias("type"), F.col("s_name").alias("text"), F.lit(None).cast("string").alias("file")),
        F.struct(F.lit("n").alias("id"), F.lit("file").alias("type"), F.lit(None).cast("string").alias("text"), P.path_of("nations", F.col("s_nationkey")).alias("file")),
    )
    text = F.to_json(F.struct(nodes.alias("nodes"), F.array(F.struct(F.lit("e").alias("id"), F.lit("s").alias("fromNode"), F.lit("n").alias("toNode"))).alias("edges")))
    c = s.select(F.col("s_suppkey").alias("key"), M.canvas(text).alias("c"))
    return c.select("key", F.size("c.nodes").alias("nodes"), F.concat_ws("|", F.col("c.edges")[0]["fromNode"], F.col("c.edges")[0]["toNode"]).alias("edge"), F.col("c.nodes")[1]["file"].alias("file"), F.col("c.nodes")[0]["text"].alias("text"))


@query("SELECT c_custkey AS key, 'Lives in [[N' || c_nationkey || '|home]], see [[N' || c_nationkey || '#top]] and [one](../places/N' || c_nationkey || '.md) or [[other]]' AS text FROM customer")
def md_renamed_links(spark, d):
    """Links of every customer follow when the nation's note moves."""
    c = widened(P.read(spark, d, "customer"), "c_custkey")
    n = F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("Lives in [[nations/n"), n, F.lit("|home]], see [[n"), n, F.lit("#top]] and [one](../nations/n"), n, F.lit(".md) or [[other]]"))
    old, new = F.concat(F.lit("nations/n"), n, F.lit(".md")), F.concat(F.lit("places/N"), n, F.lit(".md"))
    return c.select(F.col("c_custkey").alias("key"), edits.moved_links(text, P.path_of("customers", F.col("c_custkey")), old, new).alias("text"))


@query("""SELECT c_custkey AS key, 'customers' AS folder, 'md' AS ext, c_custkey || '' AS name, '#kind/' || lower(c_mktsegment) || '|#x' || (c_custkey % 3) || '|#lang/n' || c_nationkey AS tags, '2024-03-05' AS mday, CAST(NULL AS VARCHAR) AS day,
    c_mktsegment AS segment FROM customer""")
def md_file_fields(spark, d):
    notes = M.note_table(files(spark, d).where("folder = 'customers'").withColumn("mtime", F.lit("2024-03-05 10:20:30").cast("timestamp")))
    f = M.file_fields(notes)
    return f.select(F.col("name").cast("long").alias("key"), "folder", "ext", "name", F.array_join("tags", "|").alias("tags"), F.date_format("mday", "yyyy-MM-dd").alias("mday"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("frontmatter")["segment"][0].alias("segment"))


@query("SELECT c_custkey AS key, k, k = 0 AS has_children, CASE k WHEN 0 THEN '1,2' ELSE '' END AS children, k <> 0 AND NOT (k = 2 AND c_custkey % 2 = 1) AS checked FROM customer, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)")
def md_task_fields(spark, d):
    tasks = M.task_table(customers(spark, d).select(F.col("key").alias("path"), M.tasks(F.col("text")).alias("tasks")))
    return tasks.select(F.col("path").alias("key"), "k", (F.size("children") > 0).alias("has_children"), F.array_join("children", ",").alias("children"), "checked")
