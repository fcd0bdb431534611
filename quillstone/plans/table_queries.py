"""Table and list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import values as V
from quillstone.operators import rows as R
from quillstone.operators.rows import Rows
from quillstone.plans.registry import query
from quillstone.sources import projection as P

day = lambda c: F.date_format(c, "yyyy-MM-dd")


def now():
    """Queries are given the time; they don't take it from the clock."""
    return F.lit("1998-05-20 12:30:00").cast("timestamp")


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, o_orderstatus AS status, o_totalprice AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, path LIMIT 10")
def dql_table_where_sort_limit(spark, d):
    return Rows.of(P.order_notes(spark, d)).where(F.col("total") > 100000).sort(F.col("total").desc()).limit(10).table(path=F.col("path"), status=F.col("status"), total=F.col("total"))


@query("SELECT 'customers/' || c_custkey || '.md' AS path, c_name || ' (' || c_mktsegment || ')' AS value FROM customer WHERE c_acctbal < 0")
def dql_list_expr(spark, d):
    return Rows.of(P.customer_notes(spark, d)).where(F.col("balance") < 0).listed(F.concat("name", F.lit(" ("), "segment", F.lit(")")))


@query("SELECT 'docs/' || source || '/' || lang || '/' || doc_id || '.md' AS path, n_chars FROM documents WHERE lower('docs/' || source || '/' || lang || '/' || doc_id || '.md') LIKE 'docs/src1/%'")
def dql_from_folder(spark, d):
    return Rows.of(P.document_notes(spark, d)).where(R.in_folder(F.col("path"), "Docs/SRC1")).table(path=F.col("path"), n_chars=F.col("n_chars"))


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, 'priority/' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g') AS tag FROM orders UNION ALL SELECT 'customers/' || c_custkey || '.md', 'segment/' || lower(c_mktsegment) FROM customer WHERE c_mktsegment = 'BUILDING'")
def dql_from_tag_nested(spark, d):
    notes = P.order_notes(spark, d).select("path", "tags").unionByName(P.customer_notes(spark, d).select("path", "tags"))
    found = Rows.of(notes).where(R.has_tag(F.col("tags"), "#Priority") | R.has_tag(F.col("tags"), "segment/building"))
    return found.flatten("tag", F.col("tags")).table(path=F.col("path"), tag=F.col("tag"))


@query("SELECT 'customers/' || c_custkey || '.md' AS path FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'suppliers/' || s_suppkey || '.md' FROM supplier WHERE s_nationkey = 3")
def dql_from_backlinks(spark, d):
    return R.linking_to(P.nodes(spark, d), P.edges(spark, d), "nations/3.md").select("path")


@query("SELECT 'customers/' || o_custkey || '.md' AS path, 0 AS link_ord FROM orders WHERE o_orderkey = 7")
def dql_from_outgoing(spark, d):
    return R.linked_from(P.nodes(spark, d), P.edges(spark, d), "orders/7.md").select("path", "link_ord")


@query("SELECT 'customers/' || c_custkey || '.md' AS path FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND NOT c_nationkey = 5")
def dql_from_algebra(spark, d):
    notes, edges = P.customer_notes(spark, d), P.edges(spark, d)
    tagged = notes.where(R.has_tag(F.col("tags"), "segment/building"))
    return R.without(R.either(tagged, R.linking_to(notes, edges, "nations/3.md")), R.linking_to(notes, edges, "nations/5.md")).select("path")


@query("SELECT o_orderpriority AS priority, count(*) AS n, min('orders/' || o_orderkey || '.md') AS first_path FROM orders GROUP BY ALL")
def dql_group_rows_length(spark, d):
    return Rows.of(P.order_notes(spark, d)).group("priority", F.col("priority"), n=F.count("*"), first_path=F.min("path")).table(priority=F.col("priority"), n=F.col("n"), first_path=F.col("first_path"))


@query("SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY ALL")
def dql_group_sum_avg_min_max(spark, d):
    t = F.col("total")
    return Rows.of(P.order_notes(spark, d)).group("status", F.col("status"), s=F.round(F.sum(t), 2), a=F.round(F.avg(t), 4), lo=F.min(t), hi=F.max(t)).df


@query("SELECT 'customers/' || o_custkey || '.md' AS customer, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 15")
def dql_group_having(spark, d):
    return Rows.of(P.order_notes(spark, d)).group("customer", F.col("customer"), n=F.count("*")).where(F.col("n") > 15).df


@query("SELECT 'customers/' || o_custkey || '.md' AS customer, string_agg('orders/' || o_orderkey || '.md', ',' ORDER BY 'orders/' || o_orderkey || '.md') AS paths FROM orders GROUP BY 1")
def dql_group_nested_rows(spark, d):
    return Rows.of(P.order_notes(spark, d)).group_rows("customer", F.col("customer"), "path").table(customer=F.col("customer"), paths=F.array_join(F.transform("rows", lambda r: r["path"]), ","))


@query("SELECT doc_id AS key, w AS word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents WHERE lang = 'es')")
def dql_flatten_list(spark, d):
    return Rows.of(P.document_notes(spark, d).where("lang = 'es'")).flatten("word", F.split("text", " ")).table(key=F.col("key"), word=F.col("word"))


@query("SELECT doc_id AS key, CAST(x AS DOUBLE) AS x FROM (SELECT doc_id, unnest(CASE WHEN quality IS NULL THEN [NULL] WHEN quality = 0 THEN [] ELSE [quality, toxic] END) AS x FROM documents LEFT JOIN labels USING (doc_id))")
def dql_flatten_null_vs_empty(spark, d):
    values = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("quality").cast("int"), F.col("toxic").cast("int")))
    return Rows.of(P.document_notes(spark, d)).flatten("x", values.cast("array<int>")).table(key=F.col("key"), x=F.col("x").cast("double"))


@query("SELECT path, total FROM (SELECT 'orders/' || o_orderkey || '.md' AS path, o_totalprice AS total, o_orderstatus AS s FROM orders ORDER BY o_totalprice DESC, path LIMIT 100) WHERE s = 'F'")
def dql_limit_before_where(spark, d):
    return Rows.of(P.order_notes(spark, d)).sort(F.col("total").desc()).limit(100).where(F.col("status") == "F").table(path=F.col("path"), total=F.col("total"))


@query("SELECT doc_id AS key, quality IS NOT DISTINCT FROM toxic AS same, coalesce(quality < 1, false) AS below FROM documents LEFT JOIN labels USING (doc_id)")
def dql_null_equality(spark, d):
    return P.document_notes(spark, d).select("key", V.equal(F.col("quality"), F.col("toxic")).alias("same"), V.less(F.col("quality"), F.lit(1)).alias("below"))


@query("SELECT doc_id AS key, CAST(quality AS DOUBLE) AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS FIRST, 'docs/' || source || '/' || lang || '/' || doc_id || '.md'")
def dql_sort_nulls(spark, d):
    return Rows.of(P.document_notes(spark, d)).sort(F.col("quality").asc()).table(key=F.col("key"), quality=F.col("quality").cast("double"))


@query("SELECT 'orders/' || o_orderkey || '.md' AS path, c_name AS name, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000")
def dql_link_deref(spark, d):
    orders = P.order_notes(spark, d).where("total > 300000")
    nations = P.read(spark, d, "nation").select(P.path_of("nations", F.col("n_nationkey")).alias("path"), F.col("n_name").alias("name"))
    step = R.followed(orders, F.col("customer"), P.customer_notes(spark, d), name="name", to_nation="nation")
    return R.followed(step, F.col("to_nation"), nations, nation="name").select("path", "name", "nation")


@query("SELECT o_orderkey AS key, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, isodow(o_orderdate) AS wd, weekofyear(o_orderdate) AS wk FROM orders")
def dql_date_parts(spark, d):
    return P.order_notes(spark, d).select("key", *[V.date_part(F.col("date"), p).cast("long").alias(n) for p, n in (("year", "y"), ("month", "m"), ("day", "dd"), ("weekday", "wd"), ("week", "wk"))])


@query("SELECT o_orderkey AS key, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS DOUBLE) AS days FROM orders WHERE o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1998-05-20'")
def dql_date_duration_math(spark, d):
    later = V.plus_ms(F.col("date"), V.duration_ms("10 days"))
    notes = P.order_notes(spark, d).where(V.plus_ms(F.col("date"), V.duration_ms("1 month")) >= F.lit("1998-05-20").cast("timestamp"))
    return notes.select("key", day(later).alias("later"), F.floor(V.between_ms(F.col("date"), F.lit("1992-01-01").cast("timestamp")) / V.DAY_MS).cast("double").alias("days"))


@query("SELECT doc_id AS key, CASE WHEN coalesce(quality, 0) <> 0 THEN 'good' ELSE 'other' END AS c, coalesce(toxic, -1) AS t FROM documents LEFT JOIN labels USING (doc_id)")
def dql_choice_default(spark, d):
    return P.document_notes(spark, d).select("key", F.when(V.truthy(F.col("quality"), "number"), "good").otherwise("other").alias("c"), F.coalesce("toxic", F.lit(-1)).alias("t"))


@query("SELECT p_partkey AS key, contains(p_name, 'a') AS c, contains(lower(p_type), 'brass') AS i, list_contains(string_split(p_type, ' '), 'BRASS') AS e, len(list_filter(string_split(p_type, ' '), lambda x: contains(x, 'RA'))) > 0 AS l FROM part")
def dql_contains_family(spark, d):
    words = F.split("p_type", " ")
    return P.read(spark, d, "part").select(
        F.col("p_partkey").alias("key"), V.contains(F.col("p_name"), F.lit("a")).alias("c"), V.icontains(F.col("p_type"), F.lit("brass")).alias("i"), V.econtains(words, F.lit("BRASS"), "array").alias("e"), V.contains(words, F.lit("RA"), "array").alias("l")
    )


@query("SELECT p_partkey AS key, regexp_full_match(p_brand, 'Brand#[1-3].') AS m, regexp_matches(p_type, 'STEEL$') AS t, regexp_replace(p_name, '[aeiou]', '*', 'g') AS r, false AS bad FROM part")
def dql_regex_family(spark, d):
    return P.read(spark, d, "part").select(
        F.col("p_partkey").alias("key"), V.regexmatch("Brand#[1-3].", F.col("p_brand")).alias("m"), V.regextest("STEEL$", F.col("p_type")).alias("t"), F.regexp_replace("p_name", "[aeiou]", "*").alias("r"), V.regextest("(", F.col("p_name")).alias("bad")
    )


@query("SELECT c_custkey AS key, lower(c_name) AS l, CASE WHEN length(c_mktsegment) >= 9 THEN c_mktsegment ELSE lpad(c_mktsegment, 9, '.') END AS p, CASE WHEN length(c_name) <= 12 THEN c_name ELSE left(c_name, 12) || '...' END AS t, replace(c_name, '#', ' no ') AS r, starts_with(c_name, 'Cust') AS s FROM customer")
def dql_string_funcs(spark, d):
    return P.customer_notes(spark, d).select("key", F.lower("name").alias("l"), V.pad_left(F.col("segment"), 9, ".").alias("p"), V.truncate(F.col("name"), 12).alias("t"), F.replace(F.col("name"), F.lit("#"), F.lit(" no ")).alias("r"), F.col("name").startswith("Cust").alias("s"))


@query("SELECT c_custkey AS key, floor(c_acctbal + 0.5) AS r0, floor(c_acctbal * 10 + 0.5) / 10 AS r1, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS DOUBLE) AS f, CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS q FROM customer")
def dql_math_funcs(spark, d):
    c, b = P.read(spark, d, "customer"), F.col("c_acctbal")
    return c.select(F.col("c_custkey").alias("key"), V.half_up(b).alias("r0"), V.half_up(b, 1).alias("r1"), F.abs(b).alias("a"), F.floor(b).cast("double").alias("f"), V.divide(b, F.col("c_nationkey")).alias("q"))


@query("SELECT p_partkey AS key, array_to_string(list_sort(string_split(p_name, ' ')), ',') AS s, array_to_string(list_reverse(string_split(p_name, ' ')), ',') AS r, CAST(len(list_distinct(string_split(p_type, ' '))) AS INT) AS u, string_split(p_name, ' ')[-1] AS last FROM part")
def dql_list_funcs(spark, d):
    words = F.split("p_name", " ")
    return P.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array_join(F.sort_array(words), ",").alias("s"), F.array_join(F.reverse(words), ",").alias("r"), F.size(F.array_distinct(F.split("p_type", " "))).alias("u"), V.item(words, -1).alias("last"))


@query("SELECT o_orderkey AS key, strftime(o_orderdate, '%d/%m/%Y') AS f, CAST(o_orderdate >= date_trunc('month', TIMESTAMP '1998-05-20 12:30:00') AND o_orderdate < date_trunc('month', TIMESTAMP '1998-05-20 12:30:00') + INTERVAL 1 MONTH AS BOOLEAN) AS this_month FROM orders")
def dql_dateformat_words(spark, d):
    t = F.col("date")
    this = (t >= V.date_word("som", now())) & (t <= V.date_word("eom", now()))
    return P.order_notes(spark, d).select("key", V.dateformat(t, "dd/MM/yyyy").alias("f"), this.alias("this_month"))


@query("SELECT doc_id AS key FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'text' ELSE CAST(n_chars AS VARCHAR) END AS v, doc_id % 4 AS k, n_chars FROM documents) ORDER BY CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END, CASE WHEN k > 1 THEN n_chars END, doc_id")
def dql_sort_mixed_types(spark, d):
    key = F.col("key")
    raw = F.when(key % 4 == 0, F.lit(None)).when(key % 4 == 1, "text").otherwise(F.col("n_chars").cast("string"))
    return Rows.of(P.document_notes(spark, d), "key").sort(V.from_text(raw).asc()).table(key=key)


@query("SELECT o_orderkey AS key, 'customers/' || o_custkey || '.md' AS path, 'part ' || o_orderpriority AS subpath, o_orderpriority AS display FROM orders")
def dql_link_meta(spark, d):
    notes = P.order_notes(spark, d)
    made = V.link(F.concat(F.col("customer"), F.lit("#part "), F.col("priority")), F.col("priority"))
    return notes.select("key", made.alias("l")).select("key", "l.path", "l.subpath", "l.display")


@query("SELECT doc_id AS key, CASE WHEN quality IS NULL THEN 'null' ELSE 'number' END AS a, 'string' AS b, 'array' AS c, 'link' AS l, 'duration' AS t FROM documents LEFT JOIN labels USING (doc_id)")
def dql_typeof(spark, d):
    return P.document_notes(spark, d).select("key", V.kind_name(F.col("quality")).alias("a"), V.kind_name(F.col("lang")).alias("b"), V.kind_name(F.col("tags")).alias("c"), V.kind_name(V.link(F.col("path"))).alias("l"), V.kind_name(F.make_dt_interval(F.col("key").cast("int"))).alias("t"))


@query("SELECT o_orderkey AS key, CAST(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01') AS DOUBLE) / 86400000 / 7 AS weeks, CAST(epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1992-01-01') AS DOUBLE) / 3600000 AS hours, strftime(o_orderdate, '%Y-%m-%d') AS named FROM orders")
def dql_duration_parts(spark, d):
    since = V.between_ms(F.col("date"), F.lit("1992-01-01").cast("timestamp"))
    named = F.concat(F.lit("log/"), F.date_format("date", "yyyy-MM-dd"), F.lit(".md"))
    return P.order_notes(spark, d).select("key", V.duration_part(since, "weeks").alias("weeks"), V.duration_part(since, "hours").alias("hours"), day(V.link_date(named)).alias("named"))


@query("SELECT 'orders/' || o_orderkey || '.md' AS path FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 2 = 1 AND o_custkey IN (SELECT c_custkey FROM customer)")
def dql_from_and(spark, d):
    """Notes with a tag that also link to a customer of an odd number; tags are a table of their own."""
    notes, edges = P.order_notes(spark, d), P.edges(spark, d)
    tags = notes.select("path", F.explode("tags").alias("tag_lc"))
    odd = P.customer_notes(spark, d).where("key % 2 = 1").select(F.col("path").alias("dst"))
    return R.both(R.tagged_notes(notes, tags, "#priority/1-URGENT"), edges.join(odd, "dst").select(F.col("src").alias("path"))).select("path")
