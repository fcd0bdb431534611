"""Views: filters, formulas, groups and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import attempts
from quillstone.functions import values as V
from quillstone.operators.views import View, custom_summary, related, summary
from quillstone.plans.registry import query
from quillstone.sources import projection as P


@query("SELECT o_orderkey AS key FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice > 250000) AND NOT (o_orderpriority = '5-LOW' OR o_orderpriority = '4-NOT SPECIFIED')")
def view_filter_tree(spark, d):
    tree = {"and": [{"or": [F.col("status") == "O", F.col("total") > 250000]}, {"not": [F.col("priority") == "5-LOW", F.col("priority") == "4-NOT SPECIFIED"]}]}
    return View(["key"], filters=tree).rows(P.order_notes(spark, d))


@query("SELECT o_orderkey AS key, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS due, floor(o_totalprice * 110 + 0.5) / 100 AS gross FROM orders WHERE day(o_orderdate) >= 29 AND floor(o_totalprice * 110 + 0.5) / 100 > 200000")
def view_formula_month_clamp(spark, d):
    formulas = {"due": (lambda m: F.date_format(m, "yyyy-MM-dd"), ("moved",)), "moved": (lambda t: V.view_plus(t, months=1), ("date",)), "gross": (lambda t: F.floor(t * 110 + 0.5) / 100, ("total",))}
    return View(["key", "due", "gross"], filters=F.dayofmonth("date") >= 29, own_filters=F.col("gross") > 200000, formulas=formulas).rows(P.order_notes(spark, d))


@query("SELECT doc_id AS key, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, 'docs/' || source || '/' || lang || '/' || doc_id || '.md'")
def view_sort_nulls_last(spark, d):
    return View(["key", "quality"], sort=[("quality", "number", True)]).rows(P.document_notes(spark, d))


@query("SELECT c_custkey AS key FROM customer ORDER BY lower(c_mktsegment), c_custkey")
def view_sort_natural(spark, d):
    return View(["key"], sort=[("segment", "string", False), ("name", "string", False)]).rows(P.customer_notes(spark, d))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY 1")
def view_group_rows(spark, d):
    view = View(["key"], group=("segment", "string", False), summaries={"s": ("Sum", "balance", "number")})
    return view.groups(P.customer_notes(spark, d)).withColumn("s", F.round("s", 2))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') GROUP BY 1")
def view_group_order(spark, d):
    return View(["key"], group=("segment", "string", False), group_order=["Machinery", "Building", "none"]).groups(P.customer_notes(spark, d))


@query("SELECT round(avg(o_totalprice), 3) AS average, round(sum(o_totalprice), 1) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(median(o_totalprice), 3) AS middle, round(stddev_pop(o_totalprice), 3) AS spread, round(max(o_totalprice) - min(o_totalprice), 3) AS reach, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders")
def view_summaries_numeric(spark, d):
    names = {"average": "average", "total": "sum", "least": "min", "most": "max", "middle": "median", "spread": "stddev", "reach": "range"}
    view = View([], summaries={k: (v, "total", "number") for k, v in names.items()} | {"earliest": ("Earliest", "date", "date"), "latest": ("Latest", "date", "date")})
    out = view.totals(P.order_notes(spark, d))
    digits = {"average": 3, "total": 1, "middle": 3, "spread": 3, "reach": 3}
    return out.withColumns({k: F.round(k, n) for k, n in digits.items()} | {k: F.date_format(k, "yyyy-MM-dd") for k in ("earliest", "latest")})


@query("SELECT count(*) FILTER (toxic = 1) AS checked, count(*) FILTER (toxic <> 1) AS unchecked, count(*) FILTER (quality IS NULL) AS empty, count(quality) AS filled, count(DISTINCT quality) AS uniq FROM documents LEFT JOIN labels USING (doc_id)")
def view_summaries_counts(spark, d):
    notes = P.document_notes(spark, d)
    toxic = F.col("toxic") == 1
    return notes.agg(summary("checked", toxic, "boolean").alias("checked"), summary("unchecked", toxic, "boolean").alias("unchecked"), summary("empty", F.col("quality"), "number").alias("empty"), summary("filled", F.col("quality"), "number").alias("filled"), summary("unique", F.col("quality"), "number").cast("long").alias("uniq"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM customer GROUP BY 1")
def view_custom_summary(spark, d):
    positive = custom_summary(lambda values: values.filter(lambda v: v > 0).length, F.col("balance"))
    return View(["key"], group=("segment", "string", False)).groups(P.customer_notes(spark, d), positive=positive)


@query("SELECT p_partkey AS key, array_to_string(list_filter(string_split(p_type, ' '), lambda w: length(w) > 5), ',') AS f, array_to_string(list_transform(string_split(p_type, ' '), lambda w: w || length(w)), ',') AS m, CAST(length(replace(p_type, ' ', '')) AS INT) AS r, array_to_string(string_split(p_type, ' ')[-2:], ',') AS s FROM part")
def view_list_hof(spark, d):
    words = F.split("p_type", " ")
    return P.read(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.array_join(F.filter(words, lambda w: F.length(w) > 5), ",").alias("f"), F.array_join(F.transform(words, lambda w: F.concat(w, F.length(w).cast("string"))), ",").alias("m"),
        F.aggregate(words, F.lit(0), lambda acc, w: acc + F.length(w)).alias("r"), F.array_join(V.list_slice(words, -2), ",").alias("s"),
    )


@query("SELECT 'customers/' || c_custkey || '.md' AS path FROM customer WHERE c_nationkey = 7 UNION ALL SELECT 'suppliers/' || s_suppkey || '.md' FROM supplier WHERE s_nationkey = 7")
def view_haslink_this(spark, d):
    from quillstone.operators.rows import linking_to

    return linking_to(P.nodes(spark, d), P.edges(spark, d), "nations/7.md").select("path")


@query("SELECT 'customers/' || c_custkey || '.md' AS path, 1 AS shared FROM customer WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 11) AND c_custkey <> 11 UNION ALL SELECT 'suppliers/' || s_suppkey || '.md', 1 FROM supplier WHERE s_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 11)")
def view_related_overlap(spark, d):
    return related(P.edges(spark, d), "customers/11.md")


@query("SELECT c_custkey AS key, upper(left(c_mktsegment, 1)) || substr(c_mktsegment, 2) AS t, printf('%.2f', c_acctbal) AS fx, strftime(DATE '2024-02-29', '%d.%m.%y') AS f, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS w FROM customer")
def view_text_number_date_funcs(spark, d):
    c = P.customer_notes(spark, d)
    return c.select("key", V.title(F.col("segment")).alias("t"), F.format_string("%.2f", F.col("balance")).alias("fx"), V.view_format(F.lit("2024-02-29").cast("timestamp"), "DD.MM.YY").alias("f"), F.when(F.col("balance") > 0, "plus").otherwise("minus").alias("w"))


@query("SELECT p_partkey AS key, right(p_name, 5) AS tail, substr(p_name, 2, 3) AS part, reverse(p_name) AS turned, repeat(p_brand, 2) AS twice, contains(p_type, 'STEEL') AND contains(p_type, 'S') AS every, contains(p_type, 'TIN') OR contains(p_type, 'BRASS') AS some FROM part")
def view_text_methods(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    return P.read(spark, d, "part").select(
        F.col("p_partkey").alias("key"), V.text_slice(name, -5).alias("tail"), V.text_slice(name, 1, 4).alias("part"), F.reverse(name).alias("turned"), F.repeat("p_brand", F.lit(2)).alias("twice"),
        V.contains_all(kind, [F.lit("STEEL"), F.lit("S")]).alias("every"), V.contains_any(kind, [F.lit("TIN"), F.lit("BRASS")]).alias("some"),
    )


@query("SELECT p_partkey AS key, array_to_string(list_reverse(string_split(p_type, ' ')), ' ') AS turned, string_split(p_type, ' ')[-1] AS last, CAST(coalesce(list_position(string_split(p_type, ' '), 'STEEL') - 1, -1) AS BIGINT) AS at, len(list_filter(string_split(p_type, ' '), lambda w: w = 'TIN')) = 0 AS none FROM part")
def view_list_methods(spark, d):
    words = F.split("p_type", " ")
    return P.read(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.array_join(F.reverse(words), " ").alias("turned"), V.item(words, -1).alias("last"), V.index_of(words, F.lit("STEEL")).alias("at"),
        V.is_empty(F.filter(words, lambda w: w == "TIN"), "array").alias("none"),
    )


@query("SELECT (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total, key AS \"Key\", c_acctbal AS \"Balance of account\" FROM (SELECT c_custkey AS key, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, 'customers/' || c_custkey || '.md' LIMIT 15)")
def view_limit_total(spark, d):
    """The first rows under their display names, beside the number of all."""
    view = View(["key", "balance"], filters=F.col("balance") > 0, sort=[("balance", "number", True)], limit=15, names={"key": "Key", "balance": "Balance of account"})
    notes = P.customer_notes(spark, d)
    return view.rows(notes).withColumn("total", F.lit(view.total(notes).first()["total"]))


@query("SELECT c_custkey AS key, least(c_acctbal, c_nationkey) AS lo, greatest(c_acctbal, c_nationkey) AS hi, CAST(c_nationkey AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS no, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS len, true AS ok, c_custkey % 3 = 0 AS has, '&lt;b&gt;' || c_mktsegment || '&amp;' AS html FROM customer")
def view_globals(spark, d):
    c = P.read(spark, d, "customer")
    nation = F.col("c_nationkey").cast("string")
    some = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    fields = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("Due"), F.lit("x"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return c.select(
        F.col("c_custkey").alias("key"), V.view_least(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("lo"), V.view_greatest(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("hi"), V.as_number(nation, "string").alias("n"),
        V.as_number(F.col("c_name"), "string").alias("no"), F.size(V.as_list(some, "string")).alias("len"), V.is_type(F.col("c_acctbal"), "Number").alias("ok"), V.has_property(fields, "due").alias("has"),
        V.escape_html(F.concat(F.lit("<b>"), "c_mktsegment", F.lit("&"))).alias("html"),
    )


@query("""WITH t AS (SELECT c_custkey AS key, c_acctbal AS a, c_custkey % 7 AS b, CASE WHEN c_custkey % 5 = 0 THEN 'x' ELSE '' END || c_custkey AS s, '2024-02-' || (25 + c_custkey % 9) AS day FROM customer),
    r AS (SELECT key, CASE WHEN b = 0 THEN NULL ELSE round(a / b, 3) END AS ratio, TRY_CAST(s AS DOUBLE) * 2 AS twice, TRY_CAST(day AS DATE) AS d,
        CASE WHEN b = 0 THEN 'division by zero' WHEN TRY_CAST(s AS DOUBLE) IS NULL THEN 'not a number: ' || s WHEN TRY_CAST(day AS DATE) IS NULL THEN 'not a date: ' || day END AS e FROM t)
    SELECT key, ratio, twice, strftime(d, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS warning, CAST(NULL AS BIGINT) AS failed FROM r
    UNION ALL SELECT NULL, NULL, NULL, NULL, arg_min(e, key), count(e) FROM r""")
def view_row_errors(spark, d):
    """Formulas that divide, parse and cast bad values: null in their rows, and the first warning in a row of its own."""
    c = P.read(spark, d, "customer")
    key = F.col("c_custkey")
    text = F.concat(F.when(key % 5 == 0, "x").otherwise(""), key.cast("string"))
    day = attempts.day(F.concat(F.lit("2024-02-"), (25 + key % 9).cast("string")))
    rows = attempts.with_attempts(c.select("c_custkey", "c_acctbal"), ratio=attempts.divided(F.col("c_acctbal"), key % 7), twice=attempts.then(lambda n: n * 2, attempts.number(text)), day=attempts.then(lambda x: F.date_format(x, "yyyy-MM-dd"), day))
    none = F.lit(None)
    shown = rows.select(key.alias("key"), F.round("ratio", 3).alias("ratio"), "twice", "day", none.cast("string").alias("warning"), none.cast("long").alias("failed"))
    warned = attempts.first_warning(rows, key).select(none.cast("long").alias("key"), none.cast("double").alias("ratio"), none.cast("double").alias("twice"), none.cast("string").alias("day"), "warning", "failed")
    return shown.unionByName(warned)


@query("""SELECT o_orderpriority AS priority, count(*) AS n, round(median(o_totalprice), 4) AS middle, round((sum(o_totalprice) FILTER (o_totalprice > 100000)) / count(*), 3) AS share, count(DISTINCT o_custkey % 10) AS uniq,
    bool_and(o_totalprice > 1000) AS every, max(o_totalprice) - min(o_totalprice) AS reach, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY 1""")
def view_formula_summaries(spark, d):
    """Formulas over the values of groups, and a median of each group, which none of them holds in one task."""
    view = View(["key"], group=("priority", "string", False), summaries={"middle": ("Median", "total", "number")})
    total, of = F.col("total"), F.col("customer")
    more = {
        "share": custom_summary(lambda values: values.filter(lambda v: v > 100000).sum() / values.length, total), "uniq": custom_summary(lambda values: values.map(lambda v: F.regexp_extract(v, "([0-9]).md$", 1)).unique(), of),
        "every": custom_summary(lambda values: values.all(lambda v: v > 1000), total), "reach": custom_summary(lambda values: values.max() - values.min(), total), "some": custom_summary(lambda values: values.any(lambda v: v > 400000), total),
    }
    return view.groups(P.order_notes(spark, d), **more).withColumns({"middle": F.round("middle", 4), "share": F.round("share", 3)})
