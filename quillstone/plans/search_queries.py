"""Full-text search, quotations and document status."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.operators.search import Term
from quillstone.operators import tools
from quillstone.operators.segments import SearchIndex, find_quote
from quillstone.operators.status import status_byte, status_of
from quillstone.plans.registry import query
from quillstone.sources import projection as P
from quillstone.sources.scratch import fingerprint, listed, remove_folder, shared_folder, widened

# The words of a text, as the SQL sees them, and what begins in one at a joint or its start, with and without accents.
PATTERN = r"'[\p{L}\p{N}]+(?:[-._/][\p{L}\p{N}]+)*'"
WORDS = f"list_filter(regexp_extract_all(lower(text), {PATTERN}), lambda w: length(w) <= 48)"


def start(prefix):
    return f"len(list_filter({WORDS}, lambda w: regexp_matches(w, '(^|[-._/]){prefix}') OR regexp_matches(strip_accents(w), '(^|[-._/]){prefix}'))) > 0"


def forms(documents):
    """A row for each form of each word: the word, its parts and its tails, also without accents."""
    return f"""WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS w FROM {documents}),
        f AS (SELECT doc_id, w AS f FROM w UNION SELECT doc_id, strip_accents(replace(w, 'đ', 'd')) FROM w),
        g AS (SELECT doc_id, f AS word FROM f UNION ALL SELECT doc_id, unnest(string_split_regex(f, '[-._/]')) FROM f
              UNION ALL SELECT doc_id, substr(f, i + 1) FROM (SELECT doc_id, f, CAST(unnest(range(1, length(f))) AS INT) AS i FROM f WHERE regexp_matches(f, '[-._/]')) WHERE regexp_matches(substr(f, i, 1), '[-._/]'))
        SELECT word, count(DISTINCT doc_id) AS notes FROM g GROUP BY 1"""


#: Notes of a task.
NOTES = 4000


def indexed(spark, d):
    """Notes, and their index: written once a session for these very files, in the shared folder. That of files no longer there goes."""
    notes = P.document_notes(spark, d)
    base = f"{shared_folder(spark)}/search-{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()}"
    now = fingerprint(spark, f"{d}/documents.parquet")
    index = SearchIndex(spark, f"{base}/{now}")
    if index.generation() < 0:
        for old in listed(spark, base):
            remove_folder(spark, f"{base}/{old}")
        index.build(notes)
    return notes, index


@query(forms("documents"))
def search_tokens_df(spark, d):
    """The index built anew, and how many notes have each word of it."""
    notes = S.one_a_key(P.document_notes(spark, d).select("key", "text"))
    return S.postings(widened(notes, "key", NOTES)).where(F.col("word") != S.LONG_MARK).groupBy("word").agg(F.count("*").alias("notes"))


@query(f"SELECT doc_id AS key FROM documents WHERE {start('ther')} AND {start('ing')}")
def search_prefix_and(spark, d):
    notes, index = indexed(spark, d)
    return S.search(notes, index, [[Term("ther")], [Term("Ing")]]).select("key")


@query(f"SELECT doc_id AS key FROM documents WHERE ({start('ther')} OR {start('cion')} OR {start('keit')}) AND NOT {start('reou')}")
def search_or_not(spark, d):
    notes, index = indexed(spark, d)
    return S.search(notes, index, [[Term("ther"), Term("cion"), Term("keit")]], [Term("reou")]).select("key")


@query(f"SELECT doc_id AS key FROM documents WHERE NOT {start('th')}")
def search_negative_only(spark, d):
    notes, index = indexed(spark, d)
    return S.search(notes, index, [], [Term("th")]).select("key")


@query(f"SELECT doc_id AS key FROM documents WHERE len(list_filter({WORDS}, lambda w: contains(w, 'thnt'))) > 0")
def search_fragment(spark, d):
    notes, index = indexed(spark, d)
    return S.search(notes, index, [[Term("thnt", "fragment")]]).select("key")


@query("SELECT doc_id AS key FROM documents WHERE contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the')")
def search_phrase(spark, d):
    # No term asks the index, so none is built.
    return S.search(widened(P.document_notes(spark, d), "key"), None, [[Term("of  the", "phrase")]]).select("key")


@query("SELECT doc_id AS key FROM documents WHERE source = 'src2' AND (starts_with('lang/' || lang, 'lang/d')) AND lang = 'de' AND contains(CAST(doc_id AS VARCHAR), '3')")
def search_fields(spark, d):
    return S.search(P.document_notes(spark, d), None, [[Term("docs/SRC2/", field="path")], [Term("lang/de", field="tag")], [Term("3", field="title")]]).select("key")


@query(f"SELECT doc_id AS key FROM documents WHERE {start('etre')}")
def search_accent_fold(spark, d):
    notes, index = indexed(spark, d)
    return S.search(notes, index, [[Term("etre")]]).select("key")


@query("SELECT doc_id AS key FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(toxic = 1, false), NOT contains(CAST(doc_id AS VARCHAR), '7'), doc_id")
def search_rank_superseded_last(spark, d):
    found = P.document_notes(spark, d)
    return S.ranked(found, "7", F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("key").cast("string")).select("key")


AT = "coalesce(nullif(instr(lower(text), 'then '), 0), nullif(instr(lower(text), 'cion'), 0), nullif(instr(strip_accents(lower(text)), 'then '), 0), nullif(instr(strip_accents(lower(text)), 'cion'), 0))"


@query(rf"SELECT doc_id AS key, coalesce(regexp_replace(substr(text, CAST(greatest(pos - 50, 1) AS INT), CAST(pos + 110 - greatest(pos - 50, 1) AS INT)), '\s+', ' ', 'g'), '') AS snippet FROM (SELECT doc_id, text, {AT} AS pos FROM documents)")
def search_snippet(spark, d):
    return P.document_notes(spark, d).select("key", S.snippet(F.col("text"), "then ", "cion").alias("snippet"))


MASKED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '`[^`\n]+`', ' ', 'g'), '!?\[\[[^\]\n]*\]\]', ' ', 'g'), '!?\[[^\]\n]*\]\([^)\n]*\)', ' ', 'g'), '\bhttps?://\S+', ' ', 'g'), '(^|[^\p{L}\p{N}_])#[\p{L}\p{N}_/-]+', '\1 ', 'g')"""


@query(rf"SELECT doc_id AS key, mentions FROM (SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower({MASKED}), '[\p{{L}}\p{{N}}_]+'), lambda w: w IN ('then', 'thing', 'reou'))) AS INT) AS mentions FROM documents WHERE source <> 'src3') WHERE mentions > 0")
def mentions_whole_word(spark, d):
    notes = P.document_notes(spark, d)
    return S.mentions(notes, ["then", "Thing", "reou"], exclude=notes.where("source = 'src3'").select("path")).select("key", "mentions")


@query()
def quote_verify(spark, d):
    checked = S.quote_check(F.col("text"), "The and of 12 then")
    return P.document_notes(spark, d).select("key", checked.alias("c")).select("key", "c.verdict", "c.percent", "c.first", "c.last", F.array_join("c.missing_numbers", " ").alias("numbers"), F.array_join("c.missing_words", " ").alias("missing"))


@query(r"""WITH RECURSIVE notes AS (SELECT 'customers/' || c_custkey || '.md' AS path, c_mktsegment = 'BUILDING' AS old FROM customer UNION ALL SELECT 'parts/' || p_name || ' ' || p_partkey || '.md', false FROM part),
    names AS (SELECT path, old, lower(regexp_extract(path, '([^/]*?)(\.[^./]*)?$', 1)) AS s, 10 AS more FROM notes UNION ALL SELECT path, old, lower(path), 0 FROM notes),
    w AS (SELECT path, old, s, more, 0 AS i, 0 AS got, CAST(0 AS DOUBLE) AS score, 0 AS run FROM names UNION ALL
        SELECT path, old, s, more, i + 1, CASE WHEN hit THEN got + 1 ELSE got END, score + CASE WHEN hit THEN (run + 1) * 2 + CASE WHEN i = 0 OR regexp_matches(substr(s, i, 1), '[\s/_-]') THEN 5 ELSE 0 END ELSE 0 END,
            CASE WHEN hit THEN run + 1 WHEN got < 4 THEN 0 ELSE run END FROM (SELECT *, got < 4 AND substr(s, i + 1, 1) = substr('st12', got + 1, 1) AS hit FROM w WHERE i < length(s)))
    SELECT path, round(score, 6) AS score FROM (SELECT path, old, max_by(score - CAST(0.05 AS DOUBLE) * length(s) + more, more) AS score FROM w WHERE i = length(s) AND got = 4 GROUP BY 1, 2) ORDER BY old, 2 DESC, path LIMIT 60""")
def fuzzy_switcher(spark, d):
    notes = P.customer_notes(spark, d).select("path", "segment").unionByName(P.read(spark, d, "part").select(F.concat(F.lit("parts/"), F.col("p_name"), F.lit(" "), F.col("p_partkey"), F.lit(".md")).alias("path"), F.lit("").alias("segment")))
    return S.fuzzy_open(notes, "st12", F.col("segment") == "BUILDING").select("path", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS key FROM part WHERE contains(lower(p_name), 'e') AND contains(lower(p_name), 'a')")
def tool_find_notes(spark, d):
    return tools.find_notes(P.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("stem")), "E á").select("key")


@query("""SELECT o_orderkey AS key, state, overdue, state + CASE WHEN overdue THEN 4 ELSE 0 END AS byte FROM (SELECT o_orderkey, state, o_orderstatus <> 'F' AND state <> 2 AND o_orderdate < TIMESTAMP '1998-05-20' AS overdue
    FROM (SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN 2 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderstatus = 'O' THEN 1 ELSE 3 END AS state FROM orders))""")
def status_rules(spark, d):
    """Finished orders are obsolete, open ones approved, others wait for review; those of low priority were replaced."""
    low = F.when(F.col("priority") == "5-LOW", "[[Other]]").otherwise(" ")
    word = F.when(F.col("status") == "F", "Obsolete").when(F.col("status") == "O", "Approved").otherwise("for review")
    fields = F.create_map(F.lit("State"), F.array(word), F.lit("Review_due"), F.array(F.when(F.col("status") != "F", F.date_format("date", "yyyy-MM-dd")).otherwise("soon")), F.lit("replaced_by"), F.array(low))
    found = P.order_notes(spark, d).select("key", status_of(fields, F.lit("1998-05-20").cast("date")).alias("s"))
    return found.select("key", "s.state", F.col("s.due").alias("overdue"), status_byte(F.col("s")).alias("byte"))


@query(forms("(SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' neuwort-Ä1' WHEN lang = 'fr' THEN 'kurz' ELSE text END AS text FROM documents WHERE lang <> 'es')"))
def search_refreshed_index(spark, d):
    """An index after three generations of edits, as if built anew: Spanish documents go, German ones are edited twice, French ones come again as another text."""
    notes, index = indexed(spark, d)
    own = index.fork(f"{shared_folder(spark)}/search-fork-{uuid.uuid4().hex}")
    new = lambda lang, text: notes.where(F.col("lang") == lang).select("key", text.alias("text"))
    own.update(notes.where("lang in ('es', 'fr')"), new("de", F.lit("first edit")), merge=False)
    own.update(notes.where("lang = 'none'"), new("de", F.concat("text", F.lit(" neuwort-Ä1"))), merge=False)
    own.update(notes.where("lang = 'es'"), new("fr", F.lit("kurz")), merge=False)
    return own.postings().where(F.col("word") != S.LONG_MARK).groupBy("word").agg(F.count("*").alias("notes"))


@query(forms("(SELECT doc_id, CASE WHEN lang = 'de' THEN 'merged' ELSE text END AS text FROM documents)"))
def search_merged_index(spark, d):
    """The dictionary of an index whose segments were merged after an edit."""
    notes, index = indexed(spark, d)
    own = index.fork(f"{shared_folder(spark)}/search-fork-{uuid.uuid4().hex}")
    own.update(notes.where("lang = 'none'"), notes.where("lang = 'de'").select("key", F.lit("merged").alias("text")), merge=False).merge()
    (one,) = own.segments()
    return spark.read.parquet(f"{one.path}/words").where(F.col("word") != S.LONG_MARK).select("word", "notes")


#: A line that many documents share.
QUOTE = "Erreth was ofretihaou the that edouhe"


@query()
def quote_find(spark, d):
    """Where a quotation is supported, by the index; the same notes as by reading all of them."""
    notes, index = indexed(spark, d)
    return find_quote(notes, index, QUOTE).select("key", "check.verdict", "check.percent", "check.first", "check.last")


@query()
def quote_elsewhere(spark, d):
    """What isn't near the second line but elsewhere."""
    notes, index = indexed(spark, d)
    found = find_quote(notes, index, QUOTE, near=2)
    return found.select("key", "check.verdict", F.col("found_elsewhere.verdict").alias("elsewhere"), F.col("found_elsewhere.first").alias("first"), F.col("found_elsewhere.last").alias("last"))
