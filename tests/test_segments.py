"""The stored index: parts, segments, merges, freshness, and quotations through it."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.operators import segments
from quillstone.operators.search import Term
from quillstone.operators.segments import SearchIndex
from quillstone.plans import search_queries

NOTES = [(i, f"pump word{i % 37:02} PW11{i % 5}-JM valvé {'brake' if i % 9 == 0 else 'line'}") for i in range(120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, text string")


def content(df):
    return Counter((r.word, r.key, r.exact) for r in df.collect())


def anew(spark, rows):
    return content(S.settled(S.postings(frame(spark, rows))))


def test_terms_by_dictionary_and_trigrams(spark, tmp_path):
    notes = frame(spark, NOTES)
    index = SearchIndex(spark, f"{tmp_path}/i").build(notes)
    assert content(index.postings()) == anew(spark, NOTES)
    keys = lambda *clauses, no=(): sorted(r.key for r in S.search(notes, index, list(clauses), list(no)).collect())
    assert keys([Term("word01")]) == [i for i, t in NOTES if "word01" in t]
    assert keys([Term("ord0", "fragment")]) == [i for i, t in NOTES if "ord0" in t]
    assert keys([Term("11", "fragment")]) == [i for i, _ in NOTES]
    assert keys([Term("w113", "fragment")], [Term("brake")], no=[Term("word2")]) == [i for i, t in NOTES if "W113" in t and "brake" in t and "word2" not in t]
    assert keys([Term("valve")]) == [i for i, _ in NOTES] and keys([Term("zzz")]) == []
    assert keys([Term("nothing"), Term("brake line", "phrase")]) == []
    # A phrase without accents meets one with accents, not the other way round.
    assert keys([Term("jm  valve", "phrase")]) == [i for i, _ in NOTES] and keys([Term("pümp word", "phrase")]) == []


def test_a_fragment_reads_the_dictionary_and_the_parts_of_its_words(spark, tmp_path, monkeypatch):
    rows = [(i, f"a{i:04} b{i:04} c{i:04}") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = SearchIndex(spark, f"{tmp_path}/i").build(frame(spark, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (one,) = index.segments()
    parts = [p.name for p in __import__("pathlib").Path(f"{tmp_path}/i").glob("segment-*/postings/part=*")]
    assert len(parts) > 1
    hits = index.hits([Term("b0012", "fragment")])
    assert [r.key for r in hits.collect()] == [12]
    plan = hits._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "regexp_extract_all" not in plan
    words = index.words_of([Term("b0012", "fragment")])
    plan = words._jdf.queryExecution().toString()
    assert "EqualTo(gram,b00)" in plan and all("/grams/" in f for f in words.inputFiles())
    assert [(r.word, r.terms) for r in words.collect()] == [("b0012", [0])]


def test_a_word_of_all_notes_spans_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = SearchIndex(spark, f"{tmp_path}/i").build(frame(spark, [(i, "the") for i in range(5000)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (one,) = index.segments()
    word = spark.read.parquet(f"{one.path}/words").first()
    assert word.notes == 5000 and word.last > word.first
    assert index.flags([Term("the")]).count() == 5000


def test_updates_write_their_own_segment_and_merge_when_due(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 20)
    index = SearchIndex(spark, f"{tmp_path}/i").build(frame(spark, NOTES))
    first = index.segments()[0].path
    state = dict(NOTES)
    for gone, new in [([3, 4], [(5, "edited once"), (500, "new pump")]), ([500], [(5, "edited twice"), (3, "back again")]), ([], [(7, "")])]:
        index.update(frame(spark, [(k, "") for k in gone]), frame(spark, new), merge=False)
        state = {k: t for k, t in state.items() if k not in gone} | dict(new)
        assert content(index.postings()) == anew(spark, list(state.items()))
    assert len(index.segments()) == 4 and index.segments()[0].path == first
    found = lambda t: sorted(r.key for r in index.hits([t]).collect())
    assert found(Term("edited")) == [5] and found(Term("dite", "fragment")) == [5] and found(Term("again")) == [3] and found(Term("new")) == []
    assert not index.merge_due()
    other = index.fork(f"{tmp_path}/fork")
    index.update(frame(spark, [(k, "") for k in range(60, 90)]), frame(spark, [(900, "late")]))
    state = {k: t for k, t in state.items() if not 60 <= k < 90} | {900: "late"}
    assert len(index.segments()) == 1 and content(index.postings()) == anew(spark, list(state.items()))
    assert content(other.postings()) == anew(spark, [(k, t) for k, t in (dict(NOTES) | {5: "edited twice", 3: "back again", 7: ""}).items() if k != 4])


def test_an_unfinished_manifest_does_not_count(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i").build(frame(spark, NOTES[:5]))
    (tmp_path / "i" / "manifest" / "000009").mkdir()
    assert index.generation() == 0 and len(index.segments()) == 1
    assert SearchIndex(spark, f"{tmp_path}/none").segments() == []


def test_an_index_of_files_that_changed_is_built_anew(spark, tmp_path):
    def put(text, mode="overwrite"):
        spark.createDataFrame([(i, text, "en", "s", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode(mode).parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")

    put("first pump")
    notes, index = search_queries.indexed(spark, str(tmp_path))
    assert S.search(notes, index, [[Term("first")]]).count() == 4
    assert search_queries.indexed(spark, str(tmp_path))[1].base == index.base
    put("other pump")
    notes, new = search_queries.indexed(spark, str(tmp_path))
    assert new.base != index.base and S.search(notes, new, [[Term("first")]]).count() == 0 and S.search(notes, new, [[Term("other")]]).count() == 4
    assert index.generation() == -1


def test_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i").build(frame(spark, []))
    notes = frame(spark, NOTES[:3])
    assert S.search(notes, index, [[Term("pump")]]).count() == 0 and index.postings().count() == 0
    index.update(frame(spark, [(1, "")]), notes)
    assert S.search(notes, index, [[Term("pump")]]).count() == 3


LONG = "x" * 30 + "-" + "granted" + "-" + "y" * 30


@pytest.mark.parametrize(("quote", "near"), [("Permission is hereby granted, free of 12 charge", None), ("Permission is hereby granted, free of 12 charge", 30), ("of the", 1), ("...", None)])
def test_quotations_by_the_index_are_those_of_all_notes(spark, tmp_path, quote, near):
    base = "Permission is hereby granted, free of 12 charge to any person"
    words = base.split()
    texts = ["a\n" * 40 + base, base, "Permission hereby granted free of 12", " ".join(words[:4]), " ".join(reversed(words)), "**Permission** is [[x|hereby]] granted_free of 12 charge", LONG, f"permission is hereby {LONG} free of 12 charge", "", "of the", "of\nthe"]
    notes = frame(spark, list(enumerate(texts))).withColumn("extra", F.lit(1))
    index = SearchIndex(spark, f"{tmp_path}/i").build(notes)
    asked = [w for line in quote.splitlines() for w in re.findall(r"[^\W_]+", S.plain_line(line))]
    key = lambda r: (r.key, r.check, r.found_elsewhere)
    got = sorted(map(key, segments.find_quote(notes, index, quote, near).collect()))
    full = []
    if asked:
        for r in notes.select("key", S.quote_check(F.col("text"), quote, near).alias("check"), S.quote_check(F.col("text"), quote).alias("all")).collect():
            other = (r.all.verdict, r.all.first, r.all.last) if near and r.check.verdict == "not_supported" and r.all.verdict != "not_supported" else None
            if r.check.verdict != "not_supported" or other:
                full.append((r.key, r.check, other))
    assert got == sorted(full)
    if asked:
        kept = {r.key for r in segments.quote_candidates(index, quote).collect()}
        assert {k for k, *_ in full} <= kept and (len(kept) < len(texts) or quote == "of the")
