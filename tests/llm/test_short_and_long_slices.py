"""Slices of every size: very short texts, texts cut into many slices, and hits merged over blocks."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_documents import lower, plain_dedup, same

import corpus_pipeline
from quillstone.llm import decontaminate, quality_rules, suffix_dedup
from quillstone.llm.common import Scratch, utf8_buffer

SHORT = ["", "a", "ab", "a b", "abcd", "abcde", "é", "字", "😀", "字字", "a字", "😀字a"]


def plain_grams(texts):
    out = []
    for t in texts:
        data = bytes(quality_rules.ORDER - 1) + t.encode()
        out += [int.from_bytes(data[i : i + quality_rules.ORDER], "big") for i in range(len(t.encode()))]
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 4, 5, 7, 100])
def test_grams_of_batches_of_few_bytes(step):
    for texts in [[t] for t in SHORT] + [[a, b] for a in SHORT for b in SHORT] + [SHORT]:
        data, offsets = utf8_buffer(pa.array(texts))
        got = [quality_rules.grams(data, offsets, i, min(i + step, len(data))).tolist() for i in range(0, len(data), step)]
        assert sum(got, []) == plain_grams(texts)


@pytest.mark.parametrize("texts", [["a b"], ["字"], ["😀"], ["a"], [""], [None], ["long words here " * 3000, "a b"]])
def test_the_rules_and_the_pipeline_on_short_texts(spark, sf, tmp_path, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], schema).coalesce(1)
    done = {r.doc_id: r for r in quality_rules.quality_rules(docs, ["doc_id"]).collect()}
    assert len(done) == len(texts) and all(r.base_failed and not r.kept for r in done.values())
    if texts[0] == "a b":
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_judged(rows, items):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for d, t in rows:
        w = word.findall(lower(t or ""))
        hit, ids = set(), set()
        for item, text in items:
            own = word.findall(lower(text or ""))
            size = min(13, len(own))
            grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own and item else set()
            at = [i for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in grams]
            hit |= {j for i in at for j in range(i, i + size)}
            ids |= {item} if at else set()
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return Counter(out)


@pytest.mark.parametrize(("block", "several"), [(1024, 20_000), (32, 3)])
def test_hits_of_common_terms_by_blocks(spark, monkeypatch, block, several):
    monkeypatch.setattr(decontaminate, "HIT_BLOCK", block)
    monkeypatch.setattr(decontaminate, "POSTINGS", several)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 12, 13, 14, 200, 1500)] + ["w1 " * 300, "w1 w2 " * 100]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (99, None)]
    items = [(w, w) for w in words[:5]] + [("same", "w1"), ("pair", "w2 w3"), ("long", texts[5]), ("cut", " ".join(texts[6].split()[40:70])), ("ones", "w1 " * 20), ("none", ""), (None, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = decontaminate.judged(docs, spark.createDataFrame(items, "item_id string, text string"), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in done) == plain_judged(rows, items)


def test_places_are_distinct(spark):
    items = spark.createDataFrame([(f"i{k}", "the same thirteen words are here in every one of the items of it") for k in range(50)], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x the same thirteen words are here in every one of the items of it y")], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    done = decontaminate.judged(docs, items, scratch).collect()
    assert [len(r.item_ids) for r in done] == [50]
    places, met = (spark.read.parquet(f"{scratch.base}/{n}") for n in ("places0", "matches0"))
    assert places.count() == 50 * met.where("low is not null").count()
    same([(r.n_hit,) for r in done], [(14,)])


def shared_lines(n, width=199):
    """Texts that share a line, or the beginning of one, between parts of their own; some shared in pairs."""
    rng = np.random.default_rng(5)
    own = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), k))
    line = own(width)
    texts = [own(60) + line + own(60) for _ in range(n)]
    texts += [texts[0][:200] + own(50), own(30) + texts[1][40:], own(20) + line + "Z", own(10) + line + "Z" + own(5)]
    return texts


@pytest.mark.parametrize("width", [199, 230])
def test_a_line_of_very_many_texts_is_split_until_its_strings_part(spark, monkeypatch, width):
    monkeypatch.setattr(suffix_dedup, "HOT", 25)
    texts = shared_lines(60, width)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    found = {bytes(r.text_hash): (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, scratch).collect()}
    want = plain_dedup(texts)
    got = [(len(t), *found.get(hashlib.sha256(t.encode()).digest()[:16], (0, 0, hashlib.sha256(t.encode()).hexdigest()))) for t in texts]
    assert got == [tuple(w) for w in want]
    assert {"parts81", "parts41"} <= set(scratch.names)


def test_near_copies_are_split_only_where_they_differ(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 25)
    rng = np.random.default_rng(6)
    own = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), k))
    before, after = own(300), own(300)
    texts = [f"{before}{own(9)}{after}" for _ in range(60)] + [before + own(30), own(30) + after[20:]]
    scratch = Scratch(spark, "t")
    found = {bytes(r.text_hash): (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch).collect()}
    want = plain_dedup(texts)
    got = [(len(t), *found.get(hashlib.sha256(t.encode()).digest()[:16], (0, 0, hashlib.sha256(t.encode()).hexdigest()))) for t in texts]
    assert got == [tuple(w) for w in want]
    made = sum(spark.read.parquet(f"{scratch.base}/{n}").count() for n in scratch.names if n.startswith("parts"))
    # Two halves of a context a level; each string by itself would be 161.
    assert 0 < made <= 2 * 8 * spark.read.parquet(f"{scratch.base}/level").count()
