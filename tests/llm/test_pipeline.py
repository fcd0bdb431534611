"""The pipeline's stages, each against a plain version on its own input: base rules, fingerprints, contamination, pseudonyms, pieces."""

from collections import Counter

from pyspark.sql import functions as F
from test_documents import KEY, plain_base, plain_fingerprint
from test_plain_versions import PLAIN
from test_short_and_long_slices import plain_judged

import __spark_entry__
import corpus_pipeline
from quillstone.llm import decontaminate, pieces, pseudonyms


def test_stages(spark, sf, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pseudonyms", "pieces"]
    frames = [docs]
    for _, f in corpus_pipeline.STAGES:
        frames.append(f(spark, frames[-1], sf).cache())
    for a in frames[1:-1]:
        assert a.columns == docs.columns
    ids = [{r.doc_id for r in f.collect()} for f in frames]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 0
    kept = frames[2].collect()
    assert len(kept) == len({r.doc_id for r in kept}) == len({plain_fingerprint(r.text) for r in kept})
    assert {plain_fingerprint(r.text) for r in kept} <= {plain_fingerprint(r.text) for r in frames[1].collect()}
    done = __spark_entry__.queries()["pipeline"](spark, sf).collect()
    assert {(r.doc_id, tuple(r.ids)) for r in done} == {(r.doc_id, tuple(r.ids)) for r in frames[-1].collect()}


def test_empty(spark, empty_sf):
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


def test_the_first_stage_keeps_nothing_that_fails_the_base_rule(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    base = {r.doc_id: plain_base(r.text) for r in docs.collect()}
    assert not any(base[r.doc_id][0] < 50 or 100 * base[r.doc_id][4] > 50 * base[r.doc_id][0] for r in stages["quality_rules"](spark, docs, sf).collect())


def test_decontamination_matches_a_plain_version(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for d, t in rows:
        ((_, n_words, n_hit, _),) = plain_judged([(d, t)], items)
        want[d, t] += not (n_hit and 20 * n_hit >= n_words)
    assert Counter((r.doc_id, r.text) for r in decontaminate.stage(spark, docs, sf).collect()) == +want


def test_pseudonyms_and_pieces_match_plain_versions(spark, sf, docs):
    import public_tokenizers
    import sentencepiece

    planted = spark.createDataFrame([(k, f"see {s} there", "en", "s", 1) for k, (s, _) in enumerate(PLAIN)], docs.schema)
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    try:
        done = pseudonyms.stage(spark, planted.unionByName(docs.where("doc_id >= 6").withColumn("doc_id", docs.doc_id + 1000)), sf).cache()
        got = {r.doc_id: r.text for r in done.collect()}
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
    assert got == {k: f"see {w} there" for k, (_, w) in enumerate(PLAIN)} | {r.doc_id + 1000: r.text for r in docs.where("doc_id >= 6").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [r for r in pieces.stage(spark, done, sf).collect()]
    for r in rows:
        ids = sp.encode(got[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, sp.decode(ids), len(ids))
    assert len(rows) == done.count()


def test_off_a_local_master_a_session_without_a_key_gets_its_own(spark, sf, docs, monkeypatch):
    planted = spark.createDataFrame([(1, "see 2020-02-29 and 4111 1111 1111 1111 there", "en", "s", 1)], docs.schema)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    try:
        text = dict(corpus_pipeline.STAGES)["pseudonyms"](spark, planted, sf).first().text
        key = spark.conf.get(pseudonyms.KEY_SETTING)
        assert len(key) == 64 and key != pseudonyms.DEMO_KEY
        assert text == pseudonyms.pseudonymise(planted, key).first().text != pseudonyms.pseudonymise(planted, pseudonyms.DEMO_KEY).first().text
        assert pseudonyms.pseudonymise(planted.withColumn("text", F.lit(text)), key, restore=True).first().text == planted.first().text
        assert __spark_entry__.queries()["op6_pseudonyms"](spark, sf).count() == docs.count() and spark.conf.get(pseudonyms.KEY_SETTING) == key
        spark.conf.set(pseudonyms.KEY_SETTING, KEY)
        assert pseudonyms.session_key(spark) == KEY
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)
