"""Ranked search, source mixes and vector codes, against brute force and plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_documents import lower, same

from quillstone.llm import ranked_search, source_mix, vector_codes
from quillstone.llm.common import Scratch

# 11

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, k):
    tallies = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs if t is not None]
    tallies = [(d, c) for d, c in tallies if c]
    n_docs, n_terms = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        scores = []
        for d, c in tallies:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            scores += [(-s, d is None, d)] if s else []
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize(("postings", "pilot", "block"), [(2_000_000, 16, 5_000_000), (40, 2, 200), (1, 1, 30)])
def test_ranks_match_brute_force_by_shards_and_blocks(spark, rows, docs, sf, monkeypatch, postings, pilot, block):
    monkeypatch.setattr(ranked_search, "POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "PILOT", pilot)
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", block)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [("b1", "another text the"), ("b1", "another text the")]
    done = ranked_search.ranked(docs, spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1)), 5)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in done.collect()) == plain_ranks([(r[0], r[1]) for r in rows], items, 5)


def test_a_shard_stops_early_with_the_same_documents():
    rng = np.random.default_rng(4)
    texts = [rng.choice(400, rng.integers(5, 80), p=np.arange(400, 0, -1) / 80200) for _ in range(3000)]
    lists = [np.unique(t, return_counts=True) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in lists])])
    df = np.bincount(np.concatenate([t for t, _ in lists]), minlength=400)
    weights = np.floor(1000 * np.log(6002 / (2 * df + 1))).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    shard = ranked_search.Shard(lengths, ends, *(np.concatenate([x[i] for x in lists]).astype(np.int64) for i in (0, 1)), np.arange(3000), weights, 3000, int(lengths.sum()))
    stopped = 0
    for _ in range(40):
        item = np.unique(np.append(rng.integers(0, 40, 2), rng.integers(100, 300, 3)))
        whole = np.array([shard.impacts[a:b][np.isin(shard.terms[a:b], item)].sum() for a, b in zip(ends, ends[1:], strict=False)])
        want = np.lexsort((np.arange(3000), -whole))[:10]
        docs, scores, met = shard.best(item, 0, 10)
        assert sorted(docs) == sorted(want) and (scores == whole[docs]).all()
        stopped += met < df[item].sum()
        docs, scores, met = shard.best(item, int(whole[want[4]]), 10)
        assert set(want[:5]) <= set(docs) and (scores == whole[docs]).all() and (scores >= whole[want[4]]).all()
        assert shard.best(item, int(whole.max()) * 10, 10)[2] == 0
    assert stopped > 5


def test_ties_of_many_copies_leave_a_shard_ten_at_most(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300, 0, -1)] + [(None, "same words here"), (500, "other")], "doc_id long, text string").coalesce(1)
    done = ranked_search.ranked(docs, spark.createDataFrame([(1, "words")], "item_id long, text string"), 10).collect()
    assert sorted((r["rank"], r.doc_id) for r in done) == [(i, i) for i in range(1, 11)] or not done
    lists = ranked_search.term_lists(docs, ranked_search.vocabulary_of(docs.where("doc_id = 1")))
    known = (pa.array([1]), pa.array([2]), pa.array([[0]], pa.list_(pa.int32())))
    found = ranked_search.ranked_in_shards(lists, known, np.full(3, 1000), np.zeros(1, np.int64), 302, 904, 10, "item_id long, text_hash long, doc_id long, score long").collect()
    assert sorted(r.doc_id for r in found) == list(range(1, 11))


def test_ranks_of_empty_tables(spark, sf, empty, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    assert ranked_search.ranked(empty, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert ranked_search.ranked(docs, none).count() == 0
    assert ranked_search.ranked(docs, spark.createDataFrame([("a", " .,"), ("b", None)], none.schema)).count() == 0


# 12


def plain_targets(sizes, weights, share, repeats):
    wanted, over = sum(sizes) * share / 100, set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in over]
        level = (wanted - sum(repeats * sizes[i] for i in over)) / sum(weights[i] for i in rest) if rest else 0
        more = {i for i in rest if repeats * sizes[i] <= level * weights[i]}
        if not more:
            return [repeats * s if i in over else level * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over |= more


def plain_mix(rows):
    """(doc_id, size, source_size, target, taken, positions), documents of equal digests in the order given."""
    name = lambda s: (s is None, s or "")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    names = sorted({name(r[3]) for r in rows})
    docs = {n: sorted((md5(f"{'' if r[0] is None else r[0]} {md5(r[1] or '')}"), size(r[1]), r[0]) for r in rows if name(r[3]) == n) for n in names}
    kinds = [source_mix.KINDS[i % 3] for i in range(len(names))]
    sizes = [sum(s for _, s, _ in docs[n]) for n in names]
    out = []
    for n, kind, whole, target in zip(names, kinds, sizes, plain_targets(sizes, [k.weight for k in kinds], 150, 2), strict=True):
        demand, at = math.floor(target + 0.5), 0
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, *zip(*kind.knots, strict=True))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        for _, s, d in docs[n]:
            takes = [max(0, min(s, demand - at - e * whole)) for e in (0, 1)]
            times = [float(np.interp((at + e * whole) / demand, area / area[-1], grid)) for e in (0, 1) if takes[e]]
            out.append((d, s, whole, target, sum(takes), times))
            at += s
    return out


def test_a_mix_matches_a_plain_one(spark, rows, docs):
    done = source_mix.mixed(docs, ["doc_id"]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    want = sorted(plain_mix(rows), key=key)
    for a, b in zip(sorted([tuple(r[:5]) + (r.positions,) for r in done], key=key), want, strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == b[4] and a[4] <= 2 * a[1]
        assert a[5] == pytest.approx(b[5], abs=1e-3)
    taken = [r.position for r in done if r.position is not None]
    assert taken == sorted(taken) and [r.position for r in done[: len(taken)]] == taken
    assert len(done) == len(rows)


def test_training_rows_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, "one two three", "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    done = source_mix.mixed(docs, ["doc_id", "source"]).cache()
    times = [r.time for r in source_mix.training_rows(done).collect()]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    by = {r.source: r for r in source_mix.training_rows(done).groupBy("source").agg(F.expr("count_if(time < 0.5)").alias("early"), F.count("*").alias("n"), F.max("target").alias("target")).collect()}
    for source, early in (("a", 1.25 / 2), ("b", 1 / 2), ("c", 0.25)):
        assert by[source].early / by[source].n == pytest.approx(early, abs=0.01)
        assert 3 * by[source].n == pytest.approx(by[source].target, abs=3)


def test_a_hot_source_goes_by_slices(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "SLICES", 7)
    rows = [(i, "w " * (i % 9), None if i % 5 == 0 else "hot" if i % 5 < 4 else f"s{i % 7}") for i in range(700)]
    done = source_mix.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect()
    want = {r[0]: r[4] for r in plain_mix([(i, t, None, s) for i, t, s in rows])}
    assert {r.doc_id: r.taken for r in done} == want


@pytest.mark.parametrize(("sizes", "weights"), [([5, 5, 5], [3, 1, 2]), ([1, 100, 100], [3, 1, 2]), ([0, 0], [3, 1]), ([0, 7], [3, 1]), ([1, 1000, 1, 3], [3, 1, 2, 3])])
def test_targets(spark, sizes, weights):
    sources = spark.createDataFrame([(f"n{i}", s) for i, s in enumerate(sizes)], "name string, source_size long")
    done = source_mix.targets(sources, source_mix.KINDS, 150, 2, Scratch(spark, "t")).orderBy("name").collect()
    assert [r.target for r in done] == pytest.approx(plain_targets(sizes, weights, 150, 2))


def test_mix_of_odd_tables(spark, docs, empty):
    assert source_mix.mixed(empty, ["doc_id"]).count() == 0
    clash = docs.withColumns({"size": F.lit("own"), "taken": F.lit(1), "name": F.lit("n"), "place": F.lit(2)})
    done = source_mix.mixed(clash, clash.columns)
    assert done.columns == [*clash.columns, "_size", "source_size", "target", "_taken", "position", "positions"]
    same(done.select("doc_id", F.col("_size").alias("size"), F.col("_taken").alias("taken")).collect(), [tuple(r) for r in source_mix.mixed(docs, ["doc_id"]).select("doc_id", "size", "taken").collect()])
    assert {r.size for r in done.collect()} == {"own"}


# 13


def test_nearest_entries_match_brute_force():
    rng = np.random.default_rng(2)
    for width, entries, spread in ((4, 64, 60), (4, 64, 3), (1, 5, 2), (4, 1, 9), (0, 3, 1)):
        book, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-spread, spread + 1, (9000, width))
        far = ((x[:, None] - book) ** 2).sum(-1)
        index, best = vector_codes.Annuli(book).nearest(x)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def test_the_annulus_leaves_most_entries_out():
    rng = np.random.default_rng(3)
    book = rng.integers(-100, 100, (64, 4)) * np.linspace(0.1, 20, 64)[:, None].astype(np.int64)
    annuli = vector_codes.Annuli(book)
    x = book[rng.integers(0, 64, 500)] + rng.integers(-3, 4, (500, 4))
    norms = np.sqrt((x**2).sum(1))
    low, high = annuli.allowed(norms, annuli.nearest(x)[1])
    assert (high - low).mean() < 20 and (high > low).all()


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.array(e, np.float64)).astype(np.int64), lab) for i, e, lab in vectors if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1].tolist()))[:entries]
    kept = [r for r in kept if len(r[1]) == len(first[0][1])]
    cut = lambda v: np.pad(v, (0, -len(v) % parts)).reshape(parts, -1)
    x = np.array([cut(v) for _, v, _ in kept])
    books = np.array([cut(v) for _, v, _ in first]).transpose(1, 0, 2)
    for n in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        index = far.argmin(-1)
        if n < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[index[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own) if len(own) else books[p, e]
    return [(i, "".join(f"{c:02x}" for c in code), int(f.min(-1).sum()), lab) for (i, _, lab), code, f in zip(kept, index, far, strict=True)], books


@pytest.mark.parametrize("dims", [32, 20, 3])
def test_codes_match_a_plain_version(spark, tmp_path, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(3, rows[3][1], 1), (None, rows[4][1], 2), (7, None, 1), (8, [None] * dims, 1), (9, [float("nan")] + [0.0] * (dims - 1), 1), (10, [float("inf")] * dims, None), (900, [1.0], 1), (901, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("own"))
    df.repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    done = vector_codes.op13_vector_codes(spark, str(tmp_path)).collect()
    want, books = plain_codes(rows)
    totals = Counter()
    for _, _, e, lab in want:
        totals[lab] += e
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in done) == Counter((i, c, e, totals[lab]) for i, c, e, lab in want)
    assert {r.codebooks_sha256 for r in done} == {hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()}


def test_codes_of_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    for n, rows in enumerate(([], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(None, [1.0, 2.0], 1)], [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert vector_codes.op13_vector_codes(spark, f"{tmp_path}/{n}").count() == (0, 0, 2, 0, 2)[n]
