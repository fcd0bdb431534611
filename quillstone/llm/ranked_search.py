"""Ranked lexical search, score at a time over impact-ordered postings.

The items are a stated query set: blocks of about BLOCK_CHARS of their text are taken one after the other, and what the
driver and all tasks hold of a block is its distinct terms and each item's list of them.

* Term lists. Texts are read once: a row for each document with its length and its tallies of the items' terms. Document
  frequencies, N and L are aggregates of that table.
* Shards. Tasks turn term lists into shards of about POSTINGS postings, each grouped by term and exact impact, the
  greatest impacts first. An item's groups are taken by descending impact over all its terms, and each adds its impact to
  its documents. What a document may still gain is at most the sum of each term's next impact: once these bounds prove that
  the k best are among a few candidates (CANDIDATES for each wanted one), the candidates' scores are completed from the
  term lists and the k best taken. Only then does a shard stop before its last posting.
* Thresholds. One document in PILOT is ranked first; an item's k-th score there is a score that its k best must reach, so
  the other shards need not look for less. The best of all shards are ranked by item.

Defined results: null texts and texts without terms are no documents of N and are never found; every row is a document,
so repeated rows are ranked beside each other; equal scores go by ascending doc_id, null doc_ids last; null item_ids are
left out, equal (item_id, text) rows are one item, other texts of an item_id items of their own; items without terms, and
empty tables, give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, read, release
from quillstone.llm.decontaminate import BATCH_BYTES, numbered, vocabulary_of, words
from quillstone.llm.token_counts import batches

#: Documents for an item.
K = 10
#: Characters of items in a block.
BLOCK_CHARS = 5_000_000
#: A shard stops when so many documents for each wanted one can still be among the best; the scores of these are completed.
CANDIDATES = 8
#: Postings of a shard, and one document in so many that thresholds come from.
POSTINGS, PILOT = 2_000_000, 16


def term_lists(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n, terms array<int>, tallies array<int> of docs(doc_id, text): rows with a term of any kind."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value)
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                hashes, ends = words(part)
                lengths = np.diff(ends)
                terms = numbered(hashes, shared.value)
                here = np.flatnonzero(terms >= 0)
                keys, tallies = np.unique((np.searchsorted(ends, here, "right") - 1) * size + terms[here], return_counts=True)
                cuts = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * size).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (keys % max(size, 1), tallies)]
                found = pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(lengths.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tallies"])
                yield found.filter(pa.array(lengths > 0))
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tallies array<int>")


def item_terms(items: DataFrame, vocabulary: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """item_id, text_hash and the distinct terms of each of items(item_id, text_hash, text) that has some."""
    shared = items.sparkSession.sparkContext.broadcast(vocabulary)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tables:
            for at, part in batches(b.column("text"), BATCH_BYTES):
                hashes, ends = words(part)
                own = [np.unique(numbered(hashes[i:j], shared.value)).astype(np.int32) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(part)) for c in ("item_id", "text_hash")), pa.array(own, pa.list_(pa.int32()))], ["item_id", "text_hash", "terms"])

    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, text_hash long, terms array<int>"
    found = items.mapInArrow(run, schema).where(F.size("terms") > 0).toArrow().combine_chunks()
    return tuple(pa.concat_arrays(found.column(c).chunks) if found.num_rows else pa.array([], found.schema.field(c).type) for c in found.column_names)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Shard:
    """Impact-ordered postings of some documents."""

    def __init__(self, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tallies: np.ndarray, by_id: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """Of documents by number: their lengths, where their terms end, the terms and tallies; and the documents in the order of their ids."""
        shares = 10 + (90 * lengths * n_docs) // n_terms
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), np.diff(ends))
        self.ends, self.terms = ends, terms
        self.id_rank = np.empty(len(by_id), np.int64)
        self.id_rank[by_id] = np.arange(len(by_id))
        self.impacts = weights[terms] * ((1_000_000_000 * tallies) // (1000 * tallies + 8 * shares[doc]))
        order = np.lexsort((-self.impacts, terms))
        self.docs, by_term, by_impact = doc[order], terms[order], self.impacts[order]
        edge = np.ones(len(order), bool)
        edge[1:] = (by_term[1:] != by_term[:-1]) | (by_impact[1:] != by_impact[:-1])
        self.starts = np.flatnonzero(edge)
        self.sizes = np.diff(np.append(self.starts, len(order)))
        self.group_terms, self.group_impacts = by_term[self.starts], by_impact[self.starts]
        # What the next group of the same term has.
        self.next = np.append(self.group_impacts[1:], 0)
        self.next[np.append(self.group_terms[1:] != self.group_terms[:-1], True) if len(self.starts) else []] = 0

    def best(self, item: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents of the k best that have a score, and at least that one, their scores, and how many postings were met."""
        low, high = np.searchsorted(self.group_terms, item), np.searchsorted(self.group_terms, item, "right")
        groups = spread(low, high - low)
        groups = groups[np.argsort(-self.group_impacts[groups], kind="stable")]
        impacts, sizes = self.group_impacts[groups], self.sizes[groups]
        rest = self.group_impacts[low[high > low]].sum() + np.concatenate([[0], np.cumsum(self.next[groups] - impacts)])
        met = np.concatenate([[0], np.cumsum(sizes)])
        scores = np.zeros(len(self.ends) - 1, np.int64)
        step, at = len(scores) // 8 + 1, 0
        while True:
            # Documents that have nothing yet are out only if some have more than could come to these.
            if at == len(groups) or rest[at] <= max(scores.max(), least) or len(scores) <= CANDIDATES * k:
                kth = np.partition(scores, -k)[-k] if len(scores) > k else 0
                reach = np.flatnonzero(scores + rest[at] >= max(kth, least, 1))
                if len(reach) <= CANDIDATES * k or at == len(groups):
                    whole = self.complete(reach, item) if at < len(groups) else scores[reach]
                    order = np.lexsort((self.id_rank[reach], -whole))[:k]
                    order = order[whole[order] >= max(least, 1)]
                    return reach[order], whole[order], int(met[at])
            to = min(max(at + 1, int(np.searchsorted(met, met[at] + step))), len(groups))
            places = spread(self.starts[groups[at:to]], sizes[at:to])
            np.add.at(scores, self.docs[places], np.repeat(impacts[at:to], sizes[at:to]))
            at = to

    def complete(self, docs: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from their term lists."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        places = spread(self.ends[docs], sizes)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), sizes), np.where(np.isin(self.terms[places], item), self.impacts[places], 0))
        return out


def ranked_in_shards(lists: DataFrame, items: tuple, weights: np.ndarray, least: np.ndarray, n_docs: int, n_terms: int, k: int, schema: str) -> DataFrame:
    """item_id, text_hash, doc_id, score: the best of each shard that may be among the k best of all."""
    shared = lists.sparkSession.sparkContext.broadcast((*items, weights, least))

    def rank(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, terms, weights, least = shared.value
        table = pa.Table.from_batches(held).combine_chunks()
        flat = [pc.list_flatten(table.column(c)).to_numpy().astype(np.int64) for c in ("terms", "tallies")]
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column("terms")).to_numpy())])
        by_id = pc.sort_indices(table.select(["doc_id"]), sort_keys=[("doc_id", "ascending")]).to_numpy()  # nulls last
        shard = Shard(table.column("n").to_numpy(), ends, *flat, by_id, weights, n_docs, n_terms)
        of, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
        for i in range(len(ids)):
            d, s, _ = shard.best(flat[cuts[i] : cuts[i + 1]], int(least[i]), k)
            of.append(np.full(len(d), i))
            docs.append(d)
            scores.append(s)
        of, docs = pa.array(np.concatenate(of)), pa.array(np.concatenate(docs))
        out = [ids.take(of), hashes.take(of), table.column("doc_id").take(docs).combine_chunks(), pa.array(np.concatenate(scores))]
        yield from pa.table(out, ["item_id", "text_hash", "doc_id", "score"]).to_batches(max_chunksize=10_000)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in tables:
            sizes = np.cumsum(pc.list_value_length(b.column("terms")).to_numpy())
            at = 0
            while at < len(b):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + POSTINGS - size, "right")))
                held.append(b.slice(at, to - at))
                size += int(sizes[min(to, len(b)) - 1] - (sizes[at - 1] if at else 0))
                at = to
                if size >= POSTINGS or at < len(b):
                    yield from rank(held)
                    held, size = [], 0
        if held:
            yield from rank(held)
        release()

    return lists.mapInArrow(run, schema)


def top(rows: DataFrame, k: int) -> DataFrame:
    """rank and the rows of each item's k best."""
    order = Window.partitionBy("item_id", "text_hash").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, text_hash, rank, doc_id, score of the k best of docs(doc_id, text) for each of items(item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.xxhash64("text").alias("text_hash"), "text").dropDuplicates(["item_id", "text_hash"])
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, text_hash long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
    blocks, found = max(1, -(-size // BLOCK_CHARS)), []
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text_hash"), F.lit(blocks)) == i)
        vocabulary = vocabulary_of(block)
        lists = scratch.table(term_lists(docs, vocabulary), f"lists{i}")
        all_docs = lists.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        holding = lists.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas()
        df = np.zeros(len(vocabulary), np.int64)
        df[holding["term"].to_numpy(np.int64)] = holding["count"].to_numpy(np.int64)
        weights = np.floor(1000 * np.log((2 * all_docs.docs + 2) / (2 * df + 1))).astype(np.int64)
        known = item_terms(block, vocabulary)
        pilot = F.pmod(F.xxhash64("doc_id", "n"), F.lit(PILOT)) == 0
        least = np.zeros(len(known[0]), np.int64)
        args = (all_docs.docs, all_docs.terms, k, schema)
        first = scratch.table(top(ranked_in_shards(lists.where(pilot), known, weights, least, *args), k), f"pilot{i}")
        place = {x: j for j, x in enumerate(zip(known[0].to_pylist(), known[1].to_pylist(), strict=True))}
        for r in first.where(F.col("rank") == k).select("item_id", "text_hash", "score").collect():  # one row an item of the block at most
            least[place[r.item_id, r.text_hash]] = r.score
        rest = ranked_in_shards(lists.where(~pilot), known, weights, least, *args)
        found.append(scratch.table(top(rest.unionByName(first.drop("rank")), k), f"best{i}"))
        scratch.keep(*(f"best{j}" for j in range(i + 1)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("item_id", "text_hash", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    totals AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
    tallies AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tallies, totals GROUP BY term, n_docs),
    items AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
    scores AS (SELECT item_id, text, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS score
        FROM items JOIN tallies USING (term) JOIN weights USING (term), totals GROUP BY item_id, text, row, doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM placed WHERE rank <= {K}
"""
