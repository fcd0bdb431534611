"""A stored search index: segments of postings with a dictionary and its trigrams, changed without being written anew.

A segment is a folder of four tables:

* postings(word, key, exact) in parts by ranges of (word, key), so that a word of very many notes spans several parts;
* words(word, notes, first, last): the distinct words, sorted, with the parts that hold them;
* grams(gram, word, first, last): the words by their three-letter sequences, sorted by these;
* gone(key): notes whose postings in earlier segments no longer count.

A word start reads a range of the words, a fragment the words that have all its trigrams; the words found lead to their
parts and rows. An update writes one segment, of the notes it changes. A manifest names the segments in order; the latest
whole manifest counts, so a write that fails leaves the index as it was. When more than DRIFT of the notes (and LEAST
notes) have changed since the last whole segment, all are merged into one, from their postings, not from texts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.sources.scratch import exists, listed, remove_folder, removed, widened, written

#: Changed notes after which segments are merged: a share of all, but so many at least.
DRIFT, LEAST = 0.03, 2000
#: Rows of a part.
PART_ROWS = 1_500_000
#: Letters of a fragment that the trigrams answer, and about so many trigrams a word.
GRAM, GRAMS = 3, 8
#: Replaced keys that are sent to every task; more meet the postings in parts of PART_ROWS.
SENT = 500_000


class SearchIndex:
    """The index under a folder. Its tables are read when they are asked for."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # Manifests ------------------------------------------------------------------------------------------------------

    def generation(self) -> int:
        """The number of the latest whole manifest, -1 without one."""
        names = [int(n) for n in listed(self.spark, f"{self.base}/manifest")]
        return max((n for n in names if exists(self.spark, f"{self.base}/manifest/{n:06}")), default=-1)

    def segments(self) -> list:
        """Rows of at, path, notes, gone, key_type, oldest first."""
        n = self.generation()
        return self.spark.read.parquet(f"{self.base}/manifest/{n:06}").orderBy("at").collect() if n >= 0 else []

    def _commit(self, segments: list[tuple]) -> None:
        rows = [(i, *s) for i, s in enumerate(segments)]
        self.spark.createDataFrame(rows, "at int, path string, notes long, gone long, key_type string").coalesce(1).write.parquet(f"{self.base}/manifest/{self.generation() + 1:06}")

    def fork(self, base: str) -> SearchIndex:
        """An index under another folder that begins with the segments of this one; changes of either leave the other as it is."""
        other = SearchIndex(self.spark, base)
        other._commit([tuple(s)[1:] for s in self.segments()])
        return other

    # Writing --------------------------------------------------------------------------------------------------------

    def _segment(self, forms: DataFrame, notes: int, gone: DataFrame) -> tuple:
        path = f"{self.base}/segment-{uuid.uuid4().hex}"
        key_type = forms.schema["key"].dataType.simpleString()
        # By their number: as many parts as keep the rows of each in little memory.
        parts = max(self.spark.sparkContext.defaultParallelism, -(-forms.count() // PART_ROWS))
        ranged = forms.repartitionByRange(parts, "word", "key").withColumn("part", F.spark_partition_id())
        # Not sorted within a part, of which a few are read as a whole.
        ranged.write.partitionBy("part").parquet(f"{path}/postings")
        postings = self._postings(path, key_type)
        # The range partitioner reads its rows twice: they are written before.
        words = written(postings.groupBy("word").agg(F.count("*").alias("notes"), F.min("part").alias("first"), F.max("part").alias("last")), "words")
        # In as many parts as keep each small; those of few words are left to AQE.
        most = words.count() * GRAMS // PART_ROWS
        more = [most] if most > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []
        words.repartitionByRange(*more, "word").sortWithinPartitions("word").write.parquet(f"{path}/words")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - (GRAM - 1)), lambda i: F.substr("word", i, F.lit(GRAM))))
        spread = words.where(F.length("word") >= GRAM).select(F.explode(grams).alias("gram"), "word", "first", "last")
        spread.repartitionByRange(*more, "gram", "word").sortWithinPartitions("gram", "word").write.parquet(f"{path}/grams")
        gone.select("key").where("key is not null").distinct().write.parquet(f"{path}/gone")
        removed(words)
        n_gone = self.spark.read.schema(f"key {key_type}").parquet(f"{path}/gone").count()
        return path, notes, n_gone, key_type

    def build(self, notes: DataFrame) -> SearchIndex:
        """The index of notes(key, text), in place of whatever was there."""
        forms = written(S.postings(widened(S.one_a_key(notes.select("key", "text")), "key")), "forms")
        self._commit([self._segment(forms, notes.count(), notes.select("key").limit(0))])
        removed(forms)
        return self

    def update(self, gone: DataFrame, new: DataFrame, merge: bool = True) -> SearchIndex:
        """Without gone(key), and with new(key, text) in place of what these keys had: a segment, merged with the rest when that is due."""
        new = written(widened(S.one_a_key(new.select("key", "text")), "key"), "new")
        forms = written(S.postings(new), "forms")
        own = self._segment(forms, new.count(), gone.select("key").unionByName(new.select("key")))
        self._commit([*(tuple(s)[1:] for s in self.segments()), own])
        removed(forms, new)
        if merge and self.merge_due():
            self.merge()
        return self

    def merge_due(self) -> bool:
        """Whether more notes have changed since the first segment than are allowed."""
        first, *later = self.segments()
        return sum(s.notes + s.gone for s in later) > max(LEAST, DRIFT * first.notes)

    def merge(self) -> SearchIndex:
        """All segments as one. Those that the manifest before this one has stay for its readers; older ones go."""
        before = self.segments()
        live = written(self.postings(), "live")
        notes = live.select("key").distinct().count()
        self._commit([self._segment(live, notes, live.select("key").limit(0))])
        removed(live)
        kept = {s.path for s in before} | {s.path for s in self.segments()}
        for name in listed(self.spark, self.base):
            path = f"{self.base}/{name}"
            if name.startswith("segment-") and path not in kept:
                remove_folder(self.spark, path)
        return self

    # Reading --------------------------------------------------------------------------------------------------------

    def _postings(self, path: str, key_type: str) -> DataFrame:
        return self.spark.read.schema(f"word string, key {key_type}, exact boolean, part int").parquet(f"{path}/postings")

    def _live(self, rows: DataFrame, at: int, segments: list, parts: int | None = None) -> DataFrame:
        """Rows of a segment without the keys that later ones replace. With parts, rows that are very many meet very many keys in so many."""
        later = [s for s in segments[at + 1 :] if s.gone]
        if not later:
            return rows
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema(f"key {s.key_type}").parquet(f"{s.path}/gone") for s in later]).distinct()
        if sum(s.gone for s in later) <= SENT:
            return rows.join(F.broadcast(gone), "key", "left_anti")
        if parts:
            rows, gone = rows.repartition(parts, "key"), gone.repartition(parts, "key")
        return rows.join(gone, "key", "left_anti")

    def postings(self) -> DataFrame:
        """word, key, exact of all that counts."""
        segments = self.segments()
        parts = []
        for i, s in enumerate(segments):
            rows = self._postings(s.path, s.key_type).drop("part")
            parts.append(self._live(rows, i, segments, max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))).select("word", "key", "exact"))
        return reduce(DataFrame.unionByName, parts)

    def words_of(self, terms: list[S.Term]) -> DataFrame:
        """segment, word, first, last, terms array<int>: the words of each segment that the terms (word starts, fragments) find."""
        found = []
        for s in self.segments():
            for i, t in enumerate(terms):
                if t.kind == "fragment" and len(t.text) >= GRAM:
                    low = t.text.lower()
                    wanted = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
                    hits = self.spark.read.schema("gram string, word string, first int, last int").parquet(f"{s.path}/grams")
                    hits = hits.where(reduce(lambda a, b: a | b, [F.col("gram") == g for g in wanted])).groupBy("word").agg(F.count("*").alias("n"), F.first("first").alias("first"), F.first("last").alias("last"))
                    hits = hits.where((F.col("n") == len(wanted)) & S.of_word(F.col("word"), t))
                else:
                    hits = self.spark.read.schema("word string, first int, last int").parquet(f"{s.path}/words").where(S.of_word(F.col("word"), t))
                found.append(hits.select(F.lit(s.at).alias("segment"), "word", "first", "last", F.lit(i).alias("term")))
        rows = reduce(DataFrame.unionByName, found)
        return rows.groupBy("segment", "word", "first", "last").agg(F.collect_set("term").alias("terms"))

    def hits(self, terms: list[S.Term]) -> DataFrame:
        """key, term: the notes that have a word of a term, from the parts that hold such words."""
        segments = self.segments()
        # Written, so that Spark knows how small it is, and prunes parts by it where it can be broadcast.
        words = written(self.words_of(terms).select("segment", "word", "terms", F.explode(F.sequence("first", "last")).alias("part")), "hits")
        found = [self._live(self._postings(s.path, s.key_type).join(words.where(F.col("segment") == s.at).drop("segment"), ["part", "word"]), i, segments) for i, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, [f.select("key", F.explode("terms").alias("term")) for f in found])

    def flags(self, terms: list[S.Term]) -> DataFrame:
        """__key, __t0, __t1, ...: whether a note has a word of each term; notes without any have no row."""
        each = [F.bool_or(F.col("term") == i).alias(f"__t{i}") for i in range(len(terms))]
        return self.hits(terms).groupBy(F.col("key").alias("__key")).agg(*each)

    def notes_with(self, words: Column) -> DataFrame:
        """word, key of the words that a condition on the column word picks, from the dictionary's parts of them."""
        segments = self.segments()
        picked = [self.spark.read.parquet(f"{s.path}/words").where(words).select(F.lit(s.at).alias("segment"), "word", F.explode(F.sequence("first", "last")).alias("part")) for s in segments]
        picked = written(reduce(DataFrame.unionByName, picked), "picked")
        found = [self._live(self._postings(s.path, s.key_type).join(picked.where(F.col("segment") == s.at).drop("segment"), ["part", "word"]), i, segments) for i, s in enumerate(segments)]
        return reduce(DataFrame.unionByName, [f.select("word", "key") for f in found])

    def frequencies(self, words: list[str]) -> dict[str, int]:
        """Notes with each of a few words, replaced ones included: an estimate that orders them."""
        out = dict.fromkeys(words, 0)
        for s in self.segments():
            for r in self.spark.read.parquet(f"{s.path}/words").where(F.col("word").isin(words)).select("word", "notes").collect():
                out[r.word] += r.notes
        return out


def quote_words(quote: str) -> list[str]:
    """The distinct words of a quotation."""
    import re

    return sorted({w for line in quote.splitlines() for w in re.findall(r"[^\W_]+", S.plain_line(line))})


def quote_candidates(index: SearchIndex, quote: str) -> DataFrame:
    """key of all notes that can support a quotation at least closely.

    Of n distinct words such a note has CLOSE * n or more, so it has one of the rarest n - CLOSE * n + 1. Notes with a word
    that is too long for the index are candidates as well.
    """
    words = quote_words(quote)
    counts = index.frequencies(words)
    needed = -(-len(words) * round(S.CLOSE * 100) // 100)
    rare = sorted(words, key=lambda w: (counts[w], w))[: len(words) - needed + 1]
    return index.notes_with(F.col("word").isin([*rare, S.LONG_MARK])).select("key").distinct()


def find_quote(notes: DataFrame, index: SearchIndex, quote: str, near: int | None = None) -> DataFrame:
    """The notes(key, text, ...) that support a quotation exactly or closely, or, with near, elsewhere than there: with check and
    found_elsewhere, as quote_lookup() has them. Only candidates are read line by line."""
    if not quote_words(quote):
        return notes.withColumns({"check": F.lit(None), "found_elsewhere": F.lit(None)}).where(F.lit(False))
    found = widened(notes.join(quote_candidates(index, quote), "key", "left_semi"), "key")
    # Exploded, as a filter would look each quotation up once more, and in the scan, where a file may be one task.
    held = F.filter(F.array(S.quote_lookup(F.col("text"), quote, near)), lambda q: (q["check"]["verdict"] != "not_supported") | q["found_elsewhere"].isNotNull())
    found = found.withColumn("__q", F.explode(held))
    return found.select(*notes.columns, "__q.check", "__q.found_elsewhere")
