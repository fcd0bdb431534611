"""Full-text search over an inverted index of words.

A text's words are runs of letters and digits that may be joined by . - _ /; a joined word is indexed with its parts and
its tails, so that any of them finds it from its start, and words with accents also without them. segments.py stores the
index; here are its words, its terms, and what is asked of texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import fold, let, natural_key

# What a word is, where a joined one is cut, and the length from which a word is none.
WORD, JOINT = r"[\p{L}\p{N}]+(?:[-._/][\p{L}\p{N}]+)*", r"[-._/]"
MAX_WORD = 48
#: The word that notes with a longer one have in the index; no term begins with it or contains it.
LONG_MARK = ""


def spread(w: Column) -> Column:
    """A word, its parts and its tails."""
    parts = F.split(w, JOINT)
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.substr(w, F.length(F.array_join(F.slice(parts, F.lit(1), i - 1), " ")) + 2))
    return F.when(w.rlike(JOINT), F.array_distinct(F.concat(F.array(w), parts, tails))).otherwise(F.array(w))


def postings(notes: DataFrame, *also: str) -> DataFrame:
    """word, key, exact of notes(key, text): rows for each word of a note and each form of it, not exact those that only folding gives.

    A note's forms are told apart in its own row, so a key has each word once, unless it is repeated itself. Only the few words
    that are long, joined or accented are taken to pieces, and those with accents are folded together.
    """
    text = F.concat_ws("\n", "text", *also) if also else F.col("text")
    found = notes.select("key", F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("words"))
    short = lambda w: F.length(w) <= MAX_WORD
    cut = lambda w: ~short(w) | reduce(lambda a, b: a | b, [F.contains(w, F.lit(c)) for c in "-._/"])
    found = found.select("key", "words", F.filter("words", cut).alias("cut"), F.array_join(F.filter("words", lambda w: (F.octet_length(w) > F.length(w)) & short(w)), "\n").alias("accented"))
    pieces = F.flatten(F.transform("cut", lambda w: F.when(short(w), spread(w)).otherwise(F.array(F.lit(LONG_MARK)))))
    exact = F.when(F.size("cut") == 0, F.col("words")).otherwise(F.array_distinct(F.concat(F.array_except("words", "cut"), pieces)))
    folded = F.when(F.col("accented") != "", F.split(fold(F.col("accented")), "\n")).otherwise(F.array().cast("array<string>"))
    found = found.select("key", exact.alias("exact"), folded.alias("folded"))
    forms = F.array(F.struct(F.col("exact").alias("words"), F.lit(True).alias("exact")), F.struct(F.array_except(F.flatten(F.transform("folded", spread)), "exact").alias("words"), F.lit(False).alias("exact")))
    return found.select("key", F.explode(forms).alias("f")).select(F.explode("f.words").alias("word"), "key", "f.exact")


def one_a_key(notes: DataFrame) -> DataFrame:
    """notes(key, text), those of a repeated key as one note."""
    if notes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return notes
    return notes.groupBy("key").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))


def settled(found: DataFrame) -> DataFrame:
    """One row for each word of a note: exact if any of its forms is."""
    return found.groupBy("word", "key").agg(F.max("exact").alias("exact"))


@dataclass(frozen=True)
class Term:
    """A word start, a phrase, a fragment inside words (3 letters or more), or a field (path, title, tag)."""

    text: str
    kind: str = "word"
    field: str = ""


def word_start(c: Column, prefix: str) -> Column:
    """As a range, which file statistics can answer."""
    prefix = prefix.lower()
    return (c >= prefix) & (c < prefix[:-1] + chr(ord(prefix[-1]) + 1))


def of_word(c: Column, t: Term) -> Column:
    return c.contains(t.text.lower()) if t.kind == "fragment" else word_start(c, t.text)


def phrase_in(text: Column, phrase: str, folded: bool = False) -> Column:
    """White space counts as one space."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.contains(fold(flat) if folded else flat, F.lit(" ".join(phrase.lower().split())))


def field_has(t: Term) -> Column:
    if t.field == "path":
        return F.lower("path").contains(t.text.lower())
    if t.field in ("title", "file"):
        return F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).contains(t.text.lower())
    tag = t.text.lower().lstrip("#")
    return F.exists("tags", lambda x: (F.lower(x) == tag) | F.lower(x).startswith(f"{tag}/"))


def flagged(index: DataFrame, terms: list[Term]) -> DataFrame:
    """__key, __t0, __t1, ... of a table of postings, read once: whether a note has a word of each term."""
    wanted = reduce(lambda a, b: a | b, [of_word(F.col("word"), t) for t in terms])
    return index.where(wanted).groupBy(F.col("key").alias("__key")).agg(*[F.bool_or(of_word(F.col("word"), t)).alias(f"__t{i}") for i, t in enumerate(terms)])


def search(notes: DataFrame, index, clauses: list[list[Term]], negatives: list[Term] = ()) -> DataFrame:
    """Notes that have a term of every clause and none of the negatives.

    index is a SearchIndex, or a table of postings; its flags() answer all word terms at once. It may be None where all terms
    are phrases and fields. Texts are read only for phrases, of what the words left over; a phrase without accents also
    matches a text without its accents.
    """
    terms = [t for c in clauses for t in c] + list(negatives)
    if not terms:
        return notes.where(F.lit(False))
    worded = [t for t in terms if t.kind in ("word", "fragment") and not t.field]
    out = notes
    if worded:
        flags = flagged(index, worded) if isinstance(index, DataFrame) else index.flags(worded)
        only_words = any(all(t in worded for t in c) for c in clauses)
        out = notes.join(flags, notes["key"] == F.col("__key"), "inner" if only_words else "left")

    def has(t: Term) -> Column:
        if t.field:
            return F.coalesce(field_has(t), F.lit(False))
        if t.kind == "phrase":
            return F.col("__p")[f"p{phrases.index(t)}"]
        return F.coalesce(F.col(f"__t{worded.index(t)}"), F.lit(False))

    def read(t: Term) -> Column:
        plain = phrase_in(F.col("text"), t.text)
        accented = F.octet_length("text") != F.length("text")
        return F.coalesce(plain | (accented & phrase_in(F.col("text"), t.text, folded=True)) if t.text.isascii() else plain, F.lit(False))

    phrases = [t for t in terms if t.kind == "phrase" and not t.field]
    wanted = [(c, reduce(lambda a, b: a | b, map(has, c))) for c in clauses] + [([t], ~has(t)) for t in negatives]
    for own, condition in wanted:
        if not any(t in phrases for t in own):
            out = out.where(condition)
    if phrases:
        # Exploded, so that texts are read here, as they are dealt out, and not in the scan, where a file may be one task.
        out = out.withColumn("__p", F.explode(F.array(F.struct(*[read(t).alias(f"p{i}") for i, t in enumerate(phrases)]))))
    for own, condition in wanted:
        if any(t in phrases for t in own):
            out = out.where(condition)
    return out.select(*notes.columns)


def ranked(found: DataFrame, mark: str, old: Column, name: Column) -> DataFrame:
    """Superseded notes last, those with the mark in their name first, then by name."""
    return found.orderBy(F.when(old, 1).otherwise(0), F.when(F.lower(name).contains(mark.lower()), 0).otherwise(1), natural_key(name), "path")


def snippet(text: Column, *marks: str, before: int = 50, after: int = 110) -> Column:
    """The text around the first of the marks that is in it, with or without accents, cut out and then put in one line; empty without any."""
    low = F.lower(text)
    own = [F.nullif(F.instr(low, m.lower()), F.lit(0)) for m in marks]
    folded = [F.nullif(F.position(fold(F.lit(m)), fold(low)), F.lit(0)) for m in marks]
    at = F.coalesce(*own, *folded)
    start = F.greatest(at - before, F.lit(1))
    return F.coalesce(F.regexp_replace(F.substr(text, start, at + after - start), r"\s+", " "), F.lit(""))


# Names in texts ----------------------------------------------------------------------------------------------------

# What is no plain text of a note.
FRONT_MATTER, FENCED, INLINE, WIKI, MARKDOWN, URL, TAG = r"(?s)\A---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\z)", r"(?ms)^[ \t]*(```|~~~).*?^[ \t]*\1[^\n]*$", r"`[^`\n]+`", r"!?\[\[[^\]\n]*\]\]", r"!?\[[^\]\n]*\]\([^)\n]*\)", r"\bhttps?://\S+", r"(?<![\p{L}\p{N}_])#[\p{L}\p{N}_/-]+"


def masked(text: Column) -> Column:
    """The text without front matter, code, links, addresses and tags."""
    for pattern in (FRONT_MATTER, FENCED, INLINE, WIKI, MARKDOWN, URL, TAG):
        text = F.regexp_replace(text, pattern, " ")
    return text


def quoted(name: str) -> str:
    return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mentions(notes: DataFrame, names: list[str], exclude: DataFrame | None = None) -> DataFrame:
    """key, path, mentions of notes(key, path, text): whole-word occurrences of any name of three letters or more outside links and code.

    Notes of exclude(path), which link there already, are left out. Most first, then by name.
    """
    names = [n for n in names if len(n.strip()) >= 3]
    if exclude is not None:
        notes = notes.join(exclude.select("path"), "path", "left_anti")
    if not names:
        return notes.select("key", "path", F.lit(0).alias("mentions")).where(F.lit(False))
    pattern = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(map(quoted, sorted(names, key=len, reverse=True))) + r")(?![\p{L}\p{N}_])"
    found = notes.select("key", "path", F.size(F.regexp_extract_all(masked(F.col("text")), F.lit(pattern), F.lit(0))).alias("mentions")).where("mentions > 0")
    return found.orderBy(F.desc("mentions"), natural_key(stem(F.col("path"))), "path")


def stem(path: Column) -> Column:
    """The name of a note: without folders and extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def fuzzy_score(name: Column, letters: str) -> Column:
    """Score of the letters as a subsequence of the name, null if they are none.

    The k-th letter of a run counts 2k, one at the start of a word 5 more, and each character of the name takes 0.05 off.
    """
    letters = letters.lower()
    first = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("score"), F.lit(0).alias("run"), F.lit(" ").alias("before"))

    def step(acc: Column, c: Column) -> Column:
        hit = (acc["at"] < len(letters)) & (c == F.substr(F.lit(letters), acc["at"] + 1, F.lit(1)))
        run = F.when(hit, acc["run"] + 1).otherwise(F.when(acc["at"] < len(letters), 0).otherwise(acc["run"]))
        gain = F.when(hit, run * 2.0 + F.when(acc["before"].rlike(r"[\s/_-]"), 5.0).otherwise(0.0)).otherwise(0.0)
        return F.struct((acc["at"] + hit.cast("int")).alias("at"), (acc["score"] + gain).alias("score"), run.alias("run"), c.alias("before"))

    done = F.aggregate(F.split(F.lower(name), ""), first, step)
    return F.when(done["at"] == len(letters), done["score"] - F.length(name) * 0.05)


def fuzzy_open(notes: DataFrame, letters: str, old: Column | None = None, most: int = 60) -> DataFrame:
    """path, score of the best notes(path): by their name, which counts 10 more, else by their whole path; superseded ones last."""
    asked = letters.strip().lower()
    score = F.coalesce(fuzzy_score(stem(F.col("path")), asked) + 10, fuzzy_score(F.col("path"), asked))
    rows = notes.select("path", score.alias("score"), F.coalesce(old if old is not None else F.lit(False), F.lit(False)).alias("old")).where("score is not null")
    return rows.orderBy("old", F.desc("score"), "path").limit(most).select("path", "score")


# Quotations --------------------------------------------------------------------------------------------------------

# What does not count in a line, and what a number is.
LEADING = r"^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+(?:\[.\]\s+)?|\d+[.)]\s+)"
NUMBER = r"\d+(?:[.,:/-]\d+)*%?"
#: Lines of a source, lines about the one that is named, and the coverage of a quotation that is close.
SOURCE_LINES, ABOUT, CLOSE = 40, 5, 0.8


def flat_line(c: Column) -> Column:
    """A line without marks of Markdown, with plain quotes and dashes, in small letters."""
    c = F.translate(c, "‘’“”–—", "''\"\"--")
    c = F.regexp_replace(F.regexp_replace(c, LEADING, ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[*_`|~]|==", " "), r"\s+", " ")))


def line_words(c: Column) -> Column:
    return F.regexp_extract_all(flat_line(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def numbers(c: Column) -> Column:
    """As written, but for commas between thousands."""
    return F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, r",(?=\d{3}\b)", ""))


def quote_check(text: Column, quote: str, near: int | None = None) -> Column:
    """struct<verdict, percent, first, last, source, missing_numbers, missing_words> of a quotation against a text.

    The source is at most SOURCE_LINES lines, from 1, within ABOUT lines of the line near, if it is given: those with the
    words in order (exact), else those with most of the quotation's words, the fewest and first of such. Close needs CLOSE
    of the words and every number as written. Null without a word in the quotation. Texts are compared as they are composed.
    """
    asked = [w for line in quote.splitlines() for w in re.findall(r"[^\W_]+", plain_line(line))]
    if not asked:
        return F.lit(None)
    asked_set = sorted(set(asked))
    wanted, sequence = F.array(*map(F.lit, asked_set)), F.lit(f" {' '.join(asked)} ")
    low = max(0, near - 1 - ABOUT) if near else 0
    most = len(asked) * 2 + 20
    state = "struct<n:int,have:array<string>,acc:string,best:int,most:int,exact:int,done:boolean>"
    start = F.from_json(F.lit('{"n":0,"have":[],"acc":" ","best":-1,"most":0,"exact":-1,"done":false}'), state)

    def check(lines: Column, words: Column) -> Column:
        high = F.least(F.size(lines), F.lit(near + ABOUT)) if near else F.size(lines)

        def joined(i: Column, j: Column) -> Column:
            return F.concat(F.lit(" "), F.array_join(F.flatten(F.slice(words, i + 1, j - i + 1)), " "), F.lit(" "))

        def from_line(a: Column) -> Column:
            """What the lines from a on hold: the fewest with most of the words, and the fewest with all of them in order."""

            def step(acc: Column, b: Column) -> Column:
                def grown(own: Column) -> Column:
                    new = F.struct((acc["n"] + F.size(own)).alias("n"), F.array_union(acc["have"], F.array_intersect(own, wanted)).alias("have"), F.concat(acc["acc"], F.array_join(own, " "), F.lit(" ")).alias("acc"))
                    return let(new, judged)

                def judged(new: Column) -> Column:
                    exact, more = F.contains(new["acc"], sequence), F.size(new["have"]) > acc["most"]
                    return F.struct(
                        new["n"].alias("n"), new["have"].alias("have"), new["acc"].alias("acc"), F.when(more & ~exact, b).otherwise(acc["best"]).alias("best"), F.when(exact, acc["most"]).otherwise(F.size(new["have"])).alias("most"),
                        F.when(exact, b).otherwise(F.lit(-1)).alias("exact"), (exact | (new["n"] > most) | (F.size(new["have"]) == len(asked_set))).alias("done"),
                    )

                own = F.get(words, b)
                return F.when(acc["done"] | (F.size(own) == 0), acc).otherwise(let(own, grown))

            reach = F.sequence(a, F.least(high, a + SOURCE_LINES) - 1)
            return F.aggregate(reach, start, step, lambda r: F.struct(a.alias("a"), r["best"].alias("best"), r["most"].alias("most"), r["exact"].alias("exact")))

        def chosen(found: Column) -> Column:
            exact = F.get(F.filter(found, lambda r: r["exact"] >= 0), F.lit(0))
            best = F.array_max(F.transform(F.filter(found, lambda r: r["most"] > 0), lambda r: F.struct(r["most"].alias("most"), (r["a"] - r["best"]).alias("short"), (-r["a"]).alias("early"), r["best"].alias("b"))))
            # The last line from which all of it still follows.
            first = F.element_at(F.filter(F.sequence(exact["a"], exact["exact"]), lambda a: F.contains(joined(a, exact["exact"]), sequence)), -1)
            picked = F.struct(exact.isNotNull().alias("exact"), F.coalesce(first, -best["early"]).alias("low"), F.coalesce(exact["exact"], best["b"]).alias("high"), best["most"].alias("most"))
            return let(picked, told)

        def told(x: Column) -> Column:
            size = x["high"] - x["low"] + 1
            source = F.coalesce(F.array_join(F.slice(lines, x["low"] + 1, size), "\n"), F.lit(""))
            have = F.coalesce(F.flatten(F.slice(words, x["low"] + 1, size)), F.array().cast("array<string>"))
            missing = F.array_except(numbers(F.lit(quote)), numbers(source))
            share = F.when(x["exact"], 1.0).otherwise(F.coalesce(x["most"] / len(asked_set), F.lit(0.0)))
            verdict = F.when(x["exact"], "exact").when((share >= CLOSE) & (F.size(missing) == 0), "close").otherwise("not_supported")
            lost = F.when(x["exact"], F.array().cast("array<string>")).otherwise(F.array_except(F.array(*map(F.lit, dict.fromkeys(asked))), have))
            return F.struct(verdict.alias("verdict"), F.floor(share * 100 + 0.5).cast("double").alias("percent"), (x["low"] + 1).alias("first"), (x["high"] + 1).alias("last"), source.alias("source"), missing.alias("missing_numbers"), lost.alias("missing_words"))

        every = F.when(high > low, F.sequence(F.lit(low), high - 1)).otherwise(F.array().cast("array<int>"))
        return let(F.transform(F.filter(every, lambda a: F.size(F.get(words, a)) > 0), from_line), chosen)

    return let(F.split(text, r"\r?\n"), lambda lines: let(F.transform(lines, line_words), lambda words: check(lines, words)))


def quote_lookup(text: Column, quote: str, near: int | None = None) -> Column:
    """struct<check, found_elsewhere struct<verdict, first, last>>: quote_check(), and where else a quotation is that isn't near the line named."""
    check, kind = quote_check(text, quote, near), "struct<verdict:string,first:int,last:int>"
    if not near:
        return F.struct(check.alias("check"), F.lit(None).cast(kind).alias("found_elsewhere"))

    def both(own: Column) -> Column:
        other = let(quote_check(text, quote), lambda c: F.when(c["verdict"] != "not_supported", F.struct(c["verdict"].alias("verdict"), c["first"].alias("first"), c["last"].alias("last")).cast(kind)))
        return F.struct(own.alias("check"), F.when(own["verdict"] == "not_supported", other).alias("found_elsewhere"))

    return let(check, both)


def plain_line(line: str) -> str:
    """flat_line() of a text that is at hand."""
    line = re.sub(LEADING, "", line.translate(str.maketrans("‘’“”–—", "''\"\"--")))
    line = re.sub(r"[*_`|~]|==", " ", re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", line))
    return " ".join(line.split()).lower()
