"""Read tools over a vault: each filters at the source by what the caller may see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.values import fold
from quillstone.operators.rows import in_folder


def visible(df: DataFrame, only: list[str] | None, path: str = "path") -> DataFrame:
    """Rows of the folders a caller is confined to; all without a list."""
    return df if only is None else df.where(reduce(lambda a, b: a | b, [in_folder(F.col(path), f) for f in only], F.lit(False)))


def find_notes(notes: DataFrame, words: str, folder: str | None = None) -> DataFrame:
    """Notes with all the words, without accents, in their name, in a folder if one is named."""
    parts = fold(F.lit(words))
    return (notes if folder is None else notes.where(in_folder(F.col("path"), folder))).where(F.forall(F.filter(F.split(parts, r"\s+"), lambda w: w != ""), lambda w: F.contains(fold(F.col("stem")), w)))


def list_tasks(tasks: DataFrame, folder: str | None = None, done: bool | None = None, due_before: Column | None = None, due_after: Column | None = None, text: str | None = None) -> DataFrame:
    """tasks(path, text, completed, due) by what is asked for; bounds on the date leave out tasks without one."""
    conditions = [
        in_folder(F.col("path"), folder) if folder else None, (F.col("completed") == done) if done is not None else None, (F.col("due") <= due_before) if due_before is not None else None,
        (F.col("due") >= due_after) if due_after is not None else None, F.contains(F.lower("text"), F.lit(text.lower())) if text else None,
    ]
    return reduce(lambda df, c: df.where(c), [c for c in conditions if c is not None], tasks)


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def naming_line(text: Column, name: str, longest: int = 160) -> Column:
    """The first line that names a note."""
    hit = F.get(F.filter(F.split(text, r"\r?\n"), lambda line: F.contains(F.lower(line), F.lit(name.lower()))), F.lit(0))
    return F.substring(F.trim(hit), 1, longest)


def cards_by_due(cards: DataFrame) -> DataFrame:
    """cards(lane, pos, text) of each lane by the date in their text, those without one last, else as they stand."""
    due = F.nullif(F.regexp_extract("text", r"(?:📅\uFE0F?\s*|@\{)(\d{4}-\d\d-\d\d)", 1), F.lit(""))
    return cards.withColumn("due", due).orderBy("lane", F.col("due").asc_nulls_last(), "pos")


def card_counts(cards: DataFrame) -> DataFrame:
    """lane, cards, done of cards(lane, done, status); a card is done in a finished lane or when ticked."""
    return cards.groupBy("lane").agg(F.count("*").alias("cards"), F.count_if(F.col("done") | (F.lower("status") == "x")).alias("done"))
