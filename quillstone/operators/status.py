"""Document status from fields: state, review date, revision, and a citation that carries them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.values import fold

STATES = ("unknown", "current", "superseded", "draft")
# Field names by priority, and the whole values of each state, in small letters without accents.
STATUS_KEYS = ("status", "state", "doc_status", "trangthai", "trang_thai")
SUPERSEDED_KEYS = ("superseded_by", "replaced_by", "thay_the_boi")
DUE_KEYS = ("review_due", "next_review", "review_by", "expires", "expiry", "valid_until", "han_xem_lai", "ngay_het_han")
REVISION_KEYS = ("revision", "rev", "version", "phien_ban")
SUPERSEDED_VALUES = r"^(superseded|obsolete|withdrawn|cancell?ed|archived|replaced|expired|retired|deprecated|inactive|revoked|het[-_ ]?hieu[-_ ]?luc|ngung([-_ ]?ap[-_ ]?dung)?|da[-_ ]?thay[-_ ]?the|huy)$"
CURRENT_VALUES = r"^(current|active|effective|approved|released|valid|in[-_ ]?force|dang[-_ ]?ap[-_ ]?dung|hieu[-_ ]?luc|con[-_ ]?hieu[-_ ]?luc)$"
DRAFT_VALUES = r"^(draft|wip|in[-_ ]?review|for[-_ ]?review|pending|proposed|nhap|ban[-_ ]?nhap|cho[-_ ]?duyet)$"
# Field names of a citation.
DOCUMENT_KEYS = ("doc_id", "ma_tai_lieu", "ma_quy_trinh", "document_id")
EFFECTIVE_KEYS = ("effective", "ngay_hieu_luc", "effective_date")
#: The bit of the status byte for a review date that has passed; the lower two hold the state.
DUE_BIT = 4


def first_of(fields: Column, keys: tuple[str, ...]) -> Column:
    """The first value that is not blank, trimmed, under the first of the keys that has one; the names' case does not matter."""

    def one(key: str) -> Column:
        values = F.flatten(F.transform(F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == key), lambda e: e["value"]))
        return F.trim(F.get(F.filter(values, lambda v: F.length(F.trim(v)) > 0), F.lit(0)))

    return reduce(lambda a, b: F.coalesce(a, b), [one(k) for k in keys])


def day_of(text: Column) -> Column:
    """The day that a text begins with; days and months past their end run on, as 2026-02-30 into March."""
    n = [F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int") for i in (1, 2, 3)]
    return F.date_add(F.add_months(F.make_date(n[0], F.lit(1), F.lit(1)), n[1] - 1), n[2] - 1)


def status_of(fields: Column, today: Column) -> Column:
    """struct<state, due, due_date, revision, superseded_by, raw> of map<string, array<string>>.

    due: the review date has passed, which a superseded document's never does. Null where nothing is known: no state, no
    date that has passed and no revision.
    """
    raw, by, due_text, revision = (first_of(fields, k) for k in (STATUS_KEYS, SUPERSEDED_KEYS, DUE_KEYS, REVISION_KEYS))
    value = fold(raw)
    state = F.when(by.isNotNull() | value.rlike(SUPERSEDED_VALUES), 2).when(value.rlike(DRAFT_VALUES), 3).when(value.rlike(CURRENT_VALUES), 1).otherwise(0)
    due = F.coalesce((day_of(due_text) < today) & (state != 2), F.lit(False))
    due_date = F.nullif(F.regexp_extract(due_text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    found = F.struct(state.alias("state"), due.alias("due"), due_date.alias("due_date"), revision.alias("revision"), by.alias("superseded_by"), raw.alias("raw"))
    return F.when((state > 0) | due | revision.isNotNull(), found)


def status_byte(status: Column) -> Column:
    """The state, with DUE_BIT; 0 for a document without a status."""
    return F.coalesce(status["state"] + F.when(status["due"], DUE_BIT).otherwise(0), F.lit(0))


def citation(text: Column, path: Column, heading: Column, fields: Column, today: Column) -> Column:
    """A quoted text with its source below it: link, document id, revision, effective date, state, day of the copy."""
    name = F.regexp_extract(path, r"([^/]*?)(\.md)?$", 1)
    head = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(heading, F.lit("")), r"[\[\]|#^]", " "), r"\s+", " "))
    link = F.when(head != "", F.concat(F.lit("[["), name, F.lit("#"), head, F.lit("|"), name, F.lit(" › "), head, F.lit("]]"))).otherwise(F.concat(F.lit("[["), name, F.lit("]]")))
    status, document, effective = status_of(fields, today), first_of(fields, DOCUMENT_KEYS), first_of(fields, EFFECTIVE_KEYS)
    revision = status["revision"]
    parts = F.concat_ws(
        " · ", link, F.when(document != name, document), F.when(revision.rlike("(?i)^[0-9a-z]{1,3}$"), F.concat(F.lit("Rev "), revision)).otherwise(revision),
        F.concat(F.lit("effective "), effective), F.when(status["state"] == 2, "⚠ SUPERSEDED").when(status["state"] == 3, "draft"), F.concat(F.lit("copied "), F.date_format(today, "yyyy-MM-dd")),
    )
    lines = F.split(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"^\s+|\s+$", ""), "\n")
    quote = F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.concat(F.lit("> "), x), r"\s+$", "")), "\n")
    return F.concat(quote, F.lit("\n>\n> — "), parts, F.lit("\n"))
