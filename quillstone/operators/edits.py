"""Changes to the text of a note, as expressions. They give null where they don't apply; writing is the caller's.

committed() takes a batch of edits to a table of notes as compare and swap by version, with what did not fit as rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.functions.values import normal_path, view_format
from quillstone.sources.markdown import FRONT_MATTER, front_matter


def replaced_once(text: Column, old: str, new: str, every: bool = False) -> Column:
    """Null unless the old text is there exactly once, or, with every, at least once."""
    n = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)
    return F.when((n >= 1) if every else (n == 1), F.replace(text, F.lit(old), F.lit(new)))


def appended(text: Column, more: str) -> Column:
    return F.concat(F.regexp_replace(text, r"\n*\z", ""), F.lit("\n" + more.rstrip("\n") + "\n"))


def task_set(text: Column, line: int, task: str, status: str) -> Column:
    """The task at a line (from 0) with another status; null if the line holds no such task."""
    lines = F.split(text, "\n")
    own = F.get(lines, F.lit(line))
    fits = own.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\[.\]") & F.contains(own, F.lit(task))
    new = F.regexp_replace(own, r"^(\s*(?:[-*+]|\d+[.)])\s+\[).(\])", f"$1{status}$2")
    return F.when(fits, F.array_join(F.transform(lines, lambda x, i: F.when(i == line, new).otherwise(x)), "\n"))


def property_set(text: Column, key: str, value: str | None) -> Column:
    """A front-matter property put in, changed, or (None) taken out."""
    had = text.rlike(FRONT_MATTER)
    own = rf"(?m)^{re.escape(key)}\s*:.*(?:\r?\n\s*-\s.*)*"
    front = front_matter(text)
    if value is None:
        changed = F.regexp_replace(front, own + r"\r?\n?", "")
    else:
        line = f"{key}: {value}"
        changed = F.when(front.rlike(own), F.regexp_replace(front, own, line.replace("\\", "\\\\").replace("$", "\\$"))).otherwise(F.concat_ws("\n", F.when(front != "", front), F.lit(line)))
    rest = F.regexp_replace(text, FRONT_MATTER, "")
    block = F.concat(F.lit("---\n"), F.rtrim(changed), F.lit("\n---\n"), rest)
    return F.when(had | F.lit(value is not None), F.when(F.trim(changed) == "", rest).otherwise(block)).otherwise(text)


def links_renamed(text: Column, old: str, new: str) -> Column:
    """Wiki links to a stem lead to its new name; headings and aliases stay."""
    return F.regexp_replace(text, r"(?i)(\[\[)\Q" + old + r"\E(?=[\]|#])", "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))


def encoded(path: Column) -> Column:
    """A path as a Markdown link has it: percent-encoded but for slashes and a few marks."""
    out = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def relative_path(folder: Column, path: Column) -> Column:
    """The path as seen from a folder (empty: the root)."""
    a = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    b = F.split(path, "/")
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("same"))
    shared = F.aggregate(
        F.slice(a, F.lit(1), F.size(b) - 1), start,
        lambda acc, x: F.when(acc["same"] & (x == F.get(b, acc["n"])), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("same"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("same"))),
    )["n"]
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


def moved_links(text: Column, source: Column, old: Column, new: Column, name: Column | None = None) -> Column:
    """The text of a note whose links to a moved note follow it: wiki links, which keep headings and aliases, and relative Markdown links.

    A link leads to the old note by its name, its path, or its path from the note's folder. name is what wiki links then
    say: the new note's name, or its path without extension where the name alone would lead elsewhere.
    """
    bare = lambda c: F.regexp_replace(c, r"(?i)\.(md|markdown)$", "")
    stem = lambda c: bare(F.substring_index(c, "/", -1))
    folder = F.when(F.contains(source, F.lit("/")), F.regexp_replace(source, "/[^/]*$", "")).otherwise("")
    is_old = lambda c: F.lower(c).isin(F.lower(old), F.lower(bare(old)))
    leads = lambda c: is_old(c) | is_old(normal_path(F.concat_ws("/", folder, c)))
    written = F.coalesce(name, stem(new)) if name is not None else stem(new)

    def follow(one: Column) -> Column:
        inner = F.regexp_extract(one, r"^!?\[\[([^\[\]\n]+?)\]\]$", 1)
        target = F.trim(F.regexp_extract(inner, r"^([^#|]*)", 1))
        wiki = F.concat(F.when(one.startswith("!"), "!").otherwise(""), F.lit("[["), written, F.regexp_extract(inner, r"^[^#|]*(.*)$", 1), F.lit("]]"))
        href = F.regexp_extract(one, r"^\[[^\]\n]*\]\(([^)\s]+)", 1)
        path, sub = F.substring_index(href, "#", 1), F.regexp_extract(href, "(#.*)$", 1)
        plain = ~href.rlike(r"(?i)^([a-z][a-z0-9+.-]*:|#)")
        marked = F.concat(F.regexp_extract(one, r"^(\[[^\]\n]*\]\()", 1), encoded(relative_path(folder, new)), sub, F.regexp_extract(one, r"((?:\s+\"[^\"]*\")?\))$", 1))
        is_wiki = (inner != "") & (leads(target) | (F.lower(target) == F.lower(stem(old))))
        return F.when(is_wiki, wiki).when((href != "") & plain & leads(F.try_url_decode(path)), marked).otherwise(one)

    pattern = r"!?\[\[[^\[\]\n]+?\]\]|\[[^\]\n]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.concat(F.transform(found, follow), F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")


def canvas_moved(text: Column, old: Column, new: Column) -> Column:
    """The text of a canvas whose references to a file follow it; all else in it, known or not, stays as it is written."""
    in_json = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    literal = F.replace(F.replace(in_json(new), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    quoted = F.concat(F.lit("\\Q"), F.replace(in_json(old), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(text, F.concat(F.lit(r'("file"\s*:\s*")'), quoted, F.lit('(?=")')), F.concat(F.lit("$1"), literal))


def expanded(template: str, title: Column, now: Column, folder: Column | None = None) -> Column:
    """A template filled in: {{title}}, {{date}}, {{time}} with a format after a colon if wanted, and the commands of COMMANDS between <% and %>.

    Formats are those of views. Commands that are not known stay as they are written.
    """
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"<%[-_*]?\s*([\s\S]*?)\s*[-_]?%>|\{\{\s*(title|date|time)(?::([^}]*))?\s*\}\}", template, re.IGNORECASE):
        parts += [F.lit(template[at : m.start()])]
        at = m.end()
        if m[1] is not None:
            parts.append(_command(m[1], title, now, F.lit("") if folder is None else folder, m[0]))
        elif m[2].lower() == "title":
            parts.append(title)
        else:
            parts.append(view_format(now, m[3] or ("YYYY-MM-DD" if m[2].lower() == "date" else "HH:mm")))
    return F.concat(*parts, F.lit(template[at:]))


#: The commands of templates.
COMMANDS = {
    "title": r"tp\.file\.title", "folder": r"tp\.file\.folder\(\s*\)", "cursor": r"tp\.file\.cursor\(.*\)", "now": r"tp\.date\.now\(([^)]*)\)",
    "tomorrow": r"tp\.date\.tomorrow\(([^)]*)\)", "yesterday": r"tp\.date\.yesterday\(([^)]*)\)", "creation": r"tp\.file\.creation_date\(([^)]*)\)",
}


def _command(code: str, title: Column, now: Column, folder: Column, written: str) -> Column:
    for name, pattern in COMMANDS.items():
        m = re.fullmatch(pattern, code)
        if not m:
            continue
        if name in ("title", "folder", "cursor"):
            return {"title": title, "folder": F.substring_index(folder, "/", -1), "cursor": F.lit("")}[name]
        own = re.match(r"""\s*["']([^"']*)["']""", m[1])
        days = re.search(r",\s*(-?\d+)", m[1]) if name == "now" else None
        moved = {"tomorrow": 1, "yesterday": -1}.get(name, int(days[1]) if days else 0)
        return view_format(now + F.make_interval(days=F.lit(moved)), own[1] if own else "YYYY-MM-DD HH:mm" if name == "creation" else "YYYY-MM-DD")
    return F.lit(written)


def created(notes: DataFrame, new: DataFrame) -> DataFrame:
    """new(path, text) with created: false where there is a note of that path, in any case, which stays as it is."""
    had = notes.select(F.lower("path").alias("__had")).distinct()
    return new.join(had, F.lower("path") == F.col("__had"), "left").withColumn("created", F.col("__had").isNull()).drop("__had")


# Batches of edits ---------------------------------------------------------------------------------------------------


def committed(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(path, seq, text, base, force) of notes(path, text, version) with outcome, and theirs where it is a conflict.

    An edit fits if its note still has the version that it began from, if base is null, or if it is forced; one whose note is
    gone writes it back. Of several that fit, the last forced one counts, else the first by seq ("written", or "created"
    where there was no note); the others, and those that don't fit, are in conflict with the text that is there in the end,
    unless they wrote the very same ("same").
    """
    both = edits.join(notes.select("path", F.col("text").alias("__now"), F.col("version").alias("__version")), "path", "left")
    there, force = F.col("__version").isNotNull(), F.coalesce("force", F.lit(False))
    fits = force | F.col("base").isNull() | ~there | (F.col("base") == F.col("__version"))
    order = W.partitionBy("path").orderBy(force.desc(), F.when(force, -F.col("seq")).otherwise(F.col("seq")))
    winners = both.where(fits).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("path", F.col("seq").alias("__seq"), F.col("text").alias("__text"))
    told = both.join(winners, "path", "left")
    final = F.coalesce("__text", "__now")
    won = F.coalesce(F.col("seq") == F.col("__seq"), F.lit(False))
    outcome = F.when(won, F.when(~there, "created").when(F.col("text") == F.col("__now"), "same").otherwise("written")).when(F.col("text") == final, "same").otherwise("conflict")
    told = told.withColumn("outcome", outcome)
    return told.withColumn("theirs", F.when(F.col("outcome") == "conflict", final)).select(*edits.columns, "outcome", "theirs")


def after(notes: DataFrame, outcomes: DataFrame, version: Column) -> DataFrame:
    """notes(path, text, version) once what was written or created is in it, under a new version."""
    new = outcomes.where(F.col("outcome").isin("written", "created")).select("path", "text", version.alias("version"))
    return notes.join(new.select("path"), "path", "left_anti").select("path", "text", "version").unionByName(new)
