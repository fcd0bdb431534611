"""A folder of Markdown notes as tables: files, notes with fields, links, tags and tasks, boards and canvases.

Everything is a Column expression over the text of a note, so reading a folder is one scan without Python workers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.values import let, link, link_date, normal_path

FRONT_MATTER = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
TAG = r"[\p{L}\p{N}_/-]*[\p{L}_/-][\p{L}\p{N}_/-]*"
# Marks of dates in a task.
TASK_DATES = {"due": "📅", "scheduled": "⏳", "start": "🛫", "completion": "✅", "created": "➕"}


def read_folder(spark: SparkSession, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, text, size, mtime, is_note, folder, stem, ext of every file but hidden ones, node_modules and excluded folders.

    Files of no bytes are passed over, as by every file source of Spark.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split("://")[-1].rstrip("/")
    path = F.split_part(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), F.lit(base + "/"), F.lit(-1))
    is_text = F.lower("path").rlike(r"\.(md|markdown|canvas|base)$")
    own = (path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    # The contents of other files are not read.
    files = listed.where(is_text).select(*own, F.col("content").cast("string").alias("text")).unionByName(listed.where(~is_text).select(*own, F.lit(None).cast("string").alias("text")))
    low = F.lower("path")
    files = files.where(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike(r"(^|/)node_modules/"))
    for folder in excluded:
        files = files.where(~low.startswith(folder.lower().rstrip("/") + "/"))
    name = F.substring_index("path", "/", -1)
    return files.withColumns({
        "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "stem": F.regexp_replace(name, r"\.[^.]+$", ""),
        "folder": F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(""), "is_note": low.rlike(r"\.(md|markdown)$"),
    })


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, FRONT_MATTER, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT_MATTER, "")


def unquoted(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), r"""^(["'])(.*)\1$""", "$2")


def front_fields(text: Column) -> Column:
    """map<string, array<string>> of `key: value`, `key: [a, b]` and `- item` lines; deeper levels are left out."""
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<key:string,value:string>>").alias("found"))

    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))

    def step(acc: Column, line: Column) -> Column:
        def keyed(key: Column) -> Column:
            def valued(value: Column) -> Column:
                listed = F.filter(F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), unquoted), lambda v: v != "")
                values = F.when(value.rlike(r"^\[.*\]$"), listed).when(value == "", F.array().cast("array<string>")).otherwise(F.array(unquoted(value)))
                return F.struct(key.alias("key"), F.concat(acc["found"], F.array(pair(key, F.lit(None).cast("string"))), F.transform(values, lambda v: pair(key, v))).alias("found"))

            more = lambda item: F.when((item != "") & (acc["key"] != ""), F.struct(acc["key"].alias("key"), F.concat(acc["found"], F.array(pair(acc["key"], unquoted(item)))).alias("found"))).otherwise(acc)
            return F.when(key != "", let(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), valued)).otherwise(let(F.regexp_extract(line, r"^\s*-\s+(.*)$", 1), more))

        return let(F.regexp_extract(line, r"^([^\s:#-][^:]*?)\s*:(?:\s|$)", 1), keyed)

    def mapped(found: Column) -> Column:
        values = lambda keys: F.transform(keys, lambda k: F.transform(F.filter(found, lambda e: (e["key"] == k) & e["value"].isNotNull()), lambda e: e["value"]))
        return let(F.array_distinct(F.transform(found, lambda e: e["key"])), lambda keys: F.map_from_arrays(keys, values(keys)))

    return let(F.aggregate(F.split(front_matter(text), r"\r?\n"), start, step)["found"], mapped)


def inline_fields(text: Column) -> Column:
    """The same of `key:: value` lines and `[key:: value]` or `(key:: value)` anywhere; the last of a key counts."""
    entry = lambda s: F.struct(F.trim(F.regexp_extract(s, r"([\p{L}_][\p{L}\p{N}_ -]*?)\s*::", 1)).alias("key"), F.array(F.trim(F.regexp_extract(s, r"::[ \t]*(.*?)[\])]?$", 1))).alias("value"))

    def entries(plain: Column) -> Column:
        lines = F.regexp_extract_all(plain, F.lit(r"(?m)^\s*(?:[-*+]\s+)?[\p{L}_][\p{L}\p{N}_ -]*::[ \t]*.*$"), F.lit(0))
        spans = F.regexp_extract_all(plain, F.lit(r"[\[(][\p{L}_][\p{L}\p{N}_ -]*::[^\])\n]*[\])]"), F.lit(0))
        return F.transform(F.concat(lines, spans), entry)

    def mapped(found: Column) -> Column:
        values = lambda keys: F.transform(keys, lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"])
        return let(F.array_distinct(F.transform(found, lambda e: e["key"])), lambda keys: F.map_from_arrays(keys, values(keys)))

    return let(let(without_code(body(text)), entries), mapped)


def fields(text: Column) -> Column:
    """Front matter, which inline fields override."""
    return let(inline_fields(text), lambda b: F.map_concat(F.map_filter(front_fields(text), lambda k, v: ~F.map_contains_key(b, k)), b))


def without_code(text: Column) -> Column:
    fenced = F.regexp_replace(text, r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\z)", "")
    return F.regexp_replace(fenced, r"`[^`\n]*`", "")


def links(text: Column) -> Column:
    """Targets in written order, once each: wiki links and embeds without heading and alias, relative Markdown links."""

    def found(plain: Column) -> Column:
        wiki = F.regexp_extract_all(plain, F.lit(r"\[\[([^\]\n|#]+)(?:#[^\]\n|]*)?(?:\|[^\]\n]*)?\]\]"), F.lit(1))
        mark = F.regexp_extract_all(plain, F.lit(r"\]\((?![a-zA-Z][a-zA-Z0-9+.-]*:|#)<?([^)\s>#]+)[^)]*\)"), F.lit(1))
        return F.concat(wiki, F.transform(mark, F.url_decode))

    return F.array_distinct(F.transform(let(without_code(text), found), lambda x: F.trim(x)))


def tags(text: Column) -> Column:
    """Of front matter `tags` and `tag`, then inline ones with a character that is no digit."""
    listed = let(front_fields(text), lambda own: F.concat(*[F.coalesce(F.try_element_at(own, F.lit(k)), F.array().cast("array<string>")) for k in ("tags", "tag")]))
    spread = F.flatten(F.transform(listed, lambda t: F.split(t, r"[,\s]+")))
    front = F.filter(F.transform(spread, lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "")
    inline = F.regexp_extract_all(without_code(body(text)), F.lit(rf"(?:^|(?<=[\s(,;]))#({TAG})"), F.lit(1))
    return F.array_distinct(F.concat(front, inline))


def tasks(text: Column) -> Column:
    """array<struct<line, status, text, indent>>. A fence closes on its own character, at least as long as it opened."""
    start = F.struct(F.lit(0).alias("line"), F.lit("").alias("fence"), F.array().cast("array<struct<line:int,status:string,text:string,indent:int>>").alias("found"))

    pattern = r"^(\s*)(?:[-*+]|\d+[.)])\s+\[(.)\]\s+(.*)$"

    def step(acc: Column, raw: Column) -> Column:
        def of_line(line: Column, fence: Column) -> Column:
            closes = (acc["fence"] != "") & F.startswith(fence, acc["fence"]) & line.rlike(r"^\s*(`{3,}|~{3,})\s*$")
            state = F.when(closes, "").when((acc["fence"] == "") & (fence != ""), fence).otherwise(acc["fence"])
            task = F.struct(acc["line"].alias("line"), F.regexp_extract(line, pattern, 2).alias("status"), F.rtrim(F.regexp_extract(line, pattern, 3)).alias("text"), F.length(F.regexp_extract(line, pattern, 1)).alias("indent"))
            found = F.when((acc["fence"] == "") & (fence == "") & line.rlike(pattern), F.concat(acc["found"], F.array(task))).otherwise(acc["found"])
            return F.struct((acc["line"] + 1).alias("line"), state.alias("fence"), found.alias("found"))

        return let(F.replace(raw, F.lit("\t"), F.lit("    ")), lambda line: let(F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1), lambda fence: of_line(line, fence)))

    return F.aggregate(F.split(text, r"\r?\n"), start, step)["found"]


def task_date(text: Column, kind: str) -> Column:
    """Of `[due:: …]`, else of its mark."""
    inline = F.regexp_extract(text, rf"[\[(]{kind}::\s*(\d{{4}}-\d\d-\d\d)", 1)
    marked = F.regexp_extract(text, TASK_DATES[kind] + r"\s*(\d{4}-\d\d-\d\d)", 1)
    return F.when(inline != "", inline).otherwise(marked).try_cast("date")


def note_table(files: DataFrame) -> DataFrame:
    """path, folder, stem, mtime, size, links, tags, fields, tasks of the notes among files; texts stay behind."""
    t = F.col("text")
    return files.where("is_note").select("path", "folder", "stem", "mtime", "size", links(t).alias("links"), tags(t).alias("tags"), fields(t).alias("fields"), tasks(t).alias("tasks"))


def file_fields(notes: DataFrame) -> DataFrame:
    """name, path, folder, ext, link, mtime, ctime, mday, cday, size, tags, etags, day, frontmatter of a table of notes: what a query sees of a file.

    A table without ctime has mtime in its place. day is the first ISO date of the name.
    """
    ctime = F.col("ctime") if "ctime" in notes.columns else F.col("mtime")
    marked = F.transform("tags", lambda t: F.concat(F.lit("#"), t))
    return notes.select(
        F.col("stem").alias("name"), "path", "folder", F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"), link(F.col("path"), F.col("stem")).alias("link"), "mtime", ctime.alias("ctime"), F.date_trunc("day", "mtime").alias("mday"),
        F.date_trunc("day", ctime).alias("cday"), "size", marked.alias("tags"), marked.alias("etags"), link_date(F.col("stem")).alias("day"), F.col("fields").alias("frontmatter"),
    )


def task_table(notes: DataFrame) -> DataFrame:
    """path, k, line, status, text, indent, completed, checked, fully_completed (with all below it), dates, parent_k, children (their k), tags and outlinks of every task.

    The tasks of a note are one array, so nothing is shuffled.
    """
    # Outer, as Spark would else test the array first, by reading the text once more ahead of any shuffle.
    rows = notes.select("path", "tasks", F.posexplode_outer("tasks").alias("k", "t")).where("k is not null").select("path", "tasks", "k", "t.*")
    before = F.transform(F.slice("tasks", F.lit(1), F.col("k")), lambda t, i: F.struct(i.alias("k"), t["indent"].alias("indent")))
    above = F.filter(before, lambda x: x["indent"] < F.col("indent"))
    parent = F.when(F.size(above) > 0, F.element_at(above, -1)["k"])
    after = F.slice("tasks", F.col("k") + 2, F.size("tasks"))
    # Those below it are the deeper ones up to the first that is not.
    start = F.struct(F.lit(True).alias("inside"), F.lit(True).alias("done"))
    step = lambda acc, t: F.struct((acc["inside"] & (t["indent"] > F.col("indent"))).alias("inside"), (acc["done"] & (~(acc["inside"] & (t["indent"] > F.col("indent"))) | (F.lower(t["status"]) == "x"))).alias("done"))
    # Children are those below it that are no deeper than the first of them.
    level = F.get(after, F.lit(0))["indent"]
    kin = lambda acc, t: F.struct((acc["inside"] & (t["indent"] > F.col("indent"))).alias("inside"), (acc["k"] + 1).alias("k"), F.when(acc["inside"] & (t["indent"] > F.col("indent")) & (t["indent"] <= level), F.concat(acc["found"], F.array(acc["k"]))).otherwise(acc["found"]).alias("found"))
    children = F.aggregate(after, F.struct(F.lit(True).alias("inside"), (F.col("k") + 1).alias("k"), F.array().cast("array<int>").alias("found")), kin)["found"]
    own_tags = F.transform(F.regexp_extract_all("text", F.lit(rf"(?:^|(?<=[\s(,;]))#({TAG})"), F.lit(1)), lambda t: F.concat(F.lit("#"), t))
    out = F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]\n|#]+)[^\[\]\n]*\]\]"), F.lit(1))
    completed = F.lower("status") == "x"
    below = F.aggregate(after, start, step)["done"]
    return rows.withColumns({"parent_k": parent, "completed": completed, "checked": F.col("status") != " ", "children": children, "tags": own_tags, "outlinks": out, "fully_completed": completed & below, **{k: task_date(F.col("text"), k) for k in TASK_DATES}}).drop("tasks")


def suffix_index(files: DataFrame) -> DataFrame:
    """at, dst: every ending of a lower-case path that begins at a folder, with the one file that a link of that ending leads to: the shortest path, the first of equals.

    Of a name that very many folders hold one row is left, before any link meets it: files are compared where they are read, ahead of the shuffle.
    """
    steps = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, i, F.size(steps)), "/"))
    return files.select("path", F.explode(ends).alias("at")).groupBy("at").agg(F.min_by("path", F.struct(F.length("path"), F.col("path"))).alias("dst"))


def resolved(notes: DataFrame, files: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """src, dst, ord: where raw links lead. As written from the note's folder, then from the root, each also with .md; else the shortest path
    that ends in the link, in any case, or in the link with .md. Of equal ones the ending as written counts first, then the path's order.

    Each (folder, link) is resolved once and joined back. All joins are equality joins with distinct paths or with suffix_index(files), which
    may be handed in where it is stored: a link meets one file by each of its ways, however many files share its name.
    """
    raw = notes.select(F.col("path").alias("src"), "folder", F.posexplode_outer("links").alias("ord", "raw")).where("ord is not null")
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace("raw", r"\+", "%2B")), F.col("raw"))
    name = F.trim(F.translate(decoded, "\\", "/"))
    own = raw.select("folder", "raw").distinct().withColumn("clean", normal_path(name)).where("clean <> ''")
    near = normal_path(F.concat_ws("/", F.col("folder"), name))
    tries = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("at")) for i, c in enumerate((near, F.concat(near, F.lit(".md")), F.col("clean"), F.concat("clean", F.lit(".md"))))])
    known = files.select(F.col("path").alias("dst"), F.col("path").alias("at"))
    exact = own.select("folder", "raw", F.explode(tries).alias("t")).select("folder", "raw", "t.prio", "t.at").join(known, "at").groupBy("folder", "raw").agg(F.min_by("dst", "prio").alias("dst"))
    left = own.join(exact, ["folder", "raw"], "left_anti")
    endings = F.array(*[F.struct(F.lit(i).alias("prio"), c.alias("at")) for i, c in enumerate((F.lower("clean"), F.concat(F.lower("clean"), F.lit(".md"))))])
    wanted = left.select("clean").distinct().select("clean", F.explode(endings).alias("t")).select("clean", "t.prio", "t.at")
    named = wanted.join(suffixes if suffixes is not None else suffix_index(files), "at").groupBy("clean").agg(F.min_by("dst", F.struct(F.length("dst"), F.col("prio"))).alias("dst"))
    best = exact.unionByName(left.join(named, "clean").select("folder", "raw", "dst"))
    found = raw.join(best, ["folder", "raw"]).select("src", "dst", "ord")
    return found.where(F.col("src") != F.col("dst")).where(F.lower("dst").rlike(r"\.(md|markdown)$")).groupBy("src", "dst").agg(F.min("ord").alias("ord"))


def headings(text: Column) -> Column:
    """array<struct<line, level, title>> outside fences."""
    start = F.struct(F.lit(0).alias("line"), F.lit("").alias("fence"), F.array().cast("array<struct<line:int,level:int,title:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        def fenced(fence: Column) -> Column:
            state = F.when((acc["fence"] != "") & (fence != "") & F.startswith(fence, acc["fence"]), "").when((acc["fence"] == "") & (fence != ""), fence).otherwise(acc["fence"])
            hit = (acc["fence"] == "") & line.rlike(r"^#{1,6}\s+\S")
            one = F.struct(acc["line"].alias("line"), F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(line, r"^#+\s+(.*?)\s*#*\s*$", 1)).alias("title"))
            return F.struct((acc["line"] + 1).alias("line"), state.alias("fence"), F.when(hit, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

        return let(F.regexp_extract(line, r"^\s*(`{3,}|~{3,})", 1), fenced)

    return F.aggregate(F.split(text, r"\r?\n"), start, step)["found"]


def section(text: Column, title: str) -> Column:
    """From a heading to the next of the same or a higher level, null without it; of `^id` the line with that mark, without it, else the whole text."""
    if title.startswith("^"):
        mark = r"\s\^" + re.escape(title[1:]) + r"\s*$"
        line = F.get(F.filter(F.split(text, "\n"), lambda x: x.rlike(mark)), F.lit(0))
        return F.coalesce(F.regexp_replace(line, r"\s\^[\w-]+\s*$", ""), text)
    lines = F.split(text, r"\r?\n")

    def of(all_: Column) -> Column:
        def upto(own: Column) -> Column:
            after = F.get(F.filter(all_, lambda h: (h["line"] > own["line"]) & (h["level"] <= own["level"])), F.lit(0))
            cut = lambda rows: F.array_join(F.slice(rows, own["line"] + 1, F.coalesce(after["line"], F.size(rows)) - own["line"]), "\n")
            return F.when(own.isNotNull(), let(lines, cut))

        return let(F.get(F.filter(all_, lambda h: F.lower(h["title"]) == title.lower()), F.lit(0)), upto)

    return let(headings(text), of)


def board(text: Column) -> Column:
    """array<struct<lane, done, text, status>>: cards under the lane headings of a board note; `**Complete**` marks lanes of finished cards."""
    start = F.struct(F.lit("").alias("lane"), F.lit(False).alias("done"), F.array().cast("array<struct<lane:string,done:boolean,text:string,status:string>>").alias("cards"))

    def step(acc: Column, line: Column) -> Column:
        lane, mark = F.regexp_extract(line, r"^##\s+(.*?)\s*$", 1), F.trim(line) == "**Complete**"
        pattern = r"^[-*+]\s+\[(.)\]\s+(.*)$"
        one = F.struct(acc["lane"].alias("lane"), acc["done"].alias("done"), F.regexp_extract(line, pattern, 2).alias("text"), F.regexp_extract(line, pattern, 1).alias("status"))
        cards = F.when((acc["lane"] != "") & line.rlike(pattern), F.concat(acc["cards"], F.array(one))).otherwise(acc["cards"])
        return F.struct(F.when(lane != "", lane).otherwise(acc["lane"]).alias("lane"), F.when(lane != "", False).otherwise(acc["done"] | mark).alias("done"), cards.alias("cards"))

    return F.aggregate(F.split(F.split_part(body(text), F.lit("\n***"), F.lit(1)), r"\r?\n"), start, step)["cards"]


CANVAS = "struct<nodes:array<struct<id:string,type:string,x:double,y:double,width:double,height:double,text:string,file:string,url:string,label:string>>,edges:array<struct<id:string,fromNode:string,toNode:string,label:string>>>"


def canvas(text: Column) -> Column:
    """Nodes and edges of an open JSON canvas."""
    return F.from_json(text, CANVAS)


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
