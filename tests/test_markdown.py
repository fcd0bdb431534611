from datetime import date

from pyspark.sql import functions as F

from quillstone.operators import edits as E
from quillstone.sources import markdown as M

ALPHA = """---
owner: Son
tags: [work, Deep/Sub]
people:
  - Ann
  - "Bo"
---
# Alpha
rank:: 7
See [[Beta|the other]] and [[sub/Gamma#Part]] and [there](sub/Gamma.md) and [out](https://x.y) #open #12 `#code`
- [ ] first [due:: 2026-01-02]
    - [x] nested ✅ 2026-01-03
```
- [ ] in code [[Nope]]
```
## Part
text
# End
"""


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "Alpha.md").write_text(ALPHA)
    (tmp_path / "Beta.md").write_text("[[Alpha]] [[Missing]] [[Beta]]\n")
    (tmp_path / "sub" / "Gamma.md").write_text("[[../Beta]] [[Delta]]")
    (tmp_path / "sub" / "Delta.md").write_text("\n")
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "pic.png").write_text("no note")
    return str(tmp_path)


def test_notes_of_a_folder(spark, tmp_path):
    files = M.read_folder(spark, folder(tmp_path)).cache()
    assert {r.path for r in files.collect()} == {"Alpha.md", "Beta.md", "sub/Gamma.md", "sub/Delta.md", "pic.png"}
    notes = M.note_table(files)
    a = notes.where("stem = 'Alpha'").first()
    assert a.links == ["Beta", "sub/Gamma", "sub/Gamma.md"]
    assert a.tags == ["work", "Deep/Sub", "open"]
    assert a.fields == {"owner": ["Son"], "tags": ["work", "Deep/Sub"], "people": ["Ann", "Bo"], "rank": ["7"], "due": ["2026-01-02"]}
    edges = {(r.src, r.dst) for r in M.resolved(notes, files).collect()}
    assert edges == {("Alpha.md", "Beta.md"), ("Alpha.md", "sub/Gamma.md"), ("Beta.md", "Alpha.md"), ("sub/Gamma.md", "Beta.md"), ("sub/Gamma.md", "sub/Delta.md")}
    t = {r.k: r for r in M.task_table(notes).collect()}
    assert [(t[k].text.split()[0], t[k].status, t[k].parent_k) for k in sorted(t)] == [("first", " ", None), ("nested", "x", 0)]
    assert not t[0].fully_completed and t[1].fully_completed
    assert t[0].due == date(2026, 1, 2) and t[1].completion == date(2026, 1, 3) and t[1].due is None
    section = files.where("stem = 'Alpha'").select(M.section(F.col("text"), "part").alias("s")).first().s
    assert section == "## Part\ntext"


def test_board_and_canvas(spark):
    text = "## To do\n- [ ] one\n## Done\n**Complete**\n- [x] two\n***\n## Archive\n- [x] old"
    cards = spark.createDataFrame([(text,)], "text string").select(M.board(F.col("text")).alias("b")).first().b
    assert [(c.lane, c.done, c.text) for c in cards] == [("To do", False, "one"), ("Done", True, "two")]
    c = spark.createDataFrame([('{"nodes":[{"id":"a","type":"text","x":1,"odd":2}],"edges":[]}',)], "text string").select(M.canvas(F.col("text")).alias("c")).first().c
    assert c.nodes[0].id == "a" and c.edges == []


def edit(spark, text, e):
    return spark.createDataFrame([(text,)], "text string").select(e(F.col("text")).alias("r")).first().r


def test_edits(spark):
    assert edit(spark, "a b c", lambda t: E.replaced_once(t, "b", "x")) == "a x c"
    assert edit(spark, "b b", lambda t: E.replaced_once(t, "b", "x")) is None
    assert edit(spark, "- [ ] do it\n", lambda t: E.task_set(t, 0, "do it", "x")) == "- [x] do it\n"
    assert edit(spark, "- [ ] do it\n", lambda t: E.task_set(t, 0, "other", "x")) is None
    assert edit(spark, "---\na: 1\n---\nhi", lambda t: E.property_set(t, "b", "2")) == "---\na: 1\nb: 2\n---\nhi"
    assert edit(spark, "---\na: 1\n---\nhi", lambda t: E.property_set(t, "a", "3")) == "---\na: 3\n---\nhi"
    assert edit(spark, "---\na: 1\n---\nhi", lambda t: E.property_set(t, "a", None)) == "hi"
    assert edit(spark, "hi", lambda t: E.property_set(t, "a", "1")) == "---\na: 1\n---\nhi"
    assert edit(spark, "[[Old|x]] [[Older]]", lambda t: E.links_renamed(t, "old", "New")) == "[[New|x]] [[Older]]"
    assert edit(spark, "a\n\n", lambda t: E.appended(t, "b")) == "a\nb\n"


def test_catalog_refresh_equals_fresh_read(spark, tmp_path):
    from quillstone.sources.catalog import Catalog, by_kind

    root = tmp_path / "vault"
    root.mkdir()
    path = folder(root)
    catalog = Catalog(spark, str(tmp_path / "tables"))
    assert {r.op for r in catalog.refresh(path).collect()} == {"new"}
    (root / "Beta.md").write_text("[[sub/Delta]] #changed now\n")
    (root / "New.md").write_text("hello [[Alpha]]")
    (root / "sub" / "Gamma.md").unlink()
    assert {(r.path, r.op) for r in catalog.refresh(path).collect()} == {("Beta.md", "edited"), ("New.md", "new"), ("sub/Gamma.md", "deleted")}
    fresh = M.note_table(M.read_folder(spark, path))
    key = lambda df: sorted((r.path, tuple(r.links), tuple(r.tags)) for r in df.collect())
    assert key(catalog.notes()) == key(fresh)
    assert {(r.kind, r.n) for r in by_kind(M.read_folder(spark, path)).collect()} == {("note", 4), ("image", 1)}


def test_block_references_and_paths_up(spark):
    text = "# A\nfirst line ^one\nsecond ^two-x \n"
    got = spark.range(1).select(M.section(F.lit(text), "^two-x").alias("a"), M.section(F.lit(text), "^none").alias("b")).first()
    assert got.a == "second" and got.b == text
    files = spark.createDataFrame([("a/b/c/n.md", "a/b/c", ["../../x.md", "./y"]), ("a/x.md", "a", []), ("a/b/c/y.md", "a/b/c", []), ("x.md", "", [])], "path string, folder string, links array<string>")
    assert sorted((r.src, r.dst) for r in M.resolved(files, files).collect()) == [("a/b/c/n.md", "a/b/c/y.md"), ("a/b/c/n.md", "a/x.md")]


def plain_resolve(raw, folder, paths):
    """The first of: from the folder, from the root, each also with .md; else the shortest path that ends in the link."""
    import posixpath
    from urllib.parse import unquote

    name = unquote(raw).replace("\\", "/").strip()
    near, root = (posixpath.normpath(x).lstrip("/") for x in (f"{folder}/{name}", name))
    while root.startswith("../"):
        root = root[3:]
    for t in (near, near + ".md", root, root + ".md"):
        if t in paths:
            return t
    low = root.lower()
    found = [(len(p), k, p) for p in paths for k, e in enumerate((low, low + ".md")) if ("/" + p.lower()).endswith("/" + e)]
    return min(found)[2] if found else None


def test_links_by_path_suffix_match_a_plain_resolver(spark):
    paths = ["a/n.md", "b/n.md", "b/c/n.md", "N.md", "deep/a/n.md", "a/pic.png", "z/pic.png.md", "x/y/one two.md", "one.md.md", "q/one.md", "top.md", "a/b/top.md", "A/Top.md", "zz/n", "m/ä.md", "k/l+m.md"]
    raws = ["n", "N", "a/n", "A/N.md", "c/n", "../n", "./n", "pic.png", "one two", "one%20two", "ONE", "one.md", "top", "b/top", "b\\top", "nothing", " n ", "Ä", "l+m", "../../x/y/one two", "deep/a/n", "eep/a/n", "%", "."]
    folders = ["", "a", "b/c", "x/y", "none"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    notes = spark.createDataFrame([(f"{f}/src{i}.md", f, [r]) for f in folders for i, r in enumerate(raws)], "path string, folder string, links array<string>")
    want = {(f"{f}/src{i}.md", d) for f in folders for i, r in enumerate(raws) if (d := plain_resolve(r, f, paths)) and d.endswith(".md")}
    for suffixes in (None, M.suffix_index(files).cache()):
        assert {(r.src, r.dst) for r in M.resolved(notes, files, suffixes).collect()} == want


def test_a_name_in_very_many_folders_meets_a_link_once(spark):
    """Rows that joins make: one for each link and way, not one for each file of the name."""
    files = spark.range(100_000).select(F.concat(F.lit("folder"), "id", F.lit("/readme.md")).alias("path"))
    notes = spark.createDataFrame([(f"n{i}.md", "", ["README", "folder77/readme", "readme.md"]) for i in range(50)], "path string, folder string, links array<string>")
    done = M.resolved(notes, files)
    assert {(r.dst, r.n) for r in done.groupBy("dst").agg(F.count("*").alias("n")).collect()} == {("folder0/readme.md", 50), ("folder77/readme.md", 50)}
    assert M.suffix_index(files).where("at = 'readme.md'").count() == 1
    rows = M.resolved(notes, files)
    rows.collect()
    plan, made = [rows._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
        more = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        plan += more + [children.apply(i) for i in range(children.size())]
    assert made and max(made) <= 150
