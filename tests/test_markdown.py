import os

import pytest

from weftgraph.sources import frontmatter, markdown
from weftgraph.streaming.watch import Watch, listing, start


def write(root, files):
    for p, t in files.items():
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(t)


def test_frontmatter():
    assert frontmatter.parse('a: "x\\\\y \\"q\\" \\n#"  # c\nb: [1e3, TRUE, "a, \\"b"] # c\nc: NULL\nd: a#b') == {"a": 'x\\y "q" \n#', "b": [1000.0, True, 'a, "b'], "c": None, "d": "a#b"}
    head, body = frontmatter.split("---\ntitle: 'A # b'  # note\ntags: [x, 'y, z']\nup:\n  - [[Up]]\nm: {k: 1, v: 2.5}\nn: ~\nlist:\n- a: 1\n  b: true\n- two\n---\nbody\n")
    assert body == "body\n"
    assert frontmatter.parse(head) == {"title": "A # b", "tags": ["x", "y, z"], "up": ["[[Up]]"], "m": {"k": 1, "v": 2.5}, "n": None, "list": [{"a": 1, "b": True}, "two"]}
    assert frontmatter.split("---\nnever closed\n") == (None, "---\nnever closed\n")
    with pytest.raises(frontmatter.FrontMatterError):
        frontmatter.parse("a:\n\tb: 1")
    d = markdown.parse_document("/r", "x.md", b"---\na:\n\tb\n---\nbody")
    assert not d["has_frontmatter"] and d["title"] == "x"


def test_extraction():
    body = "# One #\n\n## One\n### Two\ntext #tag and (#a/b) no#tag # x\n[[t|a]] [x](y.md) [f](#frag) [[t|a]]\n"
    assert markdown.headings(body) == ["One", "Two"]
    assert markdown.inline_tags(body) == ["tag", "a/b", "frag"]
    assert markdown.body_links(body) == ["t|a", "y.md"]
    assert markdown.style_key("/en-US/docs/Web/Index.md") == "web" or markdown.style_key("/en-US/docs/Web/index.md") == "web"


def edges(v):
    names = {r["id"]: r["path"] for r in v.docs.select("id", "path").collect()}
    names |= {r["id"]: "dir:" + r["path"] for r in v.dirs.select("id", "path").collect()} if v.dirs is not None else {}
    return {(names[r["src"]], r["type"], names[r["dst"]]) for r in v.edges.collect()}


def test_links(spark, tmp_path):
    root = str(tmp_path / "v")
    write(root, {
        "source.md": "[[target-one]] [[Missing Note]] [x](target-two.md) [[target-one]] [[Nick]] [[Shared]] [[guide]] [[SUB/DEEP]] [[/docs/sub/deep.md]]",
        "target-one.md": "---\naliases: [Nick]\n---\n", "target-two.md": "---\naliases: [Shared]\nup: [[source]]\nrelated: [target-one, Nick]\n---\n[[source]]", "third.md": "---\naliases: [Shared]\n---\n",
        "guide/index.md": "x", "sub/deep.mdx": "[[../source]]",
    })
    v = markdown.Vault(spark)
    report = v.sync(root)
    assert report["scanned"] == report["created"] == 6 and report["unresolved"] == 2
    assert edges(v) == {
        ("source.md", "MD_LINKS_TO", "target-one.md"), ("source.md", "MD_LINKS_TO", "target-two.md"), ("source.md", "MD_LINKS_TO", "guide/index.md"), ("source.md", "MD_LINKS_TO", "sub/deep.mdx"),
        ("target-two.md", "MD_UP", "source.md"), ("target-two.md", "MD_LINKS_TO", "source.md"), ("target-two.md", "MD_RELATED", "target-one.md"), ("target-two.md", "MD_LINKS_TO", "target-one.md"),
        ("sub/deep.mdx", "MD_LINKS_TO", "source.md"),
    }
    row = v.edges.where("array_contains(link_rels, 'up') AND type = 'MD_LINKS_TO'").first()
    assert row["link_sources"] == ["body", "frontmatter"]


def test_sync_tombstones_and_directories(spark, tmp_path):
    root = str(tmp_path / "v")
    write(root, {"stable.md": "[[removed]]", "a/changed.md": "one", "removed.md": "[[stable]]"})
    v = markdown.Vault(spark)
    v.sync(root, directory_graph=True)
    ids = {r["path"]: r["id"] for r in v.docs.collect()}
    assert ("a/changed.md", "MD_IN_DIRECTORY", "dir:a") in edges(v) and ("dir:a", "MD_PARENT_DIRECTORY", "dir:.") in edges(v)
    os.remove(f"{root}/removed.md")
    write(root, {"a/changed.md": "two", "added.md": "[[stable]]"})
    report = v.sync(root, directory_graph=True)
    assert (report["created"], report["updated"], report["tombstoned"]) == (1, 1, 1)
    now = {r["path"]: (r["id"], r["status"]) for r in v.docs.collect()}
    assert now["removed.md"] == (ids["removed.md"], "missing") and now["stable.md"] == (ids["stable.md"], "current")
    assert not any(a == "removed.md" or b == "removed.md" for a, t, b in edges(v) if t == "MD_LINKS_TO")


def test_empty_directory(spark, tmp_path):
    os.makedirs(tmp_path / "e")
    v = markdown.Vault(spark)
    assert v.sync(str(tmp_path / "e"))["scanned"] == 0 and v.docs.count() == 0


def test_watch_debounces():
    t, files, runs = [0.0], [{"a": (1, 1)}], []
    w = Watch(lambda: files[0], lambda: runs.append(1) or {}, clock=lambda: t[0])
    w.tick()
    assert len(runs) == 1 and w.tick() is None
    files[0] = {"a": (2, 2)}
    for _ in range(3):
        t[0] += 0.05
        w.tick()
    assert len(runs) == 1
    t[0] += 0.3
    w.tick()
    assert len(runs) == 2
    for k in range(40):  # never quiet: the window ends it
        files[0] = {"a": (3, k)}
        t[0] += 0.1
        w.tick()
    assert len(runs) >= 3


def test_watch_stream(spark, tmp_path):
    root = str(tmp_path / "w")
    write(root, {"a.md": "x"})
    assert listing(spark, f"file://{root}")[0] == 1
    v = markdown.Vault(spark)
    q = start(spark, f"file://{root}", lambda: v.sync(root), max_runs=1)
    q.awaitTermination(60)
    q.stop()
    assert v.docs.count() == 1
