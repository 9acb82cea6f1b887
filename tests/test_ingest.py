"""Files to pages, pages to chunks, packs and the index on disk."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import parsing
from lexloom.functions.text import packed_chunks, split_bounded
from lexloom.operators import index, ingest, packfiles, packs
from lexloom.sources import files, snapshots
from lexloom.streaming.answers import ingest_stream

FILES = "path string, content string"


def parsed(spark, *files, **options):
    rows = ingest.parse_pages(spark.createDataFrame(list(files), FILES), "https://d.example/", **options)
    return {r["path"]: r.asDict(recursive=True) for r in rows.collect()}


def test_markdown_with_front_matter(spark):
    source = "---\ntitle: 'Own name'\nslug: /guide/start\ntitle: other\n---\n# Head\nuse `os.path` and `x`\n{{macro}}\n\n```py\nimport a_b\n```\n##### five\n```\nlost"
    got = parsed(spark, ("a/my-file.md", source))["a/my-file.md"]
    assert got["title"] == "Own name" and got["canonical_url"] == "https://d.example/guide/start" and got["symbols"] == ["a_b", "os.path"]
    assert got["sections"] == [{"heading": "Head", "anchor": "head", "text": "use `os.path` and `x`\n##### five", "code": ["import a_b"]}]
    alone = parsed(spark, ("a/my-file.md", "# One\n{{kept}}\n#### no head\n## Two\nx"), standalone=True)["a/my-file.md"]
    assert [s["heading"] for s in alone["sections"]] == ["One", "Two"] and alone["title"] == "One" and alone["symbols"] == []
    assert alone["sections"][0]["text"] == "{{kept}}\n#### no head"


def test_plain_text_and_dispatch(spark):
    got = parsed(spark, ("n_1-x.txt", " a \n b\n\nc"), ("empty.txt", " \n"), ("h.HTM", "<p>x"), ("odd.bin", "q"))
    assert [(s["anchor"], s["text"]) for s in got["n_1-x.txt"]["sections"]] == [("n-1-x", "a\nb"), ("top", "c")]
    assert got["h.HTM"]["sections"][0]["text"] == "x" and "empty.txt" not in got and "odd.bin" in got
    with pytest.raises(Exception, match="leaves its folder"):
        parsed(spark, ("../x.md", "# a"))


def test_html_sections(spark):
    source = "<title> T <b>x</b></title><nav><li>n<p>in</p></nav><h2 id='groups'>G</h2><p>a<b>b</b>c<p>d<pre>x = <code>os.path</code>\n</pre><h3>Last one</h3><td>e<td>f<h4> </h4>"
    got = parsed(spark, ("p.html", source))["p.html"]
    assert got["title"] == "T x" and got["symbols"] == ["os.path"]
    assert [(s["heading"], s["anchor"], s["text"], s["code"]) for s in got["sections"]] == [("T x", "top", "n in\nin", []), ("G", "groups", "a b c\nd", ["x = os.path"]), ("Last one", "last-one", "e\nf", [])]
    assert parsing.html("a/b_c.html", "", "<h1></h1><p>x")["title"] == "b c"


def plain_split(text):
    parts, start = [], 0
    while start < len(text):
        end = min(start + 5200, len(text))
        if end < len(text):
            back = end
            while back > start + 2600 and text[back - 1] not in "\n.;}":
                back -= 1
            end = back if back > start + 2600 else end
        parts.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - 160
    return parts if len(text) > 5200 else [text] if text else []


def split(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(split_bounded(F.col("t"))).first()[0]


def plain_chunks(title, sections):
    """(label, anchor, text) of a page's chunks, one section after the other."""
    out, held, heads, anchor = [], "", [], "top"
    for s in sections:
        for part in plain_split(s["text"] + "".join(f"\n\nCODE:\n{c}" for c in s["code"])):
            if held and len(held) + len(s["heading"]) + 1 + len(part) + 2 > 5200:
                out.append((" \u00b7 ".join(heads[:6]), anchor, held.strip()))
                held, heads = "", []
            anchor = anchor if held else s["anchor"]
            if not heads or heads[-1] != s["heading"]:
                heads.append(s["heading"])
                held += s["heading"] + "\n"
            held += part + "\n\n"
    return out + ([(" \u00b7 ".join(heads[:6]), anchor, held.strip())] if held.strip() else [])


def test_packed_chunks(spark):
    r = random.Random(2)
    pages = []
    for k in range(40):
        sections = [{"heading": f"h{r.randrange(3)}", "anchor": f"a{j}", "text": "word. " * r.randrange(r.choice([3, 300, 2500])), "code": ["c" * r.randrange(r.choice([2, 3000]))] * r.randrange(3)} for j in range(r.randrange(12))]
        pages.append((k, sections))
    rows = spark.createDataFrame(pages, f"k int, sections {ingest.SECTIONS}").select("k", packed_chunks(F.col("sections")).alias("c"))
    got = {x["k"]: [tuple(c) for c in x["c"]] for x in rows.collect()}
    assert got == {k: plain_chunks("t", s) for k, s in pages}


def test_plain_pages_without_python(spark):
    texts = ["a\n\nb", "a\n\nb\n", "a\n\nb\n\n", "a\n \n", "", "\n\n", " x \r\n y\r\n\r\nz", "\u00a0\n\u2003q", None]
    files = spark.createDataFrame([(f"d/n_{k}-x.txt", t) for k, t in enumerate(texts)] + [("noext", "t"), (".hid", "t")], FILES)
    both = [{r["path"]: r.asDict(recursive=True) for r in f(files, "https://d").collect()} for f in (ingest.plain_pages, ingest.parse_pages)]
    assert both[0] == both[1] and len(both[0]) == 8
    assert "Python" not in ingest.plain_pages(files, "b")._jdf.queryExecution().toString()


def test_chunks(spark):
    r = random.Random(1)
    for n in (0, 5200, 5201, 20_000):
        text = "".join(r.choice("abcdefgh .;\n") if r.random() < 0.2 else "x" for _ in range(n))
        assert split(spark, text) == plain_split(text)
    odd = ["y" * 12_000, "\U0001f600." * 9_000, "\u00a0x. " * 3_000, "x" * 5_199 + "}" + "z" * 5_200, "." * 10_400, None]
    assert [split(spark, t) for t in odd] == [plain_split(t or "") for t in odd]
    many = "".join(f"# H{k}\ntext {k}\n" for k in range(20))
    pages = ingest.parse_pages(spark.createDataFrame([("python", "3", "m.md", many), ("x", "local-a", "m.md", "word. " * 3000)], f"docset string, version string, {FILES}"), "b", keep=("docset", "version"))
    rows = ingest.index_rows(ingest.chunk_pages(pages)).collect()
    one = [x for x in rows if x["stem"] == "python"]
    assert len(one) == 1 and "H19" in one[0]["text"] and one[0]["section"] == " · ".join(f"H{k}" for k in range(6)) and one[0]["url"] == "docs://python/m.md#h0"
    assert len({x["id"] for x in rows}) == len(rows) > 3 and {x["stem"] for x in rows} == {"python", "local-a"} and all(len(x["text"]) <= 5210 for x in rows)


def test_tree_and_assets(spark, tmp_path):
    for name in ("library/__main__.html", "_static/x.html", "sub/_static/y.html", "z.png", "a.MD"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("veda")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.MD")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "sub.html").write_text("veda")
    got = [(r["path"], r["content"]) for r in ingest.read_tree(spark, f"file://{tmp_path}", 2).orderBy("place").collect()]
    assert got == [(x, "veda") for x in ("a.MD", "library/__main__.html", "sub/_static/y.html", "sub.html")]  # as a walk through sorted folders
    held = spark.createDataFrame([("a", b"four"), ("b", b"four"), ("c", b"four")], "name string, content binary")
    right = hashlib.sha256(b"four").hexdigest().upper()
    catalog = spark.createDataFrame([("a", 4, right), ("b", 5, right), ("c", 4, "00"), ("d", 1, "00")], "name string, bytes bigint, sha256 string")
    assert {r["name"]: r["status"] for r in ingest.verify_assets(held, catalog).collect()} == {"a": "ok", "b": "size", "c": "checksum", "d": "missing"}


def test_packs_and_index(spark, tmp_path):
    made = spark.createDataFrame([("p", 1, 1), ("q", 1, 1)], "pack_key string, schema_version int, page_count bigint")
    pages = spark.createDataFrame([("p", "a.md", ["s"]), ("q", "b.md", [])], "pack_key string, path string, symbols array<string>")
    packs.write_pack(made, pages, str(tmp_path / "packs"))
    packs.write_pack(made.filter("pack_key = 'q'"), pages.filter("pack_key = 'q'"), str(tmp_path / "packs"))
    assert packs.read_pack(spark, str(tmp_path / "packs"))[1].count() == 2
    packs.write_pack(made.filter("pack_key = 'q'"), pages.filter("pack_key = 'q'").union(pages.filter("pack_key = 'q'")), str(tmp_path / "packs"))
    with pytest.raises(ValueError, match="page count"):
        packs.read_pack(spark, str(tmp_path / "packs"))
    # an official pack in a wrong version, a ready one, and a local one
    assert packs.expected(spark).count() == 5


INDEXED = "stem string, path string, chunk_id bigint, docset string, indexed string"


def asking(spark, folder, text, **options):
    asked = spark.createDataFrame([(1, text), (1, text), (2, "nothing here"), (3, ""), (4, None)], "query_id bigint, question string")
    return [(r["chunk_id"], r["score"]) for r in index.search_index(index.load_index(spark, folder, options.pop("version", None)), asked, **options).orderBy("rank").collect()]


def test_index_on_disk(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert asking(spark, folder, "alpha") == [] and index.load_index(spark, folder).stems == []
    rows = spark.createDataFrame([("python", "a", 1, "python", "std alpha alpha"), ("local-a", "b", 2, "local", "alpha beta"), ("local-a", "c", 3, "local", "gamma"), ("007", "d", 4, "local", "")], INDEXED)
    index.write_index(rows, folder)
    every = asking(spark, folder, "alpha")
    assert [x[0] for x in every] == [1, 2] and index.load_index(spark, folder).n == 4
    assert asking(spark, folder, "alpha", docsets=["local"]) == [every[1]]  # statistics stay those of all
    scopes = spark.createDataFrame([(1, ["python"])], "query_id bigint, docsets array<string>")
    assert asking(spark, folder, "alpha", scopes=scopes) == [every[0]]
    assert asking(spark, folder, "alpha", scopes=spark.createDataFrame([(1, [])], "query_id bigint, docsets array<string>")) == every
    assert index.load_index(spark, folder).stems == ["python", "007", "local-a"]
    # a stem written again is replaced, one without rows emptied; others stay
    index.write_index(spark.createDataFrame([("local-a", "b", 9, "local", "alpha")], INDEXED), folder, ["local-a", "007"])
    assert [x[0] for x in asking(spark, folder, "alpha gamma")] == [9, 1] and index.load_index(spark, folder).n == 2


def test_removal_and_failed_writes(spark, tmp_path, monkeypatch):
    folder, out = f"{tmp_path}/index", spark.createDataFrame([("local-a",), ("local-a-index",), ("python",)], "id string")
    rows = spark.createDataFrame([("python", "a", 1, "python", "alpha " * 50), ("local-a", "b", 2, "local", "alpha beta " * 50)], INDEXED)
    index.write_index(rows, folder)
    before, full = asking(spark, folder, "alpha"), files.size(spark, f"{folder}/segments")

    def fails(*_):
        raise OSError("disk is full")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", fails)
        with pytest.raises(OSError):
            index.write_index(rows.withColumn("indexed", F.lit("other")), folder)
    assert asking(spark, folder, "alpha") == before and asking(spark, folder, "other") == []
    assert files.size(spark, f"{folder}/segments") > full
    snapshots.vacuum(spark, folder)
    assert files.size(spark, f"{folder}/segments") == full
    # readers keep their version until its files go
    assert packs.remove_pack(spark, str(tmp_path), "local-a", out).count() == 1
    assert [x[0] for x in asking(spark, folder, "alpha")] == [1] and 0 < files.size(spark, f"{folder}/segments") < full
    assert index.load_index(spark, folder).stems == ["python"]


def test_merge_replay_and_compaction(spark, tmp_path):
    folder, whole = f"{tmp_path}/index", f"{tmp_path}/whole"
    frame = lambda rows: spark.createDataFrame([("s", p, c, "local", t) for p, c, t in rows], INDEXED)
    pages = lambda *paths: spark.createDataFrame([("s", p) for p in paths], "stem string, path string")
    assert index.merge_pages(frame([("a", 1, "alpha beta"), ("b", 2, "beta"), ("c", 3, "gamma")]), pages("a", "b", "c"), folder, "1")
    assert index.merge_pages(frame([("b", 2, "alpha delta delta"), ("d", 4, "beta")]), pages("b", "d"), folder, "2")
    assert not index.merge_pages(frame([("b", 2, "alpha delta delta"), ("d", 4, "beta")]), pages("b", "d"), folder, "2")  # a replay
    assert index.merge_pages(frame([]), pages("c", "none"), folder, "3")
    assert index.merge_pages(frame([("b", 2, "alpha delta")]), pages("b"), folder, "4")
    index.write_index(frame([("a", 1, "alpha beta"), ("b", 2, "alpha delta"), ("d", 4, "beta")]), whole)
    same = lambda: [(asking(spark, folder, t), asking(spark, whole, t)) for t in ("alpha", "beta", "gamma delta")]
    assert all(a == b for a, b in same()) and asking(spark, folder, "gamma") == []
    assert (index.load_index(spark, folder).n, index.load_index(spark, folder).average) == (3, 5 / 3)
    assert [x[0] for x in asking(spark, folder, "gamma", version=2)] == [3]  # an earlier version
    assert index.compact(spark, folder, most=9) == [] and index.compact(spark, folder, most=2) == ["s"]
    assert all(a == b for a, b in same()) and len(index.load_index(spark, folder).parts) == 1
    snapshots.vacuum(spark, folder)
    assert all(a == b for a, b in same()) and len(files.children(spark, f"{folder}/segments")) == 1


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    folder = f"{tmp_path}/index"
    index.write_index(spark.createDataFrame([("s", str(k), k, "local", f"word{k} other{k}") for k in range(200)], INDEXED), folder)
    now = index.load_index(spark, folder)
    bucket = spark.range(1).select(index.bucket_of(F.lit("word7"))).first()[0]
    read, every = now.postings([bucket]).inputFiles(), now.table("postings").inputFiles()
    assert asking(spark, folder, "word7")[0][0] == 7 and [x[0] for x in asking(spark, folder, " ".join(f"word{k}" for k in range(0, 250)))]
    assert all(f"bucket={bucket}/" in f for f in now.postings([bucket]).filter("term = 'word7'").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]) and len(every) > index.BUCKETS // 2
    assert now.postings([bucket]).count() < now.table("postings").count() / 8 and read


def test_pages_that_land(spark, tmp_path):
    """Three batches of two stems: both pages of a stem stay, a changed page replaces only itself, an empty one goes; a batch build is the same."""
    schema = f"docset string, version string, {FILES}"
    land = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "index"), "https://d", str(tmp_path / "c")).awaitTermination(120)
    land(("python", "3", "a.md", "# A\nalpha words"), ("css", "1", "b.md", "# B\nbeta"))
    run()
    land(("python", "3", "b.md", "# B\ngamma words only"), ("x", "local-n", "c.md", "gamma"))
    run()
    land(("python", "3", "a.md", "# A\ndelta"), ("css", "1", "b.md", ""))
    run()
    run()
    now = index.load_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "gamma"), (2, "alpha"), (3, "beta"), (4, "delta")], "query_id bigint, question string")
    found = lambda ix: sorted((r["query_id"], r["chunk_id"], r["score"]) for r in index.search_index(ix, asked).collect())
    assert [x[:2] for x in found(now)] == [(1, "local:local-n:c.md:0"), (1, "python:3:b.md:0"), (4, "python:3:a.md:0")] and now.n == 3
    final = spark.createDataFrame([("python", "3", "a.md", "# A\ndelta"), ("python", "3", "b.md", "# B\ngamma words only"), ("x", "local-n", "c.md", "gamma")], schema)
    rows = ingest.index_rows(ingest.chunk_pages(ingest.parse_pages(final, "https://d", keep=("docset", "version")))).withColumnsRenamed({"id": "chunk_id", "page_path": "path"})
    index.write_index(rows, str(tmp_path / "whole"))
    assert found(now) == found(index.load_index(spark, str(tmp_path / "whole")))


def test_library_ids(spark):
    slug = lambda s: spark.createDataFrame([(s,)], "s string").select(packs.library_slug(F.col("s"))).first()[0]
    assert [slug(x) for x in ("My Notes!", "///", "C++ API", "a b c d e f g")] == ["my-notes", "docs", "c-api", "a-b-c-d-e-f"]
    new = spark.createDataFrame([(1, "Notes"), (2, "notes"), (3, "x")], "slot bigint, name string")
    held = spark.createDataFrame([("local-notes",), ("local-notes-3",)], "id string")
    assert {r["slot"]: r["id"] for r in packs.library_ids(new, held).collect()} == {1: "local-notes-2", 2: "local-notes-4", 3: "local-x"}


def test_library_ids_of_two_slugs(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "A 2"), (4, "a"), (5, "a 2")], "slot bigint, name string")
    held = spark.createDataFrame([("local-a-4",), ("python",)], "id string")
    taken, want = {"local-a-4"}, {}
    for slot, slug in ((1, "a"), (2, "a"), (3, "a-2"), (4, "a"), (5, "a-2")):
        n = next(n for n in range(1, 99) if f"local-{slug}{'' if n == 1 else f'-{n}'}" not in taken)
        want[slot] = f"local-{slug}{'' if n == 1 else f'-{n}'}"
        taken.add(want[slot])
    assert {r["slot"]: r["id"] for r in packs.library_ids(new, held).collect()} == want


MANIFEST = {"schemaVersion": 1, "id": "python", "name": "n", "version": "3", "sourceUrl": "u", "sourceRevision": "r", "createdAt": "c", "locale": "en", "pageCount": 1, "license": {"name": "l", "url": "u", "attribution": "a", "sourceOfferUrl": None}}
PAGE = {"path": "a.md", "title": "t", "canonicalUrl": "u", "symbols": ["x.y"], "sections": [{"heading": "h", "anchor": "top", "text": "words"}]}


def test_pack_files(spark, tmp_path):
    cases = {
        "fine": (MANIFEST, json.dumps(PAGE) + "\n\n  \n"),
        "defaults": (MANIFEST, json.dumps({k: v for k, v in PAGE.items() if k != "symbols"} | {"more": 1})),
        "no manifest": (None, json.dumps(PAGE)),
        "bad manifest": (MANIFEST | {"license": {"name": "l"}}, json.dumps(PAGE)),
        "bad manifest 2": (MANIFEST | {"pageCount": -1}, json.dumps(PAGE)),
        "bad page": (MANIFEST, "{oops"),
        "bad page 2": (MANIFEST, json.dumps(PAGE | {"sections": [{"heading": "h", "anchor": "top"}]})),
        "bad page 3": (MANIFEST, json.dumps(PAGE | {"symbols": [None]})),
        "schema version": (MANIFEST | {"schemaVersion": 2}, json.dumps(PAGE)),
        "page count": (MANIFEST, json.dumps(PAGE) + "\n" + json.dumps(PAGE)),
        "entry too large": (MANIFEST | {"name": "n" * 1_100_000}, json.dumps(PAGE)),
        "unexpected entry": (MANIFEST, json.dumps(PAGE)),
    }
    for key, (manifest, pages) in cases.items():
        (tmp_path / key).mkdir()
        if manifest:
            (tmp_path / key / "manifest.json").write_text(json.dumps(manifest))
        (tmp_path / key / "pages.jsonl").write_text(pages)
    (tmp_path / "unexpected entry" / "evil.sh").write_text("x")
    pages, wrong = packfiles.read_packs(spark, str(tmp_path))
    assert {r["pack_key"]: r["violation"] for r in wrong.collect()} == {k: re.sub(" [23]$", "", k) for k in cases if k not in ("fine", "defaults")}
    got = {r["pack_key"]: r for r in pages.collect()}
    assert set(got) == {"fine", "defaults"} and got["fine"]["symbols"] == ["x.y"] and got["defaults"]["symbols"] == [] and got["fine"]["sections"][0]["code"] == []


def test_intermediate_tables_are_cleared(spark, tmp_path, monkeypatch):
    from lexloom.operators.lexical import bm25
    from lexloom.sources import tables

    chunks = spark.createDataFrame([(1, "red green"), (2, "green blue")], "chunk_id bigint, text string")
    asked = spark.createDataFrame([(7, "green")], "query_id bigint, question string")
    monkeypatch.setattr(tables.tempfile, "mkdtemp", lambda prefix: str(tmp_path / "made"))
    top = spark.conf.get("spark.checkpoint.dir", None) or str(tmp_path / "made")
    before = set(files.children(spark, top))
    made = lambda: sorted(x.split("-")[0] for x in set(files.children(spark, top)) - before)
    kept = tables.stored(asked, "kept")
    with tables.clearing(spark):
        with tables.clearing(spark):
            tables.stored(asked, "inner")
            assert made() == ["inner", "kept"]
        assert made() == ["kept"]
        bm25(chunks, asked).write.parquet(str(tmp_path / "hits"))
        assert made() == ["kept", "terms"]
    assert made() == ["kept"] and kept.count() == 1
    with pytest.raises(RuntimeError), tables.clearing(spark):
        tables.stored(asked, "lost")
        raise RuntimeError
    assert made() == ["kept"]
    files.delete(spark, kept.inputFiles()[0].rsplit("/", 1)[0])
    assert spark.read.parquet(str(tmp_path / "hits")).count() == 2


def test_few_pages_of_a_batch_are_parsed_at_once(spark):
    import pandas as pd

    rows = pd.DataFrame({"a": range(10)})
    assert [list(x["a"]) for x in ingest.slices(iter([rows, rows[:0], rows[:1]]), 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0]]
    n = 2 * ingest.PARSED + 5
    files = spark.createDataFrame([(f"{k}.md", f"# h{k}\n\ntext {k}") for k in range(n)], FILES).coalesce(1)
    got = {r["path"]: r["sections"][0]["text"] for r in ingest.parse_pages(files, "https://d").collect()}
    assert len(got) == n and all(got[f"{k}.md"].endswith(f"text {k}") for k in range(n))
