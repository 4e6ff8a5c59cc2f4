from __future__ import annotations

import io
import json
import random
import time
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvault.operators import chunking, ingest, intervals, literal, similarity, stats
from corvault.plans import compare, dedup


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    rng = np.random.default_rng(0)
    v = rng.standard_normal((150, 8))
    v[7] = v[9]
    rows = [(i, ("public", "restricted")[i % 2], v[i].tolist()) for i in range(150)] + [(900, "public", None), (901, "public", [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, level string, vec array<double>")
    got = {(r.query_id, r.level, r["rank"]): r.id for r in similarity.nearest(df.where("id < 5"), df, 4).collect()}
    for q in range(5):
        for parity, level in enumerate(("public", "restricted")):
            order = sorted((i for i in range(150) if i % 2 == parity), key=lambda i: (round(((v[q] - v[i]) ** 2).sum(), 9), i))[:4]
            assert [got[q, level, k + 1] for k in range(4)] == order


def test_similar_pairs_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 30)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((90, 4))
    v[3] = 0
    names = ("public", "restricted", "confidential")
    df = spark.createDataFrame([(i, names[i % 3], v[i].tolist()) for i in range(90)], "id long, level string, vec array<double>")
    got = {(r.source_id, r.target_id) for r in similarity.similar_pairs(df, df, 0.8).collect()}
    with np.errstate(invalid="ignore"):
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got == {(a, b) for a in range(90) for b in range(90) if a % 3 > b % 3 and a != 3 and b != 3 and u[a] @ u[b] >= 0.8}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, level string, vec array<double>")
    assert similarity.nearest(none, none, 3).count() == 0
    assert similarity.similar_pairs(none, none, 0.5).count() == 0


@pytest.mark.parametrize(
    ("boxes", "span", "closed", "strict", "inside"),
    [([[0, 10], [10, 25], [25, 40]], [5, 10], {0, 1}, {0}, {0}), ([[0, 5], [2, 8], [3, 15]], [3, 12], {0, 1, 2}, {0, 1, 2}, {2}), ([[60, 700], [10, 25]], [0, 80], {0, 1}, {0, 1}, set())],
)
def test_interval_joins(spark, boxes, span, closed, strict, inside):
    left = spark.createDataFrame([("d", i, a, b) for i, (a, b) in enumerate(boxes)], "doc string, l_id int, l_start long, l_end long")
    right = spark.createDataFrame([("d", 0, *span)], "doc string, r_id int, r_start long, r_end long")
    for join, expected in ((intervals.closed_overlap, closed), (intervals.strict_overlap, strict), (intervals.containment, inside)):
        found = [r.l_id for r in join(left, right, "doc").collect()]
        assert len(found) == len(set(found))
        assert set(found) == expected


def test_line_boxes(spark):
    df = spark.createDataFrame([(1, "第一行\n第二行\n\n第四行\n"), (2, None)], "id long, text string")
    rows = intervals.line_boxes(df, "id", "text").orderBy("line_no").collect()
    assert [(r.line_no, r.char_start, r.char_end, r.y0, r.y1, r.x1) for r in rows] == [(0, 0, 4, 0, 14, 595), (1, 4, 8, 14, 28, 595), (3, 9, 13, 42, 56, 595)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。，\n .", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_chunkers_keep_the_text(text, size, overlap):
    plain = chunking.recursive(size, 0)(text)
    assert "".join(plain) == text
    assert all(len(p) <= size for p in plain)
    assert "".join(w[overlap if i else 0 :] for i, w in enumerate(chunking.windows(text, size, overlap))) == text
    assert all(len(p) <= size for p in chunking.at_sentence(size, overlap)(text))
    chunking.merging(size, overlap)(text)
    chunking.semantic(size, 3)(text)


def test_chunk_parameters():
    with pytest.raises(ValueError, match="overlap"):
        chunking.recursive(10, 10)
    assert chunking.recursive(10, 2)("short") == ["short"]
    assert chunking.recursive(4, 1)("aa。bb。cc。") == ["aa。", "。bb。", "。cc。"]


def test_folds():
    assert chunking.without_sections("目录\n1. 概述……1\n2. 方法……5\n\n\n正文") == "正文"
    assert chunking.without_sections("目录\n\n这是正文第一段\n$x=1$\n末") == "这是正文第一段\n末"
    assert chunking.level_headings("# a\n### b\ntext\n## c") == "# a\n## b\ntext\n# c"
    assert chunking.distinct_paragraphs("one two three\n\none, two three\n\nquite another one") == "one two three\n\nquite another one"
    assert chunking.table_blocks("| a |\n|---|\n| b |\ntext\nk: v\nk: w") == [(0, 3)]


def test_links_and_contacts(spark):
    df = spark.createDataFrame([("see http://a.org/x and [t](http://b.org)", "Call 13912345678 or a@b.cn\n2024-12345678"), (None, "13912345678"), ("", "010-12345678 and 010-12345678\n11010519491231002X")], "a string, b string")
    got = [tuple(r) for r in df.select(chunking.named_links(F.col("a")), chunking.contacts_on_lines(F.col("b"))).collect()]
    assert got == [
        ("see [链接: a.org](http://a.org/x) and [t](http://b.org)", "Call or\n电话: 13912345678\n邮箱: a@b.cn\n2024-12345678"),
        (None, "电话: 13912345678"),
        ("", "and\n电话: 010-12345678\n电话: 010-12345678\n身份证: 11010519491231002X"),
    ]


def test_chunk_positions_and_nulls(spark):
    df = spark.createDataFrame([(1, "abcdef" * 30), (2, None), (3, "")], "id long, text string")
    rows = chunking.chunk(df, "id", "text", chunking.recursive(50, 10)).collect()
    assert {r.id for r in rows} == {1}
    assert all(("abcdef" * 30)[r.char_start : r.char_end] == r.text for r in rows)


def test_literal_signs(spark):
    assert literal.signs("abcdefghij", "xxabcdefghyy", 8) == (1 / 3, 8)
    assert literal.signs("abc", "xabcx", 8) == (0.0, 0)
    assert literal.signs("abc", "xxxxabcxxxx", 8) == (1.0, 0)
    df = spark.createDataFrame([("ab cdefghij", "abcdefghij"), (None, "x")], "q string, t string")
    assert [(r.overlap, r.run) for r in literal.pair_overlap(df, "q", "t").collect()] == [(1.0, 10), (0.0, 0)]


@pytest.mark.parametrize("limit", [(512, 1_500_000), (3, 400)])
def test_blocks_of_documents_equal_brute_force(spark, monkeypatch, limit):
    """Overlap and longest run against a level; once with small blocks, so that a document is dealt to several."""
    monkeypatch.setattr(literal, "DOCUMENTS", limit[0])
    monkeypatch.setattr(literal, "CHARS", limit[1])
    rng = random.Random(4)
    phrase = ["".join(rng.choices("abcd", k=rng.randint(4, 14))) for _ in range(30)]
    text = lambda k: " ".join(rng.choices(phrase, k=k))
    index = [(("x", "y")[i % 2], None if i == 5 else f"d{i % 9}", text(rng.randint(1, 14))) for i in range(40)] + [("x", "empty", None), ("x", "short", "abc")]
    queries = [(i, text(rng.randint(0, 12))) for i in range(25)] + [(90, None), (91, "")]
    got = {(r.id, r.level): (r.grams, r.hits, r.run, r.doc) for r in literal.against(spark.createDataFrame(queries, "id long, text string"), spark.createDataFrame(index, "level string, doc string, text string")).collect()}
    grams = lambda t: ["".join(t.split())[i : i + 8] for i in range(len("".join(t.split())) - 7)] if t else []
    expected = {}
    for i, q in queries:
        own = grams(q)
        for level in ("x", "y"):
            docs = {}
            for lv, d, t in index:
                if lv == level:
                    docs.setdefault(d, set()).update(grams(t))
            every = set().union(*docs.values())
            if not set(own) & every:
                continue
            runs = []
            for d, known in docs.items():
                best = now = 0
                for g in own:
                    now = now + 1 if g in known else 0
                    best = max(best, now)
                if best:
                    runs.append((-best, d is None, d or "", d))
            run = min(runs)
            expected[i, level] = (len(set(own)), len(set(own) & every), 7 - run[0], run[3])
    assert got == expected and len(got) > 20


def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    t = ingest.Table(spark, str(tmp_path / "t"))
    rows = lambda x: spark.createDataFrame(x, "id string, n int")
    t.upsert(rows([("a", 1), ("b", 1)]), "id")
    before = sorted(map(tuple, t.read().collect()))
    # after the data, before the pointer
    with monkeypatch.context() as m:
        m.setattr(ingest.Table, "_pointers", lambda self: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t._put(rows([("a", 9)]), "id", {})
    assert sorted(map(tuple, ingest.Table(spark, str(tmp_path / "t")).read().collect())) == before
    # a pointer that was written, but not renamed
    (tmp_path / "t" / "_next-x").write_text("{}")
    assert sorted(map(tuple, t.read().collect())) == before
    for i in range(4):
        t.upsert(rows([("c", i)]), "id")
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 1), ("c", 3)]
    assert len(list((tmp_path / "t").glob("current-*.json"))) == 2


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    t = ingest.Table(spark, str(tmp_path / "t"), buckets=16)
    t.upsert(spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("n")), "id")
    first = t._state()["folders"]
    t.upsert(spark.createDataFrame([("7", 5)], "id string, n int"), "id")
    second = t._state()["folders"]
    assert sum(first[b] != second[b] for b in first) == 1
    assert {r.id: r.n for r in t.read().collect()} == {str(i): 5 if i == 7 else 0 for i in range(200)}
    t.append(spark.createDataFrame([("7", 6), (None, 1), (None, 2)], "id string, n int"), "id")
    assert t.read().count() == 203


def test_children_without_parent_keep_apart(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, None, None, "y"), (3, "", 4, "x"), (4, "p", 2, "x"), (5, "p", None, "x")], "row_id long, doc_id string, i int, t string")
    got = [r[0] for r in df.select(ingest.child_key(F.col("doc_id"), F.col("i"), F.col("row_id"), F.col("t"))).collect()]
    assert len(set(got)) == 5 and got[3] == "p_child_2" and got[0].startswith("unknown_child_") and got[4].startswith("p_child__")


def test_free_names(spark):
    df = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "a_1.md"), (4, "a.md"), (5, "b"), (6, "b"), (7, None)], "i int, n string")
    got = {r.i: r.free_name for r in ingest.free_names(df, "n", "i").collect()}
    assert got == {1: "a.md", 2: "a_1.md", 3: "a_1_1.md", 4: "a_2.md", 5: "b", 6: "b_1", 7: None}
    taken = spark.createDataFrame([("a.md",), ("a_1.md",)], "n string")
    assert {r.i: r.free_name for r in ingest.free_names(df.where("i = 1"), "n", "i", taken=taken).collect()} == {1: "a_2.md"}


def test_upsert_and_delete(spark, tmp_path):
    t = ingest.Table(spark, str(tmp_path / "t"))
    rows = lambda x: spark.createDataFrame(x, "id string, n int")
    t.upsert(rows([("a", 1), ("b", 1), ("b", 2)]), "id", F.desc("n"))
    t.upsert(rows([("b", 9), ("c", 1)]), "id", F.desc("n"))
    assert sorted((r.id, r.n) for r in t.read().collect()) == [("a", 1), ("b", 9), ("c", 1)]
    t.delete(rows([("a", 0)]), "id")
    assert sorted(r.id for r in t.read().collect()) == ["b", "c"]
    t.clear()
    assert t.read() is None


def test_hash_notations(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h,), ("SHA256:" + h.upper(),), ("sha256-" + h,), ("x",), (None,)], "h string")
    assert [r.p for r in df.select(ingest.plain_hash(F.col("h")).alias("p")).collect()] == [h, h, h, None, None]


def test_series_report(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((0, 30, 60, 90, 130))] + [("b", i, 1.0) for i in range(5)], "k string, t int, v double")
    r = {x.k: x for x in stats.series_report(df, "k", F.col("t"), "v").collect()}
    assert r["a"].leaking and not r["b"].leaking
    assert (r["a"].peak, r["a"].total_delta) == (130.0, 130.0)


def test_dedup_plan(spark):
    text = "the same passage of more than thirty characters"
    rows = [(1, "public", [1.0, 0.0], text), (2, "confidential", [1.0, 0.0], text), (3, "restricted", [0.0, 1.0], "other")]
    corpus = spark.createDataFrame(rows, "id long, level string, vec array<double>, text string")
    found = dedup.matches(corpus)
    assert [(r.source_id, r.target_id, r.band) for r in found.collect()] == [(2, 1, "high")]
    assert sorted(r.id for r in dedup.apply(corpus, found).collect()) == [1, 3]
    n = {(r.source_level, r.target_level): (r.total_checked, r.high) for r in dedup.counters(found, corpus).collect()}
    assert n == {("restricted", "public"): (1, 0), ("confidential", "public"): (1, 1), ("confidential", "restricted"): (1, 0)}
    assert dedup.report(found).first().line.startswith("1. [confidential → public] 1.0000")


def test_matching_spans():
    assert compare.matching_spans("we saw the secret plan today", "secret plan") == [(11, 22)]
    assert compare.matching_spans("nothing here", "secret plan") == []
    assert compare.matching_spans("", "x") == []


def test_compare_skips_what_is_known(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    vec = [1.0] + [0.0] * 7
    parents = spark.createDataFrame([("d", 0, "p0", vec, text)], "doc string, idx int, doc_id string, vec array<double>, text string")
    corpus = spark.createDataFrame([(1, "confidential", "lib", vec, text)], "id long, level string, doc string, vec array<double>, text string")
    rows = compare.compare(parents, parents, corpus).collect()
    assert [(r.kind, r.matched_level, r.matched_doc) for r in rows] == [("abstract", "confidential", "lib")]


def test_composite_queries_ask_for_everything(spark, monkeypatch):
    from corvault.plans import queries

    chunks = queries.read(spark, "/root/testdata/sf0.001", "chunks").select("row_id", "file_path", "chunk_index", "text", "batch_no").collect()
    asked = {r.row_id for r in queries.QUERIES["search"](spark, "/root/testdata/sf0.001").collect()}
    assert asked == {r.row_id for r in chunks if r.text and r.row_id % 50 == 0}

    monkeypatch.setattr(compare, "compare", lambda parents, children, corpus: (parents, children))
    monkeypatch.setattr(compare, "scan", lambda texts, *_: texts.select(F.col("row_id").alias("id"), *[F.lit(0).alias(c) for c in ("chunk_no", "level", "similarity", "matched_id", "start", "end", "content")]))
    parents, children = ([r.asDict() for r in df.collect()] for df in queries.QUERIES["compare_documents"](spark, "/root/testdata/sf0.001"))
    assert sorted((r["doc"], r["idx"]) for r in parents) == sorted({(r.file_path, r.chunk_index) for r in chunks if r.text and r.batch_no > 0})
    assert {(r["doc"], r["doc_id"]) for r in children} == {(r["doc"], r["doc_id"]) for r in parents}
    assert max(len(r["text"]) for r in children) < max(len(r["text"]) for r in parents)
    assert {r.row_id for r in queries.QUERIES["scan_texts"](spark, "/root/testdata/sf0.001").collect()} == {r.row_id for r in chunks if r.batch_no > 0}


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return b.getvalue()


def test_readers(spark, tmp_path):
    from corvault.sources import files

    root = tmp_path / "DOC" / "1Restricted"
    root.mkdir(parents=True)
    w = 'xmlns:w="http://w"'
    (root / "a.docx").write_bytes(_zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'}))
    (root / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>'}))
    (root / "c.html").write_text("<body><header>x</header><h2>H</h2><p>a <b>b</b><pre>x = 1</pre><a href='javascript:1'>l</a></body>")
    (root / "d.docx").write_bytes(b"no zip")
    (root / "e.png").write_bytes(b"x")
    (root / ".hidden.txt").write_text("x")
    got = {r.path.rpartition("/")[2]: r for r in files.markdown(spark, str(tmp_path / "DOC")).collect()}
    assert got["a.docx"].text == "# Title\n\nBody"
    assert got["b.xlsx"].text == "h: 5"
    assert got["c.html"].text == "## H\n\na **b**\n\n```\nx = 1\n```\n\nl"
    assert got["d.docx"].text is None and got["d.docx"].error
    assert got["e.png"].text == "[Image: e.png]\n"
    assert {r.level for r in got.values()} == {"restricted"}


def test_chunk_files(spark, tmp_path):
    from corvault.sources import files

    d = tmp_path / "0Public" / "doc.md"
    d.mkdir(parents=True)
    item = lambda i: {"text": f"t{i}", "metadata": {"chunk_index": i, "source": "doc.md", "doc_id": f"p{i}"}}
    (d / "doc.parents.json").write_text(json.dumps([item(0), item(1)]))
    (d / "doc.children.json").write_text(json.dumps([item(0)]))
    (d / "bad.chunks.json").write_text("not valid json {{{")
    assert sorted((r.kind, r.text, r.is_parent, r.parent_doc_id) for r in files.chunk_files(spark, str(tmp_path)).collect()) == [("children", "t0", False, "p0"), ("parents", "t0", True, None), ("parents", "t1", True, None)]
    assert files.chunk_files(spark, str(tmp_path), "children-only").count() == 1


def test_streaming_ingest(spark, tmp_path):
    from corvault.streaming.ingest import ingest as stream

    src = str(tmp_path / "in")
    chunks = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet")
    chunks.where("batch_no = 0").write.parquet(src)
    table = ingest.Table(spark, str(tmp_path / "t"))
    for batch in (None, 1):
        if batch is not None:
            chunks.where("batch_no > 0").write.mode("append").parquet(src)
        stream(spark, src, chunks.schema, table, str(tmp_path / "ck")).awaitTermination()
    assert table.read().count() == ingest.canonical(chunks).select("id").distinct().count()


def test_stream_and_shared_folder(spark):
    from corvault import runtime

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            runtime.shared_dir(Session())
    made = runtime.checkpoint(spark.range(3))
    assert made.count() == 3 and runtime.drop_tables(spark) >= 1


def _pdf(pages):
    import zlib

    esc = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] >>", b"<< /Type /Font /Subtype /Type1 >>"]
    for i, lines in enumerate(pages):
        body = zlib.compress(b"BT /F1 12 Tf 14 TL 72 770 Td " + b" ".join(b"[(%s) -200 (%s)] TJ T*" % (esc(x[:2]), esc(x[2:])) for x in lines) + b" ET")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))


def test_pdf(spark, tmp_path):
    from corvault.sources import files, pdf

    content = _pdf([["Head", "one (a)", "two"], ["Head", "three 13912345678"], ["Head", "four"]])
    (tmp_path / "a.pdf").write_bytes(content)
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    pages = pdf.lines(content)
    assert [[t for t, _ in p] for p in pages] == [["Head", "one (a)", "two"], ["Head", "three 13912345678"], ["Head", "four"]]
    assert pages[0][0][1][0] == 72 and pages[0][0][1][1] < pages[0][1][1][1]
    got = {r.path.rpartition("/")[2]: r for r in files.markdown(spark, str(tmp_path)).collect()}
    assert "Head" not in got["a.pdf"].text and "<!-- Page 2 -->" in got["a.pdf"].text and "three\n电话: 13912345678" in got["a.pdf"].text
    assert got["bad.pdf"].error
    e = files.pdf_elements(spark, str(tmp_path)).where("path like '%a.pdf'")
    row = e.first()
    assert [(row.text[x.start : x.end], x.page) for x in row.elements] == [("one (a)", 1), ("two", 1), ("four", 3)]
    v = files.verified_elements(e).first()
    assert (v.elements, v.outside, v.empty, v.unsorted, v.wrong_page) == (3, 0, 0, 0, 0) and 0 < v.covered < 1
    wrong = e.withColumn("elements", F.transform("elements", lambda x: x.withField("page", F.lit(2))))
    assert files.verified_elements(wrong).first().wrong_page == 3


def test_office_pictures_and_markers(spark, tmp_path):
    from corvault.sources import files

    w = 'xmlns:w="http://w" xmlns:a="http://a" xmlns:r="http://r"'
    rels = '<Relationships><Relationship Id="r1" Target="media/image1.png"/></Relationships>'
    doc = f'<w:document {w}><w:body><w:p><w:r><w:t>Text</w:t></w:r><w:r><a:blip r:embed="r1"/></w:r></w:p></w:body></w:document>'
    content = _zip({"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/media/image1.png": b"x", "word/media/../../evil.png": b"y"})
    (tmp_path / "a.docx").write_bytes(content)
    assert files.docx(content, "a.docx") == "Text\n\n##a_002.png##"
    assert [(r.inner, r.name) for r in files.office_media(spark, str(tmp_path)).collect()] == [("word/media/image1.png", "a_002.png")]
    texts = spark.createDataFrame([(1, "see ##a_002.png## and ##none.png##"), (2, "plain"), (3, None), (1, "see ##a_002.png##")], "id int, text string")
    said = spark.createDataFrame([("a_002.md", " a chart ")], "name string, text string")
    assert sorted((r.id, r.text or "") for r in files.described(texts, said, "id", "text").collect()) == [(1, "see a chart"), (1, "see a chart and ##none.png##"), (2, "plain"), (3, "")]
    assert files.html_markdown('<body><p>x <img src="data:image/png;base64,AAAA"></p></body>').startswith("x ##") and files.data_image("data:text/html,x") is None
    fast = files.convert(_zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'}), "b.docx", "docx-fast")
    assert fast == "Body\n"


def test_folders_of_documents(spark, tmp_path):
    from corvault.sources import files

    d = tmp_path / "1Restricted" / "doc.md" / "images"
    d.mkdir(parents=True)
    for n in ("b.png", "a.JPG", "c.txt"):
        (d / n).write_bytes(b"12")
    (tmp_path / "0Public" / "other.md").mkdir(parents=True)
    (tmp_path / "0Public" / "other.md" / "x.parents.json").write_text("[]")
    got = [(r.image_index, r.path.rpartition("/")[2], r.document, r.level) for r in files.images(spark, str(tmp_path)).orderBy("image_index").collect()]
    assert got == [(0, "a.JPG", "doc.md", "restricted"), (1, "b.png", "doc.md", "restricted")]
    assert {r.folder.rpartition("/")[2] for r in files.document_folders(spark, str(tmp_path)).collect()} == {"doc.md", "other.md"}
    assert [(r.name, r.size_display) for r in files.listed(spark, str(d)).where("name = 'b.png'").collect()] == [("b.png", "0.0 KB")]
    assert {(r.level, r.files, r.bytes) for r in files.source_counts(spark, str(tmp_path)).collect()} == {("restricted", 3, 6), ("public", 1, 2)}
    o = spark.createDataFrame([("/out/x/a.md",), ("/out/b.md",), ("/out/none.md",)], "p string")
    i = spark.createDataFrame([("/in/x/a.docx",), ("/in/y/b.pdf",)], "p string")
    assert {r.output: r.source for r in files.sources_of(o, i, "/out", "/in").collect()} == {"/out/x/a.md": "/in/x/a.docx", "/out/b.md": "/in/y/b.pdf", "/out/none.md": None}


def test_preprocess_with_a_log(spark, tmp_path):
    from corvault.plans import pipeline

    root, out = tmp_path / "in" / "0Public", str(tmp_path / "out")
    root.mkdir(parents=True)
    (root / "a.txt").write_text("one line. " * 200)
    (root / "b.docx").write_bytes(b"broken")
    log = pipeline.preprocess(spark, str(tmp_path / "in"), out)
    assert sorted((r.path.rpartition("/")[2], r.status) for r in log.collect()) == [("a.txt", "success"), ("b.docx", "failed")]
    assert {(r.level, r.processed, r.success, r.failed) for r in pipeline.totals(log).collect()} == {("public", 2, 1, 1), (None, 2, 1, 1)}
    (root / "b.docx").write_bytes(_zip({"word/document.xml": '<w:document xmlns:w="http://w"><w:body><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'}))
    assert [r.status for r in pipeline.retry(spark, str(tmp_path / "in"), out).collect()] == ["success"]
    assert pipeline.totals(ingest.Table(spark, out + "/log").read()).where("level is null").first().failed == 0
    kids = ingest.Table(spark, out + "/children").read()
    assert kids.select("path").distinct().count() == 2 and kids.where("doc_id is null").count() == 0


def test_index_from_files_to_search(spark, tmp_path):
    from corvault.plans import pipeline
    from corvault.sources import files

    d = tmp_path / "MD" / "0Public" / "doc.md"
    d.mkdir(parents=True)
    item = lambda t, i, p: {"text": t, "metadata": {"chunk_index": i, "source": "doc.md", "doc_id": p}}
    parents = [item("apples and pears grow on trees", 0, "p0"), item("ships sail the sea", 1, "p1")]
    children = [item("apples grow", 0, "p0"), item("pears grow", 1, "p0"), item("ships sail", 2, "p1"), item("the sea", 3, "p1"), item("no parent", 4, None), item("none either", 4, None)]
    (d / "doc.parents.json").write_text(json.dumps(parents))
    (d / "doc.children.json").write_text(json.dumps(children))
    index = pipeline.Index(spark, str(tmp_path / "ix"))
    rows = lambda: files.chunk_files(spark, str(tmp_path / "MD"))
    assert index.index(rows()).count() == 2
    n = lambda: {r.collection: r.n for r in index.counts().collect()}
    assert n() == {"parents": 2, "children": 6, "manifest": 2}
    assert index.index(rows()).count() == 0
    assert [(r.action, r.files) for r in index.ingest(rows()).collect()] == [("skipped", 0)]
    q = spark.createDataFrame([(1, "apples grow")], "id long, text string")
    hits = index.search(q, 3).orderBy(F.desc("score")).collect()
    assert hits[0].text == "apples grow" and hits[0].parent_text == "apples and pears grow on trees" and hits[0].score == 1.0
    assert len({h.doc_id or h.id for h in hits}) == len(hits) <= 3
    (d / "doc.children.json").write_text(json.dumps(children[:3]))
    assert index.index(rows()).count() == 1 and n()["children"] == 3
    pair = pipeline.Index(spark, str(tmp_path / "pair"))
    pair.add_pair(spark.createDataFrame([("a pair", 0, "")], "text string, chunk_index int, doc_id string"), spark.createDataFrame([("kid", 0), ("kid", 1)], "text string, chunk_index int"))
    assert {r.collection: r.n for r in pair.counts().collect()} == {"parents": 1, "children": 2}
    index.clear("public")
    assert n() == {}
    assert index.switch("hashed") is False and index.switch("other") is True


def test_pictures_in_the_index(spark, tmp_path):
    from corvault.functions import models
    from corvault.plans import pipeline
    from corvault.sources import files

    d = tmp_path / "2Confidential" / "doc.md" / "images"
    d.mkdir(parents=True)
    (d / "a.png").write_bytes(b"abc")
    (d / "empty.png").write_bytes(b"")
    index = pipeline.Index(spark, str(tmp_path / "ix"))
    contents = spark.read.format("binaryFile").load(str(d)).select("path", "content")
    for _ in range(2):
        assert index.index_images(files.images(spark, str(tmp_path)), contents, models.embed_images(F.col("content"))).count() == 1
    assert {r.collection: r.n for r in index.counts().collect()} == {"images": 1}


def test_models_without_a_model(spark):
    from corvault.functions import models

    df = spark.createDataFrame([("q", "c")], "q string, c string")
    assert tuple(df.select(models.reranked(F.col("q"), F.col("c")), models.answers(F.col("q"))).first()) == (None, None)
    models.register("reranker", "zero", lambda pairs: [0.0 for _ in pairs])
    assert df.select(models.reranked(F.col("q"), F.col("c"), "zero")).first()[0] == 0.5
    with models.Run(spark, "test-run") as run:
        assert run.progress() == 1.0
    replies = spark.createDataFrame([([7, 8], "1: YES\n2: no\n3: YES\nx\n 1 : NO")], "ids array<long>, reply string")
    assert {r.id: r.noise for r in models.verdicts(replies).collect()} == {7: False, 8: False}


def test_states_of_files(spark):
    from corvault.plans import status

    names = ["report.pdf", "report.md", "report.parents.json", "note.md", "x_1.txt", "orphan.parents.json", ".hidden.txt", "x.chunks.json"]
    listing = spark.createDataFrame([(n,) for n in names], "name string")
    from corvault.functions import text as T

    first = spark.createDataFrame([("report", f"{T.MARKS[0]}[1.0]{T.MARKS[1]}public:0.5")], "stem string, vector string")
    states = status.file_states(listing, first, ["pdf", "md", "txt"])
    assert {tuple(r) for r in states.collect()} == {("report", "report.pdf", True, True, True), ("note", "note.md", False, False, False), ("x_1", "x_1.txt", False, False, False)}
    assert tuple(status.folder_statistics(listing, states).first()) == (3, 1, 1, 1)
    asked = spark.createDataFrame([("report.pdf",), ("x.txt",), ("none.txt",)], "name string")
    assert {(r.filename, r.saved, r.compared) for r in status.status_of(states, asked).collect()} == {("report.pdf", True, True), ("x.txt", True, False), ("none.txt", False, False)}
    left = status.without_files(listing, spark.createDataFrame([("report.pdf",)], "name string"))
    assert {r.name for r in left.collect()} == {"note.md", "x_1.txt", "orphan.parents.json", ".hidden.txt", "x.chunks.json"}


def test_documents_split_with_their_elements(spark):
    from corvault.plans import pipeline

    text = "# Head\n" + "word " * 60 + "\n| a | b |\n| c | d |\n" + "more " * 60
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    e = pipeline.line_elements(df, "id", "text")
    assert [(r.element, r.type) for r in e.where("id = 1").orderBy("element").collect()] == [(0, "Title"), (1, "text"), (2, "Table"), (3, "Table"), (4, "text")]
    paged = e.withColumn("page", F.when(F.col("element") < 2, 1).otherwise(2))
    got = pipeline.split_documents(df, paged, "id", "text", 330, 0).orderBy("chunk_index").collect()
    assert [(r.page, r.chunk_type) for r in got] == [(1, "heading"), (1, "text")] or got[0].page == 1
    assert json.loads(got[0].bbox)["chunk_bboxes"][0]["page"] == 1
    with pytest.raises(Exception, match="longer than the limit"):
        pipeline.split_documents(df, e, "id", "text", 330, 0, most=10).count()
    p = {r.id: r for r in pipeline.process(df, "id", "text").collect()}
    assert p[1].title == "Head" and p[1].chunks and p[2].overall_score == 0 and p[2].issues == ["empty"]


def moved(spark, df):
    """Bytes written to the shuffle for ``df``."""
    sc = spark.sparkContext

    def total() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_blocks_of_vectors_are_not_copied(spark, monkeypatch):
    """The shuffle doesn't grow with the number of blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, ("public", "restricted", "confidential")[i % 3], v.tolist()) for i, v in enumerate(rng.normal(size=(600, 32)))]
    df = spark.createDataFrame(rows, "id long, level string, vec array<double>").localCheckpoint()
    got = {}
    for block in (1000, 20):
        monkeypatch.setattr(similarity, "BLOCK", block)
        got[block] = moved(spark, similarity.similar_pairs(df, df, 0.9)), moved(spark, similarity.nearest(df, df, 2))
    assert got[1000][0] > 0 and got[20][0] < 2 * got[1000][0] and got[20][1] < 2 * got[1000][1]


def test_signs_of_similar_pairs_equal_those_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(literal.Signs, "TOGETHER", 300)
    monkeypatch.setattr(literal.Signs, "BITS", 9)  # many grams share a place
    rng = random.Random(8)
    words = ["".join(rng.choices("abcde", k=rng.randint(2, 9))) for _ in range(25)]
    texts = ["", "abc", "abcabcab", "abcabc a" * 40, *(" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(40)), None]
    rows = [(i, ("public", "restricted", "confidential")[i % 3], [1.0, i / 1000], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, level string, vec array<float>, text string")
    got = {(r.source_id, r.target_id): (r.overlap, r.run) for r in similarity.similar_pairs(df, df, 0.5, text_col="text").collect()}
    plain = [literal.normal(t or "") for t in texts]
    assert len(got) == 15 * 30 + 15 * 15 and all(v == pytest.approx(literal.signs(plain[a], plain[b])) for (a, b), v in got.items())


@pytest.mark.parametrize("name", ["overlap_with_history", "longest_run_in_history"])
def test_literal_queries_copy_nothing(spark, monkeypatch, name):
    """What the query moves doesn't grow with the number of blocks of the history."""
    from corvault.plans import queries

    got = []
    for chars in (1_500_000, 3_000):
        monkeypatch.setattr(literal, "CHARS", chars)
        got.append(moved(spark, queries.QUERIES[name](spark, "/root/testdata/sf0.001")))
    # 57 blocks instead of one; of each only the best of each text is sent
    assert 0 < got[1] < 6 * got[0]


@pytest.mark.parametrize("limit", [8_000_000, 50])
def test_known_grams_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(literal, "GRAMS", limit)
    rng = random.Random(6)
    phrase = ["".join(rng.choices("abcd", k=rng.randint(4, 14))) for _ in range(30)]
    text = lambda: " ".join(rng.choices(phrase, k=rng.randint(0, 14)))
    old, new = [text() for _ in range(60)] + [None, "", "abc"], [(i, text()) for i in range(40)] + [(90, None), (91, ""), (92, "a b c d e f")]
    grams = lambda t: {"".join(t.split())[i : i + 8] for i in range(len("".join(t.split())) - 7)} if t else set()
    there = set().union(*map(grams, old))
    queries = spark.createDataFrame(new, "id long, text string").repartition(3)
    for known, expected in ((old, there), ([], set())):
        got = {r.id: (r.grams, r.hits) for r in literal.known(queries, spark.createDataFrame([(t,) for t in known], "text string").repartition(3)).collect()}
        assert got == {i: (len(grams(t)), len(grams(t) & expected)) for i, t in new if grams(t)}


def test_spans_of_long_texts():
    """Pairs of long texts end; the stretches are those of the definition."""
    rng = random.Random(3)
    bare = lambda s: "".join(filter(str.isalnum, s))
    word = lambda: "".join(rng.choices("abcö-.", k=rng.randint(1, 30)))
    for _ in range(200):
        text, pattern = (" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(2))
        spaced = len(set(pattern.split())) > 1
        keys = {k for k in map(bare, set(pattern.split()) if spaced else pattern) if len(k) > (2 if spaced else 0)}
        for w in {bare(x) for x in text.split()} - {""}:
            assert compare._related(w, frozenset(keys), "\n".join(keys)) == any(k in w or w in k for k in keys)
    begun = time.thread_time()
    text, pattern = (" ".join(f"{k}{i:05d}" for i in range(8_000)) for k in "xy")
    assert compare.matching_spans(text, pattern) == []
    assert time.thread_time() - begun < 2


def test_signs_of_chosen_pairs(spark):
    """Equal to those of each pair of texts, and no pair carries its texts through the shuffle."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    texts = ["", None, "abc", *(" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").localCheckpoint()
    pairs = spark.createDataFrame([(a, b) for a in range(63) for b in range(63) if rng.random() < 0.7], "query_id long, id long").localCheckpoint()
    made = literal.chosen_overlap(pairs, df, df)
    got = {(r.query_id, r.id): (r.overlap, r.run) for r in made.collect()}
    plain = [literal.normal(t or "") for t in texts]
    assert len(got) == pairs.count() and all(v == pytest.approx(literal.signs(plain[a], plain[b])) for (a, b), v in got.items())
    assert moved(spark, made) < sum(len(texts[a] or "") + len(texts[b] or "") for a, b in got) / 10
