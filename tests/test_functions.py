"""Scalar functions, XML and diffs, over small literals."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import citation as C
from plumbline.functions import batches, linediff, xmltext
from plumbline.functions import measure as M
from plumbline.functions import scalar as S
from plumbline.functions import text as T
from plumbline.operators import diffs, packing


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r if isinstance(r, tuple) else (r,)) for r in rows], schema).select(column).collect()]


def test_word_rule(spark):
    cases = {"": 0, "one two": 2, "a--b": 2, "a-b": 1, "a - b": 2, "a–b": 2, "co​op": 1, "a-­-b": 1, "...": 0, "§ 1.1": 1, "x y\ty": 3, "don't": 1, "第 一": 2}
    assert values(spark, list(cases), "t string", T.count_words(F.col("t"))) == list(cases.values())
    assert values(spark, [None], "t string", T.count_words(F.col("t"))) == [None]


def test_scopes(spark):
    s = C.to_scope(F.col("t"), chapter=F.col("c"), part=F.col("p"))
    df = spark.createDataFrame([(40, "I", "60"), (40, "", None), (7, None, "1-2")], "t int, c string, p string").select(s.alias("s"))
    got = df.select(C.ref_key(F.col("s")).alias("k"), C.narrowest_level(F.col("s")).alias("l"), C.display(F.col("s")).alias("d"), C.parse_ref_key(C.ref_key(F.col("s"))).alias("b"), "s").collect()
    assert [(r.k, r.l, r.d) for r in got] == [("title-40/chapter-I/part-60", "part", "40 CFR chapter I part 60"), ("title-40", "title", "40 CFR"), ("title-7/part-1-2", "part", "7 CFR part 1-2")]
    assert all(r.b == r.s for r in got)
    assert values(spark, ["part-1", "title-x", "title-3/foo-1/part-2"], "k string", C.parse_ref_key(F.col("k"))["part"]) == [None, None, "2"]


def test_citation_queries(spark):
    """The recognised forms and no others: what else is typed is a name."""
    q = {
        "40 CFR part 60": (40, "part", "60"), "40 CFR 60.1": (40, "title", "40"), "40 cfr 60": (40, "part", "60"), "title 3": (3, "title", "3"), "51 CFR 1": None, "clean air": None, "40 CFR " + " " * 70 + "1": None,
        "40 CFR pt. 60a": (40, "part", "60a"), "40cfr60": (40, "part", "60"), "40 CFR Chapter i": (40, "chapter", "I"), "40 CFR ch. I": (40, "chapter", "I"), "40 CFR Subchapter c": (40, "subchapter", "C"), "40 cfr subch. C": (40, "subchapter", "C"),
        "7 CFR Subtitle a": (7, "subtitle", "A"), "title-40": (40, "title", "40"), "title-40/chapter-i/part-60": (40, "part", "60"), "title-7/subtitle-A/chapter-IX": (7, "chapter", "IX"), "title-40/part-60/chapter-I": None,
        "26 CFR § 1.72-9": (26, "title", "26"), "title 0": None, "": None, "  title 5 ": (5, "title", "5"), "title 12, part 1026": None,
    }
    got = values(spark, list(q), "q string", C.parse_query(F.col("q")))
    assert [(g["title"], g["level"], g["identifier"]) if g else None for g in got] == list(q.values())
    by = dict(zip(q, got))
    assert by["26 CFR § 1.72-9"]["section"] == "1.72-9" and by["title-40/chapter-i/part-60"]["chapter"] == "I"


def test_ancestors_and_children(spark):
    assert values(spark, ["a/b/c"], "c string", C.ancestors(F.col("c"))) == [["a", "a/b", "a/b/c"]]
    assert values(spark, [("p", "section", None, 2), ("", "title", "3", 0)], "p string, k string, i string, o int", C.child_citation(*map(F.col, "pkio"))) == ["p/section-@2", "title-3"]


def test_natural_order_is_a_total_order(spark):
    labels = ["10", "9", "9a", "a10", "a9", "A2", ""]
    keys = values(spark, labels, "x string", T.natural_key(F.col("x")))
    assert [x for _, x in sorted(zip(keys, labels))] == ["", "9", "9a", "10", "A2", "a9", "a10"]


def test_html_and_text_helpers(spark):
    assert values(spark, ['<a & "b">'], "x string", T.escape_html(F.col("x"))) == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert values(spark, ["a\x00b"], "x string", T.sanitize(F.col("x"))) == ["a�b"]
    assert values(spark, ["50%_\\x"], "x string", T.like_pattern(F.col("x"))) == ["%50\\%\\_\\\\x%"]
    assert values(spark, ["  a   b \n\n c "], "x string", T.diff_lines(F.col("x"))) == [["a b", "c"]]
    assert values(spark, [("t", "<p>x</p>")], "h string, b string", T.wrap_fragment(F.col("h"), F.col("b"))) == ["<article><h1>t</h1><p>x</p></article>"]
    body = spark.createDataFrame([("<h2>§ 1.1 A</h2><h2>§ 2.2</h2>", {"1.1": "s-1"})], "b string, m map<string,string>")
    assert body.select(xmltext.inject_anchors("b", "m")).first()[0] == '<h2 id="s-1">§ 1.1 A</h2><h2>§ 2.2</h2>'


def test_measurements_keep_their_invariants(spark):
    df = spark.createDataFrame([(5, 100), (7, 99_999_999)], "w bigint, b bigint")
    m = df.select(M.reject_by_size(F.col("b"), M.counted(F.col("w"))).alias("m")).unionByName(df.limit(1).select(M.not_computed().alias("m"))).unionByName(df.limit(1).select(M.reserved_empty().alias("m"))).select("m.*")
    assert M.violations(m).count() == 0
    assert sorted(r.status for r in m.collect()) == ["counted", "not_computed", "reserved_empty", "unavailable_too_large"]
    with pytest.raises(Exception, match="negative count"):
        df.select(M.counted(-F.col("w"))).collect()
    assert values(spark, ["a\U0001f600"], "x string", M.utf16_units(F.col("x"))) == [3]


def test_all_or_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", None)], "k string, w bigint")
    assert {r.k: r.s for r in df.groupBy("k").agg(M.all_or_nothing(F.col("w")).alias("s")).collect()} == {"a": 3, "b": None}
    assert df.limit(0).agg(M.all_or_nothing(F.col("w"))).first()[0] is None


def test_dates(spark):
    d = F.to_date("x")
    assert [str(v) for v in values(spark, ["2026-03-31", "2024-02-29"], "x string", S.window_start(d))] == ["2023-04-01", "2021-03-01"]
    assert values(spark, ["2023-02-29", "2024-02-29", "2016-12-31", "x", None], "x string", C.is_issue_date(F.col("x"))) == [False, True, False, False, False]


def test_edits_are_minimal():
    r = random.Random(12345)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 18))] for _ in range(2))
        e = linediff.edits(a, b)
        assert [x[3] for x in e if x[0] != "insert"] == a and [x[3] for x in e if x[0] != "delete"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(x[0] == "equal" for x in e) == best[-1][-1]


def test_hunks(spark):
    old = [str(i) for i in range(20)]
    new = old[:3] + ["x"] + old[3:10] + old[11:]
    p = spark.createDataFrame([(1, old, new, False, False), (2, old, old, False, False), (3, None, new, False, False), (4, None, None, False, False), (5, old, new, True, False)], "k int, old_lines array<string>, new_lines array<string>, old_failed boolean, new_failed boolean")
    c = diffs.compare(p)
    assert [r.status for r in c.orderBy("k").collect()] == ["modified", "unchanged", "added", "unavailable", "unavailable"]
    h = [(r.hunk, r.old_start, r.old_count, r.new_start, r.new_count, r.added, r.removed) for r in diffs.hunks(c, "k", 1).orderBy("hunk").collect()]
    assert h == [(0, 3, 2, 3, 3, 1, 0), (1, 10, 3, 11, 2, 0, 1)]
    assert diffs.hunks(c, "k", 4).count() == 1


def test_page_packing(spark):
    items = [("a", i, 4) for i in range(5)] + [("b", 0, 99)]
    df = spark.createDataFrame(items, "p string, i int, s bigint")
    got = [(r.p, r.unit, r.ids, r.bytes, r.oversized) for r in packing.pack_siblings(df, "p", "i", "s", "i", target=10, oversized=50).orderBy("p", "unit").collect()]
    assert got == [("a", 0, ["0", "1"], 8, False), ("a", 1, ["2", "3"], 8, False), ("a", 2, ["4"], 4, False), ("b", 0, ["0"], 99, True)]


XML = """<DIV5 N="51" TYPE="PART"><HEAD>PART 51</HEAD><AUTH><HED>Authority:</HED><P>5 U.S.C.</P></AUTH><P>Own <I>wo</I>rds.</P>
<DIV8 N="§ 51.1" TYPE="SECTION"><HEAD>§ 51.1 Scope.</HEAD><P>One&nbsp;two.</P><P>Three</P><CITA>[1 FR 2]</CITA></DIV8><DIV8 N="51.2" TYPE="SECTION"><HEAD>[Reserved]</HEAD></DIV8></DIV5>"""


def test_xml_nodes(spark):
    n = xmltext.xml_nodes(spark.createDataFrame([("f", XML), ("g", "<broken"), ("h", None)], "path string, content string"))
    got = [(r.citation, r.words, r.own, r.left_out, r.reserved) for r in n.select("citation", T.count_words(F.col("text")).alias("words"), T.count_words(F.col("own_text")).alias("own"), T.count_words(F.col("excluded_text")).alias("left_out"), "reserved").collect()]
    assert got == [("part-51", 5, 2, 11, False), ("part-51/section-51.1", 3, 3, 5, False), ("part-51/section-51.2", 0, 0, 1, True)]


def test_xml_rendering_and_lines():
    r = xmltext.to_html(XML)
    assert r["heading"] == "PART 51" and r["authority"] == "5 U.S.C." and "<p>Own <em>wo</em>rds.</p>" in r["html"]
    assert xmltext.section_lines(XML, "51.1") == (["§ 51.1 Scope.", "One two.", "Three", "[1 FR 2]"], True, True)
    assert xmltext.section_lines(XML, "9")[1:] == (False, True) and xmltext.to_html("<x") is None


def test_character_references_of_html_end_with_their_semicolon():
    cases = {"a &quot b": "a &quot b", "a &quot; b": 'a " b', "R&amp": "R&amp", "&copy; &#65; &#x42; &#65 &notit; &no; & &&lt;": "© A B &#65 &notit; &no; & &<", "<p title='&lt'>x &lt</p>": "x &lt", "\ufdd0 &gt y": "\ufdd0 &gt y"}
    assert {k: xmltext._Html(k) for k in cases} == cases


def test_pieces_of_a_batch_are_small_and_whole():
    import pyarrow as pa

    b = pa.record_batch({"k": pa.array(range(5000)), "t": pa.array(["x" * (100_000 if k == 7 else 200) for k in range(5000)])})
    parts = list(batches.slices(b, 50_000, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert all(p.nbytes <= 50_000 or len(p) == 1 for p in parts) and [len(p) for p in parts if p.nbytes > 50_000] == [1]


def test_python_yields_pieces_of_a_batch_and_not_the_batch():
    """Before, all edits and all nodes of a batch of 10,000 rows were in memory at once."""
    import pyarrow as pa

    lines = pa.array([["a", "b"], None, ["c"], []] * 2000)
    got = list(linediff.line_diff.func(iter([(lines, pa.array([["a"], ["b"], None, ["d"]] * 2000))])))
    assert max(map(len, got)) <= batches.SLICE_ROWS and sum(map(len, got)) == 8000
    e = lambda op, i, j, x: {"op": op, "old_index": i, "new_index": j, "text": x}
    assert [x for a in got for x in a.to_pylist()] == [[e("equal", 0, 0, "a"), e("delete", 1, None, "b")], None, None, [e("insert", None, 0, "d")]] * 2000


def test_nodes_of_a_batch_come_in_pieces():
    import pyarrow as pa

    docs = pa.record_batch({"k": pa.array(range(5000)), "x": pa.array([f"<DIV5 N='{k}'><P>one two</P></DIV5>" if k % 10 else None for k in range(5000)])})
    got = list(xmltext.node_batches(iter([docs]), ["k"], "x", failures=True))
    assert max(map(len, got)) <= batches.SLICE_ROWS
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["k"], r["node_type"], r["citation"]) for r in rows] == [(k, "part", f"part-{k}") if k % 10 else (k, "failed", None) for k in range(5000)]
    assert {r["text"].split()[0] for r in rows if r["citation"]} == {"one"}
