"""Loads end to end, and the reads over what they publish."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import load, reads
from plumbline.sources.tables import Warehouse

PART = '<DIV5 N="{n}" TYPE="PART"><HEAD>Part {n}</HEAD><P>own text</P><DIV8 N="{n}.1" TYPE="SECTION"><HEAD>x</HEAD><P>{a}</P></DIV8>{b}</DIV5>'
SECOND = '<DIV8 N="{n}.2" TYPE="SECTION"><P>{t}</P></DIV8>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("land")
    (f / "agencies.json").write_text(json.dumps({"agencies": [
        {"slug": "alpha", "name": "Alpha Office", "sortable_name": "Alpha", "cfr_references": [{"title": 1, "chapter": "I"}], "children": []},
        {"slug": "beta", "name": "Beta Bureau", "sortable_name": "Beta", "cfr_references": [{"title": 1, "chapter": "I", "part": "2"}], "children": [{"slug": "gamma", "name": "Gamma", "sortable_name": "Gamma", "cfr_references": []}]},
    ]}))
    (f / "titles.json").write_text(json.dumps({"titles": [{"number": 1, "name": "General Matters", "reserved": False}], "meta": {"date": "2024-01-01", "import_in_progress": False}}))
    leaf = lambda n, **k: {"type": "section", "identifier": n, "label": f"§ {n}", "size": 10} | k
    (f / "structure").mkdir()
    (f / "structure/1.json").write_text(json.dumps({"type": "title", "identifier": "1", "label": "Title 1", "children": [{"type": "chapter", "identifier": "I", "label": "Chapter I", "children": [
        {"type": "part", "identifier": "1", "label": "Part 1 Scope", "size": 50, "children": [leaf("1.1"), leaf("1.2", reserved=True)]}, {"type": "part", "identifier": "2", "label": "Part 2", "size": 60, "children": [leaf("2.1"), leaf("2.2")]},
    ]}]}))
    (f / "xml").mkdir()
    (f / "xml/1.xml").write_text(PART.format(n=1, a="one two three", b=""))
    (f / "xml/2.xml").write_text(PART.format(n=2, a="four five", b=SECOND.format(n=2, t="six")))
    return f


def test_backfill_then_delta_then_reads(spark, folder, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    inputs = load.read_inputs(spark, str(folder))
    assert load.backfill(w, inputs, 1)
    t = {n: w.read(n) for n in w.pointer()["tables"]}
    words = {r.citation: r.words for r in t["structure_node"].collect()}
    assert words == {
        "title-1": 10, "title-1/chapter-I": 10, "title-1/chapter-I/part-1": 5, "title-1/chapter-I/part-1/section-1.1": 3, "title-1/chapter-I/part-1/section-1.2": 0,
        "title-1/chapter-I/part-2": 5, "title-1/chapter-I/part-2/section-2.1": 2, "title-1/chapter-I/part-2/section-2.2": 1,
    }
    assert {r.agency_slug: r.deduplicated for r in t["agency_rollup"].collect()} == {"alpha": 8, "beta": 2, "gamma": 0}
    assert t["corpus"].first().words == 10

    assert [(r.slug, r.words, r.total) for r in reads.agencies(t, sort="words", limit=2).collect()] == [("alpha", 8, 3), ("beta", 2, 3)]
    assert [r.slug for r in reads.agencies(t, top_only=True, q="BUREAU", title=1).collect()] == ["beta"]
    assert [(r.ref_key, r.words, r.agency_count) for r in reads.agency(t, "beta").collect()] == [("title-1/chapter-I/part-2", 5, 1)]
    assert [(r.relation, r.slug) for r in reads.family(t, "gamma").collect()] == [("parent", "beta")]
    assert [(r.number, r.words, r.parts, r.sections) for r in reads.titles(t).collect()] == [(1, 10, 2, 4)]
    assert [(r.citation, r.truncated) for r in reads.structure(t, "title-1/chapter-I", 1, 2).collect()] == [("title-1/chapter-I", True), ("title-1/chapter-I/part-1", True)]
    p = reads.part(t, 1, "2").first()
    assert (p.words, p.sections, p.agencies) == (5, 2, ["alpha", "beta"])
    assert [(r.kind, r.id) for r in reads.search(t, "1 CFR part 2").collect()] == [("citation", "title-1/chapter-I/part-2")]
    assert [r.kind for r in reads.search(t, "part").collect()] == ["node", "node"]
    c = reads.corpus(t).first()
    assert (c.nodes, c.unknown, c.reserved, c.deduplicated, c.titles) == (8, 0, 1, 10, 1)
    assert reads.quality(t).count() == 0 and reads.overlap(t).count() == 0

    # a changed part alone is measured again
    (folder / "xml/2.xml").write_text(PART.format(n=2, a="four five more", b=SECOND.format(n=2, t="six")))
    (folder / "xml/1.xml").write_text("<broken")
    amended = spark.createDataFrame([("title-1/chapter-I/part-2",)], "citation string")
    assert not load.incremental(w, load.read_inputs(spark, str(folder)), amended, 2), "one word in ten is more than the drift allowed"
    assert w.pointer()["run"] == 1
    (folder / "xml/2.xml").write_text(PART.format(n=2, a="four FIVE", b=SECOND.format(n=2, t="six")))
    assert load.incremental(w, load.read_inputs(spark, str(folder)), amended, 3)
    assert {r.citation: r.words for r in w.read("structure_node").collect()} == words

    # a full load with unreadable XML would make known words unknown: refused
    assert not load.backfill(w, load.read_inputs(spark, str(folder)), 4)
    assert w.pointer()["run"] == 3
    assert [r.status for r in w.ledger().orderBy("id").collect()] == ["published", "refused", "published", "refused"]


def test_amendment_pages(spark):
    rows = [(1, "1.1", "1", "2024-01-01", f"2024-01-{d:02d}", d % 2 == 0, d == 4) for d in range(1, 8)]
    t = {"amendment": spark.createDataFrame(rows, "title int, section string, part string, amendment_date string, issue_date string, substantive boolean, removed boolean")}
    got = reads.amendments(t, title=1, since="2024-01-02", substantive=True, limit=2)
    assert [(r.issue_date, r.total) for r in got.collect()] == [("2024-01-06", 2), ("2024-01-02", 2)]
    assert got.filter(F.col("removed")).count() == 0


def test_measure_keeps_titles_apart(spark):
    """Two titles of equal part and section numbers, told apart by their files' paths or by the documents themselves."""
    from plumbline.functions.xmltext import xml_nodes
    from plumbline.operators import tree

    def structure(n):
        return [(f"title-{n}", None, "title", str(n)), (f"title-{n}/part-1", f"title-{n}", "part", "1"), (f"title-{n}/part-1/section-1.1", f"title-{n}/part-1", "section", "1.1")]

    nodes = spark.createDataFrame([(*r, False, 9) for n in (1, 2, 3, 4) for r in structure(n)], "citation string, parent_citation string, node_type string, identifier string, reserved boolean, xml_bytes long")
    files = [("land/title-1/a.xml", PART.format(n=1, a="one two three", b="")), ("land/b.xml", f'<DIV1 N="2" TYPE="TITLE">{PART.format(n=1, a="a b c d e f g", b="")}</DIV1>'), ("land/title=3/c.xml", "<broken"), ("land/d.xml", PART.format(n=1, a="of no title", b=""))]
    xml = xml_nodes(spark.createDataFrame(files, "path string, content string"), failures=True)
    got = {r.citation: (r.words, r.status) for r in tree.roll_up(load.measure(nodes, xml)).collect()}
    assert got["title-1/part-1/section-1.1"] == (3, "counted") and got["title-2/part-1/section-1.1"] == (7, "counted")
    assert got["title-1"][0] == 5 and got["title-2"][0] == 9
    assert got["title-3/part-1/section-1.1"] == (None, "unavailable_parse_failed") and got["title-3"] == (None, "not_computed")
    assert got["title-4/part-1/section-1.1"] == (None, "not_computed")


def test_search_by_name_and_citation(spark):
    node = [
        ("title-1", "title", "1", "Title 1 water"), ("title-1/subtitle-A", "subtitle", "A", "Subtitle A water"), ("title-1/chapter-I", "chapter", "I", "Chapter I Water"), ("title-1/chapter-I/subchapter-B", "subchapter", "B", "Subchapter B water"),
        ("title-1/chapter-I/subchapter-B/part-2", "part", "2", "Part 2 water"), ("title-1/chapter-I/subchapter-B/part-2/section-2.1", "section", "2.1", "water"), ("title-1/chapter-I/part-3", "part", "3", None),
    ]
    t = {
        "structure_node": spark.createDataFrame(node, "citation string, node_type string, identifier string, label string"),
        "agency": spark.createDataFrame([("w", "Bureau of Water", "BOW", "Bureau", "Water, Bureau of"), ("x", "Water Office", None, "Water Office", "Z"), ("y", "Air", "WATERY", "Air", "Air")], "slug string, name string, short_name string, display_name string, sortable_name string"),
        "title": spark.createDataFrame([(2, "Water", False), (1, "On water", False)], "number int, name string, reserved boolean"),
    }
    ids = lambda q, **k: [r.id for r in reads.search(t, q, **k).collect()]
    nodes = ["title-1/chapter-I", "title-1/chapter-I/subchapter-B", "title-1/subtitle-A", "title-1/chapter-I/subchapter-B/part-2"]
    assert ids("WATER") == ["x", "y", "w", "title-1", "title-2", *nodes]
    assert ids("water", limit=3) == ["x", "y", "w"] and ids("water", kind="node") == nodes and ids("1 CFR part 2", kind="agency") == []
    assert ids("1 cfr subch. b") == [nodes[1]] and ids("1 CFR Subtitle a") == ["title-1/subtitle-A"] and ids("1 CFR § 2.1") == ["title-1"] and ids("title-1/chapter-i") == ["title-1/chapter-I"]
    assert ids("9 CFR 1") == [] and ids("50%") == []
