"""Readers, table maintenance, publishing, streams, and the registered queries."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import queries as Q
from plumbline.operators import series
from plumbline.plans import delta
from plumbline.sources import readers, tables
from plumbline.streaming import incremental


def test_agencies_and_claims(spark, tmp_path):
    ref = [{"title": 40, "chapter": "I"}, {"title": 40, "chapter": "I", "extra": 1}]
    doc = {"agencies": [{"slug": "a", "name": "A", "cfr_references": ref, "children": [{"slug": "b", "name": "B", "cfr_references": [{"title": 2, "part": ""}]}]}, {"slug": "a", "name": "again", "cfr_references": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    a = readers.agencies(spark, str(tmp_path / "a.json"))
    assert sorted((r.slug, r.parent_slug, r.depth, r.display_name) for r in a.collect()) == [("a", None, 0, "A"), ("b", "a", 1, "B")]
    assert sorted((r.slug, r.ref_key) for r in readers.claims(a).collect()) == [("a", "title-40/chapter-I"), ("b", "title-2")]


def test_titles_and_versions(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"titles": [{"number": 1, "name": "x", "reserved": False}], "meta": {"date": "2024-01-01", "import_in_progress": True}}))
    assert readers.titles(spark, str(tmp_path / "t.json")).first().import_in_progress
    v = lambda i: {"identifier": i, "amendment_date": "2024-01-01", "issue_date": "2024-01-02", "part": "1", "title": "1", "removed": False, "substantive": True}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/1.json").write_text(json.dumps({"content_versions": [v("1.1"), v("1.2")], "meta": {"total_pages": "2"}}))
    (tmp_path / "v/2.json").write_text(json.dumps({"content_versions": [v("1.2"), v("1.3")], "meta": {"total_pages": "2"}}))
    pages = readers.versions(spark, str(tmp_path / "v"))
    assert sorted(r.identifier for r in readers.merge_pages(pages).collect()) == ["1.1", "1.2", "1.3"]
    (tmp_path / "v/3.json").write_text((tmp_path / "v/1.json").read_text())
    with pytest.raises(Exception, match="repeated"):
        readers.merge_pages(readers.versions(spark, str(tmp_path / "v"))).collect()


def test_files_and_choice(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.xml").write_text("<P>a</P>")
    (tmp_path / "x/b.xml").write_text("<P>" + "b" * 100 + "</P>")
    assert sorted((r.content, r.too_large) for r in readers.xml_files(spark, str(tmp_path / "x"), 50).fillna("").collect()) == [("", True), ("<P>a</P>", False)]
    assert [r.key for r in readers.objects(spark, str(tmp_path / "x"), "b").collect()] == ["b.xml"]
    assert readers.choose(snapshot_dir="/s") == ("snapshot", "/s") and readers.choose() == ("fixture", None)
    with pytest.raises(ValueError):
        readers.choose(database="relative")


def test_refused_gate_leaves_the_pointer(spark, tmp_path):
    w = tables.Warehouse(spark, str(tmp_path / "w"))
    one, two = spark.range(3).toDF("n"), spark.range(1).toDF("n")
    stats = lambda n: spark.createDataFrame([(n, 5, 5, 0)], "total_words bigint, agency_count int, title_count int, uncounted_nodes int")
    assert w.read("t") is None
    assert delta.publish_if(w, 1, {"t": one}, delta.gate(stats(100), stats(100).limit(0)))
    assert w.read("t").count() == 3
    assert not delta.publish_if(w, 2, {"t": two}, delta.gate(stats(50), stats(100)))
    assert w.pointer()["run"] == 1 and w.read("t").count() == 3
    assert delta.publish_if(w, 3, {"t": two}, delta.gate(stats(103), stats(100)))
    assert w.read("t").count() == 1
    assert sorted((r.id, r.status) for r in w.ledger().collect()) == [(1, "published"), (2, "refused"), (3, "published")]
    with pytest.raises(ValueError):
        w.publish(9, ["t"])


def test_export_withholds_accounts(spark, tmp_path):
    done = tables.export({"title": spark.range(2), "api_key": spark.range(1)}, str(tmp_path / "e"))
    assert done == ["title"] and not (tmp_path / "e/api_key").exists()
    assert tables.export_manifest(spark, str(tmp_path / "e")).agg(F.sum("length")).first()[0] > 0


def test_truncation_flag(spark):
    df = spark.range(5)
    assert [r.truncated for r in series.limited(df, 5, F.col("id")).collect()] == [False] * 5
    assert [r.truncated for r in series.limited(df, 4, F.col("id")).collect()] == [True] * 4


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "a") for s in range(0, 20, 2)] + [("2024-01-01 00:00:04", "b")] * 7
    df = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, mode):
    out = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def test_streamed_rate_limit_equals_batch(spark, stream, tmp_path):
    table, live = stream
    want = sorted((r.k, str(r.ts), r.granted) for r in incremental.rate_limited_batch(table, "k", "ts", 0.25, 2).collect())
    got = sorted((r.k, str(r.ts), r.granted) for r in drain(incremental.rate_limited(live, "k", "ts", 0.25, 2), tmp_path, "append"))
    assert got == want and any(g for *_, g in want) and not all(g for *_, g in want)


def test_streamed_quota_equals_batch(spark, stream, tmp_path):
    table, live = stream
    want = sorted(map(tuple, series.quota(table, "k", "ts", 6).collect()))
    assert sorted(map(tuple, drain(incremental.quota(live, "k", "ts", 6), tmp_path, "update"))) == want


def test_streamed_deduplication(spark, stream, tmp_path):
    table, live = stream
    assert len(drain(incremental.distinct_versions(live, "ts", ["ts", "k"]), tmp_path, "append")) == table.distinct().count()


def cell(v):
    return "∅" if v is None or v is pd.NaT or v != v else f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("part", range(4))
def test_queries_equal_their_sql(spark, sf, part):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    heavy = {"g05_exclusive_regions", "g09_coverage", "g10_overlaps", "g11_corpus_total", "g28_shared_statistics"}  # the same division as g04 and g12
    for name in sorted(set(Q.ORACLES) - heavy)[part::4]:
        df = Q.QUERIES[name](spark, sf)
        cur = c.execute(Q.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns), name
        order = sorted(names)
        want = sorted(tuple(cell(r[names.index(k)]) for k in order) for r in cur.fetchall())
        assert sorted(tuple(cell(r[k]) for k in order) for r in df.collect()) == want, name


def test_xml_files_as_they_land(spark, tmp_path):
    land = tmp_path / "xml"
    land.mkdir()
    (land / "1.xml").write_text("<A>é</A>")
    (land / "2.xml").write_text("<B>" + "x" * 100 + "</B>")
    q = readers.xml_stream(spark, str(land), limit=50).writeStream.format("memory").queryName("landed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.too_large) for r in spark.table("landed").collect()}
    assert got == {"1.xml": ("<A>é</A>", False), "2.xml": (None, True)}


def test_ledger_keeps_runs_that_never_ended(spark, tmp_path):
    w = tables.Warehouse(spark, str(tmp_path / "w"))
    w.record(1, "backfill", "running")
    w.record(1, "backfill", "published", tables=3)
    w.record(2, "delta", "running")
    assert [(r.id, r.status) for r in w.ledger().orderBy("id").collect()] == [(1, "published"), (2, "running")]


def test_new_keys_are_random_and_parse(spark):
    from plumbline.functions import credentials

    rows = spark.range(50).select(credentials.new_key("pk").alias("k")).select("k.*", credentials.parse_key(F.col("k.plaintext"), "pk")["id"].alias("back")).collect()
    assert all(r.id == r.back and len(r.hash) == 64 and r.plaintext.endswith(r.suffix) for r in rows) and len({r.plaintext for r in rows}) == 50
