"""The pipeline's stages, each against what it was given."""

import os
import random
from collections import Counter

import corpus_pipeline
from plumbline.llm import jaccard_join, quality_rules, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_and_their_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [Counter(r.doc_id for r in s.select("doc_id").collect()) for s in seen]
    rejected = {r.doc_id for r in quality_rules.score(docs).collect() if r.verdict != "keep"}
    assert set(ids[1]) == set(ids[0]) - rejected
    assert set(ids[2]) < set(ids[1]) and not jaccard_join.join(seen[2]).count()
    assert ids[3] == ids[2]
    assert {r.doc_id: r.text for r in seen[3].collect()} == {r.doc_id: secret_scan.mask(r.text) for r in seen[2].collect()}
    assert sum(ids[4].values()) == sum(ids[3].values())
    words = sum(len(r.text.split()) for r in seen[4].collect())
    assert sum(r.n_words for r in seen[5].collect()) == words
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    again = corpus_pipeline.run(spark, sf)
    assert again.columns == seen[5].columns and again.count() == seen[5].count()
    assert len(set(os.listdir(folder)) - before) == 1, "of a run its result alone is left"


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, blanks, a very long text, copies, repeated rows, names that the stages use themselves."""
    r = random.Random(1)
    prose = lambda n: " ".join(r.choice(["al", "be", "ga", "de", "ep"]) + r.choice(["pha", "ta", "mma", "lta", "silon"]) + r.choice(["", "s", "ing", "ed"]) for _ in range(n))
    long, some = prose(30_000), [prose(90) for _ in range(4)]
    secret = "0123456789abcdef0123456789abcdef01234567"
    rows = [
        (1, some[0], "en", "a", 5), (1, some[0], "en", "a", 5), (2, some[0], "en", "b", 5), (None, some[0], "en", "a", 5), (3, None, "en", "a", None), (4, "", None, None, None), (5, " \n\t", "en", "a", 3), (None, None, None, None, None),
        (6, long, "en", "a", len(long)), (7, some[1], None, None, None), (8, some[2] + f' token = "{secret}"', "en", "a", -1), (9, some[3], "de", "c", 0),
    ]
    rows += [(100 + i, prose(r.randint(60, 200)), "en", r.choice("abc"), 500) for i in range(60)]
    schema = DOCS + ", _pl_h string, _PL_S int, cls string, window_id int, copy_no string"
    docs = spark.createDataFrame([(*r, "h", 2, "c", 3, "n") for r in rows], schema)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            break
        assert out.columns == docs.columns
        assert {(r["_pl_h"], r["_PL_S"], r.cls, r.window_id, r.copy_no) for r in out.collect()} == {("h", 2, "c", 3, "n")}
        kept.append(Counter(r.doc_id for r in out.collect()))
        docs = out
    usual = Counter(range(100, 160))
    assert kept[0] == Counter({1: 2, 2: 1, None: 1, 6: 1, 7: 1, 8: 1, 9: 1}) + usual
    assert kept[1] == kept[2] == Counter([1, None, 6, 7, 8, 9]) + usual
    assert sum(kept[3].values()) == 66
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += r.n_words
    assert got == Counter({i: n * kept[3][i] for i, n in words.items()})  # whole texts
    assert secret not in " ".join(r.text for r in docs.collect())


def test_stages_on_no_rows(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
