"""Division of claimed words; values from the rules: shares add up, an unknown is never a zero."""

import pytest

from plumbline.operators import jurisdiction as J
from plumbline.operators import tree as T

NODE = "citation string, node_type string, identifier string, title int, subtitle string, chapter string, subchapter string, part string, words bigint"


def node(path, words):
    levels = dict(x.split("-", 1) for x in path.split("/"))
    kind, ident = path.split("/")[-1].split("-", 1)
    return (path, kind, ident, int(levels["title"]), None, levels.get("chapter"), levels.get("subchapter"), levels.get("part"), words)


TREE = {"title-42": 1000, "title-42/chapter-I": 600, "title-42/chapter-I/subchapter-A": 300, "title-42/chapter-I/subchapter-A/part-1": 100, "title-42/chapter-I/subchapter-A/part-2": 200, "title-42/chapter-I/subchapter-B": 300, "title-42/chapter-I/subchapter-B/part-3": 300, "title-42/chapter-II": 400, "title-42/chapter-II/part-4": 400}


def divide(spark, claims, tree=TREE):
    nodes = spark.createDataFrame([node(p, w) for p, w in tree.items()], NODE)
    rows = []
    for slug, paths in claims.items():
        for p in paths:
            levels = dict(x.split("-", 1) for x in p.split("/"))
            rows.append((slug, p, int(levels["title"]), levels.get("subtitle"), levels.get("chapter"), levels.get("subchapter"), levels.get("part")))
    c = spark.createDataFrame(rows, "slug string, ref_key string, title int, subtitle string, chapter string, subchapter string, part string")
    a = spark.createDataFrame([(s, s.title()) for s in claims], "slug string, sortable_name string")
    return J.divide(a, c, nodes), c, nodes


I, A, P1 = "title-42/chapter-I", "title-42/chapter-I/subchapter-A", "title-42/chapter-I/subchapter-A/part-1"


@pytest.mark.parametrize(
    ("claims", "want", "corpus"),
    [
        ({"alpha": [I], "beta": [P1]}, {"alpha": 550, "beta": 50}, 600),
        ({"alpha": [I], "beta": [A], "gamma": [P1]}, {"alpha": 434, "beta": 133, "gamma": 33}, 600),
        ({"alpha": [I], "beta": [I], "gamma": [P1]}, {"alpha": 284, "beta": 283, "gamma": 33}, 600),
        ({"alpha": ["title-42/chapter-IX"], "beta": [P1]}, {"alpha": 0, "beta": 100}, 100),
        ({"alpha": [I, P1], "beta": []}, {"alpha": 600, "beta": 0}, 600),
    ],
)
def test_shares_add_up(spark, claims, want, corpus):
    d, _, _ = divide(spark, claims)
    assert {r.slug: r.deduplicated for r in d.agencies.collect()} == want
    assert d.corpus.first().words == corpus == sum(want.values())


def test_unknown_is_never_zero(spark):
    tree = TREE | {"title-42/chapter-II/part-4": None}
    d, _, _ = divide(spark, {"alpha": ["title-42/chapter-II"], "beta": ["title-42/chapter-II/part-4"]}, tree)
    assert {r.slug: r.deduplicated for r in d.agencies.collect()} == {"alpha": None, "beta": None}
    assert d.corpus.first().words is None


def test_overlaps_coverage_and_diagnostics(spark):
    d, c, nodes = divide(spark, {"alpha": [I], "beta": [I, "title-42/chapter-IX"], "gamma": [P1]})
    assert [(r.ref_key, r.agency_count, r.agency_slugs) for r in d.overlaps.collect()] == [(I, 2, '["alpha","beta"]')]
    a = {r.slug: r for r in d.agencies.collect()}
    assert (a["beta"].refs_total, a["beta"].refs_counted, a["beta"].shared_refs, a["beta"].coverage) == (2, 1, 1, 0.5)
    found = J.resolve(c, nodes)
    x = J.diagnostics(c, found, d.regions).first()
    assert (x.distinct_scopes, x.dangling, x.ambiguous, x.nested_pairs) == (3, 1, 0, 1)
    edges = spark.createDataFrame([("alpha", None), ("beta", "alpha"), ("gamma", "beta")], "child string, parent string")
    s = {r.slug: (r.attributed, r.deduplicated) for r in J.subtree_totals(d, T.closure(edges), c, found).collect()}
    assert s == {"alpha": (600, 600), "beta": (600, 316), "gamma": (100, 33)}


def test_wildcards_can_be_ambiguous(spark):
    tree = {"title-1": 10, "title-1/chapter-I": 5, "title-1/chapter-I/part-7": 5, "title-1/chapter-II": 5, "title-1/chapter-II/part-7": 5}
    d, c, nodes = divide(spark, {"alpha": ["title-1/part-7"], "beta": ["title-1/chapter-II/part-7"]}, tree)
    assert {r.ref_key: r.outcome for r in J.resolve(c, nodes).collect()} == {"title-1/part-7": "ambiguous", "title-1/chapter-II/part-7": "resolved"}
    assert {r.slug: r.deduplicated for r in d.agencies.collect()} == {"alpha": None, "beta": 5}


def test_containment_joins(spark):
    _, c, _ = divide(spark, {"alpha": [I], "beta": [P1, "title-42"]})
    parts = spark.createDataFrame([("p1", 42, None, "I", "A", "1"), ("p4", 42, None, "II", None, "4")], "part_key string, title int, subtitle string, chapter string, subchapter string, part string")
    assert sorted((r.part_key, r.slug) for r in J.covering(parts, c).collect()) == [("p1", "alpha"), ("p1", "beta"), ("p4", "beta")]
    ch = spark.createDataFrame([("c1", 42, None, "I", None, None)], "chapter_key string, title int, subtitle string, chapter string, subchapter string, part string")
    assert sorted(r.ref_key for r in J.related(ch, c).collect()) == ["title-42", I, P1]
