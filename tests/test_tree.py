"""Roll-up against a recursive version, flattening, closure, nesting."""

import json
import random

from plumbline.operators import tree as T

NODES = "citation string, parent_citation string, direct struct<words:bigint,known:boolean>, own struct<words:bigint,known:boolean>, reserved boolean, xml_bytes bigint"


def recursive(nodes):
    kids = {}
    for c, n in nodes.items():
        kids.setdefault(n[0], []).append(c)
    out = {}

    def value(m):
        return m[0] if m[1] else None

    def walk(c):
        _, direct, own, reserved, size = nodes[c]
        below = [walk(k) for k in kids.get(c, [])]
        if direct:
            out[c] = value(direct)
        elif below:
            parts = below + ([value(own)] if own else [])
            out[c] = None if None in parts else sum(parts)
        elif own:
            out[c] = value(own)
        else:
            out[c] = 0 if reserved or size == 0 else None
        return out[c]

    for c in kids.get(None, []):
        walk(c)
    return out


def test_roll_up_of_random_trees(spark):
    r = random.Random(6)
    nodes = {}
    for t in range(300):
        paths = [f"t-{t}"]
        nodes[paths[0]] = None
        for k in range(r.randint(0, 9)):
            p = r.choice(paths)
            paths.append(f"{p}/n-{k}")
        for p in paths:
            measure = lambda q: (r.randint(0, 9), True) if r.random() < q else (None, False) if r.random() < 0.15 else None
            leaf = not any(x.startswith(p + "/") for x in paths)
            nodes[p] = (p.rpartition("/")[0] or None, measure(0.7 if leaf else 0.12), measure(0.3), r.random() < 0.1, r.choice([None, 0, 5]))
    rows = [(c, *n) for c, n in nodes.items()]
    got = {x.citation: (x.words, x.status, x.reason) for x in T.roll_up(spark.createDataFrame(rows, NODES)).collect()}
    want = recursive(nodes)
    assert {c: v[0] for c, v in got.items()} == want
    assert all((v[0] is None) == (v[2] is not None) for v in got.values())


def test_flatten_structure(spark):
    small = {"type": "title", "identifier": "3", "children": [{"type": "chapter", "identifier": "I", "size": 9, "children": [{"type": "part", "identifier": "1", "reserved": True}, {"type": "appendix", "label": "x"}]}, {"type": "chapter", "identifier": "II"}]}
    got = T.flatten_structure(spark.createDataFrame([(json.dumps(small),), (None,)], "json string")).collect()
    assert [(r.citation, r.depth, r.ordinal, r.doc_pos) for r in got] == [
        ("title-3", 0, 0, 0), ("title-3/chapter-I", 1, 0, 1), ("title-3/chapter-I/part-1", 2, 0, 2), ("title-3/chapter-I/appendix-@1", 2, 1, 3), ("title-3/chapter-II", 1, 1, 4),
    ]


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("a", None)], "child string, parent string")
    got = sorted((r.ancestor, r.descendant) for r in T.closure(e).collect())
    assert got == sorted([(v, v) for v in "abcxy"] + [("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("y", "x")])


def test_forest_and_containers(spark):
    rows = [("a", None, 0, 0), ("a/b", "a", 1, 1), ("a/b/c", "a/b", 2, 2), ("a/d", "a", 1, 3)]
    f = T.forest(spark.createDataFrame(rows, "citation string, parent_citation string, depth int, doc_pos int"), 2).collect()
    assert len(f) == 1 and [k.citation for k in f[0].children] == ["a/b", "a/d"] and f[0].children[0].children[0].citation == "a/b/c"
    n = T.nearest_container(spark.createDataFrame([("a",), ("a/b/c",), ("a/b/c/d",), ("ab",)], "citation string"))
    assert {r.citation: r.container for r in n.collect()} == {"a": None, "a/b/c": "a", "a/b/c/d": "a/b/c", "ab": None}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(150)], "child int, parent int")
    got = T.closure(edges)
    assert got.count() == 151 * 152 // 2 and got.filter("ancestor = 0 and descendant = 150").count() == 1
    loop = T.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "child int, parent int"))
    assert loop.count() == 10 and loop.distinct().count() == 10
