"""Trees of digests against a plain recursion."""

from __future__ import annotations

import random

from conftest import rows
from tallyloom.operators import tree
from tallyloom.sources.lake import Stage

SCHEMA = "path string, kind string, content string"


def made(rng, n=40):
    out = {}
    for _ in range(n):
        path = "".join(f"/{rng.choice('abc')}" for _ in range(rng.randrange(1, 4)))
        out[path] = (rng.choice(["file", "link"]), rng.choice("xyz"))
    # A leaf can't hold others.
    return {p: v for p, v in out.items() if not any(q.startswith(f"{p}/") for q in out)}


def nodes(found):
    """Every node with all that is below it."""
    out = {}
    for path, value in found.items():
        parts = path.split("/")
        for i in range(1, len(parts)):
            out.setdefault("/".join(parts[:i]), set()).add((path, value))
        out[path] = {("", value)}
    return {p: frozenset(v) for p, v in out.items()}


def frame(spark, found):
    return spark.createDataFrame([(p, *v) for p, v in found.items()], SCHEMA).repartition(3)


def test_changes_match_a_recursion(spark):
    rng = random.Random(1)
    before = made(rng)
    after = {p: v for p, v in before.items() if rng.random() > 0.1}
    after = {p: (v if rng.random() > 0.1 else (v[0], "other")) for p, v in after.items()} | {"/new/place": ("file", "n"), "/a/q": ("dir", "")}
    b, a = nodes(before), nodes(after)
    expected = {p: "added" if p not in b else "removed" if p not in a else "modified" for p in b | a if b.get(p) != a.get(p)}
    stages = [Stage.shared(spark) for _ in range(3)]
    trees = [tree.build(frame(spark, x), stage) for x, stage in zip((before, after), stages, strict=False)]
    got = rows(tree.changes(*trees, stages[2]), "path", "state")
    assert len(got) == len(dict(got)) and dict(got) == expected


def test_equal_trees_and_roots(spark):
    found = {"/s/a/1": ("file", "x"), "/s/a/2": ("link", "/t"), "/s/b/": ("dir", None), "/s//c/3": ("file", "y")}
    one, two, other = (tree.build(frame(spark, x), Stage.shared(spark)) for x in (
        found, dict(reversed(found.items())), {**found, "/s/a/2": ("file", "/t")}))
    assert tree.changes(one, two, Stage.shared(spark)).count() == 0
    got = {r.root: (r.exists, r.verified) for r in tree.verified(one, other, ["/s/a", "/s/b/", "/s/c", "/s/none", ""]).collect()}
    assert got == {"/s/a": (True, False), "/s/b": (True, True), "/s/c": (True, True), "/s/none": (False, False), "": (True, False)}


def test_a_directory_that_is_listed_and_filled(spark):
    one = tree.build(frame(spark, {"/d": ("dir", ""), "/d/f": ("file", "x")}), Stage.shared(spark))
    two = tree.build(frame(spark, {"/d/f": ("file", "x")}), Stage.shared(spark))
    assert tree.changes(one, two).count() == 0
    empty = tree.build(frame(spark, {"/d": ("dir", "")}).where("false"))
    assert tree.changes(empty, two).count() == 3 and tree.changes(empty, empty).count() == 0
