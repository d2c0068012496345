import random

import pytest

from thalweg.operators import editlog as E


def plain(ops):
    """The stack of edits after all operations."""
    stack, cursor = [], 0
    for k, kind in enumerate(ops):
        if kind == E.EDIT:
            stack[cursor:] = [k]
            cursor += 1
        elif kind == E.UNDO:
            cursor = max(0, cursor - 1)
        else:
            cursor = min(len(stack), cursor + 1)
    return stack[:cursor]


def test_short_forms_walk_alike():
    rng = random.Random(1)
    for _ in range(3000):
        ops = rng.choices((E.EDIT, E.UNDO, E.REDO), rng.choice([(1, 1, 1), (5, 2, 2), (1, 4, 4), (1, 9, 1)]), k=rng.randrange(40))
        short = E.Short()
        for kind in ops:
            short.add(kind)
        steps = [tuple(s) for s in short.told()]
        for cursor, more in [(0, 0), (1, 0), (2, 5), (30, 0), (30, 3), (0, 9)]:
            assert E.walk(cursor, cursor + more, steps) == E.walk(cursor, cursor + more, [(k, 1) for k in ops]) or not ops
    short = E.Short()
    for kind in rng.choices((E.EDIT, E.UNDO, E.REDO), (5, 2, 2), k=100_000):
        short.add(kind)
    assert len(short.told()) < 100


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_logs_in_slices(spark, slices):
    rng = random.Random(slices)
    rows, want = [], {}
    for doc in ["a", "b", None, "c", "d"]:
        ops = rng.choices((E.EDIT, E.UNDO, E.REDO), rng.choice([(3, 1, 1), (1, 2, 2)]), k=rng.choice([0, 1, 30, 600]))
        rows += [(doc, k, ("edit", "undo", "redo")[kind]) for k, kind in enumerate(ops)]
        want[doc] = plain(ops)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, seq int, op string").selectExpr("*", "1 as slice", "2 as kind")
    got = {}
    for r in E.effective_ops(df, slices=slices).collect():
        got.setdefault(r.doc, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert E.effective_ops(df.limit(0)).collect() == []


def test_a_million_edits_of_one_document(spark):
    """Long ways up and down, dealt to many tasks."""
    ops = spark.range(1_000_000).selectExpr("7L as doc", "id as seq", "case when id % 1000 >= 700 and id % 1000 < 900 then 'undo' when id % 1000 >= 900 and id % 1000 < 950 then 'redo' else 'edit' end as op")
    got = sorted(r.seq for r in E.effective_ops(ops, slices=50).collect())
    kinds = [E.UNDO if 700 <= k % 1000 < 900 else E.REDO if 900 <= k % 1000 < 950 else E.EDIT for k in range(1_000_000)]
    assert got == plain(kinds)


def test_difference_of_rows(spark):
    from thalweg.operators.diagrams import difference

    a = spark.createDataFrame([("same", 1, "x"), ("gone", 1, "x"), ("new label", 1, "x"), ("null now", 1, "x"), ("twice", 1, "x"), ("twice", 2, "y"), ("crossed", 1, "x"), ("crossed", 2, "y"), (None, 1, "x")], "k string, n int, label string")
    b = spark.createDataFrame([("same", "x", 1, None), ("fresh", "x", 1, None), ("new label", "z", 1, None), ("null now", None, 1, 5.0), ("twice", "y", 2, None), ("twice", "x", 1, None), ("crossed", "y", 1, None), ("crossed", "x", 2, None), (None, "q", 1, None)], "k string, label string, n int, extra double")
    got = {r.k: (r.change, r.fields) for r in difference(a, b, "k").collect()}
    assert got == {"gone": ("removed", []), "fresh": ("added", []), "new label": ("changed", ["label"]), "null now": ("changed", ["extra", "label"]), "crossed": ("changed", [])}
    assert difference(a.limit(0), b.limit(0), "k").collect() == difference(a.select("k"), a.select("k"), "k").collect() == []
    assert {r.change for r in difference(a.limit(0), b, "k").collect()} == {"added"}


def test_versions_compared_and_restored(spark, tmp_path):
    from thalweg.sources import versions

    nodes = lambda *rows: spark.createDataFrame(rows, "node_key string, label string")
    edges = lambda *rows: spark.createDataFrame(rows, "edge_key string, source_node_key string, target_node_key string")
    root = str(tmp_path)
    one = versions.publish(nodes(("a", "x"), ("b", "y")), edges(("e", "a", "b")), root, "area", "engine")
    two = versions.publish(nodes(("a", "z"), ("c", "y")), edges(("e", "a", "c")), root, "area", "community", secret="s", password="s")
    got = {(r.part, r.key): (r.change, r.fields) for r in versions.compare(spark, root, one, two).collect()}
    assert got == {("nodes", "a"): ("changed", ["label"]), ("nodes", "b"): ("removed", []), ("nodes", "c"): ("added", []), ("edges", "e"): ("changed", ["target_node_key"])}
    three = versions.restore(spark, root, one)
    assert versions.compare(spark, root, one, three).collect() == [] and three not in (one, two)
    assert {r.version_id for r in versions.current(spark, root, "area")[0].collect()} == {three}
    with pytest.raises(PermissionError):
        versions.restore(spark, root, two, secret="s")
    with pytest.raises(ValueError):
        versions.compare(spark, root, one, "nothing")
