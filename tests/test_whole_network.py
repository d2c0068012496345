"""Network queries over all rows of lineitem."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from thalweg.operators import spatial as S
from thalweg.plans import views as V
from thalweg.plans.catalogue import QUERIES
from thalweg.storage import materialize


def test_every_row_is_an_edge(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, nodes = rows.count(), rows.select("l_partkey").distinct().count() + rows.select("l_suppkey").distinct().count()
    assert {r.edge_id for r in QUERIES["q28_waterway_size"](spark, sf_dir).collect()} == set(range(n))
    assert QUERIES["q21_chain_contract"](spark, sf_dir).agg(F.sum("n_edges")).first()[0] == n
    assert QUERIES["q22_component_report"](spark, sf_dir).first()["size"] == nodes
    assert QUERIES["q26_schematic_layout"](spark, sf_dir).select("node_id").distinct().count() == nodes
    assert entry_module.entry(spark).agg(F.sum("degree")).first()[0] == 2 * n


def test_a_large_component_is_walked_in_little_memory():
    """The walk holds some bytes for each end of an edge; a table of all edges and lists of neighbours held hundreds."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from thalweg.operators import layout

    n, rng = 200_000, np.random.default_rng(1)
    u, v = rng.integers(0, 2000, n), 2000 + rng.integers(0, 500, n)
    at, to = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.argsort(at, kind="stable")
    met = np.union1d(u, v)

    def batches():
        rows = lambda at, x, to: pa.RecordBatch.from_pydict({"component": pa.array(np.zeros(len(at), np.int64)), "grid": pa.array([10.0] * len(at)), "at": pa.array(at), "x": pa.array(x, from_pandas=True), "y": pa.array(x, from_pandas=True), "to": to})
        yield rows(met, met * 1.0, pa.nulls(len(met), pa.int64()))
        for k in range(0, len(at), 1000):
            part = order[k : k + 1000]
            yield rows(at[part], np.full(len(part), np.nan), pa.array(to[part]))

    tracemalloc.start()
    out = list(layout._walk(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(i for b in out for i in b.column("node_id").to_pylist()) == met.tolist()
    assert peak < 40 * len(at)


def test_graph_files_are_packed_and_rows_are_shuffled_once(spark, sf_dir):
    """Disk of a graph's text and of numbered edges: the text is packed, and what edges are made of is not shuffled beside them."""
    from pathlib import Path

    back = QUERIES["q34_graphml_roundtrip"](spark, sf_dir)
    folders = {f.rsplit("/", 1)[0] for f in back.inputFiles()}
    files = [f for folder in folders for f in Path(folder.removeprefix("file:").replace("///", "/")).glob("part-*")]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    rows = back.count()
    assert sum(f.stat().st_size for f in files) < 40 * rows  # 207 bytes a row as plain text

    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "materialize", lambda df, label: seen.append(df) or materialize(df, label))
        V.net(spark, sf_dir)
    tree = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    shuffled = tree[tree.index("RepartitionByExpression") :]
    assert "length_m" not in shuffled and "named_struct" not in shuffled


def test_numbers_in_the_order_of_several_columns(spark):
    rows = [(k % 7 if k % 10 else None, (k * 37) % 101, f"v{k}") for k in range(101)]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    got = S.dense_ids(df, ["a", "b"], "n", slices=5, then=[F.upper("c").alias("d")])
    assert got.columns == ["d", "n"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.d for r in got.orderBy("n").collect()] == [r[2].upper() for r in want] and got.agg(F.max("n")).first()[0] == 100


def test_the_walk_reads_one_list_a_node(spark, monkeypatch):
    """Neighbours are put in order by many tasks, each once; what one task reads grows with nodes, and its places are those of single rows."""
    import random

    import pyarrow as pa

    from thalweg.operators import layout as L

    r = random.Random(2)
    ends = [(r.randrange(60), 1000 + r.randrange(20)) for _ in range(4000)] + [(k, k + 1) for k in range(59)] + [(5, 5)]
    rows = [(k, u, v, float(r.randrange(50)), r.choice(["river", "canal"])) for k, (u, v) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "edge_id long, u long, v long, length_m double, tag string")
    ids = sorted({n for e in ends for n in e})
    at = {n: (r.uniform(0, 900), r.uniform(0, 900)) for n in ids}
    nodes = spark.createDataFrame([(n, *at[n]) for n in ids], "node_id long, x double, y double")
    grid = L.grid_unit(edges).first().grid
    near = {n: [] for n in ids}
    for k, u, v, length, tag in sorted(rows, key=lambda e: (e[4] != "river", -e[3], e[0])):
        if u != v:
            near[u].append(v)
            near[v].append(u)
    single = [(n, *at[n], None) for n in ids] + [(n, None, None, m) for n in ids for m in near[n]]
    columns = [pa.array(c) for c in zip(*[(0, grid, *x) for x in single])]
    want = {r["node_id"]: (r["schematic_x"], r["schematic_y"]) for b in L._walk([pa.RecordBatch.from_arrays(columns, ["component", "grid", "at", "x", "y", "to"])]) for r in b.to_pylist()}
    for whole in (False, True):
        got = L.layout(nodes, edges, whole=whole)
        assert {r.node_id: (r.schematic_x, r.schematic_y) for r in got.collect()} == want
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_pydict({"node_id": b.column("at").cast(pa.int64()), "schematic_x": b.column("grid"), "schematic_y": b.column("grid")})

    monkeypatch.setattr(L, "_walk", counted)
    L.layout(nodes, edges, whole=True).count()
    assert seen.value <= 4 * len(ids)  # before: a row for each of 8,118 ends


def test_pieces_of_lines_are_written_once(spark, monkeypatch):
    from thalweg.plans import pipeline as P

    labels = []
    for module in (S, P):
        monkeypatch.setattr(module, "materialize", lambda df, label="table": labels.append(label) or materialize(df, label))
    geom = lambda y: [(0.0, y), (9.0, 9.0 - y)]
    lines = spark.createDataFrame([(k, "primary", "t", None, geom(float(k))) for k in range(6)], "line_id long, source string, tag string, name string, geom array<struct<x:double,y:double>>")
    _, edges = P.noded(lines, P.Settings(snap=0.01))
    assert edges.count() > 6 and "pieces" not in labels and labels.count("dense") >= 1
