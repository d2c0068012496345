import random

from thalweg.operators import compaction as C


def test_crossings_of_known_lines(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 10.0, 10.0, 0.0), (3, 5.0, 5.0, 9.0, 5.0), (4, 2.0, 0.0, 2.0, 9.0), (5, 0.0, 0.0, 10.0, 10.0), (6, 20.0, 20.0, 30.0, 30.0), (1, 20.0, 30.0, 30.0, 20.0)]
    got = {r.edge_id: r.crossings for r in C.crossings(spark.createDataFrame(rows, "edge_id long, x1 double, y1 double, x2 double, y2 double")).collect()}
    # 3 starts where 1, 2 and 5 cross and only touches them; 1 and 5 lie on each other
    assert got == {1: 3, 2: 3, 4: 3, 5: 2, 6: 1}


def test_compact_layouts(spark):
    rng = random.Random(3)
    places = {i: (rng.randrange(12) * 7.0, rng.randrange(12) * 3.0) for i in range(90)}
    taken, nodes = set(), {}
    for i, p in places.items():
        if p not in taken:
            taken.add(p)
            nodes[i] = p
    ids = sorted(nodes)
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [(ids[0], ids[0]), (ids[0], 999)]
    df = spark.createDataFrame([(i, *p) for i, p in nodes.items()] + [(500, None, 1.0)], "node_id long, schematic_x double, schematic_y double")
    out = {r.node_id: (r.column, r.row) for r in C.compacted(df, spark.createDataFrame(links, "u long, v long")).collect()}
    assert out.keys() == nodes.keys() and len(set(out.values())) == len(out)
    for a in ids:
        for b in ids:
            if nodes[a][1] == nodes[b][1] and nodes[a][0] < nodes[b][0]:
                assert out[a][0] < out[b][0]
            if out[a][0] == out[b][0] and nodes[a][1] < nodes[b][1]:
                assert out[a][1] < out[b][1]
    for u, v in links[:-1]:
        if nodes[u][0] == nodes[v][0]:
            assert out[u][0] == out[v][0]
        if nodes[u][1] == nodes[v][1]:
            assert out[u][1] == out[v][1]
    # each stands as far left as what stands before it lets it
    groups = {}
    for i in ids:
        groups.setdefault(out[i][0], []).append(i)
    assert min(groups) == 0 and max(groups) < 12
    alone = {r.node_id: (r.column, r.row) for r in C.compacted(df, spark.createDataFrame([], "u long, v long")).collect()}
    for i in ids:
        assert alone[i][0] == sum(nodes[j][1] == nodes[i][1] and nodes[j][0] < nodes[i][0] for j in ids)
    assert C.compacted(df.limit(0), spark.createDataFrame(links, "u long, v long")).collect() == []


def test_long_rows_are_walked_in_slices(spark):
    """Thousands of nodes on a line take some rounds, not one for every few nodes."""
    n, rng = 3000, random.Random(5)
    nodes = [(i, float(i // 500), float(rng.randrange(3))) for i in range(n)]
    links = [(i, i + 1) for i in range(n - 1) if rng.random() < 0.3]
    df = spark.createDataFrame(nodes, "node_id long, schematic_x double, schematic_y double")
    out = {r.node_id: (r.column, r.row) for r in C.compacted(df, spark.createDataFrame(links, "u long, v long"), size=700).collect()}

    def ranks(along, across):
        grp = list(range(n))
        for u, v in links:  # in ascending order
            if along[u] == along[v]:
                grp[v] = grp[u]
        members, top, rank = {}, {}, {}
        for i in range(n):
            members.setdefault((along[i], grp[i]), set()).add(across[i])
        for key in sorted(members):
            r = max(top.get(c, -1) for c in members[key]) + 1
            top |= dict.fromkeys(members[key], r)
            rank[key[1]] = r
        return [rank[g] for g in grp]

    columns = ranks([p[1] for p in nodes], [p[2] for p in nodes])
    rows = ranks([p[2] for p in nodes], columns)
    assert out == dict(enumerate(zip(columns, rows)))
    assert max(columns) > 900


def test_many_crossings_are_counted_without_rows_of_pairs(spark, monkeypatch):
    import numpy as np

    from thalweg.operators import quadtree

    rng = np.random.default_rng(11)
    x1, y1, x2, y2 = ends = rng.uniform(0, 100, (4, 1500))
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    a, b = side(x1[:, None], y1[:, None], x2[:, None], y2[:, None], x1, y1), side(x1[:, None], y1[:, None], x2[:, None], y2[:, None], x2, y2)
    apart = np.triu(a * b < 0, 1) & np.triu((a * b < 0).T, 1)
    want = apart.sum(axis=0) + apart.sum(axis=1)
    lines = spark.createDataFrame([(i, *v) for i, v in enumerate(ends.T.tolist())], "edge_id long, x1 double, y1 double, x2 double, y2 double")
    out = C.crossings(lines)
    assert "Join" not in out._jdf.queryExecution().toString()
    assert {r.edge_id: r.crossings for r in out.collect()} == {i: n for i, n in enumerate(want.tolist()) if n}
