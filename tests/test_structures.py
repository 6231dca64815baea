"""Parsing, contacts, centralities, pockets and geometry on the helix of the catalog and on small graphs, against dense numpy versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.operators import graph, krylov, metrics, paths, pockets
from meshwork.operators.blocks import Tile
from meshwork.operators.contacts import ContactRule, both_ways, contacts, network
from meshwork.plans import workflows
from meshwork.plans.catalog import FIXTURE, fixture_lines
from meshwork.sources.structures import read_files, residues, without_residues, write_files

N = len(FIXTURE)


@pytest.fixture(scope="module")
def nodes(spark):
    lines = spark.createDataFrame(list(enumerate(fixture_lines())), "line_no int, line string").withColumn("structure_id", F.lit("s"))
    return residues(lines).where("chain = 'A'").cache()


@pytest.fixture(scope="module")
def edges(nodes):
    return both_ways(contacts(nodes)).cache()


def small(spark, pairs, n, name="g"):
    nodes = spark.createDataFrame([(name, i) for i in range(n)], "structure_id string, node_id int")
    edges = spark.createDataFrame([(name, a, b) for a, b in pairs], "structure_id string, src int, dst int")
    return nodes, both_ways(edges)


def together(*graphs):
    nodes, edges = graphs[0]
    for n, e in graphs[1:]:
        nodes, edges = nodes.unionByName(n), edges.unionByName(e)
    return nodes, edges.cache()


def adjacency(pairs, n):
    a = np.zeros((n, n))
    for x, y in pairs:
        if x != y:
            a[x, y] = a[y, x] = 1
    return a


def helix():
    near = lambda i, j: abs(FIXTURE[i][0] - FIXTURE[j][0]) >= 3 and math.dist(FIXTURE[i][1:], FIXTURE[j][1:]) <= 8
    return adjacency([(i, j) for i in range(N) for j in range(i) if near(i, j)], N)


def dense(a):
    """Every method's scores by plain linear algebra and searches, normalised, and the spectral radius."""
    n, degree = len(a), a.sum(axis=1)
    values, vectors = np.linalg.eig(np.block([[a, np.eye(n) - np.diag(degree)], [np.eye(n), np.zeros((n, n))]]))
    real = np.flatnonzero(np.abs(values.imag) < 1e-7)
    top = max(real, key=lambda i: (round(abs(values[i].real), 9), values[i].real))
    dist, count = np.full((n, n), np.inf), np.zeros((n, n))
    for s in range(n):
        front, d = {s: 1}, 0
        while front:
            for v, c in front.items():
                dist[s, v], count[s, v] = d, c
            new = {}
            for v, c in front.items():
                for u in np.flatnonzero(a[v]).tolist():
                    if dist[s, u] > d:
                        new[u] = new.get(u, 0) + c
            front, d = {u: c for u, c in new.items() if np.isinf(dist[s, u])}, d + 1
    between, close = np.zeros(n), np.zeros(n)
    for s in range(n):
        far = dist[s][np.isfinite(dist[s]) & (dist[s] > 0)]
        close[s] = len(far) ** 2 / ((n - 1) * far.sum()) if len(far) else 0
        for t, v in itertools.product(range(n), range(n)):
            if s < t and v not in (s, t) and dist[s, v] + dist[v, t] == dist[s, t] < np.inf:
                between[v] += count[s, v] * count[v, t] / count[s, t]
    x = np.ones(n)
    for _ in range(200):
        x = a @ x
        x /= np.linalg.norm(x) or 1
    out = {"nonbacktracking": np.abs(vectors[:n, top].real), "degree": degree, "closeness": close, "betweenness": between, "eigenvector": np.abs(x)}
    return {k: v / (v.max() or 1) for k, v in out.items()}, abs(values[top].real)


def scores(frame):
    return {r.node_id: r.score for r in graph.max_normalised(frame).collect()}


def test_parse(nodes):
    rows = sorted(nodes.collect(), key=lambda r: r.node_id)
    assert [(r.res_seq, r.x, r.y, r.z) for r in rows] == FIXTURE and {r.res_name for r in rows} == {"ALA"}


def test_bad_first_record_hides_a_later_one(spark):
    good = fixture_lines()[2]
    bad = good.replace("   5.000", "   5.0x0", 1)
    lines = spark.createDataFrame([("s", 0, bad), ("s", 1, good)], "structure_id string, line_no int, line string")
    assert residues(lines).count() == 0
    assert [r.structure_id for r in without_residues(lines, residues(lines)).collect()] == ["s"]


def test_files(spark, tmp_path):
    (tmp_path / "my name+1.v2.PDB").write_text("\r\n".join(fixture_lines()))
    (tmp_path / "b.ent").write_text("END\n")
    (tmp_path / "c.txt").write_text("\n".join(fixture_lines()))
    found = read_files(spark, str(tmp_path))
    assert {r.structure_id for r in found.collect()} == {"my name+1.v2", "b"}
    assert residues(found).where("chain = 'A'").count() == N


def test_files_written_and_read(spark, nodes, tmp_path):
    many = nodes.unionByName(nodes.withColumn("structure_id", F.lit("Other one"))).repartition(3)
    made = write_files(many, f"file://{tmp_path}/out").collect()
    assert sorted((r.structure_id, r.n) for r in made) == [("Other one", N), ("s", N)]
    assert sorted(map(tuple, residues(read_files(spark, f"{tmp_path}/out")).collect())) == sorted(map(tuple, many.select("structure_id", "node_id", "chain", "res_seq", "res_name", "x", "y", "z").collect()))


@pytest.mark.parametrize("cells", [True, False])
def test_contacts(nodes, cells):
    found = contacts(nodes, ContactRule(), cells)
    a = helix()
    assert {(r.src, r.dst) for r in found.collect()} == {(i, j) for i in range(N) for j in range(N) if i < j and a[i, j]}
    degree = {r.node_id: r.degree for r in graph.degrees(nodes, both_ways(found)).collect()}
    assert [degree[i] for i in range(N)] == a.sum(axis=1).tolist()


def test_contact_rules(spark):
    rows = [("s", i, "A", i + 1, "ALA", float(i), 0.0, 0.0) for i in range(4)] + [("s", 4, "B", 2, "ALA", 0.0, 8.0, 0.0), ("s", 5, "B", 90, "ALA", -8.1, -0.1, 0.0)]
    n = spark.createDataFrame(rows, "structure_id string, node_id int, chain string, res_seq int, res_name string, x double, y double, z double")
    assert {(r.src, r.dst) for r in contacts(n).collect()} == {(0, 3), (0, 4)}


#: A wheel with a tail and an isolated node, two triangles joined by a path, and a bipartite ladder.
SHAPES = {
    "wheel": ([(0, i) for i in range(1, 8)] + [(i, i % 7 + 1) for i in range(1, 8)] + [(3, 8), (8, 9)], 11),
    "dumbbell": ([(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (5, 7)], 8),
    "ladder": ([(2 * i, 2 * i + 1) for i in range(5)] + [(2 * i + b, 2 * i + 2 + b) for i in range(4) for b in (0, 1)], 10),
}


def test_scores_agree_with_dense_ones(spark, nodes, edges):
    shapes = {k: adjacency(*v) for k, v in SHAPES.items()} | {"s": helix()}
    n, e = together((nodes.select("structure_id", "node_id"), edges.select("structure_id", "src", "dst")), *(small(spark, *v, k) for k, v in SHAPES.items()))
    _, rho = krylov.backtrackless(n, e)
    got = {(r.structure_id, r.method, r.node_id): r.score for r in workflows.all_scores(n, e)[0].collect()}
    for name, a in shapes.items():
        want, radius = dense(a)
        for method in workflows.METHODS:
            if (name, method) != ("ladder", "eigenvector"):  # which ends are ahead changes at each step there
                assert [got[name, method, i] for i in range(len(a))] == pytest.approx(want[method].tolist(), abs=1e-6), (name, method)
        row = rho.where(F.col("structure_id") == name).first()
        assert row.rho == pytest.approx(radius, abs=1e-8) and row.converged


def test_pocket_and_geometry(nodes, edges):
    score = graph.max_normalised(graph.degrees(nodes, edges).withColumn("score", F.col("degree").cast("double")))
    found, members = pockets.pockets(score, edges, 0.5)
    a = helix()
    value = np.round(a.sum(axis=1) / a.sum(axis=1).max(), 9)
    hot = [i for i in range(N) if value[i] >= np.sort(value)[int((N - 1) * 0.5 + 0.5)]]
    reached, todo = set(), [hot[0]]
    while todo:
        i = todo.pop()
        reached.add(i)
        todo += [j for j in hot if a[i, j] and j not in reached]
    one = found.collect()
    assert len(one) == 1 and set(hot) == reached and one[0]["size"] == len(hot) and one[0].mean_score == pytest.approx(value[hot].mean())
    box = pockets.geometry(members, nodes).first()
    places = np.array([FIXTURE[i][1:] for i in hot])
    assert tuple(box.center) == pytest.approx(tuple(places.mean(axis=0))) and tuple(box.box_size) == pytest.approx(tuple(places.max(axis=0) - places.min(axis=0) + 12))
    assert pockets.of_rank(found, 1).count() == 1 and pockets.of_rank(found, 2).count() == 0
    with pytest.raises(Exception, match="no coordinates"):
        pockets.geometry(members, nodes.where(f"node_id <> {hot[0]}")).collect()


def test_spectral_radius_of_known_shapes(spark):
    """A complete graph of 6 (radius 4), a complete bipartite one of 2 and 5 (2), a cycle of 7 (1, a double eigenvalue), one node (0)."""
    shapes = [small(spark, [(a, b) for a in range(6) for b in range(a)], 6, "k6"), small(spark, [(a, b) for a in range(2) for b in range(2, 7)], 7, "k25"), small(spark, [(i, (i + 1) % 7) for i in range(7)], 7, "c7"), small(spark, [], 1, "one")]
    found, rho = krylov.backtrackless(*together(*shapes))
    got = {r.structure_id: r.rho for r in rho.collect()}
    assert got["k6"] == pytest.approx(4, abs=1e-8) and got["k25"] == pytest.approx(2, abs=1e-8) and got["c7"] == pytest.approx(1, abs=1e-3) and got["one"] == 0
    assert [r.score for r in found.where("structure_id = 'one'").collect()] == [None]


def dense_form(edges, n):
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    return np.block([[a, np.eye(n) - np.diag(a.sum(axis=1))], [np.eye(n), np.zeros((n, n))]])


def started(nodes, edges):
    return graph.degrees(nodes, edges).select("structure_id", "node_id", (F.col("degree") + F.col("node_id") * 0.1).cast("double").alias("w"), (1 + F.col("node_id") * 0.01).alias("v")).cache()


def vector_of(start):
    rows = start.orderBy("node_id").collect()
    return np.array([r.w for r in rows] + [r.v for r in rows])


RANDOM = [(a, b) for a in range(60) for b in range(a) if (a * 7 + b * 13) % 11 == 0 or a - b == 1]


def test_krylov_agrees_with_dense_eigenvalues(spark):
    shape = [(0, 1), (1, 2), (0, 2), (2, 3)]
    nodes, edges = small(spark, shape, 4)
    start = started(nodes, edges)
    columns = [list(c) for c in krylov.projected(krylov.arnoldi(nodes, edges, start, 3)).first().h]
    m, v = dense_form(shape, 4), vector_of(start)
    basis = [v / np.linalg.norm(v)]
    for j in range(3):
        w = m @ basis[j]
        assert [w @ b for b in basis] == pytest.approx(columns[j][:-1])
        w = w - sum((w @ b) * b for b in basis)
        assert np.linalg.norm(w) == pytest.approx(columns[j][-1])
        basis.append(w / np.linalg.norm(w))


@pytest.mark.parametrize("chunk,block", [(1024, 8), (16, 5)])
def test_bases_and_pairs(spark, chunk, block):
    """Over one chunk and over many: orthonormal bases whose relation holds, pairs that are the dense matrix's, and a space that closes early."""
    nodes, edges = together(small(spark, RANDOM, 60, "r"), small(spark, [(a, b) for a in range(30) for b in range(a)], 30, "k30"))
    start = started(nodes, edges).withColumn("w", F.when(F.col("structure_id") == "k30", 2.0).otherwise(F.col("w"))).withColumn("v", F.when(F.col("structure_id") == "k30", 1.0).otherwise(F.col("v")))
    basis = krylov.arnoldi(nodes, edges, start, 40, block, chunk)
    assert basis.most_chunks == -(-60 // chunk)
    figures = {r.structure_id: r for r in krylov.projected(basis).collect()}
    assert figures["r"].dims == 40 and figures["k30"].dims == 2
    for r in figures.values():
        assert r.orthogonal < 1e-11 and r.relation < 1e-6
    pairs = krylov.ritz_pairs(krylov.projected(basis))
    lifted = {}
    for r in krylov.lift(basis, nodes, pairs.where("accepted"), chunk).collect():
        lifted.setdefault((r.structure_id, r.place), {})[r.node_id] = (r.value, r.w)
    values = np.linalg.eigvals(dense_form(RANDOM, 60))
    top = max(values[np.abs(values.imag) < 1e-9].real, key=abs)
    value = lifted["r", 0][0][0]
    assert value == pytest.approx(top, abs=1e-8) and lifted["k30", 0][0][0] == pytest.approx(28, abs=1e-9)
    w = np.array([lifted["r", 0][i][1] for i in range(60)])
    dense_ = np.linalg.eig(dense_form(RANDOM, 60))
    want = np.abs(dense_[1][:60, np.argmin(np.abs(dense_[0] - top))].real)
    assert np.abs(w) / np.abs(w).max() == pytest.approx(want / want.max(), abs=1e-6)


def counted(edges, n):
    """Breadth-first distances and numbers of shortest paths, and each node's share of them."""
    near = [[b for a, b in edges + [(b, a) for a, b in edges] if a == i] for i in range(n)]
    dist, number, score = {}, {}, [0.0] * n
    for s in range(n):
        d, c, order, k = {s: 0}, {s: 1}, [s], 0
        while k < len(order):
            for y in near[order[k]]:
                if y not in d:
                    d[y], c[y] = d[order[k]] + 1, 0
                    order.append(y)
                if d[y] == d[order[k]] + 1:
                    c[y] += c[order[k]]
            k += 1
        flow = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if d[x] == d[y] - 1:
                    flow[x] += c[x] / c[y] * (1 + flow[y])
            if y != s:
                score[y] += flow[y] / 2
        dist |= {(s, y): d[y] for y in order if near[s]}
        number |= {(s, y): c[y] for y in order if near[s]}
    return dist, number, score


@pytest.mark.parametrize("sources,chunk", [(64, 1024), (5, 1024), (8, 10)])
def test_paths_by_blocks_of_sources(spark, sources, chunk):
    shape = sorted({(a, b) for a in range(22) for b in range(a) if (a * 5 + b * 3) % 17 == 0} | {(i + 1, i) for i in range(9)})
    nodes, edges = together(small(spark, shape, 24, "r"), small(spark, [(1, 0), (2, 1)], 4, "p"))
    for name, (pairs, n) in {"r": (shape, 24), "p": ([(1, 0), (2, 1)], 4)}.items():
        dist, number, score = counted(pairs, n)
        mine = (nodes.where(F.col("structure_id") == name), edges.where(F.col("structure_id") == name))
        if name == "r":
            found = paths.shortest_paths(*mine, sources, chunk).collect()
            assert {(r.source, r.node_id): r.dist for r in found} == dist and {(r.source, r.node_id): r.paths for r in found} == number
        got = {r.node_id: r.score for r in paths.betweenness(*mine, sources, chunk).collect()}
        assert [got[i] for i in range(n)] == pytest.approx(score, abs=1e-12)
    assert paths.betweenness(nodes.limit(0), edges.limit(0), sources, chunk).count() == 0


def test_chunks_give_the_same_scores(spark):
    shapes = together(small(spark, RANDOM, 60, "r"), small(spark, [(i, (i + 1) % 7) for i in range(7)], 7, "c7"), small(spark, [], 20, "none"))
    whole, parts = (krylov.backtrackless(*shapes, chunk=c) for c in (1024, 16))
    for a, b in zip(whole, parts):
        keys = [c for c in a.columns if c in ("structure_id", "node_id")]
        value = "score" if "score" in a.columns else "rho"
        get = lambda df: {tuple(r[k] for k in keys): r[value] for r in df.where("structure_id = 'r'").collect()}
        assert get(a) == pytest.approx(get(b), abs=1e-8)
    assert {(r.structure_id, r.converged) for r in whole[1].collect()} >= {("r", True)}
    one, many = (scores(graph.eigenvector(*shapes, rounds=30, settle_every=7, chunk=c)) for c in (1024, 16))
    assert one == pytest.approx(many, abs=1e-12)


def test_cycles_end_structure_by_structure(spark):
    """With a basis too small for one cycle, structures start again on their own until each has converged."""
    shapes = together(small(spark, RANDOM, 60, "r"), small(spark, [(a, b) for a in range(6) for b in range(a)], 6, "k6"))
    got = {r.structure_id: r for r in krylov.backtrackless(*shapes, cycles=40, dims=20)[1].collect()}
    want = {r.structure_id: r.rho for r in krylov.backtrackless(*shapes)[1].collect()}
    assert all(r.converged for r in got.values()) and {k: r.rho for k, r in got.items()} == pytest.approx(want, abs=1e-8)
    cut = {r.structure_id: r.converged for r in krylov.backtrackless(*shapes, cycles=1, dims=4)[1].collect()}
    assert cut == {"r": False, "k6": True}


def test_arnoldi_over_the_whole_space_gives_the_centrality(spark):
    nodes, edges = small(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 1)], 4)
    basis = krylov.arnoldi(nodes, edges, started(nodes, edges), 8)
    got = scores(krylov.dominant(basis, nodes, krylov.projected(basis)))
    want = scores(krylov.backtrackless(nodes, edges)[0])
    assert {k: v / max(got.values()) for k, v in got.items()} == pytest.approx({k: v / max(want.values()) for k, v in want.items()}, abs=1e-6)


def test_product(spark):
    m = spark.createDataFrame([("s", i, j, float(i + 2 * j)) for i in range(3) for j in range(3)], "structure_id string, row int, column int, entry double")
    v = spark.createDataFrame([("s", j, float(j)) for j in range(3)], "structure_id string, node_id int, value double")
    assert {r.node_id: r.value for r in krylov.product(m, v).collect()} == {0: 10.0, 1: 13.0, 2: 16.0}


def test_real_pairs_of_small_matrices():
    one = lambda h: krylov.real_pairs(np.array(h), np.eye(2), np.array(h))
    assert [x for x, *_ in one([[2.0, 1.0], [1.0, 2.0]])] == pytest.approx([3.0, 1.0])
    assert one([[0.0, 1.0], [-1.0, 0.0]]) == []
    assert [(x, r < 1e-9) for x, r, _ in one([[0.0, 2.0], [2.0, 0.0]])] == [(pytest.approx(2.0), True), (pytest.approx(-2.0), True)]


def test_components_and_loops(spark):
    nodes, edges = small(spark, [(0, 1), (1, 0), (1, 1), (1, 2)], 5)
    assert edges.count() == 4 and graph.edge_count(edges).first().n_edges == 2
    assert {r.node_id: r.component for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_long_chain_is_one_component(spark):
    nodes, edges = small(spark, [(i, i + 1) for i in range(20)], 21)
    assert graph.components(nodes, edges).select("component").distinct().count() == 1


def test_evaluation(spark, nodes):
    chosen = {2: True, 5: False, 11: True, 14: False, 20: False, 23: True, 29: False, 38: False}
    labels = spark.createDataFrame([("s", "A", r, y) for r, y in chosen.items()] + [("uniform", "A", 2, True), ("uniform", "A", 5, True)], "structure_id string, chain string, res_seq int, label boolean")
    every = nodes.unionByName(nodes.withColumn("structure_id", F.lit("other"))).unionByName(nodes.withColumn("structure_id", F.lit("uniform")))
    files = spark.createDataFrame([("s",), ("other",), ("uniform",), ("broken",)], "structure_id string")
    done = workflows.evaluate(every, labels, files=files)
    want, _ = dense(helix())
    number = {r[0]: i for i, r in enumerate(FIXTURE)}

    def auc(method, rows):
        value = np.round(want[method], 9)
        pairs = [(value[number[p]], value[number[q]]) for p, y in rows for q, z in rows if y and not z]
        return sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in pairs) / len(pairs)

    got = {(r.structure_id, r.method): (r.auc, r.n_pos, r.n_neg) for r in done.each.collect()}
    pooled = {r.method: (r.auc, r.n_pos, r.n_neg) for r in done.pooled.collect()}
    for method in workflows.METHODS:
        assert got["s", method] == (pytest.approx(auc(method, list(chosen.items()))), 3, 5) and got["uniform", method] == (None, 2, 0)
        assert pooled[method] == (pytest.approx(auc(method, [*chosen.items(), (2, True), (5, True)])), 5, 5)
    assert {(r.structure_id, r.reason) for r in done.skipped.collect()} == {("other", "no labels"), ("broken", "no residues")}
    nested = {r.structure_id: r for r in done.structures.collect()}
    assert nested["s"].n_labeled == 8 and [m.method for m in nested["s"].methods] == list(workflows.METHODS)


def test_ranges_give_what_one_window_gives(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 501).cast("double").alias("score"), (F.col("id") % 5 == 0).alias("label"))
    for by in ([], ["g"]):
        one, more = (sorted(map(str, metrics.roc_auc(rows, by, window_rows=w).collect())) for w in (10**6, 10))
        assert one == more
    one, more = (sorted(map(str, metrics.average_rank(rows, ["g"], "score", window_rows=w).collect())) for w in (10**6, 10))
    assert one == more and len(one) == 3000
    placed = metrics.numbered(rows.withColumn("id", F.monotonically_increasing_id()), [F.col("score").desc(), F.col("id").asc()]).collect()
    assert [r.place for r in placed] == list(range(1, 3001)) and all(a.score >= b.score for a, b in zip(placed, placed[1:]))


def test_residue_numbers_of_more_than_four_digits(spark, tmp_path):
    """Numbers over 9,999 come back as they were written, in order with others; what fits no columns is an error."""
    numbers = [-999, 0, 9_999, 10_000, 45_999, 51_281, 1_223_055, 1_223_056, 2_436_111]
    rows = [("s", i, "A", n, "GLY", 0.0625, -1.25, float(i)) for i, n in enumerate(numbers)]
    schema = "structure_id string, node_id int, chain string, res_seq int, res_name string, x double, y double, z double"
    write_files(spark.createDataFrame(rows, schema), f"file://{tmp_path}/wide").collect()
    lines = read_files(spark, f"{tmp_path}/wide")
    assert [tuple(r) for r in residues(lines, wide=True).orderBy("node_id").collect()] == [(*r[:5], 0.062, *r[6:]) for r in rows]  # as a half goes to even
    assert [r.res_seq for r in residues(lines).orderBy("node_id").collect()] == numbers[:3]  # not so in files of others
    for odd in ({"res_seq": 2_436_112}, {"res_seq": -1000}, {"x": 10_000.0}):
        with pytest.raises(Exception, match="four columns|fit its columns"):
            write_files(spark.createDataFrame([tuple((dict(zip(schema.split()[::2], rows[0])) | odd).values())], schema), f"file://{tmp_path}/odd").collect()


@pytest.fixture(scope="module")
def clouds(spark):
    """Two structures of random places, in several chunks of 16 nodes: a dense one, whose blocks are bit maps, and a thin one; with a missing number, places and a chain."""
    rnd = np.random.default_rng(5)
    rows = [(s, i, "AB"[i % 2], i, *(rnd.normal(size=3) * width).tolist()) for s, n, width in (("dense", 70, 4.0), ("thin", 45, 14.0)) for i in range(n) if i != 20]
    rows[3], rows[5] = (*rows[3][:4], None, 0.0, 0.0), (*rows[5][:2], None, *rows[5][3:])
    nodes = spark.createDataFrame(rows, "structure_id string, node_id int, chain string, res_seq int, x double, y double, z double").cache()
    return nodes, both_ways(contacts(nodes)).cache(), network(nodes, chunk=16)


def test_a_network_of_blocks_is_the_graph_of_contacts(clouds):
    nodes, edges, blocks_of = clouds
    found = set()
    for r in blocks_of.matrix.collect():
        i, j = Tile(r.i, r.j, r.bits, r.row_size, r.size).places()
        found |= {(r.structure_id, a, b) for a, b in zip((i + 16 * r.row).tolist(), (j + 16 * r.chunk).tolist())}
    assert found == {tuple(r) for r in edges.select("structure_id", "src", "dst").collect()} and len(found) > 100
    assert {r.bits is None for r in blocks_of.matrix.collect()} == {True, False}
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(graph.degrees(nodes, blocks_of)) == as_set(graph.degrees(nodes, edges))
    hot = nodes.where("node_id % 3 > 0").select("structure_id", "node_id")
    assert as_set(graph.components(hot, blocks_of)) == as_set(graph.components(hot, graph.induced(edges, hot)))


@pytest.mark.parametrize("sources,whole", [(7, 16), (64, 0), (64, 3)])
def test_paths_over_networks(clouds, sources, whole):
    """Structures that a task holds as a whole, those that it doesn't, and one of each (thin fits in three chunks): the same as by plain searches."""
    nodes, edges, blocks_of = clouds
    pairs = {}
    for r in edges.collect():
        pairs.setdefault(r.structure_id, []).append((r.src, r.dst))
    want = {s: counted(sorted({(max(p), min(p)) for p in e}), n) for s, e, n in (("dense", pairs["dense"], 70), ("thin", pairs["thin"], 45))}
    given = dict(sources=sources, chunk=16, whole=whole)
    for s, (dist, number, score) in want.items():
        reached = {}
        for (a, b), d in dist.items():
            reached.setdefault(a, []).append((d, number[a, b]))
        counts = {r.source: (r.reached, r.farthest, r.n_paths) for r in paths.path_counts(nodes, blocks_of, **given).where(F.col("structure_id") == s).collect()}
        assert counts == {a: (len(x), max(d for d, _ in x), sum(c for _, c in x)) for a, x in reached.items()}
        far = {r.node_id: (r.r, r.far) for r in paths.reach(nodes, blocks_of, **given).where(F.col("structure_id") == s).collect() if r.r}
        assert far == {a: (len(x) - 1, sum(d for d, _ in x)) for a, x in reached.items() if len(x) > 1}
        got = {r.node_id: r.score for r in paths.betweenness(nodes, blocks_of, **given).where(F.col("structure_id") == s).collect()}
        assert [got[i] for i in range(len(score)) if i != 20] == pytest.approx([x for i, x in enumerate(score) if i != 20], abs=1e-9)


def test_what_an_evaluation_skips_takes_no_scores(spark, clouds, monkeypatch):
    nodes, *_ = clouds
    monkeypatch.setattr(workflows, "all_scores", None)
    labels = nodes.where("structure_id = 'dense'").select("structure_id", "chain", "res_seq", (F.col("res_seq") % 2 == 0).alias("label"))
    files = spark.createDataFrame([("dense",), ("thin",), ("empty",)], "structure_id string")
    assert {tuple(r) for r in workflows.skipped(nodes, labels, files).collect()} == {("thin", "no labels"), ("empty", "no residues")}
