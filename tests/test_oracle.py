"""Every query that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import catalog

D = "/root/testdata/sf0.01"


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return int(x) if type(x).__name__ == "Decimal" and x == int(x) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected


def test_every_query_has_rows(spark, duck):
    """A comparison of nothing with nothing would show nothing."""
    assert all(duck.sql(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchall()[0][0] for name in catalog.ORACLES)


def test_betweenness_sql_goes_deep_enough(duck):
    """The last level of the SQL is empty."""
    sql = catalog.ORACLES["edge_betweenness"]
    assert duck.sql(sql[: sql.rindex(") SELECT src, dst")] + f") SELECT count(*) FROM v{catalog.LEVELS - 1}").fetchall()[0][0] == 0


@pytest.mark.parametrize("name", ["gbt_predict", "hybrid_model"])
def test_models(spark, monkeypatch, name):
    """Every test pair has a prediction, and the root mean square error is that of the rows. (The ratings are random, so no model does better than their mean; these come near.)"""
    monkeypatch.setattr(catalog, "TREES", 5)
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    x = [r.x for r in got]
    mean = sum(x) / len(x)
    rmse = math.sqrt(sum((r.x - r.prediction) ** 2 for r in got) / len(got))
    assert len(got) > 100 and all(r.rmse == pytest.approx(rmse, abs=1e-4) for r in got) and rmse <= 1.2 * math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))


def test_girvan_newman(spark):
    """Communities of the registered query are what a plain loop over the same edges finds."""
    e = [(r.src, r.dst) for r in catalog._edges(spark, D, 7).collect()]
    got = {r.node: r.community for r in catalog.QUERIES["girvan_newman"](spark, D).collect()}
    assert set(got) == {v for pair in e for v in pair}
    assert got == plain_communities(e)


def plain_between(edges):
    """Betweenness by the definition: for each pair of nodes, the share of its shortest paths that use each edge."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def reach(root):
        far, many, layer = {root: 0}, {root: 1}, [root]
        while layer:
            fresh = {}
            for v in layer:
                for w in near[v]:
                    if w not in far:
                        fresh[w] = fresh.get(w, 0) + many[v]
            far |= {w: far[layer[0]] + 1 for w in fresh}
            many |= fresh
            layer = list(fresh)
        return far, many

    all_ = {v: reach(v) for v in near}
    out = {}
    for a, b in edges:
        total = 0.0
        for s in all_[a][0]:
            for x, y in ((a, b), (b, a)):
                if all_[s][0][x] + 1 == all_[s][0][y]:
                    total += sum(all_[s][1][x] * all_[y][1][t] / all_[s][1][t] for t in all_[y][0] if all_[s][0][y] + all_[y][0][t] == all_[s][0][t])
        out[a, b] = total / 2
    return out


def plain_communities(edges, patience=20):
    m, degree = len(edges), {}
    for pair in edges:
        for v in pair:
            degree[v] = degree.get(v, 0) + 1
    live, best, waited = list(edges), None, 0
    while True:
        label = {v: v for v in degree}
        for _ in degree:
            before = dict(label)
            for a, b in live:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                break
        q = sum(label[a] == label[b] for a, b in edges) / m - sum((sum(d for v, d in degree.items() if label[v] == g) / (2 * m)) ** 2 for g in set(label.values()))
        if best is None or q > best[0] + 1e-12:
            best, waited = (q, label), 0
        else:
            waited += 1
        if waited >= patience or not live:
            return best[1]
        x = plain_between(live)
        live = [e for e in live if x[e] < max(x.values()) * (1 - 1e-9)]


def test_bfr(spark):
    """Every vector is placed once, in a cluster or as an outlier. (The vectors have no structure; test_clustering holds the operator to clusters that are there.)"""
    got = catalog.QUERIES["bfr"](spark, D).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()}
    assert len(got) == len(ids) and {r.id for r in got} == ids and {r.cluster for r in got} <= set(range(-1, 8))
