"""Numerical checks of what SQL can't express: PageRank against a dense matrix, gradients, pairwise interactions."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tallywood.llm")
from tallywood.llm import quality, toxicity, urlrules
from tallywood.llm.textscan import pieces, stripped


def dense(edges, seeds, hosts, damping):
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for src, dst, weight in edges:
        move[at[src], at[dst]] += weight
    out = move.sum(axis=1)
    start = np.zeros(len(hosts))
    start[[at[s] for s in seeds]] = 1 / len(seeds)
    move = np.where(out[:, None] > 0, move / np.maximum(out, 1e-300)[:, None], start[None, :])  # without out-edges: back to the seeds
    return np.linalg.solve(np.eye(len(hosts)) - damping * move.T, (1 - damping) * start)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_propagation_against_a_dense_matrix(spark, seed):
    rng = np.random.default_rng(seed)
    hosts = [f"h{i}" for i in range(25)]
    edges = [(hosts[a], hosts[b], float(w)) for a, b, w in zip(rng.integers(0, 18, 60), rng.integers(0, 25, 60), rng.integers(1, 5, 60)) if a != b]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    seeds = [hosts[i] for i in rng.choice(25, 4, replace=False)]
    got = urlrules.propagate(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(s,) for s in seeds], "host string"), spark.createDataFrame([(h,) for h in hosts], "host string"), residual=1e-7)
    mass = {r.host: r.mass for r in got.collect()}
    assert np.allclose([mass[h] for h in hosts], dense(edges, seeds, hosts, urlrules.DAMPING), atol=1e-5) and abs(sum(mass.values()) - 1) < 1e-9


def test_trust_and_distrust_of_hosts_without_a_rule(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">' for h in hosts)
    rows = [(1, "http://good.com/a", link("friend.org")), (2, "http://friend.org/", ""), (3, "http://bad.net/es/1", link("else.org")), (4, "http://foe.org/", link("bad.net")), (5, "http://else.org/q", None), (5, "http://foe.org/again", None), (None, None, None), (6, "no url", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, trust string")
    got = urlrules.filter_urls(pages).collect()
    verdict = {(r.page_id, r.host): (r.rule, r.verdict) for r in got}
    assert len(got) == len(rows)
    assert verdict[1, "good.com"] == ("com/", "allow") and verdict[3, "bad.net"] == ("net/es/", "block")
    assert verdict[2, "friend.org"] == (None, "allow") and verdict[4, "foe.org"] == (None, "block") and verdict[5, "foe.org"] == (None, "block")  # it links to a blocked host
    assert verdict[5, "else.org"] == (None, "allow") and verdict[None, ""] == (None, "allow") and verdict[6, ""] == (None, "allow")
    assert urlrules.filter_urls(pages.limit(0)).collect() == []


def test_gradients_of_the_network():
    net = toxicity.Network(seed=5)
    (piece,) = pieces(pa.array(["some quite nasty words stand in here and others don't", "short one", "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f g h i j"]))
    v = toxicity.Vocabulary(stripped(piece))
    _, begin, size = toxicity.windows(v.offs)
    index, labels = toxicity._index(v.where, begin), np.arange(len(begin)) % 2
    e = net.embed(v)

    def loss():
        z = net.forward(*net.project(e), index, size).astype(np.float64)
        return float((np.log1p(np.exp(z)) - labels * z).sum())

    logit, kept = net.forward(*net.project(e), index, size, keep=True)
    g, (gf, gb) = net.backward((1 / (1 + np.exp(-logit)) - labels).astype(np.float32), kept, index, len(e))
    g |= {"wf": e.T @ gf, "wb": e.T @ gb, "bf": gf.sum(axis=0), "bb": gb.sum(axis=0)}
    rng = np.random.default_rng(9)
    for name in ("uf", "ub", "wf", "wb", "bf", "bb", "att", "out", "last"):
        old = getattr(net, name).copy()
        way = rng.normal(size=old.shape).astype(np.float32)
        way /= np.linalg.norm(way)
        step, ends = 0.02, []
        for sign in (1, -1):
            setattr(net, name, old + sign * np.float32(step) * way)
            ends.append(loss())
        setattr(net, name, old)
        assert np.isclose((ends[0] - ends[1]) / (2 * step), float((g[name] * way).sum()), rtol=0.03, atol=2e-3), name


def test_scores_are_of_the_most_toxic_window():
    net = toxicity.Network(seed=5)
    net.trained = True
    parts = ["plain " * 40, "odd words " * 30, "x"]
    whole, each = net.scores(pa.array([parts[0] + parts[1]])), net.scores(pa.array(parts))
    assert whole.shape == (1,) and each.shape == (3,) and (0 <= each).all() and (each <= 1).all()
    assert (net.scores(pa.array([None, "", " "])) == net.prior).all()


def test_sum_of_squares_is_all_pairs():
    machine, rng = quality.Machine(), np.random.default_rng(4)
    machine.w, machine.v = rng.normal(size=machine.w.shape), rng.normal(size=machine.v.shape)
    rows = [(rng.choice(len(machine.w), k, replace=False), rng.normal(size=k)) for k in (1, 2, 9, 30)]
    offs = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
    got = machine.raw(offs, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
    for z, (i, x) in zip(got, rows):
        pairs = sum((machine.v[i[a]] @ machine.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(z, machine.bias + machine.w[i] @ x + pairs)
