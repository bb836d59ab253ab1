import numpy as np
import pytest
from pyspark.sql import functions as F

from wardspark.operators import fed as FD


def params(spark, per_client):
    rows = [(c, n, i, float(v)) for c, vals in per_client.items() for (n, i, v) in vals]
    return spark.createDataFrame(rows, "client string, name string, idx long, value double")


def test_weights_sum_to_one(spark):
    s = spark.createDataFrame([("a",)] * 3 + [("b",)] * 7, "client string")
    w = {r["client"]: r["w"] for r in FD.client_weights(s).collect()}
    assert w == pytest.approx({"a": 0.3, "b": 0.7}) and sum(w.values()) == pytest.approx(1.0)


def test_fedavg_identity_and_counters(spark):
    same = [("enc.w", 0, 1.5), ("norm.w", 1, -2.0)]
    p = params(spark, {"a": same, "b": same})
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "client string, w double")
    got = {(r["name"], r["idx"]): r["value"] for r in FD.fed_avg(p, w).collect()}
    assert got == pytest.approx({("enc.w", 0): 1.5, ("norm.w", 1): -2.0})
    p2 = params(spark, {"a": [("bn.num_batches_tracked", 0, 5.0)], "b": [("bn.num_batches_tracked", 0, 9.0)]})
    assert FD.fed_avg(p2, w).collect()[0]["value"] == 5.0


def test_fedbn_keeps_norm_local(spark):
    p = params(spark, {"a": [("enc.w", 0, 1.0), ("norm.w", 1, 10.0)], "b": [("enc.w", 0, 3.0), ("norm.w", 1, 20.0)]})
    srv = spark.createDataFrame([("enc.w", 0, 0.0), ("norm.w", 1, 99.0)], "name string, idx long, value double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "client string, w double")
    got = {(r["client"], r["name"]): r["value"] for r in FD.fed_bn(p, srv, w).collect()}
    assert got == {("a", "enc.w"): 2.0, ("b", "enc.w"): 2.0, ("server", "enc.w"): 2.0,
                   ("a", "norm.w"): 10.0, ("b", "norm.w"): 20.0, ("server", "norm.w"): 99.0}


def test_prox_penalty_norm_rule(spark):
    p = params(spark, {"a": [("enc.w", 0, 1.0), ("norm.w", 1, 3.0)]})
    srv = spark.createDataFrame([("enc.w", 0, 0.0), ("norm.w", 1, 1.0)], "name string, idx long, value double")
    prox = FD.prox_penalty(p, srv, 0.5, include_norm=False).collect()[0]["penalty"]
    pxn = FD.prox_penalty(p, srv, 0.5, include_norm=True).collect()[0]["penalty"]
    assert prox == pytest.approx(0.25) and pxn == pytest.approx(0.25 * 5)


def test_gradient_step_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    y = (rng.random(40) < 0.4).astype(int)
    feats = spark.createDataFrame([("a", [float(v) for v in x[i]], int(y[i])) for i in range(40)],
                                  "client string, x array<double>, y int")
    out = FD.train(feats, 3, rounds=2, lr=0.5, algorithm="single")
    got = [r["value"] for r in out.orderBy("idx").collect()]
    w = np.zeros(4)
    xb = np.hstack([x, np.ones((40, 1))])
    for _ in range(2):
        p = 1 / (1 + np.exp(-xb @ w))
        w = w - 0.5 * xb.T @ (p - y) / 40
    assert got == pytest.approx(list(w), abs=1e-9)


def test_fedavg_round_is_weighted_mean_of_local_models(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c, n in (("a", 10), ("b", 30)):
        for _ in range(n):
            rows.append((c, [float(v) for v in rng.normal(size=2)], int(rng.random() < 0.5)))
    feats = spark.createDataFrame(rows, "client string, x array<double>, y int")
    out = FD.train(feats, 2, rounds=1, lr=1.0, algorithm="fedavg")
    server = [r["value"] for r in out.where(F.col("client") == "server").orderBy("idx").collect()]
    local = FD.train(feats, 2, rounds=1, lr=1.0, algorithm="single")
    la = [r["value"] for r in local.where(F.col("client") == "a").orderBy("idx").collect()]
    lb = [r["value"] for r in local.where(F.col("client") == "b").orderBy("idx").collect()]
    assert server == pytest.approx([0.25 * a + 0.75 * b for a, b in zip(la, lb)], abs=1e-12)


def sites(seed=2):
    rng = np.random.default_rng(seed)
    return {c: (rng.normal(size=(n, 2)) + shift, (rng.random(n) < 0.5).astype(int)) for c, n, shift in (("a", 12, 0.0), ("b", 24, 1.0))}


def frame(spark, data):
    return spark.createDataFrame([(c, [float(v) for v in x], int(t)) for c, (xs, ys) in data.items() for x, t in zip(xs, ys)],
                                 "client string, x array<double>, y int")


def by_hand(data, rounds, steps, algorithm, lr, mu):
    total = sum(len(y) for _, y in data.values())
    models, server = {c: np.zeros(3) for c in data}, np.zeros(3)
    for r in range(rounds):
        for c, (x, y) in data.items():
            xb = np.hstack([x, np.ones((len(x), 1))])
            for _ in range(steps):
                g = xb.T @ (1 / (1 + np.exp(-xb @ models[c])) - y) / len(y)
                if r > 0 and algorithm in ("fedprox", "fedpxn"):
                    pull = mu * (models[c] - server)
                    if algorithm == "fedprox":
                        pull[2] = 0
                    g = g + pull
                models[c] = models[c] - lr * g
        mean = sum(models[c] * len(data[c][1]) / total for c in data)
        kept = 2 if algorithm in ("fedbn", "fedpxn") else 3
        server = np.concatenate([mean[:kept], server[kept:]])
        models = {c: np.concatenate([mean[:kept], m[kept:]]) for c, m in models.items()}
    return models | {"server": server}


@pytest.mark.parametrize("algorithm", ["fedavg", "fedprox", "fedbn", "fedpxn"])
def test_algorithms_match_numpy(spark, algorithm):
    data = sites()
    out = FD.train(frame(spark, data), 2, rounds=2, lr=0.5, local_steps=3, algorithm=algorithm, mu=0.5).orderBy("idx").collect()
    want = by_hand(data, 2, 3, algorithm, 0.5, 0.5)
    for c, w in want.items():
        assert [r["value"] for r in out if r["client"] == c] == pytest.approx(list(w), abs=1e-9)


def test_algorithms_differ():
    got = [np.concatenate(list(by_hand(sites(), 2, 3, a, 0.5, 0.5).values())) for a in ("fedavg", "fedprox", "fedbn", "fedpxn")]
    assert all(np.abs(got[i] - got[j]).max() > 1e-4 for i in range(4) for j in range(i))


def test_resume_equals_one_run(spark):
    f = frame(spark, sites())
    half = FD.train(f, 2, rounds=1, local_steps=2, algorithm="fedpxn", mu=0.5)
    got = FD.train(f, 2, rounds=1, local_steps=2, algorithm="fedpxn", mu=0.5, start=half, start_round=1)
    want = FD.train(f, 2, rounds=2, local_steps=2, algorithm="fedpxn", mu=0.5)
    key = lambda df: sorted((r["client"], r["idx"], round(r["value"], 12), r["round"]) for r in df.collect())
    assert key(got) == key(want)


def _adam_numpy(rows, dims, rounds, batches, epochs, lr, algorithm, mu):
    """The loop in plain numpy: clients one after the other, batches in the order of the hash."""
    import hashlib
    clients = sorted({c for _, c, _, _ in rows})
    share = {c: sum(r[1] == c for r in rows) / len(rows) for c in clients}
    w, server = {c: np.zeros(dims + 1) for c in clients}, np.zeros(dims + 1)
    for r in range(rounds):
        for c in clients:
            m, v, t = np.zeros(dims + 1), np.zeros(dims + 1), 0
            for e in range(epochs):
                mine = sorted((hashlib.md5(f"{p}_{r}_{e}".encode()).hexdigest(), p, x, y) for p, k, x, y in rows if k == c)
                for b in range(batches):
                    part = [z for i, z in enumerate(mine) if i * batches // len(mine) == b]
                    if not part:
                        continue
                    x = np.array([[*z[2], 1.0] for z in part])
                    g = x.T @ (1 / (1 + np.exp(-x @ w[c])) - np.array([z[3] for z in part])) / len(part)
                    if algorithm in ("fedprox", "fedpxn") and r > 0 and b > 0:
                        pull = mu * (w[c] - server)
                        if algorithm == "fedprox":
                            pull[dims] = 0
                        g = g + pull
                    t += 1
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w[c] = w[c] - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        if algorithm != "single":
            new = sum(share[c] * w[c] for c in clients)
            if algorithm in ("fedbn", "fedpxn"):
                new[dims] = server[dims]
            for c in clients:
                bias = w[c][dims]
                w[c] = new.copy()
                if algorithm in ("fedbn", "fedpxn"):
                    w[c][dims] = bias
            server = new
    return w, server


@pytest.mark.parametrize("algorithm", ["fedavg", "fedprox", "fedbn", "fedpxn", "single"])
def test_minibatch_adam_matches_numpy(spark, algorithm):
    rng = np.random.default_rng(3)
    rows = [(i, "abc"[i % 3] if i != 5 else "d", [float(x) for x in rng.normal(size=3)], int(rng.random() < 0.4)) for i in range(50)]
    feats = spark.createDataFrame(rows, "pid int, client string, x array<double>, y int").repartition(3)
    seen = []
    out = FD.train_minibatch(feats, 3, rounds=2, batches=4, epochs=2, lr=0.05, algorithm=algorithm, mu=0.5, on_round=lambda r, p: seen.append(r))
    got = {}
    for r in out.orderBy("client", "idx").collect():
        got.setdefault(r["client"], []).append(r["value"])
    w, server = _adam_numpy(rows, 3, 2, 4, 2, 0.05, algorithm, 0.5)
    assert seen == [0, 1] and set(got) == {*w, *(["server"] if algorithm != "single" else [])}
    for c in w:
        assert got[c] == pytest.approx(list(w[c]), abs=1e-9)
    if algorithm != "single":
        assert got["server"] == pytest.approx(list(server), abs=1e-9)


def test_fed_bn_query_returns_every_parameter(spark, tmp_path):
    """The query gives one row for each client, name and idx, as its SQL does, and no summary of them."""
    import duckdb
    from wardspark.plans import catalog

    rows = [(i, [float(i * 64 + j) / 7 for j in range(64)], i) for i in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["fed_bn"](spark, str(tmp_path))
    assert got.columns == ["client", "name", "idx", "value"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[:3]: r[3] for r in con.execute(catalog.oracle_sql()["fed_bn"]).fetchall()}
    seen = {tuple(r)[:3]: r["value"] for r in got.collect()}
    assert len(seen) == got.count() == 12 * 64 * 6 and seen == pytest.approx(want, abs=2e-6)
