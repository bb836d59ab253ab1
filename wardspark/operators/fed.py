"""Federated-learning table operators.

Model state is long: ``params(client, name, idx, value)``; a parameter whose name contains
'norm' is a normalisation parameter, one containing 'num_batches_tracked' is a counter.
Merging, penalties and client weights are joins and aggregates over that table.

The learner (re-aimed from the GPU network) is a logistic model trained by full-batch
gradient steps for every client at once: one pass over the feature rows per step, with
the per-client weight vector joined by broadcast (its size is clients x dims - the
model, never the data) and the mean gradient vector aggregated map-side per client. The
bias (idx = dims) is the model's normalisation parameter. The small parameter table is
checkpointed every step so the lineage stays one step deep.

``train_minibatch`` trains as the reference's loop does: local epochs of batches in a random order that a hash gives,
Adam with moment tables per client that are fresh in each round. An epoch's rows are stored by batch once, so a step
reads one batch, and every step advances all clients at once. The number of batches is a parameter, so the
number of Spark steps doesn't grow with the data; a client's batch holds its rows / batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators.metrics import sigmoid
from wardspark.operators.util import rank_by_hash
from wardspark.sources.stage import cut, store

COUNTER = "num_batches_tracked"
NORM = "norm"
LOCAL_NORM = ("fedbn", "fedpxn")    # norm parameters are not merged
PROXIMAL = ("fedprox", "fedpxn")    # pulled towards the server after the first round


def client_weights(samples: DataFrame, client: str = "client") -> DataFrame:
    """n_c / sum(n): share of each client's training rows."""
    from pyspark.sql import Window
    c = samples.groupBy(client).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _weighted(params: DataFrame, weights: DataFrame, client: str = "client") -> DataFrame:
    # weights has one row per client: bounded by the number of sites
    return params.join(F.broadcast(weights.select(client, "w")), client)


def fed_avg(params: DataFrame, weights: DataFrame, client_order: Sequence[str] | None = None,
            client: str = "client") -> DataFrame:
    """Server params: weighted sum over clients; counters copied from the first client."""
    p = _weighted(params, weights, client)
    order = F.col(client) if client_order is None else \
        F.array_position(F.array(*[F.lit(c) for c in client_order]), F.col(client))
    g = p.groupBy("name", "idx").agg(F.sum(F.col("w") * F.col("value")).alias("_avg"),
                                     F.min_by(F.col("value"), order).alias("_first"))
    return g.select("name", "idx", F.when(F.col("name").contains(COUNTER), F.col("_first"))
                    .otherwise(F.col("_avg")).alias("value"))


def fed_bn(params: DataFrame, server: DataFrame, weights: DataFrame, client: str = "client") -> DataFrame:
    """Average only non-norm parameters; norm parameters stay local (clients and server
    keep their own). Returns all rows for clients and the server (client = 'server')."""
    shared = _weighted(params.where(~F.col("name").contains(NORM)), weights, client) \
        .groupBy("name", "idx").agg(F.sum(F.col("w") * F.col("value")).alias("_avg"))
    everyone = params.unionByName(server.withColumn(client, F.lit("server")).select(params.columns))
    j = everyone.join(shared, ["name", "idx"], "left")
    return j.withColumn("value", F.when(F.col("name").contains(NORM), F.col("value")).otherwise(F.col("_avg"))) \
        .drop("_avg")


def prox_penalty(params: DataFrame, server: DataFrame, mu: float, include_norm: bool,
                 client: str = "client") -> DataFrame:
    """mu/2 * sum((w - w_server)^2) per client (fedprox skips norm params, fedpxn keeps all)."""
    s = server.select("name", "idx", F.col("value").alias("_s"))
    j = params.join(s, ["name", "idx"])
    if not include_norm:
        j = j.where(~F.col("name").contains(NORM))
    return j.groupBy(client).agg((F.lit(mu / 2.0) * F.sum(F.pow(F.col("value") - F.col("_s"), 2))).alias("penalty"))


# ----------------------------------------------------------------------------- learner
def to_vectors(params: DataFrame, client: str = "client") -> DataFrame:
    """Long (client, idx, value) -> (client, w array ordered by idx)."""
    g = params.groupBy(client).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_s"))
    return g.select(client, F.transform("_s", lambda s: s["value"]).alias("w"))


def init_params(clients: DataFrame, dims: int, client: str = "client") -> DataFrame:
    """Zeros for every row of ``clients`` (one per client)."""
    return clients.select(client, F.explode(F.sequence(F.lit(0), F.lit(dims))).alias("idx"),
                          F.lit(0.0).alias("value"))


def linear(x: str, w: str):
    """x . w plus the bias, the last entry of ``w``."""
    coef = F.slice(F.col(w), 1, F.size(F.col(x)))
    return F.aggregate(F.zip_with(F.col(x), coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) \
        + F.element_at(F.col(w), -1)


def gradient(features: DataFrame, params: DataFrame, client: str = "client", x: str = "x",
             y: str = "y") -> DataFrame:
    """Mean logistic-loss gradient per (client, idx); idx = dims is the bias."""
    # one row per client: bounded by the model
    j = features.join(F.broadcast(to_vectors(params, client)), client)
    j = j.withColumn("_r", sigmoid(linear(x, "w")) - F.col(y).cast("double"))
    row = F.concat(F.transform(F.col(x), lambda v: v * F.col("_r")), F.array(F.col("_r")))
    g = j.select(client, array_to_vector(row).alias("_g")).groupBy(client).agg(Summarizer.mean(F.col("_g")).alias("_g"))
    return g.select(client, F.posexplode(vector_to_array("_g")).alias("idx", "grad"))


def local_step(features: DataFrame, params: DataFrame, server: DataFrame | None, lr: float, mu: float,
               client: str = "client", skip: int | None = None) -> DataFrame:
    """One gradient step for every client; with ``server`` and mu > 0 the proximal term
    mu * (w - w_server) is added, but for parameter ``skip``."""
    g = gradient(features, params, client)
    p = params.join(g, [client, "idx"], "left").withColumn("grad", F.coalesce("grad", F.lit(0.0)))
    if server is not None and mu > 0:
        p = p.join(server.select("idx", F.col("value").alias("_s")), "idx")
        pull = F.lit(mu) * (F.col("value") - F.col("_s"))
        if skip is not None:
            pull = F.when(F.col("idx") == skip, F.lit(0.0)).otherwise(pull)
        p = p.withColumn("grad", F.col("grad") + pull).drop("_s")
    return p.select(client, "idx", (F.col("value") - F.lit(lr) * F.col("grad")).alias("value"))


def train(features: DataFrame, dims: int, rounds: int, lr: float = 0.5, local_steps: int = 1,
          algorithm: str = "fedavg", mu: float = 0.01, client: str = "client",
          start: DataFrame | None = None, start_round: int = 0, on_round=None) -> DataFrame:
    """Rounds of local steps + merge. ``algorithm``: fedavg | fedprox | fedbn | fedpxn | single
    (no merge; pooled training is one client that holds all rows). fedprox and fedpxn add the proximal term after
    round 0, fedprox without the norm parameter; fedbn and fedpxn leave the norm parameter of clients and server as it is.
    Returns (round, client, idx, value) of the final round (client 'server' included when
    merging). ``on_round(round, params)`` lets callers persist each round (resume)."""
    if algorithm not in ("fedavg", "single", *LOCAL_NORM, *PROXIMAL):
        raise ValueError(f"unknown algorithm {algorithm}")
    feats = cut(features.select(client, "x", "y"))
    weights = cut(client_weights(feats, client))
    # site names: one per client, a handful of strings
    names = sorted(r[0] for r in weights.select(client).collect())
    server = None
    if start is None:
        params = cut(init_params(weights, dims, client))
        if algorithm != "single":
            server = params.where(F.col(client) == names[0]).select("idx", "value")
    else:
        params = start.where(F.col(client) != "server").select(client, "idx", "value")
        if algorithm != "single":
            server = start.where(F.col(client) == "server").select("idx", "value")
    for r in range(start_round, start_round + rounds):
        prox = server if algorithm in PROXIMAL and r > 0 else None
        for _ in range(local_steps):
            # a step reads the parameters twice: uncut, k steps would read the features 2^k times
            params = cut(local_step(feats, params, prox, lr, mu, client, skip=dims if algorithm == "fedprox" else None))
        if algorithm != "single":
            params, server = _merge(params, server, weights, names, dims, algorithm, client)
        if on_round is not None:
            on_round(r, _with_server(params, server, client))
    return _with_server(params, server, client).withColumn("round", F.lit(start_round + rounds - 1))


def _merge(params: DataFrame, server: DataFrame, weights: DataFrame, names: Sequence[str], dims: int, algorithm: str,
           client: str = "client") -> tuple[DataFrame, DataFrame]:
    """Weighted mean of the clients' parameters; every client restarts from it, but for its own norm parameter where
    the algorithm leaves that local. Returns the clients' and the server's parameters."""
    own = (F.col("idx") == dims) if algorithm in LOCAL_NORM else F.lit(False)
    merged = cut(_weighted(params.where(~own), weights, client).groupBy("idx").agg(
        F.sum(F.col("w") * F.col("value")).alias("value")))
    params = cut(merged.select(F.explode(F.array(*[F.lit(n) for n in names])).alias(client), "idx", "value")
                 .unionByName(params.where(own)))
    return params, cut(merged.unionByName(server.where(own)))


# ------------------------------------------------------------------------ mini-batches
def with_batches(features: DataFrame, batches: int, order: str, client: str = "client", pid: str = "pid") -> DataFrame:
    """Adds ``batch`` 0 .. ``batches`` - 1: a client's rows in the order of md5(pid_<order>), cut into equal runs (a client
    of fewer rows has rows in some batches only)."""
    key = F.md5(F.concat_ws("_", F.col(pid).cast("string"), F.lit(order)))
    x = rank_by_hash(features, [client], key, [F.col(pid)], "_k")
    return x.withColumn("batch", F.floor((F.col("_k") - 1) * batches / F.col("_k_n")).cast("int")).drop("_k", "_k_n")


def adam_step(state: DataFrame, g: DataFrame, lr: float, client: str = "client", betas: tuple[float, float] = (0.9, 0.999),
              eps: float = 1e-8) -> DataFrame:
    """One Adam update of (client, idx, value, m, v, t) by (client, idx, grad); clients without a gradient stay."""
    b1, b2 = betas
    x = state.join(g, [client, "idx"], "left")
    x = x.withColumns({"t": F.col("t") + F.col("grad").isNotNull().cast("int"),
                       "m": F.when(F.col("grad").isNull(), F.col("m")).otherwise(b1 * F.col("m") + (1 - b1) * F.col("grad")),
                       "v": F.when(F.col("grad").isNull(), F.col("v")).otherwise(b2 * F.col("v") + (1 - b2) * F.col("grad") * F.col("grad"))})
    size = F.col("m") / (1 - F.pow(F.lit(b1), F.col("t")))
    step = F.lit(lr) * size / (F.sqrt(F.col("v") / (1 - F.pow(F.lit(b2), F.col("t")))) + eps)
    return x.select(client, "idx", F.when(F.col("grad").isNull(), F.col("value")).otherwise(F.col("value") - step).alias("value"), "m", "v", "t")


def train_minibatch(features: DataFrame, dims: int, rounds: int, batches: int, epochs: int = 1, lr: float = 0.01,
                    algorithm: str = "fedavg", mu: float = 0.01, client: str = "client", pid: str = "pid", on_round=None) -> DataFrame:
    """Rounds of local epochs of mini-batch Adam + merge, over (pid, client, x, y). The optimiser is fresh for every
    client and round. fedprox and fedpxn pull towards the server after round 0, from an epoch's second batch on.
    Returns (round, client, idx, value) as ``train`` does."""
    if algorithm not in ("fedavg", "single", *LOCAL_NORM, *PROXIMAL):
        raise ValueError(f"unknown algorithm {algorithm}")
    feats = features.select(pid, client, "x", "y")
    weights = cut(client_weights(feats, client))
    names = sorted(r[0] for r in weights.select(client).collect())  # site names, a handful
    params, server = cut(init_params(weights, dims, client)), None
    if algorithm != "single":
        server = params.where(F.col(client) == names[0]).select("idx", "value")
    for r in range(rounds):
        state = params.select(client, "idx", "value", F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).alias("t"))
        for e in range(epochs):
            dealt = store(with_batches(feats, batches, f"{r}_{e}", client, pid), "batches", ["batch"])
            for b in range(batches):
                g = gradient(dealt.where(F.col("batch") == b), state, client)
                if algorithm in PROXIMAL and r > 0 and b > 0:
                    pull = F.lit(mu) * (F.col("value") - F.col("_s"))
                    if algorithm == "fedprox":
                        pull = F.when(F.col("idx") == dims, F.lit(0.0)).otherwise(pull)
                    g = g.join(state.select(client, "idx", "value"), [client, "idx"]).join(server.select("idx", F.col("value").alias("_s")), "idx")
                    g = g.select(client, "idx", (F.col("grad") + pull).alias("grad"))
                state = cut(adam_step(state, g, lr, client))
        params = state.select(client, "idx", "value")
        if algorithm != "single":
            params, server = _merge(params, server, weights, names, dims, algorithm, client)
        if on_round is not None:
            on_round(r, _with_server(params, server, client))
    return _with_server(params, server, client).withColumn("round", F.lit(rounds - 1))


def _with_server(params: DataFrame, server: DataFrame | None, client: str) -> DataFrame:
    if server is None:
        return params
    return params.unionByName(server.select(F.lit("server").alias(client), "idx", "value"))


def score(features: DataFrame, params: DataFrame, client: str = "client", digits: int = 9) -> DataFrame:
    """Logit ``z`` and ``score`` of every row under the model of its client."""
    j = features.join(F.broadcast(to_vectors(params, client)), client).withColumn("z", F.round(linear("x", "w"), digits))
    return j.drop("w").withColumn("score", sigmoid(F.col("z")))
