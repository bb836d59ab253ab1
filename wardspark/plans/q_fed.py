"""Federated-learning, scoring and metric queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.operators import fed as FD
from wardspark.operators import metrics as M
from wardspark.operators import tokens as TK
from wardspark.operators.util import hash_bucket
from wardspark.plans import q_tokens  # noqa: F401  (registers the token CTE fragments)
from wardspark.plans.catalog import query
from wardspark.plans.oracle_fx import cte, with_ctes
from wardspark.sources import fixtures as X
from wardspark.sources.stage import children, config_hash, cut, exists, fingerprint, remove, shared_dir

MU = 0.01
LOGIT = "(score - 0.5) * 8.0"


def logits(df):
    return df.withColumn("z", (F.col("score") - 0.5) * 8.0)


def params_clients(spark, d):
    p = X.fx_param(spark, d)
    return p.where(F.col("client") != "server"), p.where(F.col("client") == "server").drop("client")


def weights(spark, d):
    return FD.client_weights(X.fx_feature(spark, d))


def r6(c):
    return F.round(F.col(c), 6).alias(c)


# ============================================================================ DuckDB twins
cte("cw", ("fx_feature",), """
SELECT client, count(*) AS n, count(*) / sum(count(*)) OVER () AS w FROM fx_feature GROUP BY client""")
cte("pc", ("fx_param",), "SELECT * FROM fx_param WHERE client <> 'server'")
cte("ps", ("fx_param",), "SELECT name, idx, value FROM fx_param WHERE client = 'server'")
cte("fedavg", ("pc", "cw"), """
SELECT name, idx, CASE WHEN name LIKE '%num_batches_tracked%' THEN arg_min(value, p.client)
                       ELSE sum(w * value) END AS value
FROM pc p JOIN cw c ON p.client = c.client GROUP BY name, idx""")
cte("es", ("fx_metric",), """
SELECT *, max(CASE WHEN counter >= 10 THEN 1 ELSE 0 END)
            OVER (PARTITION BY client ORDER BY round ROWS UNBOUNDED PRECEDING) = 1 AS stopped
FROM (SELECT *, CAST(round - max(CASE WHEN improved THEN round END)
                  OVER (PARTITION BY client ORDER BY round ROWS UNBOUNDED PRECEDING) AS INTEGER) AS counter
      FROM (SELECT *, coalesce(auprc >= max(auprc) OVER (PARTITION BY client ORDER BY round
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM fx_metric) a) b""")
cte("gstop", ("es",), """
SELECT CASE WHEN count(*) FILTER (WHERE stop_round IS NULL) = 0 THEN max(stop_round) END AS stop_round
FROM (SELECT client, min(CASE WHEN stopped THEN round END) AS stop_round FROM es GROUP BY client) t""")
AP_SQL = """
SELECT {k}CASE WHEN max(tp) > 0 THEN round(sum(CASE WHEN tp > 0 THEN pos / tp * (cpos / cn) END), 6) END AS auprc
FROM (SELECT *, sum(pos) OVER (PARTITION BY {p} ORDER BY score DESC) AS cpos,
             sum(n) OVER (PARTITION BY {p} ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY {p}) AS tp
      FROM (SELECT {k}score, sum(y) AS pos, count(*) AS n FROM {src} GROUP BY {k}score) s) c
{g}"""
BCE_SQL = "greatest({z}, 0.0) - {z} * {y} + ln(1 + exp(-abs({z})))"


# ============================================================================ queries
@query("client_weights", with_ctes("SELECT client, n, round(w, 6) AS w FROM cw", "cw"))
def client_weights_q(spark, d):
    return weights(spark, d).select("client", "n", r6("w"))


@query("fed_avg", with_ctes("SELECT name, idx, round(value, 6) AS value FROM fedavg", "fedavg"))
def fed_avg(spark, d):
    p, _ = params_clients(spark, d)
    return FD.fed_avg(p, weights(spark, d)).select("name", "idx", r6("value"))


@query("fed_avg_counters", with_ctes(
    "SELECT name, idx, round(value, 6) AS value FROM fedavg WHERE name LIKE '%num_batches_tracked%'", "fedavg"))
def fed_avg_counters(spark, d):
    p, _ = params_clients(spark, d)
    s = FD.fed_avg(p, weights(spark, d))
    return s.where(F.col("name").contains(FD.COUNTER)).select("name", "idx", r6("value"))


@query("fed_bn", with_ctes("""
SELECT a.client, a.name, a.idx, round(CASE WHEN a.name LIKE '%norm%' THEN a.value ELSE s.v END, 6) AS value
FROM (SELECT client, name, idx, value FROM fx_param) a
LEFT JOIN (SELECT name, idx, sum(w * value) AS v FROM pc JOIN cw USING (client)
           WHERE name NOT LIKE '%norm%' GROUP BY name, idx) s ON a.name = s.name AND a.idx = s.idx""",
                          "fx_param", "pc", "cw"))
def fed_bn(spark, d):
    """Merge that leaves norm parameters local; every parameter of every client and the server."""
    p, s = params_clients(spark, d)
    return FD.fed_bn(p, s, weights(spark, d)).select("client", "name", "idx", r6("value"))


@query("prox_penalty", with_ctes(f"""
SELECT client, algorithm, round(penalty, 6) AS penalty FROM (
  SELECT p.client, 'fedprox' AS algorithm, {MU / 2} * sum(power(p.value - s.value, 2)) AS penalty
  FROM pc p JOIN ps s ON p.name = s.name AND p.idx = s.idx WHERE p.name NOT LIKE '%norm%' GROUP BY p.client
  UNION ALL
  SELECT p.client, 'fedpxn', {MU / 2} * sum(power(p.value - s.value, 2))
  FROM pc p JOIN ps s ON p.name = s.name AND p.idx = s.idx GROUP BY p.client) t""", "pc", "ps"))
def prox_penalty(spark, d):
    p, s = params_clients(spark, d)
    a = FD.prox_penalty(p, s, MU, include_norm=False).withColumn("algorithm", F.lit("fedprox"))
    b = FD.prox_penalty(p, s, MU, include_norm=True).withColumn("algorithm", F.lit("fedpxn"))
    return a.unionByName(b).select("client", "algorithm", r6("penalty"))


@query("bce_loss", with_ctes(f"""
SELECT client, round(avg({BCE_SQL.format(z=LOGIT, y='y')}), 6) AS loss FROM fx_score GROUP BY client""", "fx_score"))
def bce_loss(spark, d):
    return M.mean_bce(logits(X.fx_score(spark, d)), ["client"]).select("client", r6("loss"))


ML_Z = "((pid * 31 + k * 17) % 13 - 6) / 3.0"


@query("bce_multilabel", with_ctes(f"""
SELECT client, round(avg({BCE_SQL.format(z='z', y='y')}), 6) AS loss FROM (
  SELECT client, {ML_Z} AS z, CAST(list_contains(labels, k) AS INTEGER) AS y
  FROM fx_multilabel, range(1, 7) r(k)) t GROUP BY client""", "fx_multilabel"))
def bce_multilabel(spark, d):
    """Multi-label loss: every (sample, class) pair is one binary term, then the mean."""
    ml = X.fx_multilabel(spark, d)
    x = ml.select("pid", "client", "labels", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    x = x.select("client", (((F.col("pid") * 31 + F.col("k") * 17) % 13 - 6) / 3.0).alias("z"),
                 F.array_contains("labels", F.col("k")).cast("int").alias("y"))
    return M.mean_bce(x, ["client"]).select("client", r6("loss"))


@query("auprc", with_ctes(AP_SQL.format(k="client, ", p="client", src="fx_score", g="GROUP BY client"), "fx_score"))
def auprc(spark, d):
    return M.average_precision(X.fx_score(spark, d), ["client"]).select("client", r6("auprc"))


@query("auprc_micro", with_ctes(AP_SQL.format(k="", p="1", src="fx_score", g=""), "fx_score"))
def auprc_micro(spark, d):
    s = X.fx_score(spark, d)
    return M.average_precision(s, []).select(r6("auprc"))


@query("epoch_loss", with_ctes(f"""
SELECT client, round(sum(bl) / count(*), 6) AS loss FROM (
  SELECT client, batch, avg({BCE_SQL.format(z=LOGIT, y='y')}) AS bl FROM fx_score GROUP BY client, batch) t
GROUP BY client""", "fx_score"))
def epoch_loss(spark, d):
    s = logits(X.fx_score(spark, d)).withColumn("loss", M.bce_with_logits(F.col("z"), F.col("y").cast("double")))
    return M.epoch_loss(s, ["client"]).select("client", r6("loss"))


@query("early_stop", with_ctes("SELECT client, round, improved, counter, stopped FROM es", "es"))
def early_stop(spark, d):
    return M.early_stopping(X.fx_metric(spark, d)).select("client", "round", "improved", "counter", "stopped")


@query("global_stop_round", with_ctes("SELECT stop_round FROM gstop", "gstop"))
def global_stop_round(spark, d):
    return M.global_stop(M.early_stopping(X.fx_metric(spark, d)))


@query("best_round", with_ctes("""
SELECT client, max(CASE WHEN improved THEN round END) AS best_round FROM es, gstop
WHERE gstop.stop_round IS NULL OR round <= gstop.stop_round GROUP BY client""", "es", "gstop"))
def best_round(spark, d):
    return M.best_round(M.early_stopping(X.fx_metric(spark, d)))


@query("metrics_long", with_ctes("""
SELECT key, round, value FROM (
  SELECT 'valid/' || client || '_auprc' AS key, round, CAST(auprc AS DOUBLE) AS value FROM m UNION ALL
  SELECT 'valid/' || client || '_n_events', round, CAST(n_events AS DOUBLE) FROM m) t""".replace(
    "FROM m", "FROM (SELECT event_type AS client, CAST(dayofyear(ts) - 1 AS INTEGER) AS round, "
    "round(avg(value), 1) AS auprc, count(*) AS n_events FROM events GROUP BY 1, 2) m")))
def metrics_long(spark, d):
    e = X.read(spark, d, "events")
    rec = e.groupBy(F.col("event_type").alias("client"), (F.dayofyear("ts") - 1).alias("round")).agg(
        F.round(F.avg("value"), 1).alias("auprc"), F.count(F.lit(1)).alias("n_events"))
    rec = rec.withColumn("split", F.lit("valid"))
    return M.flatten_records(rec, "split", "client", ["auprc", "n_events"], ["round"])


@query("param_count", with_ctes("SELECT client, name, count(*) AS n FROM fx_param GROUP BY client, name", "fx_param"))
def param_count(spark, d):
    return X.fx_param(spark, d).groupBy("client", "name").agg(F.count(F.lit(1)).alias("n"))


cte("sc_w", ("fx_feature",), """
SELECT list(w ORDER BY k) AS w FROM (
  SELECT k, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS w
  FROM (SELECT y, unnest(x) AS v, unnest(range(0, len(x))) AS k FROM fx_feature) e GROUP BY k) t""")
cte("sc", ("fx_feature", "sc_w"), """
SELECT pid, client, y, z, 1.0 / (1.0 + exp(-z)) AS score,
  CASE CAST(('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 8)) AS BIGINT) % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid'
       ELSE 'train' END AS split
FROM (SELECT pid, client, y, round(list_sum(list_transform(list_zip(x, w), lambda p: p[1] * p[2])), 9) AS z
      FROM fx_feature, sc_w) t""")


@query("score_clients", with_ctes(f"""
SELECT l.client, l.split, l.loss, a.auprc FROM
 (SELECT client, split, round(avg({BCE_SQL.format(z='z', y='y')}), 6) AS loss FROM sc GROUP BY client, split) l
 JOIN ({AP_SQL.format(k="client, split, ", p="client, split", src="sc", g="GROUP BY client, split")}) a
 ON l.client = a.client AND l.split = a.split""", "sc"))
def score_clients(spark, d):
    """Validate/test every client and split: linear scores -> sigmoid -> loss and AP."""
    f = X.fx_feature(spark, d)
    ex = f.select("y", F.posexplode("x").alias("k", "v"))
    w = ex.groupBy("k").agg((F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v"))))
                            .alias("w"))
    wv = w.agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("_s")).select(
        F.transform("_s", lambda s: s["w"]).alias("w"))
    x = f.withColumn("_w", wv.scalar())  # one dims-long vector
    z = F.aggregate(F.zip_with("x", "_w", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    b = hash_bucket(F.col("pid"), 10)
    x = x.select("pid", "client", "y", F.round(z, 9).alias("z"),
                 F.when(b == 0, F.lit("test")).when(b == 1, F.lit("valid")).otherwise(F.lit("train")).alias("split"))
    x = x.withColumn("score", M.sigmoid(F.col("z")))
    loss = M.mean_bce(x, ["client", "split"]).select("client", "split", r6("loss"))
    ap = M.average_precision(x, ["client", "split"]).select("client", "split", r6("auprc"))
    return loss.join(ap, ["client", "split"])


@query("experiment_grid", with_ctes("""
SELECT task, 'single' AS train_type, client AS dataset, 'none' AS algorithm, seed FROM
  (SELECT DISTINCT client FROM client_src) c, (SELECT unnest(['mort', 'los3', 'los7', 'readm', 'dx']) AS task) t, seeds
UNION ALL SELECT task, 'pooled', 'pooled', 'none', seed FROM
  (SELECT unnest(['mort', 'los3', 'los7', 'readm', 'dx']) AS task) t, seeds
UNION ALL SELECT task, 'federated', 'all', algorithm, seed FROM
  (SELECT unnest(['mort', 'los3', 'los7', 'readm', 'dx']) AS task) t, seeds,
  (SELECT unnest(['fedavg', 'fedprox', 'fedbn', 'fedpxn']) AS algorithm) a""", "client_src", "seeds"))
def experiment_grid(spark, d):
    """Run table task x dataset x seed (x algorithm); datasets are the clients in the data."""
    from wardspark.plans.q_folds import client_sources
    tasks = F.explode(F.array(*[F.lit(t) for t in ("mort", "los3", "los7", "readm", "dx")]))
    seeds = F.explode(F.array(*[F.lit(s) for s in (2020, 2021, 2022, 2023, 2024)]))
    algos = F.explode(F.array(*[F.lit(a) for a in ("fedavg", "fedprox", "fedbn", "fedpxn")]))
    clients = client_sources(spark, d).select(F.col("client").alias("dataset")).distinct()
    single = clients.select(tasks.alias("task"), "dataset").select(
        "task", F.lit("single").alias("train_type"), "dataset", F.lit("none").alias("algorithm"), seeds.alias("seed"))
    one = clients.agg(F.count(F.lit(1)).alias("_n"))
    pooled = one.select(tasks.alias("task")).select(
        "task", F.lit("pooled").alias("train_type"), F.lit("pooled").alias("dataset"), F.lit("none").alias("algorithm"),
        seeds.alias("seed"))
    fed = one.select(tasks.alias("task")).select("task", algos.alias("algorithm")).select(
        "task", F.lit("federated").alias("train_type"), F.lit("all").alias("dataset"), "algorithm", seeds.alias("seed"))
    return single.unionByName(pooled).unionByName(fed)


# ----------------------------------------------------------------------------- learner runs
DIMS, LR = 64, 0.5
ALGORITHMS = ("fedavg", "fedprox", "fedbn", "fedpxn")


def learner_sql(src: str, algorithms, rounds: int, steps: int) -> tuple[str, list[str]]:
    """DuckDB CTEs of the learner over ``src`` (pid, client, x, y): ``p<r>`` holds the clients'
    parameters (algorithm, client, k, w) after round r, ``s<r>`` the server's."""
    algos = ", ".join(f"'{a}'" for a in algorithms)
    out = [f"""ft AS MATERIALIZED (SELECT pid, client, y, unnest(list_append(x, 1.0)) AS v, unnest(range(0, {DIMS + 1})) AS k FROM {src})""",
           f"cn AS MATERIALIZED (SELECT client, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {src} GROUP BY client)",
           f"""q0 AS MATERIALIZED (SELECT algorithm, client, k, 0.0::DOUBLE AS w FROM cn, range(0, {DIMS + 1}) r(k), (SELECT unnest([{algos}]) AS algorithm))""",
           f"s_init AS (SELECT DISTINCT algorithm, k, w FROM q0)"]
    last, server, i = "q0", "s_init", 0
    for r in range(rounds):
        pull = "0.0" if r == 0 else (f"CASE WHEN p.algorithm = 'fedpxn' OR (p.algorithm = 'fedprox' AND p.k < {DIMS}) THEN {MU}::DOUBLE * (p.w - s.w) ELSE 0.0 END")
        for _ in range(steps):
            i += 1
            out.append(f"""z{i} AS MATERIALIZED (SELECT p.algorithm, f.pid, f.client, 1.0 / (1.0 + exp(-sum(f.v * p.w))) - any_value(f.y) AS e
  FROM ft f JOIN {last} p ON f.client = p.client AND f.k = p.k GROUP BY p.algorithm, f.pid, f.client)""")
            out.append(f"""g{i} AS MATERIALIZED (SELECT z.algorithm, z.client, f.k, sum(f.v * z.e) / any_value(c.n) AS g
  FROM z{i} z JOIN ft f ON z.pid = f.pid AND z.client = f.client JOIN cn c ON c.client = z.client GROUP BY z.algorithm, z.client, f.k)""")
            out.append(f"""q{i} AS MATERIALIZED (SELECT p.algorithm, p.client, p.k, p.w - {LR}::DOUBLE * (g.g + {pull}) AS w
  FROM {last} p JOIN g{i} g USING (algorithm, client, k) LEFT JOIN {server} s ON s.algorithm = p.algorithm AND s.k = p.k)""")
            last = f"q{i}"
        own = f"(a.algorithm IN ('fedbn', 'fedpxn') AND a.k = {DIMS})"
        out.append(f"""s{r} AS MATERIALIZED (SELECT a.algorithm, a.k, CASE WHEN {own} THEN any_value(o.w) ELSE sum(a.w * c.share) END AS w
  FROM {last} a JOIN cn c ON a.client = c.client JOIN {server} o ON o.algorithm = a.algorithm AND o.k = a.k GROUP BY a.algorithm, a.k)""")
        out.append(f"""p{r} AS MATERIALIZED (SELECT a.algorithm, a.client, a.k, CASE WHEN a.algorithm = 'single' OR {own} THEN a.w ELSE s.w END AS w
  FROM {last} a JOIN s{r} s ON s.algorithm = a.algorithm AND s.k = a.k)""")
        last, server = f"p{r}", f"s{r}"
    return ",\n".join(out), [f"p{r}" for r in range(rounds)]


def _fx(sql: str) -> str:
    """``sql``, more WITH items and a body, after ``fx_feature``."""
    return with_ctes(",\n" + sql, "fx_feature")


def _round_out(p):
    return p.select("client", "idx", F.round("value", 6).alias("value"))


@query("fed_round", _fx(learner_sql("fx_feature", ALGORITHMS, 3, 3)[0] + """
SELECT algorithm, client, k::INTEGER AS idx, round(w, 6) AS value FROM p2
UNION ALL SELECT algorithm, 'server', k::INTEGER, round(w, 6) FROM s2"""))
def fed_round(spark, d):
    """Three federated rounds of three local steps of the distributed logistic learner, by each algorithm."""
    f = X.fx_feature(spark, d)
    out = None
    for a in ALGORITHMS:
        p = FD.train(f, DIMS, rounds=3, lr=LR, local_steps=3, algorithm=a, mu=MU)
        p = p.select(F.lit(a).alias("algorithm"), "client", "idx", F.round("value", 6).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


@query("single_train", _fx("one AS (SELECT * FROM fx_feature WHERE client = '0'),\n" + learner_sql("one", ["single"], 3, 1)[0] + """
SELECT client, k::INTEGER AS idx, round(w, 6) AS value FROM p2"""))
def single_train(spark, d):
    """One client trained alone (no merging)."""
    f = X.fx_feature(spark, d).where(F.col("client") == "0")
    return _round_out(FD.train(f, DIMS, rounds=3, lr=LR, algorithm="single"))


@query("pooled_run", _fx("pool AS (SELECT pid, 'pooled' AS client, x, y FROM fx_feature),\n" + learner_sql("pool", ["single"], 3, 1)[0] + """
SELECT client, k::INTEGER AS idx, round(w, 6) AS value FROM p2"""))
def pooled_run(spark, d):
    """All clients' rows trained as one pooled set."""
    f = X.fx_feature(spark, d).withColumn("client", F.lit("pooled"))
    return _round_out(FD.train(f, DIMS, rounds=3, lr=LR, algorithm="single"))


SPLIT_SQL = """CASE CAST(('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 8)) AS BIGINT) % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END"""


def split_of(pid: str = "pid"):
    b = hash_bucket(F.col(pid), 10)
    return F.when(b == 0, F.lit("test")).when(b == 1, F.lit("valid")).otherwise(F.lit("train"))


@query("fed_history", _fx(f"sp AS (SELECT *, {SPLIT_SQL} AS split FROM fx_feature),\ntr AS (SELECT * FROM sp WHERE split = 'train'),\n"
                          + learner_sql("tr", ["fedavg"], 4, 1)[0] + ",\nhp AS ("
                          + " UNION ALL ".join(f"SELECT {r}::INTEGER AS round, client, k, w FROM p{r}" for r in range(4)) + f"""),
sc AS (SELECT round, pid, client, y, z, 1.0 / (1.0 + exp(-z)) AS score FROM (
  SELECT h.round, f.pid, f.client, f.y, round(sum(f.v * h.w), 9) AS z
  FROM (SELECT pid, client, y, unnest(list_append(x, 1.0)) AS v, unnest(range(0, {DIMS + 1})) AS k FROM sp WHERE split = 'valid') f
  JOIN hp h ON h.client = f.client AND h.k = f.k GROUP BY h.round, f.pid, f.client, f.y) t),
m AS (SELECT l.client, l.round, l.loss, a.auprc FROM
 (SELECT client, round, round(avg({BCE_SQL.format(z='z', y='y')}), 6) AS loss FROM sc GROUP BY client, round) l
 JOIN ({AP_SQL.format(k="client, round, ", p="client, round", src="sc", g="GROUP BY client, round")}) a USING (client, round)),
im AS (SELECT *, coalesce(auprc >= max(auprc) OVER (PARTITION BY client ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM m)
SELECT client, round, loss, auprc, improved FROM im"""))
def fed_history(spark, d):
    """Train on the train split; after every round score the clients' valid rows with the round's
    model; loss, average precision and whether the round improved the client."""
    f = X.fx_feature(spark, d).withColumn("split", split_of())
    seen = []
    FD.train(f.where("split = 'train'"), DIMS, rounds=4, lr=LR, on_round=lambda r, p: seen.append(
        FD.score(f.where("split = 'valid'"), p.where("client <> 'server'")).withColumn("round", F.lit(r))))
    s = seen[0]
    for x in seen[1:]:
        s = s.unionByName(x)
    loss = M.mean_bce(s, ["client", "round"]).select("client", "round", r6("loss"))
    m = loss.join(M.average_precision(s, ["client", "round"]).select("client", "round", r6("auprc")), ["client", "round"])
    return M.early_stopping(m).select("client", "round", "loss", "auprc", "improved")


@query("round_resume", _fx(learner_sql("fx_feature", ["fedavg"], 3, 1)[0] + """
SELECT client, k::INTEGER AS idx, round(w, 6) AS value FROM p2
UNION ALL SELECT 'server', k::INTEGER, round(w, 6) FROM s2"""))
def round_resume(spark, d):
    """Persist every round, restart from the last complete round, finish the run. The folder is named by the run's
    configuration and a fingerprint of its input, so another process finds the same rounds and changed input
    none; a finished run removes it."""
    cfg = {"input": d, "state": fingerprint(spark, [f"{d}/embeddings.parquet"]), "algorithm": "fedavg", "lr": 0.5, "local_steps": 1, "dims": DIMS}
    root = f"{shared_dir(spark)}/fed_rounds-{config_hash(cfg)}"
    f = X.fx_feature(spark, d)

    def save(r, p):
        p.write.mode("overwrite").parquet(f"{root}/round={r}")

    def resume(total):
        last = max(_complete_rounds(spark, root), default=-1)
        if last >= total - 1:
            return spark.read.parquet(f"{root}/round={total - 1}").withColumn("round", F.lit(total - 1))
        start = spark.read.parquet(f"{root}/round={last}") if last >= 0 else None
        return FD.train(f, DIMS, rounds=total - 1 - last, algorithm="fedavg", start=start, start_round=last + 1, on_round=save)

    resume(2)
    out = cut(_round_out(resume(3)))
    remove(spark, root)
    return out


def _complete_rounds(spark, root):
    """Rounds under ``root`` whose write was finished."""
    names = [c.rsplit("/", 1)[-1] for c in children(spark, root)]
    return [int(n.split("=")[-1]) for n in names if n.startswith("round=") and exists(spark, f"{root}/{n}/_SUCCESS")]


# --------------------------------------------------------------------------- mini-batches
ADAM_LR, ADAM_BATCHES = 0.05, 3
ADAM_ALGORITHMS = ("fedavg", "fedpxn")


def adam_sql(src: str, algorithms, rounds: int, epochs: int, batches: int) -> str:
    """DuckDB CTEs of the mini-batch learner over ``src`` (pid, client, x, y): ``ap<r>`` and ``as<r>`` as in learner_sql."""
    algos = ", ".join(f"'{a}'" for a in algorithms)
    out = [f"""aft AS MATERIALIZED (SELECT pid, client, y, unnest(list_append(x, 1.0)) AS v, unnest(range(0, {DIMS + 1})) AS k FROM {src})""",
           f"acn AS MATERIALIZED (SELECT client, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM {src} GROUP BY client)",
           f"""aq0 AS MATERIALIZED (SELECT algorithm, client, k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0 AS t
  FROM acn, range(0, {DIMS + 1}) r(k), (SELECT unnest([{algos}]) AS algorithm))""",
           "as_init AS (SELECT DISTINCT algorithm, k, w FROM aq0)"]
    last, server, i = "aq0", "as_init", 0
    for r in range(rounds):
        if r:
            out.append(f"af{r} AS MATERIALIZED (SELECT algorithm, client, k, w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0 AS t FROM {last})")
            last = f"af{r}"
        for e in range(epochs):
            key = f"md5(CAST(pid AS VARCHAR) || '_{r}_{e}')"
            out.append(f"""ab{r}_{e} AS MATERIALIZED (SELECT pid, client, (row_number() OVER (PARTITION BY client ORDER BY {key}, pid) - 1) * {batches}
    // count(*) OVER (PARTITION BY client) AS b FROM {src})""")
            for b in range(batches):
                i += 1
                pull = "0.0" if r == 0 or b == 0 else (f"CASE WHEN p.algorithm = 'fedpxn' OR (p.algorithm = 'fedprox' AND p.k < {DIMS}) THEN {MU}::DOUBLE * (p.w - s.w) ELSE 0.0 END")
                out.append(f"""az{i} AS MATERIALIZED (SELECT p.algorithm, f.pid, f.client, 1.0 / (1.0 + exp(-sum(f.v * p.w))) - any_value(f.y) AS e
  FROM aft f JOIN ab{r}_{e} o ON o.pid = f.pid AND o.client = f.client AND o.b = {b} JOIN {last} p ON f.client = p.client AND f.k = p.k GROUP BY p.algorithm, f.pid, f.client)""")
                out.append(f"""ag{i} AS MATERIALIZED (SELECT z.algorithm, z.client, f.k, avg(f.v * z.e) AS g
  FROM az{i} z JOIN aft f ON z.pid = f.pid AND z.client = f.client GROUP BY z.algorithm, z.client, f.k)""")
                out.append(f"""aq{i} AS MATERIALIZED (SELECT algorithm, client, k, CASE WHEN g IS NULL THEN w ELSE
    w - {ADAM_LR}::DOUBLE * (m / (1 - power(0.9::DOUBLE, t))) / (sqrt(v / (1 - power(0.999::DOUBLE, t))) + 1e-8::DOUBLE) END AS w, m, v, t FROM (
  SELECT algorithm, client, k, w, g, t + CASE WHEN g IS NULL THEN 0 ELSE 1 END AS t, CASE WHEN g IS NULL THEN m ELSE 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g END AS m,
    CASE WHEN g IS NULL THEN v ELSE 0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * g * g END AS v FROM (
  SELECT p.algorithm, p.client, p.k, p.w, p.m, p.v, p.t, g.g + {pull} AS g
  FROM {last} p LEFT JOIN ag{i} g USING (algorithm, client, k) LEFT JOIN {server} s ON s.algorithm = p.algorithm AND s.k = p.k) x) y)""")
                last = f"aq{i}"
        own = f"(a.algorithm IN ('fedbn', 'fedpxn') AND a.k = {DIMS})"
        out.append(f"""as{r} AS MATERIALIZED (SELECT a.algorithm, a.k, CASE WHEN {own} THEN any_value(o.w) ELSE sum(a.w * c.share) END AS w
  FROM {last} a JOIN acn c ON a.client = c.client JOIN {server} o ON o.algorithm = a.algorithm AND o.k = a.k GROUP BY a.algorithm, a.k)""")
        out.append(f"""ap{r} AS MATERIALIZED (SELECT a.algorithm, a.client, a.k, CASE WHEN a.algorithm = 'single' OR {own} THEN a.w ELSE s.w END AS w
  FROM {last} a JOIN as{r} s ON s.algorithm = a.algorithm AND s.k = a.k)""")
        last, server = f"ap{r}", f"as{r}"
    return ",\n".join(out)


@query("fed_minibatch", _fx(adam_sql("fx_feature", ADAM_ALGORITHMS, 2, 1, ADAM_BATCHES) + """
SELECT algorithm, client, k::INTEGER AS idx, round(w, 5) AS value FROM ap1
UNION ALL SELECT algorithm, 'server', k::INTEGER, round(w, 5) FROM as1"""))
def fed_minibatch(spark, d):
    """Two rounds of one local epoch of mini-batch Adam, by each algorithm."""
    out = None
    for a in ADAM_ALGORITHMS:
        p = FD.train_minibatch(X.fx_feature(spark, d), DIMS, rounds=2, batches=ADAM_BATCHES, lr=ADAM_LR, algorithm=a, mu=MU)
        p = p.select(F.lit(a).alias("algorithm"), "client", "idx", F.round("value", 5).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


@query("fed_test", _fx(f"sp AS (SELECT *, {SPLIT_SQL} AS split FROM fx_feature),\ntr AS (SELECT * FROM sp WHERE split = 'train'),\n"
                       + adam_sql("tr", ["fedavg"], 3, 1, 2) + ",\nhp AS ("
                       + " UNION ALL ".join(f"SELECT {r}::INTEGER AS round, client, k, w FROM ap{r}" for r in range(3)) + f"""),
sc AS (SELECT split, round, pid, client, y, z, 1.0 / (1.0 + exp(-z)) AS score FROM (
  SELECT f.split, h.round, f.pid, f.client, f.y, round(sum(f.v * h.w), 6) AS z
  FROM (SELECT split, pid, client, y, unnest(list_append(x, 1.0)) AS v, unnest(range(0, {DIMS + 1})) AS k FROM sp WHERE split <> 'train') f
  JOIN hp h ON h.client = f.client AND h.k = f.k GROUP BY f.split, h.round, f.pid, f.client, f.y) t),
va AS (SELECT * FROM sc WHERE split = 'valid'),
m AS ({AP_SQL.format(k="client, round, ", p="client, round", src="va", g="GROUP BY client, round")}),
im AS (SELECT *, coalesce(auprc >= max(auprc) OVER (PARTITION BY client ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM m),
br AS (SELECT client, max(round) FILTER (WHERE improved) AS best FROM im GROUP BY client),
te AS (SELECT sc.* FROM sc JOIN br ON br.client = sc.client AND br.best = sc.round WHERE split = 'test')
SELECT l.client, best AS best_round, l.loss, a.auprc FROM br JOIN
 (SELECT client, round(avg({BCE_SQL.format(z='z', y='y')}), 6) AS loss FROM te GROUP BY client) l USING (client)
 JOIN ({AP_SQL.format(k="client, ", p="client", src="te", g="GROUP BY client")}) a ON l.client = a.client"""))
def fed_test(spark, d):
    """Train on the train split, keep every round's model, and score each client's test rows once, with the
    model of its best validated round."""
    f = X.fx_feature(spark, d).withColumn("split", split_of())
    rounds = []
    FD.train_minibatch(f.where("split = 'train'"), DIMS, rounds=3, batches=2, lr=ADAM_LR,
                       on_round=lambda r, p: rounds.append(p.where("client <> 'server'").withColumn("round", F.lit(r))))
    valid = [FD.score(f.where("split = 'valid'"), p.drop("round"), digits=6).withColumn("round", F.lit(r)) for r, p in enumerate(rounds)]
    m = M.average_precision(reduce(DataFrame.unionByName, valid), ["client", "round"])
    best = cut(M.best_round(M.early_stopping(m)))
    params = reduce(DataFrame.unionByName, rounds).join(best, "client").where("round = best_round")
    s = FD.score(f.where("split = 'test'"), params.select("client", "idx", "value"), digits=6)
    loss = M.mean_bce(s, ["client"]).select("client", r6("loss"))
    return loss.join(M.average_precision(s, ["client"]).select("client", r6("auprc")), "client").join(best, "client").select("client", "best_round", "loss", "auprc")


@query("batch_pad", with_ctes("""
SELECT "ID", client, batch, target_seq, target_word,
  md5(array_to_string(list_transform(padded, lambda r: array_to_string(r, ',')), '|')) AS ids_md5
FROM (SELECT *, CASE WHEN len(rows) >= target_seq THEN rows[1:target_seq]
                     ELSE list_concat(rows, list_transform(range(target_seq - len(rows)),
                          lambda x: list_concat([101], list_transform(range(target_word - 1), lambda y: 0)))) END AS padded
      FROM (SELECT *, list_transform(evs, lambda e: CASE WHEN len(e) >= target_word THEN e[1:target_word]
                          ELSE list_concat(e, list_transform(range(target_word - len(e)), lambda y: 0)) END) AS rows
            FROM tk_batch) a) b""", "tk_batch"))
def batch_pad(spark, d):
    """Collator shapes and padding per batch of 64 patients within a client."""
    from wardspark.plans.q_tokens import sequence_stage
    s = sequence_stage(spark, d).withColumn("client", (F.col("ID") % 3).cast("string"))
    b = TK.batch_sizes(s, "client", "ID")
    p = TK.pad_sample(F.col("ids"), F.col("target_seq"), F.col("target_word"), TK.CLS)
    txt = F.array_join(F.transform(p, lambda e: F.array_join(F.transform(e, lambda v: v.cast("string")), ",")), "|")
    return b.select("ID", "client", "batch", "target_seq", "target_word", F.md5(txt).alias("ids_md5"))


EMBED_TOK = ("(SELECT \"ID\", \"ORDER\" AS ev, unnest(ids) AS i, unnest(types) AS t, unnest(dpes) AS d, unnest(range(len(ids))) AS j, "
             "(SELECT count(*) FROM embeddings) AS n FROM tk_budget WHERE in_budget AND \"ID\" IN "
             "(SELECT \"ID\" FROM tk_nb WHERE n_budget <= 256)) tok")


def embed_sql(tok: str) -> str:
    return f"""
SELECT "ID", string_agg(printf('%.6f', v), ',' ORDER BY k) AS pooled FROM (
  SELECT "ID", k, avg(v) AS v FROM (
    SELECT x."ID", x.ev, x.j, e.k, sum(e.v) AS v FROM (
      SELECT "ID", ev, j, ((i % n) + n) % n AS vec_id FROM {tok} UNION ALL
      SELECT "ID", ev, j, ((t % n) + n) % n FROM {tok} UNION ALL
      SELECT "ID", ev, j, ((d + 100) % n + n) % n FROM {tok}) x
    JOIN (SELECT vec_id, unnest(range(0, len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) e
      ON x.vec_id = e.vec_id
    GROUP BY x."ID", x.ev, x.j, e.k) a
  GROUP BY "ID", k) b
GROUP BY "ID" """


def pooled_vectors(spark, d, first_only: bool = False):
    """Token + type + digit-place vectors, mean over a patient's non-padding tokens (or its first token alone).

    The sum is linear: (patient, vector id) is counted first, combining map-side, so a hot vector id meets the
    vectors at most once a patient; one aggregate then adds whole vectors."""
    from wardspark.plans.q_tokens import sequence_stage
    s = sequence_stage(spark, d)
    flat = s.select("ID", F.posexplode(F.flatten(F.transform(
        F.arrays_zip(F.col("ids").alias("a"), F.col("types").alias("b"), F.col("dpes").alias("c")),
        lambda e: F.arrays_zip(e["a"].alias("i"), e["b"].alias("t"), e["c"].alias("d"))))).alias("pos", "tok"))
    if first_only:
        flat = flat.where("pos = 0")
    emb = X.read(spark, d, "embeddings").select("vec_id", "embedding")
    flat = flat.withColumn("_n", emb.agg(F.count(F.lit(1)).alias("n")).scalar())
    keys = flat.select("ID", F.explode(F.array(
        F.pmod(F.col("tok.i"), F.col("_n")), F.pmod(F.col("tok.t"), F.col("_n")),
        F.pmod(F.col("tok.d") + 100, F.col("_n")))).alias("vec_id"))
    counted = keys.groupBy("ID", "vec_id").agg(F.count(F.lit(1)).alias("c"))
    tokens = flat.groupBy("ID").agg(F.count(F.lit(1)).alias("m"))
    part = counted.join(emb, "vec_id").select("ID", array_to_vector(F.transform("embedding", lambda v: v.cast("double") * F.col("c"))).alias("_v"))
    total = part.groupBy("ID").agg(Summarizer.sum(F.col("_v")).alias("_v"))
    out = total.join(tokens, "ID")
    return out.select("ID", F.array_join(F.transform(vector_to_array("_v"), lambda v: F.format_string("%.6f", v / F.col("m"))), ",").alias("pooled"))


@query("embed_pool", with_ctes(embed_sql(EMBED_TOK), "tk_budget", "tk_nb"))
def embed_pool(spark, d):
    return pooled_vectors(spark, d)


@query("embed_first", with_ctes(embed_sql(
    f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"ID\" ORDER BY ev, j) AS rn FROM {EMBED_TOK}) q WHERE rn = 1) tok"),
    "tk_budget", "tk_nb"))
def embed_first(spark, d):
    """First-row pooling: the vector of a patient's first token."""
    return pooled_vectors(spark, d, first_only=True)
