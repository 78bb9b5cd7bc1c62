"""Document quality by hierarchical empirical Bayes.

A classifier of the text gives each document its own evidence. Sites say more: the
mean evidence of a host, and below it of a path, is a posterior that shrinks toward
the level above. How strongly is read from the data: between-site variance against
within-site variance gives each level's concentration, in pseudo documents. Sparse
sites stay near the global prior, large ones speak for themselves. A document leaves
itself out of its site's figures. Evidence and site are added as log-odds.

Sites are only aggregated, with partial sums before the shuffle. The classifier alone
is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.joins import join_small
from ..session import stage
from .common import text_or_empty

FEATURES = 10


@dataclass(frozen=True)
class QualityModelRules:
    """``sample`` bounds the labelled rows that the classifier is fitted on."""

    sample: int = 40_000
    threshold: float = 0.5
    least_variance: float = 1e-4
    site_weight: float = 0.5  # of the site's log-odds beside the document's own


def text_figures(text: bytes) -> list[float]:
    """Features of a text in UTF-8: length, repetition, symbols, case, lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text) - sum(map(len, lines)) + sum(map(len, words))
    upper = sum(text.count(c) for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    symbols = sum(text.count(c) for c in b"#*$%&<>|")
    return [
        math.log1p(n) / 5,
        adjacent / n,
        1 - len(set(words)) / n,
        min(3.0, symbols / n),
        min(1.0, text.count(b"|") / n),
        min(1.0, text.count(b"!!") / n),
        min(1.0, upper / max(1, letters)),
        min(2.0, letters / n / 10),
        1 - len(set(lines)) / len(lines),
        0.0,
    ]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge by Newton steps; the bias comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _concentration(groups: DataFrame, mean, rules: QualityModelRules) -> float:
    """Pseudo documents of a level's prior: within variance over between variance.

    ``groups`` has n, s (sum) and q (sum of squares) of each group, ``mean`` is the
    column of the level above. One row of sums comes to the driver.
    """
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2))
    r = groups.agg(
        within.alias("w"), spread.alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"),
        (F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("scale"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return 1.0
    inside = max((r["w"] or 0.0) / max(1, r["n"] - r["k"]), rules.least_variance)
    between = (r["b"] - (r["k"] - 1) * inside) / max(r["scale"], 1.0)
    return round(inside / max(between, rules.least_variance), 6)


def _logit(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    held_out,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    rules: QualityModelRules = QualityModelRules(),
) -> DataFrame:
    """Rows (doc_id, evidence, host_posterior, path_posterior, score, kept) of ``docs``.

    ``evidence`` is the classifier's probability, ``score`` the combination, both
    rounded to six decimals; ``kept`` is true at the threshold. Rows for which the
    boolean column expression ``held_out`` is true teach the classifier nothing. Null
    and empty texts have no words and get the evidence of such texts; null hosts and
    paths are sites of their own. Repeated rows count each. Without labels of both
    kinds all evidence is 0.5.
    """
    sc = docs.sparkSession.sparkContext
    known = labels.filter("quality is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("quality").cast("int").alias("y")
    )
    rows = docs.select(
        F.col(doc_id).alias("_id"), held_out.alias("_out"), text_or_empty(text).cast("binary").alias("_text")
    )
    train = join_small(rows.filter("not _out").select("_id", "_text"), known, ["_id"])
    sample = train.orderBy(F.xxhash64("_id"), "_id").limit(rules.sample).select("_text", "y")

    def features(batches):
        for batch in batches:
            x = [text_figures(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"]
            )

    found = sample.mapInArrow(features, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in found], float)
    both = len(set(y.tolist())) == 2
    weights = _fit(np.array([r["x"] for r in found]), y) if both else np.zeros(FEATURES + 1)
    shared = sc.broadcast(weights)

    def evidence(batches):
        w = shared.value
        for batch in batches:
            x = np.array([text_figures(t) for t in batch.columns[-1].to_pylist()]).reshape(-1, FEATURES)
            p = np.round(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))), 6)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p, pa.float64())], names=["doc_id", "host", "path", "p"]
            )

    sites = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        text_or_empty(text).cast("binary").alias("_text"),
    )
    schema = T.StructType([*[sites.schema[c] for c in ("doc_id", "host", "path")], T.StructField("p", T.DoubleType())])
    scored = stage(sites.mapInArrow(evidence, schema), "quality-evidence")

    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    by_path = stage(scored.groupBy("host", "path").agg(*sums), "quality-paths")
    by_host = by_path.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = by_host.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = round(total["s"] / total["n"], 6) if total["n"] else 0.5
    k_host = _concentration(by_host, F.lit(prior), rules)
    host_mean = (k_host * F.lit(prior) + F.col("hs")) / (k_host + F.col("hn"))
    hosts = by_host.select("host", F.col("n").alias("hn"), F.col("s").alias("hs"))
    placed = by_path.join(hosts, "host")
    k_path = _concentration(placed, host_mean, rules)

    figures = placed.select("host", "path", "n", "s", "hn", "hs")
    joined = join_small(scored, figures, ["host", "path"], spread=["doc_id"])
    own = F.col("p")
    host_posterior = (k_host * F.lit(prior) + F.col("hs") - own) / (k_host + F.col("hn") - 1)
    path_posterior = (k_path * host_posterior + F.col("s") - own) / (k_path + F.col("n") - 1)
    logit = _logit(own) + rules.site_weight * (_logit(path_posterior) - _logit(F.lit(prior)))
    score = F.round(1 / (1 + F.exp(-logit)), 6)
    return joined.select(
        "doc_id",
        own.alias("evidence"),
        F.round(host_posterior, 6).alias("host_posterior"),
        F.round(path_posterior, 6).alias("path_posterior"),
        score.alias("score"),
        (score >= rules.threshold).alias("kept"),
    )
