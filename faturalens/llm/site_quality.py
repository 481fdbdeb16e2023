"""Quality classifier by hierarchical empirical Bayes: a document's own evidence, its path and its host.

A logistic model of line and word figures gives each whole text its evidence, the log-odds of
being good less those of the average document. Labelled documents are counted by host and by path
inside the host; each level's rate is shrunk toward the one above by as many pseudo-documents as
the spread of the level's rates calls for (moments of a beta prior): sparse paths become their host,
sparse hosts the average of all. The score adds the evidence to the log-odds of the path.

The logistic model is fitted on at most about `MOST_LABELLED` labelled documents that are not held
out, drawn by hash; rates and spreads come from group-bys over all of them. A document that
was learned from doesn't count toward its own path. Site tables join as tables of known size.

A null or empty text has the figures of no line. Null hosts and paths are sites like others. Without
labels of both kinds all scores are 0.5. Several labels of one id all count; rows without an id
are never learned from. Repeated rows are scored alike; an empty table gives an empty one. Texts of
any length are read whole; their figures are shares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faturalens.llm import common, line_quality

MOST_LABELLED = 6_000
RIDGE = 1.0
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1_000.0
KEEP = 0.5
SIZE_EDGES = np.array([1, 5, 20, 60, 200, 800, 3000])
WIDTH = line_quality.WIDTH + len(SIZE_EDGES) + 2


@dataclass
class Evidence:
    """Weights of a text's figures; their sum with the intercept is the log-odds less those of the average."""

    weights: np.ndarray
    intercept: float


def figures_of(texts: list[bytes]) -> np.ndarray:
    """Shares of line features by word characters, the share of repeated words, and a bin of the length."""
    rows = []
    for start, stop in common.slices(texts):
        own = line_quality.Figures(texts[start:stop])
        part = np.zeros((stop - start, WIDTH), dtype=np.float32)
        if len(own.line_chars):
            chars = np.maximum(own.line_chars, 1)
            whole = np.bincount(own.line_owner, chars, stop - start)
            for column in range(own.features.shape[1]):
                np.add.at(part, (own.line_owner, own.features[:, column]), chars / whole[own.line_owner])
        part[:, line_quality.WIDTH] = own.n_repeat_words / np.maximum(own.n_words, 1)
        part[np.arange(stop - start), line_quality.WIDTH + 1 + np.searchsorted(SIZE_EDGES, own.n_words, side="right")] = 1
        rows.append(part)
    return np.concatenate(rows) if rows else np.zeros((0, WIDTH), dtype=np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> Evidence:
    """A ridged logistic model by Newton steps."""
    design = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    ridge = np.full(design.shape[1], RIDGE)
    ridge[-1] = 1e-6
    theta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * theta
        move = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), gradient)
        theta += move
        if np.abs(move).max() < 1e-8:
            break
    rate = (y.sum() + 0.5) / (len(y) + 1)
    return Evidence(theta[:-1], float(theta[-1] - np.log(rate / (1 - rate))))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Evidence | None:
    """The evidence model; None without labels of both kinds."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out())
    size = usable.count()
    if not size:
        return None
    drawn = common.written(common.hash_sample(usable, min(1.0, most / size), 23).select("doc_id", F.col("quality").cast("int").alias("quality")))

    def run(batch: pa.RecordBatch) -> dict:
        rows = figures_of(common.texts_of(batch))
        return {"quality": common.column(batch, "quality"), "row": pa.array([row.tobytes() for row in rows], pa.binary())}

    rows = common.map_batches(docs.select("doc_id", "text").join(drawn, "doc_id"), run, "quality int, row binary").collect()
    pairs = sorted((row["quality"], bytes(row["row"])) for row in rows)
    y = np.array([float(quality == 1) for quality, _ in pairs])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.frombuffer(b"".join(row for _, row in pairs), dtype=np.float32).reshape(len(y), WIDTH), y)


def strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of the beta prior from which the groups' rates scatter about `rate`, by moments."""
    p = F.col("good") / F.col("n")
    row = groups.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (p - rate) ** 2).alias("spread"),
        F.sum(F.col("n") * rate * (1 - rate)).alias("binomial"),
        F.sum(rate * (1 - rate)).alias("chance"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["binomial"]:
        return MOST_STRENGTH
    # What scatters beyond chance, as a share of the largest possible scatter.
    excess = (row["spread"] - row["chance"]) / max(row["binomial"] - row["chance"], 1e-9)
    return float(min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / excess - 1))) if excess > 0 else MOST_STRENGTH


def key_of(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("0"), value.cast("string")), F.lit("1"))


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, held_out, score, kept, evidence, host_posterior and path_posterior of every document."""
    model = learn(docs, labels)

    def run(batch: pa.RecordBatch) -> dict:
        texts = common.texts_of(batch)
        if model is None:
            evidence = np.zeros(len(texts))
        else:
            evidence = figures_of(texts).astype(np.float64) @ model.weights + model.intercept
        kept = {name: common.column(batch, name) for name in ("doc_id", "host", "path", "held_out")}
        return {**kept, "evidence": pa.array(evidence, pa.float64())}

    rows = docs.select("doc_id", "text", key_of(host).alias("host"), key_of(path).alias("path"), common.held_out().alias("held_out"))
    slim = common.map_batches(rows, run, "doc_id long, host string, path string, held_out boolean, evidence double")
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out())
    marks = marked.groupBy("doc_id").agg(F.count("*").alias("own_n"), F.count_if(F.col("quality") == 1).alias("own_good"))
    scored = common.written(slim.join(marks, "doc_id", "left").na.fill(0, ["own_n", "own_good"]))
    sums = [F.sum("own_n").alias("n"), F.sum("own_good").alias("good")]
    paths = common.written(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    n, good = total["n"] or 0, total["good"] or 0
    base = F.lit((good + 0.5) / (n + 1))
    host_strength = strength(hosts.where("n > 0"), base)
    host_rate = (F.col("good") + host_strength * base) / (F.col("n") + host_strength)
    rated = paths.join(
        hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"), host_rate.alias("host_rate")), "host"
    )
    path_strength = strength(rated.where("n > 0"), F.col("host_rate"))
    sites = common.written(rated)
    joined = scored.join(sites, ["host", "path"])
    # A learned document leaves its own label out of its host and path.
    host_posterior = (F.col("host_good") - F.col("own_good") + host_strength * base) / (F.col("host_n") - F.col("own_n") + host_strength)
    path_posterior = (F.col("good") - F.col("own_good") + path_strength * F.col("host_posterior")) / (F.col("n") - F.col("own_n") + path_strength)
    found = joined.withColumn("host_posterior", host_posterior).withColumn("path_posterior", path_posterior)
    odds = F.col("evidence") + F.log(F.col("path_posterior") / (1 - F.col("path_posterior")))
    value = F.lit(0.5) if model is None else 1 / (1 + F.exp(-odds))
    return found.withColumn("score", value).select(
        "doc_id", "held_out", "score", (F.col("score") >= KEEP).alias("kept"), "evidence", "host_posterior", "path_posterior"
    )
