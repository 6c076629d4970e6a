"""The clustering pipeline from a table of vectors to membership, and the layers that older forms of it add."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.operators import agreement, checks, hierarchy, kmeans, reports
from vexil.sources import writers
from vexil.storage import materialise


class StageFailed(RuntimeError):
    """A stage of the pipeline found a violation or raised; later stages were not run."""


@dataclass
class Clusters:
    """What the pipeline found; tables that later ones read are written once."""

    vectors: DataFrame
    top: DataFrame | None = None
    centroids: DataFrame | None = None
    trace: DataFrame | None = None
    chosen_k: int = 0
    mids: DataFrame | None = None
    gates: DataFrame | None = None
    finals: DataFrame | None = None
    final: DataFrame | None = None
    members: DataFrame | None = None
    bounds: DataFrame | None = None
    events: list[tuple] = field(default_factory=list)
    manifest: DataFrame | None = None

    def telemetry(self) -> DataFrame:
        """(run, seq, stage_id, event_type, elapsed_ms), a start and an end for each stage."""
        return self.vectors.sparkSession.createDataFrame(self.events, "run int, seq int, stage_id string, event_type string, elapsed_ms double")


def _none(rows: DataFrame, what: str) -> None:
    if bad := rows.take(1):
        raise StageFailed(f"{what}: {bad[0].asDict()}")


def run(vectors: DataFrame, gate: int = hierarchy.GATE, root: str | None = None) -> Clusters:
    """Vectors (id, vector) through the stages ingest (ids once each, one dimension, finite), top (choice of k and assignments), mid (each top cluster by itself), lower (gates), final (clusters of branches that stop) and membership. Each stage is validated; the first that fails ends the run. With root, the tables are published below it and a manifest lists their rows and digests. No rows give empty tables."""
    out = Clusters(materialise(vectors.select(F.col("id").cast("long").alias("id"), "vector"), "vectors"))

    def stage(name: str, work: Callable[[], None]) -> None:
        began = time.perf_counter()
        out.events.append((1, len(out.events), name, "stage_start", 0.0))
        try:
            work()
        except Exception as failed:
            out.events.append((1, len(out.events), name, "stage_fail", 1000 * (time.perf_counter() - began)))
            raise failed if isinstance(failed, StageFailed) else StageFailed(f"{name}: {failed}") from failed
        out.events.append((1, len(out.events), name, "stage_end", 1000 * (time.perf_counter() - began)))

    def ingest() -> None:
        first = out.vectors.where("vector IS NOT NULL").select(F.size("vector").alias("n")).take(1)
        _none(out.vectors.groupBy("id").count().where("count > 1 OR id IS NULL"), "ids")
        _none(checks.embedding_violations(out.vectors, first[0].n if first else 0, 0.0, float("inf")), "vectors")

    def top() -> None:
        found, out.centroids, out.trace, out.chosen_k = kmeans.cluster_top(out.vectors)
        out.top = materialise(found, "top")
        cids = out.centroids.select(F.col("top_id").alias("cid"))
        _none(checks.clustering_violations(out.top.select("id", F.col("top_id").alias("cid")), cids, out.vectors.count()), "top")

    def mid() -> None:
        grouped = kmeans.cluster_groups(out.vectors.join(out.top, "id"))
        out.mids = materialise(hierarchy.mid_ids(materialise(grouped, "mid")), "mids")
        _none(checks.membership_violations(out.mids).where("n > 0"), "mid")

    def lower() -> None:
        out.gates = materialise(hierarchy.lower_ids(hierarchy.lower_gate(out.mids, gate)), "gates")
        _none(hierarchy.empty_violations(out.gates), "lower")

    def final() -> None:
        out.finals = materialise(hierarchy.final_clusters(out.gates), "finals")
        out.final = hierarchy.final_assignments(out.mids, out.finals)
        _none(hierarchy.missing_vectors(out.final, out.vectors), "final")

    def membership() -> None:
        out.members = materialise(hierarchy.membership(out.vectors, out.top, out.mids, out.gates, out.finals), "members")
        _none(hierarchy.membership_violations(out.members, out.gates), "membership")
        out.bounds = hierarchy.k_bounds_table(out.vectors, out.top, out.gates)
        _none(checks.gate_violations(out.bounds), "bounds")
        if root:
            tables = {"top_assignments": out.top, "centroids": out.centroids, "elbow_trace": out.trace, "mid_assignments": out.mids, "lower_gate": out.gates, "final_assignments": out.final, "k_bounds": out.bounds, "membership": out.members}
            rows = None
            for name, table in tables.items():
                row = writers.write_artifact(table, root, name)
                rows = row if rows is None else rows.unionByName(row)
            out.manifest = materialise(rows, "manifest")
            writers.write_text(out.vectors.sparkSession, f"{root}/manifest.json", writers.manifest(out.manifest).first()["manifest"])

    for work in (ingest, top, mid, lower, final, membership):
        stage(work.__name__, work)
    _none(reports.telemetry_violations(out.telemetry()), "telemetry")
    return out


def lower_split(vectors: DataFrame, mids: DataFrame, least: int = 64) -> tuple[DataFrame, DataFrame]:
    """The lower layer that splits once more: branches of least rows or more are clustered by themselves, and their parts are leaves, as are smaller branches. Gives the leaves (id, mid_id, part; part is -1 for a branch that isn't split) and the evaluations (mid_id, part, n, decision, reason)."""
    branches = hierarchy.gate_by_size(mids.groupBy("mid_id").agg(F.count(F.lit(1)).alias("n")), least)
    split = mids.join(branches.where("gate = 'continue'").select("mid_id"), "mid_id", "left_semi").select("id", "mid_id")
    parts = materialise(kmeans.cluster_groups(vectors.select("id", "vector").join(split, "id"), "mid_id").withColumnRenamed("mid", "part"), "parts")
    whole = mids.join(branches.where("gate = 'stop'").select("mid_id"), "mid_id", "left_semi").select("id", "mid_id", F.lit(-1).cast("long").alias("part"))
    below = F.when(F.col("gate") == "continue", "size_above_split_threshold").otherwise("size_below_split_threshold")
    rows = branches.select("mid_id", F.lit(-1).cast("long").alias("part"), "n", F.col("gate").alias("decision"), below.alias("reason"))
    capped = parts.groupBy("mid_id", "part").agg(F.count(F.lit(1)).alias("n")).select("mid_id", "part", "n", F.lit("stop").alias("decision"), F.lit("depth_cap_reached").alias("reason"))
    return parts.select("id", "mid_id", "part").unionByName(whole), rows.unionByName(capped)


def _range_of_k(x: np.ndarray, seed: int, least: int = 256, most: int = 4096) -> tuple[int, int]:
    """agreement.k_range of unit rows x, within one task: from the quartiles of local dimensions of most rows at most."""
    n = len(x)
    part = x[np.sort(np.random.default_rng(seed).permutation(n)[: max(min(n, least), min(most, int(n * 0.3)))])]
    s = part @ part.T
    np.fill_diagonal(s, -np.inf)
    two = -np.sort(-np.partition(s, -2, axis=1)[:, -2:], axis=1)
    d = np.maximum(1e-9, 1 - np.clip(two, -1, 1))
    ok = d[:, 1] > d[:, 0]
    m = np.sort(np.log(2) / np.log(d[ok, 1] / d[ok, 0]))
    if not len(m):
        return 1, max(2, min(8, n))
    low = float(np.clip(m[int(0.25 * (len(m) - 1))], 2, 512))
    high = max(low, min(512.0, float(m[int(0.75 * (len(m) - 1))])))
    centre = np.sqrt(n) * np.sqrt((low + high) / 2 / 32)
    k_max = min(8192, 2 ** int(np.ceil(np.log2(np.floor(max(1, 2 * centre))))))
    k_min = max(8, 2 ** int(np.floor(np.log2(np.floor(max(1, 0.5 * centre))))))
    k_max = max(2, min(k_max, n))
    return max(1, min(k_min, k_max - 1)), k_max


SECOND = "id long, top_id long, second long, k long, fallback boolean, elapsed_ms double"


def second_level(vectors: DataFrame, tops: DataFrame, live: DataFrame | None = None, least: int = 8, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """Each top cluster clustered again by spherical k-means with its own range of k and elbow. live has the ids that still exist. Gives (id, top_id, second) and a summary (top_id, n, live, eligible, reason, k, elapsed_ms), in which clusters of too few vectors are named. A cluster that fits a task (kmeans.LOCAL_VALUES) is clustered in one, a larger one by passes of the whole cluster."""
    alive = tops if live is None else tops.join(live.select("id"), "id", "left_semi")
    joined = vectors.select("id", "vector").join(alive, "id")
    counts = tops.groupBy("top_id").agg(F.count(F.lit(1)).alias("n")).join(joined.groupBy("top_id").agg(F.count(F.lit(1)).alias("live"), F.sum(F.size("vector")).alias("values")), "top_id", "left")
    groups = materialise(hierarchy.second_level_eligibility(counts.fillna(0, ["live", "values"]), least), "eligible")
    fit = joined.join(groups.where(F.col("eligible") & (F.col("values") <= kmeans.LOCAL_VALUES)).select("top_id"), "top_id", "left_semi")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        part = part.sort_values("id")
        x = kmeans._unit(np.array(part["vector"].tolist(), dtype=float))
        own = seed + int(part["top_id"].iloc[0])
        low, high = _range_of_k(x, own)
        k, fallback, _ = kmeans.elbow_stage(lambda k: kmeans.local_spherical(x, k, 8, own + k)[2], list(range(low, high + 1)))
        pick = kmeans.local_spherical(x, k, 20, own + k)[1]
        return pd.DataFrame({"id": part["id"].to_numpy(), "top_id": part["top_id"].to_numpy(), "second": pick.astype("int64"), "k": k, "fallback": fallback, "elapsed_ms": 1000 * (time.perf_counter() - began)})

    found = fit.groupBy("top_id").applyInPandas(one, SECOND)
    for g in groups.where(F.col("eligible") & (F.col("values") > kmeans.LOCAL_VALUES)).select("top_id", "live").collect():  # few: each has more than LOCAL_VALUES values
        began = time.perf_counter()
        rows = materialise(joined.where(F.col("top_id") == g.top_id).select("id", "vector"), "large")
        r = agreement.k_range(agreement.local_dimensions(materialise(agreement.sample_by_hash(kmeans.unit_vectors(rows), seed + g.top_id), "sample")), g.live).first()
        high = max(2, min(int(r.k_max), g.live)) if r else 8
        k, fallback, c, _ = kmeans.elbow_search(rows, max(1, min(int(r.k_min), high - 1)) if r else 1, high, seed=seed + g.top_id)
        near = kmeans.assigned(kmeans.unit_vectors(rows), c).select("id", F.lit(g.top_id).cast("long").alias("top_id"), F.col("cid").alias("second"))
        found = found.unionByName(near.select("*", F.lit(k).cast("long").alias("k"), F.lit(fallback).alias("fallback"), F.lit(1000 * (time.perf_counter() - began)).alias("elapsed_ms")))
    found = materialise(found, "second")
    done = found.groupBy("top_id").agg(F.first("k").alias("k"), F.first("elapsed_ms").alias("elapsed_ms"))
    return found.select("id", "top_id", "second"), groups.drop("values").join(done, "top_id", "left")


def cluster_health(stability: DataFrame) -> DataFrame:
    """stability() with available and status, as a store reports on its clusters; without a run nothing is available."""
    spark = stability.sparkSession
    found = stability.select(F.lit(True).alias("available"), "passed", F.when(F.col("passed"), "ok").otherwise("failed").alias("status"), "mean_nmi", "std_nmi", "mean_jaccard", "mean_drift")
    return found if found.take(1) else spark.createDataFrame([(False, False, "unavailable", 0.0, 0.0, 0.0, 0.0)], found.schema)
