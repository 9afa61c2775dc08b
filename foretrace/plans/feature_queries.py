"""Grid, interpolation, features and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretrace.operators import features, harmonize, similarity
from foretrace.plans import standin as S
from foretrace.plans.registry import part, register

STATS = ("last", "mean", "std", "slope")
K = 30
part("norm", """
SELECT variable, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS s
FROM cut WHERE split = 'train' AND part = 'obs' GROUP BY variable""")
part("zed", "SELECT stay_id, variable, hour, (value - m)/s AS z FROM cut JOIN norm USING (variable) WHERE part = 'obs'")
part("long_features", " UNION ALL ".join(
    f"SELECT stay_id, split, idx*4 + {i} AS feature, {s} AS value FROM summary JOIN vars USING (variable)" for i, s in enumerate(STATS)))
part("feature_stats", """
SELECT feature, avg(value) AS m, CASE WHEN coalesce(var_pop(value), 0) = 0 THEN 1.0 ELSE sqrt(var_pop(value)*count(value)/count(*)) END AS s
FROM long_features WHERE split = 'train' GROUP BY feature""")
part("scaled", """
SELECT stay_id, split, feature, (coalesce(value, m) - m)/s AS x FROM long_features JOIN feature_stats USING (feature)""")
part("near", f"""
SELECT query_id, neighbor_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM (
  SELECT q.stay_id AS query_id, t.stay_id AS neighbor_id, sqrt(sum((q.x - t.x)*(q.x - t.x))) AS distance
  FROM scaled q JOIN scaled t USING (feature) WHERE q.split = 'test' AND t.split = 'train' GROUP BY ALL)
QUALIFY rank <= {K}""")
part("neighbour_cells", """
SELECT n.query_id, h.variable, h.hour, h.value FROM near n JOIN (SELECT * FROM cut WHERE part = 'horizon') h ON h.stay_id = n.neighbor_id""")
part("trajectory", """
SELECT query_id, variable, hour, avg(value) AS mean_value, count(value) AS n_values FROM neighbour_cells GROUP BY ALL""")
part("horizon_means", "SELECT query_id, variable, avg(mean_value) AS horizon_mean FROM trajectory GROUP BY ALL")
part("spread", """
SELECT query_id, variable, hour + 1 AS lead, count(value) AS n_values, quantile_cont(value, 0.25) AS q1,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
FROM neighbour_cells WHERE value IS NOT NULL AND hour + 1 IN (1, 3, 7, 11, 15) GROUP BY ALL HAVING count(value) >= 3""")


@register("grid_dense", "stay_id:i variable:s hour:i value:d", "SELECT stay_id, variable, hour, value FROM grid")
def grid_dense(spark, sf):
    ws = S.Workspace(spark, sf)
    return harmonize.grid(ws.cohort, ws.panel, S.VARIABLES, S.WINDOWS)


@register("gaps_interpolated", "stay_id:i variable:s hour:i value:d", "SELECT stay_id, variable, hour, value FROM interp")
def gaps_interpolated(spark, sf):
    ws = S.Workspace(spark, sf)
    return harmonize.unpacked(harmonize.fill_gaps(harmonize.packed(ws.cohort, ws.panel, S.VARIABLES, S.WINDOWS)))


@register("gaps_interpolated_strict", "stay_id:i variable:s hour:i value:d", """
SELECT stay_id, variable, hour, CASE WHEN value IS NOT NULL THEN value
  WHEN pv IS NOT NULL AND nv IS NOT NULL AND nh - ph - 1 <= 3 THEN pv + (nv - pv)*(hour - ph)/(nh - ph) END AS value
FROM bracketed""")
def gaps_strict(spark, sf):
    ws = S.Workspace(spark, sf)
    return harmonize.unpacked(harmonize.fill_gaps(harmonize.packed(ws.cohort, ws.panel, S.VARIABLES, S.WINDOWS), strict=True))


@register("observation_horizon_cut", "stay_id:i variable:s part:s hour:i value:d",
          "SELECT stay_id, variable, part, hour, value FROM cut")
def cut_query(spark, sf):
    ws = S.Workspace(spark, sf)
    return harmonize.tensors(ws.cohort, ws.panel, S.VARIABLES, S.WINDOWS)


@register("observation_summary", "stay_id:i variable:s last:d mean:d std:d slope:d n_obs:i recent_mean:d", "SELECT * FROM summary")
def observation_summary(spark, sf):
    return features.summarize_packed(S.Workspace(spark, sf).packed, S.WINDOWS, S.RECENT)


@register("reference_statistics", "variable:s median:d q1:d q3:d std:d n:i", "SELECT * FROM reference")
def reference_statistics(spark, sf):
    return features.reference_stats(S.Workspace(spark, sf).cells.filter(F.col("split") == "train"))


@register("fill_for_unobserved", "variable:s fill_value:d fill_width:d", "SELECT * FROM fill")
def fill_query(spark, sf):
    return S.Workspace(spark, sf).fill


@register("neighbour_features", "stay_id:i feature:i value:d", "SELECT stay_id, feature, value FROM long_features")
def neighbour_features(spark, sf):
    vectors = features.knn_vector(S.Workspace(spark, sf).series(), S.VARIABLES)
    return vectors.select("stay_id", F.posexplode("vector").alias("feature", "value"))


TREE = [(v, s) for v in S.NAMES for s in ("last", "mean", "std", "slope", "n_obs")]


@register("tree_features", "stay_id:i " + " ".join(f"{v}_{s}:d" for v, s in TREE), f"""
SELECT stay_id, {', '.join(f"coalesce(max({s}) FILTER (variable = '{v}'), 0.0) AS {v}_{s}" for v, s in TREE)} FROM summary GROUP BY stay_id""")
def tree_features(spark, sf):
    return features.tree_vector(S.Workspace(spark, sf).series(), S.VARIABLES)


def _normalised(spark, sf):
    ws = S.Workspace(spark, sf)
    train = ws.cells.filter(F.col("split") == "train")
    return features.normalise(ws.cells, features.normalisation(train))


@register("normalised_values", "stay_id:i variable:s hour:i z:d", "SELECT * FROM zed")
def normalised_values(spark, sf):
    return _normalised(spark, sf).filter(F.col("part") == "obs")


@register("forward_fill_and_mask", "stay_id:i variable:s hour:i filled:d measured:i", """
SELECT stay_id, variable, hour, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY stay_id, variable ORDER BY hour
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS filled, CAST(z IS NOT NULL AS INT) AS measured FROM zed""")
def forward_fill(spark, sf):
    return features.ffill_mask(_normalised(spark, sf))


@register("zero_filled_inputs", "stay_id:i variable:s hour:i filled:d",
          "SELECT stay_id, variable, hour, coalesce(z, 0.0) AS filled FROM zed")
def zero_filled(spark, sf):
    return features.ffill_mask(_normalised(spark, sf), "zero_fill")


@register("delta_anchor", "stay_id:i variable:s anchor:d", """
SELECT stay_id, variable, coalesce(arg_max(z, hour) FILTER (z IS NOT NULL), 0.0) AS anchor FROM zed GROUP BY ALL""")
def delta_anchor(spark, sf):
    return features.anchor(_normalised(spark, sf))


def knn_vectors(ws):
    """Scaler of the training stays and the standardised vectors of all, by split."""
    vectors = features.knn_vector(ws.series(), S.VARIABLES).join(ws.cohort.select("stay_id", "split"), "stay_id")
    scaler = similarity.fit(vectors.filter(F.col("split") == "train"))
    pick = lambda split: similarity.standardise(vectors.filter(F.col("split") == split), scaler)
    return vectors, scaler, pick


def neighbours(ws, k=K):
    _, _, pick = knn_vectors(ws)
    return similarity.knn_join(pick("test"), pick("train"), k=k)


def train_horizons(ws):
    return similarity.packed_horizons(ws.packed.filter(F.col("split") == "train"), S.VARIABLES, S.WINDOWS)


def outcomes(ws, near=None):
    return similarity.outcomes(neighbours(ws) if near is None else near, train_horizons(ws))


@register("standardised_features", "stay_id:i feature:i x:d", "SELECT stay_id, feature, x FROM scaled")
def standardised(spark, sf):
    vectors, scaler, _ = knn_vectors(S.Workspace(spark, sf))
    return similarity.standardise(vectors, scaler).select("stay_id", F.posexplode("vector").alias("feature", "x"))


@register("nearest_neighbours", "query_id:i neighbor_id:i distance:d rank:i", "SELECT * FROM near")
def nearest(spark, sf):
    return neighbours(S.Workspace(spark, sf))


@register("nearest_embeddings", "query_id:i neighbor_id:i distance:d rank:i", """
SELECT query_id, neighbor_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, t.vec_id) AS rank
  FROM embeddings q JOIN embeddings t ON t.label <> 0 WHERE q.label = 0) WHERE rank <= 5""")
def nearest_embeddings(spark, sf):
    """Vectors of label 0 against all others, in many small blocks."""
    e = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("stay_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return similarity.knn_join(e.filter("label = 0"), e.filter("label <> 0"), 5, block_rows=64)


@register("nearest_neighbours_lsh", "query_id:i neighbor_id:i distance:d rank:i")
def nearest_lsh(spark, sf):
    """The approximate join; its recall is in the next two queries, so it has no SQL of its own."""
    _, _, pick = knn_vectors(S.Workspace(spark, sf))
    return similarity.knn_lsh(pick("test"), pick("train"), K)


@register("nearest_neighbours_lsh_recall", "n_queries:i n_neighbours:i recall_reached:b", """
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, TRUE AS recall_reached FROM near""")
def nearest_lsh_recall(spark, sf):
    _, _, pick = knn_vectors(S.Workspace(spark, sf))
    queries, train = pick("test"), pick("train")
    measured = similarity.recall(similarity.knn_lsh(queries, train, K), similarity.knn_join(queries, train, K))
    return measured.withColumn("recall_reached", F.col("recall") >= 0.9)


@register("nearest_embeddings_lsh_recall", "n_queries:i n_neighbours:i recall_reached:b", """
SELECT count(*) FILTER (label = 0) AS n_queries, 5*count(*) FILTER (label = 0) AS n_neighbours, TRUE AS recall_reached FROM embeddings""")
def embeddings_lsh_recall(spark, sf):
    """Vectors of label 0 against all others, as in nearest_embeddings."""
    e = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("stay_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    queries, train = e.filter("label = 0"), e.filter("label <> 0")
    found = similarity.knn_lsh(queries, train, 5, block_rows=64)
    return similarity.recall(found, similarity.knn_join(queries, train, 5)).withColumn("recall_reached", F.col("recall") >= 0.9)


@register("neighbour_mean_trajectory", "query_id:i variable:s hour:i mean_value:d n_values:i", "SELECT * FROM trajectory")
def neighbour_trajectory(spark, sf):
    return similarity.mean_trajectory(outcomes(S.Workspace(spark, sf)), S.VARIABLES, S.WINDOWS)


@register("neighbour_outcome_quartiles", "query_id:i variable:s lead:i n_values:i q1:d median:d q3:d", "SELECT * FROM spread")
def neighbour_quartiles(spark, sf):
    return similarity.trajectory_quantiles(outcomes(S.Workspace(spark, sf)), S.VARIABLES, S.WINDOWS)


@register("neighbour_horizon_mean", "query_id:i variable:s horizon_mean:d", "SELECT * FROM horizon_means")
def neighbour_horizon(spark, sf):
    return similarity.horizon_mean(similarity.mean_trajectories(outcomes(S.Workspace(spark, sf)), S.VARIABLES, S.WINDOWS))
