"""Exact k-nearest-neighbour join and neighbour outcome summaries.

The join is a block join with pruning. Training vectors are grouped around
pivots; each query keeps an upper bound on its k-th distance (from the
distances of training vectors to their pivots) and only meets the cells the
triangle inequality cannot rule out. Cells are cut into blocks of bounded size
on both sides, so a cell holding a large share of the data is still many small
tasks, and only each block's k best rows are emitted, never the pairs.

``knn_lsh`` is the approximate form for vectors whose cells prune little: random projections
propose the training vectors a query meets, distances stay exact, recall is measured.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretrace.functions.draws import draw
from foretrace.functions.durable import durable
from foretrace.settings import Variable, Windows

# Ship this module's helpers with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_PIVOTS = 1024
BLOCK_ROWS = 4096
# Blocks grow until about so many pairs of them cover the join, up to a size that a task holds: rows are
# copied once for each block they meet.
BLOCK_PAIRS, MOST_BLOCK_ROWS = 1024, 16_384
# Rows bounded at once in a task: times pivots times k doubles.
VISIT_ROWS = 256
# Distances a task holds at once.
SCREENED = 1 << 20


@dataclass(frozen=True)
class Scaler:
    """Column means and scales of the imputed training vectors."""

    means: tuple[float, ...]
    scales: tuple[float, ...]
    n_train: int


def fit(train: DataFrame) -> Scaler:
    """One pass: a missing entry counts as the column mean, so the mean is that of
    the known values and the variance is spread over all rows. Constant columns
    get scale 1; a missing vector counts as all entries missing. The result is one row of numbers per feature."""
    width = train.agg(F.max(F.size("vector"))).first()[0] or 0
    sums = []
    for i in range(width):
        x = F.get("vector", F.lit(i))
        sums += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.count(x).alias(f"c{i}")]
    row = train.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    means = tuple(float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(width))
    scales = []
    for i in range(width):
        spread = float(np.sqrt((row[f"v{i}"] or 0.0) * row[f"c{i}"] / row["n"]))
        scales.append(spread if spread > 0 else 1.0)
    return Scaler(means, tuple(scales), int(row["n"]))


def standardise(vectors: DataFrame, scaler: Scaler) -> DataFrame:
    """(stay_id, vector) imputed and scaled, no nulls left."""
    entries = [
        (F.coalesce(F.get("vector", F.lit(i)), F.lit(m)) - F.lit(m)) / F.lit(s)
        for i, (m, s) in enumerate(zip(scaler.means, scaler.scales))]
    return vectors.select("stay_id", F.array(*entries).alias("vector"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _nearest_in_block(queries: pd.DataFrame, train: pd.DataFrame, k: int) -> pd.DataFrame:
    """Exact k best of one block pair: BLAS screens, survivors are recomputed."""
    if queries.empty or train.empty:
        return pd.DataFrame({"query_id": [], "neighbor_id": [], "distance": []})
    q, t = _matrix(queries["vector"]), _matrix(train["vector"])
    ids, query_ids = train["neighbor_id"].to_numpy(), queries["query_id"].to_numpy()
    kk = min(k, len(ids))
    largest = (t * t).sum(1).max()
    step = max(1, SCREENED // len(ids))
    out_q, out_n, out_d = [], [], []
    for start in range(0, len(q), step):
        some = q[start : start + step]
        rough = _squared(some, t)
        slack = 1e-9 * (1.0 + (some * some).sum(1) + largest)
        cutoff = np.partition(rough, kk - 1, axis=1)[:, kk - 1] + slack
        for i, query_id in enumerate(query_ids[start : start + step]):
            near = np.flatnonzero(rough[i] <= cutoff[i])
            exact = np.sqrt(((t[near] - some[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], exact))[:kk]
            out_q.append(np.full(len(best), query_id))
            out_n.append(ids[near][best])
            out_d.append(exact[best])
    return pd.DataFrame({
        "query_id": np.concatenate(out_q), "neighbor_id": np.concatenate(out_n), "distance": np.concatenate(out_d)})


def _block_rows(pairs: int, least: int) -> int:
    """Rows of a block when so many (query, training vector) pairs may meet."""
    return max(least, min(MOST_BLOCK_ROWS, math.isqrt(int(pairs) // BLOCK_PAIRS)))


def knn_join(queries: DataFrame, train: DataFrame, k: int, block_rows: int = BLOCK_ROWS,
             n_pivots: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): min(k, n_train) nearest, ties by id.

    Inputs are (stay_id, vector) without nulls. The driver only ever holds the
    pivots and k radii per pivot (at most 1024 pivots). ``block_rows`` is the least size of a block,
    see ``_block_rows``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # Both sides are read several times below; their history is run only once.
    train = durable(train.select(F.col("stay_id").alias("neighbor_id"), "vector"))
    queries = durable(queries.select(F.col("stay_id").alias("query_id"), "vector"))
    n_train = train.count()
    if not n_train:
        return queries.sparkSession.createDataFrame([], "query_id long, neighbor_id long, distance double, rank int")
    block_rows = _block_rows(n_train * queries.count(), block_rows)
    n_pivots = n_pivots or n_train // block_rows
    n_pivots = int(min(MAX_PIVOTS, max(1, n_pivots)))
    picked = train.orderBy(draw("pivot", F.col("neighbor_id")), "neighbor_id").limit(n_pivots).collect()
    pivots = np.array([list(r["vector"]) for r in picked], dtype=float)

    def to_cells(batches):
        for pdf in (b.iloc[i:i + VISIT_ROWS] for b in batches for i in range(0, len(b), VISIT_ROWS)):
            if len(pdf):
                d = np.sqrt(_squared(_matrix(pdf["vector"]), pivots))
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), radius=d[np.arange(len(pdf)), cell])

    celled = train.mapInPandas(to_cells, "neighbor_id long, vector array<double>, cell int, radius double")
    nearest_first = Window.partitionBy("cell").orderBy("radius", "neighbor_id")
    extent = celled.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi"))
    closest = (
        celled.select("cell", "radius", "neighbor_id").withColumn("_r", F.row_number().over(nearest_first))
        .filter(F.col("_r") <= k).groupBy("cell").agg(F.collect_list("radius").alias("radii")))
    stats = sorted(extent.join(closest, "cell").collect(), key=lambda r: r["cell"])
    cells = np.array([r["cell"] for r in stats])
    lo = np.array([r["lo"] for r in stats])
    hi = np.array([r["hi"] for r in stats])
    blocks = {int(r["cell"]): -(-r["n"] // block_rows) for r in stats}
    owner = np.concatenate([np.full(len(r["radii"]), i) for i, r in enumerate(stats)])
    radii = np.concatenate([np.array(r["radii"]) for r in stats])
    kth = min(k, len(radii)) - 1

    def visits(batches):
        """Per query: the cells to visit."""
        for pdf in (b.iloc[i:i + VISIT_ROWS] for b in batches for i in range(0, len(b), VISIT_ROWS)):
            d = np.sqrt(_squared(_matrix(pdf["vector"]), pivots))
            d = d[:, cells]
            bound = np.partition(d[:, owner] + radii[None, :], kth, axis=1)[:, kth]
            gap = np.maximum(np.maximum(d - hi[None, :], lo[None, :] - d), 0.0)
            meets = gap <= (bound * (1 + 1e-9) + 1e-9)[:, None]
            yield pdf.assign(visit=[cells[m].astype("int32") for m in meets])

    routed = durable(queries.mapInPandas(visits, "query_id long, vector array<double>, visit array<int>"))
    # One row per cell, so the driver can hold it: blocks of the queries that visit a cell.
    visitors = {r["cell"]: -(-r["n"] // block_rows) for r in routed.select(F.explode("visit").alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n_blocks = F.create_map(*[F.lit(x) for c, b in blocks.items() for x in (c, int(b))])
    q_blocks = F.create_map(*[F.lit(x) for c in blocks for x in (c, int(visitors.get(c, 0)))])
    t_block = (draw("train", F.col("neighbor_id")) % F.try_element_at(n_blocks, F.col("cell"))).cast("int")
    q_block = (draw("query", F.col("query_id")) % F.try_element_at(q_blocks, F.col("cell"))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.try_element_at(n, F.col("cell")) - 1))
    train_side = celled.filter(F.try_element_at(q_blocks, F.col("cell")) > 0).select(
        "neighbor_id", "vector", "cell", t_block.alias("t_block"), every(q_blocks).alias("q_block"))
    query_side = routed.select("query_id", "vector", F.explode("visit").alias("cell")).select(
        "query_id", "vector", "cell", q_block.alias("q_block"), every(n_blocks).alias("t_block"))

    keys = ["cell", "q_block", "t_block"]
    partial = query_side.groupBy(*keys).cogroup(train_side.groupBy(*keys)).applyInPandas(
        lambda q, t: _nearest_in_block(q, t, k), "query_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Hashes:
    """Projections of a locality-sensitive index and what its fit expects of them."""

    directions: np.ndarray  # table, projection, entry
    offsets: np.ndarray
    factors: np.ndarray
    width: float
    recall: float
    compared: float


_erf = np.vectorize(math.erf, otypes=[float])


def _hit_chance(distance: np.ndarray, width: float, n_projections: int) -> np.ndarray:
    """Chance that a table shows a query a vector at this distance: all projections agree, or one lands
    in the neighbouring bucket nearer to the query, which is probed too."""
    phi = lambda x: 0.5 * (1.0 + _erf(x / math.sqrt(2.0)))
    spread = np.maximum(distance, 1e-12) / width
    place = (np.arange(16) + 0.5) / 32  # of a query between its nearer border and the middle
    below = phi(-place[:, None] / spread[None, :])
    same = (phi((1 - place)[:, None] / spread[None, :]) - below).mean(axis=0)
    side = (below - phi(-(1 + place)[:, None] / spread[None, :])).mean(axis=0)
    return same ** n_projections + n_projections * same ** (n_projections - 1) * side


def fit_hashes(train: DataFrame, k: int, recall: float = 0.95, n_tables: int = 8, n_sample: int = 256, seed: int = 42) -> Hashes:
    """Random projections for ``knn_lsh``. Of a hashed sample of ``n_sample`` training vectors the exact
    neighbours among all and the distances to each other are taken; of the widths and numbers of
    projections whose expected share of neighbours found is at least ``recall``, the one that
    compares fewest of the others is kept. The driver holds the sample and its neighbour distances."""
    vectors = train.select("stay_id", "vector")
    sample = durable(vectors.orderBy(draw("lsh", F.col("stay_id")), "stay_id").limit(n_sample))
    exact = knn_join(sample, vectors, k + 1).filter("query_id <> neighbor_id").select("distance")
    near = np.array([r["distance"] for r in exact.collect()] or [1.0])
    points = np.array([list(r["vector"]) for r in sample.collect()], dtype=float)
    far = np.sqrt(_squared(points, points))[~np.eye(len(points), dtype=bool)] if len(points) > 1 else near
    far = np.quantile(far, np.linspace(0, 1, 257))
    near = np.quantile(near, np.linspace(0, 1, 257))
    unit = max(float(np.median(near)), 1e-9)
    best = None
    for m in range(1, 17):
        for width in unit * 2.0 ** np.arange(-1, 9, 0.5):
            found = float((1 - (1 - _hit_chance(near, width, m)) ** n_tables).mean())
            if found >= recall:
                compared = float(_hit_chance(far, width, m).mean()) * n_tables
                best = min(best, (compared, m, width, found)) if best else (compared, m, width, found)
                break  # wider ones compare more
    if best is None:  # distances without a scale: one bucket, everything is compared
        best = (float(n_tables), 1, float(far.max() + unit) * 1e6, 1.0)
    compared, m, width, found = best
    rng = np.random.default_rng(seed)
    return Hashes(rng.normal(size=(n_tables, m, points.shape[1])), rng.random((n_tables, m)),
                  rng.integers(1, 1 << 62, (n_tables, m + 1)) * 2 + 1, float(width), found, compared)


def _bucketed(vectors: DataFrame, id_col: str, hashes: Hashes, probe: bool) -> DataFrame:
    """One row per bucket of a vector: one for each table, and with ``probe`` also those reached by
    moving one projection over its nearer border."""
    h = hashes

    def buckets(batches):
        for pdf in batches:
            if len(pdf):
                at = np.einsum("nd,tmd->ntm", _matrix(pdf["vector"]), h.directions) / h.width + h.offsets
                cell = np.floor(at)
                with np.errstate(over="ignore"):
                    own = (cell.astype("int64") * h.factors[None, :, 1:]).sum(axis=2) + h.factors[None, :, 0]
                    keys = own[:, :, None]
                    if probe:
                        step = np.where(at - cell < 0.5, -h.factors[None, :, 1:], h.factors[None, :, 1:])
                        keys = np.concatenate([keys, own[:, :, None] + step], axis=2)
                yield pdf.assign(bucket=list(keys.reshape(len(pdf), -1)))

    rows = vectors.mapInPandas(buckets, f"{id_col} long, vector array<double>, bucket array<long>")
    return rows.withColumn("bucket", F.explode("bucket"))


def knn_lsh(queries: DataFrame, train: DataFrame, k: int, hashes: Hashes | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) as ``knn_join`` gives, but a neighbour that shares no probed
    bucket with its query is missed; ``recall`` measures how many are. Distances are exact.

    A query meets the training vectors of its buckets. Buckets are cut into blocks on both
    sides, so one that holds a third of all rows is many tasks, and a block returns only its k best
    rows. Queries that find fewer than min(k, n_train) go through ``knn_join``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    train = durable(train.select("stay_id", "vector"))
    queries = durable(queries.select("stay_id", "vector"))
    wanted_rows = min(k, train.count())
    if not wanted_rows:
        return knn_join(queries, train, k)
    hashes = hashes or fit_hashes(train, k)
    t = durable(_bucketed(train.withColumnRenamed("stay_id", "neighbor_id"), "neighbor_id", hashes, False))
    q = durable(_bucketed(queries.withColumnRenamed("stay_id", "query_id"), "query_id", hashes, True))
    size = F.count(F.lit(1))
    shared = durable(t.groupBy("bucket").agg(size.alias("_t")).join(q.groupBy("bucket").agg(size.alias("_q")), "bucket"))
    block_rows = _block_rows(shared.agg(F.sum(F.col("_t") * F.col("_q"))).first()[0] or 0, block_rows)
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    shared = shared.withColumns({"t_blocks": blocks("_t"), "q_blocks": blocks("_q")})
    load = shared.agg(F.sum(F.col("_t") * F.col("q_blocks") + F.col("_q") * F.col("t_blocks"))).first()[0] or 0
    n_parts = int(max(1, -(-load // block_rows)))
    shared = shared.select("bucket", "t_blocks", "q_blocks")
    part = F.pmod(F.xxhash64("bucket", "q_block", "t_block"), F.lit(n_parts)).alias("part")

    def side(rows: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block")
        mine = (draw("block", F.col(id_col)) % F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block")
        return rows.join(shared, "bucket").select(id_col, "vector", "bucket", mine, every).select("*", part)

    block = ["bucket", "q_block", "t_block"]

    def best(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        met = dict(list(others.groupby(block)))
        found = [_nearest_in_block(rows, met[key], k) for key, rows in mine.groupby(block) if key in met]
        return pd.concat(found) if found else _nearest_in_block(mine.iloc[:0], others, k)

    partial = side(q, "query_id", "q", "t").groupBy("part").cogroup(side(t, "neighbor_id", "t", "q").groupBy("part")).applyInPandas(
        best, "query_id long, neighbor_id long, distance double")
    # Tables show the same neighbour again; its distance is the same in all of them.
    once = partial.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    ranked = durable(once.withColumn("rank", rank).filter(F.col("rank") <= k))
    full = ranked.filter(F.col("rank") == wanted_rows).select("query_id")
    short = durable(queries.join(full, queries["stay_id"] == full["query_id"], "left_anti"))
    if short.isEmpty():
        return ranked
    return ranked.join(full, "query_id", "left_semi").unionByName(knn_join(short, train, k))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries and n_neighbours of ``exact``, and the share of it that ``found`` holds. A row
    found no farther than the last exact neighbour counts, so ties do not matter."""
    last = exact.groupBy("query_id").agg(F.max("distance").alias("_last"), F.count(F.lit(1)).alias("_n"))
    reach = F.col("distance") <= F.col("_last") * (1 + 1e-9) + 1e-12
    hits = found.join(last.select("query_id", "_last"), "query_id").filter(reach).groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    return last.join(hits, "query_id", "left").agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("_n").alias("n_neighbours"),
        F.try_divide(F.sum(F.coalesce(F.least("_hits", "_n"), F.lit(0))), F.sum("_n")).alias("recall"))


def packed_horizons(series: DataFrame, variables: list[Variable], windows: Windows) -> DataFrame:
    """(stay_id, horizon): one row per stay with the horizon bins of all variables in the configured
    order, null = not measured. ``series``: stay_id, variable, values (``harmonize.packed``)."""
    own = F.struct("variable", F.slice("values", windows.obs + 1, windows.horizon).alias("values"))
    by_name = series.groupBy("stay_id").agg(F.map_from_entries(F.collect_list(own)).alias("_own"))
    unknown = F.array_repeat(F.lit(None).cast("double"), windows.horizon)
    parts = [F.coalesce(F.try_element_at("_own", F.lit(v.name)), unknown) for v in variables]
    return by_name.select("stay_id", F.flatten(F.array(*parts)).alias("horizon"))


def outcomes(neighbors: DataFrame, horizons: DataFrame) -> DataFrame:
    """(query_id, outcomes): the ranked horizons of a query's neighbours, from one join with one row
    per stay. A query holds at most k arrays, in the order of their ranks."""
    rows = horizons.withColumnRenamed("stay_id", "neighbor_id")
    return neighbors.select("query_id", "neighbor_id", "rank").join(rows, "neighbor_id").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "horizon"))).alias("outcomes"))


def _sums(k: int | None, n_cells: int) -> Column:
    """Sum and count of every horizon bin over the k nearest outcomes, in one fold."""
    near = F.col("outcomes") if k is None else F.filter("outcomes", lambda o: o["rank"] <= k)
    start = F.array_repeat(F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), n_cells)

    def add(sums: Column, outcome: Column) -> Column:
        return F.zip_with(sums, outcome["horizon"], lambda a, v: F.struct(
            (a["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (a["n"] + v.isNotNull().cast("int")).alias("n")))

    return F.aggregate(near, start, add)


def mean_trajectories(found: DataFrame, variables: list[Variable], windows: Windows, ks: tuple[int, ...] = ()) -> DataFrame:
    """(query_id, variable, means, counts) of ``outcomes``: per bin the mean of the neighbours' values,
    null where no neighbour has one. With ``ks`` a column ``k`` too, one row for each of them."""
    h = windows.horizon
    settings = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _sums(k, len(variables) * h).alias("sums")) for k in (ks or (None,))])).alias("_s")
    rows = found.select("query_id", settings).select("query_id", *(["_s.k"] if ks else []), "_s.sums")
    own = F.explode(F.array(*[
        F.struct(F.lit(v.name).alias("variable"), F.slice("sums", i * h + 1, h).alias("sums")) for i, v in enumerate(variables)])).alias("_v")
    return rows.withColumn("_v", own).select(
        "query_id", *(["k"] if ks else []), "_v.variable",
        F.transform("_v.sums", lambda c: F.try_divide(c["sum"], c["n"])).alias("means"),
        F.transform("_v.sums", lambda c: c["n"]).alias("counts"))


def mean_trajectory(found: DataFrame, variables: list[Variable], windows: Windows, ks: tuple[int, ...] = ()) -> DataFrame:
    """``mean_trajectories`` with one row per bin: hour, mean_value, n_values."""
    rows = mean_trajectories(found, variables, windows, ks)
    keys = [c for c in rows.columns if c not in ("means", "counts")]
    return rows.select(*keys, F.posexplode(F.arrays_zip("means", "counts")).alias("hour", "_c")).select(
        *keys, "hour", F.col("_c.means").alias("mean_value"), F.col("_c.counts").alias("n_values"))


def report_hours(windows: Windows) -> list[int]:
    """1, quarter, half, three quarters and end of the horizon (1-based, distinct)."""
    h = windows.horizon
    return sorted({1, h // 4, h // 2, 3 * h // 4, h} - {0})


def _quantile(values: str, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below = F.get(values, low)
    return below + (F.coalesce(F.get(values, low + 1), below) - below) * (at - low)


def trajectory_quantiles(found: DataFrame, variables: list[Variable], windows: Windows, min_values: int = 3) -> DataFrame:
    """Median and quartiles of ``outcomes`` at a few horizon hours, where at least three
    neighbours have a value."""
    places = F.array(*[
        F.struct(F.lit(v.name).alias("variable"), F.lit(lead).alias("lead"), F.lit(i * windows.horizon + lead - 1).alias("at"))
        for i, v in enumerate(variables) for lead in report_hours(windows)])
    ranked = F.transform(places, lambda p: F.struct(p["variable"].alias("variable"), p["lead"].alias("lead"), F.array_sort(F.filter(
        F.transform("outcomes", lambda o: F.get(o["horizon"], p["at"])), lambda x: x.isNotNull())).alias("values")))
    rows = found.select("query_id", F.explode(ranked).alias("_p")).select("query_id", "_p.*").filter(F.size("values") >= min_values)
    return rows.select(
        "query_id", "variable", "lead", F.size("values").cast("long").alias("n_values"), _quantile("values", 0.25).alias("q1"),
        _quantile("values", 0.5).alias("median"), _quantile("values", 0.75).alias("q3"))


def horizon_mean(trajectories: DataFrame) -> DataFrame:
    """Mean over the hours of ``mean_trajectories``, per query and variable."""
    known = F.filter("means", lambda m: m.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, m: a + m), F.size(known))
    return trajectories.select("query_id", "variable", mean.alias("horizon_mean"))
