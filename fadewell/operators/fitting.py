"""Scoring and ranking of candidate parameter sets.

Paths are reduced to one row per (candidate, path) and one spread per
(candidate, sample) before any candidate meets a target. A candidate and a
target are then one row each, with their features in bounded arrays, and a
pair of them is scored by one kernel over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, power
from .blocks import quantiles
from .metrics import valid_path
from .ordering import bounded_join, positions, running

D = "dataset_id"

# Fixed values.
PDP_WEIGHT = 0.5
SPREAD_WEIGHT = 0.5
BINS = 128
MARGIN = 1.05
EPS = 1e-12
TOP_K = 5
MAX_CANDIDATES = 500
GRID = [j / 100 for j in range(101)]

PIVOTS = 8
CELL = 0.05  # decades per cell of the candidate index
ALL_PAIRS = 64  # up to so many candidates per dataset an index costs more than it saves
SLACK = 1e-9  # rounding that a bound may be off by


def parameter_grid(values: DataFrame, names: list[str]) -> DataFrame:
    """Cartesian grid in index order, last parameter fastest, with GS-%06d ids.

    `values` has one row with one sorted array per parameter. The row number is
    decoded digit by digit on the arrays, so the grid is a plain range that all
    tasks share evenly; no array is unfolded.
    """
    spark = values.sparkSession
    row = values.select(*names).first()  # the value lists of the parameters, not the grid
    sizes = [len(row[p]) if row else 0 for p in names]
    grid = spark.range(1, int(np.prod(sizes, dtype=object)) + 1)
    columns, stride = {}, 1
    for p, size in reversed(list(zip(names, sizes))):
        digit = F.expr(f"(id - 1) div {max(stride, 1)}")
        listed = F.array(*[F.lit(v) for v in row[p]]) if size else F.array()
        columns[p] = F.get(listed, F.pmod(digit, F.lit(max(size, 1))).cast("int")).cast(values.schema[p].dataType.elementType)
        stride *= size
    return grid.select(F.col("id").alias("candidate"), F.format_string("GS-%06d", F.col("id")).alias("id"),
                       *[columns[p].alias(p) for p in names])


def path_moments(cir: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, power, power times delay and times its square per (keys, t, path).

    Path features and delay spreads are sums of these, so the observations are
    read once for both; the functions below take such a table or observations.
    """
    p, d = power(), F.col("delay_s")
    return cir.filter(valid_path()).groupBy(*keys, "t", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(d * p).alias("sdp"), F.sum(d * d * p).alias("sddp"))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows if "sddp" in rows.columns else path_moments(rows, keys)


def path_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per (key, path) that can be added up over samples: rows, power, power times delay."""
    return _moments(rows, keys).groupBy(*keys, "path").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sdp").alias("sdp"))


def sample_spreads(rows: DataFrame, keys: list[str]) -> DataFrame:
    """RMS delay spread per snapshot, averaged per key."""
    total, mean = F.sum("sp"), F.sum("sdp") / F.sum("sp")
    spread = F.when(total > 0, F.sqrt(F.greatest(F.sum("sddp") / total - mean * mean, F.lit(0.0))))
    by_time = _moments(rows, keys).groupBy(*keys, "t").agg(spread.alias("spread_s"))
    return by_time.groupBy(*keys).agg(F.avg("spread_s").alias("spread_s")).filter("spread_s IS NOT NULL")


def path_features(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean power and power-weighted delay per path of each key."""
    total = sums.groupBy(*keys, "path").agg(F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sdp").alias("sdp"))
    return total.filter("sp > 0 AND sdp >= 0").select(
        *keys, "path", (F.col("sp") / F.col("n")).alias("power"), (F.col("sdp") / F.col("sp")).alias("delay_s"))


def clipped_histogram(paths: DataFrame, keys: list[str], window: str) -> DataFrame:
    """Power share per delay bin on [0, window]; later delays count in the last bin."""
    width = F.col(window) / BINS
    d = F.least(F.greatest(F.col("delay_s"), F.lit(0.0)), F.col(window))
    binned = paths.withColumn("bin", F.least(F.floor(d / width).cast("int"), F.lit(BINS - 1)))
    h = binned.groupBy(*keys, "bin").agg(F.sum("power").alias("w"))
    total = F.sum("w").over(Window.partitionBy(*keys))  # at most 128 rows per key
    return h.select(*keys, "bin", (F.col("w") / total).alias("share"))


def build_targets(sums: DataFrame, spreads: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features per target key: window, histogram, spread quantiles.

    `sums` are path sums and `spreads` one delay spread per sample, both with
    the target key.
    """
    paths = path_features(sums, keys).persist()
    window = paths.groupBy(*keys).agg((F.max("delay_s") * MARGIN).alias("window_s")).filter("window_s > 0")
    hist = clipped_histogram(bounded_join(paths, window, keys), keys, "window_s")
    q = quantiles(spreads, "spread_s", keys, GRID)
    return window, hist, q.select(*keys, "p_index", F.col("q").alias("tq"))


def known_targets(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of whole datasets from their known region."""
    moments = _moments(known, [D, "sample"])
    return build_targets(path_sums(moments, [D]), sample_spreads(moments, [D, "sample"]), [D])


def window_targets(cir: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets of overlapping sample windows.

    Rows are reduced per sample once; only those sums and spreads are copied
    to the windows that hold the sample.
    """
    keys = [D, "window"]
    moments = _moments(cir, [D, "sample"])
    sums = path_sums(moments, [D, "sample"]).join(members, [D, "sample"])
    spreads = sample_spreads(moments, [D, "sample"]).join(members, [D, "sample"])
    return build_targets(sums, spreads, keys)


def _log_grid(quantile_rows: DataFrame, keys: list[str], q: str, out: str) -> DataFrame:
    """One row per key with the log10 of its 101 quantiles in order."""
    cells = F.array_sort(F.collect_list(F.struct("p_index", F.log10(F.greatest(F.col(q), F.lit(EPS))).alias("v"))))
    return quantile_rows.groupBy(*keys).agg(cells["v"].alias(out))


def candidate_features(cand: DataFrame) -> DataFrame:
    """One row per candidate: arrays of path delays and powers, and of the log spread quantiles.

    A candidate without paths or without a finite spread has no row.
    """
    keys = [D, "candidate_id"]
    cand = _moments(cand, [*keys, "sample"])
    q = quantiles(sample_spreads(cand, [*keys, "sample"]), "spread_s", keys, GRID)
    cell = F.array_sort(F.collect_list(F.struct("path", "delay_s", "power")))  # the paths of one instrument
    paths = path_features(path_sums(cand, keys), keys).groupBy(*keys).agg(cell.alias("_p"))
    return paths.join(_log_grid(q, keys, "q", "cq"), keys).select(
        *keys, F.col("_p.delay_s").alias("delays"), F.col("_p.power").alias("powers"), "cq")


def target_features(targets: tuple[DataFrame, DataFrame, DataFrame], keys: list[str]) -> DataFrame:
    """One row per target: window_s, the shares of its 128 bins, and the log spread quantiles."""
    window, hist, tq = targets
    cell = F.array_sort(F.collect_list(F.struct("bin", "share")))
    bins = hist.groupBy(*keys).agg(cell.alias("_h"))
    return window.join(bins, keys).join(_log_grid(tq, keys, "tq", "tq"), keys).select(
        *keys, "window_s", F.col("_h.bin").alias("bins"), F.col("_h.share").alias("shares"), "tq")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def pair_scores(window: pa.Array, bins: pa.Array, shares: pa.Array, tq: pa.Array, delays: pa.Array,
                powers: pa.Array, cq: pa.Array) -> pa.Array:
    """Profile and spread distance of each row's target and candidate.

    The candidate's paths are placed on the target's delay grid, later delays in
    the last bin; the distance of the two smoothed histograms is the base-2
    Jensen-Shannon distance, that of the log quantiles their mean gap, at most one.
    """
    n = len(window)
    w = window.to_numpy(zero_copy_only=False)
    delay, row = _flat(delays)
    p, _ = _flat(powers)
    at = np.minimum(np.floor(np.clip(delay, 0.0, w[row]) / (w[row] / BINS)), BINS - 1).astype(np.int64)
    q = np.bincount(row * BINS + at, p, minlength=n * BINS).reshape(n, BINS)
    q /= q.sum(axis=1, keepdims=True)
    share, row = _flat(shares)
    t = np.zeros((n, BINS))
    t[row, _flat(bins)[0]] = share
    a, b = ((x + EPS) / (1.0 + BINS * EPS) for x in (t, q))
    m = (a + b) / 2
    js = np.sqrt(np.clip(((a * np.log2(a / m) + b * np.log2(b / m)) / 2).sum(axis=1), 0.0, 1.0))
    gap = np.abs(_flat(tq)[0].reshape(n, len(GRID)) - _flat(cq)[0].reshape(n, len(GRID))).mean(axis=1)
    return pa.StructArray.from_arrays([pa.array(js), pa.array(np.minimum(gap, 1.0))], ["pdp", "spread"])


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Adds the three scores to rows that hold a target's and a candidate's features, and drops the features."""
    kernel = F.arrow_udf(pair_scores, "struct<pdp: double, spread: double>")
    arrays = ["window_s", "bins", "shares", "tq", "delays", "powers", "cq"]
    scored = pairs.withColumn("_s", kernel(*arrays)).drop(*arrays)
    return scored.withColumns({
        "pdp_score": F.col("_s.pdp"), "delay_spread_score": F.col("_s.spread"),
        "total_score": PDP_WEIGHT * F.col("_s.pdp") + SPREAD_WEIGHT * F.col("_s.spread")}).drop("_s")


def score_candidates(targets: tuple[DataFrame, DataFrame, DataFrame], keys: list[str], candidates: DataFrame) -> DataFrame:
    """Total, profile and spread score of every candidate for every target key of its dataset, one row a pair."""
    return score_pairs(bounded_join(candidates, target_features(targets, keys), [D])).select(
        *keys, "candidate_id", "pdp_score", "delay_spread_score", "total_score")


# ---- best candidate per target without scoring all pairs -------------------

def _mean_gap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(GRID)


def with_pivots(candidates: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Candidates with their distances `cd` to the pivots, and the pivots: per dataset a few of its candidates.

    The pivots lie at equal steps of the mean log quantile. The distance is the
    mean gap of the log quantiles, a metric, so for any target and candidate
    |d(target, pivot) - d(candidate, pivot)| is at most their own distance.
    """
    level = F.aggregate("cq", F.lit(0.0), lambda s, x: s + x) / len(GRID)
    steps = [(k + 0.5) / pivots for k in range(pivots)]
    leveled = candidates.withColumn("_level", level)
    wanted = leveled.groupBy(D).agg(F.percentile_approx("_level", steps, 1000).alias("_at"))
    near = [F.min_by(F.struct("candidate_id", "delays", "powers", "cq"), F.struct(F.abs(F.col("_level") - F.col("_at")[k]), F.col("candidate_id")))
            for k in range(pivots)]
    chosen = bounded_join(leveled, wanted, [D]).groupBy(D).agg(F.array(*near).alias("pivots"))
    grids = chosen.select(D, F.transform("pivots", lambda p: p["cq"]).alias("_grids"))
    placed = bounded_join(candidates, grids, [D]).withColumn("cd", F.transform("_grids", lambda g: _mean_gap(g, F.col("cq"))))
    return placed.drop("_grids"), chosen


def best_candidates(targets: DataFrame, keys: list[str], candidates: DataFrame, pivots: int = PIVOTS,
                    cell: float = CELL, count_pairs: bool = False, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """Best candidate of each target: keys, candidate_id, total_score; ties go to the smaller id.

    Every target is scored against the pivots and against the candidates that
    the pivots put within one cell of it; the best of these bounds the result.
    A candidate can only be as good if half its spread distance is within the
    bound, so by the triangle inequality its distance to each pivot differs from
    the target's by at most twice the bound. Candidates lie in cells of their
    distance to the first pivot, a target visits the cells in reach, and what all
    pivots admit is scored exactly. Bounds exclude only what is worse, by more
    than rounding, so the minimum is that of all pairs; where nothing fits well,
    nothing is excluded. Profile histograms lie on the target's own grid and have
    no common index. Minima are combined on the map side. With `count_pairs` the
    column n_scored has the scored pairs. Up to `all_pairs` candidates are all
    scored, with the same result.
    """
    features = ["window_s", "bins", "shares", "tq"]
    candidates, targets = candidates.persist(), targets.persist()  # rows of features, read several times
    sizes = candidates.groupBy(D).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (sizes["most"] or 0) <= all_pairs:
        scored = score_pairs(bounded_join(targets, candidates, [D], counted=sizes["rows"] or 0)).groupBy(*keys).agg(
            F.min(F.struct("total_score", "candidate_id")).alias("_b"), F.count(F.lit(1)).alias("n_scored"))
        return scored.select(*keys, "_b.candidate_id", "_b.total_score", *(["n_scored"] if count_pairs else []))
    placed, chosen = with_pivots(candidates, pivots)
    first_gap = F.floor(F.col("cd")[0] / cell)
    indexed = placed.withColumn("_cell", first_gap).persist()  # read for the cells' range and by both searches
    cells = indexed.groupBy(D).agg(F.min("_cell").alias("_lo"), F.max("_cell").alias("_hi"))
    seen = bounded_join(bounded_join(targets, chosen, [D]), cells, [D]).withColumn(
        "td", F.transform("pivots", lambda p: _mean_gap(p["cq"], F.col("tq"))))

    def best_of(pairs: DataFrame, name: str) -> DataFrame:
        return score_pairs(pairs.select(*keys, *features, "candidate_id", "delays", "powers", "cq")).groupBy(*keys).agg(
            F.min(F.struct("total_score", "candidate_id")).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))

    def within(rows: DataFrame, reach: Column, kept: Column) -> DataFrame:
        """Targets with the candidates that no pivot excludes at this reach."""
        low = F.greatest(F.col("_lo"), F.floor((F.col("td")[0] - reach) / cell))
        high = F.least(F.col("_hi"), F.floor((F.col("td")[0] + reach) / cell))
        visits = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        gap = F.array_max(F.zip_with("td", "cd", lambda a, b: F.abs(a - b)))
        met = bounded_join(rows.withColumn("_cell", F.explode(visits)), indexed, [D, "_cell"])
        return met.withColumn("_gap", gap).filter((F.col("_gap") <= reach) & kept)

    whole = F.when(F.col("_reach") >= 1, F.lit(float("inf"))).otherwise(F.col("_reach"))  # gaps count as one at most
    start = best_of(seen.withColumn("_p", F.explode(F.array_distinct("pivots"))).select(*keys, *features, "_p.*"), "pivot")
    close = best_of(within(seen.drop("pivots"), F.lit(cell), F.lit(True)), "close")
    # few rows of scalars, kept because the search and the result read them
    bound = start.join(close, keys, "left").withColumn("_best", F.least("pivot", F.coalesce("close", "pivot"))).persist()
    reach = bound.select(*keys, (F.col("_best.total_score") / SPREAD_WEIGHT + SLACK).alias("_reach"))
    rest = best_of(within(seen.drop("pivots").join(reach, keys).filter(F.col("_reach") > cell).withColumn("_reach", whole),
                          F.col("_reach"), F.col("_gap") > cell), "rest")
    both = bound.join(rest, keys, "left").withColumn("_b", F.least("_best", F.coalesce("rest", "_best")))
    n = sum((F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in ("close", "rest")), F.col("n_pivot"))
    return both.select(*keys, "_b.candidate_id", "_b.total_score", *([n.alias("n_scored")] if count_pairs else []))


def evaluate_candidates(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Every candidate with its outcome; a candidate without a score fails with Inf."""
    joined = candidates.join(scores, [D, "candidate_id"], "left")
    ok = F.col("total_score").isNotNull()
    inf = F.lit(float("inf"))
    return joined.select(
        *candidates.columns, F.coalesce("total_score", inf).alias("total_score"),
        F.coalesce("pdp_score", inf).alias("pdp_score"), F.coalesce("delay_spread_score", inf).alias("delay_spread_score"),
        ok.alias("success"), F.when(ok, "SUCCEEDED").otherwise("FAILED").alias("outcome"))


def rank_candidates(evaluated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Successes first, then score, then index; only successes get a rank."""
    keys = keys or [D]
    evaluated = evaluated.persist()  # sized and ranked; scoring runs once
    placed = positions(evaluated, keys, [F.col("success").cast("int").desc(), "total_score", "candidate_id"],
                       "total_score", "place", tie_key="candidate_id")  # failed ones tie at an infinite score
    return placed.withColumn("rank", F.when(F.col("success"), F.col("place")))


def top_k(evaluated: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best of each dataset; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(D).orderBy("total_score", "candidate_id")
    return evaluated.filter("success").withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def best_candidate(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct("total_score", "candidate_id")
    return evaluated.filter("success").groupBy(*keys).agg(
        F.min_by("candidate_id", order).alias("candidate_id"), F.min("total_score").alias("total_score"))


def outcome_counts(evaluated: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return evaluated.groupBy(D).agg(
        n.alias("planned"), n.alias("completed"), F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"), n.alias("proposals"), n.alias("objective_evaluations"))


def search_history(history: DataFrame, group: list[str], pos: str, score: str) -> DataFrame:
    """Running best, improvement flag and no-improvement streak for a search of any length."""
    history = history.select(*group, pos, score).persist()  # read by every pass
    prior = running(history, group, pos, {"_prior": ("min_before", score)})
    improved = F.col("_prior").isNull() | (F.col(score) < F.col("_prior"))
    flagged = prior.withColumns({"best": F.least("_prior", score), "improved": improved,
                                 "_at": F.when(improved, F.col(pos))})
    last = running(flagged, group, pos, {"_last": ("max", "_at")})
    return last.withColumn("streak", F.col(pos) - F.col("_last")).drop("_prior", "_at", "_last")


def acceptance_by_level(history: DataFrame, keys: list[str]) -> DataFrame:
    """Per temperature level: successful and accepted proposals, their ratio, best score."""
    return history.groupBy(*keys).agg(
        F.count_if("success").alias("successful"), F.count_if(F.col("success") & F.col("accepted")).alias("accepted_n"),
        F.min("best").alias("best_score")).withColumn(
        "acceptance_rate", F.col("accepted_n") / F.greatest("successful", F.lit(1)))


def proposal_cache(proposals: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Proposals, objective calls (distinct keys) and cached repeats per search."""
    per_key = proposals.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.groupBy(*keys).agg(
        F.sum("c").alias("proposals"), F.count(F.lit(1)).alias("objective_evaluations"),
        F.sum(F.col("c") - 1).alias("cached"))


def fit_windows(cir: DataFrame, members: DataFrame, cand: DataFrame, windows: DataFrame, parameters: DataFrame,
                names: list[str]) -> DataFrame:
    """Best candidate per local window as a labelled row; windows without one stay as FAIL.

    `members` maps samples to windows; `parameters` has the named values per
    candidate.
    """
    keys = [D, "window"]
    moments = _moments(cand, [D, "candidate_id", "sample"]).persist()
    targets = target_features(window_targets(moments if cir is cand else cir, members), keys)
    best = best_candidates(targets, keys, candidate_features(moments)).withColumnRenamed("total_score", "fit_score")
    labelled = bounded_join(best, parameters.select(D, "candidate_id", *names), [D, "candidate_id"], "left")
    ok = F.col("fit_score").isNotNull()
    for n in names:
        ok = ok & is_finite(n)
    return windows.join(labelled, keys, "left").withColumn(
        "quality_status", F.when(ok, "PASS").otherwise("FAIL")).withColumn(
        "label_source", F.lit("grid_fitted")).withColumn("fit_score", F.coalesce("fit_score", F.lit(float("inf"))))
