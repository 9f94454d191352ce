"""Irregular readings onto a regular grid, with gaps filled by low-rank factorisation across sources.

Readings are reduced to one value per source and period (map-side combined), and the cells are laid out as matrices of
sources by times. A matrix covers the sources of one period length and one window of ``tile_cells`` periods, and sees
``HALO`` periods more on either side, so that nothing changes at its edges; where there are many such sources they are
spread over several matrices. So a matrix is bounded in both directions, however long or frequent a source is, and all
matrices are solved independently.

In a matrix each source is first carried on from its own neighbours in time. What those don't tell is shared out among
sources: the differences are factorised at a rank below the number of sources by alternating least squares, and each
source takes as much of the factors as cells held out from them bear out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import NANOS, finite
from tidemark.storage import discard, join_small, materialize, ship

OBSERVED, FILLED, UNSUPPORTED = "observed", "filled", "unsupported"
#: What an estimate needs: observations of its source in the matrix, and periods to the nearest of them.
MIN_SEEN, NEAR = 4, 6
#: Periods that a matrix sees beyond its own on either side.
HALO = 32
#: Numbers of neighbours on either side that a source may be carried on from.
REACHES = (1, 2, 4, 8)
#: Differences beyond so many of their usual size count as that, lest single ones bend the factors.
MOST = 6.0


def _neighbours(values: np.ndarray) -> np.ndarray:
    """Of every cell, the value that its source's neighbours in time suggest, the cell itself left out.

    A straight line is laid through the nearest observations on both sides (their mean where one side has none). Of the
    numbers of observations in REACHES each source takes that by which its own cells are told best.
    """
    n_sources, n_times = values.shape
    out = np.full(values.shape, np.nan)
    most = max(REACHES)
    at = np.arange(n_times)
    for r in range(n_sources):
        seen = np.flatnonzero(np.isfinite(values[r]))
        if not len(seen):
            continue
        left = np.searchsorted(seen, at)[None, :] - 1 - np.arange(most)[:, None]
        right = np.searchsorted(seen, at, side="right")[None, :] + np.arange(most)[:, None]
        candidates, errors = [], []
        for k in REACHES:
            near = np.concatenate([left[:k], right[:k]])
            weight = ((near >= 0) & (near < len(seen))).astype(float)
            place = seen[np.clip(near, 0, len(seen) - 1)]
            x, y = (place - at) * weight, values[r, place] * weight
            s0, s1, s2, t0, t1 = weight.sum(0), x.sum(0), (x * x).sum(0), y.sum(0), (x * y).sum(0)
            spread = s0 * s2 - s1 * s1
            both = (weight[:k].sum(0) > 0) & (weight[k:].sum(0) > 0) & (spread > 0)
            line = np.where(both, (s2 * t0 - s1 * t1) / np.where(both, spread, 1.0), t0 / np.where(s0 > 0, s0, np.nan))
            error = np.abs(line - values[r])[seen]
            candidates.append(line)
            errors.append(np.minimum(error, np.nanquantile(error, 0.95)).mean() if np.isfinite(error).any() else np.inf)
        out[r] = candidates[int(np.nanargmin(errors)) if np.isfinite(errors).any() else 0]
    return out


def _factors(target: np.ndarray, weight: np.ndarray, rank: int, rounds: int, ridge: float) -> np.ndarray:
    """The product of two factors of so many columns that is least squares' best for the cells with weight."""
    n_sources, n_times = target.shape
    left, eye = np.random.default_rng(11).normal(0, 0.3, (n_sources, rank)), ridge * np.eye(rank)
    for _ in range(rounds):
        outer = np.einsum("sa,sb->sab", left, left).reshape(n_sources, -1)
        right = np.linalg.solve((weight.T @ outer).reshape(-1, rank, rank) + eye, ((target * weight).T @ left)[..., None])[..., 0]
        outer = np.einsum("ta,tb->tab", right, right).reshape(n_times, -1)
        left = np.linalg.solve((weight @ outer).reshape(-1, rank, rank) + eye, ((target * weight) @ right)[..., None])[..., 0]
    return left @ right.T


def factorise(values: np.ndarray, rank: int = 4, rounds: int = 8, ridge: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Estimate all cells of ``values`` (sources x times, NaN where unseen).

    Returns the estimates and the mask of cells with support: their source has at least ``MIN_SEEN`` observations here,
    and either two sources were observed at their time or their source was within ``NEAR`` periods. The rank is at most one
    less than there are sources, so a source by itself is only carried on from its neighbours.
    """
    seen = np.isfinite(values)
    per_row, per_col = seen.sum(axis=1), seen.sum(axis=0)
    counts = np.pad(np.cumsum(seen, axis=1), ((0, 0), (NEAR + 1, NEAR)), mode="edge")
    counts[:, : NEAR + 1] = 0
    near = counts[:, 2 * NEAR + 1 :] > counts[:, : -(2 * NEAR + 1)]
    support = (per_row >= MIN_SEEN)[:, None] & ((per_col >= 2)[None, :] | near)
    if not support.any():
        return np.full(values.shape, np.nan), support
    # values near the greatest numbers would overflow in sums of squares
    unit = np.ones(len(values))
    unit[per_row > 0] = np.maximum(np.nanmax(np.abs(values[per_row > 0]), axis=1), 1e-300)
    own = _neighbours(values / unit[:, None])
    difference = values / unit[:, None] - own
    weight = np.isfinite(difference).astype(float)
    rank = min(rank, len(values) - 1)
    if rank > 0:
        held = weight.sum(axis=1) > 0
        scale = np.ones(len(values))
        scale[held] = np.nanmedian(np.abs(difference[held]), axis=1) * 1.4826
        scale = np.where(scale > 0, scale, 1.0)[:, None]
        target = np.clip(np.where(weight > 0, difference / scale, 0.0), -MOST, MOST)
        test = weight * (np.random.default_rng(7).random(values.shape) < 0.2)
        told = _factors(target, weight - test, rank, rounds, ridge)
        against, size = (test * told * target).sum(axis=1), (test * told * told).sum(axis=1) + 1e-9
        share = np.clip(against / size - 1 / np.sqrt(size), 0.0, 1.0)  # less a standard error, so chance counts for nothing
        own = own + share[:, None] * scale * _factors(target, weight, rank, rounds, ridge)
    return own * unit[:, None], support & np.isfinite(own)


def _solve_tile(tile_cells: int, rank: int):
    def solve(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        """Every cell of one matrix, between the first and last observed cell of each source."""
        tile = int(key[2])
        sources, row = np.unique(cells["source"].to_numpy(), return_inverse=True)
        first = cells.groupby(row)["first_cell"].first().to_numpy()
        last = cells.groupby(row)["last_cell"].first().to_numpy()
        wide = np.full((len(sources), tile_cells + 2 * HALO), np.nan)
        held = cells["value"].notna().to_numpy()
        at = cells["cell"].to_numpy()[held].astype(np.int64) - tile * tile_cells + HALO
        wide[row[held], at] = cells["value"].to_numpy()[held]
        inner = slice(HALO, HALO + tile_cells)
        estimate, support = (x[:, inner] for x in factorise(wide, rank))
        values = wide[:, inner]
        seen = np.isfinite(values)
        number = tile * tile_cells + np.arange(tile_cells)
        wanted = (number[None, :] >= first[:, None]) & (number[None, :] <= last[:, None])
        r, c = np.nonzero(wanted)
        state = np.where(seen, OBSERVED, np.where(support, FILLED, UNSUPPORTED))
        value = np.where(seen, values, np.where(support, estimate, np.nan))[r, c]
        period = int(cells["period_sec"].iloc[0])
        return pd.DataFrame(
            {
                "source": sources[r],
                "cell_start_sec": number[c] * period,
                "value": value,
                "state": state[r, c],
            }
        )

    return solve


def cells_of(readings: DataFrame, periods: DataFrame) -> DataFrame:
    """(source, period_sec, cell, value): one row per source and period that has a usable reading.

    ``readings`` has (source, ts_nanos, value), ``periods`` (source, period_sec). Usable is a reading with a time and a
    finite value whose source has a positive period. The value is the reading itself where all readings of the cell
    agree, so that a single reading or its copies stay exact, and their mean otherwise.
    """
    usable = readings.select("source", "ts_nanos", finite(F.col("value")).alias("value")).where("ts_nanos is not null and value is not null")
    period = F.col("period_sec").cast("bigint") * NANOS
    exact = "case when lo = hi then lo when abs(mean) > 1.7976931348623157e308 then lo / 2 + hi / 2 else mean end"
    cell = F.expr("(ts_nanos - pmod(ts_nanos, period)) div period")  # whole numbers: doubles can't tell nanoseconds apart
    return (
        join_small(usable, periods.where("period_sec > 0").select("source", "period_sec"), ["source"])
        .withColumn("period", period)
        .withColumn("cell", cell)
        .groupBy("source", "period_sec", "cell")
        .agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))
        .select("source", "period_sec", "cell", F.expr(exact).alias("value"))
    )


def regular_grid(readings: DataFrame, periods: DataFrame, *, tile_cells: int = 512, tile_sources: int = 256, rank: int = 4) -> DataFrame:
    """(source, cell_start_sec, value, state) for every period from a source's first to its last usable reading.

    ``state`` is ``observed`` (the exact value), ``filled`` (estimated) or ``unsupported`` (no value: the source or the
    time has too few observations in its matrix to estimate from). Readings of sources without a period have no grid;
    null sources are left out; an empty input gives an empty result.
    """
    ship(readings.sparkSession)
    cells = materialize(cells_of(readings, periods), "grid-cells")
    spans = cells.groupBy("source", "period_sec").agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"))
    spans = materialize(spans, "grid-spans")
    share = spans.groupBy("period_sec").agg(F.ceil(F.count(F.lit(1)) / tile_sources).alias("groups"))
    placed = spans.join(share, "period_sec").withColumn("grp", F.pmod(F.xxhash64("source"), F.col("groups")))
    placed = materialize(placed.drop("groups"), "grid-sources")
    discard(spans)
    # every matrix that a source passes through, also those in which it has no reading at all
    tiles = placed.withColumn(
        "tile", F.explode(F.sequence(F.floor(F.col("first_cell") / tile_cells), F.floor(F.col("last_cell") / tile_cells)))
    ).select("source", "period_sec", "grp", "tile", "first_cell", "last_cell", F.lit(None).cast("bigint").alias("cell"), F.lit(None).cast("double").alias("value"))
    own = F.floor(F.col("cell") / tile_cells)
    # cells near an edge are shown to the matrix beyond it as well, if their source passes through that
    beside = [F.when((F.col("cell") - own * tile_cells < HALO) & (own > F.floor(F.col("first_cell") / tile_cells)), own - 1)]
    beside += [F.when(((own + 1) * tile_cells - F.col("cell") <= HALO) & (own < F.floor(F.col("last_cell") / tile_cells)), own + 1)]
    held = join_small(cells, placed, ["source", "period_sec"]).select(
        "source", "period_sec", "grp", F.explode(F.array_compact(F.array(own, *beside))).alias("tile"), "first_cell", "last_cell", "cell", "value"
    )
    return held.unionByName(tiles).groupBy("period_sec", "grp", "tile").applyInPandas(
        _solve_tile(tile_cells, rank), "source string, cell_start_sec bigint, value double, state string"
    )


def held_out_errors(readings: DataFrame, periods: DataFrame, part: int = 10, **options) -> DataFrame:
    """(source, cells, error, line_error): how far fills lie off cells that were held out, one in ``part`` of each source's.

    Errors are medians over the cells that are filled and have an observed one within ``NEAR`` periods on both sides, in the
    unit of the readings; ``line_error`` is that of a straight line between the nearest two.
    """
    cells = materialize(cells_of(readings, periods), "grid-truth")
    hidden = F.pmod(F.xxhash64("source", "cell"), F.lit(part)) == 0
    shown = cells.where(~hidden)
    at = (F.col("cell") * F.col("period_sec")).alias("cell_start_sec")
    filled = regular_grid(shown.select("source", (at * NANOS).alias("ts_nanos"), "value"), periods, **options).where(F.col("state") == FILLED)
    steps = F.explode(F.array(*[F.lit(k) for k in range(-NEAR, NEAR + 1) if k])).alias("step")
    asked = cells.where(hidden).select("source", "period_sec", F.col("cell").alias("at"), F.col("value").alias("truth"), steps).withColumn("cell", F.col("at") + F.col("step"))
    before, after = F.when(F.col("step") < 0, F.col("step")), F.when(F.col("step") > 0, F.col("step"))
    beside = asked.join(shown.select("source", "cell", "value"), ["source", "cell"]).groupBy("source", "period_sec", "at", "truth").agg(
        F.max(before).alias("a"), F.max_by("value", before).alias("va"), F.min(after).alias("b"), F.min_by("value", after).alias("vb")
    ).where("a is not null and b is not null")
    line = F.col("va") - (F.col("vb") - F.col("va")) * F.col("a") / (F.col("b") - F.col("a"))
    told = beside.select("source", (F.col("at") * F.col("period_sec")).alias("cell_start_sec"), "truth", line.alias("line"))
    both = told.join(filled.select("source", "cell_start_sec", "value"), ["source", "cell_start_sec"])
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("cells"),
        F.median(F.abs(F.col("value") - F.col("truth"))).alias("error"), F.median(F.abs(F.col("line") - F.col("truth"))).alias("line_error"),
    )
