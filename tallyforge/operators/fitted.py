"""Fitted ratings as of every bucket: the results ridge on its points scale (Power), play efficiency, and their blend.

A season's games become sums per (bucket, fold, pair, site, weight).  A task takes a season's sums up to the end of a block of buckets and fits
at each bucket of its block, so nothing is fitted one after another across tasks; what a task holds are the pairs that met, never teams squared.  Every fit is stated in SQL as well (functions.ridge_sql).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import ship
from tallyforge.functions import algebra as al
from tallyforge.functions.expr import response_sql
from tallyforge.functions.ridge_sql import gradients, ridge
from tallyforge.operators import plays
from tallyforge.sources import adapters as A

GRID_RESULTS = tuple(2.0**k for k in range(-1, 9))
GRID_EFFICIENCY = tuple(float(v) for v in range(75, 350, 25))
FOLDS = 5
TYPE_WEIGHT = "case game_type when 'bowl_non_cfp' then 0.25 else 1.0 end"
MARGIN = "(home_points - away_points)"
SITE = "(case when neutral_site then 0 else 1 end)"
#: Buckets that one task fits one after the other.
AS_OF_BLOCK = 8
#: Rows beside the teams' in a matrix of games, by name; they sort behind all teams.
GAMES_ROW, MARGIN_ROW, SITE_ROW = "~g", "~m", "~site"
SPECIAL = (GAMES_ROW, MARGIN_ROW, SITE_ROW, al.RESPONSE)
#: The same of steps, whose teams are named o: and d: for their two parts.
STEP_SITE, STEP_ONE, STEP_VALUE = "~~site", "~~one", "~~y"
STEP_SPECIAL = (STEP_SITE, STEP_ONE, STEP_VALUE)
K_START = 68.0
LEAST_GAMES = 40
STEP_KINDS = ("view", "click", "purchase")


def entry(name, value) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("i"), value.cast("double").alias("v"))


def weighted(games: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Games and w: by type, times gamma for each whole week before the season's last kickoff."""
    base = F.expr(TYPE_WEIGHT).cast("double")
    if gamma != 1.0:
        last = F.max(F.unix_timestamp("start_date")).over(Window.partitionBy("season"))
        base = base * F.pow(F.lit(gamma), F.floor((last - F.unix_timestamp("start_date")) / 604800))
    return games.withColumn("w", base)


def folds(rows: DataFrame, k: int = FOLDS, group: str = "game_id", by: str = "season") -> DataFrame:
    """fold: the place of a group among the sorted distinct ones, modulo k; a game keeps its fold as the window grows."""
    if k < 2:
        raise ValueError("there must be at least two folds")
    return rows.withColumn("fold", ((F.dense_rank().over(Window.partitionBy(by).orderBy(group)) - 1) % k).cast("int"))


def game_design(games: DataFrame, gamma: float = 1.0, cap: float = 32.0, bonus: float = 7.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(season, bucket_order, row_id, w, entries, keep): +1 home, -1 away, the site, no intercept; beside them a one, the margin and the response."""
    g = weighted(games, gamma)
    entries = F.array(
        entry(F.col("home_team"), F.lit(1.0)), entry(F.col("away_team"), F.lit(-1.0)), entry(SITE_ROW, F.expr(SITE)), entry(GAMES_ROW, F.lit(1.0)), entry(MARGIN_ROW, F.expr(MARGIN)), entry(al.RESPONSE, F.expr(response_sql(MARGIN, cap, bonus))),
    )
    return g.select("season", "bucket_order", F.col("game_id").alias("row_id"), "w", *keep, *([F.col("fold")] if "fold" in games.columns else []), entries.alias("entries"))


FIT_SCHEMA = "season int, as_of int, team string, rho double, rating double, se double, lambda double, n_folds int, n_games long, edf double, sigma2 double, home_field double, scale double, points_edge double, residual double"


class Sums:
    """A season's matrices, growing by buckets: weighted sums a by fold, of squared weights a2, and plain ones a0.

    What it holds grows with the cells that are filled.  Matrices are made when they are asked for, of the buckets taken in so far.
    """

    def __init__(self, pdf: pd.DataFrame, special: tuple[str, ...] = SPECIAL):
        order = np.argsort(pdf["bucket_order"].to_numpy(), kind="stable")
        self.number(np.unique(np.concatenate((pdf["i"], pdf["j"]))), special)
        at = {n: k for k, n in enumerate(self.names)} | self.special
        self.dealt(pdf["bucket_order"].to_numpy()[order], pdf["fold"].to_numpy()[order])
        self.i, self.j = (pdf[c].map(at).to_numpy()[order] for c in ("i", "j"))
        self.values = {c: pdf[c].to_numpy()[order] for c in ("a", "a2", "a0")}
        n = len(self.names)
        self.diagonal, self.beside, self.behind = (self.i == self.j) & (self.i < n), (self.i < n) & (self.j >= n), self.i >= n
        self.cell = np.flatnonzero((self.i != self.j) & (self.j < n))
        self.order = al.both_ways(self.i[self.cell], self.j[self.cell])

    def number(self, names: np.ndarray, special: tuple[str, ...]) -> None:
        self.names = sorted(set(names) - set(special))
        self.special = {s: len(self.names) + k for k, s in enumerate(special)}
        self.teams = np.array([k for k, n in enumerate(self.names) if n[1:2] != ":"], int)
        self.size = len(self.names) + len(special)

    def dealt(self, bucket: np.ndarray, fold: np.ndarray) -> None:
        self.bucket, self.fold, self.buckets, self.folds, self.done = bucket, fold, np.unique(bucket), [int(f) for f in np.unique(fold)], 0

    def grow(self, bucket: int) -> None:
        """Takes in all buckets up to this one."""
        self.done = int(np.searchsorted(self.bucket, bucket, "right"))

    def known(self, fold: int | None = None, but: int | None = None) -> np.ndarray:
        """The rows taken in, of one fold or of all but one."""
        on = np.arange(len(self.bucket)) < self.done
        return on if fold is None and but is None else on & (self.fold == fold) if but is None else on & (self.fold != but)

    def ahead(self, bucket: int) -> np.ndarray:
        """The rows after those taken in, up to a bucket."""
        place = np.arange(len(self.bucket))
        return (place >= self.done) & (place < np.searchsorted(self.bucket, bucket, "right"))

    def matrix(self, name: str, on: np.ndarray | None = None) -> al.Gram:
        """The sums a, a2 or a0 of some rows, by themselves of all that were taken in."""
        on, n = self.known() if on is None else on, len(self.names)
        k, v = self.size - n, self.values[name]
        d, e, c = (part & on for part in (self.diagonal, self.beside, self.behind))
        corner = np.bincount((self.i[c] - n) * k + self.j[c] - n, v[c], k * k).reshape(k, k)
        border = np.bincount(self.i[e] * k + self.j[e] - n, v[e], n * k).reshape(n, k)
        return al.Gram(np.bincount(self.i[d], v[d], n), border, corner + corner.T - np.diag(corner.diagonal()), self.i[self.cell], self.j[self.cell], v[self.cell], self.order, on[self.cell])


class Meetings(Sums):
    """The same from rows (bucket_order, fold, p, q, w, n, sums and squares): games or steps of a pair of columns, a row a pair, bucket, fold, site and weight.

    `features` are the special columns with the sum that each has in a row, `products` the sums of products of two of them.  A row stands for n
    entries of 1 in column p and of `sign` in column q.
    """

    def __init__(self, pdf: pd.DataFrame, features: dict[str, str], products: dict[tuple[str, str], str], sign: int, p: str = "", q: str = ""):
        pdf = pdf.sort_values(["bucket_order", "p", "q", "site", "w"], kind="stable")
        p, q = (np.array([prefix + x for x in pdf[c]], object) for prefix, c in ((p, "p"), (q, "q")))
        self.number(np.unique(np.concatenate((p, q))), tuple(features))
        at = {n: k for k, n in enumerate(self.names)}
        self.dealt(pdf["bucket_order"].to_numpy(int), pdf["fold"].to_numpy(int))
        self.p, self.q, self.sign = (*(np.array([at[x] for x in part], int) for part in (p, q)), sign)
        self.w, self.n = pdf["w"].to_numpy(float), pdf["n"].to_numpy(float)
        self.sums = [pdf[c].to_numpy(float) for c in features.values()]
        place = {f: k for k, f in enumerate(features)}
        self.products = {(place[f], place[g]): pdf[c].to_numpy(float) for (f, g), c in products.items()}
        self.order = al.both_ways(np.minimum(self.p, self.q), np.maximum(self.p, self.q))

    def matrix(self, name: str, on: np.ndarray | None = None) -> al.Gram:
        on, k, n = self.known() if on is None else on, len(self.sums), len(self.names)
        w = {"a": self.w, "a2": self.w**2, "a0": np.ones(len(self.w))}[name] * on
        corner = np.zeros((k, k))
        for (f, g), v in self.products.items():
            corner[f, g] = corner[g, f] = w @ v
        border = np.column_stack([np.bincount(self.p, w * v, n) + self.sign * np.bincount(self.q, w * v, n) for v in self.sums])
        cells = w * self.n
        return al.Gram(np.bincount(self.p, cells, n) + np.bincount(self.q, cells, n), border, corner, np.minimum(self.p, self.q), np.maximum(self.p, self.q), self.sign * cells, self.order, on)


def fold_systems(sums: Sums, use: np.ndarray, special: list[int], y: int) -> Iterator[tuple]:
    """For each fold (A, b, yy) of all other rows and of its own."""
    for f in sums.folds:
        yield tuple((m.take(use, special), m.right(use, special, y), m.corner[y, y]) for m in (sums.matrix("a", sums.known(but=f)), sums.matrix("a", sums.known(fold=f))))


def places(sums: Sums, *names: str) -> list[int]:
    """Of special columns among themselves."""
    return [sums.special[n] - len(sums.names) for n in names]


def fit_games(sums: Sums, grid: tuple[float, ...] = GRID_RESULTS) -> dict:
    """Cross-validated ridge of the response on the teams seen so far and the site, and its scale against plain margins."""
    site, y, m, one = places(sums, SITE_ROW, al.RESPONSE, MARGIN_ROW, GAMES_ROW)
    a0, whole = sums.matrix("a0"), sums.matrix("a")
    seen = sums.teams[a0.diag[sums.teams] > 0]
    free = np.append(np.ones(len(seen)), 0.0)
    n_games = int(round(a0.corner[one, one]))
    lam, used = al.choose_lambda(fold_systems(sums, seen, [site], y), len(sums.folds), grid, free, n_games)
    a, b = whole.take(seen, [site]), whole.right(seen, [site], y)
    x = al.ridge(a, b, lam * free)
    scale, edge = points_scale(a0, seen, x[:-1], site, m)
    return {"seen": seen, "teams": [sums.names[k] for k in seen], "x": x, "lambda": lam, "folds": used, "n": n_games, "a": a, "b": b, "free": free, "yy": whole.corner[y, y], "weight": whole.corner[one, one], "scale": scale, "edge": edge}


def points_scale(a0: al.Gram, seen: np.ndarray, teams: np.ndarray, site: int, m: int) -> tuple[float, float]:
    """margin ~ scale * (difference of ratings) + edge * site, without intercept, from the plain sums."""
    part = a0.take(seen, [])
    return two_by_two(teams @ (part @ teams), teams @ a0.border[seen, site], a0.corner[site, site], teams @ a0.border[seen, m], a0.corner[site, m])


def two_by_two(s00: float, s01: float, s11: float, t0: float, t1: float) -> tuple[float, float]:
    """Least squares on two columns from their sums; of least norm where they aren't independent."""
    det = s00 * s11 - s01 * s01
    if det > 1e-9 * s00 * s11:
        return (t0 * s11 - t1 * s01) / det, (s00 * t1 - s01 * t0) / det
    trace = s00 + s11
    return ((s00 * t0 + s01 * t1) / trace**2, (s01 * t0 + s11 * t1) / trace**2) if trace else (0.0, 0.0)


TWO_BY_TWO = "case when s00 * s11 - s01 * s01 > 1e-9 * s00 * s11 then (t0 * s11 - t1 * s01) / (s00 * s11 - s01 * s01) else coalesce((s00 * t0 + s01 * t1) / nullif(pow(s00 + s11, 2), 0), 0) end"


#: Columns of the inverse that are solved for side by side.
UNITS = 64


def errors_of(sums: Sums, f: dict) -> tuple[np.ndarray, float, float]:
    """Sandwich variances of the coefficients, effective degrees of freedom and residual variance of a fit; columns of the inverse are solved for in blocks."""
    k, penalty = len(f["x"]), f["lambda"] * f["free"]
    squares, a = sums.matrix("a2").take(f["seen"], places(sums, SITE_ROW)), f["a"]
    variances, edf = np.zeros(k), 0.0
    for lo in range(0, k, UNITS):
        unit = np.zeros((k, min(UNITS, k - lo)))
        unit[np.arange(lo, lo + unit.shape[1]), np.arange(unit.shape[1])] = 1.0
        x = al.ridge_path(a, unit, np.repeat(penalty[:, None], unit.shape[1], 1))
        variances[lo : lo + unit.shape[1]] = (x * (squares @ x)).sum(0)
        edf += float((unit * (a @ x)).sum())
    rss = float(f["yy"] - 2 * f["x"] @ f["b"] + f["x"] @ (a @ f["x"]))
    sigma2 = rss / max(f["weight"] - edf, 1.0)
    return sigma2 * variances, edf, sigma2


def covariance_of(sums: Sums, f: dict) -> np.ndarray:
    """The whole sandwich covariance, coefficients squared, for readers of all pairs."""
    inverse = np.linalg.pinv(f["a"].toarray() + np.diag(f["lambda"] * f["free"]), hermitian=True)
    return errors_of(sums, f)[2] * inverse @ sums.matrix("a2").take(f["seen"], places(sums, SITE_ROW)).toarray() @ inverse


ROW_KEYS = ("season", "bucket_order", "fold", "p", "q", "site", "w")


def meetings(rows: DataFrame, p: str, q: str, values: dict[str, Column]) -> DataFrame:
    """ROW_KEYS, n and sums: one row a season, bucket, fold, pair of columns, site and weight."""
    return rows.select("season", "bucket_order", "fold", F.col(p).alias("p"), F.col(q).alias("q"), F.col("site").cast("double").alias("site"), "w", *(v.cast("double").alias(k) for k, v in values.items())).groupBy(*ROW_KEYS).agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in values))


def game_rows(games: DataFrame, cap: float = 32.0, bonus: float = 7.0) -> DataFrame:
    """Meetings of home and away team with sums of margins m and responses y, and of their squares."""
    g = weighted(folds(games)).withColumns({"site": F.expr(SITE), "m": F.expr(MARGIN).cast("double"), "y": F.expr(response_sql(MARGIN, cap, bonus))})
    return meetings(g, "home_team", "away_team", {"m": F.col("m"), "y": F.col("y"), "mm": F.col("m") * F.col("m"), "yy": F.col("y") * F.col("y")})


def site_sums(pdf: pd.DataFrame, names: tuple[str, ...]) -> pd.DataFrame:
    """With s, ss and s<name>: the site's sums by itself, squared and times others, as all of a row's entries have one site."""
    pdf = pdf.astype({c: float for c in ("site", "n", *names)})
    return pdf.assign(s=pdf["site"] * pdf["n"], ss=pdf["site"] ** 2 * pdf["n"], **{f"s{c}": pdf["site"] * pdf[c] for c in names})


def game_sums(pdf: pd.DataFrame) -> Meetings:
    one, m, s, y = SPECIAL
    products = {(one, one): "n", (one, m): "m", (one, s): "s", (one, y): "y", (m, m): "mm", (s, m): "sm", (s, s): "ss", (s, y): "sy", (y, y): "yy"}
    return Meetings(site_sums(pdf, ("m", "y")), {one: "n", m: "m", s: "s", y: "y"}, products, -1)


def step_rows(steps: DataFrame) -> DataFrame:
    return meetings(steps, "offense", "defense", {"y": F.col("play_value"), "yy": F.col("play_value") * F.col("play_value")})


def step_sums(pdf: pd.DataFrame) -> Meetings:
    if not len(pdf):  # without columns, where a group has no steps
        pdf = pd.DataFrame({c: [] for c in (*ROW_KEYS, "n", "y", "yy")})
    s, one, y = STEP_SPECIAL
    products = {(one, one): "n", (one, s): "s", (one, y): "y", (s, s): "ss", (s, y): "sy", (y, y): "yy"}
    return Meetings(site_sums(pdf, ("y",)), {s: "s", one: "n", y: "y"}, products, 1, "o:", "d:")


def in_blocks(rows: DataFrame, games: DataFrame, every: bool, ahead: bool = False) -> DataFrame:
    """Rows with a block: those that each block of buckets needs, its own and all before, and the next bucket's if it looks ahead.

    `every` fits at each bucket; otherwise there is one block a season, fitted at its last bucket.
    """
    if not every:
        return rows.withColumn("block", F.lit(0))
    info = games.groupBy("season").agg(F.max("bucket_order").alias("last"), F.array_sort(F.collect_set("bucket_order")).alias("all"))
    start = F.expr("coalesce(array_max(filter(all, b -> b < bucket_order)), bucket_order)") if ahead else F.col("bucket_order")
    blocks = F.sequence((start / AS_OF_BLOCK).cast("int"), (F.col("last") / AS_OF_BLOCK).cast("int"))
    return rows.join(F.broadcast(info), "season").withColumn("block", F.explode(blocks)).drop("last", "all")  # one row a season


def block_buckets(buckets: np.ndarray, block: int, every: bool) -> list[int]:
    return [int(b) for b in buckets if int(b) // AS_OF_BLOCK == block] if every else [int(b) for b in buckets[-1:]]


def bucket_sums(games: DataFrame, every: bool, cap: float = 32.0, bonus: float = 7.0) -> DataFrame:
    """The rows of game_rows that each block of buckets needs."""
    return in_blocks(game_rows(games, cap, bonus), games, every)


def fits(games: DataFrame, every: bool = False, errors: bool = False, grid: tuple[float, ...] = GRID_RESULTS, cap: float = 32.0, bonus: float = 7.0) -> DataFrame:
    """FIT_SCHEMA for every season, or as of every bucket of it: result ratings rho and Power, which is rho on the scale of points.

    A team is rated from its first game on.  Standard errors, edf and sigma2 are null unless `errors`.  No games: no rows.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, out = game_sums(pdf), []
        for as_of in block_buckets(sums.buckets, int(pdf["block"].iloc[0]), every):
            sums.grow(as_of)
            f = fit_games(sums, grid)
            k = len(f["teams"])
            variances, edf, sigma2 = errors_of(sums, f) if errors else (None, None, None)
            residual = float(np.abs(f["a"] @ f["x"] + f["lambda"] * f["free"] * f["x"] - f["b"]).max())
            out.append(pd.DataFrame({
                "season": pdf["season"].iloc[0], "as_of": as_of, "team": f["teams"], "rho": f["x"][:k], "rating": f["scale"] * f["x"][:k], "se": np.sqrt(np.maximum(variances[:k], 0)) if errors else None, "lambda": f["lambda"],
                "n_folds": f["folds"], "n_games": f["n"], "edf": edf, "sigma2": sigma2, "home_field": f["x"][-1], "scale": f["scale"], "points_edge": f["edge"], "residual": residual,
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in FIT_SCHEMA.split(", ")])

    ship(games.sparkSession)
    return bucket_sums(games, every, cap, bonus).groupBy("season", "block").applyInPandas(one, FIT_SCHEMA)


def power(games: DataFrame) -> DataFrame:
    """(season, team, rating): Power from all games of each season, to six places."""
    return fits(games).select("season", "team", F.round("rating", 6).alias("rating"))


def power_by_bucket(games: DataFrame, source: str = "L2", steps: DataFrame | None = None) -> DataFrame:
    """(season, as_of, team, rating): Power from the games through every bucket; results to six places, the blend with steps (L3) to four."""
    if source == "L3":
        return blend(layers(games, steps, every=True)).select("season", "as_of", "team", F.round("rating", 4).alias("rating"))
    return fits(games, every=True).select("season", "as_of", "team", F.round("rating", 6).alias("rating"))


def contest_steps(spark: SparkSession, d: str, rules: tuple[str, ...] = ()) -> DataFrame:
    """Snaps of the counted kinds with their values, on the games that they belong to: offense, defense, site 1, -1 or 0, bucket, weight.

    What a step is worth comes from the expected points of all steps.  Steps of no completed game between top-class teams go.
    With `rules` of decided games there are also the game's start and w_<rule>, the weight times the step's own under each.
    """
    steps = A.steps(spark, d)
    shown = plays.repaired(plays.board(steps)) if rules else steps
    valued = plays.play_values(shown, plays.expected_points(steps)).where(F.col("play_type").isin(*STEP_KINDS))
    orders = A.table(spark, d, "orders").agg(F.max("o_orderkey").alias("most"))
    keyed = valued.join(F.broadcast(orders)).withColumn("contest", 1 + (F.col("game_id") * 7919 + F.col("segment") * 104729) % F.col("most"))
    games = weighted(folds(A.played(spark, d))).select(F.col("game_id").alias("contest"), "season", "bucket_order", "start_date", "home_team", "away_team", "neutral_site", "w", "fold")
    j = keyed.join(games, "contest")
    home = F.col("offense_is_home")
    return j.select(
        "season", "bucket_order", "fold", "w", "contest", F.concat_ws(":", "game_id", "play_index").alias("row_id"), F.when(home, F.col("home_team")).otherwise(F.col("away_team")).alias("offense"),
        F.when(home, F.col("away_team")).otherwise(F.col("home_team")).alias("defense"), F.when(F.col("neutral_site"), 0).when(home, 1).otherwise(-1).alias("site"), "play_value",
        *((F.col("w") * F.expr(plays.step_weight_sql(r))).alias(f"w_{r}") for r in rules), *(["start_date"] if rules else []),
    )


def step_design(steps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Four entries a step: offence, defence, site, intercept; the value as a fifth."""
    entries = F.array(
        entry(F.concat(F.lit("o:"), "offense"), F.lit(1.0)), entry(F.concat(F.lit("d:"), "defense"), F.lit(1.0)), entry(STEP_SITE, F.col("site")), entry(STEP_ONE, F.lit(1.0)), entry(STEP_VALUE, F.col("play_value")),
    )
    return steps.select("season", "bucket_order", "fold", "row_id", "w", *keep, entries.alias("entries"))


def fit_steps(sums: Sums, grid: tuple[float, ...] = GRID_EFFICIENCY, n_folds: int = 0) -> dict:
    """Cross-validated ridge of step values on offences and defences; neither site nor intercept is penalised.  No steps: nothing.  Of n_folds folds some may have no steps."""
    site, one, y = places(sums, *STEP_SPECIAL)
    a0 = sums.matrix("a0")
    n = int(round(a0.corner[one, one]))
    if not n:
        return {"offense": {}, "defense": {}, "lambda": max(grid), "n": 0}
    parts = np.array([k for k in np.flatnonzero(a0.diag > 0) if sums.names[k][1:2] == ":"], int)
    free = np.append(np.ones(len(parts)), (0.0, 0.0))
    lam, _ = al.choose_lambda(fold_systems(sums, parts, [site, one], y), max(n_folds, len(sums.folds)), grid, free, n)
    whole = sums.matrix("a")
    x = al.ridge(whole.take(parts, [site, one]), whole.right(parts, [site, one], y), lam * free)
    got = {sums.names[k]: v for k, v in zip(parts, x, strict=False)}
    return {"offense": {k[2:]: v for k, v in got.items() if k[0] == "o"}, "defense": {k[2:]: v for k, v in got.items() if k[0] == "d"}, "lambda": lam, "n": n}


def least_norm(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(s, rcond=1e-11, hermitian=True) @ t


def game_moments(sums: Sums, columns: np.ndarray, a0: al.Gram) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of squares and products over games of columns, each a combination of the matrix's rows: (S, t with the margin, margin squared, games)."""
    m, one = places(sums, MARGIN_ROW, GAMES_ROW)
    return columns @ (a0 @ columns.T), columns @ np.append(a0.border[:, m], a0.corner[:, m]), float(a0.corner[m, m]), int(round(a0.corner[one, one]))


BLEND_SCHEMA = "season int, as_of int, team string, offense double, defense double, net double, k double, rho double, efficiency_lambda double, n_steps long, own array<double>, ahead array<double>"


def layer_fits(pdf: pd.DataFrame, step_pdf: pd.DataFrame, every: bool) -> pd.DataFrame:
    """BLEND_SCHEMA of one block of a season, from its rows of games and of steps."""
    own_sums, of_steps, out = game_sums(pdf), step_sums(step_pdf), []
    buckets = [int(b) for b in own_sums.buckets]
    at = {own_sums.names[i]: i for i in own_sums.teams}
    for as_of in block_buckets(own_sums.buckets, int(pdf["block"].iloc[0]), every):
        own_sums.grow(as_of)
        of_steps.grow(as_of)
        l2, l1 = fit_games(own_sums), fit_steps(of_steps, n_folds=len(own_sums.folds))
        net = {t: l1["offense"].get(t, 0.0) - l1["defense"].get(t, 0.0) for t in sorted({*l1["offense"], *l1["defense"]})}
        row = np.zeros((4, own_sums.size))  # net, rho, site, one
        for t, v in net.items():
            if t in at:
                row[0, at[t]] = v
        row[1, l2["seen"]] = l2["x"][:-1]
        row[2, own_sums.special[SITE_ROW]] = row[3, own_sums.special[GAMES_ROW]] = 1.0
        plain = own_sums.matrix("a0")
        s, t, _, _ = game_moments(own_sums, row[[3, 0, 2]], plain)
        k = float(least_norm(s, t)[1]) if l1["n"] else K_START
        row[0] *= k
        packed = lambda a0: [float(v) for part in game_moments(own_sums, row[:3], a0) for v in np.ravel(part)]
        own, ahead = packed(plain), None
        after = [b for b in buckets if b > as_of]
        if every and after:
            ahead = packed(own_sums.matrix("a0", own_sums.ahead(after[0])))
        names = sorted({*l2["teams"], *net})
        rho = dict(zip(l2["teams"], l2["x"], strict=False))
        part = pd.DataFrame({
            "season": pdf["season"].iloc[0], "as_of": as_of, "team": names, "offense": [l1["offense"].get(n, 0.0) for n in names], "defense": [l1["defense"].get(n, 0.0) for n in names], "net": [net.get(n, 0.0) for n in names],
            "k": k, "rho": [rho.get(n, 0.0) for n in names], "efficiency_lambda": l1["lambda"], "n_steps": l1["n"],
        })
        part["own"] = [own] + [None] * (len(names) - 1)
        part["ahead"] = [ahead] + [None] * (len(names) - 1)
        out.append(part)
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in BLEND_SCHEMA.split(", ")])


def layers(games: DataFrame, steps: DataFrame | None, every: bool = False) -> DataFrame:
    """BLEND_SCHEMA: both layers of every fit, k on the scale of points, and the sums that blend weights come from.

    own: moments of (k * net, rho, site) and the margin over the fit's own games; ahead: over the next bucket's games, which it hasn't
    seen (null for the last).  Both stand in one row of each fit.  Without steps efficiency is zero.
    """
    # A block also needs the next bucket of games after it, to see what its last fit says of what is ahead.
    g = in_blocks(game_rows(games), games, every, ahead=True)
    # A step belongs to a game, so no season or bucket has steps alone.
    none = "season int, bucket_order int, fold int, p string, q string, site double, w double, n long, y double, yy double, block int"
    h = games.sparkSession.createDataFrame([], none) if steps is None else in_blocks(step_rows(steps), games, every, ahead=True)

    ship(games.sparkSession)
    return g.groupBy("season", "block").cogroup(h.groupBy("season", "block")).applyInPandas(lambda pdf, step_pdf: layer_fits(pdf, step_pdf, every), BLEND_SCHEMA)


WALK_SCHEMA = "season int, as_of int, team string, rating double, efficiency double, w1 double, w2 double, home_field double, source string, n_weights long, sigma double, sigma_source string, n_residuals long"


def blend(fitted: DataFrame, floor: float = A.SIGMA, least: int = LEAST_GAMES) -> DataFrame:
    """WALK_SCHEMA: ratings w1 * k * net + w2 * rho as of every fit, weights and sigma from games that fits hadn't seen.

    Weights are least squares of the margin on (k * net, rho, site) over the games that earlier fits predicted, `least` of them or more, else
    over the fit's own games; sigma is the root mean square of those predictions' errors, the configured one where they are few or it is
    larger.  A season's task gets one row a team and bucket.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["as_of", "team"])
        s, t, yy, n, rss = np.zeros((3, 3)), np.zeros(3), 0.0, 0, 0.0
        out, told = [], None
        for as_of, part in pdf.groupby("as_of", sort=True):
            if told is not None:  # what the fit before said of this bucket's games
                ahead, w = told
                s, t, yy, n = s + ahead[:9].reshape(3, 3), t + ahead[9:12], yy + ahead[12], n + int(round(ahead[13]))
                rss += ahead[12] - 2 * w @ ahead[9:12] + w @ ahead[:9].reshape(3, 3) @ w
            own = np.array(next(v for v in part["own"] if v is not None), float)
            w = least_norm(s, t) if n >= least else least_norm(own[:9].reshape(3, 3), own[9:12])
            value = np.sqrt(max(rss, 0.0) / n) if n else 0.0
            source = "config_fallback_thin_window" if n < least else "config_floor" if value < floor else "walk_forward_residuals"
            out.append(pd.DataFrame({
                "season": part["season"].iloc[0], "as_of": int(as_of), "team": part["team"], "rating": w[0] * part["k"] * part["net"] + w[1] * part["rho"], "efficiency": part["k"] * part["net"], "w1": w[0], "w2": w[1], "home_field": w[2],
                "source": "out_of_sample" if n >= least else "training_window", "n_weights": n if n >= least else int(round(own[13])), "sigma": value if source == "walk_forward_residuals" else floor, "sigma_source": source, "n_residuals": n,
            }))
            ahead = next((v for v in part["ahead"] if v is not None), None)
            told = None if ahead is None else (np.array(ahead, float), w)
        return pd.concat(out)

    ship(fitted.sparkSession)
    return fitted.groupBy("season").applyInPandas(one, WALK_SCHEMA)


def predicted(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Games with both sides' ratings, a missing one being 0, their difference, the margin and the site."""
    for side, short in (("home", "hr"), ("away", "ar")):
        games = games.join(ratings.select("season", F.col("team").alias(f"{side}_team"), F.col("rating").alias(short)), ["season", f"{side}_team"], "left").withColumn(short, F.coalesce(short, F.lit(0.0)))
    return games.withColumns({"margin": F.expr(MARGIN), "site": F.expr(SITE), "delta": F.col("hr") - F.col("ar")})


GAME_ENTRIES = "select season, b, rid, fold, w, unnest([hi, ai, n + 1, n + 2]) i, unnest([1.0::double, -1.0, site, y]) v from {p}_rows"
GAME_PREDICTED = "x[hi] - x[ai] + site * x[n + 1]"
FIT_VIEWS = {
    "fit_teams": "select season, team, row_number() over (partition by season order by team) i, count(*) over (partition by season) n from (select distinct season, team from sides)",
}
ANY_GAMES = """select p.season, p.bucket_order b, game_id rid, h.i hi, a.i ai, h.n, {weight}::double w, {site}::double site, {margin}::double m, {response} y, (dense_rank() over (partition by p.season order by game_id) - 1) % {folds} fold
      from {games} p join {teams} h on h.season = p.season and h.team = home_team join {teams} a on a.season = p.season and a.team = away_team"""
_PARTS = {"weight": TYPE_WEIGHT, "site": SITE, "margin": MARGIN, "response": response_sql(MARGIN), "folds": FOLDS}
FIT_VIEWS["fit_games"] = ANY_GAMES.format(games="played", teams="fit_teams", **_PARTS)
# All classes of teams, whole seasons.
FIT_VIEWS |= {
    "fit_all_teams": "select season, team, row_number() over (partition by season order by team) i, count(*) over (partition by season) n from (select distinct season, team from sides_of_all where completed)",
    "fit_all_games": ANY_GAMES.format(games="(select * from contests where completed)", teams="fit_all_teams", **_PARTS),
    **ridge("fa", "select season, max(b) as_of from fit_all_games group by season", "select * from fit_all_games", GAME_ENTRIES.format(p="fa"), GAME_PREDICTED, 1, GRID_RESULTS, FOLDS),
    "fa_moments": "select season, as_of, sum(dr * dr) s00, sum(dr * site) s01, sum(site * site) s11, sum(dr * m) t0, sum(site * m) t1 from (select *, x[hi] - x[ai] dr from fa_x join fit_all_games using (season)) group by all",
    "fit_everyone": f"select season, team, x[i] * ({TWO_BY_TWO}) rating from fa_x join fa_moments using (season, as_of) join fit_all_teams using (season)",
}
for _p, _keys, _view in (("fs", "select season, max(bucket_order) as_of from played group by season", "fit_season"), ("fb", "select distinct season, bucket_order as_of from played", "fit_bucket")):
    FIT_VIEWS |= ridge(_p, _keys, "select * from fit_games", GAME_ENTRIES.format(p=_p), GAME_PREDICTED, 1, GRID_RESULTS, FOLDS)
    FIT_VIEWS |= {
        f"{_p}_moments": f"select season, as_of, sum(dr * dr) s00, sum(dr * site) s01, sum(site * site) s11, sum(dr * m) t0, sum(site * m) t1 from (select *, x[hi] - x[ai] dr from {_p}_x join fit_games using (season) where b <= as_of) group by all",
        _view: f"select season, as_of, team, x[i] rho, x[i] * ({TWO_BY_TWO}) rating, lam from {_p}_x join {_p}_moments using (season, as_of) join fit_teams using (season) join (select distinct season, as_of, i from {_p}_whole where i = j) using (season, as_of, i)",
    }
# Layer 1, the scale k, and the blend.  Names end in _s for whole seasons and in _b for every bucket.
STEP_VIEWS = {
    "step_values": f"""select t.*, play_type kind, case when points_scored <> 0 then points_scored else coalesce(lead(ep) over w * case when lead(offense_is_home) over w = offense_is_home then 1 else -1 end, 0) end - ep play_value
      from (select t.*, x.ep from ({plays.TARGETS}) t join (with {plays.EP_SQL.strip()} select * from ep) x on x.down = t.down and x.bucket = t.bucket and x.yards_to_goal = t.yards_to_goal where is_snap) t window w as (partition by game_id, segment order by play_index)""",
    "contest_steps": f"""select season, b, s.game_id * 1000000 + play_index rid, fold, w, case when offense_is_home then hi else ai end oi, n + case when offense_is_home then ai else hi end di, 2 * n n,
      case when f.site = 0 then 0 when offense_is_home then 1 else -1 end::double site, play_value y, case when offense_is_home then hi else ai end o, case when offense_is_home then ai else hi end d
      from (select *, 1 + (game_id * 7919 + segment * 104729) % (select max(o_orderkey) from orders) contest from step_values where kind in {STEP_KINDS}) s join fit_games f on f.rid = contest""",
}
STEP_ENTRIES = "select season, b, rid, fold, w, unnest([oi, di, n + 1, n + 2, n + 3]) i, unnest([1.0::double, 1.0, site, 1.0, y]) v from {p}_rows"
STEP_PREDICTED = "x[oi] + x[di] + site * x[n + 1] + x[n + 2]"


def moments_sql(columns: tuple[str, ...], by: str, rows: str) -> str:
    """(by, n, mm, a, b, d, f): normal equations of the margin on columns, as a system of gradients."""
    cell = lambda x, y: f"sum(({x}) * ({y}))"
    k = len(columns)
    matrix = "[" + ", ".join("[" + ", ".join(cell(x, y) for y in columns) + "]" for x in columns) + "]"
    return f"select {by}, count(*) n, sum(m * m) mm, {matrix} a, [{', '.join(cell(x, 'm') for x in columns)}] b, [{', '.join(['1.0::double'] * k)}] d, [{', '.join(['0.0::double'] * k)}] f from ({rows}) group by {by}"


def matrix_sum(column: str, over: str) -> str:
    at = lambda i, j: f"sum({column}[{i}][{j}]) over {over}"
    return "[" + ", ".join("[" + ", ".join(at(i, j) for j in (1, 2, 3)) + "]" for i in (1, 2, 3)) + "]"


for _e, _l, _s in (("es", "fs", "s"), ("eb", "fb", "b")):
    STEP_VIEWS |= ridge(_e, f"select * from {_l}_keys", "select * from contest_steps", STEP_ENTRIES.format(p=_e), STEP_PREDICTED, 2, GRID_EFFICIENCY, FOLDS, 14, 30)
    STEP_VIEWS |= {
        f"effect_{_s}": f"select season, as_of, team, i, lam, coalesce(x[i], 0) offense, coalesce(x[t.n + i], 0) defense, coalesce(x[i] - x[t.n + i], 0) net from {_l}_keys join fit_teams t using (season) left join {_e}_x e using (season, as_of)",
        f"net_{_s}": f"select season, as_of, list(net order by i) nets from effect_{_s} group by all",
        f"terms_{_s}": f"select season, as_of, b, rid, m, site, nets[hi] - nets[ai] dn, x[hi] - x[ai] dr from {_l}_x join net_{_s} using (season, as_of) join fit_games using (season)",
        f"scale_{_s}": moments_sql(("1::double", "dn", "site"), "season, as_of", f"select * from terms_{_s} where b <= as_of"),
        **gradients(f"k_{_s}", f"scale_{_s}", "season, as_of", 12),
        f"own_{_s}": moments_sql(("x[2] * dn", "dr", "site"), "season, as_of", f"select * from terms_{_s} join k_{_s} using (season, as_of) where b <= as_of"),
    }
STEP_VIEWS |= {
    **gradients("weight_s", "own_s", "season, as_of", 12),
    "blend_s": "select season, team, w.x[1] * k.x[2] * net + w.x[2] * coalesce(rho, 0) rating, k.x[2] k, net, offense, defense, coalesce(rho, 0) rho, w.x[1] w1, w.x[2] w2, w.x[3] h, e.lam from effect_s e join k_s k using (season, as_of) join weight_s w using (season, as_of) left join fit_season r using (season, as_of, team)",
    "ahead_b": moments_sql(("x[2] * dn", "dr", "site"), "season, prev, as_of", "select t.*, k.x, t.as_of prev, t.b next from terms_b t join (select season, as_of prev, lead(as_of) over (partition by season order by as_of) b from fb_keys) p on p.season = t.season and p.prev = t.as_of and p.b = t.b join k_b k on k.season = t.season and k.as_of = t.as_of").replace("season, prev, as_of, count", "season, prev, next as_of, count").replace("group by season, prev, as_of", "group by season, prev, next"),
    "seen_b": f"select season, as_of, sum(n) over w n, {matrix_sum('a', 'w')} a, [sum(b[1]) over w, sum(b[2]) over w, sum(b[3]) over w] b, d, f from ahead_b window w as (partition by season order by as_of)",
    "weigh_b": f"select season, as_of, coalesce(s.n, 0) seen, case when s.n >= {LEAST_GAMES} then s.n else o.n end n, case when s.n >= {LEAST_GAMES} then s.a else o.a end a, case when s.n >= {LEAST_GAMES} then s.b else o.b end b, o.d, o.f from own_b o left join seen_b s using (season, as_of)",
    **gradients("weight_b", "weigh_b", "season, as_of", 12),
    "missed_b": "select t.season, p.b as_of, sum(pow(m - w.x[1] * k.x[2] * dn - w.x[2] * dr - w.x[3] * site, 2)) rss, count(*) n from terms_b t join (select season, as_of prev, lead(as_of) over (partition by season order by as_of) b from fb_keys) p on p.season = t.season and p.prev = t.as_of and p.b = t.b join k_b k on k.season = t.season and k.as_of = t.as_of join weight_b w on w.season = t.season and w.as_of = t.as_of group by all",
    "error_b": f"select *, case when seen < {LEAST_GAMES} then 'config_fallback_thin_window' when rms < {A.SIGMA} then 'config_floor' else 'walk_forward_residuals' end sigma_source from (select season, k.as_of, coalesce(sum(n) over w, 0)::bigint seen, coalesce(sqrt(sum(rss) over w / sum(n) over w), 0) rms from fb_keys k left join missed_b m using (season, as_of) window w as (partition by season order by k.as_of))",
    "weights_b": f"select season, as_of, w.x[1] w1, w.x[2] w2, w.x[3] home_field, case when g.seen >= {LEAST_GAMES} then 'out_of_sample' else 'training_window' end as source, g.n::bigint n_weights, case when sigma_source = 'walk_forward_residuals' then rms else {A.SIGMA} end sigma, sigma_source, e.seen n_residuals from weight_b w join weigh_b g using (season, as_of) join error_b e using (season, as_of)",
    "blend_b": "select season, as_of, team, w1 * k.x[2] * net + w2 * coalesce(rho, 0) rating, k.x[2] * net efficiency from effect_b e join k_b k using (season, as_of) join weights_b w using (season, as_of) left join fit_bucket r using (season, as_of, team) where rho is not null or exists (select 1 from contest_steps c where c.season = e.season and c.b <= e.as_of and (c.o = e.i or c.d = e.i))",
}
FIT_VIEWS |= STEP_VIEWS
FIT_VIEWS |= {"power": "select season, team, round(rating, 6) rating from fit_season", "season_power": "select season, team, round(rating, 6) rating from blend_s", "power_as_of": "select season, as_of, team, round(rating, 6) rating from fit_bucket", "blend_as_of": "select season, as_of, team, round(rating, 4) rating from blend_b"}
A.VIEWS.update(FIT_VIEWS)
A.MATERIALIZED.update(FIT_VIEWS)


