"""Recipes, variants and the lever grid as tables (C*)."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import ship
from tallyforge.functions import algebra as al
from tallyforge.functions import config as C
from tallyforge.functions import solve
from tallyforge.functions.expr import compress_sql, phi_sql, rounded
from tallyforge.functions.ridge_sql import ridge
from tallyforge.operators import fitted
from tallyforge.operators import resume as Q
from tallyforge.plans.registry import query, rule
from tallyforge.sources import adapters as A
from tallyforge.sources.stored import stored

CAPS, BONUSES = (1.0, 18.0, 24.0, 32.0, 48.0, float("inf")), (0.0, 3.0, 7.0, 12.0)
DIAL = 0.985


@rule("C01_overlay")
def overlay_rows(spark: SparkSession, d: str) -> DataFrame:
    tree = C.flat(C.overlay(C.DEFAULTS, {"margin": {"c": 24.0}}))
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(tree.items())], "name string, value string")


@rule("C03_recipes")
def recipes(spark: SparkSession, d: str) -> DataFrame:
    """All recipes by (stance, slug), with their resolved hash and layer."""
    return spark.createDataFrame([(i, r.stance, r.slug, C.resolved_hash(r.resolve()), r.resolve()["poll"]["layer"]) for i, r in enumerate(C.roster())], "place int, stance string, slug string, hash string, layer string")


@rule("C17_levers")
def levers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, str(v[0]), str(v[-1])) for k, v in C.LEVERS.items()], "lever string, low string, high string")


@query("C15_lever_clamp", "select p_partkey, greatest(1.0::double, least(64.0, p_size * 2.5)) c from part")
def lever_clamp(spark: SparkSession, d: str) -> DataFrame:
    low, high = C.LEVERS["margin.c"]
    return A.table(spark, d, "part").select("p_partkey", F.greatest(F.lit(low), F.least(F.lit(high), F.col("p_size") * F.lit(2.5))).alias("c"))


def cell_id(cap: float, bonus: float, ordering: str) -> str:
    return f"c-{'uncapped' if cap == float('inf') else f'{cap:g}'}-bw-{bonus:g}-{ordering}"


#: Cap, bonus and ordering of every cell, and the eight that turn one knob of the house's (fixed values).
ORDERINGS = ("odds", "resume", "resume-margin")
CELLS = tuple(itertools.product(CAPS, BONUSES))
HOUSE = cell_id(32.0, 7.0, "odds")
VARIANTS = {
    "margin-beta-w-0": cell_id(32.0, 0.0, "odds"), "margin-beta-w-3": cell_id(32.0, 3.0, "odds"), "margin-beta-w-12": cell_id(32.0, 12.0, "odds"), "margin-c-1": cell_id(1.0, 7.0, "odds"), "margin-c-18": cell_id(18.0, 7.0, "odds"),
    "margin-c-uncapped": cell_id(float("inf"), 7.0, "odds"), "ordering-l4-resume": cell_id(32.0, 7.0, "resume"), "ordering-l4-resume-margin": cell_id(32.0, 7.0, "resume-margin"),
}
#: Rows of the responses in a matrix of games: one a cap, and the sign of the margin.
SIGN_ROW = "~~sign"
RESPONSES = tuple(f"~~y{k}" for k in range(len(CAPS)))
CELL_SCHEMA = "season int, cap double, bonus double, team string, rho double, rating double, lambda double"


def lever_design(games: DataFrame, caps: tuple[float, ...] = CAPS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The design of fitted.game_design with a response for each cap and one for the bonus, of which any cell's response is a sum."""
    rows = fitted.game_design(games, keep=keep)
    margin = F.element_at(F.filter("entries", lambda e: e["i"] == fitted.MARGIN_ROW), 1)["v"]
    more = [fitted.entry(f"~~y{k}", F.expr(compress_sql("m", c))) for k, c in enumerate(caps)] + [fitted.entry(SIGN_ROW, F.expr("sign(m)"))]
    return rows.withColumn("m", margin).withColumn("entries", F.concat(F.filter("entries", lambda e: e["i"] != al.RESPONSE), F.array(*more))).drop("m")


def lever_rows(games: DataFrame, caps: tuple[float, ...]) -> DataFrame:
    """Meetings of home and away team with sums of the margin, of the response of each cap, of the sign, and of the products that errors need."""
    g = fitted.weighted(fitted.folds(games)).withColumns({"site": F.expr(fitted.SITE), "m": F.expr(fitted.MARGIN).cast("double")})
    y, sign = {f"y{k}": F.expr(compress_sql("m", c)) for k, c in enumerate(caps)}, F.expr("sign(m)")
    products = {f"{a}{c}": v * w for a, v in y.items() for c, w in (("y", v), ("g", sign))}
    return fitted.meetings(g, "home_team", "away_team", {"m": F.col("m"), "mm": F.col("m") * F.col("m"), "g": sign, "gg": sign * sign, **y, **products})


def lever_sums(pdf: pd.DataFrame, caps: tuple[float, ...]) -> fitted.Meetings:
    one, m, s, g = fitted.GAMES_ROW, fitted.MARGIN_ROW, fitted.SITE_ROW, SIGN_ROW
    y = [f"y{k}" for k in range(len(caps))]
    products = {(one, one): "n", (one, m): "m", (one, s): "s", (one, g): "g", (m, m): "mm", (s, m): "sm", (s, s): "ss", (s, g): "sg", (g, g): "gg"}
    for c in y:
        products |= {(one, f"~~{c}"): c, (s, f"~~{c}"): f"s{c}", (f"~~{c}", f"~~{c}"): f"{c}y", (f"~~{c}", g): f"{c}g"}
    return fitted.Meetings(fitted.site_sums(pdf, ("m", "g", *y)), {one: "n", m: "m", s: "s", **{f"~~{c}": c for c in y}, g: "g"}, products, -1)


def fit_cells(sums: fitted.Sums, cells: tuple, caps: tuple[float, ...], grid: tuple[float, ...] = fitted.GRID_RESULTS) -> dict:
    """Ratings of all cells from one set of sums: (cap, bonus) -> (penalty, coefficients, scale), and the teams seen.

    A cell's response is that of its cap plus its bonus times the sign, so its solution is the same sum of solutions at each
    penalty; all caps and the sign are solved side by side over the whole path, once a fold.
    """
    site, one, m, sign, *ys = fitted.places(sums, fitted.SITE_ROW, fitted.GAMES_ROW, fitted.MARGIN_ROW, SIGN_ROW, *(f"~~y{k}" for k in range(len(caps))))
    a0, ys = sums.matrix("a0"), [*ys, sign]
    seen = sums.teams[a0.diag[sums.teams] > 0]
    free, n = np.append(np.ones(len(seen)), 0.0), int(round(a0.corner[one, one]))
    penalties = np.tile(free[:, None] * np.array(grid), (1, len(ys)))  # penalties of the first response, then of the next

    def path(a: al.Gram) -> np.ndarray:
        b = np.repeat(np.column_stack([a.right(seen, [site], y) for y in ys]), len(grid), 1)
        return al.ridge_path(a.take(seen, [site]), b, penalties).reshape(len(free), len(ys), len(grid))

    errors = {cell: np.zeros(len(grid)) for cell in cells}
    folds = sums.folds if len(sums.folds) > 1 and n >= 2 * len(sums.folds) else []
    for fold in folds:
        of_all, f = path(sums.matrix("a", sums.known(but=fold))), sums.matrix("a", sums.known(fold=fold))
        told = (f.take(seen, [site]) @ of_all.reshape(len(free), -1)).reshape(of_all.shape)  # of all responses, whose sums the cells' are
        for (cap, bonus), e in errors.items():
            k = caps.index(cap)
            x = of_all[:, k] + bonus * of_all[:, -1]
            y = f.right(seen, [site], ys[k]) + bonus * f.right(seen, [site], ys[-1])
            yy = f.corner[ys[k], ys[k]] + 2 * bonus * f.corner[ys[k], ys[-1]] + bonus**2 * f.corner[ys[-1], ys[-1]]
            e += yy - 2 * x.T @ y + (x * (told[:, k] + bonus * told[:, -1])).sum(0)
    last, out = path(sums.matrix("a")), {}
    for cap, bonus in cells:
        e = errors[cap, bonus]
        at = max(i for i, v in enumerate(e) if v <= e.min() + 1e-12) if folds else len(grid) - 1
        x = last[:, caps.index(cap), at] + bonus * last[:, -1, at]
        out[cap, bonus] = (grid[at], x, fitted.points_scale(a0, seen, x[:-1], site, m)[0])
    return {"teams": [sums.names[k] for k in seen], "cells": out}


def cell_ratings(games: DataFrame, cells: tuple = CELLS) -> DataFrame:
    """CELL_SCHEMA: every season refitted under every cap and bonus, from one set of sums a season."""
    caps = tuple(sorted({c for c, _ in cells}))
    g = lever_rows(games, caps)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = lever_sums(pdf, caps)
        sums.grow(int(sums.buckets[-1]))
        f = fit_cells(sums, cells, caps)
        return pd.concat([
            pd.DataFrame({"season": pdf["season"].iloc[0], "cap": cap, "bonus": bonus, "team": f["teams"], "rho": x[:-1], "rating": scale * x[:-1], "lambda": lam})
            for (cap, bonus), (lam, x, scale) in f["cells"].items()
        ])

    ship(games.sparkSession)
    return g.groupBy("season").applyInPandas(one, CELL_SCHEMA)


RECORD_SCHEMA = "season int, cap double, bonus double, team string, rating double, tail double, mid double, resume double, by_margin double, wins long"


def cell_records(sides: pd.DataFrame, ratings: pd.DataFrame) -> pd.DataFrame:
    """RECORD_SCHEMA of one season under one cap: each bonus's ratings met with the season's sides by schedule odds and both resumes.

    A team's games are in order and its roots are those of resume.solved and resume.solved_by_margin; teams are solved side by side.
    """
    cap = float(ratings["cap"].iloc[0]) if len(ratings) else 1.0
    sides = sides.sort_values(["team", "game_id"])
    names, team = np.unique(sides["team"].to_numpy(object), return_inverse=True)
    k = len(names)
    start = np.searchsorted(team, np.arange(k))
    at = {n: i for i, n in enumerate(names)}
    other = np.array([at[o] for o in sides["opponent"]], int)
    margin, site = sides["margin"].to_numpy(float), Q.EDGE * sides["site"].to_numpy(float)
    wins = np.add.reduceat(sides["won"].to_numpy(int), start) if k else np.zeros(0, int)
    compressed = margin if np.isinf(cap) else cap * np.tanh(margin / cap)
    out = []
    for bonus, part in ratings.groupby("bonus", sort=True):
        rated = part.set_index("team")["rating"]
        power = rated.reindex(names).fillna(0.0).to_numpy()
        opp, best = power[other], np.sort(rated.to_numpy())[::-1]
        q_ref = best[min(Q.REFERENCE_RANK, len(best)) - 1]
        tail, mid = solve.tails(al.phi((q_ref - opp + site) / Q.SIGMA), team, start, wins)
        target = np.round(np.add.reduceat(compressed + bonus * np.sign(margin), start), 9)
        resume = solve.roots(lambda q, on: al.phi((q - opp[on] + site[on]) / Q.SIGMA), wins.astype(float), team, start)
        by_margin = solve.roots(lambda q, on, b=bonus: expected_response(q - opp[on] + site[on], cap, b), target, team, start)
        out.append(pd.DataFrame({"season": part["season"].iloc[0], "cap": cap, "bonus": bonus, "team": names, "rating": rated.reindex(names).to_numpy(), "tail": tail, "mid": mid, "resume": resume, "by_margin": by_margin, "wins": wins}))
    return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in RECORD_SCHEMA.split(", ")])


def expected_response(mean: np.ndarray, cap: float, bonus: float) -> np.ndarray:
    """Of a normal margin about `mean`: its expected compressed value, by the nodes of resume.margin_of, and the bonus."""
    if np.isinf(cap):
        value = mean
    else:
        value = np.zeros(len(mean))
        for x, w in zip(Q.NODES, Q.WEIGHTS, strict=True):
            value += w / np.sqrt(np.pi) * np.tanh((mean + np.sqrt(2) * Q.SIGMA * x) / cap)
        value *= cap
    return value + bonus * (2 * al.phi(mean / Q.SIGMA) - 1) if bonus else value


def placed(games: DataFrame) -> DataFrame:
    """(season, cell, cap, bonus, ordering, team, rating, r): the ranks of all 72 cells, each refitted and met with its own schedule odds or resume."""
    p = stored(cell_ratings(games).select("season", "cap", "bonus", "team", F.round("rating", 6).alias("rating")), "cells")
    caps = F.explode(F.array(*(F.lit(c) for c in CAPS))).alias("cap")
    sides = A.sides(games).select("season", caps, "game_id", "team", "opponent", "site", "margin", "won")
    records = sides.groupBy("season", "cap").cogroup(p.groupBy("season", "cap")).applyInPandas(cell_records, RECORD_SCHEMA)
    x = F.explode(F.array(
        F.struct(F.lit("odds").alias("ordering"), F.round("tail", 12).alias("x"), F.round("mid", 12).alias("y")),
        F.struct(F.lit("resume").alias("ordering"), (-F.round("resume", 5)).alias("x"), (-F.col("wins")).cast("double").alias("y")),
        F.struct(F.lit("resume-margin").alias("ordering"), (-F.round("by_margin", 5)).alias("x"), (-F.col("wins")).cast("double").alias("y")),
    ))
    every = records.withColumn("o", x).select("season", "cap", "bonus", "team", "rating", "o.*")
    r = F.row_number().over(Window.partitionBy("season", "cap", "bonus", "ordering").orderBy("x", "y", "team"))
    cell = F.concat(F.lit("c-"), F.when(F.col("cap") > 1e300, "uncapped").otherwise(F.col("cap").cast("int").cast("string")), F.lit("-bw-"), F.col("bonus").cast("int").cast("string"), F.lit("-"), "ordering")
    return every.select("season", cell.alias("cell"), "cap", "bonus", "ordering", "team", "rating", r.alias("r"))


_CAPS = ", ".join("'Infinity'::double" if c == float("inf") else f"{c}::double" for c in CAPS)
_CELL_KEYS = f"select k.season * 100 + ci * 10 + bi season, k.season real_season, as_of, cap, bonus from fs_keys k, (select cap, bonus, ci, bi from (select unnest([{_CAPS}]) cap, unnest(range(0, {len(CAPS)})) ci) cross join (select unnest([{', '.join(f'{b}::double' for b in BONUSES)}]) bonus, unnest(range(0, {len(BONUSES)})) bi))"
_OF = "case when cap > 1e300 then {m}::double else cap * tanh({m} / cap) end + bonus * sign({m})"
GRID_VIEWS = {
    "lg_cells": _CELL_KEYS,
    **ridge("lg", "select season, as_of from lg_cells", f"select g.* replace (c.season as season, g.rid * 100 + c.season % 100 as rid, {_OF.format(m='m')} as y) from fit_games g join lg_cells c on c.real_season = g.season", fitted.GAME_ENTRIES.format(p="lg"), fitted.GAME_PREDICTED, 1, fitted.GRID_RESULTS, fitted.FOLDS),
    "lg_moments": "select season, as_of, sum(dr * dr) s00, sum(dr * site) s01, sum(site * site) s11, sum(dr * m) t0, sum(site * m) t1 from (select *, x[hi] - x[ai] dr from lg_x join lg_rows using (season)) group by all",
    "lg_power": f"select c.season key, c.real_season season, cap, bonus, team, round(x[i] * ({fitted.TWO_BY_TWO}), 6) rating from lg_x x join lg_moments using (season, as_of) join lg_cells c using (season, as_of) join fit_teams t on t.season = c.real_season",
    "lg_q": f"select key, season, cap, bonus, coalesce(max(case when r = {Q.REFERENCE_RANK} then rating end), min(rating)) q_ref from (select *, row_number() over (partition by key order by rating desc, team) r from lg_power) group by all",
    "lg_side": f"select q.key, s.team, game_id, cap, bonus, site, margin, won, lost, coalesce(o.rating, 0) opp, {_OF.format(m='margin')} response, (q_ref - coalesce(o.rating, 0) + {Q.EDGE} * site) / {Q.SIGMA} z from sides s join lg_q q using (season) left join (select key, team, rating from lg_power) o on o.key = q.key and o.team = s.opponent",
    "lg_steps": f"select key, team, {Q.WIN_P} p, row_number() over (partition by key, team order by game_id) step_no from lg_side",
    "lg_sum": "select key, team, cap, bonus, sum(won)::double wins, round(sum(response), 9) target, count(*) n from lg_side group by all",
    "lg_conv": """select key, team, 0::bigint step_no, [1.0::double] acc from lg_sum
      union all select key, team, o.step_no, list_transform(range(1, len(acc) + 2), lambda i: coalesce(acc[i], 0) * (1 - p) + case when i > 1 then coalesce(acc[i - 1], 0) else 0 end * p) from lg_conv c join lg_steps o using (key, team) where o.step_no = c.step_no + 1""",
    "lg_root": f"""select key, team, kind, 0 it, -{Q.BOUND}::double lo, {Q.BOUND}::double hi, case kind when 'resume' then wins else target end goal from lg_sum, (select unnest(['resume', 'resume-margin']) kind)
      union all select key, team, kind, it + 1, case when w < goal then mid else lo end, case when w < goal then hi else mid end, goal from (
        select key, team, kind, it, lo, hi, mid, goal, sum(case kind when 'resume' then {phi_sql(f'(d / {Q.SIGMA})')} else {Q.margin_of('d', 'cap')} + bonus * (2 * {phi_sql(f'(d / {Q.SIGMA})')} - 1) end) w
        from (select r.*, (lo + hi) / 2 mid, (lo + hi) / 2 - opp + {Q.EDGE} * site d, cap, bonus from lg_root r join lg_side using (key, team) where it < {Q.HALVINGS}) group by all)""",
    "lg_order": f"""select key, team, 'odds' ordering, round(list_sum(acc[wins::int + 1:]), 12) x, round(list_sum(acc[wins::int + 1:]) - 0.5 * acc[wins::int + 1], 12) y from lg_conv join lg_sum using (key, team) where step_no = n
      union all select key, team, kind, -round(case when (lo + hi) / 2 > {Q.BOUND} - 1e-9 then {Q.BOUND} when (lo + hi) / 2 < -{Q.BOUND} + 1e-9 then -{Q.BOUND} else (lo + hi) / 2 end, 5), -wins from lg_root join lg_sum using (key, team) where it = {Q.HALVINGS}""",
    "lever_grid": "select season, 'c-' || case when cap > 1e300 then 'uncapped' else cap::int::varchar end || '-bw-' || bonus::int::varchar || '-' || ordering cell, cap, bonus, ordering, team, rating, row_number() over (partition by key, ordering order by x, y, team)::int r from lg_order join lg_power using (key, team)",
    "lever_pairs": f"select a.season, a.cell, a.team, a.r, h.r h from lever_grid a join lever_grid h on h.season = a.season and h.team = a.team and h.cell = '{HOUSE}'",
    "lever_agreement": """select c.season, c.cell, c.n, c.moved, round(tau, 6) tau from (select season, cell, count(*) n, count(case when abs(r - h) >= 5 then 1 end) moved from lever_pairs group by all) c
      left join (select p.season, p.cell, avg(sign(p.r - q.r) * sign(p.h - q.h)) tau from lever_pairs p join lever_pairs q on q.season = p.season and q.cell = p.cell and q.team > p.team group by all) t using (season, cell)""",
}
A.VIEWS.update(GRID_VIEWS)
A.MATERIALIZED.update(GRID_VIEWS)
NAMED = "case cell " + " ".join(f"when '{v}' then '{k}'" for k, v in VARIANTS.items()) + " end"
NAMES = f"(select unnest({list(VARIANTS)}) variant, unnest({list(VARIANTS.values())}) cell)"


@query("C10_lever_grid", "select cell, count(*) teams, count(distinct season) seasons, min(r) least, max(r) most from lever_grid group by cell", least="int", most="int")
def lever_grid(spark: SparkSession, d: str) -> DataFrame:
    return placed(A.played(spark, d)).groupBy("cell").agg(F.count("*").alias("teams"), F.countDistinct("season").alias("seasons"), F.min("r").alias("least"), F.max("r").alias("most"))


@query("C07_variant_set", f"select variant, season, team, r from lever_grid join {NAMES} using (cell) where r <= 25", r="int")
def variant_set(spark: SparkSession, d: str) -> DataFrame:
    """One knob turned: the first 25 of each season under each of the eight variants."""
    return placed(A.played(spark, d)).withColumn("variant", F.expr(NAMED)).where("variant is not null and r <= 25").select("variant", "season", "team", "r")


def inversions(x: np.ndarray) -> int:
    """Pairs in the wrong order, by merging sorted halves; no pair is looked at by itself."""
    n, total, width = len(x), 0, 1
    x = np.array(x)
    while width < n:
        for lo in range(0, n - width, 2 * width):
            left, right = x[lo : lo + width], x[lo + width : lo + 2 * width]
            total += int((width - np.searchsorted(left, right, "right")).sum())
            x[lo : lo + 2 * width] = np.sort(x[lo : lo + 2 * width], kind="stable")
        width *= 2
    return total


def agreement(games: DataFrame) -> DataFrame:
    """(season, cell, n, moved, tau): each cell's ranks against the house's, over the whole common board."""
    p = stored(placed(games).select("season", "cell", "team", "r"), "placed")
    house = p.where(F.col("cell") == HOUSE).select("season", "team", F.col("r").alias("h"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        wrong = inversions(pdf.sort_values("h")["r"].to_numpy())
        tau = 1 - 4 * wrong / (n * (n - 1)) if n > 1 else None
        return pd.DataFrame({"season": pdf["season"].iloc[:1], "cell": pdf["cell"].iloc[:1], "n": n, "moved": int((np.abs(pdf["r"] - pdf["h"]) >= 5).sum()), "tau": None if tau is None else round(tau, 6)})

    return p.join(house, ["season", "team"]).groupBy("season", "cell").applyInPandas(one, "season int, cell string, n long, moved long, tau double")


JUDGED = f"case when tau < {DIAL} then 'dial' else 'convention' end"


@query("C08_agreement", f"select variant, season, n, moved, tau, {JUDGED} verdict from lever_agreement join {NAMES} using (cell)")
def agreement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau and teams moved by five places or more, of each variant."""
    return agreement(A.played(spark, d)).withColumn("variant", F.expr(NAMED)).where("variant is not null").select("variant", "season", "n", "moved", "tau", F.expr(JUDGED).alias("verdict"))


@query("C11_grid_agreement", f"select a.cell, season, n, moved, tau, case when variant is not null or a.cell in {tuple(cell_id(c, 7.0, 'odds') for c in (24.0, 48.0))} then {JUDGED} end verdict from lever_agreement a left join {NAMES} v on v.cell = a.cell")
def grid_agreement(spark: SparkSession, d: str) -> DataFrame:
    """A verdict only where exactly one knob is turned."""
    a = agreement(A.played(spark, d))
    turned = (~F.col("cell").startswith("c-32-")).cast("int") + (~F.col("cell").contains("-bw-7-")).cast("int") + (~F.col("cell").endswith("-odds")).cast("int")
    return a.select("cell", "season", "n", "moved", "tau", F.when(turned == 1, F.expr(JUDGED)).alias("verdict"))


@query("C09_variant_document", f"select variant, season, team, r, round(rating, 4) rating from lever_grid join {NAMES} using (cell) where r <= 40", r="int")
def variant_document(spark: SparkSession, d: str) -> DataFrame:
    return placed(A.played(spark, d)).withColumn("variant", F.expr(NAMED)).where("variant is not null and r <= 40").select("variant", "season", "team", "r", rounded("rating", 4).alias("rating"))


@query("C12_equivalence", f"select cell, case when cell = '{HOUSE}' then 'house' else variant end matches, n from (select cell, count(*) n from lever_grid group by cell) left join {NAMES} using (cell)")
def equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Which cells are the house's or a variant's settings, and how many rows they have."""
    c = placed(A.played(spark, d)).groupBy("cell").agg(F.count("*").alias("n"))
    return c.select("cell", F.when(F.col("cell") == HOUSE, "house").otherwise(F.expr(NAMED)).alias("matches"), "n")


@query("C13_complete_seasons", f"select season from lever_grid group by season having count(distinct cell) = {len(CELLS) * len(ORDERINGS)}")
def complete_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Seasons that every cell covers."""
    r = placed(A.played(spark, d)).groupBy("season").agg(F.countDistinct("cell").alias("n"))
    return r.where(f"n = {len(CELLS) * len(ORDERINGS)}").select("season")


@query("C14_manifest", "select cap_slug, bonus, ordering, n, seasons, leaders from (select case when cap > 1e300 then 'uncapped' else cap::int::varchar end cap_slug, bonus, ordering, count(*) n, count(distinct season) seasons, string_agg(case when r = 1 then team end, ',' order by season) leaders from lever_grid group by cap, bonus, ordering)")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    p = placed(A.played(spark, d)).withColumn("cap_slug", F.when(F.col("cap") > 1e300, "uncapped").otherwise(F.col("cap").cast("int").cast("string")))
    leaders = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") == 1, F.struct("season", "team")))), lambda x: x["team"]), ",")
    return p.groupBy("cap_slug", "bonus", "ordering").agg(F.count("*").alias("n"), F.countDistinct("season").alias("seasons"), leaders.alias("leaders"))


@query("C18_grid_checker", "with a as (select distinct season, team, round(rating, 4) rating from lever_grid where cap = 32 and bonus = 7), b as (select season, team, round(rating, 4) rating from power) select season, team, rating, 'grid' only_in from (select * from a except all select * from b) union all select season, team, rating, 'direct' from (select * from b except all select * from a)")
def grid_checker(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of the house's cell that a fit of its own lacks, and the other way round; none if both agree."""
    g = A.played(spark, d)
    a = cell_ratings(g).where("cap = 32 and bonus = 7").select("season", "team", F.round(F.round("rating", 6), 4).alias("rating"))
    b = fitted.power(g).select("season", "team", F.round("rating", 4).alias("rating"))
    return a.exceptAll(b).withColumn("only_in", F.lit("grid")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("direct")))


@query("M22_home_edge_anchor", f"select season, {A.HOME_EDGE}::double edge, count(*) n from played group by season")
def home_edge_anchor(spark: SparkSession, d: str) -> DataFrame:
    return A.played(spark, d).groupBy("season").agg(F.lit(A.HOME_EDGE).alias("edge"), F.count("*").alias("n"))


@query("M40_cross_pair_error", "with p as (select season, team, rating, n from power join (select season, team, count(*) n from sides group by 1, 2) using (season, team)) select a.season, count(*) pairs, round(avg(sqrt(1.0::double / a.n + 1.0::double / b.n)), 6) mean_se from p a join p b on a.season = b.season and a.team < b.team where left(a.team, 6) <> left(b.team, 6) group by 1")
def cross_pair_error(spark: SparkSession, d: str) -> DataFrame:
    """Spread of differences between teams of different groups; pairs of a league's teams."""
    g = A.played(spark, d)
    p = fitted.power(g).join(A.sides(g).groupBy("season", "team").agg(F.count("*").alias("n")), ["season", "team"]).select("season", "team", "n")
    o = p.select("season", F.col("team").alias("other"), F.col("n").alias("m"))
    j = p.join(o, "season").where("team < other and left(team, 6) <> left(other, 6)")
    return j.groupBy("season").agg(F.count("*").alias("pairs"), F.round(F.avg(F.sqrt(1 / F.col("n") + 1 / F.col("m"))), 6).alias("mean_se"))


