"""Ridge fits as SQL for DuckDB: normal equations as lists of lists, solved by conjugate gradients in recursive CTEs.

It states for small tables what the grouped tasks of operators.fitted do with dense solves; the two share no code.
"""

from __future__ import annotations


def gradients(name: str, systems: str, key: str, rounds: int) -> dict[str, str]:
    """Views ending in `name` (key, x): the solutions of (a + diag(f)) x = b for every row (key, a, b, d, f) of `systems`.

    d is the diagonal of the whole matrix, a list like b; f what is added to a's diagonal.  A right side of zeros, or one that has
    been met to fourteen digits, stays where it is.  From zero on, so a singular system gets its solution of least norm where d is constant.
    """
    inner = f"""select {key}, it + 1 it, list_transform(x, lambda v, i: v + al * p[i]) x, r2 r, list_transform(r2, lambda v, i: v / d[i] + case when rz = 0 then 0 else rz2 / rz end * p[i]) p, rz2 rz, goal, d from (
      select *, list_dot_product(r2, list_transform(r2, lambda v, i: v / d[i])) rz2 from (
        select *, list_transform(r, lambda v, i: v - al * q[i]) r2 from (
          select *, case when rz <= goal then 0 else rz / list_dot_product(p, q) end al from (
            select c.*, list_transform(s.a, lambda w, i: list_dot_product(w, p) + s.f[i] * p[i]) q from {name}_steps c join {systems} s using ({key}) where it < {rounds}))))"""
    start = f"select {key}, 0 it, list_transform(b, lambda v: 0::double) x, b r, list_transform(b, lambda v, i: v / d[i]) p, list_dot_product(b, list_transform(b, lambda v, i: v / d[i])) rz, 1e-28 * list_dot_product(b, list_transform(b, lambda v, i: v / d[i])) goal, d from {systems}"
    return {f"{name}_steps": f"{start} union all {inner}", name: f"select {key}, x from {name}_steps where it = {rounds}"}


def ridge(p: str, keys: str, rows: str, entries: str, predicted: str, free: int, grid: tuple[float, ...], folds: int, quick: int = 26, rounds: int = 70) -> dict[str, str]:
    """Views ending in {p}_x (season, as_of, n, lam, x), one fit for each (season, as_of) of `keys` from the rows whose b is no later.

    rows: (season, b, rid, fold, w, y, n) and what `predicted` needs beside x; n coefficients are penalised, `free` more are not.
    entries: (season, b, rid, fold, w, i, v), i from 1, the response being the last.  The penalty is the greatest of those within
    1e-12 of the least weighted squared error over held-out folds; with fewer rows than twice the folds, the greatest of all.
    """
    k = "season, as_of, fold"
    key = "season, as_of, fold, lam"
    whole = f"select season, as_of, -1 fold, i, map(list(j order by j), list(a order by j)) m from {p}_whole group by all"
    train = f"select w.season, w.as_of, f.fold, w.i, map(list(w.j order by w.j), list(w.a - coalesce(c.a, 0) order by w.j)) from {p}_whole w cross join (select unnest(range(0, {folds})) fold) f left join {p}_cum c on c.season = w.season and c.as_of = w.as_of and c.fold = f.fold and c.i = w.i and c.j = w.j group by all"
    penalised = "list_transform(d, lambda v, i: case when i <= n then v + lam else greatest(v, 1e-300) end) d, list_transform(d, lambda v, i: case when i <= n then lam else 0::double end) f"
    out = {
        f"{p}_keys": keys,
        f"{p}_rows": rows,
        f"{p}_ent": entries,
        f"{p}_cell": f"select e.season, e.b, e.fold, e.i, f.i j, sum(e.w * e.v * f.v) a from {p}_ent e join {p}_ent f using (rid) group by all",
        f"{p}_cum": f"select season, as_of, fold, i, j, sum(a) a from {p}_cell join {p}_keys using (season) where b <= as_of group by all",
        f"{p}_whole": f"select season, as_of, i, j, sum(a) a from {p}_cum group by all",
        f"{p}_map": f"{whole} union all {train}",
        f"{p}_row": f"select k.*, list_transform(range(1, n + {free + 1}), lambda j: coalesce(m[j], 0)) r, coalesce(m[n + {free + 1}], 0) y from (select *, unnest(range(1, n + {free + 1})) i from {p}_keys join (select distinct season, n from {p}_rows) using (season), (select unnest(range(-1, {folds})) fold)) k left join {p}_map c on c.season = k.season and c.as_of = k.as_of and c.fold = k.fold and c.i = k.i",
        f"{p}_sys": f"select {k}, n, list(r order by i) a, list(y order by i) b, list(r[i] order by i) d from {p}_row group by all",
        f"{p}_try": f"select {key}, n, a, b, {penalised} from (select s.*, unnest([{', '.join(f'{v}::double' for v in grid)}]) lam from {p}_sys s where fold >= 0)",
        **gradients(f"{p}_cv", f"{p}_try", key, quick),
        f"{p}_err": f"select season, as_of, lam, sum(w * pow(y - ({predicted}), 2)) e from {p}_cv join {p}_rows using (season, fold) where b <= as_of group by all",
        f"{p}_n": f"select season, as_of, count(*) rows from {p}_rows join {p}_keys using (season) where b <= as_of group by all",
        f"{p}_lam": f"select season, as_of, case when any_value(rows) < {2 * folds} then {max(grid)} else max(case when e <= least + 1e-12 then lam end) end lam from (select *, min(e) over (partition by season, as_of) least from {p}_err) join {p}_n using (season, as_of) group by all",
        f"{p}_best": f"select {key}, n, a, b, {penalised} from {p}_sys join {p}_lam using (season, as_of) where fold = -1",
        **gradients(f"{p}_fit", f"{p}_best", key, rounds),
    }
    return out | {f"{p}_x": f"select season, as_of, n, lam, x from {p}_fit join {p}_best using ({key})"}


def dense(cells: str, teams: str = "fit_teams") -> str:
    """(season, n, a): a matrix as a list of rows from cells (season, i, j, v), each given once, over all teams of a season."""
    listed = f"select season, i, map(list(j), list(v::double)) m from ({cells}) group by season, i"
    row = f"select t.season, t.n, t.i, list_transform(range(1, n + 1), lambda j: coalesce(m[j], 0)) r from {teams} t left join ({listed}) c on c.season = t.season and c.i = t.i"
    return f"select season, n, list(r order by i) a from ({row}) group by season, n"
