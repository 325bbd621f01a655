"""Sparse and dense regressions on sufficient statistics: small algebra whose size is the number of terms.

``g`` is the covariance of the columns, ``c`` their covariance with the response, both divided by n.
"""

from __future__ import annotations

from collections.abc import Sequence

import warnings

import numpy as np

from .stats import Gram, total


def lasso(g: np.ndarray, c: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 5000, tol: float = 1e-10) -> np.ndarray:
    """Minimises b'gb/2 - c'b + penalty * |b|_1 by feature-sign search (Lee et al., 2006): guess the signs of the non-zero
    coefficients, solve for them, and walk towards that solution as far as the target falls; then let in the column that
    breaks the optimality conditions most. Exact after finitely many steps, also for highly correlated columns."""
    m = len(c)
    b = np.zeros(m) if start is None else start.astype(float).copy()
    usable = g.diagonal() > 1e-14
    size = np.abs(c)
    if (size[usable] <= penalty).all():
        return np.zeros(m)
    eps = tol * max(1e-12, float(size.max()))
    if m <= FEW and np.isfinite(size).all():
        for signs in ([] if start is None else [start.tolist()]) + [[0.0] * m]:
            if few := _lasso_of_few(g.tolist(), c.tolist(), penalty, signs, usable.tolist(), eps):
                return np.array(few)
    if start is not None and (kept := _with_signs(g, c, penalty, start, usable, eps)) is not None:
        return kept
    b[~usable] = 0
    target = lambda at, x: 0.5 * x @ g[at[:, None], at] @ x - c[at] @ x + penalty * np.abs(x).sum()
    sign = np.sign(b)
    for _ in range(rounds):
        slope = g @ b - c
        outside = np.where(usable & (b == 0), np.abs(slope) - penalty, -np.inf)
        j = int(np.argmax(outside)) if m else 0
        settled = not np.any(np.abs(slope + penalty * sign)[b != 0] > eps * 10)
        if settled:
            if not m or outside[j] <= eps:
                break
            sign[j] = -np.sign(slope[j])
        for _ in range(m + 10):
            at = np.flatnonzero(sign)
            if not len(at):
                break
            inner = g[at[:, None], at]
            goal = np.linalg.lstsq(inner, c[at] - penalty * sign[at], rcond=1e-13)[0]
            now = b[at]
            if np.array_equal(np.sign(goal), sign[at]):  # nothing crosses zero on the way, the whole step is the best
                b[at] = goal
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                cross = now / (now - goal)
            steps = [1.0, *np.unique(cross[(cross > 0) & (cross < 1)])]
            tried = [now + t * (goal - now) for t in steps]
            for x, t in zip(tried, steps, strict=True):
                if t < 1:
                    x[np.abs(cross - t) < 1e-12] = 0
            best = min(tried, key=lambda x: target(at, x))
            done = best is tried[0] and np.all(np.sign(goal) == sign[at])
            moved = np.abs(best - now).max()
            b[at] = best
            sign = np.sign(b)
            if done or moved <= eps:
                break
        else:
            continue
        if settled and b[j] == 0 and outside[j] <= 1e-7 * max(1.0, penalty):
            break
    else:
        slope = g @ b - c
        gap = np.where(b == 0, np.maximum(np.abs(slope) - penalty, 0), np.abs(slope + penalty * np.sign(b)))[usable]
        if gap.max(initial=0.0) > 1e-4 * max(penalty, float(np.abs(c).max(initial=0.0))):
            warnings.warn(f"lasso stopped after {rounds} rounds, {gap.max():.3g} from optimal", RuntimeWarning, stacklevel=2)
    return b


#: Columns up to which single numbers are faster than arrays.
FEW = 6


def _lasso_of_few(g: list[list[float]], c: list[float], penalty: float, start: list[float], usable: list[bool], eps: float) -> list[float] | None:
    """The lasso by letting columns in as in ``lasso``, None where a sign changes on the way."""
    m = len(c)
    sign = [(v > 0) - (v < 0) for v in start]
    for _ in range(m + 1):
        at = [k for k in range(m) if sign[k]]
        a = [[g[i][j] for j in at] + [c[i] - penalty * sign[i]] for i in at]
        for i, top in enumerate(a):  # elimination; the matrix is positive definite or the case is not for here
            if not top[i] > 1e-10 * g[at[i]][at[i]]:
                return None
            for low in a[i + 1 :]:
                f = low[i] / top[i]
                for j in range(i, len(low)):
                    low[j] -= f * top[j]
        b = [0.0] * m
        for i in range(len(at) - 1, -1, -1):
            b[at[i]] = (a[i][-1] - sum(a[i][j] * b[at[j]] for j in range(i + 1, len(at)))) / a[i][i]
            if b[at[i]] * sign[at[i]] <= 0:
                return None
        slope = [sum(g[i][j] * b[j] for j in at) - c[i] for i in range(m)]
        if any(abs(slope[i] + penalty * sign[i]) > eps for i in at):
            return None
        off = [abs(slope[i]) - penalty if usable[i] and not sign[i] else -1.0 for i in range(m)]
        worst = max(range(m), key=off.__getitem__)
        if off[worst] <= eps:
            return b
        sign[worst] = -1 if slope[worst] > 0 else 1
    return None


def _with_signs(g: np.ndarray, c: np.ndarray, penalty: float, start: np.ndarray, usable: np.ndarray, eps: float) -> np.ndarray | None:
    """The lasso if its coefficients have the signs of ``start``, else None."""
    at = np.flatnonzero(start)
    sign = np.sign(start[at])
    try:
        own = np.linalg.solve(g[at[:, None], at], c[at] - penalty * sign)
    except np.linalg.LinAlgError:
        return None
    if not (own * sign > 0).all():
        return None
    b = np.zeros(len(c))
    b[at] = own
    slope = g @ b - c
    off = np.abs(slope) - penalty
    off[at] = np.abs(slope[at] + penalty * sign)
    return b if (off[usable] <= eps).all() and usable[at].all() else None


def penalties(c: np.ndarray, n: int = 100, ratio: float = 1e-3) -> np.ndarray:
    """From the smallest penalty that selects nothing down to ``ratio`` of it, evenly on a log scale."""
    top = float(np.abs(c).max(initial=0.0))
    return np.geomspace(top, top * ratio, n) if top > 0 else np.zeros(1)


def lasso_path(g: np.ndarray, c: np.ndarray, grid: np.ndarray) -> np.ndarray:
    out, b = [], np.zeros(len(c))
    for p in grid:
        b = lasso(g, c, float(p), b, rounds=300)
        out.append(b)
    return np.array(out)


#: Columns up to which ``lasso_cvs`` follows paths side by side; of more, a table for each path would take too much memory.
SIDE_BY_SIDE = 256
#: Numbers of the matrices of paths that are followed at once, and rows of their steps that are kept in one array.
TABLES, ROWS_KEPT = 1 << 21, 32
#: Columns of problems are filled up to a multiple of this number; numbers of solutions that are checked at once.
WIDTHS, CHECKED = 16, 1 << 15


def lasso_paths(g: np.ndarray, c: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """``lasso_path`` of several problems, stacked in ``g``, ``c`` and ``grid`` (each falling). Coefficients are linear in the
    penalty between the points where a column enters or leaves (Osborne, Presnell and Turlach, 2000), which are followed for
    all problems at once. Every solution is then held against the optimality conditions; ``lasso`` solves those that miss them."""
    if not c.size:
        return np.zeros((*grid.shape, c.shape[1]))
    with np.errstate(all="ignore"):
        out = _followed(g, c, grid)
    useless = np.diagonal(g, axis1=1, axis2=2) <= 1e-14  # never let in
    near = 1e-9 * np.maximum(1e-12, np.abs(c).max(axis=1))
    size = max(1, CHECKED // out[0].size)
    for first in range(0, len(out), size):
        part = slice(first, first + size)
        at = grid[part, :, None]
        bound = np.sign(out[part])
        bound *= at
        gap = out[part] @ g[part]
        gap -= c[part, None]
        gap += bound
        np.abs(gap, out=gap)  # of columns let in, at most the penalty of others
        np.abs(bound, out=bound)
        gap += bound
        if useless[part].any():
            gap = np.where(useless[part, None], 0.0, gap)
        for k, j in np.argwhere(~(gap.max(axis=2) <= grid[part] + near[part, None])).tolist():
            k += first
            own = out[k]
            start = own[j] if np.isfinite(own[j]).all() else own[j - 1] if j else None
            own[j] = lasso(g[k], c[k], float(grid[k, j]), start, rounds=300)
    return out


def _followed(g: np.ndarray, c: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Paths as far as rounding lets them be followed, NaN beyond. ``room`` has for the columns let in how far b is from 0, for the
    others how far y = g b - c is from the penalty and from minus the penalty, ``fall`` how fast that shrinks while the
    penalty falls. With h the inverse of the part of g of the columns let in, one that enters or leaves adds scale * v v' to h.
    Of each v a row is kept, v for the columns let in and g v for the others (which are zero for the others and for those let
    in), so that the next row is one product with them. Where a column has entered, ``aside`` has its g v until it leaves."""
    m, n = c.shape[1], grid.shape[1]
    out, reached = np.empty((*grid.shape, m)), np.zeros(len(c), int)
    usable, least = np.diagonal(g, axis1=1, axis2=2) > 1e-14, 1e-12 * np.diagonal(g, axis1=1, axis2=2)
    sign, fall = np.zeros(c.shape), np.repeat(usable[:, None].astype(float), 2, axis=1)
    turn = fall * [[-1.0], [1.0]]  # what a move takes from ``fall``: the sign of those let in and 0, of the others -1 and 1
    at, done, live, each = np.abs(c * usable).max(axis=1), np.zeros(len(c), int), np.arange(len(c)), np.arange(len(c))
    room = at[:, None, None] - c[:, None] * [[-1.0], [1.0]]
    # all points of all paths in one rising row: twice a path's number and how far the penalty has fallen
    top = np.maximum(at, 1e-300)
    fallen, before = (2 * each[:, None] + np.clip(1 - grid / top[:, None], 0, 1)).ravel(), each * n
    kept: list[np.ndarray] = []
    aside: list[np.ndarray] = []
    scale = np.zeros((len(c), 0))
    rate, least_room, falls = np.empty(room.shape), np.empty(room.shape), np.empty(room.shape, bool)
    for step in range(4 * m + 100):
        np.greater(fall, 1e-9, out=falls)
        np.multiply(fall, falls, out=rate)
        np.maximum(room, 1e-300, out=least_room)
        rate /= least_room
        k = rate.reshape(-1, 2 * m).argmax(axis=1)
        kind, column = np.divmod(k, m)
        length = np.where(rate[each, kind, column] > 0, least_room[each, kind, column] / fall[each, kind, column], np.inf)
        ahead = at - length
        upto = np.maximum(done, fallen.searchsorted(2 * live + np.minimum(1 - ahead / top, 1), side="right") - before)
        rows = np.repeat(each, upto - done)
        if len(rows):
            points = np.arange(len(rows)) - np.repeat(np.cumsum(upto - done) - upto, upto - done)
            to = live[rows]
            own = np.maximum(at[rows] - grid[to, points], 0)[:, None] * fall[rows, 0]  # nothing is let in above the first point
            np.subtract(room[rows, 0], own, out=own)
            own *= sign[rows]
            out[to, points] = own
            reached[to] = points + 1  # the last one of a path counts
            done = upto
        enters = turn[each, 1, column] > 0
        move = g[each, column]
        move *= turn[:, 1] * -enters[:, None].astype(float)
        columns = []
        for first, some in zip(range(0, step, ROWS_KEPT), kept):
            some = some[:, : step - first]
            columns.append(some[each, :, column])
            move += ((scale[:, first : first + some.shape[1]] * columns[-1])[:, None] @ some)[:, 0]
        pivot = move[each, column]
        go = (upto < n) & (np.abs(pivot) > least[each, column] * enters) & ((pivot < 0) == enters)
        going = np.count_nonzero(go)
        if not going:
            break
        if going <= 0.5 * len(go):
            live, g, least, sign, turn, room, fall, at, done, top, before, scale, length, ahead, kind, column, enters, move, pivot = (x[go] for x in (live, g, least, sign, turn, room, fall, at, done, top, before, scale, length, ahead, kind, column, enters, move, pivot))
            kept, aside, columns = ([x[go] for x in some] for some in (kept, aside, columns))
            each, go = np.arange(going), go[go]
            rate, least_room, falls = np.empty(room.shape), np.empty(room.shape), np.empty(room.shape, bool)
        if going < len(go):  # those that are finished stand still
            done, length, ahead, pivot, enters = np.where(go, done, n), np.where(go, length, 0), np.where(go, ahead, 0), np.where(go, pivot, np.inf), enters & go
        letin = (2 * kind - 1.0) * enters
        own = -1 / pivot
        change = np.where(enters, fall[each, 0, column] - 1, -sign[each, column] * fall[each, 0, column])  # how the column itself moves
        change = (change - letin) * own
        room -= np.multiply(length[:, None, None], fall, out=rate)
        fall -= np.multiply(turn, (change[:, None] * move)[:, None], out=rate)
        at = ahead
        place = step % ROWS_KEPT
        if not place:
            kept.append(np.empty((len(live), ROWS_KEPT, m)))
            aside.append(np.zeros((len(live), m, ROWS_KEPT)))
            scale = np.concatenate((scale, np.empty((len(live), ROWS_KEPT))), axis=1)
        kept[-1][:, place], scale[:, step] = move, own
        come, drop = np.flatnonzero(enters), np.flatnonzero(go & ~enters)
        own, now = column[come], letin[come]
        room[come, 0, own], room[come, 1, own], fall[come, 0, own], fall[come, 1, own] = 0, 1, now * change[come], 0
        turn[come, 0, own], turn[come, 1, own], sign[come, own] = now, 0, now
        aside[-1][come, own, place], kept[-1][come, place, own] = pivot[come], -1
        for some, other, values in zip(kept, aside, columns):
            other[come, own, : values.shape[1]], some[come, : values.shape[1], own] = values[come], 0
        if len(drop):
            own = column[drop]
            now = sign[drop, own]
            room[drop, 0, own], room[drop, 1, own] = at[drop] * (1 + now), at[drop] * (1 - now)
            fall[drop, 0, own], fall[drop, 1, own] = 1 + now + change[drop], 1 - now - change[drop]
            turn[drop, 0, own], turn[drop, 1, own], sign[drop, own] = -1, 1, 0
            for some, other, values in zip(kept, aside, columns):
                some[drop, : values.shape[1], own] = other[drop, own, : values.shape[1]]
            kept[-1][drop, place, own] = 1
    for path in np.flatnonzero(reached < n).tolist():
        out[path, reached[path] :] = np.nan
    return out


def lasso_each(problems: Sequence[tuple[np.ndarray, np.ndarray, float]]) -> list[np.ndarray]:
    """``lasso`` of several problems; the paths of those of equal size are followed together as far as their penalties."""
    out: list = [None] * len(problems)
    alike: dict[int, list[int]] = {}
    for k, (_, c, _) in enumerate(problems):
        alike.setdefault(len(c), []).append(k)
    for m, same in alike.items():
        size = max(1, TABLES // (m + 1) ** 2) if FEW < m <= SIDE_BY_SIDE else 0
        for at in range(0, len(same) if size else 0, max(1, size)):
            own = same[at : at + size]
            for k, (b,) in zip(own, _paths([(g, c, np.array([p])) for g, c, p in (problems[k] for k in own)]), strict=True):
                out[k] = lasso(*problems[k], b)
    return [lasso(*problem) if b is None else b for problem, b in zip(problems, out, strict=True)]


def lasso_cv(folds: dict[int, Gram], n_penalties: int = 100) -> tuple[np.ndarray, float, float]:
    """Coefficients, constant and penalty. The penalty has the smallest mean of the folds' mean squared errors (the largest
    such penalty); held-out errors follow from the folds' statistics, without a further pass."""
    return lasso_cvs([folds], n_penalties)[0]


def lasso_cvs(problems: Sequence[dict[int, Gram]], n_penalties: int = 100) -> list[tuple[np.ndarray, float, float]]:
    """``lasso_cv`` of several problems, of which those of about equal size follow their paths together."""
    out: list = [None] * len(problems)
    alike: dict[tuple[int, int], list] = {}
    for k, folds in enumerate(problems):
        whole = total(folds)
        held = [f for f in folds.values() if f.n > 0 and whole.n - f.n > 1]
        if whole.width > SIDE_BY_SIDE:
            out[k] = _in_turn(whole, held, n_penalties)
            continue
        if not np.abs(whole.a[0, 1:-1] * (whole.a[0, -1] / whole.n) - whole.a[1:-1, -1]).max(initial=0.0) > 0:
            g, c, _, mean, y = whole.centred()
            b = lasso(g, c, 0.0)
            out[k] = b, y - mean @ b, 0.0
            continue
        wide = -(-whole.width // WIDTHS) * WIDTHS
        same = alike.setdefault((wide, len(held)), [])
        same.append((k, whole, held))
        if len(same) >= max(1, TABLES // ((wide + 1) ** 2 * (len(held) + 1))):
            _crossed(alike.pop((wide, len(held))), wide, n_penalties, out)
    for (wide, _), same in alike.items():
        _crossed(same, wide, n_penalties, out)
    return out


def _in_turn(whole: Gram, held: list[Gram], n_penalties: int) -> tuple[np.ndarray, float, float]:
    """``lasso_cv`` of many columns: a fold after another, so that one more Gram is held at a time."""
    g, c, _, mean, mean_y = whole.centred()
    grid = penalties(c, n_penalties)
    error = np.zeros(len(grid))
    for f in held:
        gt, ct, _, mt, yt = (whole - f).centred()
        error += [f.sse(b, yt - mt @ b) / f.n for b in lasso_path(gt, ct, grid)]
    best = float(grid[int(np.argmin(error))]) if held else float(grid[0])
    b = lasso(g, c, best, lasso_path(g, c, grid[grid >= best])[-1])
    return b, mean_y - mean @ b, best


def _crossed(problems: list[tuple[int, Gram, list[Gram]]], wide: int, n_penalties: int, out: list) -> None:
    """Puts the results of problems with equally many folds into ``out``. They are filled up to ``wide`` columns with such that are
    of no use. The path of all rows is followed as far as the chosen penalty."""
    folds = len(problems[0][2])
    made = np.empty if all(whole.width == wide for _, whole, _ in problems) else np.zeros
    (g, c), n = (made((len(problems), folds + 1, wide, *more)) for more in ((wide,), ())), np.empty((len(problems), folds))
    # products of the rows left out, less the means of the others, and those with y
    left, y, means = made((len(problems), folds, wide + 1, wide + 1)), made((len(problems), folds, wide + 1)), []
    own = rest = product = np.zeros((0, 0, 0))
    for j, (_, whole, held) in enumerate(problems):
        m = whole.width
        if len(rest) == 0 or rest.shape[1] != m + 2:
            own, rest, product = (np.empty((f, w, w)) for f, w in ((folds, m + 2), (folds + 1, m + 2), (folds + 1, m)))
        for to, f in zip(own, held, strict=True):
            to[:] = f.a
        rest[0] = whole.a
        np.subtract(whole.a, own, out=rest[1:])
        rest /= rest[:, :1, :1].copy()
        mean, inner = rest[:, 0, 1:].copy(), rest[:, 0, 1:-1]
        np.multiply(inner[:, :, None], inner[:, None], out=product)
        np.subtract(rest[:, 1:-1, 1:-1], product, out=g[j, :, :m, :m])
        c[j, :, :m] = rest[:, 1:-1, -1] - inner * mean[:, -1:]
        means.append((mean[0, :-1], mean[0, -1]))
        n[j], shift = own[:, 0, 0], mean[1:]
        sums = own[:, 0, 1:] - 0.5 * n[j, :, None] * shift
        np.matmul(np.stack((sums, shift), axis=2), np.stack((shift, sums), axis=1), out=left[j, :, : m + 1, : m + 1])
        np.subtract(own[:, 1:, 1:], left[j, :, : m + 1, : m + 1], out=left[j, :, : m + 1, : m + 1])
        y[j, :, :m], y[j, :, -1] = left[j, :, :m, m], left[j, :, m, m]
    top = np.maximum(np.abs(c[:, 0]).max(axis=1), 1e-300)
    grid = np.ascontiguousarray(np.geomspace(top, top * 1e-3, n_penalties).T) if n_penalties > 1 else top[:, None]
    paths = lasso_paths(g[:, 1:].reshape(-1, wide, wide), c[:, 1:].reshape(-1, wide), np.repeat(grid, folds, axis=0))
    left, y = left.reshape(-1, wide + 1, wide + 1), y.reshape(-1, wide + 1)
    error = np.empty((len(left), n_penalties))
    size = max(1, CHECKED // max(1, n_penalties * wide))
    for first in range(0, len(left), size):
        part = slice(first, first + size)
        own = paths[part] @ left[part, :-1, :-1]
        own -= 2 * y[part, None, :-1]
        error[part] = np.maximum(0.0, np.einsum("bij,bij->bi", own, paths[part]) + y[part, -1:])  # y'y - 2 b'x'y + b'x'x b
    best = (error.reshape(len(problems), folds, n_penalties) / n[..., None]).sum(axis=1).argmin(axis=1)
    chosen = grid[np.arange(len(grid)), best]
    ends = lasso_paths(np.ascontiguousarray(g[:, 0]), c[:, 0], np.maximum(grid, chosen[:, None]))
    for j, ((k, whole, _), (mean, mean_y)) in enumerate(zip(problems, means, strict=True)):
        m = whole.width
        b = lasso(g[j, 0, :m, :m], c[j, 0, :m], float(chosen[j]), ends[j, best[j], :m])
        out[k] = b, float(mean_y - mean @ b), float(chosen[j])


def _paths(asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    return lasso_paths(*(np.array(x) for x in zip(*asked, strict=True))) if asked else np.zeros((0, 0, 0))


def ols(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The shortest solution where columns depend on each other."""
    if not len(c):
        return np.zeros(0)
    try:
        if (np.linalg.cholesky(g).diagonal() ** 2 > 1e-6 * g.diagonal()).all():
            return np.linalg.solve(g, c)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(g, c, rcond=1e-12)[0]


def ridge(g: np.ndarray, c: np.ndarray, alpha: float, n: float) -> np.ndarray:
    """``alpha`` is on the scale of sums over rows."""
    return np.linalg.solve(g + np.eye(len(c)) * (alpha / n), c) if len(c) else np.zeros(0)


def ridge_cv(folds: dict[int, Gram], alphas: Sequence[float] = (0.001, 0.01, 0.1, 1.0, 10.0)) -> float:
    """The penalty with the smallest held-out error; the first of equal ones."""
    whole = total(folds)
    error = []
    for a in alphas:
        e = 0.0
        for f in folds.values():
            rest = whole - f
            g, c, _, m, y = rest.centred()
            b = ridge(g, c, a, rest.n)
            e += f.sse(b, y - m @ b)
        error.append(e)
    return alphas[int(np.argmin(error))]


def omp(g: np.ndarray, c: np.ndarray, k: int, tol: float = 1e-12) -> np.ndarray:
    """Orthogonal matching pursuit: k times the column most correlated with the residual (first of ties), then all chosen
    ones fitted anew."""
    chosen: list[int] = []
    b = np.zeros(len(c))
    scale = np.sqrt(np.maximum(np.diag(g), 1e-30))
    for _ in range(min(k, len(c))):
        left = np.abs(c - g @ b) / scale
        left[chosen] = -1
        j = int(np.argmax(left))
        if left[j] <= tol:
            break
        chosen.append(j)
        b = np.zeros(len(c))
        b[chosen] = ols(g[np.array(chosen)[:, None], chosen], c[chosen])
    return b


def omp_each(problems: Sequence[tuple[np.ndarray, np.ndarray, int]], tol: float = 1e-12) -> list[np.ndarray]:
    """``omp`` of several problems; those of equal size and number of columns choose side by side."""
    out: list = [None] * len(problems)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (_, c, most) in enumerate(problems):
        alike.setdefault((len(c), min(most, len(c))), []).append(k)
    for (m, most), same in alike.items():
        g, c = (np.array([problems[k][of] for k in same]).reshape(len(same), *shape) for of, shape in ((0, (m, m)), (1, (m,))))
        scale = np.sqrt(np.maximum(np.diagonal(g, axis1=1, axis2=2), 1e-30))
        b, chosen, live = np.zeros(c.shape), np.zeros((len(same), 0), int), np.arange(len(same))
        for _ in range(most):
            left = np.abs(c[live] - (g[live] @ b[live, :, None])[:, :, 0]) / scale[live]
            left[np.arange(len(live))[:, None], chosen] = -1
            j = left.argmax(axis=1)
            go = left[np.arange(len(live)), j] > tol
            live, chosen = live[go], np.column_stack((chosen, j))[go]
            if not len(live):
                break
            b[live[:, None], chosen] = _ols_each(g[live[:, None, None], chosen[:, :, None], chosen[:, None]], c[live[:, None], chosen])
        for k, own in zip(same, b, strict=True):
            out[k] = own
    return out


def _ols_each(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    try:
        if (np.diagonal(np.linalg.cholesky(g), axis1=1, axis2=2) ** 2 > 1e-6 * np.diagonal(g, axis1=1, axis2=2)).all():
            return np.linalg.solve(g, c[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        pass
    return np.array([ols(*own) for own in zip(g, c, strict=True)])


def omp_cv(folds: dict[int, Gram], sizes: Sequence[int] = (1, 2, 3, 5, 7, 10, 15, 20, 30)) -> int:
    """The number of terms with the highest mean held-out R2; the first of equal ones."""
    whole, best = total(folds), (-np.inf, sizes[0])
    for k in sizes:
        if k > whole.width:
            break
        score = []
        for f in folds.values():
            g, c, _, m, y = (whole - f).centred()
            b = omp(g, c, k)
            score.append(1 - f.sse(b, y - m @ b) / max(f.centred()[2] * f.n, 1e-300))
        if np.mean(score) > best[0]:
            best = (float(np.mean(score)), k)
    return best[1]


def stlsq(g: np.ndarray, c: np.ndarray, n: float, threshold: float | None = None, ridge_alpha: float = 0.0, relative: bool = True, least: int = 1, rounds: int = 20, grow: float = 0.0) -> np.ndarray:
    """Sequentially thresholded least squares. Terms under the threshold (by default a tenth of the largest coefficient) go,
    the rest are fitted anew, until nothing changes; the ``least`` largest always stay."""
    active = np.arange(len(c))
    b = np.zeros(len(c))
    fit = lambda at, a: ridge(g[at[:, None], at], c[at], a, n) if a else ols(g[at[:, None], at], c[at])
    own = fit(active, ridge_alpha)
    for t in range(rounds):
        size = np.abs(own)
        bound = (0.1 if threshold is None else threshold) * (size.max(initial=0.0) if relative or threshold is None else 1.0)
        keep = size >= bound
        if keep.sum() < min(least, len(own)):
            keep = np.zeros(len(own), bool)
            keep[np.argsort(-size, kind="stable")[:least]] = True
        if keep.all():
            break
        active = active[keep]
        own = fit(active, ridge_alpha * (1 + grow * (t + 1)))
    b[active] = own
    return b


def stlsq_each(problems: Sequence[tuple[np.ndarray, np.ndarray, float, dict]]) -> list[np.ndarray]:
    """``stlsq`` of several problems with its settings; those of equal size and settings go side by side, all but the columns that
    are left held at 0. What a factor does not solve well is left to ``stlsq``."""
    out: list = [None] * len(problems)
    alike: dict[tuple, list[int]] = {}
    for k, (_, c, _, settings) in enumerate(problems):
        alike.setdefault((len(c), *settings.items()), []).append(k)
    for (m, *settings), same in alike.items():
        own = dict(settings)
        ridge_alpha, least, rounds = own.get("ridge_alpha", 0.0), own.get("least", 1), own.get("rounds", 20)
        threshold, relative, grow = own.get("threshold"), own.get("relative", True), own.get("grow", 0.0)
        g, c = (np.array([problems[k][of] for k in same]).reshape(len(same), *shape) for of, shape in ((0, (m, m)), (1, (m,))))
        n, live, active = np.array([problems[k][2] for k in same]), np.arange(len(same)), np.ones(c.shape, bool)
        alpha, each = ridge_alpha, np.arange(m)
        for t in range(rounds + 1):
            inner = np.where(active[:, :, None] & active[:, None], g, 0)
            inner[:, each, each] += np.where(active, alpha / n[:, None], 1)
            try:
                whole = (np.diagonal(np.linalg.cholesky(inner), axis1=1, axis2=2) ** 2 > 1e-6 * np.diagonal(inner, axis1=1, axis2=2)).all(axis=1)
            except np.linalg.LinAlgError:
                break
            b = np.linalg.solve(inner, (c * active)[:, :, None])[:, :, 0]
            size = np.abs(b)
            bound = (0.1 if threshold is None else threshold) * (size.max(axis=1, keepdims=True, initial=0.0) if relative or threshold is None else 1.0)
            keep = (size >= bound) & active
            few = keep.sum(axis=1) < np.minimum(least, active.sum(axis=1))
            if few.any():
                order = np.argsort(-np.where(active, size, -1.0), axis=1, kind="stable")[:, :least]
                first = np.zeros(keep.shape, bool)
                np.put_along_axis(first, order, True, axis=1)
                keep = np.where(few[:, None], first & active, keep)
            done = whole & ((keep == active).all(axis=1) | (t == rounds))
            for k in np.flatnonzero(done).tolist():
                out[same[live[k]]] = b[k]
            go = whole & ~done
            live, g, c, n, active = live[go], g[go], c[go], n[go], keep[go]
            alpha = ridge_alpha * (1 + grow * (t + 1))
            if not len(live):
                break
    return [stlsq(g, c, n, **settings) if b is None else b for (g, c, n, settings), b in zip(problems, out, strict=True)]


def graphical_lasso(s: np.ndarray, alpha: float, rounds: int = 200, tol: float = 1e-6, like: np.ndarray | None = None) -> np.ndarray:
    """Precision matrix that maximises log det - trace(s x) - alpha * off-diagonal |x|, by block coordinate descent. The regressions
    try the signs of ``like`` first, the precision of a similar matrix."""
    p = len(s)
    if p == 1:
        return 1 / np.maximum(s, 1e-12)
    if p <= FEW + 1:
        return np.array(_graphical_lasso_of_few(s.tolist(), alpha, rounds, tol, None if like is None else like.tolist()))
    w = s.copy()
    w[np.diag_indices(p)] = np.maximum(np.diag(s), 1e-12)
    beta = np.zeros((p, p)) if like is None else -like / like.diagonal()
    rest = [np.delete(np.arange(p), j) for j in range(p)]
    spread = np.abs(s - np.diag(np.diag(s))).mean()
    for _ in range(rounds):
        before = w.copy()
        for j, at in enumerate(rest):
            inner = w[at[:, None], at]
            own = beta[at, j] = lasso(inner, s[at, j], alpha, beta[at, j], rounds=200)
            w[at, j] = w[j, at] = inner @ own
        if np.abs(w - before).mean() < tol * spread + 1e-15:
            break
    out = np.zeros((p, p))
    for j in range(p):
        at = rest[j]
        out[j, j] = 1 / max(w[j, j] - w[at, j] @ beta[at, j], 1e-12)
        out[at, j] = -beta[at, j] * out[j, j]
    return (out + out.T) / 2


def _graphical_lasso_of_few(s: list[list[float]], alpha: float, rounds: int, tol: float, like: list[list[float]] | None) -> list[list[float]]:
    """The same in single numbers."""
    p = len(s)
    w = [[max(v, 1e-12) if i == j else v for j, v in enumerate(row)] for i, row in enumerate(s)]
    rest = [[i for i in range(p) if i != j] for j in range(p)]
    beta = [[0.0 if like is None else -like[i][j] / like[j][j] for i in at] for j, at in enumerate(rest)]
    near = (tol * sum(abs(s[i][j]) for j, at in enumerate(rest) for i in at) / p**2 + 1e-15) * p**2
    for _ in range(rounds):
        before = [row[:] for row in w]
        for j, at in enumerate(rest):
            c = [s[i][j] for i in at]
            top = max(map(abs, c))
            if top <= alpha:
                own = beta[j] = [0.0] * len(at)
                new = own
            else:
                inner = [[w[i][k] for k in at] for i in at]
                own = beta[j] = _lasso_of_few(inner, c, alpha, beta[j], [inner[i][i] > 1e-14 for i in range(len(at))], 1e-10 * max(1e-12, top)) or lasso(np.array(inner), np.array(c), alpha, np.array(beta[j]), rounds=200).tolist()
                new = [sum(v * b for v, b in zip(row, own)) for row in inner]
            for i, v in zip(at, new):
                w[i][j] = w[j][i] = v
        moved = sum(abs(v - u) for row, old in zip(w, before) for v, u in zip(row, old))
        if moved < near:
            break
    out = [[0.0] * p for _ in range(p)]
    for j, at in enumerate(rest):
        out[j][j] = 1 / max(w[j][j] - sum(w[i][j] * b for i, b in zip(at, beta[j])), 1e-12)
        for i, b in zip(at, beta[j]):
            out[i][j] = -b * out[j][j]
    return [[(out[i][j] + out[j][i]) / 2 for j in range(p)] for i in range(p)]


def graphical_lassos(s: np.ndarray, alpha: np.ndarray, rounds: int = 200, tol: float = 1e-6, like: np.ndarray | None = None) -> np.ndarray:
    """``graphical_lasso`` of several matrices, each with its own ``alpha``, side by side."""
    p = s.shape[1]
    if p == 1:
        return 1 / np.maximum(s, 1e-12)
    out, live = np.empty(s.shape), np.arange(len(s))
    rest = np.array([np.delete(np.arange(p), j) for j in range(p)])
    w, every = s.copy(), np.arange(p)
    w[:, every, every] = np.maximum(s[:, every, every], 1e-12)
    start = np.zeros(s.shape) if like is None else -like / like[:, every, every][:, None]
    beta = start[:, rest, every[:, None]]  # of each column, of the others
    size = np.abs(s).sum(axis=(1, 2)) - np.abs(s[:, every, every]).sum(axis=1)
    near = (tol * size / p**2 + 1e-15) * p**2
    right = s[:, rest, every[:, None]]
    for step in range(rounds):
        before = w.copy()
        for j, at in enumerate(rest):
            inner = w[:, at[:, None], at]
            beta[:, j] = lassos(inner, right[:, j], alpha, beta[:, j])
            w[:, at, j] = w[:, j, at] = (inner @ beta[:, j, :, None])[:, :, 0]
        done = np.abs(w - before).sum(axis=(1, 2)) < near if step < rounds - 1 else np.ones(len(w), bool)
        if done.any():
            own = 1 / np.maximum(w[done][:, every, every] - (w[done][:, rest, every[:, None]] * beta[done]).sum(axis=2), 1e-12)
            made = np.zeros((len(own), p, p))
            made[:, every, every], made[:, rest, every[:, None]] = own, -beta[done] * own[:, :, None]
            out[live[done]] = (made + made.transpose(0, 2, 1)) / 2
            live, w, beta, near, right, alpha = (x[~done] for x in (live, w, beta, near, right, alpha))
            if not len(live):
                break
    return out


def lassos(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``lasso`` of several small problems, each with its own penalty. Those whose coefficients have not the signs of ``start``
    let columns in from none as long as no sign changes; what is left then is left to ``lasso``."""
    m = c.shape[1]
    top, each = np.abs(c).max(axis=1, initial=0.0), np.arange(m)
    usable, eps = g[:, each, each] > 1e-14, 1e-10 * np.maximum(1e-12, top)[:, None]
    signs = np.sign(start) * (usable & (top > penalty)[:, None])
    out, good, over, _ = _signed(g, c, penalty, signs, usable)
    live, left = np.flatnonzero(~(good & (over <= eps).all(axis=1))), []
    signs = np.zeros((len(live), m))
    for _ in range(m + 1):
        if not len(live):
            break
        own, good, over, slope = _signed(g[live], c[live], penalty[live], signs, usable[live])
        at = signs != 0
        good &= (~at | (over <= eps[live])).all(axis=1)
        worst = np.where(at, -1.0, over).argmax(axis=1)
        done = good & (over <= eps[live]).all(axis=1)
        out[live[done]] = own[done]
        left += live[~good].tolist()
        more = np.flatnonzero(good & ~done)
        signs[more, worst[more]] = -np.sign(slope[more, worst[more]])
        live, signs = live[more], signs[more]
    for k in [*left, *live.tolist()]:
        out[k] = lasso(g[k], c[k], float(penalty[k]), start[k], rounds=200)
    return out


def _signed(g: np.ndarray, c: np.ndarray, penalty: np.ndarray, signs: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients if they had these signs, whether they have them, by how much each column misses its condition, slopes."""
    at, bound, each = signs != 0, penalty[:, None], np.arange(signs.shape[1])
    m, right = len(each), bound * signs
    a = np.empty((m, m + 1, len(c)))  # elimination of all at once; columns without a sign are 0
    a[:, :m] = np.where(at[:, :, None] & at[:, None], g, 0).transpose(1, 2, 0)
    a[each, each] += ~at.T
    a[:, m] = (c * at - right).T
    with np.errstate(all="ignore"):
        for k in range(m):
            a[k, k + 1 :] /= a[k, k]
            for low in range(k + 1, m):
                a[low, k + 1 :] -= a[low, k] * a[k, k + 1 :]
        for k in range(m - 1, 0, -1):
            a[:k, m] -= a[:k, k] * a[k, m]
    b = np.ascontiguousarray(a[:, m].T)
    slope = (g @ b[:, :, None])[:, :, 0] - c
    over = np.where(usable, np.abs(slope + right) - bound * ~at, -1.0)
    return b, ((b * signs > 0) == at).all(axis=1), over, slope


def theory_sigma(g: np.ndarray, c: np.ndarray, var_y: float, n: float) -> float:
    """Noise level: root mean square residual of least squares on the most correlated columns."""
    k = int(max(1, min(n // 2, len(c) // 4, 10)))
    top = np.argsort(-np.abs(c), kind="stable")[:k]
    b = ols(g[top[:, None], top], c[top])
    return float(np.sqrt(max(var_y - c[top] @ b, 0.0)))


def theory_penalty(sigma: float, n: float, p: int) -> float:
    return float(np.clip(0.5 * sigma * np.sqrt(2 * np.log(max(p, 2)) / n), 1e-4, 10))
