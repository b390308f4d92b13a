"""Gauge observables from ordered products of links along paths.

A path is a list of steps; step mu > = 0 goes one site forward in direction mu and step
-mu - 1 one site back.  All links that a set of paths needs are gathered in one shuffle,
and each product is a chain of staged matrix multiplications in columns.
"""

from __future__ import annotations

import operator
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.tensors import C, Tensor, column
from fieldloom.plans.lattice import Lattice

Path = tuple[int, ...]


def back(mu: int) -> int:
    return -mu - 1


def link(mu: int) -> str:
    return f"u{mu}"


def _walk(path: Path, start: tuple[int, ...]) -> list[tuple[int, tuple[int, ...], bool]]:
    """(direction, place of the link, adjoint) of each step."""
    at, out = list(start), []
    for s in path:
        mu = s if s >= 0 else -s - 1
        if s < 0:
            at[mu] -= 1
        out.append((mu, tuple(at), s < 0))
        if s >= 0:
            at[mu] += 1
    return out


def products(lat: Lattice, paths: dict[str, tuple[Path, tuple[int, ...]]]) -> Lattice:
    """lat with one field a path (its steps, its start relative to the site): the ordered product of links."""
    walks = {n: _walk(p, s) for n, (p, s) in paths.items()}
    got, names = lat.gather([(link(mu), at) for w in walks.values() for mu, at, _ in w])

    def step(now: Lattice, mu: int, at: tuple[int, ...], adjoint: bool) -> Tensor:
        u = now.t(names[(link(mu), at)])
        return u.adj() if adjoint else u

    for k in range(max(len(w) for w in walks.values())):
        # One projection a step: each product is a column before it is used again.
        got = got.put(**{n: (step(got, *w[0]) if k == 0 else got.t(n) * step(got, *w[k])) for n, w in walks.items() if k < len(w)})
    return got.keep(*lat.shapes, *paths)


def zero(lat: Lattice, **moved: int) -> tuple[int, ...]:
    return (0,) * len(lat.grid.dims)


def plaquette_path(mu: int, nu: int) -> Path:
    return (mu, nu, back(mu), back(nu))


def loop_path(r1: int, r2: int, mu: int, nu: int) -> Path:
    """A rectangle of r1 steps in mu and r2 in nu."""
    return (mu,) * r1 + (nu,) * r2 + (back(mu),) * r1 + (back(nu),) * r2


def plaquettes(lat: Lattice, pairs: list[tuple[int, int]] | None = None) -> Lattice:
    """Real traces of the plaquettes of all direction pairs as fields p{mu}{nu}."""
    pairs = pairs or list(combinations(range(len(lat.grid.dims)), 2))
    return products(lat, {f"p{a}{b}": (plaquette_path(a, b), zero(lat)) for a, b in pairs})


def _real_trace(lat: Lattice, names: list[str]):
    total = F.lit(0.0)
    for n in names:
        total = total + column(lat.t(n).trace()[0, 0].re)
    return total


def loop_averages(lat: Lattice, **loops: tuple[int, int]) -> DataFrame:
    """Real traces of R1 x R2 loops over sites and direction pairs, per color, all in one pass.

    For each name the columns name_total and name_average; pairs are ordered where R1 and
    R2 differ.
    """
    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    of = {n: [(a, b) for a in range(d) for b in range(d) if a != b] if r[0] != r[1] else list(combinations(range(d), 2)) for n, r in loops.items()}
    paths = {f"{n}{a}{b}": (loop_path(*loops[n], a, b), zero(lat)) for n, pairs in of.items() for a, b in pairs}
    got = products(lat, paths)
    out = []
    for n, pairs in of.items():
        s = F.sum(_real_trace(got, [f"{n}{a}{b}" for a, b in pairs]))
        out += [s.alias(f"{n}_total"), (s / (lat.grid.volume * len(pairs) * nc)).alias(f"{n}_average")]
    return got.df.agg(*out)


def average_loop(lat: Lattice, r1: int, r2: int) -> DataFrame:
    """One loop of loop_averages: rows (total, average)."""
    return loop_averages(lat, w=(r1, r2)).select(F.col("w_total").alias("total"), F.col("w_average").alias("average"))


def average_plaquette(lat: Lattice) -> DataFrame:
    return average_loop(lat, 1, 1)


def plaquette_by_slice(lat: Lattice, time: int) -> DataFrame:
    """Sum of spatial plaquettes a time slice."""
    space = [k for k in range(len(lat.grid.dims)) if k != time]
    pairs = list(combinations(space, 2))
    p = plaquettes(lat, pairs)
    return p.df.groupBy(F.col(f"x{time}").alias("t")).agg(F.sum(_real_trace(p, [f"p{a}{b}" for a, b in pairs])).alias("plaquette"))


def link_trace(lat: Lattice) -> DataFrame:
    """Average real trace of the links over sites, directions and colors."""
    d, nc = len(lat.grid.dims), lat.shapes[link(0)][0]
    return lat.df.agg((F.sum(_real_trace(lat, [link(mu) for mu in range(d)])) / (lat.grid.volume * d * nc)).alias("link_trace"))


def staple_paths(mu: int, nu: int, d: int) -> dict[str, tuple[Path, tuple[int, ...]]]:
    """Upper and lower staple of a link: from its end back to its start."""
    end = tuple(int(k == mu) for k in range(d))
    return {f"up{nu}": ((nu, back(mu), back(nu)), end), f"down{nu}": ((back(nu), back(mu), nu), end)}


def _all_staples(mu: int, d: int) -> dict[str, tuple[Path, tuple[int, ...]]]:
    return {n: p for nu in range(d) if nu != mu for n, p in staple_paths(mu, nu, d).items()}


def _all_rectangles(mu: int, d: int) -> dict[str, tuple[Path, tuple[int, ...]]]:
    """The staples of 2 x 1 rectangles through a link, three to each side of it in each plane."""
    end = tuple(int(k == mu) for k in range(d))
    paths = {}
    for nu in (k for k in range(d) if k != mu):
        for s, t in ((nu, back(nu)), (back(nu), nu)):
            tag = f"{nu}{'u' if s >= 0 else 'd'}"
            paths |= {
                f"r{tag}a": ((mu, s, back(mu), back(mu), t), end),
                f"r{tag}b": ((s, back(mu), back(mu), t, mu), end),
                f"r{tag}c": ((s, s, back(mu), t, t), end),
            }
    return paths


def _summed(lat: Lattice, **sums: dict[str, tuple[Path, tuple[int, ...]]]) -> Lattice:
    """Sums of path products as fields, all paths in one call of ``products``."""
    got = products(lat, {n: p for paths in sums.values() for n, p in paths.items()})
    totals = {out: reduce(operator.add, [got.t(n) for n in paths]) for out, paths in sums.items()}
    return got.put(**totals).keep(*dict.fromkeys([*lat.shapes, *sums]))


def staple(lat: Lattice, mu: int, out: str = "staple") -> Lattice:
    """Sum of all staples of the links in direction mu."""
    return _summed(lat, **{out: _all_staples(mu, len(lat.grid.dims))})


def staples(lat: Lattice, dims: list[int], prefix: str = "__s") -> Lattice:
    """The sums of all staples of several directions, their links gathered at once."""
    d = len(lat.grid.dims)
    return _summed(lat, **{f"{prefix}{mu}": {f"{n}_{mu}": p for n, p in _all_staples(mu, d).items()} for mu in dims})


def rectangle_staple(lat: Lattice, mu: int, out: str = "rect_staple") -> Lattice:
    """Sum of all staples of 2 x 1 rectangles through the links in direction mu."""
    return _summed(lat, **{out: _all_rectangles(mu, len(lat.grid.dims))})


def clover(lat: Lattice, mu: int, nu: int, out: str = "f") -> Lattice:
    """Field strength F_mu,nu: an eighth of the four leaves less their adjoint."""
    z = zero(lat)
    leaves = {
        "l0": ((mu, nu, back(mu), back(nu)), z), "l1": ((nu, back(mu), back(nu), mu), z),
        "l2": ((back(mu), back(nu), mu, nu), z), "l3": ((back(nu), mu, nu, back(mu)), z),
    }
    got = products(lat, leaves)
    q = got.t("l0") + got.t("l1") + got.t("l2") + got.t("l3")
    return got.put(**{out: (q - q.adj()).scale(0.125)}).keep(*lat.shapes, out)


def topological_charge(lat: Lattice) -> DataFrame:
    """8/(32 pi^2) sum tr(B.E) from the clover field strengths of a four-dimensional lattice, by time slice."""
    got = lat
    for a, b in combinations(range(4), 2):
        got = clover(got, a, b, f"f{a}{b}")
    density = F.lit(0.0)
    for (a, b), (c, d), sign in (((1, 2), (0, 3), 1.0), ((0, 2), (1, 3), -1.0), ((0, 1), (2, 3), 1.0)):
        density = density + sign * column(got.t(f"f{a}{b}").trace_product(got.t(f"f{c}{d}"))[0, 0].re)
    return got.df.groupBy(F.col("x3").alias("t")).agg((F.sum(density) * (8.0 / (32.0 * 3.141592653589793**2))).alias("charge"))


def polyakov_loop(lat: Lattice, mu: int) -> DataFrame:
    """Trace of the product of links all the way along mu, over all sites, per color and site.

    Products of 2, 4, 8, ... links are formed by doubling: a shuffle for each doubling, not each step.
    """
    n, nc = lat.grid.dims[mu], lat.shapes[link(mu)][0]
    d = len(lat.grid.dims)
    work = lat.keep(link(mu)).rename(link(mu), "power")
    work = work.put(line=Tensor.constant([[float(i == j) for j in range(nc)] for i in range(nc)]))
    done, size = 0, 1
    while done < n:
        if (n // size) % 2:  # the line so far, then the next ``size`` links
            ahead = tuple(done * int(k == mu) for k in range(d))
            work, names = work.gather([("power", ahead)])
            work = work.put(line=work.t("line") * work.t(names[("power", ahead)])).keep("line", "power")
            done += size
        if done < n:
            ahead = tuple(size * int(k == mu) for k in range(d))
            work, names = work.gather([("power", ahead)])
            work = work.put(power=work.t("power") * work.t(names[("power", ahead)])).keep("line", "power").cut()
            size *= 2
    tr = work.t("line").trace()[0, 0]
    return work.df.agg((F.sum(column(tr.re)) / (nc * lat.grid.volume)).alias("re"), (F.sum(column(tr.im)) / (nc * lat.grid.volume)).alias("im"))


def gauge_transform(lat: Lattice, g: str) -> Lattice:
    """U_mu(x) becomes g(x) U_mu(x) g†(x + mu)."""
    d = len(lat.grid.dims)
    ahead = [tuple(int(k == mu) for k in range(d)) for mu in range(d)]
    got, names = lat.gather([(g, a) for a in ahead])
    return got.put(**{link(mu): got.t(g) * got.t(link(mu)) * got.t(names[(g, ahead[mu])]).adj() for mu in range(d)}).keep(*lat.shapes)


def project_unitary(lat: Lattice, name: str, out: str) -> Lattice:
    """Rows made orthonormal one after another, a projection a step so that expressions stay small."""
    n, work = lat.shapes[name][0], lat
    m = lat.t(name)
    if n == 1:
        return lat.put(**{out: m.project_unitary()})
    work = work.put(**{f"__r{i}": Tensor([m[i, j] for j in range(n)], (1, n)) for i in range(n)})
    for i in range(n):
        for k in range(i):
            work = work.put(__c=Tensor([work.t(f"__r{k}").inner(work.t(f"__r{i}"))]))
            work = work.put(**{f"__r{i}": work.t(f"__r{i}") - work.t(f"__r{k}") * work.t("__c")})
        work = work.put(__s=Tensor([C(F.pow(work.t(f"__r{i}").norm2(), -0.5))]))
        work = work.put(**{f"__r{i}": work.t(f"__r{i}").scale(F.col("__s_0_re"))})
    return work.put(**{out: Tensor([x for i in range(n) for x in work.t(f"__r{i}").items], (n, n))}).keep(*dict.fromkeys([*lat.shapes, out]))


def covariant_shift(lat: Lattice, f: str, mu: int, forward: bool = True, out: str = "cs") -> Lattice:
    """U_mu(x) f(x + mu), or U_mu†(x - mu) f(x - mu)."""
    step = tuple((1 if forward else -1) * int(k == mu) for k in range(len(lat.grid.dims)))
    got, names = lat.gather([(f, step)] + ([] if forward else [(link(mu), step)]))
    u = got.t(link(mu)) if forward else got.t(names[(link(mu), step)]).adj()
    return got.put(**{out: u * got.t(names[(f, step)])}).keep(*lat.shapes, out)


def wilson_action(lat: Lattice, beta: float) -> DataFrame:
    """beta (1 - plaquette) d(d-1)/2 V."""
    d = len(lat.grid.dims)
    return average_plaquette(lat).select((beta * (1.0 - F.col("average")) * (d * (d - 1) / 2) * lat.grid.volume).alias("action"))


def rectangle_action(lat: Lattice, beta: float, c1: float) -> DataFrame:
    """Plaquettes with weight 1 - 8 c1 and rectangles with c1 (c1 = -0.331 Iwasaki, -1/12 Symanzik, -1.4088 DBW2)."""
    d = len(lat.grid.dims)
    got = loop_averages(lat, p=(1, 1), r=(2, 1))
    plaq = (1 - 8 * c1) * (1 - F.col("p_average")) * (d * (d - 1) / 2)
    return got.select((beta * lat.grid.volume * (plaq + c1 * (1 - F.col("r_average")) * (d * (d - 1)))).alias("action"))


def shift_identity_backward(lat: Lattice, mu: int, out: str = "cs") -> Lattice:
    """U_mu†(x - mu): the backward covariant shift of the identity."""
    step = tuple(-int(k == mu) for k in range(len(lat.grid.dims)))
    got, names = lat.gather([(link(mu), step)])
    return got.put(**{out: got.t(names[(link(mu), step)]).adj()}).keep(*lat.shapes, out)


def shift_staple(lat: Lattice, name: str, mu: int, out: str = "shifted") -> Lattice:
    """A staple, born at the site, as it is at the site ahead in mu."""
    step = tuple(int(k == mu) for k in range(len(lat.grid.dims)))
    got, names = lat.gather([(name, step)])
    return got.put(**{out: got.t(names[(name, step)])}).keep(*lat.shapes, out)


def staple_and_rectangle(lat: Lattice, mu: int, out: str = "staple", out_rectangle: str = "rect_staple") -> Lattice:
    """Plaquette and rectangle staples of a direction; their paths share displaced links and one call of ``products``."""
    d = len(lat.grid.dims)
    return _summed(lat, **{out: _all_staples(mu, d), out_rectangle: _all_rectangles(mu, d)})


def clover_leaf(lat: Lattice, mu: int, nu: int, m: int, n: int, out: str = "f") -> Lattice:
    """Field strength of m x n leaves (and n x m ones where they differ), per unit area."""
    z = zero(lat)
    leaves = {}
    for tag, (a, b) in {f"{m}{n}": (m, n), f"{n}{m}": (n, m)}.items():
        f, g, p, q = (mu,) * a, (nu,) * b, (back(mu),) * a, (back(nu),) * b
        leaves |= {f"l{tag}0": (f + g + p + q, z), f"l{tag}1": (g + p + q + f, z), f"l{tag}2": (p + q + f + g, z), f"l{tag}3": (q + f + g + p, z)}
    got = products(lat, leaves)
    total = None
    for name in leaves:
        total = got.t(name) if total is None else total + got.t(name)
    return got.put(**{out: (total - total.adj()).scale(0.5 / (len(leaves) * m * n))}).keep(*lat.shapes, out)


#: Coefficient of rectangles in the named improved actions.
NAMED_ACTIONS = {"iwasaki": -0.331, "symanzik": -1.0 / 12.0, "dbw2": -1.4088}


def named_action(lat: Lattice, name: str, beta: float) -> DataFrame:
    return rectangle_action(lat, beta, NAMED_ACTIONS[name])


def long_links(lat: Lattice, steps: int = 3) -> Lattice:
    """Products of ``steps`` links straight ahead, as fields w0, w1, ..."""
    return products(lat, {f"w{mu}": ((mu,) * steps, zero(lat)) for mu in range(len(lat.grid.dims))})
