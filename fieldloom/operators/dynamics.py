"""Molecular dynamics of links on packed blocks: actions with their forces, and nested integrators.

Links are the fields ``u0``, ``u1``, ...; ``p`` holds the momenta of all directions, traceless
antihermitian matrices (d, N, N), and the energy is the action less tr p^2.  Moving a link along
an antihermitian A, U -> exp(A) U, changes an action by Re tr(A F); F is what its stencil
gives.  A force takes one exchange and one table: links and momenta are brought up to date
in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np

from fieldloom.operators.halo import dagger, halves, inner, wilson
from fieldloom.operators.krylov import ca_gmres
from fieldloom.operators.linear import unit
from fieldloom.plans.blocks import Arrays, Blocks, Shape, Site, Stencil

#: A move: links by their momenta over a time, or momenta by the force of some actions where links are shifted along it.
Drift = float
Kick = tuple[tuple["Action", ...], float, float]

#: Per step, a kick as (weight, shift in squares of the step) and a drift as its weight.
SCHEMES: dict[str, tuple] = {
    "leapfrog": ((1 / 2, 0.0), 1.0, (1 / 2, 0.0)),
    "minimum_norm": ((0.1931833275037836, 0.0), 0.5, (0.6136333449924328, 0.0), 0.5, (0.1931833275037836, 0.0)),
    "force_gradient": ((1 / 6, 0.0), 0.5, (2 / 3, 1 / 24), 0.5, (1 / 6, 0.0)),
}


def traceless(f: np.ndarray) -> np.ndarray:
    """Traceless antihermitian part; for one color the antihermitian part."""
    a, n = (f - dagger(f)) / 2, f.shape[-1]
    return a if n == 1 else a - np.trace(a, axis1=-2, axis2=-1)[..., None, None] * np.eye(n) / n


def exponential(a: np.ndarray) -> np.ndarray:
    """exp of antihermitian matrices."""
    w, v = np.linalg.eigh(-1j * a)
    return (v * np.exp(1j * w)[..., None, :]) @ dagger(v)


class Action(Protocol):
    """stencil(links, out) gives the force ``out``, (d, N, N), and the energy of a block ``#s``, from links and what prepare adds."""

    def prepare(self, b: Blocks, links: Sequence[str]) -> Blocks | None: ...

    def stencil(self, links: Sequence[str], out: str) -> Stencil: ...


@dataclass(frozen=True)
class Plaquettes:
    """beta times the sum over plaquettes of 1 - Re tr P / N."""

    d: int
    colors: int
    beta: float

    def prepare(self, b: Blocks, links: Sequence[str]) -> None:
        return None

    def stencil(self, links: Sequence[str], out: str) -> Stencil:
        d, n, beta, links = self.d, self.colors, self.beta, tuple(links)
        pairs = [(mu, nu) for mu in range(d) for nu in range(d) if mu != nu]
        corner = {(mu, nu): tuple(a - b for a, b in zip(unit(d, mu), unit(d, nu), strict=True)) for mu, nu in pairs}
        wanted = [w for mu, nu in pairs for w in ((links[nu], unit(d, mu)), (links[nu], unit(d, nu, -1)), (links[mu], unit(d, nu, -1)), (links[nu], corner[mu, nu]))]

        def after(x: Arrays, seen, site: Site) -> Arrays:
            around: list = [0.0] * d
            for mu, nu in pairs:
                up = seen[links[nu], unit(d, mu)] @ dagger(seen[links[mu], unit(d, nu)]) @ dagger(x[links[nu]])
                down = dagger(seen[links[nu], corner[mu, nu]]) @ dagger(seen[links[mu], unit(d, nu, -1)]) @ seen[links[nu], unit(d, nu, -1)]
                around[mu] = around[mu] + x[links[mu]] @ (up + down)
            loops = np.stack(around, axis=2)
            # Each plaquette is met from its four links.
            met = np.trace(loops, axis1=-2, axis2=-1).real.sum((1, 2)) / (4 * n)
            return {out: -beta / n * loops, "#s": beta * (site.geometry.sites * d * (d - 1) / 2 - met)}

        return Stencil(links, {u: Shape((n, n)) for u in links}, tuple(dict.fromkeys(wanted)), lambda x, site: {u: x[u] for u in links}, after, {out: Shape((d, n, n)), "#s": Shape()})


@dataclass(frozen=True)
class TwoFlavours:
    """phi† (M† M)^-1 phi for the Wilson operator M; ``fields`` holds the pseudofermion ``phi``.

    With Y = M†^-1 phi and X = M^-1 Y, each solved with few exchanges, the energy is |Y|^2
    and the force an outer product of X and Y at the ends of a link; only half spinors move.
    """

    d: int
    colors: int
    mass: float
    fields: Blocks
    tol: float = 1e-8

    def prepare(self, b: Blocks, links: Sequence[str]) -> Blocks:
        d, n, mass, links = self.d, self.colors, self.mass, tuple(links)
        here = b.keep(*links).join(self.fields.keep("phi")).cut()
        y = ca_gmres(lambda s, o: wilson(d, links, s, o, n, mass, dag=True), here, "phi", tol=self.tol, x="Y")
        both = here.join(y.blocks).keep("Y", *links).cut()
        x = ca_gmres(lambda s, o: wilson(d, links, s, o, n, mass), both, "Y", tol=self.tol, x="X")
        if not (x.converged and y.converged):
            raise ArithmeticError("a solve of the pseudofermion force has not converged")
        made = both.keep("Y").join(x.blocks).keep("X", "Y").cut()
        for gone in (here, both):
            gone.drop()
        return made

    def stencil(self, links: Sequence[str], out: str) -> Stencil:
        d, n, links = self.d, self.colors, tuple(links)
        half, spinor = Shape((2, n)), ("X", "Y")
        sign = {"X": -1, "Y": 1}

        def before(x: Arrays, site: Site) -> Arrays:
            return {f"{f}{mu}": halves(mu, sign[f])[1] @ x[f] for f in spinor for mu in range(d)}

        def after(x: Arrays, seen, site: Site) -> Arrays:
            total = []
            for mu, u in enumerate(links):
                turn = np.swapaxes(x[u], -1, -2)
                fore = seen[f"X{mu}", unit(d, mu)] @ turn
                back = seen[f"Y{mu}", unit(d, mu)] @ turn
                own = {f: dagger(halves(mu, sign[f])[0]) for f in spinor}
                total.append(np.swapaxes(fore, -1, -2) @ np.conj(own["X"] @ x["Y"]) - np.swapaxes(own["Y"] @ x["X"], -1, -2) @ np.conj(back))
            return {out: np.stack(total, axis=2), "#s": inner(x["Y"], x["Y"]).real}

        return Stencil((*links, *spinor), {f"{f}{mu}": half for f in spinor for mu in range(d)}, tuple((f"{f}{mu}", unit(d, mu)) for f in spinor for mu in range(d)), before, after, {out: Shape((d, n, n)), "#s": Shape()})


@dataclass(frozen=True)
class Level:
    """Actions whose forces act at this level, steps it takes for each drift of the level above, and the scheme of a step."""

    actions: tuple[Action, ...]
    steps: int
    scheme: str = "force_gradient"


def moves(levels: Sequence[Level], time: float) -> list[Drift | Kick]:
    """All drifts and kicks over a time; a drift of one level is a trajectory of the next.

    Kicks that meet, or that meet once drifts are done, are taken together.
    """
    if not levels:
        return [time]
    first, rest, h = levels[0], levels[1:], time / levels[0].steps
    out: list = []
    for _ in range(first.steps):
        for part in SCHEMES[first.scheme]:
            for move in moves(rest, part * h) if isinstance(part, float) else [(first.actions, part[0] * h, part[1] * h * h)]:
                last = out[-1] if out else None
                if isinstance(move, tuple) and isinstance(last, tuple) and move[0] == last[0] and move[2] == last[2] == 0.0:
                    out[-1] = (move[0], last[1] + move[1], 0.0)
                else:
                    out.append(move)
    return out


def _links(b: Blocks) -> list[str]:
    return [f"u{mu}" for mu in range(b.shapes["p"].dims[0])]


def _moved(x: Arrays, links: Sequence[str], pending: Sequence[tuple[str, float]]) -> Arrays:
    """Links and momenta after drifts, and kicks by the force f that is there."""
    x = dict(x)
    for kind, by in pending:
        if kind == "kick":
            x["p"] = x["p"] + 0.5 * by * traceless(x["f"])
        else:
            for mu, u in enumerate(links):
                x[u] = exponential(by * x["p"][:, :, mu]) @ x[u]
    return x


def _force(b: Blocks, actions: Sequence[Action], pending: Sequence[tuple[str, float]], shift: float) -> Blocks:
    """b brought up to date, with the sum of the actions' forces in ``f``, at links shifted along the force that was there."""
    links, shape = _links(b), b.shapes["p"]
    kept = {n: b.shapes[n] for n in (*links, "p", "f")}
    ends = [f"v{mu}" for mu in range(len(links))]
    for k, action in enumerate(actions):
        more = [] if k == 0 else ["g"]

        def ready(x: Arrays, pending=tuple(pending if k == 0 else ())) -> Arrays:
            x = _moved(x, links, pending)
            return x | {v: exponential(0.5 * shift * traceless(x["f"][:, :, mu])) @ x[u] if shift else x[u] for mu, (u, v) in enumerate(zip(links, ends, strict=True))}

        old = b
        if isinstance(action, Plaquettes):
            here, get = b, ready
        else:
            names = kept | {v: b.shapes[u] for u, v in zip(links, ends, strict=True)}
            b = b.local(lambda x, site, ready=ready: {n: ready(x)[n] for n in names}, tuple(kept), names).keep(*names, *more).cut()
            solved = action.prepare(b, ends)
            here, get = (b if solved is None else b.join(solved)), lambda x: x
        s = action.stencil(ends, "_f")

        def after(x: Arrays, seen, site: Site, s=s, get=get, more=more) -> Arrays:
            x = get(x)
            g = s.after(x, seen, site)["_f"]
            return {n: x[n] for n in kept} | {"g": x["g"] + g if more else g}

        reads = tuple(dict.fromkeys([*kept, *more, *[n for n in s.reads if get is not ready or n not in ends]]))
        b = here.stencil(replace(s, reads=reads, before=lambda x, site, s=s, get=get: s.before(get(x), site), after=after, results=kept | {"g": shape})).keep(*kept, "g").cut()
        old.drop()
    return b.keep(*links, "p", "g").rename(f="g")


def evolve(b: Blocks, levels: Sequence[Level], time: float) -> Blocks:
    """Links and momenta after a time by the nested schemes of the levels, the slowest forces first."""
    links = _links(b)
    state = b.keep(*links, "p").local(lambda x, site: {"f": 0 * x["p"]}, ("p",), {"f": b.shapes["p"]}).keep(*links, "p", "f").cut()
    pending: list[tuple[str, float]] = []
    for move in moves(levels, time):
        if not isinstance(move, tuple):
            pending.append(("drift", move))
            continue
        actions, by, shift = move
        state, pending = _force(state, actions, pending, 0.0), []
        if shift:
            state = _force(state, actions, [], shift)
        pending = [("kick", by)]
    both = {n: state.shapes[n] for n in (*links, "p")}
    return state.local(lambda x, site, pending=tuple(pending): {n: _moved(x, links, pending)[n] for n in both}, (*links, "p", "f"), both).keep(*links, "p").cut()


def hamiltonian(b: Blocks, actions: Sequence[Action]) -> float:
    """The actions less the trace of the squared momenta."""
    links = _links(b)
    total = b.local(lambda x, site: {"#k": -np.trace(x["p"] @ x["p"], axis1=-2, axis2=-1).real.sum((1, 2))}, ("p",), {"#k": Shape()}).sums("#k")[0]
    for action in actions:
        more = action.prepare(b, links)
        here = b if more is None else b.join(more)
        total += here.stencil(action.stencil(links, "_f")).sums("#s")[0]
    return total


def reversed_momenta(b: Blocks) -> Blocks:
    return b.local(lambda x, site: {"p": -x["p"]}, ("p",), {"p": b.shapes["p"]}).cut()


def pseudofermion(b: Blocks, links: Sequence[str], eta: str, mass: float, out: str = "phi") -> Blocks:
    """phi = M† eta, which for a gaussian eta is distributed as the action of two flavours asks."""
    d, n = len(links), b.shapes[eta].dims[-1]
    return b.stencil(wilson(d, tuple(links), eta, out, n, mass, dag=True)).keep(out).cut()
