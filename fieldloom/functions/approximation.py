"""Rational and polynomial approximations, computed on the driver; only coefficients reach Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def jackson(order: int) -> np.ndarray:
    """Damping factors that keep a truncated Chebyshev series from ringing."""
    n = order + 1.0
    k = np.arange(order)
    return ((n - k) * np.cos(np.pi * k / n) + np.sin(np.pi * k / n) / np.tan(np.pi / n)) / n


def remez(function: Callable[[np.ndarray], np.ndarray], low: float, high: float, degree: int, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Best polynomial on [low, high] by exchange of extrema: Chebyshev coefficients and the largest error."""
    x = 0.5 * (low + high) - 0.5 * (high - low) * np.cos(np.pi * np.arange(degree + 2) / (degree + 1))
    grid = 0.5 * (low + high) - 0.5 * (high - low) * np.cos(np.pi * np.linspace(0, 1, 200 * (degree + 2)))
    to_unit = lambda z: (2 * z - low - high) / (high - low)
    for _ in range(rounds):
        system = np.column_stack([np.polynomial.chebyshev.chebvander(to_unit(x), degree), (-1.0) ** np.arange(degree + 2)])
        solved = np.linalg.solve(system, function(x))
        error = function(grid) - np.polynomial.chebyshev.chebval(to_unit(grid), solved[:-1])
        pieces = np.split(np.arange(len(grid)), np.flatnonzero(np.diff(np.sign(error)) != 0) + 1)
        extrema = np.array([p[np.abs(error[p]).argmax()] for p in pieces])
        if len(extrema) < degree + 2 or np.abs(error).max() <= abs(solved[-1]) * (1 + 1e-6):
            break
        while len(extrema) > degree + 2:
            extrema = extrema[1:] if abs(error[extrema[0]]) < abs(error[extrema[-1]]) else extrema[:-1]
        x = grid[extrema]
    return solved[:-1], float(np.abs(error).max())


def power_by_poles(power: float, low: float, high: float, poles: int) -> tuple[float, np.ndarray, np.ndarray]:
    """x^power (-1 < power < 0) as norm + sum residue_k / (x + shift_k) on [low, high].

    The integral of t^power / (x + t) over t is summed by the trapezoid rule in log t,
    whose error falls exponentially; the range follows from the accuracy the step allows.
    """
    a, b = np.log(low), np.log(high)
    reach = np.sqrt(2 * np.pi**2 * poles / (min(-power, 1 + power)) / 4 + ((b - a) / 2) ** 2)
    t = np.linspace((a + b) / 2 - reach, (a + b) / 2 + reach, poles)
    weight = -np.sin(np.pi * power) / np.pi * (t[1] - t[0])
    return 0.0, weight * np.exp(t * (power + 1)), np.exp(t)


def _agm(k: float) -> float:
    """Complete elliptic integral K of modulus k."""
    a, b = 1.0, np.sqrt(1 - k * k)
    while abs(a - b) > 1e-15 * a:
        a, b = (a + b) / 2, np.sqrt(a * b)
    return np.pi / (2 * a)


def _sn(u: float, k: float) -> float:
    """Jacobi sn by descending Landen steps."""
    if k < 1e-9:
        return np.sin(u)
    k1 = (1 - np.sqrt(1 - k * k)) / (1 + np.sqrt(1 - k * k))
    s = _sn(u / (1 + k1), k1)
    return (1 + k1) * s / (1 + k1 * s * s)


def zolotarev_inverse_sqrt(low: float, high: float, poles: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Best 1/sqrt(x) on [low, high] as d prod (x + c_2l) / prod (x + c_2l-1): scale, zeros' and poles' shifts."""
    kappa = np.sqrt(1 - low / high)
    big = _agm(kappa)
    c = np.array([(s := _sn(j * big / (2 * poles), kappa) ** 2) / (1 - s) * low for j in range(1, 2 * poles)])
    odd, even = c[0::2], c[1::2]
    x = np.exp(np.linspace(np.log(low), np.log(high), 4000))
    f = np.array([np.prod(z + even) / np.prod(z + odd) * np.sqrt(z) for z in x])
    return float(2.0 / (f.max() + f.min())), even, odd


def partial_fractions(scale: float, zeros: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Residues r_k of scale prod (x + z) / prod (x + p) = sum r_k / (x + p_k), with fewer zeros than poles."""
    return np.array([scale * np.prod(zeros - p) / np.prod(np.delete(poles, k) - p) for k, p in enumerate(poles)])
