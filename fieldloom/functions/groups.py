"""Group tables by rule: generators of SU(N) and Sp(2N), SU(2) subgroups, higher representations."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from fieldloom.functions.tensors import C, Tensor


def su_generators(n: int) -> list[np.ndarray]:
    """Hermitian, traceless, tr(T_a T_b) = delta / 2: symmetric, antisymmetric and diagonal ones."""
    out = []
    for i, j in combinations(range(n), 2):
        s, a = np.zeros((n, n), complex), np.zeros((n, n), complex)
        s[i, j] = s[j, i] = 0.5
        a[i, j], a[j, i] = -0.5j, 0.5j
        out += [s, a]
    for k in range(1, n):
        d = np.diag([1.0] * k + [-float(k)] + [0.0] * (n - k - 1)).astype(complex)
        out.append(d / np.sqrt(2.0 * k * (k + 1)))
    return out


def omega(n: int) -> np.ndarray:
    """The symplectic form of Sp(2n)."""
    return np.block([[np.zeros((n, n)), np.eye(n)], [-np.eye(n), np.zeros((n, n))]])


def sp_generators(n: int) -> list[np.ndarray]:
    """The n (2n + 1) generators of Sp(2n) with tr(T_a T_b) = delta / 2.

    They are the hermitian matrices T with Omega T^T Omega = T, built from pairs of blocks.
    """
    out = []
    for g in [np.eye(n, dtype=complex) / np.sqrt(2 * n), *su_generators(n)]:
        block = np.block([[g, np.zeros((n, n))], [np.zeros((n, n)), -g.T]])
        out.append(block)
    for i in range(n):
        for j in range(i, n):
            for z in (1.0, 1j):
                b = np.zeros((n, n), complex)
                b[i, j] = b[j, i] = z
                out.append(np.block([[np.zeros((n, n)), b], [b.conj().T, np.zeros((n, n))]]))
    return [t / np.sqrt(2 * np.trace(t @ t).real) for t in out]


def su2_subgroups(n: int) -> list[tuple[int, int]]:
    return list(combinations(range(n), 2))


def su2_extract(m: Tensor, pair: tuple[int, int]) -> tuple[C, C]:
    """The (a, b) of the matrix [[a, b], [-b*, a*]] nearest to the 2 x 2 part of a matrix, unnormalised."""
    i, j = pair
    a, b = m[i, i] + m[j, j].conj(), m[i, j] - m[j, i].conj()
    return a.scale(0.5), b.scale(0.5)


def su2_insert(a: C, b: C, pair: tuple[int, int], n: int) -> Tensor:
    i, j = pair
    cells = {(i, i): a, (i, j): b, (j, i): -(b.conj()), (j, j): a.conj()}
    return Tensor.build((n, n), lambda r, c: cells.get((r, c), C(1.0 if r == c else 0.0)))


def adjoint_representation(u: Tensor, n: int) -> Tensor:
    """2 tr(T_a U T_b U†), a real matrix of n^2 - 1 rows."""
    t = [Tensor.constant(x) for x in su_generators(n)]
    turned = [u * x * u.adj() for x in t]
    return Tensor.build((len(t), len(t)), lambda a, b: C(t[a].trace_product(turned[b])[0, 0].scale(2.0).re))


def two_index_basis(n: int, symmetric: bool) -> list[np.ndarray]:
    """Orthonormal symmetric or antisymmetric n x n matrices."""
    out = []
    for i, j in combinations(range(n), 2):
        m = np.zeros((n, n))
        m[i, j], m[j, i] = 2.0**-0.5, 2.0**-0.5 if symmetric else -(2.0**-0.5)
        out.append(m)
    if symmetric:
        out += [np.diag((np.arange(n) == k).astype(float)) for k in range(n)]
    return out


def two_index_representation(u: Tensor, n: int, symmetric: bool) -> Tensor:
    """tr(e_a† U e_b U^T)."""
    e = [Tensor.constant(x) for x in two_index_basis(n, symmetric)]
    turned = [u * x * u.transpose() for x in e]
    return Tensor.build((len(e), len(e)), lambda a, b: e[a].adj().trace_product(turned[b])[0, 0])


def project_on_algebra(m: Tensor, n: int) -> Tensor:
    """Coefficients -2 i tr(T_a A) of an antihermitian matrix A = i sum c_a T_a."""
    t = [Tensor.constant(x) for x in su_generators(n)]
    return Tensor([x.trace_product(m)[0, 0].times_minus_i().scale(2.0) for x in t], (len(t), 1))


def from_algebra(c: Tensor, n: int) -> Tensor:
    """i sum c_a T_a."""
    total = None
    for k, x in enumerate(su_generators(n)):
        term = Tensor.constant(1j * x) * c.items[k]
        total = term if total is None else total + term
    return total
