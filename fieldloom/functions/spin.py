"""Spin algebra: the sixteen products of four gamma matrices in the chiral basis, and projectors.

The four matrices are fixed values; everything else follows from them by products.
"""

from __future__ import annotations

import numpy as np

from fieldloom.functions.tensors import Tensor

#: gamma_x, gamma_y, gamma_z, gamma_t in the chiral basis.
GAMMA = tuple(
    np.array(m, dtype=complex)
    for m in (
        [[0, 0, 0, 1j], [0, 0, 1j, 0], [0, -1j, 0, 0], [-1j, 0, 0, 0]],
        [[0, 0, 0, -1], [0, 0, 1, 0], [0, 1, 0, 0], [-1, 0, 0, 0]],
        [[0, 0, 1j, 0], [0, 0, 0, -1j], [-1j, 0, 0, 0], [0, 1j, 0, 0]],
        [[0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0], [0, 1, 0, 0]],
    )
)
GAMMA5 = GAMMA[0] @ GAMMA[1] @ GAMMA[2] @ GAMMA[3]
NAMES = {"X": GAMMA[0], "Y": GAMMA[1], "Z": GAMMA[2], "T": GAMMA[3], "5": GAMMA5}


def gamma(name: str, sign: int = 1) -> np.ndarray:
    """A named product, e.g. "X", "5", "XT" (half the commutator: sigma) or "X5"; "I" is the identity."""
    if name == "I":
        return sign * np.eye(4, dtype=complex)
    if name.startswith("Sigma"):
        a, b = (NAMES[c] for c in name[5:])
        return sign * (a @ b - b @ a) / 2
    out = np.eye(4, dtype=complex)
    for c in name:
        out = out @ NAMES[c]
    return sign * out


def all_gammas() -> dict[str, np.ndarray]:
    """The 32 elements of the algebra: sixteen products and their negatives."""
    names = ["I", "5", "X", "Y", "Z", "T", "X5", "Y5", "Z5", "T5", "SigmaXY", "SigmaXZ", "SigmaXT", "SigmaYZ", "SigmaYT", "SigmaZT"]
    return {s + n: gamma(n, k) for n in names for s, k in (("", 1), ("Minus", -1))}


def times(m: np.ndarray, psi: Tensor) -> Tensor:
    """A constant spin matrix on a spinor of 4 x Nc components; zeros cost nothing."""
    return Tensor.constant(m) * psi


def projector(mu: int, sign: int) -> np.ndarray:
    """1 + sign gamma_mu; mu = 4 is gamma 5."""
    return np.eye(4, dtype=complex) + sign * (GAMMA5 if mu == 4 else GAMMA[mu])


#: The flavour matrices sigma_1, sigma_2, sigma_3.
PAULI = tuple(np.array(m, dtype=complex) for m in ([[0, 1], [1, 0]], [[0, -1j], [1j, 0]], [[1, 0], [0, -1]]))


def peek_spin(psi: Tensor, s: int) -> Tensor:
    """The color vector of one spin component of a 4 x Nc spinor."""
    return psi.row(s)


def poke_spin(psi: Tensor, s: int, colors: Tensor) -> Tensor:
    return psi.with_row(s, colors)


def peek_color(psi: Tensor, c: int) -> Tensor:
    """The spin vector of one color component."""
    return psi.column(c)


def poke_color(psi: Tensor, c: int, spins: Tensor) -> Tensor:
    return psi.with_column(c, spins)


def half_spinor(mu: int, sign: int, psi: Tensor) -> Tensor:
    """The upper two rows of (1 + sign gamma_mu) psi: all that the projection holds."""
    full = times(projector(mu, sign), psi)
    return Tensor(full.items[: 2 * psi.shape[1]], (2, psi.shape[1]))


def full_spinor(mu: int, sign: int, half: Tensor) -> Tensor:
    """The projected spinor of a half: its lower rows are combinations of the upper ones."""
    p = projector(mu, sign)
    lower = np.linalg.lstsq(p[:2].T, p[2:].T, rcond=None)[0].T
    return Tensor([*half.items, *times(np.round(lower, 12), half).items], (4, half.shape[1]))
