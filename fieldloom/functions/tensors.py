"""Complex numbers and small matrices of columns: site-local algebra without UDFs.

Every operation builds column expressions in Python, so that Catalyst sees plain
arithmetic and whole-stage code generation compiles it.  Constant parts stay Python
numbers until the end, which keeps sparse constant matrices (spin algebra) sparse.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Number = int | float
Part = Column | Number


def _constant(x: Part) -> bool:
    return not isinstance(x, Column)


def _add(a: Part, b: Part) -> Part:
    if _constant(a) and a == 0:
        return b
    if _constant(b) and b == 0:
        return a
    return a + b


def _mul(a: Part, b: Part) -> Part:
    for x, y in ((a, b), (b, a)):
        if _constant(x):
            if x == 0:
                return 0.0
            if x == 1:
                return y
            if x == -1:
                return -y
    return a * b


def column(x: Part) -> Column:
    return F.lit(float(x)) if _constant(x) else x


def quotient(x: Part, d: Column) -> Column:
    """x / d for d that is not negative, by the rules of floats: nothing fails where d is zero."""
    return F.when(d == 0, column(x) * F.lit(float("inf"))).otherwise(column(x) / d)


def log(x: Column) -> Column:
    """The natural logarithm by the rules of floats: minus infinity at zero, not a number below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


class C:
    """A complex number of two real parts, columns or constants."""

    __slots__ = ("re", "im")

    def __init__(self, re: Part, im: Part = 0.0):
        self.re, self.im = re, im

    @staticmethod
    def of(z: C | complex | Number) -> C:
        return z if isinstance(z, C) else C(float(np.real(z)), float(np.imag(z)))

    def __add__(self, o) -> C:
        o = C.of(o)
        return C(_add(self.re, o.re), _add(self.im, o.im))

    def __neg__(self) -> C:
        return C(_mul(-1, self.re), _mul(-1, self.im))

    def __sub__(self, o) -> C:
        return self + (-C.of(o))

    def __mul__(self, o) -> C:
        o = C.of(o)
        return C(_add(_mul(self.re, o.re), _mul(-1, _mul(self.im, o.im))), _add(_mul(self.re, o.im), _mul(self.im, o.re)))

    __radd__, __rmul__ = __add__, __mul__

    def scale(self, x: Part) -> C:
        return C(_mul(self.re, x), _mul(self.im, x))

    def over(self, o: C) -> C:
        """Quotient by a complex number."""
        n = self * o.conj()
        d = column(o.norm2())
        return C(quotient(n.re, d), quotient(n.im, d))

    def conj(self) -> C:
        return C(self.re, _mul(-1, self.im))

    def times_i(self) -> C:
        return C(_mul(-1, self.im), self.re)

    def times_minus_i(self) -> C:
        return C(self.im, _mul(-1, self.re))

    def norm2(self) -> Part:
        return _add(_mul(self.re, self.re), _mul(self.im, self.im))

    # The transcendental functions act on the real part alone, as on vector words of the
    # array library whose results this one matches; the exponential is the complex one.
    def real_map(self, f: Callable[[Column], Column]) -> C:
        return C(f(column(self.re)), 0.0)

    def exp(self) -> C:
        size = F.exp(column(self.re))
        return C(size * F.cos(column(self.im)), size * F.sin(column(self.im)))


class Tensor:
    """A matrix of complex numbers; a scalar is 1 x 1 and a vector n x 1."""

    def __init__(self, items: Sequence[C], shape: tuple[int, int] = (1, 1)):
        self.items, self.shape = list(items), shape
        assert len(self.items) == shape[0] * shape[1]

    @staticmethod
    def constant(m) -> Tensor:
        m = np.atleast_2d(np.asarray(m, dtype=complex))
        return Tensor([C.of(z) for z in m.ravel()], m.shape)

    @staticmethod
    def build(shape: tuple[int, int], f: Callable[[int, int], C]) -> Tensor:
        return Tensor([f(i, j) for i in range(shape[0]) for j in range(shape[1])], shape)

    def __getitem__(self, at: tuple[int, int]) -> C:
        return self.items[at[0] * self.shape[1] + at[1]]

    def map(self, f: Callable[[C], C]) -> Tensor:
        return Tensor([f(x) for x in self.items], self.shape)

    def __add__(self, o: Tensor) -> Tensor:
        """A sum; a scalar is added to a square matrix's diagonal only, from either side."""
        if self.shape == o.shape:
            return Tensor([a + b for a, b in zip(self.items, o.items, strict=True)], self.shape)
        if self.shape == (1, 1):
            return o + self
        assert o.shape == (1, 1) and self.shape[0] == self.shape[1]
        return Tensor.build(self.shape, lambda i, j: self[i, j] + o[0, 0] if i == j else self[i, j])

    def __neg__(self) -> Tensor:
        return self.map(lambda x: -x)

    def __sub__(self, o: Tensor) -> Tensor:
        return self + (-o)

    def __mul__(self, o: Tensor | C | complex | Number) -> Tensor:
        """Matrix product; a scalar multiplies every element."""
        if not isinstance(o, Tensor):
            return self.map(lambda x: x * C.of(o))
        if o.shape == (1, 1):
            return self.map(lambda x: x * o[0, 0])
        if self.shape == (1, 1):
            return o.map(lambda x: self[0, 0] * x)
        assert self.shape[1] == o.shape[0]

        def cell(i: int, j: int) -> C:
            total = C(0.0)
            for k in range(self.shape[1]):
                total = total + self[i, k] * o[k, j]
            return total

        return Tensor.build((self.shape[0], o.shape[1]), cell)

    def __truediv__(self, o: Tensor) -> Tensor:
        """Division by a scalar tensor."""
        return self.map(lambda x: x.over(o[0, 0]))

    def scale(self, x: Part) -> Tensor:
        return self.map(lambda c: c.scale(x))

    def transpose(self) -> Tensor:
        return Tensor.build(self.shape[::-1], lambda i, j: self[j, i])

    def conj(self) -> Tensor:
        return self.map(C.conj)

    def adj(self) -> Tensor:
        return self.transpose().conj()

    def trace(self) -> Tensor:
        total = C(0.0)
        for k in range(self.shape[0]):
            total = total + self[k, k]
        return Tensor([total])

    def trace_product(self, o: Tensor) -> Tensor:
        """tr(A B) without forming A B."""
        total = C(0.0)
        for i in range(self.shape[0]):
            for k in range(self.shape[1]):
                total = total + self[i, k] * o[k, i]
        return Tensor([total])

    def ta(self) -> Tensor:
        """Traceless antihermitian part: (A - A†)/2 less its trace over N."""
        half = (self - self.adj()).scale(0.5)
        n = self.shape[0]
        mean = half.trace()[0, 0].scale(1.0 / n)
        return Tensor.build(self.shape, lambda i, j: half[i, j] - mean if i == j else half[i, j])

    def sp_ta(self) -> Tensor:
        """The antihermitian traceless part kept in the algebra of Sp(2n): half of Ta plus its Omega image."""
        n = self.shape[0] // 2
        t = self.ta()
        omega = np.block([[np.zeros((n, n)), np.eye(n)], [-np.eye(n), np.zeros((n, n))]])
        image = Tensor.constant(omega) * t.transpose() * Tensor.constant(omega)
        return (t + image).scale(0.5)

    def poke(self, i: int, j: int, value: C) -> Tensor:
        """The tensor with one component replaced."""
        return Tensor.build(self.shape, lambda r, c: value if (r, c) == (i, j) else self[r, c])

    def row(self, i: int) -> Tensor:
        return Tensor([self[i, j] for j in range(self.shape[1])], (1, self.shape[1]))

    def column(self, j: int) -> Tensor:
        return Tensor([self[i, j] for i in range(self.shape[0])], (self.shape[0], 1))

    def with_row(self, i: int, o: Tensor) -> Tensor:
        return Tensor.build(self.shape, lambda r, c: o.items[c] if r == i else self[r, c])

    def with_column(self, j: int, o: Tensor) -> Tensor:
        return Tensor.build(self.shape, lambda r, c: o.items[r] if c == j else self[r, c])

    def equals(self, o: Tensor) -> Column:
        """Whether all components are equal."""
        out = F.lit(self.shape == o.shape)
        for a, b in zip(self.items, o.items, strict=False):
            out = out & (column(a.re) == column(b.re)) & (column(a.im) == column(b.im))
        return out

    def real(self) -> Tensor:
        return self.map(lambda c: C(c.re, 0.0))

    def imag(self) -> Tensor:
        """The imaginary parts, as real numbers."""
        return self.map(lambda c: C(c.im, 0.0))

    def inner(self, o: Tensor) -> C:
        """Sum over components of conj(a) b."""
        total = C(0.0)
        for a, b in zip(self.items, o.items, strict=True):
            total = total + a.conj() * b
        return total

    def norm2(self) -> Column:
        return column(self.inner(self).re)

    def outer(self, o: Tensor) -> Tensor:
        """Matrix of a_i conj(b_j)."""
        return Tensor.build((len(self.items), len(o.items)), lambda i, j: self.items[i] * o.items[j].conj())

    def minor(self, i: int, j: int) -> Tensor:
        n = self.shape[0]
        return Tensor([self[r, c] for r in range(n) for c in range(n) if r != i and c != j], (n - 1, n - 1))

    def det(self) -> C:
        if self.shape == (1, 1):
            return self[0, 0]
        total = C(0.0)
        for j in range(self.shape[1]):
            term = self[0, j] * self.minor(0, j).det()
            total = total + (term if j % 2 == 0 else -term)
        return total

    def inverse(self) -> Tensor:
        """By cofactors; meant for up to 3 x 3."""
        if self.shape == (1, 1):
            return Tensor([C(1.0).over(self[0, 0])])
        d = self.det()
        return Tensor.build(self.shape, lambda i, j: (self.minor(j, i).det() if (i + j) % 2 == 0 else -self.minor(j, i).det()).over(d))

    def project_unitary(self) -> Tensor:
        """Rows made orthonormal one after another (Gram-Schmidt)."""
        rows: list[list[C]] = []
        for i in range(self.shape[0]):
            row = [self[i, j] for j in range(self.shape[1])]
            for done in rows:
                along = _dot(done, row)
                row = [x - along * y for x, y in zip(row, done, strict=True)]
            size = F.sqrt(column(_dot(row, row).re))
            rows.append([C(quotient(x.re, size), quotient(x.im, size)) for x in row])
        return Tensor([x for row in rows for x in row], self.shape)


def _dot(a: list[C], b: list[C]) -> C:
    total = C(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + x.conj() * y
    return total


def reconstruct_row(two_rows: Tensor) -> Tensor:
    """Third row of a special unitary 3 x 3 matrix: conj(row 0 x row 1)."""
    a, b = ([two_rows[r, k] for k in range(3)] for r in (0, 1))
    third = [(a[(k + 1) % 3] * b[(k + 2) % 3] - a[(k + 2) % 3] * b[(k + 1) % 3]).conj() for k in range(3)]
    return Tensor([*a, *b, *third], (3, 3))


def trace_index(m: Tensor, outer: int, inner: int, keep_outer: bool) -> Tensor:
    """Partial trace of an (outer*inner)² matrix over the other factor."""
    if keep_outer:
        return Tensor.build((outer, outer), lambda i, j: _total(m[i * inner + k, j * inner + k] for k in range(inner)))
    return Tensor.build((inner, inner), lambda i, j: _total(m[k * inner + i, k * inner + j] for k in range(outer)))


def transpose_index(m: Tensor, outer: int, inner: int, of_outer: bool) -> Tensor:
    """Partial transpose of one factor of an (outer*inner)² matrix."""

    def cell(r: int, c: int) -> C:
        (i, a), (j, b) = divmod(r, inner), divmod(c, inner)
        return m[j * inner + a, i * inner + b] if of_outer else m[i * inner + b, j * inner + a]

    return Tensor.build(m.shape, cell)


def _total(xs) -> C:
    out = C(0.0)
    for x in xs:
        out = out + x
    return out


def mult(a: Tensor, b: Tensor) -> Tensor:
    return a * b


def mac(acc: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """acc + a b."""
    return acc + a * b


def axpby(a: Part, x: Tensor, b: Part, y: Tensor) -> Tensor:
    return x.scale(a) + y.scale(b)


def to_complex(x: Part) -> Tensor:
    """A real number as a complex scalar with a zero imaginary part."""
    return Tensor([C(x)])


def to_real(t: Tensor) -> Part:
    """The real part of a scalar, as a column."""
    return column(t[0, 0].re)


def project_on_sp(m: Tensor) -> Tensor:
    """A 2n x 2n matrix projected to Sp(2n): its first n rows made orthonormal, the others their Omega images.

    Row i is made orthogonal to the rows before it and to their images, conj(row) Omega.
    """
    n = m.shape[0] // 2

    def image(row: list[C]) -> list[C]:
        return [-(x.conj()) for x in row[n:]] + [x.conj() for x in row[:n]]

    top: list[list[C]] = []
    for i in range(n):
        row = [m[i, j] for j in range(2 * n)]
        for done in [r for t in top for r in (t, image(t))]:
            along = _dot(done, row)
            row = [x - along * y for x, y in zip(row, done, strict=True)]
        size = F.sqrt(column(_dot(row, row).re))
        top.append([C(quotient(x.re, size), quotient(x.im, size)) for x in row])
    return Tensor([x for row in [*top, *map(image, top)] for x in row], m.shape)
