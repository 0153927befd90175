"""Vector algebra over array<double> columns, as native expressions: no Python in any of them.

Binary functions raise on a length mismatch, since zip_with would pad with nulls. Null vectors give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-7  # inside the logarithm of the cross-entropy
F32_EPSILON = 1.1920929e-07


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def _same(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))


def of_width(a: Column, width: int) -> Column:
    """a, which raises where its length is another."""
    return F.when(F.size(a) == width, a).when(a.isNotNull(), F.raise_error(F.lit(f"a vector has not {width} entries")).cast("array<double>"))


def _alike(arrays: Sequence[Column], out: Column) -> Column:
    """out, which raises where the arrays differ in length; null where one is null."""
    same, present = F.lit(True), F.lit(True)
    for a in arrays:
        same, present = same & (F.size(a) == F.size(arrays[0])), present & a.isNotNull()
    return F.when(present & same, out).when(present, F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))


def bind(value: Column, use) -> Column:
    """use(value), the value worked out once a row; inside a lambda it would be worked out for every entry."""
    return F.element_at(F.transform(F.array(value), use), 1)


def double(a: Column | str) -> Column:
    return col(a).cast("array<double>")


def fill(size: int, value: float = 0.0) -> Column:
    """A constant vector; ``mat_create``, ``mat_clear`` and ``mat_fill`` all give a new column."""
    return F.array_repeat(F.lit(float(value)), size)


def copy(a: Column | str, into: Column | str) -> Column:
    """The entries of a in place of those of ``into``; raises where their lengths differ."""
    a, into = double(a), double(into)
    return _same(a, into, a)


def scale(a: Column | str, s: float) -> Column:
    return F.transform(double(a), lambda x: x * F.lit(float(s)))


def total(a: Column | str) -> Column:
    return F.aggregate(double(a), F.lit(0.0), lambda s, x: s + x)


def add(a: Column | str, b: Column | str) -> Column:
    a, b = double(a), double(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column | str, b: Column | str) -> Column:
    a, b = double(a), double(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = double(a), double(b)
    return F.aggregate(_same(a, b, F.zip_with(a, b, lambda x, y: x * y)), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    a, b = double(a), double(b)
    return F.aggregate(_same(a, b, F.zip_with(a, b, lambda x, y: (x - y) * (x - y))), F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column | str) -> Column:
    """Position of the first largest entry; 0 if empty. A NaN at the front stays, a later one never wins."""
    a = double(a)
    clean = F.transform(a, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    return F.when(a.isNull(), None).when(F.size(a) == 0, 0).when(F.isnan(F.get(a, F.lit(0))), 0).otherwise(F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def argmin(a: Column | str) -> Column:
    a = double(a)
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def relu(a: Column | str) -> Column:
    """The larger of 0 and each entry; NaN gives 0."""
    return F.transform(double(a), lambda x: F.when(~F.isnan(x) & (x > 0), x).otherwise(F.lit(0.0)))


def softmax(a: Column | str) -> Column:
    """Shifted by the largest entry; work is linear in the width. An empty vector, or a sum of 0, gives null."""
    shifted = bind(double(a), lambda v: bind(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    shares = bind(shifted, lambda e: bind(F.aggregate(e, F.lit(0.0), lambda t, x: t + x), lambda s: F.when((F.size(e) > 0) & (s != 0), F.transform(e, lambda x: x / s))))
    return shares


def cross_entropy(p: Column | str, q: Column | str) -> Column:
    """Elementwise: 0 where p is 0, else -p ln(q + 1e-7)."""
    p, q = double(p), double(q)
    return _same(p, q, F.zip_with(p, q, lambda x, y: F.when(x == 0, F.lit(0.0)).otherwise(-x * F.log(y + EPSILON))))


def relu_grad(out: Column | str, a: Column | str, grad: Column | str) -> Column:
    """out + grad where a > 0."""
    out, a, grad = double(out), double(a), double(grad)
    z = F.arrays_zip(out.alias("o"), a.alias("a"), grad.alias("g"))
    return _alike([out, a, grad], F.transform(z, lambda t: t["o"] + F.when(~F.isnan(t["a"]) & (t["a"] > 0), t["g"]).otherwise(F.lit(0.0))))


def softmax_grad(out: Column | str, grad: Column | str) -> Column:
    """out + grad: the gradient passes through, as it is only used behind a cross-entropy."""
    return add(out, grad)


def cross_entropy_grad_q(out: Column | str, p: Column | str, q: Column | str, grad: Column | str) -> Column:
    """out + (q - p) grad."""
    out, p, q, grad = double(out), double(p), double(q), double(grad)
    z = F.arrays_zip(out.alias("o"), p.alias("p"), q.alias("q"), grad.alias("g"))
    return _alike([out, p, q, grad], F.transform(z, lambda t: t["o"] + (t["q"] - t["p"]) * t["g"]))


def cross_entropy_grad_p(out: Column | str, q: Column | str, grad: Column | str) -> Column:
    """out - ln(q + 1e-7) grad."""
    out, q, grad = double(out), double(q), double(grad)
    z = F.arrays_zip(out.alias("o"), q.alias("q"), grad.alias("g"))
    return _alike([out, q, grad], F.transform(z, lambda t: t["o"] - F.log(t["q"] + EPSILON) * t["g"]))


def sigmoid(s: Column | str) -> Column:
    """In two branches, so that neither overflows."""
    s = col(s)
    return F.when(s >= 0, 1 / (1 + F.exp(-s))).otherwise(F.exp(s) / (1 + F.exp(s)))


def affine(features: Column | str, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """features . W + b; weights: one row per feature, one column per output."""
    x = double(features)
    columns = list(zip(*weights))
    return F.array(*[dot(x, vector(w)) + F.lit(float(b)) for w, b in zip(columns, bias)])


def one_hot(label: Column | str, classes: int) -> Column:
    """1 at the truncated label; all 0 for null, NaN and labels out of range."""
    k = F.expr(f"sequence(0, {classes - 1})")
    x = col(label).cast("double")
    at = F.when(x.isNotNull() & ~F.isnan(x) & (x > -1) & (x < classes), F.when(x >= 0, F.floor(x)).otherwise(-1)).otherwise(-1)
    return F.transform(k, lambda c: (c == at).cast("double"))


def smaller(a: Column | str, b: Column | str) -> Column:
    return F.least(col(a), col(b))


def larger(a: Column | str, b: Column | str) -> Column:
    return F.greatest(col(a), col(b))


def kib(n: Column | str) -> Column:
    return F.shiftleft(col(n).cast("long"), 10)


def mib(n: Column | str) -> Column:
    return F.shiftleft(col(n).cast("long"), 20)


def gib(n: Column | str) -> Column:
    return F.shiftleft(col(n).cast("long"), 30)


def align_up(n: Column | str, p: Column | int) -> Column:
    """The next multiple of p, a power of two."""
    n, p = col(n).cast("long"), (F.lit(p) if isinstance(p, int) else p).cast("long")
    return (n + p - 1).bitwiseAND(F.bitwise_not(p - 1))


def is_power_of_two(n: Column | str) -> Column:
    n = col(n).cast("long")
    return (n != 0) & (n.bitwiseAND(n - 1) == 0)


def grey_code(v: Column | str) -> Column:
    """Terminal colour of a pixel in [0, 1]: 232 is black."""
    return (F.lit(232) + F.floor(col(v) * 23)).cast("int")
