"""Scalar formulas as expression graphs.

A formula is written once with ordinary operators over ``Ex`` nodes, or over ``Dual`` numbers to get its gradient along. ``Program``
lays it out as projections in which every shared subexpression is a named column, so that Catalyst neither repeats it nor
meets a tree too large for one generated method. The same text is valid in other SQL engines.

Doubles throughout. A divisor of zero gives NULL, never an error or an infinity.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame

_KNOWN: dict[tuple, Ex] = {}


class Ex:
    """A node: a template and its operands. Equal nodes are one object."""

    __slots__ = ("form", "kids", "value")

    def __new__(cls, form: str, *kids: Ex, value: float | None = None):
        key = (form, *map(id, kids))
        if (found := _KNOWN.get(key)) is None:
            found = _KNOWN[key] = super().__new__(cls)
            found.form, found.kids, found.value = form, kids, value
        return found

    def __add__(self, o):
        o = ex(o)
        if isinstance(o, Dual):
            return o + self
        if self.value is not None and o.value is not None:
            return num(self.value + o.value)
        return o if self.value == 0 else self if o.value == 0 else Ex("({} + {})", self, o)

    def __neg__(self):
        return num(-self.value) if self.value is not None else Ex("(-{})", self)

    def __sub__(self, o):
        o = ex(o)
        if isinstance(o, Dual):
            return -o + self
        if self.value is not None and o.value is not None:
            return num(self.value - o.value)
        return self if o.value == 0 else -o if self.value == 0 else Ex("({} - {})", self, o)

    def __mul__(self, o):
        o = ex(o)
        if isinstance(o, Dual):
            return o * self
        if self.value is not None and o.value is not None:
            return num(self.value * o.value)
        if self.value == 0 or o.value == 0:
            return num(0)
        return o if self.value == 1 else self if o.value == 1 else Ex("({} * {})", self, o)

    def __truediv__(self, o):
        o = ex(o)
        if isinstance(o, Dual):
            return Dual(self, (num(0),) * len(o.d)) / o
        if o.value is not None and o.value != 0:
            return self * num(1 / o.value) if self.value is None else num(self.value / o.value)
        return num(0) if self.value == 0 else Ex("({} / nullif({}, 0e0))", self, o)

    def __radd__(self, o):
        return ex(o) + self

    def __rsub__(self, o):
        return ex(o) - self

    def __rmul__(self, o):
        return ex(o) * self

    def __rtruediv__(self, o):
        return ex(o) / self

    def __lt__(self, o):
        return Ex("({} < {})", self, plain(o))

    def __le__(self, o):
        return Ex("({} <= {})", self, plain(o))

    def __gt__(self, o):
        return Ex("({} > {})", self, plain(o))

    def __ge__(self, o):
        return Ex("({} >= {})", self, plain(o))

    def __and__(self, o):
        return Ex("({} AND {})", self, o)

    def __or__(self, o):
        return Ex("({} OR {})", self, o)

    def __invert__(self):
        return Ex("(NOT {})", self)


class Dual:
    """A value with its derivatives along some directions; comparisons are of values."""

    __slots__ = ("v", "d")

    def __init__(self, v: Ex, d: tuple[Ex, ...]):
        self.v, self.d = v, d

    def _of(self, o) -> Dual:
        return o if isinstance(o, Dual) else Dual(ex(o), (num(0),) * len(self.d))

    def __add__(self, o):
        o = self._of(o)
        return Dual(self.v + o.v, tuple(a + b for a, b in zip(self.d, o.d, strict=True)))

    def __neg__(self):
        return Dual(-self.v, tuple(-a for a in self.d))

    def __sub__(self, o):
        return self + (-self._of(o))

    def __mul__(self, o):
        o = self._of(o)
        return Dual(self.v * o.v, tuple(a * o.v + self.v * b for a, b in zip(self.d, o.d, strict=True)))

    def __truediv__(self, o):
        o = self._of(o)
        q = self.v / o.v
        return Dual(q, tuple((a - q * b) / o.v for a, b in zip(self.d, o.d, strict=True)))

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, o):
        return self._of(o) - self

    def __rtruediv__(self, o):
        return self._of(o) / self

    def __lt__(self, o):
        return self.v < o

    def __le__(self, o):
        return self.v <= o

    def __gt__(self, o):
        return self.v > o

    def __ge__(self, o):
        return self.v >= o


Number = Ex | Dual | float | int


def num(x: float) -> Ex:
    return Ex(f"({float(x)!r}e0)" if "e" not in repr(float(x)) else f"({float(x)!r})", value=float(x))


def col(name: str) -> Ex:
    return Ex(name)


def ex(x) -> Ex | Dual:
    return x if isinstance(x, (Ex, Dual)) else num(x)


def plain(x) -> Ex:
    x = ex(x)
    return x.v if isinstance(x, Dual) else x


def _lifted(x: Number, f: str, slope: Callable[[Ex, Ex], Ex]):
    x = ex(x)
    if isinstance(x, Dual):
        y = Ex(f, x.v)
        k = slope(x.v, y)
        return Dual(y, tuple(k * a for a in x.d))
    return Ex(f, x)


def sqrt(x):
    return _lifted(x, "sqrt(greatest({}, 0e0))", lambda v, y: num(0.5) / y)


def exp(x):
    return _lifted(x, "exp({})", lambda v, y: y)


def sin(x):
    return _lifted(x, "sin({})", lambda v, y: cos(v))


def cos(x):
    return _lifted(x, "cos({})", lambda v, y: -sin(v))


def log(x):
    """NULL where x isn't positive."""
    return Ex("ln(CASE WHEN {0} > 0e0 THEN {0} END)", ex(x))


def atan2(y, x):
    return Ex("atan2({}, {})", ex(y), ex(x))


def acos(x):
    return Ex("acos(least(1e0, greatest(-1e0, {})))", ex(x))


def floor(x):
    return Ex("CAST(floor({}) AS DOUBLE)", ex(x))


def where(test: Ex, a: Number, b: Number):
    a, b = ex(a), ex(b)
    if isinstance(a, Dual) or isinstance(b, Dual):
        n = a if isinstance(a, Dual) else b
        a, b = n._of(a), n._of(b)
        return Dual(where(test, a.v, b.v), tuple(where(test, x, y) for x, y in zip(a.d, b.d, strict=True)))
    return a if a is b else Ex("CASE WHEN {} THEN {} ELSE {} END", test, a, b)


def vabs(x):
    """Derivative 1 at zero, as the two-valued sign has it."""
    x = ex(x)
    return where(x.v >= 0, x, -x) if isinstance(x, Dual) else Ex("abs({})", x)


def low(a, b):
    a, b = ex(a), ex(b)
    if isinstance(a, Dual) or isinstance(b, Dual):
        return where(Ex("({} < {})", plain(a), plain(b)), a, b)
    return Ex("least({}, {})", a, b)


def high(a, b):
    a, b = ex(a), ex(b)
    if isinstance(a, Dual) or isinstance(b, Dual):
        return where(Ex("({} > {})", plain(a), plain(b)), a, b)
    return Ex("greatest({}, {})", a, b)


def clamp(x, a, b):
    return low(high(x, a), b)


def side(x) -> Ex:
    """Two-valued sign: +1 at zero, NULL for NULL."""
    return Ex("CASE WHEN {0} >= 0e0 THEN 1e0 WHEN {0} < 0e0 THEN -1e0 END", plain(x))


def sgn(x) -> Ex:
    """Three-valued sign."""
    return Ex("CASE WHEN {0} > 0e0 THEN 1e0 WHEN {0} < 0e0 THEN -1e0 WHEN {0} = 0e0 THEN 0e0 END", plain(x))


def rounded(x) -> Ex:
    """Six decimals, without a negative zero; sums over shuffled rows differ in their last bits."""
    return Ex("(round({}, 6) + 0e0)", plain(x))


class Program:
    """Named outputs over the columns of a frame."""

    def __init__(self, **outputs: Number):
        outputs = {k: plain(v) for k, v in outputs.items()}
        uses: dict[int, int] = {}
        order: list[Ex] = []

        def visit(e: Ex) -> None:
            uses[id(e)] = uses.get(id(e), 0) + 1
            if uses[id(e)] == 1:
                for k in e.kids:
                    visit(k)
                if e.kids:
                    uses[id(e.kids[0])] += max(0, e.form.count("{0}") - 1)
                order.append(e)

        for e in outputs.values():
            visit(e)
        names: dict[int, str] = {}
        depth: dict[int, int] = {}
        layers: dict[int, dict[str, str]] = {}

        def text(e: Ex) -> str:
            return names.get(id(e)) or (e.form.format(*map(text, e.kids)) if e.kids else e.form)

        size: dict[int, int] = {}
        for e in order:
            depth[id(e)] = max((depth[id(k)] + (id(k) in names) for k in e.kids), default=0)
            size[id(e)] = 1 + sum(1 if id(k) in names else size[id(k)] for k in e.kids)
            if e.kids and (uses[id(e)] > 1 or size[id(e)] > 60):
                layers.setdefault(depth[id(e)], {})[f"_t{len(names)}"] = text(e)
                names[id(e)] = f"_t{len(names)}"
        self.temporary = list(names.values())
        self.layers = [layers[k] for k in sorted(layers)]
        self.outputs = {k: text(e) for k, e in outputs.items()}

    def on(self, df: DataFrame, *keep: str) -> DataFrame:
        """``df`` with the outputs; with ``keep``, only those of its columns."""
        held = list(keep) or df.columns
        for layer in self.layers:
            df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in layer.items()])
        return df.selectExpr(*[c for c in held if c not in self.outputs], *[f"{e} AS {n}" for n, e in self.outputs.items()])

    def sql(self, source: str, *keep: str) -> str:
        """A parenthesised query over ``source``; without ``keep``, all its columns stay (outputs must have new names)."""
        for layer in self.layers:
            source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {source})"
        held = ", ".join(keep) if keep else ("* EXCLUDE (" + ", ".join(self.temporary) + ")" if self.temporary else "*")
        return f"(SELECT {held}, {', '.join(f'{e} AS {n}' for n, e in self.outputs.items())} FROM {source})"


#: How each form reads over numpy arrays, NULL being NaN there.
_ARRAYS = {f"({{}} {o} {{}})": f"({{}} {o} {{}})" for o in ("+", "-", "*", "<", "<=", ">", ">=")} | {
    "(-{})": "(-{})",
    "({} / nullif({}, 0e0))": "({0} / np.where(np.equal({1}, 0), np.nan, {1}))",
    "({} AND {})": "({} & {})",
    "({} OR {})": "({} | {})",
    "(NOT {})": "(~{})",
    "sqrt(greatest({}, 0e0))": "np.sqrt(np.fmax({}, 0.0))",
    "CASE WHEN {} THEN {} ELSE {} END": "np.where({}, {}, {})",
    "CASE WHEN {0} >= 0e0 THEN 1e0 WHEN {0} < 0e0 THEN -1e0 END": "np.where({0} >= 0, 1.0, np.where({0} < 0, -1.0, np.nan))",
    "CASE WHEN {0} > 0e0 THEN 1e0 WHEN {0} < 0e0 THEN -1e0 WHEN {0} = 0e0 THEN 0e0 END": "np.sign({0})",
    "atan2({}, {})": "np.arctan2({}, {})",
    "least({}, {})": "np.fmin({}, {})",
    "greatest({}, {})": "np.fmax({}, {})",
} | {f"{f}({{}})": f"np.{f}({{}})" for f in ("exp", "sin", "cos", "abs")}


def over_arrays(e: Number) -> str:
    """Python source of ``f(c)``: the formula over a dict of numpy arrays, one for each column, every node worked out once."""
    done: dict[int, str] = {}
    lines: list[str] = []

    def visit(n: Ex) -> str:
        if n.value is not None:
            return repr(n.value)
        if not n.kids:
            return f"c[{n.form!r}]"
        if id(n) not in done:
            text = _ARRAYS[n.form].format(*map(visit, n.kids))
            done[id(n)] = f"_t{len(done)}"
            lines.append(f"    {done[id(n)]} = {text}")
        return done[id(n)]

    last = visit(plain(e))
    return "\n".join(["import numpy as np", "def f(c):", *lines, f"    return {last}"])


PI = math.pi

# Vectors are tuples.


def vec(prefix: str, names: str = "xyz") -> tuple[Ex, ...]:
    return tuple(col(prefix + n) for n in names)


def add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def mul(a, k):
    return tuple(x * k for x in a)


def dot(a, b):
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def norm(a):
    return sqrt(dot(a, a))


def unit(a):
    n = norm(a)
    return tuple(x / n for x in a)


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def choose(test, a, b):
    return tuple(where(test, x, y) for x, y in zip(a, b, strict=True))


def basis(n):
    """Orthonormal (s, t) perpendicular to n: s along n x u for the axis u (x, or y where n is close to x), and t = n x s."""
    n = unit(n)
    u = choose(vabs(n[0]) > 0.9, (num(0), num(1), num(0)), (num(1), num(0), num(0)))
    s = unit(cross(n, u))
    return s, cross(n, s)


def from_spherical(theta, phi):
    return cos(theta) * sin(phi), sin(theta) * sin(phi), cos(phi)


def to_spherical(a):
    return atan2(a[1], a[0]), acos(a[2])


def erf(x):
    """Error function from its rational approximation with a = 0.147."""
    a, s = num(0.147), x * x
    return sgn(x) * sqrt(num(1) - exp(-s * (num(4 / math.pi) + a * s) / (num(1) + a * s)))
