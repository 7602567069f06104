"""Units as products of powers of base units, exactly; columns are converted by factors that the plan holds as literals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The base units, what the others are in them, and the prefixes.
BASE = ("m", "kg", "s", "A", "K", "mol", "cd", "rad", "sr")
DEFINED = """
g = 1/1000 kg
Hz = s^-1
N = kg m s^-2
Pa = kg m^-1 s^-2
J = kg m^2 s^-2
W = kg m^2 s^-3
C = A s
V = kg m^2 s^-3 A^-1
F = kg^-1 m^-2 s^4 A^2
Ohm = kg m^2 s^-3 A^-2
S = kg^-1 m^-2 s^3 A^2
Wb = kg m^2 s^-2 A^-1
T = kg s^-2 A^-1
H = kg m^2 s^-2 A^-2
lm = cd sr
lx = m^-2 cd sr
degC = K
degF = 5/9 K
min = 60 s
h = 3600 s
d = 86400 s
deg = 1/180 pi rad
rev = 2 pi rad
L = 1/1000 m^3
bar = 100000 kg m^-1 s^-2
% = 1/100
ft = 0.3048 m
in = 0.0254 m
mi = 1609.344 m
nmi = 1852 m
kn = 1852/3600 m s^-1
lb = 0.45359237 kg
lbf = 4.4482216152605 kg m s^-2
psi = 44482216152605/6451600000 kg m^-1 s^-2
g_n = 9.80665 m s^-2
gauss = 1/10000 kg s^-2 A^-1
"""
#: Where zero lies on the scale of the base unit.
OFFSETS = {"degC": Fraction("273.15"), "degF": Fraction("459.67") * Fraction(5, 9)}
PREFIXES = {"p": -12, "n": -9, "u": -6, "µ": -6, "μ": -6, "m": -3, "c": -2, "d": -1, "h": 2, "k": 3, "M": 6, "G": 9}
#: Units that take a prefix.
PREFIXED = ("m", "g", "s", "A", "K", "mol", "cd", "rad", "Hz", "N", "Pa", "J", "W", "C", "V", "F", "Ohm", "S", "Wb", "T", "H", "L", "bar", "gauss")

TABLE = dict(line.split(" = ") for line in DEFINED.strip().split("\n"))


@dataclass(frozen=True)
class Unit:
    """``scale * pi ** pi`` of the base units to the powers ``powers``; ``offset`` is added to a value that isn't a difference."""

    scale: Fraction = Fraction(1)
    pi: int = 0
    powers: tuple[int, ...] = (0,) * len(BASE)
    offset: Fraction = Fraction(0)

    def times(self, other: Unit, n: int = 1) -> Unit:
        return Unit(self.scale * other.scale**n, self.pi + n * other.pi, tuple(a + n * b for a, b in zip(self.powers, other.powers, strict=True)))

    @property
    def base(self) -> str:
        """Its coherent unit, positive powers first; ``1`` if it has no dimension."""
        found = sorted(((b, n) for b, n in zip(BASE, self.powers, strict=True) if n), key=lambda x: (x[1] < 0, x[0]))
        return " ".join(b if n == 1 else f"{b}^{n}" for b, n in found) or "1"

    def exact(self, value: int | Fraction, difference: bool = False) -> tuple[Fraction, int]:
        """A value in base units, as a rational and the power of pi that it is multiplied by; zero has power 0."""
        out = value * self.scale + (0 if difference else self.offset)
        return Fraction(out), self.pi if out else 0


@lru_cache(maxsize=None)
def symbol(name: str) -> Unit:
    """A single unit, whole names before prefixed ones."""
    if name in BASE:
        return Unit(powers=tuple(int(b == name) for b in BASE))
    if name in TABLE:
        plain = parse(TABLE[name], True)
        return Unit(plain.scale, plain.pi, plain.powers, OFFSETS.get(name, Fraction(0)))
    if name[:1] in PREFIXES and name[1:] in PREFIXED:
        return Unit(scale=Fraction(10) ** PREFIXES[name[0]]).times(symbol(name[1:]))
    raise ValueError(f"not a unit: {name!r}")


@lru_cache(maxsize=4096)
def parse(text: str, numbers: bool = False) -> Unit:
    """Factors with blanks, ``*`` or ``·`` between them, ``^n`` for powers, ``/`` before each factor that divides; ``1`` has no dimension.

    A scale with an offset keeps it only where it stands alone. ``ValueError`` for any other text.
    """
    if numbers:  # in the table: a number and pi may come first
        words, out = text.split(), Unit()
        while words and re.fullmatch(r"[\d./]+|pi", words[0]):
            head = words.pop(0)
            out = Unit(out.scale, 1) if head == "pi" else Unit(Fraction(head))
        return out.times(parse(" ".join(words) or "1"))
    parts = re.split(r"\s*([*·/])\s*|\s+", text.strip())
    out, sign, alone = Unit(), 1, len(parts) == 1
    for k, part in enumerate(parts):
        if k % 2:
            sign = -1 if part == "/" else 1
            continue
        name, _, power = (part or "").partition("^")
        if name == "1" and not power:
            continue
        if "^" in part and not re.fullmatch(r"-?[1-9]\d*", power):
            raise ValueError(f"not a power: {part!r}")
        unit = symbol(name)
        if alone and not power:
            return unit
        out = out.times(unit, sign * int(power or 1))
    return out


def in_base(value: Column, unit: Column, known: Iterable[str], difference: bool = False) -> Column:
    """A struct ``value, unit`` of a value in base units, for the unit texts ``known``; nulls for any other. One look-up in a literal map."""
    units = {text: parse(text) for text in dict.fromkeys(known)}
    if not units:
        return F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"))
    flat = []
    for text, u in units.items():
        offset = 0.0 if difference else float(u.offset)
        flat += [F.lit(text), F.struct(F.lit(float(u.scale) * math.pi**u.pi).alias("scale"), F.lit(offset).alias("offset"), F.lit(u.base).alias("base"))]
    found = F.try_element_at(F.create_map(*flat), unit)
    return F.struct((value.cast("double") * found["scale"] + found["offset"]).alias("value"), found["base"].alias("unit"))
