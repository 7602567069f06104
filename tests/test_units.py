"""Units against their definitions."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factweave.functions import units


@pytest.mark.parametrize(
    ("text", "value", "want", "pi", "base"),
    [
        ("kPa", 3, 3000, 0, "kg m^-1 s^-2"), ("psi", 1, Fraction("4.4482216152605") / Fraction("0.0254") ** 2, 0, "kg m^-1 s^-2"), ("deg/s", 90, Fraction(1, 2), 1, "rad s^-1"),
        ("degC", 20, Fraction("293.15"), 0, "K"), ("degF", 32, Fraction("273.15"), 0, "K"), ("m s^-2", 5, 5, 0, "m s^-2"), ("km / h", 36, 10, 0, "m s^-1"),
        ("mm^2", 1, Fraction(1, 10**6), 0, "m^2"), ("%", 50, Fraction(1, 2), 0, "1"), ("1/s", 2, 2, 0, "s^-1"), ("µT", 1, Fraction(1, 10**6), 0, "kg A^-1 s^-2"),
        ("min", 2, 120, 0, "s"), ("rev", 0, 0, 0, "rad"), ("N*m", 1, 1, 0, "kg m^2 s^-2"), ("V·A", 1, 1, 0, "kg m^2 s^-3"), ("W/m^2/K", 1, 1, 0, "kg K^-1 s^-3"),
        ("degC/s", 3, 3, 0, "K s^-1"), ("kn", 1, Fraction(1852, 3600), 0, "m s^-1"),
    ],
)
def test_a_unit_is_exact(text, value, want, pi, base):
    unit = units.parse(text)
    assert unit.exact(value) == (want, pi) and unit.base == base


def test_a_difference_takes_no_offset():
    assert units.parse("degC").exact(20, difference=True) == (20, 0)


@pytest.mark.parametrize("text", ["", "kmin", "parsec", "m^", "m^0", "m^1.5", "m//s", "kdegC", "m/", "mkg"])
def test_other_text_is_refused(text):
    with pytest.raises(ValueError):
        units.parse(text)


def test_derived_units_agree():
    for a, b in [("J", "N*m"), ("W", "J/s"), ("V", "W/A"), ("F", "C/V"), ("Ohm", "V/A"), ("S", "A/V"), ("Wb", "V*s"), ("T", "Wb/m^2"), ("H", "Wb/A"), ("lx", "lm/m^2"), ("Pa", "N/m^2"), ("lbf", "lb*g_n"), ("psi", "lbf/in^2"), ("mi", "mi")]:
        assert units.parse(a) == units.parse(b), a


def test_columns_take_known_units_only(spark):
    rows = spark.createDataFrame([(1, 20.0, "degC"), (2, 180.0, "deg"), (3, 1.0, "parsec"), (4, None, "m"), (5, 2.0, None)], "id int, v double, u string")
    got = {r.id: (r.x.value, r.x.unit) for r in rows.select("id", units.in_base(F.col("v"), F.col("u"), ["degC", "deg", "m", "deg"]).alias("x")).collect()}
    assert got[1] == (293.15, "K") and got[2][0] == pytest.approx(3.141592653589793) and got[3] == (None, None) and got[4] == (None, "m") and got[5] == (None, None)
    none = rows.select(units.in_base(F.col("v"), F.col("u"), []).alias("x")).first().x
    assert (none.value, none.unit) == (None, None)
