"""Column expressions: guarded division, origins, inverse normal."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(num: Column, den: Column) -> Column:
    """IEEE division of doubles under ANSI mode: null if either is null, NaN for 0/0, else an infinity by sign for a zero denominator."""
    num, den = num.cast("double"), den.cast("double")
    return F.coalesce(num / F.when(den != 0, den), F.when(den == 0, num * float("inf")))


def origin(f2: Column) -> Column:
    """'M' for an even id; 'P' for an odd one or null."""
    return F.when(f2 % 2 == 0, "M").otherwise("P")


def known(value: Column) -> Column:
    """The value, with null in the place of NaN."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


#: Coefficients of Wichura's algorithm AS 241 (numerators and denominators, constant term first).
CENTRE = (
    (
        3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
        4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
    ),
    (
        1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
        2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
    ),
)
MIDDLE = (
    (
        1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
        1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
    ),
    (
        1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
        1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
    ),
)
TAIL = (
    (
        6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
        2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
    ),
    (
        1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
        7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
    ),
)


def _ratio(x: Column, form: tuple) -> Column:
    top, bottom = (reduce(lambda acc, c: acc * x + F.lit(c), reversed(part[:-1]), F.lit(part[-1])) for part in form)
    return top / bottom


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(r <= 5, _ratio(r - 1.6, MIDDLE)).otherwise(_ratio(r - 5, TAIL))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, CENTRE)).otherwise(F.signum(q) * far)


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """The same for an array."""

    def ratio(x: np.ndarray, form: tuple) -> np.ndarray:
        return np.polyval(form[0][::-1], x) / np.polyval(form[1][::-1], x)

    q = p - 0.5
    r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
    far = np.where(r <= 5, ratio(r - 1.6, MIDDLE), ratio(r - 5, TAIL))
    return np.where(np.abs(q) <= 0.425, q * ratio(0.180625 - q * q, CENTRE), np.sign(q) * far)
