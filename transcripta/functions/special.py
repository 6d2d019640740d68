"""Scalar special functions evaluated on the driver for a handful of values
(digamma/trigamma of df/2 for the variance prior).  Never called per row."""

from __future__ import annotations

import math


def digamma(x: float) -> float:
    r = 0.0
    while x < 20.0:
        r -= 1.0 / x
        x += 1.0
    f = 1.0 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1.0 / 12 - f * (1.0 / 120 - f * (1.0 / 252 - f * (
        1.0 / 240 - f * (1.0 / 132)))))


def trigamma(x: float) -> float:
    r = 0.0
    while x < 20.0:
        r += 1.0 / (x * x)
        x += 1.0
    f = 1.0 / (x * x)
    return r + 1.0 / x + f / 2.0 + f / x * (1.0 / 6 - f * (1.0 / 30 - f * (1.0 / 42 - f * (1.0 / 30))))


def trigamma_inverse(y: float) -> float:
    """Solve trigamma(x) = y by Newton's method (Smyth 2004, appendix)."""
    if y > 1e7:
        return 1.0 / math.sqrt(y)
    if y < 1e-6:
        return 1.0 / y
    x = 0.5 + 1.0 / y
    for _ in range(50):
        tri = trigamma(x)
        # derivative of trigamma via finite difference of its series is
        # avoided: use the published update x += tri*(1-tri/y)/tetragamma
        tetra = _tetragamma(x)
        dif = tri * (1.0 - tri / y) / tetra
        x += dif
        if -dif / x < 1e-8:
            break
    return x


def _tetragamma(x: float) -> float:
    r = 0.0
    while x < 20.0:
        r -= 2.0 / (x * x * x)
        x += 1.0
    f = 1.0 / (x * x)
    return r - 1.0 / (x * x) - 1.0 / (x * x * x) - f * f * (0.5 - f * (1.0 / 6 - f * (1.0 / 6 - f * 0.3)))
