"""Layers of networks on array<double> columns: dropout with repeatable masks, recurrent outputs in both directions, turn points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenark.functions.vector import let

# A multiplicative congruential generator modulo a Mersenne prime, and what spreads the keys before it.
MODULUS, MULTIPLIER, SPREAD = 2147483647, 48271, (7919, 104729, 1299709)


def uniform(*keys: Column, seed: int = 1) -> Column:
    """A number from 0 to 1 that depends on up to three integer keys and the seed only, so that a recomputed task draws the same."""
    mixed = sum((k.cast("long") * s for k, s in zip(keys, SPREAD, strict=False)), F.lit(seed).cast("long"))
    once = F.pmod(mixed * MULTIPLIER, F.lit(MODULUS))
    return F.pmod(once * MULTIPLIER, F.lit(MODULUS)) / F.lit(float(MODULUS))


def dropout(x: Column, ratio: float, *keys: Column, seed: int = 1, training: bool = True, reach: int = 1, by_place: bool = True) -> Column:
    """x with each place dropped at `ratio` and the others divided by what is left; x itself outside training.

    The mask is drawn for each row by its `keys` and, with by_place, each run of `reach` places: a reach above 1 drops whole
    maps, no keys draw one mask for all rows (all time steps). The gradient of the layer is the same function of the gradient
    of its output, as the mask is the same.
    """
    if not training or ratio <= 0:
        return x
    place = lambda i: [F.floor(i / reach)] if by_place else []
    return F.transform(x, lambda v, i: F.when(uniform(*keys, *place(i), seed=seed) < ratio, F.lit(0.0)).otherwise(v / (1 - ratio)))


def recurrent(x: Column, wx: float, wh: float, bias: float = 0.0, reverse: bool = False) -> Column:
    """The states of a one-unit tanh layer at every place, read from the first to the last place or from the last to the first."""
    steps = F.aggregate(
        F.reverse(x) if reverse else x,
        F.struct(F.lit(0.0).alias("h"), F.array().cast("array<double>").alias("all")),
        lambda a, v: let(F.tanh(v * wx + a["h"] * wh + bias), lambda h: F.struct(h.alias("h"), F.concat(a["all"], F.array(h)).alias("all"))),
        lambda a: a["all"],
    )
    return F.reverse(steps) if reverse else steps


def bidirectional(x: Column, wx: float, wh: float, bias: float = 0.0) -> Column:
    """At every place the state of the layer read forward and that of the layer read backward."""
    return F.arrays_zip(recurrent(x, wx, wh, bias).alias("forward"), recurrent(x, wx, wh, bias, reverse=True).alias("backward"))


def levelled(y: Column) -> Column:
    """A series turned about its start until its ends are level; places count one each."""
    n = F.size(y)
    angle = -F.atan((F.get(y, n - 1) - F.get(y, F.lit(0))) / (n - 1))
    return F.when(n > 1, let(angle, lambda a: F.transform(y, lambda v, i: F.sin(a) * i + F.cos(a) * v))).otherwise(y)


def turn_points(y: Column, gap: int = 2) -> Column:
    """Places of the levelled series above or below both neighbours, at least `gap` apart from the first on."""

    def turns(v: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(v) - 2)
        return F.filter(inner, lambda i: (F.get(v, i - 1) - F.get(v, i)) * (F.get(v, i + 1) - F.get(v, i)) > 0)

    def apart(places: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(places, none, lambda a, i: F.when((F.size(a) == 0) | (i - F.element_at(F.concat(F.array(F.lit(-gap)), a), -1) >= gap), F.concat(a, F.array(i))).otherwise(a))

    return F.when(F.size(y) < 3, F.array().cast("array<int>")).otherwise(let(levelled(y), lambda v: apart(turns(v))))
