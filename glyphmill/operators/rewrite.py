"""Rewrites of token arrays as built-in expressions: merge, blow-up, delete."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _runs(tokens: Column) -> Column:
    """Maximal runs of one token as an array of (token, length); linear in the array."""
    starts = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: (i == 1) | (F.element_at(tokens, i) != F.element_at(tokens, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(tokens)), F.array(F.size(tokens) + 1))
    runs = F.zip_with(starts, ends, lambda a, e: F.struct(F.element_at(tokens, a).alias("token"), (e - a).alias("length")))
    return F.when(F.size(tokens) > 0, runs).otherwise(F.array().cast("array<struct<token:binary,length:int>>"))


def merge_pair(tokens: Column, left: Column, right: Column) -> Column:
    """Greedy left-to-right replacement of left, right by their concatenation, without overlap."""
    size = F.size(tokens)
    at = lambda i: F.element_at(tokens, F.least(F.greatest(i, F.lit(1)), size))
    hit = lambda i: (i >= 1) & (i < size) & (at(i) == left) & (at(i + 1) == right)
    nothing = F.array().cast("array<binary>")
    # two different tokens can't overlap with themselves, so every place decides on its own
    apart = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.when(hit(i), F.array(F.concat(left, right))).when(hit(i - 1), nothing).otherwise(F.array(at(i)))))

    def halved(run: Column) -> Column:
        twos = F.array_repeat(F.concat(left, right), F.floor(run["length"] / 2).cast("int"))
        one = F.when(run["length"] % 2 == 1, F.array(run["token"])).otherwise(nothing)
        return F.when(run["token"] == left, F.concat(twos, one)).otherwise(F.array_repeat(run["token"], run["length"]))

    return F.when(size < 1, tokens).when(left == right, F.flatten(F.transform(_runs(tokens), halved))).otherwise(apart)


def blow_up(tokens: Column, bad: Column, parts: Column) -> Column:
    """Every occurrence of a token replaced by its parts."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t == bad, parts).otherwise(F.array(t))))


def delete_token(tokens: Column, bad: Column) -> Column:
    return F.array_remove(tokens, bad)


def adjacent_pairs(tokens: Column) -> Column:
    """Pairs of neighbours as an array of (left, right, times). Within a run of one token pairs don't overlap,
    so n equal tokens give n // 2 of them."""
    kind = "array<struct<left:binary,right:binary,times:int>>"
    beside = F.zip_with(F.slice(tokens, F.lit(1), F.size(tokens) - 1), F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.struct(a.alias("left"), b.alias("right"), F.lit(1).alias("times")))
    apart = F.filter(beside, lambda p: p["left"] != p["right"])
    alike = F.transform(F.filter(_runs(tokens), lambda r: r["length"] > 1), lambda r: F.struct(r["token"].alias("left"), r["token"].alias("right"), F.floor(r["length"] / 2).cast("int").alias("times")))
    return F.when(F.size(tokens) > 1, F.concat(apart.cast(kind), alike.cast(kind))).otherwise(F.array().cast(kind))
