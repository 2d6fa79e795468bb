"""Sums of doubles that are exact and rounded once, whatever the partitioning: a superaccumulator of built-in expressions.

A finite double is a whole number of at most 53 bits times a power of two. Cut at multiples of ``WIDTH`` bits it is three whole
numbers at most, each of its own bin; whole numbers of a bin add up exactly in a long (up to 2^36 rows), in each task before
the shuffle and after it. At the end the bins of a group, 82 at most, are carried into digits of one sign, and the 53
leading bits are rounded half to even by all that follow them. So a sum is the double nearest to the true sum, as
``math.fsum`` gives it.

Defined results: nulls are left aside, and a group of nulls alone sums to null; a sum of zeros is 0.0; infinities of both signs,
or any nan, give nan, infinities of one sign that infinity; a sum beyond the largest double is an infinity, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import share

#: Bits of a bin: three bins hold any 53 bits, as 1 + 2 * 26 = 53.
WIDTH = 26
#: Numbers beyond 2^FAR either way are moved by SHIFT bins before they are cut, so that every power of two in use is a double.
FAR, SHIFT = 400, 20
#: Bins that no finite number has.
NAN, PLUS, MINUS = 1000, 1001, 1002


def power(e: Column) -> Column:
    """2 to a whole number: exact where it's a double."""
    return F.pow(F.lit(2.0), e)


def binned(rows: DataFrame, x: str) -> DataFrame:
    """rows, one to three times: with _nth (0 to 2), _bin and _part, whose sums of _part * 2^(WIDTH * _bin) are x. A null has one row, without them."""
    own = rows.columns
    v = F.col(x).cast("double")
    size = F.abs(v)
    moved = F.when(size > 2.0**FAR, SHIFT).when((size < 2.0**-FAR) & (size > 0), -SHIFT).otherwise(0)
    special = F.when(F.isnan(v), NAN).when(v == float("inf"), PLUS).when(v == float("-inf"), MINUS)
    rows = rows.withColumns({"_moved": moved, "_special": special})
    held = F.when(F.col("_special").isNotNull(), 0.0).when(F.col("_moved") > 0, v * 2.0 ** (-WIDTH * SHIFT)).when(F.col("_moved") < 0, v * 2.0 ** (WIDTH * SHIFT)).otherwise(v)
    rows = rows.withColumn("_held", held)
    # The logarithm may be a bin off at a bin's edge; the three parts then still hold all bits.
    rows = rows.withColumn("_top", F.when(F.col("_held") == 0, 0).otherwise(F.floor(F.log2(F.abs("_held")) / WIDTH)).cast("int"))
    unit = [power((F.col("_top") - k) * WIDTH) for k in range(3)]
    rows = rows.withColumn("_a", (F.col("_held") / unit[0]).cast("long"))
    rows = rows.withColumn("_rest", F.col("_held") - F.col("_a") * unit[0])
    rows = rows.withColumn("_b", (F.col("_rest") / unit[1]).cast("long"))
    rows = rows.withColumn("_c", ((F.col("_rest") - F.col("_b") * unit[1]) / unit[2]).cast("long"))
    part = lambda k, c: F.struct(F.lit(k).alias("_nth"), (F.col("_top") + F.col("_moved") - k).alias("_bin"), F.col(c).alias("_part"))
    counted = F.struct(F.lit(0).alias("_nth"), F.col("_special").alias("_bin"), F.lit(1).cast("long").alias("_part"))
    cut = F.when(F.col("_special").isNotNull(), F.array(counted)).when(F.col("_c") != 0, F.array(part(0, "_a"), part(1, "_b"), part(2, "_c")))
    cut = cut.when(F.col("_b") != 0, F.array(part(0, "_a"), part(1, "_b"))).otherwise(F.array(part(0, "_a")))
    return rows.select(*own, F.inline(cut))


def rounded(groups: DataFrame, bins: str, out: str) -> DataFrame:
    """groups with out, the double nearest to the sum of an array of (bin, part), in its place. Bins may repeat; parts may be null."""
    groups = groups.withColumn(bins, F.filter(bins, lambda p: p["part"].isNotNull()))
    has = lambda b: F.exists(bins, lambda p: p["bin"] == b)
    special = F.when(has(NAN) | (has(PLUS) & has(MINUS)), float("nan")).when(has(PLUS), float("inf")).when(has(MINUS), float("-inf"))
    groups = groups.withColumn("_special", special).withColumn(bins, F.filter(bins, lambda p: p["bin"] < NAN))
    at = F.transform(bins, lambda p: p["bin"])
    # Three bins more than the largest, so that nothing is left to carry but the sign.
    groups = groups.withColumn("_range", F.when(F.size(bins) > 0, F.sequence(F.array_min(at), F.array_max(at) + 3)))
    own = lambda k: F.aggregate(F.filter(bins, lambda p: p["bin"] == k), F.lit(0).cast("long"), lambda a, p: a + p["part"])
    groups = groups.withColumn("_totals", F.transform("_range", own))
    # An arithmetic shift rounds down, so what is carried beyond the last bin is -1 for negative sums, else 0.
    over = F.aggregate("_totals", F.lit(0).cast("long"), lambda carry, t: F.shiftright(carry + t, WIDTH))
    groups = groups.withColumn("_sign", F.when(over < 0, -1).otherwise(1).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def carry(state: Column, total: Column) -> Column:
        held = state["carry"] + total * F.col("_sign")
        return F.struct(F.shiftright(held, WIDTH).alias("carry"), F.concat(F.array(held.bitwiseAND((1 << WIDTH) - 1)), state["digits"]).alias("digits"))

    groups = groups.withColumn("_digits", F.aggregate("_totals", start, carry, lambda s: s["digits"]))  # the leading one first
    groups = groups.withColumn("_h", F.array_min(F.transform("_digits", lambda d, k: F.when(d != 0, k))))
    digit = lambda k: F.coalesce(F.get("_digits", F.col("_h") + k), F.lit(0).cast("long"))
    groups = groups.withColumn("_bits", F.length(F.bin(digit(0))).cast("int"))  # of the leading digit, 1 to 26
    shift = lambda x, n: F.call_function("shiftleft", x, n)
    low = digit(2).bitwiseAND(shift(F.lit(1).cast("long"), F.col("_bits") - 1) - 1)
    mantissa = shift(digit(0), 53 - F.col("_bits")) + shift(digit(1), 27 - F.col("_bits")) + F.call_function("shiftright", digit(2), F.col("_bits") - 1)
    rest, half = shift(low, F.lit(WIDTH)) + digit(3), shift(F.lit(1).cast("long"), F.col("_bits") + (WIDTH - 2))
    more = F.exists(F.filter("_digits", lambda d, k: k > F.col("_h") + 3), lambda d: d != 0)
    groups = groups.withColumns({"_mantissa": mantissa, "_up": (rest > half) | ((rest == half) & (more | (mantissa % 2 == 1)))})
    # Of the leading digit's bin; the range runs upwards, the digits downwards.
    exponent = (F.element_at("_range", -1) - F.col("_h")) * WIDTH - 53 + F.col("_bits")
    groups = groups.withColumn("_e", exponent.cast("int"))
    # In two steps, as 2^e alone may be beyond doubles where the product isn't. A sum of doubles has no bits below the least one.
    near = F.greatest(F.least(F.col("_e"), F.lit(900)), F.lit(-900))
    value = (F.col("_mantissa") + F.when(F.col("_up"), 1).otherwise(0)).cast("double") * power(near) * power(F.col("_e") - near) * F.col("_sign")
    total = F.when(F.col("_special").isNotNull(), F.col("_special")).when(F.size(bins) == 0, None).when(F.col("_h").isNull(), 0.0).otherwise(value)
    return groups.withColumn(out, total).drop(bins, "_special", "_range", "_totals", "_sign", "_digits", "_h", "_bits", "_mantissa", "_up", "_e")


def exact_sums(rows: DataFrame, keys: list[str], sums: dict[str, Column], counts: dict[str, Column] | None = None) -> DataFrame:
    """keys, then by name the exact sums of doubles, and the numbers of rows for which a condition holds.

    One shuffle of what each task has summed by key and bin, and a small one of the few bins of each key.
    """
    counts = counts or {}
    share(rows.sparkSession)
    flags = [F.coalesce(c, F.lit(False)).alias(f"_n{k}") for k, c in enumerate(counts.values())]
    each = rows.select(*keys, *flags, F.posexplode(F.array(*[c.cast("double") for c in sums.values()])).alias("_which", "_x"))
    each = binned(each, "_x")
    once = (F.col("_which") == 0) & (F.col("_nth") == 0)
    tallies = [F.count_if(once & F.col(f"_n{k}")).alias(f"_n{k}") for k in range(len(counts))]
    held = each.groupBy(*keys, "_bin").agg(*tallies, *[F.sum(F.when(F.col("_which") == k, F.col("_part"))).alias(f"_s{k}") for k in range(len(sums))])
    lists = [F.collect_list(F.struct(F.col("_bin").alias("bin"), F.col(f"_s{k}").alias("part"))) for k in range(len(sums))]
    groups = held.groupBy(*keys).agg(*[F.sum(f"_n{k}").alias(f"_n{k}") for k in range(len(counts))], F.array(*lists).alias("_lists"))
    # One row a sum, so that the rounding is planned once; they meet again where they are.
    each = rounded(groups.select(*keys, *[f"_n{k}" for k in range(len(counts))], F.posexplode("_lists").alias("_which", "_bins")), "_bins", "_sum")
    found = [F.max(F.when(F.col("_which") == k, F.col("_sum"))).alias(name) for k, name in enumerate(sums)]
    return each.groupBy(*keys).agg(*found, *[F.first(f"_n{k}").alias(name) for k, name in enumerate(counts)])


def float_hex(x: Column) -> Column:
    """A double as text in base 16, exact, as ``float.hex`` writes it; null stays null."""
    v = x.cast("double")
    size = F.abs(v)
    # The logarithm may be off by one next to a power of two; least of all numbers have no leading 1.
    near = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size).otherwise(1.0))).cast("int")
    near = F.greatest(F.least(near, F.lit(1023)), F.lit(-1022))
    e = F.when(power(near) > size, near - 1).when((near < 1023) & (power(F.least(near + 1, F.lit(1023))) <= size), near + 1).otherwise(near)
    e = F.greatest(e, F.lit(-1022))
    scaled = size * power(-e)
    lead = F.when(scaled >= 1, 1).otherwise(0)
    digits = F.lpad(F.lower(F.hex(((scaled - lead) * 2.0**52).cast("long"))), 13, "0")
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise("")
    shown = F.concat(sign, F.lit("0x"), lead.cast("string"), F.lit("."), digits, F.lit("p"), F.when(e >= 0, "+").otherwise("-"), F.abs(e).cast("string"))
    return F.when(v.isNull(), None).when(F.isnan(v), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size == 0, F.concat(sign, F.lit("0x0.0p+0"))).otherwise(shown)
