"""Names that are much alike, as a join whose work follows the names and not their pairs.

Names are alike by ``functions.text.similarity``: 1 if equal but for case, the ratio of
lengths where one holds the other, else the Jaccard of their sets of characters. Three
joins find all pairs over a floor: equal names by an equi-join; contained ones by the
substrings that are long enough (or share enough characters) to matter; the rest by
their sets of characters. Names of one set are one row there, and sets meet only where
their sizes allow it and they share one of their rarest characters (of a set of n, one
among n - ceil(floor * n) + 1), then are verified. Of a set that is alike, a name needs
its first category that it neither holds nor lies in: the first r + 1 in order are
enough if it is so related to r of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.shared_folder import written


def _letters(low: Column) -> Column:
    return F.array_sort(F.array_distinct(F.split(low, "")))


def _substrings(low: Column, floor: float) -> Column:
    """Substrings over the floor by length or by characters, without the whole."""
    n, all_letters = F.length(low), F.size(_letters(low))
    of_length = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda p: F.substring(low, p, k))
    every = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), of_length))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(every, lambda s: (F.length(s) > floor * n) | (F.size(_letters(s)) > floor * all_letters)))


def _contained(names: DataFrame, categories: DataFrame, floor: float) -> DataFrame:
    """low, low_c, ratio of pairs where one holds the other and that would pass by lengths or characters."""
    inside = lambda d, whole, part: d.select(F.col(whole), F.explode(_substrings(F.col(whole), floor)).alias(part))
    one = inside(names, "low", "low_c").join(categories, "low_c", "left_semi")
    other = inside(categories, "low_c", "low").join(names, "low", "left_semi")
    pairs = one.select("low", "low_c").unionByName(other.select("low", "low_c"))
    return pairs.withColumn("ratio", F.least(F.length("low"), F.length("low_c")) / F.greatest(F.length("low"), F.length("low_c")))


def _alike_sets(names: DataFrame, categories: DataFrame, floor: float) -> DataFrame:
    """set, set_c, jaccard of sets of characters over the floor; both tables have set and letters, a row each."""
    letters = names.select("letters").unionByName(categories.select("letters")).select(F.explode("letters").alias("letter")).groupBy("letter").agg(F.count("*").alias("often"))

    def prefixes(sets: DataFrame) -> DataFrame:
        each = sets.select("set", "letters", F.size("letters").alias("size"), F.explode("letters").alias("letter")).join(F.broadcast(letters), "letter")  # as many rows as there are characters
        place = F.row_number().over(Window.partitionBy("set").orderBy("often", "letter"))
        return each.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(floor * F.col("size") - 1e-9) + 1)

    right = prefixes(categories).select("letter", F.col("set").alias("set_c"), F.col("letters").alias("letters_c"), F.col("size").alias("size_c"))
    sizes = (F.col("size_c") >= floor * F.col("size")) & (F.col("size") >= floor * F.col("size_c"))
    met = prefixes(names).join(right, "letter").where(sizes)
    shared = F.size(F.array_intersect("letters", "letters_c"))
    scored = met.select("set", "set_c", (shared / (F.col("size") + F.col("size_c") - shared)).alias("jaccard"))
    return scored.where(F.col("jaccard") > floor).distinct()


def similar_names(categories: DataFrame, names: DataFrame, floor: float = 0.85) -> DataFrame:
    """name, category, score: the existing category most like each new name, above the floor; ties by category. Nulls are like nothing."""
    asked = names.where(F.col("name").isNotNull()).select("name", F.lower("name").alias("low")).distinct()
    there = categories.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("low_c")).agg(F.min("name").alias("category"))
    with_set = lambda d, low, key: d.withColumn("letters", _letters(F.col(low))).withColumn(key, F.array_join("letters", ""))
    # read many times below, and a caller may go on from the result to the next join
    asked, there = written(with_set(asked, "low", "set")), written(with_set(there, "low_c", "set_c"))
    lows, lows_c = asked.select("low").distinct(), there.select("low_c")
    equal = asked.join(there.select(F.col("low_c").alias("low"), "category"), "low").select("name", "category", F.lit(1.0).alias("score"))
    contained = _contained(lows, lows_c, floor)
    inside = contained.where(F.col("ratio") > floor).join(asked.select("name", "low"), "low").join(there.select("low_c", "category"), "low_c").select("name", "category", F.col("ratio").alias("score"))
    sets = _alike_sets(asked.select("set", "letters").distinct(), there.select(F.col("set_c").alias("set"), "letters").distinct(), floor)
    # pairs that are equal or contained don't count by their characters
    other = contained.select("low", "low_c").unionByName(lows.join(lows_c, F.col("low") == F.col("low_c")))
    skipped = other.join(there.select("low_c", "set_c"), "low_c").groupBy("low", "set_c").agg(F.count("*").alias("r"))
    ordered = there.select("set_c", "low_c", "category", F.row_number().over(Window.partitionBy("set_c").orderBy("category")).alias("place"))
    wanted = asked.select("name", "low", "set").join(sets, "set").join(skipped, ["low", "set_c"], "left")
    wanted = wanted.select("name", "low", "set_c", "jaccard", F.explode(F.sequence(F.lit(1), F.coalesce("r", F.lit(0)).cast("int") + 1)).alias("place"))
    by_letters = wanted.join(ordered, ["set_c", "place"]).join(other, ["low", "low_c"], "left_anti").select("name", "category", F.col("jaccard").alias("score"))
    found = equal.unionByName(inside).unionByName(by_letters)
    return found.groupBy("name").agg(F.min_by("category", F.struct(-F.col("score"), "category")).alias("category"), F.max("score").alias("score"))
