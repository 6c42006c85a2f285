"""Names matched with titles: exact, without spaces, or the best of three similarities.

Candidates share character trigrams of their words (with the words' ends marked), so a wrong letter in a one-word name and a name
among other words of a title are both found. One asks for ``SHARED`` of its trigrams; a text that has that many must have one of
all but that many less one of them, whichever those are, so it is looked up by its rarest ones only (prefix filter), an equi-join.
Candidates are then counted in full, and scored in batches.

All similarities rest on the longest common subsequence: 200 times its length over both lengths. Equal names are matched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of a name's trigrams that a candidate has.
SHARED = 0.4
#: Least scores by whole and sorted words, and for a part.
LEAST, LEAST_PART = 85.0, 87.0
#: Order in which equal scores count.
SCORERS = ("token_set", "token_sort", "partial")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of it at a time in the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common words, those with one side's other words, and those with the other's; 100 if one side's
    words are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max([ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else [])])


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one that is no longer, cut short at its ends."""
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    if not m:
        return 100.0 if not n else 0.0
    if short in long:
        return 100.0
    return max(ratio(short, long[max(0, i) : i + m]) for i in range(1 - m, n))


def best_score(a: str, b: str) -> tuple[float, str]:
    scores = [(f(a, b), -k) for k, f in enumerate((token_set, token_sort, partial))]
    score, k = max(scores)
    return score, SCORERS[-k]


def _trigrams(text: Column) -> Column:
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of)))


def _asked_of(x: DataFrame, y: DataFrame, shared: float) -> DataFrame:
    """(_x, _y) of (_x, _gx) and (_y, _gy) where _y has at least ``shared`` of the trigrams _gx, one at the least."""
    x = x.withColumn("_t", F.greatest(F.lit(1), F.floor(F.size("_gx") * shared).cast("int")))
    spread = x.select("_x", F.size("_gx").alias("_n"), "_t", F.explode("_gx").alias("_g"))
    index = y.select("_y", F.explode("_gy").alias("_g"))
    often = index.groupBy("_g").agg(F.count("*").alias("_often"))
    order = Window.partitionBy("_x").orderBy(F.coalesce("_often", F.lit(0)), "_g")
    rare = spread.join(often, "_g", "left").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("_n") - F.col("_t") + 1)
    met = rare.select("_x", "_g").join(index, "_g").select("_x", "_y").distinct()
    return met.join(x, "_x").join(y, "_y").where(F.size(F.array_intersect("_gx", "_gy")) >= F.col("_t")).select("_x", "_y")


def candidates(a: DataFrame, b: DataFrame, shared: float = SHARED) -> DataFrame:
    """(_a, _b): distinct texts ``_a`` and titles ``_b`` of which one has at least ``shared`` of the other's trigrams, as a title
    may stand inside a longer name too."""
    x, y = a.select(F.col("_a").alias("_x"), _trigrams(F.col("_a")).alias("_gx")), b.select(F.col("_b").alias("_y"), _trigrams(F.col("_b")).alias("_gy"))
    ahead = _asked_of(x, y, shared).select(F.col("_x").alias("_a"), F.col("_y").alias("_b"))
    turn = lambda df, c, d: df.select(F.col(f"_{c}").alias(f"_{d}"), F.col(f"_g{c}").alias(f"_g{d}"))
    back = _asked_of(turn(y, "y", "x"), turn(x, "x", "y"), shared).select(F.col("_y").alias("_a"), F.col("_x").alias("_b"))
    return ahead.unionByName(back).distinct()


def title_matches(names: DataFrame, titles: DataFrame, name: str, title: str, name_id: str, title_id: str, shared: float = SHARED) -> DataFrame:
    """name_id, title_id, score, how: each name's title if it is equal (exact) or equal without spaces (no space); else the title
    with the highest score of any similarity, which is then named, if the score reaches LEAST, or LEAST_PART for ``partial``; of
    equal scores the first similarity and the smallest title id. Texts are folded beforehand; empty and null ones match nothing.
    """
    own = names.where(F.col(name) != "").select(name_id, F.col(name).alias("_a"))
    a = own.select("_a").distinct()
    b = titles.where(F.col(title) != "").groupBy(F.col(title).alias("_b")).agg(F.min(title_id).alias(title_id))
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    exact = a.join(b, F.col("_a") == F.col("_b")).select("_a", title_id, F.lit("exact").alias("how"), F.lit(0).alias("_k"))
    close = a.join(b, tight(F.col("_a")) == tight(F.col("_b"))).select("_a", title_id, F.lit("no space").alias("how"), F.lit(1).alias("_k"))
    sure = exact.unionByName(close).groupBy("_a").agg(F.min(F.struct("_k", F.col(title_id).alias("t"), "how")).alias("m")).select("_a", F.col("m.t").alias(title_id), F.lit(100.0).alias("score"), F.col("m.how").alias("how"))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            best = [best_score(x, y) for x, y in zip(rows["_a"], rows["_b"], strict=True)]
            yield pd.DataFrame({"_a": rows["_a"], "_b": rows["_b"], "score": [s for s, _ in best], "how": [h for _, h in best]})

    left = a.join(sure.select("_a"), "_a", "left_anti")
    scored = candidates(left, b, shared).mapInPandas(score, "_a string, _b string, score double, how string").join(b, "_b")
    first = F.struct((-F.col("score")).alias("s"), F.array_position(F.array(*map(F.lit, SCORERS)), F.col("how")).alias("k"), F.col(title_id).alias("t"))
    top = scored.groupBy("_a").agg(F.min(F.struct(first.alias("o"), "how")).alias("m")).select("_a", F.col("m.o.t").alias(title_id), (-F.col("m.o.s")).alias("score"), F.col("m.how").alias("how"))
    fit = top.where(F.col("score") >= F.when(F.col("how") == "partial", LEAST_PART).otherwise(LEAST))
    return own.join(sure.unionByName(fit), "_a").select(name_id, title_id, "score", "how")
