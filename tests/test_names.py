"""Title matching against plain versions, and the table of scores."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import names, position, scores


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(row[j - 1], last[j])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(12))) for _ in "ab")
        assert names.common_length(a, b) == plain_common(a, b)


def test_similarities():
    assert names.ratio("abcd", "abce") == 75 and names.ratio("", "") == 100
    assert names.token_sort("new york mets", "mets york new") == 100
    assert names.token_set("mariners vs angels", "los angeles angels of anaheim at seattle mariners vs") == 100
    assert names.token_set("a b", "a c") == pytest.approx(max(names.ratio("a b", "a c"), names.ratio("a", "a b")))
    assert names.partial("forest", "savanna forest land") == 100 and names.partial("abcx", "zzabcd") == 75
    assert names.partial("", "a") == 0 and names.token_set("", "a") == 0


def spoiled(rng, name):
    i = rng.randrange(len(name))
    return rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("abcdefgh") + name[i:]])


def test_title_matches_and_their_recall(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("bcdfglmnprst" + "aeiou" * 2, k=rng.randrange(4, 10))) for _ in range(160)]
    titles = sorted({" ".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(220)})
    asked = [rng.choice(titles) for _ in range(20)]
    asked += [spoiled(rng, rng.choice(titles)) for _ in range(60)] + [t.replace(" ", "") for t in rng.sample(titles, 10)]
    asked += [" ".join(rng.sample(t.split(), len(t.split()))) for t in rng.sample(titles, 20)] + [f"{t} of {rng.choice(words)}" for t in rng.sample(titles, 20)] + ["qqqq", "", None]
    a = spark.createDataFrame(list(enumerate(asked)), "id int, n string")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] + [(900, titles[0]), (901, "")], "tid int, t string")
    got = {r.id: (r.tid, r.score, r.how) for r in names.title_matches(a, b, "n", "t", "id", "tid").collect()}
    order = {h: k for k, h in enumerate(names.SCORERS)}
    found = wanted = 0
    for i, n in enumerate(asked):
        if not n:
            assert i not in got
            continue
        if n in titles:
            assert got[i] == (titles.index(n), 100.0, "exact")
            continue
        tight = [k for k, t in enumerate(titles) if t.replace(" ", "") == n.replace(" ", "")]
        if tight:
            assert got[i] == (tight[0], 100.0, "no space")
            continue
        s, _, k, how = min((-s, order[h], k, h) for k, t in enumerate(titles) for s, h in [names.best_score(n, t)])
        if -s >= (names.LEAST_PART if how == "partial" else names.LEAST):
            wanted += 1
            found += got.get(i) == (k, pytest.approx(-s), how)
    assert wanted > 60 and found >= 0.98 * wanted
    assert names.title_matches(a.limit(0), b, "n", "t", "id", "tid").count() == 0


def test_candidates_have_the_share_of_trigrams(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab ", k=rng.randrange(1, 14))).strip() or "a" for _ in range(80)]
    a, b = sorted(set(texts[:40])), sorted(set(texts[40:]))
    grams = lambda t: {f"^{w}$"[i : i + 3] for w in t.split() for i in range(len(w))}
    want = {(x, y) for x in a for y in b if len(grams(x) & grams(y)) >= max(1, int(min(len(grams(x)), len(grams(y))) * names.SHARED))}
    got = names.candidates(spark.createDataFrame([(x,) for x in a], "_a string"), spark.createDataFrame([(y,) for y in b], "_b string"))
    assert {(r._a, r._b) for r in got.collect()} == want


def test_scores_are_refreshed_where_values_changed(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    df = spark.range(60).select("id", (F.col("id") * 7 % 13).cast("double").alias("x"), F.when(F.col("id") % 5 != 0, F.col("id") * 3.0).alias("y"))
    rows = lambda d: sorted((r.id, r.variable, r.raw if r.raw is not None else -1, r.score if r.score is not None else -1) for r in d.collect())
    got, anew = scores.refreshed(df, "id", ["x", "y"], path)
    assert anew == ["x", "y"] and rows(got) == rows(position.scores_long(df, "id", ["x", "y"]))
    got, anew = scores.refreshed(df.repartition(7), "id", ["y", "x"], path)
    assert anew == [] and rows(got) == rows(position.scores_long(df, "id", ["x", "y"]))
    changed = df.withColumn("x", F.when(F.col("id") == 3, 99.0).otherwise(F.col("x")))
    got, anew = scores.refreshed(changed, "id", ["x", "y"], path)
    assert anew == ["x"] and rows(got) == rows(position.scores_long(changed, "id", ["x", "y"]))
    # the earlier values are still there, and a run that was lost before its manifest row counts for nothing
    assert scores.refreshed(df, "id", ["x"], path)[1] == []
    spark.createDataFrame([(1, 5.0, 1.0)], "id long, raw double, score double").withColumns({"variable": F.lit("z"), "version": F.lit("begun")}).write.mode("append").partitionBy("variable", "version").parquet(f"{path}/scores")
    got, anew = scores.refreshed(df.withColumn("z", F.col("y")), "id", ["z"], path)
    assert anew == ["z"] and got.count() == 60
