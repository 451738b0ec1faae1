"""The similarity join of D4: its filters lose no pair and drop nearly all unlike ones before sets are shuffled."""

import itertools
import math
import random

from feedmine.operators import rollup as ru


def test_few_candidates_in_buckets_of_unlike_sets(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    sets = [frozenset(rng.sample(vocabulary, rng.randint(10, 24))) for _ in range(240)]
    for k in range(10):  # near copies: one word exchanged
        base = sorted(sets[k])
        sets.append(frozenset([*base[1:], f"x{k % 3}"]))
    items = spark.createDataFrame([(i, "c", " ".join(sorted(s))) for i, s in enumerate(sets)], "ordinal long, category string, text string")
    hashed = ru.F.array_sort(ru.F.transform(ru.shingles_from_words(ru.words_of(ru.F.col("text")), 1), lambda x: ru.F.xxhash64(x)))
    nodes = items.select(ru.F.col("ordinal").alias("node"), ru.F.col("category").alias("grp"), hashed.alias("sh"))
    threshold = 0.7
    buckets = ru.materialize(ru._prefix_buckets(nodes, threshold))
    alone = nodes.select("node", ru.F.col("node").alias("label"))  # no component found yet
    candidates = {(r["a"], r["b"]) for r in ru._mixed_pairs(buckets, alone, threshold, 4).collect()}
    candidates = {(min(p), max(p)) for p in candidates}

    members = {}
    for r in buckets.collect():
        members.setdefault(r["token"], []).append(r["node"])
    meeting = {(min(p), max(p)) for m in members.values() for p in itertools.combinations(m, 2)}
    alike = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold}
    assert len(alike) >= 10 and alike <= candidates <= meeting
    assert len(candidates) <= 3 * len(alike) < len(meeting) / 100

    label = list(range(len(sets)))
    for i, j in sorted(alike):
        a, b = label[i], label[j]
        label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r["ordinal"]: r["rep"] for r in ru.merge_similar(items, threshold=threshold, n=1).collect()}
    assert got == dict(enumerate(label))


def test_similar_sizes_lie_in_neighbouring_bands():
    for threshold in (0.5, 0.7, 0.9):
        width = -math.log(threshold) * (1 + 1e-6)
        for large in range(1, 2000):
            small = math.ceil(threshold * large - 1e-9)
            assert math.floor(math.log(large) / width) - math.floor(math.log(small) / width) <= 1


def test_each_text_is_normalised_once_and_shingles_are_shuffled_once(spark):
    items = spark.createDataFrame([(i, "c", f"one two three four w{i % 3}") for i in range(9)], "ordinal long, category string, text string")
    plan = ru.exact_groups(items)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan  # kept before its join reads it from both sides
    sets = ru.materialize(items.select(ru.F.col("ordinal").alias("node"), ru.F.col("category").alias("grp"), ru.F.array_sort(
        ru.F.transform(ru.shingles(ru.F.col("text")), lambda x: ru.F.xxhash64(x))).alias("sh")))
    plan = ru._prefix_buckets(sets, 0.7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_only_large_buckets_are_copied(spark, monkeypatch):
    monkeypatch.setattr(ru, "SALT_ROWS", 5)
    rows = [("a", 1, i) for i in range(40)] + [(None, 2, i) for i in range(3)]
    members = spark.createDataFrame(rows, "grp string, token long, node long")
    other = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "grp string, token long, c string")
    copied = []
    join = ru.join_small
    monkeypatch.setattr(ru, "join_small", lambda *a, **k: copied.append(join(*a, **k)) or copied[-1])
    got = sorted((r["token"], r["node"], r["c"]) for r in ru._bucket_join(members, other, 4).collect())
    assert got == sorted((t, n, {1: "x", 2: "y"}[t]) for _, t, n in rows)
    assert {r["token"]: r["_salts"] for r in copied[1].collect()} == {1: 4, 2: None}


def test_shingle_sets_are_those_of_the_words(spark):
    texts = ["a b c d", "A  b, c-d!", "a b", None, "", "   a b c a b c a b c", "x y z", "é \u0085ü ß ٣ a b"]
    items = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    words = items.select("node", ru.words_of(ru.F.col("text")).alias("w"),
                         ru.F.coalesce(ru.F.transform(ru.words_of(ru.F.col("text")), lambda w: ru.F.xxhash64(w)), ru.F.array()).alias("words"))
    rows = {r["node"]: r for r in ru._shingle_sets(words, 3).collect()}
    named = {k: {tuple(r["w"][i:i + 3]) for i in range(len(r["w"]) - 2)} if r["w"] else set() for k, r in rows.items()}
    assert [len(named[k]) for k in range(8)] == [2, 2, 0, 0, 0, 3, 1, 4]
    for k, r in rows.items():
        assert r["sh"] == sorted(set(r["sh"])) and len(r["sh"]) == len(named[k])
    for i in rows:
        for j in rows:
            assert len(set(rows[i]["sh"]) & set(rows[j]["sh"])) == len(named[i] & named[j])
