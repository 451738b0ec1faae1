"""Sharding, fingerprints, quality rules, secrets, near duplicates against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from feedmine.llm import components, digest, gbt, quality, secret_scan, sharding, simhash


@pytest.fixture(params=["odd", "documents", "empty"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_sharding(spark, docs):
    got = sharding.shard_rows(docs, shards=7, points=16).collect()
    rows = docs.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    # Keys move only clockwise from full shards: one with room to spare keeps all its own keys.
    home = Counter(r["home_shard"] for r in got)
    for r in got:
        if r["shard"] != r["home_shard"]:
            assert home[r["home_shard"]] > sizes[r["home_shard"]] - 1


def test_walk_equals_key_by_key():
    rng = np.random.default_rng(2)
    for _ in range(50):
        shard_at = rng.integers(0, 4, 12).astype(np.int32)
        shard_at[:4] = range(4)
        counts = rng.integers(0, 9, 12)
        bounds = np.full(4, counts.sum() // 4)
        bounds[:counts.sum() % 4] += 1
        pieces = sharding.walk(counts, shard_at, bounds)
        held = np.zeros(4, int)
        for arc in range(12):
            own = sorted(p for p in pieces if p[0] == arc)
            assert [p[1] for p in own] == [0, *(p[2] for p in own)][:len(own)] and sum(p[2] - p[1] for p in own) == counts[arc]
        for _, lo, hi, shard, _ in pieces:
            held[shard] += hi - lo
        assert (held == bounds).all()
        # Whoever is not at home met only full shards on the way.
        for arc, lo, hi, shard, _ in pieces:
            passed = arc
            while shard_at[passed] != shard:
                assert held[shard_at[passed]] == bounds[shard_at[passed]]
                passed = (passed + 1) % 12


def in_id_order(rows):
    def key(r):
        text = r["text"] or ""
        return (r["doc_id"] is not None, r["doc_id"] or 0, text)
    return sorted(rows, key=key)


def test_fingerprints_and_edits(docs):
    got = digest.compare_with_edit(docs).collect()
    rows = in_id_order([r for r in docs.collect()])
    with_id = [r for r in rows if r["doc_id"] is not None]
    by_doc = Counter((r["doc_id"], len(r["text"] or ""), digest.fingerprint(r["text"])) for r in rows)
    assert Counter((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in got) == by_doc
    want = Counter()
    # Rows without id come first, in an order of their own; the last document is followed by one of them.
    for r, after in zip(with_id, with_id[1:], strict=False):
        text, following = r["text"] or "", after["text"] or ""
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        a, b, c = digest.fingerprint(text), digest.fingerprint(edited), digest.fingerprint(following)
        want[r["doc_id"], hashlib.sha256(edited.encode()).hexdigest(), a, b, digest.likeness(a, b), digest.likeness(a, c)] += 1
    shown = Counter((r["doc_id"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got)
    assert not want - shown
    if len(with_id) == len(rows) and rows:
        last = next(r for r in got if r["doc_id"] == rows[-1]["doc_id"])
        assert last["near_next"] == digest.likeness(last["fingerprint"], digest.fingerprint(rows[0]["text"]))


def test_likeness_separates():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)]
    for a, b in zip(texts, texts[1:], strict=False):
        near = digest.likeness(digest.fingerprint(a), digest.fingerprint(a[:len(a) * 3 // 4] + b[:len(a) // 4]))
        assert 0 <= digest.likeness(digest.fingerprint(a), digest.fingerprint(b)) < near < 1
    assert digest.difference(digest.fingerprint(""), digest.fingerprint("abc")) <= digest.BOUND
    assert digest.likeness(digest.fingerprint("ab"), digest.fingerprint("ab")) == 1


def brute_counts(data):
    """Triplet by triplet with Python's integers; a triplet is its window's first byte and two others of the window."""
    counts = [0] * 128
    for at in range(len(data) - 4):
        for k, (i, j) in enumerate(((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))):
            h = (data[at] * 0x9E3779B1 + data[at + i] * 0x85EBCA77) & 0xFFFFFFFF
            h ^= h >> 15
            h = (h + data[at + j] * 0xC2B2AE3D + k * 0x165667B1) & 0xFFFFFFFF
            counts[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    return counts


def brute_digest(text):
    data = (text or "").encode()
    if len(data) < 5:
        return "0000" + hashlib.sha256(data).hexdigest()
    counts = brute_counts(data)
    ranked = sorted(counts)
    q = ranked[31], ranked[63], ranked[95]
    codes = [sum(c > x for x in q) for c in counts]
    length = min(255, int(np.log2(len(data)) * 8))
    ratios = [min(15, 16 * x // max(1, q[2])) if x < q[2] else 15 for x in q[:2]]
    digits = "".join(f"{codes[k] << 2 | codes[k + 1]:x}" for k in range(0, 128, 2))
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{digits}"


def brute_difference(a, b):
    total = 0
    for x, y in zip(a[4:], b[4:], strict=True):
        x, y = int(x, 16), int(y, 16)
        for s in (abs((x >> 2) - (y >> 2)), abs((x & 3) - (y & 3))):
            total += 6 if s == 3 else s
    total += min(16, abs(int(a[:2], 16) - int(b[:2], 16)))
    total += sum(min(4, abs(int(a[k], 16) - int(b[k], 16))) for k in (2, 3))
    return min(256, total)


def test_digest_against_plain_python(documents, monkeypatch):
    texts = ["", "a", "abcd", "abcde", "é漢字 text", "x" * 300, *[r["text"] for r in documents.limit(25).collect()]]
    monkeypatch.setattr(digest, "SLICE", 64)
    prints = [digest.fingerprint(t) for t in texts]
    assert prints == [brute_digest(t) for t in texts]
    for a, b in zip(prints, prints[1:], strict=False):
        assert digest.difference(a, b) == brute_difference(a, b)


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


def test_quality_statistics(docs):
    forest = gbt.Forest(5.0, 3)
    got = quality.judge(docs, forest).collect()
    want = Counter()
    for r in docs.collect():
        c = brute_statistics(r["text"])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want[(r["doc_id"], *c, failed, not failed)] += 1
    names = ["doc_id", *quality.COUNTS, "base_failed", "kept"]
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    kept = Counter((r["doc_id"], r["text"]) for r in quality.keep_good(docs, forest).collect())
    assert sum(kept.values()) == sum(n for k, n in want.items() if k[-1])


def test_quality_trees_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    forest = quality.train_rules(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, forest).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in held)
    assert right / len(held) > 0.99
    assert sum(not r["kept"] and r["quality"] == 1 for r in held) / len(held) < 0.005


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("equal", [True, False])
def test_trees_when_one_labelled_id_repeats(spark, label, equal):
    """Most rows on one id, more than the bound on rows: no other document leaves the training."""
    clean = "row {0} of the many that say something else again and which nobody would want to lose here today at all w{0} x{1}"
    noisy = "# $ % & | < > row {0} #### $$$$ %%%% &&&& |||| <<<< >>>> *** !!! ??? ### $$$ %%% w{0} x{1}"
    docs = [(i, (clean if i % 2 else noisy).format(i, i)) for i in range(1, 201)]
    hot = noisy if label == 0 else clean
    docs += [(0, hot.format(0, 0 if equal else k)) for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 201)] + [(0, label)], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    seen = []

    def train(x, y, monotone):
        seen.append((x, y))
        return gbt.train(x, y, monotone)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train", train)
        # 201 ids are chosen, then 40; at most twice as many rows.
        forest = quality.train_rules(table, labels, sample_rows=201)
        _, small = quality.train_rules(table, labels, sample_rows=40), seen[1]
    assert len(seen[0][1]) == (201 if equal else 402) and (seen[0][1] != label).sum() == 100
    assert len(small[1]) <= 80 and set(small[1]) == {0.0, 1.0}
    kept = Counter(r["doc_id"] for r in quality.judge(table, forest).where("kept").collect())
    assert {i for i in kept if i} == {i for i in range(1, 201) if i % 2} and kept[0] == 300 * label


def test_training_rows_over_the_bound_are_dealt_by_document(spark):
    """30 documents of one text and one of 500, with room for 62: each document is there, the rest is the hot one's."""
    text = "row {0} of the many that say something else again and which nobody would want to lose here today at all w{0} x{1} "
    docs = [(i, text.format(i, i)) for i in range(1, 31)] + [(0, text.format(0, k) + "# " * (k % 5)) for k in range(500)]
    labels = spark.createDataFrame([(i, int(i > 0)) for i in range(31)], "doc_id long, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "train", lambda x, y, monotone: seen.append(y))
        quality.train_rules(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels, sample_rows=31)
    assert (seen[0] == 1).sum() == 30 and (seen[0] == 0).sum() == 32


def test_trees_without_labels(spark, documents, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (10**9, 0)], "doc_id long, quality int")
    for docs in (documents, empty):
        forest = quality.train_rules(docs, labels)
        assert not len(forest.roots) and forest.score(np.zeros((2, len(quality.FEATURES)))).min() >= 0.5


@pytest.mark.parametrize("label", [0, 1])
def test_labels_of_one_class_keep_all_that_pass_the_base_rules(spark, documents, label):
    forest = quality.train_rules(documents, documents.selectExpr("doc_id", f"{label} AS quality"))
    judged = quality.judge(documents, forest).collect()
    clean = Counter(r["doc_id"] for r in judged if not r["base_failed"])
    assert clean and Counter(r["doc_id"] for r in judged if r["kept"]) == clean
    assert all(r["score"] == 0.5 for r in judged)
    for least in (quality.LEAST_SCORE, 0.9):
        assert Counter(r["doc_id"] for r in quality.keep_good(documents, forest, least_score=least).collect()) == clean


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (np.sin(3 * x[:, 0]) - x[:, 0] + x[:, 1] + rng.normal(size=3000) > 0).astype(float)
    forest = gbt.train(x, y, {0: -1, 1: 1})
    for k, way in ((0, -1), (1, 1)):
        for row in x[:50]:
            line = np.tile(row, (200, 1))
            line[:, k] = np.linspace(-4, 4, 200)
            assert (np.diff(forest.score(line)) * way >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == (y > 0)).mean() > 0.75


def brute_spans(text):
    out = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, rule.flags):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_secrets(docs):
    want = Counter()
    for r in docs.collect():
        spans = brute_spans(r["text"] or "")
        names = [f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in spans]
        base = [n for n in names if n.split(":")[0] in ("assign", "access", "hex")]
        of = lambda kind, b=base: sum(x.startswith(kind) for x in b)
        want[r["doc_id"], of("assign"), of("access"), of("hex"), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(names)] += 1
    assert Counter(map(tuple, secret_scan.span_digests(docs).collect())) == want


def test_secret_index_loses_nothing():
    rng = np.random.default_rng(9)
    parts = ["password", "PassWD", "toKen", "api_key", "APIKEY", " ", "=", ":", '"', "AKIA", "abcdef0123456789", "Zz9", "ghp_", "é", "ſecret",
             "x" * 40, "eyJ", ".", "xoxb-", "sk_live_", "-----BEGIN RSA PRIVATE KEY-----", "://", "@", "user"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 20))) for _ in range(3000)]
    assert secret_scan.scanner(secret_scan.RULES).scan(texts) == [brute_spans(t) for t in texts]


def test_trigram_queries():
    flat = lambda p: [{frozenset(o) for o in e} for e in secret_scan.trigram_query(p)]
    assert flat("abcd+") == [{frozenset({"abc"})}]
    assert flat("(foo|bar)x") == [{frozenset({"foo", "oox"}), frozenset({"bar", "arx"})}]
    assert flat("[0-9a-f]+") == [] and flat("ab?") == []


def test_masking(docs):
    before, after = docs.collect(), secret_scan.mask_secrets(docs).collect()
    want = Counter()
    for r in before:
        spans = brute_spans(r["text"] or "")
        text, n = r["text"], r["n_chars"]
        if spans:
            hidden = {i for s, _, e in spans for i in range(s, e)}
            starts = {s for s, _, _ in spans if s - 1 not in hidden or any(e == s for _, _, e in spans)}
            text = "".join("[REDACTED]" if i in starts else "" if i in hidden else c for i, c in enumerate(text))
            n = len(text)
        want[r["doc_id"], text, n] += 1
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in after)
    assert got == want and docs.columns == (after[0].__fields__ if after else docs.columns)


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, cache={}):  # noqa: B006
    fps = [cache.setdefault(t, brute_fingerprint(t)) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= (label[i], label[j]) != (low, low)
            label[i] = label[j] = low
    return fps, label


def test_near_duplicates(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps, label = brute_components(rows)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = Counter((i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, label, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.schema.names == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(label))
    of = {}
    for (i, t), x in zip(rows, label, strict=True):
        of.setdefault((i, t), x)
    assert sorted(of[r["doc_id"], r["text"]] for r in kept) == sorted(set(label))
    for r in kept:
        x = of[r["doc_id"], r["text"]]
        assert r["doc_id"] == least.get(x)


def test_gray_index_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 2**63, 4, dtype=np.uint64)
        members = np.unique(np.array([np.bitwise_xor.reduce([base[rng.integers(4)], *(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5), dtype=np.uint64))])
                                      for _ in range(300)], np.uint64))
        bucket = np.sort(rng.integers(0, 3, len(members)))
        index = simhash.GrayIndex(members, bucket)
        got = {frozenset((int(index.members[i]), int(index.members[j]))) for a, b in index.links(2) for i, j in zip(a, b, strict=True)}
        want = {frozenset((int(x), int(y))) for i, x in enumerate(members) for j, y in enumerate(members[:i])
                if bucket[i] == bucket[j] and int(np.bitwise_count(x ^ y)) <= 2}
        assert got == want
    assert simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))


def test_gray_index_prunes_large_buckets(monkeypatch):
    """A bucket as large as those of 10**10 fingerprints, and a group of near copies with all their variants in it."""
    rng = np.random.default_rng(7)
    free = np.uint64((1 << 42) - 1)
    base = rng.integers(0, 2**42, dtype=np.uint64)
    near = [base ^ np.uint64(1 << i | 1 << j) for i in range(42) for j in range(i)]
    members = np.unique(np.concatenate([rng.integers(0, 2**42, 5000, dtype=np.uint64) & free, np.array(near, np.uint64)]))
    monkeypatch.setattr(simhash, "PAIRS", 1 << 19)
    index = simhash.GrayIndex(members, np.zeros(len(members), np.int64))
    found = sum(len(a) for a, _ in index.links(2))
    want = sum(int((np.bitwise_count(members[k + 1:] ^ m) <= 2).sum()) for k, m in enumerate(members))
    assert found == want and index.compared < 0.4 * len(members) ** 2


def test_simhash_search_over_task_blocks(spark, monkeypatch):
    """Buckets at the borders of search blocks, and pairs that differ in any two bits."""
    rng = np.random.default_rng(6)
    base = rng.integers(-2**63, 2**63, 60, dtype=np.int64)
    near = [int(b) ^ int(np.int64(np.uint64(1 << i | 1 << j))) for b in base[:30] for i, j in [rng.integers(0, 64, 2).tolist()] if i != j]
    fps = sorted({*map(int, base), *near})
    monkeypatch.setattr(simhash, "SEARCH_ROWS", 50)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(df).collect()}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                assert roots[a] == roots[b]
    assert len(set(roots.values())) == 60


@pytest.mark.parametrize("n", [2, 61, 200])
def test_components_of_long_chains(spark, n):
    rng = np.random.default_rng(n)
    names = rng.permutation(n * 3)[:n].tolist()
    links = [(names[k], names[k + 1]) for k in range(n - 1)] + [(names[0], names[0]), (1000, 1001), (1001, 1000)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(names, min(names)), 1000: 1000, 1001: 1000}


def test_components_of_nothing(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []
