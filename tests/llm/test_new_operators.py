"""Operators 11 to 13 against brute force and known answers."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import centroids, outliers, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows):
    df = spark.createDataFrame([(*r, *(["en", "s"][len(r) - 2 :] if len(r) < 4 else ())) for r in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("t", "w", "h", "runs", "n", "k", "g", "x1", "m1", "n_words", "start", "v")})


# ------------------------------------------------------------------ op 11


def plain_runs(w, min_length=6, min_exponent=4):
    """Every period tried at every place."""
    found, n = {}, len(w)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and j > i:
                found.setdefault((i, j + q - i), q)  # the smallest period of this extent comes first
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(min_length, min_exponent * q)), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    n, kinds = rng.randrange(0, 60), rng.choice([1, 2, 3, 8])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(2, 9)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


@pytest.mark.parametrize("least", [(2, 2), (6, 4), (5, 3)])
@pytest.mark.parametrize("group", [1, 40, 1 << 16])
def test_runs_are_those_of_all_periods_at_all_places(monkeypatch, least, group):
    import pyarrow as pa

    monkeypatch.setattr(periodic_runs, "GROUP", group)
    rng = random.Random(group)
    texts = [repetitive(rng) for _ in range(150)]
    runs, rest = periodic_runs._runs_of_batch(pa.array([" ".join(t) for t in texts]), *least)
    for words, found, left in zip(texts, runs, rest, strict=True):
        want = plain_runs(words, *least)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert left == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    plain = periodic_runs.word_parts
    monkeypatch.setattr(periodic_runs, "word_parts", lambda *a, **k: ((h % np.uint64(2), b, e) for h, b, e in plain(*a, **k)))
    rng = random.Random(3)
    texts = [repetitive(rng) for _ in range(60)]
    runs, _ = periodic_runs._runs_of_batch(pa.array([" ".join(t) for t in texts]), 6, 4)
    assert [[(r["start"], r["length"], r["period"]) for r in found] for found in runs] == [plain_runs(t) for t in texts]


def planted(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_digests_of_planted_documents(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (None, "a a a a a a a b"), (503, "\x0bx\x0cx\rx x  x\nx y"), (504, "é é é é é é Z"), (503, "repeated id")]
    rows += [(600, " ".join(rng.choice(["a b c", "d"]) for _ in range(9000))), (601, "same " * 20000)]
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.plant_runs(documents(spark, rows)).withColumn("runs", F.lit(1))))
    want = []
    for doc_id, text in rows:
        w = planted(doc_id, text)
        runs = plain_runs(w) if len(w) < 5000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(w) if i not in gone).encode()).hexdigest()))
    got = [tuple(r) for r in found.collect()]
    assert sorted((r for r in got if r[0] not in (600, 601)), key=str) == sorted(want, key=str)
    assert next(r for r in got if r[0] == 601)[1:5] == (1, 0, 20000, 1)
    assert periodic_runs.periodic_runs(documents(spark, rows).limit(0)).collect() == []


# ------------------------------------------------------------------ op 12


def test_clusters_are_those_of_full_distances(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 64)) * np.linspace(2, 0.01, 64), 3).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(7, x[7].tolist(), "x"), (None, x[9].tolist(), "x")]
    odd = [(900, None, "x"), (901, [1.0] * 63, "x"), (902, [float("nan")] * 64, "x"), (903, [1.0] * 63 + [None], "x"), (904, [float("inf")] * 64, "x"), (905, [], "x")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v string").repartition(7)
    got = sorted((tuple(r) for r in centroids.cluster_vectors(frame).collect()), key=str)
    q = np.floor(np.array([r[1] for r in rows]) * 1024).astype(object)
    order = sorted((i for i in range(len(rows)) if rows[i][0] is not None), key=lambda i: (hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), q[i].tolist()))
    c = [list(q[i]) for i in order[:8]]
    for turn in range(11):
        d = np.array([[int(((v - np.array(m, dtype=object)) ** 2).sum()) for m in c] for v in q])
        who = d.argmin(1)
        if turn < 10:
            c = [[int(s) // int((who == j).sum()) for s in q[who == j].sum(0)] if (who == j).any() else c[j] for j in range(8)]
    best = d.min(1)
    inertia = {j: int(best[who == j].sum()) for j in range(8)}
    digest = [hashlib.sha256(",".join(str(int(y)) for y in m).encode()).hexdigest() for m in c]
    want = [(r[0], int(who[i]), int(best[i]), inertia[who[i]], int(best.sum()), digest[who[i]]) for i, r in enumerate(rows)]
    assert got == sorted(want, key=str)
    few = centroids.cluster_vectors(frame.where("vec_id < 3")).collect()
    assert len(few) == 3 and {r.distance for r in few} == {0}
    assert centroids.cluster_vectors(frame.where("vec_id > 800")).collect() == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r.cluster for r in centroids.cluster_vectors(huge).collect()) == [0, 1]


def test_ties_go_to_the_smaller_number_and_losers_leave_early():
    c = np.array([[0] * 64, [2] * 64, [0] * 64, [50] * 64])
    who, d = centroids.nearest(np.array([[1] * 64, [2] * 64, [0] * 64]), c)
    assert who.tolist() == [0, 1, 0] and d.tolist() == [64, 0, 0]


# ------------------------------------------------------------------ op 13


def statistics(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), len(lines) - len(set(lines)), len(covered)


def fit(x, h_share=0.75):
    """The estimate of one group in numpy, by the same rule for the share."""
    unit, floors = outliers.UNIT, np.diag(np.square(outliers.FLOORS))

    def estimate(rows, scale=1.0):
        mean = rows.mean(0)
        return mean, scale * (rows.T @ rows / len(rows) - np.outer(mean, mean)) / unit**2 + floors

    def distance(mean, cov):
        z = (x - mean) / unit
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)

    lower = lambda v: np.sort(v, axis=0)[(len(v) - 1) // 2]
    middle = lower(x)
    ends = []
    for mean, cov in (estimate(x), (middle, np.diag(np.square(1.4826 * lower(np.abs(x - middle)) / unit)) + floors)):
        for _ in range(outliers.STEPS):
            bins = np.floor(outliers.BINS * np.log(distance(mean, cov) + 1e-6))
            need = int(np.ceil(h_share * len(x)))
            mean, cov = estimate(x[bins <= np.sort(bins)[need - 1]])
        ends.append((np.linalg.det(cov), mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    mean, cov = estimate(x[distance(mean, cov) <= outliers.INNER * outliers.CONSISTENT_RAW], outliers.CONSISTENT)
    return distance(mean, cov)


def prose(rng, n, symbols=0.0):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12)) if not symbols else " ".join(w + ("#$|" if rng.random() < symbols else "") for w in words)


def test_statistics_rules_and_distances(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(10, 300)), "en", f"s{i % 3 if i % 4 else 9}") for i in range(260)]
    rows += [(300 + i, prose(rng, 80, symbols=0.9), "en", "s1") for i in range(12)]
    rows += [(400 + i, prose(rng, rng.randrange(10, 99)), "de", "s1") for i in range(20)] + [(430, prose(rng, 50), None, None)]
    line = prose(rng, 12)
    rows += [(500, None, "en", "s1"), (501, "", "en", None), (502, " \n\t", "en", "s1"), (503, "a b c", "en", "s1"), (504, "\n".join([line] * 9), "en", "s1"), (505, f"{prose(rng, 90)}\n{line}\n{prose(rng, 60)}\n {line}\n{line} ", "en", "s1")]
    rows += [(None, prose(rng, 40), "en", "s1"), (300, prose(rng, 80, symbols=0.9), "en", "s1"), (506, prose(rng, 30_000), "en", "s2"), (507, "x y z w v " * 3000, "en", "s2"), (508, "é" * 5 + " ü" * 11, "en", "s2")]
    found = outliers.reject_outliers(documents(spark, rows))
    assert found.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    stats = [statistics(r[1]) for r in rows]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats]
    passed = [i for i in range(len(rows)) if not failed[i]]
    sizes, pools = {}, {}
    for i in passed:
        sizes[rows[i][2:]] = sizes.get(rows[i][2:], 0) + 1
    for (lang, source), n in sizes.items():
        if n < outliers.LEAST_GROUP:
            pools[lang] = pools.get(lang, 0) + n
    group = {k: k if n >= outliers.LEAST_GROUP else (k[0],) if pools[k[0]] >= outliers.LEAST_GROUP else () for k, n in sizes.items()}
    assert len(set(group.values())) >= 3
    far = {}
    for g in set(group.values()):
        own = [i for i in passed if group[rows[i][2:]] == g]
        x = np.array([[np.log(n), np.log(c / n), np.log1p(100 * s / c), np.log1p(10 * r / n), np.log1p(d)] for n, c, s, d, r in (stats[i] for i in own)])
        far |= dict(zip(own, fit(np.floor(outliers.UNIT * x + 0.5)), strict=True))
    want = sorted(((r[0], *stats[i], failed[i], i in far and far[i] <= outliers.CUTOFF, far.get(i)) for i, r in enumerate(rows)), key=str)
    for a, b in zip(sorted(got, key=lambda r: (str(r[:7]), str(r[7]))), sorted(want, key=lambda r: (str(r[:7]), str(r[7]))), strict=True):
        assert a[:8] == b[:8] and (a[8] is None) == (b[8] is None) and (a[8] is None or abs(a[8] - b[8]) < 1e-6 * max(1, b[8]))
    verdict = {r[0]: r[7] for r in got}
    assert not any(verdict[300 + i] for i in range(12)) and sum(verdict[i] for i in range(260)) >= 258


def test_outliers_of_no_or_few_documents(spark):
    assert outliers.reject_outliers(documents(spark, [(1, "x")]).limit(0)).collect() == []
    one = outliers.reject_outliers(documents(spark, [(1, " ".join(map(str, range(30)))), (2, "too short")])).collect()
    assert [(r.doc_id, r.kept, r.distance) for r in sorted(one)] == [(1, True, 0.0), (2, False, None)]
    assert outliers.reject_outliers(documents(spark, [(2, None)])).collect()[0].kept is False
    same = outliers.reject_outliers(documents(spark, [(i, " ".join(map(str, range(30)))) for i in range(80)])).collect()
    assert all(r.kept and r.distance < 1e-9 for r in same)
