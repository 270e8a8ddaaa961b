"""Every operator against brute force or known answers, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, decontamination, jaccard_join, language_id, license_scan, quality, source_mixing, textkit, token_counts, toxicity, url_filter
from quillon.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra=False):
    """Rows of (doc_id, text[, lang[, source]]); ``extra`` adds columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    clashing = ("node", "n", "label", "score", "tokens", "key", "bin", "size", "held_out", "token", "rank", "i", "part")
    return df.withColumns({c: F.lit("x") for c in clashing}) if extra else df


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ words


def test_words_are_hashed_alike_wherever_they_are_cut(monkeypatch):
    import pyarrow as pa

    texts = ["Ab cd", None, "", " \t", "ab\x0bCD ab", "É é", "x" * 300 + " y", "a\x00b"]
    data, at = textkit.text_bytes(pa.array(texts))
    whole = textkit.hash_words(data, at)
    monkeypatch.setattr(textkit, "SEGMENT", 7)
    cut = textkit.hash_words(data, at)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    words = [w for t in texts for w in WORD.findall(lower(t or ""))]
    assert len(words) == len(whole[0]) and len(set(words)) == len(set(whole[0].tolist()))
    ids = {}
    assert all(ids.setdefault(w, h) == h for w, h in zip(words, whole[0].tolist(), strict=True))


def test_offset_slices_of_arrow_columns():
    import pyarrow as pa

    column = pa.array(["zzz", "a b", "c"]).slice(1)
    assert len(textkit.hash_words(*textkit.text_bytes(column))[0]) == 3


# ------------------------------------------------------------------ op 9


def brute_components(rows, k=5):
    sets = {}
    for i, r in enumerate(rows):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    least = {i: min((rows[m][0] for m in g if rows[m][0] is not None), default=None) for g in groups.values() for i in g}
    return sorted(((r[0], len(sets[i]), least[i]) for i, r in enumerate(rows)), key=str)


def near_copies(rng, count):
    rows, base = [], [prose(rng, n) for n in (8, 30, 120, 300)]
    passage = prose(rng, 60)
    for i in range(count):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(3000)}"
        rows.append((i, " ".join(words)))
    rows += [(count + i, prose(rng, 40) + " " + passage + " " + prose(rng, rng.randrange(1, 30))) for i in range(40)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"HOT_FROM": 2, "HUBS": 1, "BLOCK": 3, "SEARCHES": 4, "CHUNK": 500}, {"BROADCAST_NODES": 0, "HOT_TOKENS": 1}])
def test_components_are_those_of_all_pairs(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(5)
    rows = near_copies(rng, 120) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "a b c d"), (906, "a b c d e"), (None, "one two"), (903, "One two")]
    long = prose(rng, 30_000)
    rows += [(950, long), (951, long + " end")]
    found = jaccard_join.jaccard_components(documents(spark, rows, extra=True).repartition(5))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(rows)


@pytest.mark.parametrize("settings", [{}, {"BROADCAST_NODES": 0}])
def test_a_near_copy_without_an_id_bridges_two_documents(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    words = [f"w{i}" for i in range(136)]
    rows = [(2, " ".join(words[:120])), (None, " ".join(words[8:128])), (1, " ".join(words[16:])), (None, " ".join(words[8:128])), (None, prose(random.Random(1), 50)), (None, "z y x"), (None, None)]
    alone = [prose(random.Random(2), 60)]
    rows += [(None, alone[0] + end) for end in (" a", " b", " c")]
    found = jaccard_join.jaccard_components(documents(spark, rows).repartition(3)).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_components(rows)
    assert sorted(r.component_id for r in found if r.n_shingles == 116) == [1] * 4


def test_components_of_nothing(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    only_empty = jaccard_join.jaccard_components(documents(spark, [(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in only_empty) == [(1, 0, 1), (2, 0, 2)]


def test_divide_skip_counts_like_a_scan():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(20), rng.randrange(0, 15))) for _ in range(rng.randrange(1, 12))]
        t = rng.randrange(1, 12)
        want = {e: n for e in range(20) if (n := sum(e in x for x in lists)) >= t}
        assert jaccard_join.divide_skip(lists, t) == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 1)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ op 5


def brute_tiles(item, text, least):
    a, b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and a[p + n] and b[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, t, n)
        if best is None:
            return tiles
        p, t, n = best
        for i in range(n):
            a[p + i] = b[t + i] = False
        tiles.append(best)


def test_tiles_are_those_of_the_plain_loop():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item, text = rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)
        got, want = decontamination.greedy_tiles(item, text, 3), brute_tiles(item.tolist(), text.tolist(), 3)
        assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_contamination(spark, limit):
    rng = random.Random(6)
    items = [prose(rng, 40), prose(rng, 30), "only three words", "", None]
    halves = items[0].split()
    rows = [
        (1, prose(rng, 200) + " " + items[0].upper().replace(" ", ",\n") + " " + prose(rng, 50)),
        (2, " ".join(halves[20:]) + " " + prose(rng, 30) + " " + " ".join(halves[:20])),
        (3, prose(rng, 500)),
        (4, " ".join(halves[:12])),
        (5, "x only three words y"),
        (6, None),
        (7, ""),
        (8, prose(rng, 40_000) + " " + items[1]),
        (1, prose(rng, 5) + " " + items[0]),
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = decontamination.contaminated_pairs(documents(spark, rows, extra=True), bench, broadcast_words=limit)
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in found.collect())
    assert got == [(1, 0, 1.0, 1), (1, 0, 1.0, 1), (2, 0, 1.0, 2), (5, 2, 1.0, 1), (8, 1, 1.0, 1)]
    per_doc = {r.doc_id: r.item_ids for r in decontamination.contaminated_documents(found).collect()}
    assert per_doc == {1: [0], 2: [0], 5: [2], 8: [1]}
    assert decontamination.contaminated_pairs(documents(spark, []), bench, broadcast_words=limit).count() == 0
    assert decontamination.contaminated_pairs(documents(spark, rows), bench.limit(0), broadcast_words=limit).count() == 0


def test_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    """Both ways agree, whatever the filter's size, with a seed that a third of all documents and many items share."""
    rng = random.Random(16)
    common = prose(rng, 12)
    items = [(i, common + " " + prose(rng, 20) if i % 2 else prose(rng, rng.choice([2, 4, 30]), 60)) for i in range(40)] + [(None, "alpha beta gamma delta epsilon"), (7, items7 := prose(rng, 25)), (7, items7)]
    rows = [(i, prose(rng, 80) + (" " + common if i % 3 == 0 else "") + (" " + items[i % 40][1] if i % 5 == 0 else "")) for i in range(150)] + [(None, "x alpha beta gamma delta epsilon y"), (3, items7), (3, items7), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tell = lambda df: sorted((tuple(r)[:6] for r in df.collect()), key=str)
    held = tell(decontamination.contaminated_pairs(documents(spark, rows), bench))
    assert len(held) > 30
    for bits, part in ((27, 19), (16, 10)):
        monkeypatch.setattr(decontamination, "FILTER_BITS", bits)
        monkeypatch.setattr(decontamination, "PART_BITS", part)
        assert tell(decontamination.contaminated_pairs(documents(spark, rows), bench, broadcast_words=0)) == held


# ------------------------------------------------------------------ op 1


def brute_count(word, vocabulary):
    best = [(0, 0)]
    for i in range(1, len(word) + 1):
        options = [(best[s][0] + vocabulary.costs[word[s:i]], best[s][1] + 1) for s in range(max(0, i - vocabulary.longest), i) if word[s:i] in vocabulary.costs]
        if word[i - 1] not in vocabulary.costs:
            n = len(word[i - 1].encode())
            options.append((best[i - 1][0] + n * vocabulary.byte_cost, best[i - 1][1] + n))
        best.append(min(options))
    return best[-1][1]


def test_token_counts_are_those_of_each_word_alone(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_DEPTH", 20)
    vocabulary = token_counts.zipf_vocabulary(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "abab", "c", "▁b", "é"])
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("abcdé€", k=rng.randint(1, 12))) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "ab" * 500), (None, "ab ab"), (104, "ab ab"), (104, "ab ab")]
    found = token_counts.count_tokens(documents(spark, rows, extra=True), vocabulary)
    want = sorted(((i, len((t or "").split()), sum(brute_count("▁" + w, vocabulary) for w in (t or "").split())) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert token_counts.count_tokens(documents(spark, []), vocabulary).count() == 0
    monkeypatch.setattr(textkit, "SEGMENT", 16)
    monkeypatch.setattr(token_counts, "MAX_NODES", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    cut = token_counts._count_batches(lambda: vocabulary, "▁")(iter([batch]))
    assert sorted((tuple(r.values()) for b in cut for r in b.to_pylist()), key=str) == want


def test_public_vocabulary():
    pytest.importorskip("sentencepiece")
    import os

    if not os.path.exists(token_counts.VOCABULARY):
        pytest.skip("no vocabulary files here")
    trie = token_counts.TokenTrie(token_counts.load_vocabulary())
    assert trie.count("▁the") == 1 and trie.count("▁") == 1 and trie.count("▁zqxjk") > 2


# ------------------------------------------------------------------ op 2


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BINS", 1)
    monkeypatch.setattr(source_mixing, "FINER", 3)
    rng = random.Random(8)
    sources = {"a": 30, "b": 200, "c": 10, None: 5, "d": 60, "e": 0}
    rows, n = [], 0
    for source, count in sources.items():
        for _ in range(count):
            rows.append((n, prose(rng, rng.randint(1, 80)), "en", source))
            n += 1
    rows += [(n, None, "en", "a"), (n + 1, "", "en", "b"), (n + 2, " ", "en", "empty"), (0, rows[0][1], "en", "a"), (None, "x y z", "en", "a")]
    found = [r.asDict() for r in source_mixing.mix_sources(documents(spark, rows, extra=True)).collect()]
    assert len(found) == len(rows)
    total = sum(r["size"] for r in found)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {s: sum(r["size"] for r in found if r["source"] == s) for s in names}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    free, target = set(names), {}
    while True:  # water-filling, a source at a time
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in names:
        own = [r for r in found if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 1
        assert all(r["epochs"] * r["size"] <= r["taken"] <= min(3, r["epochs"] + 1) * r["size"] for r in own)
    again = source_mixing.mix_sources(documents(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.taken) for r in again) == sorted((r["doc_id"] is None, r["doc_id"], r["taken"]) for r in found)
    assert source_mixing.mix_sources(documents(spark, [])).count() == 0


@pytest.mark.parametrize("scale", [0.01, 1.0, 100.0, None])
def test_documents_are_drawn_by_ascending_key_whatever_the_weights(spark, monkeypatch, scale):
    """Few rows share the last bin at any scale of weights, and null, NaN and non-positive weights come last."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(1, 20)), "en", "ab"[i % 2]) for i in range(400)]
    odd = {3: None, 4: float("nan"), 5: -1.0, 6: 0.0}
    weights = {i: odd.get(i, None if scale is None else scale * rng.uniform(0.5, 1)) for i in range(400)}
    df = documents(spark, rows).join(spark.createDataFrame(list(weights.items()), "doc_id long, w double"), "doc_id")
    found = {r.doc_id: r for r in source_mixing.mix_sources(df, weight=F.col("w")).collect()}

    def key(i):
        import hashlib

        digest = hashlib.md5(f"42:{i}:{hashlib.md5(rows[i][1].encode()).hexdigest()}".encode()).hexdigest()
        u, w = (int(digest[:12], 16) + 0.5) / 2**48, weights[i]
        return (0, -math.log(u) / w, i) if w is not None and w > 0 else (1, -math.log(u), i)

    for source in "ab":
        mine = sorted((i for i in range(400) if rows[i][3] == source), key=key)
        first = found[mine[0]]
        left = round(first.target) - first.epochs * first.source_size
        for i in mine:
            size = found[i].size
            assert found[i].taken == found[i].epochs * size + max(0, min(size, left))
            left -= size


# ------------------------------------------------------------------ op 3


@pytest.mark.parametrize(("block", "queries"), [(4096, 4096), (50, 1)])
def test_neighbours(spark, monkeypatch, block, queries):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERIES", queries)
    monkeypatch.setattr(ann, "TRAVERSED", queries)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 800)] + 0.3 * rng.normal(size=(800, 8))).astype(np.float32).astype(float)
    x[300:420] = x[300]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (1005, []), (1100, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + [rows[5]], "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "i": F.lit(2), "label": F.lit(0)})
    found = ann.nearest_neighbours(df).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 800, 100))
    hits = 0
    for q, near in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(800), d))[:10]
        assert len(near) == 10 and all(math.isclose(s, d[v], abs_tol=1e-12) for v, s in near)
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
        hits += len({v for v, _ in near} & set(want.tolist()))
    assert hits >= 0.9 * 80
    assert [v for v, _ in got[300]] == list(range(301, 311))  # ties to the smaller id


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    three = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [2.0])], schema)
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(three).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 2.0)]
    assert ann.nearest_neighbours(three.limit(0)).count() == 0
    assert ann.nearest_neighbours(three.where("vec_id = 0")).count() == 0


def test_cells_are_traversed_by_their_sum():
    rng = np.random.default_rng(10)
    for _ in range(100):
        a, b, counts = rng.random(rng.integers(1, 6)), rng.random(rng.integers(1, 6)), None
        counts = rng.integers(0, 4, (len(a), len(b)))
        enough = int(rng.integers(1, 15))
        sums = (a[:, None] + b[None]).ravel()
        order = np.argsort(sums, kind="stable")
        reached = np.flatnonzero(np.cumsum(counts.ravel()[order]) >= enough)
        want = sums[order[reached[0]]] if len(reached) else float("inf")
        assert ann.traverse(a, b, counts, enough) == want


# ------------------------------------------------------------------ op 4


def test_url_parts_rules_and_hosts(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "https://A.Example.NET/en/x?q#f", ""),
        (2, "http://b.example.net/de/x", link("c.example.com")),
        (3, "http://c.example.com/de/1", ""),
        (4, "http://c.example.com/en/1", ""),
        (5, "http://d.example.com/en/1", link("b.example.net", "B.example.net")),
        (6, "http://e.org/fr/", link("f.example.com")),
        (7, "http://f.example.com", "<p>"),
        (8, "no scheme/net/", None),
        (9, None, None),
        (10, "http://net?x", ""),
        (11, "x://y://z.net/a", ""),
        (11, "x://y://z.net/a", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "verdict": F.lit(3)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("b.example.net", "/de/x", "net/", "block"),
        3: ("c.example.com", "/de/1", "example.com/de/", "block"),
        4: ("c.example.com", "/en/1", None, "allow"),
        5: ("d.example.com", "/en/1", None, "block"),
        6: ("e.org", "/fr/", "org/fr/", "allow"),
        7: ("f.example.com", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("net", "", None, "allow"),
        11: ("y:", "//z.net/a", None, "allow"),
    }
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_the_sql_twin_of_the_url_filter_over_links(spark, tmp_path):
    import duckdb

    rng = random.Random(15)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'example.com', 'org'])}" for i in range(60)]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['fr', 'de', 'x'])}/", "".join(f'<a href="http://{rng.choice(hosts)}/">' for _ in range(rng.randrange(4)))) for i in range(200)]
    rows += [(900, None, "<a href=//h1.com/>"), (901, "http://x.net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = ("page_id", "host", "path", "rule", "verdict")
    want = con.sql(f"select {', '.join(names)}, trust, distrust from ({url_filter.oracle()}) order by page_id").fetchall()
    got = [tuple(r) for r in url_filter.filter_urls(df).select(*names, "trust", "distrust").orderBy("page_id").collect()]
    assert [x[:5] for x in got] == [x[:5] for x in want] and {"allow", "block"} == {x[4] for x in got if x[3] is None}
    assert all(math.isclose(a, b, abs_tol=2e-9) for x, y in zip(got, want, strict=True) for a, b in zip(x[5:], y[5:], strict=True))


def test_trust_is_personalised_page_rank(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 2), ("c", "a", 1), ("d", "c", 3)]
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.5)}
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(spark.createDataFrame(edges, "source string, target string, n long"), spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), rounds=8).collect()}
    hosts = "abcd"
    for kind in (0, 1):
        w = {(s, t): n for s, t, n in edges} if kind == 0 else {(t, s): n for s, t, n in edges}
        out = {h: sum(n for (s, _), n in w.items() if s == h) for h in hosts}
        total = sum(v[kind] for v in seeds.values())
        base = {h: 0.15 * seeds.get(h, (0, 0))[kind] / total for h in hosts}
        score = dict(base)
        for _ in range(8):
            score = {h: base[h] + sum(0.85 * score[s] * n / out[s] for (s, t), n in w.items() if t == h) for h in hosts}
        for h in hosts:
            assert math.isclose(got.get(h, (0.0, 0.0))[kind], score[h], abs_tol=1e-12)


def test_verdicts_do_not_depend_on_seeds_elsewhere(spark):
    """mixed.com has 1/10 of a trusted host's links and is 1 of 5 linking to a blocked one, fair.com all of them and 1 of 5."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">y</a>' for h in hosts)
    rows = [(1, "http://bad.net/", ""), (2, "http://sends.com/", link("bad.net")), (3, "http://good.org/fr/", link("mixed.com", *(f"o{i}.com" for i in range(9)))), (4, "http://mixed.com/", link("bad.net")), (5, "http://fair.com/", link("bad.net"))]
    rows += [(6, "http://good2.org/fr/", link("fair.com")), (7, "http://far.com/", "")]
    rows += [(100 + i, f"http://many{i}.com/", link("bad.net")) for i in range(2)]

    def verdicts(more):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        for of, count in more.items():
            df = df.unionByName(spark.range(count).select((F.col("id") + 10_000).alias("page_id"), F.format_string(of, "id").alias("url"), F.lit("").alias("html")))
        return {r.page_id: r.verdict for r in url_filter.filter_urls(df).where("page_id < 10000").collect()}

    alone = verdicts({})
    assert alone == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 100: "block", 101: "block"}
    assert verdicts({"http://u%d.net/": 3000}) == alone
    assert verdicts({"http://u%d.org/fr/": 3000}) == alone


def test_a_popular_blocked_host_still_counts(spark):
    """100,000 hosts link to one of 2,000 blocked hosts: each has a distrust of 6e-10, and no trust."""
    pages = spark.range(2000).selectExpr("id as page_id", "concat('http://u', id, '.net/') as url", "'' as html")
    pages = pages.unionByName(spark.range(100_000).selectExpr("id + 10000 as page_id", "concat('http://h', id, '.com/') as url", "'<a href=http://u0.net/>' as html"))
    got = {(r.verdict, r.tiny): r["count"] for r in url_filter.filter_urls(pages).where("page_id >= 10000").groupBy("verdict", (F.col("distrust") < 1e-9).alias("tiny")).count().collect()}
    assert got == {("block", True): 100_000}


def test_distrust_reaches_hosts_of_any_depth(spark):
    rows = [(0, "http://c0.net/", "")] + [(i, f"http://c{i}.com/", f"<a href=http://c{i - 1}.{'com' if i > 1 else 'net'}/>") for i in range(1, 15)]
    got = {r.page_id: (r.verdict, r.distrust) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(verdict == "block" and math.isclose(d, 0.15 * 0.85**i, rel_tol=1e-9) for i, (verdict, d) in got.items()) and len(got) == 15


def test_spreading_ends_at_the_fixed_point(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 2), ("c", "a", 1), ("d", "c", 3)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.spread(spark.createDataFrame(edges, "source string, target string, n long"), spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 0.5)], "host string, trust double, distrust double")).collect()}
    for kind, seed in enumerate("ac"):
        m = np.zeros((4, 4))
        for s, t, n in edges:
            giver, taker = (s, t) if kind == 0 else (t, s)
            m["abcd".index(taker), "abcd".index(giver)] = n
        m /= np.maximum(m.sum(axis=0), 1)
        want = np.linalg.solve(np.eye(4) - 0.85 * m, 0.15 * np.array([h == seed for h in "abcd"]))
        assert all(math.isclose(got[h][kind], w, rel_tol=1e-8, abs_tol=1e-15) for h, w in zip("abcd", want, strict=True))


# ------------------------------------------------------------------ op 8


def test_licences_are_found_with_their_spans(spark):
    line = license_scan.TEMPLATES["Apache-2.0"]
    edited = "This work is licensed under a GNU General Public Licence, version 3."
    rows = [(1, f"Intro words here.\n{line}\nmore {license_scan.TEMPLATES['MIT']} end"), (2, edited), (3, "Licensed under nothing at all."), (4, None), (5, ""), (6, "w " * 50_000 + line), (1, line)]
    found = license_scan.scan_licenses(documents(spark, rows, extra=True)).collect()
    got = sorted((r.doc_id, r.license, round(r.coverage, 2), r.start_word) for r in found)
    assert got == [(1, "Apache-2.0", 1.0, 0), (1, "Apache-2.0", 1.0, 3), (1, "MIT", 1.0, 12), (2, "GPL-3.0", 0.83, 0), (6, "Apache-2.0", 1.0, 50_000)]
    first = next(r for r in found if r.license == "MIT")
    assert rows[0][1][first.start_char : first.end_char] == "Released under the MIT License"
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
    assert license_scan.scan_licenses(documents(spark, rows), {}).count() == 0


def test_adjacent_notices_are_all_found(spark):
    t = license_scan.TEMPLATES
    orders = [("CC-BY-NC-4.0", "CC-BY-4.0"), ("CC-BY-4.0", "CC-BY-NC-4.0"), ("CC-BY-SA-4.0", "CC-BY-4.0"), ("CC-BY-4.0", "CC-BY-SA-4.0"), ("MIT",) * 6, ("BSD-3-Clause", "MIT", "BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-4.0",) * 7, ("MIT-notice", "MIT-notice"), ("Apache-2.0",) * 4]
    orders += [(x, y, x) for x in ("MIT", "CC-BY-NC-4.0", "CC-BY-4.0", "BSD-3-Clause") for y in t]
    rows = [(i, " ".join(t[x] for x in names)) for i, names in enumerate(orders)]
    rows += [(1000, "\n".join(f"{t['MIT']} {'x ' * k}" for k in range(9)))]
    got = {}
    for r in sorted(license_scan.scan_licenses(documents(spark, rows)).collect(), key=lambda r: (r.doc_id, r.start_word)):
        assert r.coverage == 1.0
        got.setdefault(r.doc_id, []).append((r.license, r.end_word - r.start_word))
    size = {x: len(re.findall("[0-9A-Za-z]+", y)) for x, y in t.items()}
    assert got == {i: [(x, size[x]) for x in names] for i, names in enumerate([*orders])} | {1000: [("MIT", 5)] * 9}


def test_every_edit_that_coverage_allows_is_found(spark):
    """But for the words that tell licences apart, any words may be left out or changed as far as the coverage allows."""
    rows, want = [], {}
    for name, line in license_scan.TEMPLATES.items():
        words = re.findall("[0-9A-Za-z]+", line)
        spare = len(words) - math.ceil(0.8 * len(words) - 1e-9)
        plain = [i for i, w in enumerate(words) if not w.isdigit() and w.lower() not in license_scan.DECISIVE]
        for p in range(len(plain)):
            for put in ([], ["changed"]):
                edited = list(words)
                for x in sorted({plain[(p + i * len(plain) // spare) % len(plain)] for i in range(min(spare, len(plain)))}, reverse=True):
                    edited[x : x + 1] = put
                want[len(rows)] = name
                rows.append((len(rows), "zz yy xx ww " + " ".join(edited) + " vv uu tt"))
    for line in ("Released under MIT License", "Released under the terms of the MIT License", "Released now under then the same MIT free License"):
        want[len(rows)] = "MIT"
        rows.append((len(rows), line))
    got = {}
    for r in license_scan.scan_licenses(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    # A shorter template's words may be left in what another's edits keep: the header's first line, or a licence of one other word.
    like = {"MIT": "ISC", "Apache-2.0-header": "Apache-2.0"}
    missed = {i: (rows[i][1], x, got.get(i)) for i, x in want.items() if not {x, like.get(x, x), *(k for k, v in like.items() if v == x)} & set(got.get(i, []))}
    assert not missed


def test_relatives_of_a_licence_are_not_taken_for_it(spark):
    lines = {
        "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under a Creative Commons Attribution 3.0 License.": "CC-BY-3.0-notice",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.": "CC-BY-NC-4.0-notice",
        "Licensed under CC BY 1.0.": None,
        "This work is licensed under the GNU General Public License, version 7.": None,
        "This work is licensed under the GNU Library General Public License, version 3.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under CC BY-ND 9.0. under CC BY-ND 4.0": "CC-BY-ND-4.0",
        "Released under all the many old and new and other terms of the quite free MIT kind of License": None,
    }
    found = license_scan.scan_licenses(documents(spark, list(enumerate(lines)))).collect()
    assert {r.doc_id: r.license for r in found} == {i: x for i, x in enumerate(lines.values()) if x} and len(found) == sum(map(bool, lines.values()))


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def brute_scan(words, templates, coverage=0.8, density=0.5):
    """Every span against every template; the best is taken, and again with what is left."""
    told = lambda ws: [w for w in ws if w.isdigit() or w in license_scan.DECISIVE]
    options = []
    for name, line in templates.items():
        want = [w.lower() for w in re.findall("[0-9A-Za-z]+", line)]
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 2 * len(want)) + 1):
                span = words[i:j]
                if told(span) != told(want):
                    continue
                n = longest_common(want, span)
                if n >= coverage * len(want) and n >= density * len(span) and n > max(longest_common(want, span[1:]), longest_common(want, span[:-1])):
                    options.append((-n, -n / len(want), j - i, i, name, j))
    taken, out = set(), []
    for less, _, _, i, name, j in sorted(options):
        if not taken & set(range(i, j)):
            taken |= set(range(i, j))
            out.append((name, -less, i, j))
    return sorted(out)


def test_the_scan_is_that_of_all_spans(spark):
    rng = random.Random(31)
    names = ["CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-3.0", "MIT", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "Apache-2.0"]
    templates = {n: license_scan.TEMPLATES[n] for n in names}
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = re.findall("[0-9A-Za-z]+", templates[rng.choice(names)])
            if rng.random() < 0.6:
                p = rng.randrange(len(own))
                own[p : p + 1] = rng.choice([[], ["edited"], [own[p], "more"]])
            words += own + [f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 0, 1, 4, 12]))]
        rows.append((i, " ".join(words)))
    got = {i: [] for i, _ in rows}
    for r in license_scan.scan_licenses(documents(spark, rows), templates).collect():
        got[r.doc_id].append((r.license, r.matched_words, r.start_word, r.end_word))
    for i, text in rows:
        assert sorted(got[i]) == brute_scan(text.lower().split(), templates), text


def test_alignment_is_the_longest_common_subsequence_within_the_band():
    rng = random.Random(11)
    for _ in range(200):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        total, first, end = license_scan.align(np.array(a), np.array(b), 0, 12)
        assert total == table[-1][-1] and (not total or 0 <= first < end <= len(b))


def test_winnowing_keeps_the_least_of_every_window():
    h = np.array([5, 3, 9, 9, 1, 7], dtype=np.uint64)
    kept = license_scan.winnow(h, 2)
    assert all(any(i in kept and h[i] == min(h[j : j + 2]) for i in (j, j + 1)) for j in range(5))


# ------------------------------------------------------------------ ops 6, 7, 10


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def speech(rng, lang, n):
    parts = {"xx": ["ka", "lo", "mi", "ta"], "yy": ["sch", "ung", "ber", "ein"], "zz": ["ção", "que", "nha", "os"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(12)
    rows = [(i, speech(rng, lang, rng.randint(15, 60)), lang) for i in range(240) for lang in [rng.choice(["xx", "yy", "zz"])]]
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "123 !?", "yy"), (1003, speech(rng, "yy", 60_000), None), (None, speech(rng, "zz", 40), None), (5, rows[5][1], rows[5][2])]
    found = language_id.identify_languages(documents(spark, rows + odd, extra=True)).collect()
    assert len(found) == len(rows) + len(odd)
    said = {r.doc_id: r for r in found}
    assert all(said[i].held_out == (fold(i) == 2) for i, *_ in rows)
    held = [(said[i].lang_pred, lang) for i, _, lang in rows if fold(i) == 2]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [(said[i].lang_pred, said[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert said[1003].lang_pred == "yy" and said[None].lang_pred == "zz" and not said[None].held_out
    assert all(0 <= r.score <= 1 for r in found)
    assert language_id.identify_languages(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(documents(spark, [(1, "abc", None)])).collect()} == {"und"}


def test_ngrams_of_a_text_and_their_order():
    grams, counts = language_id.ngram_counts("Ab, ab")
    named = {"".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF): n for g, n in zip(grams, counts, strict=True)}
    assert named == {"a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, "b a": 1}
    assert len(language_id.ngram_counts("12 3")[0]) == 0 == len(language_id.ngram_counts("")[0])
    assert len(language_id.top_ngrams(grams, counts, 3)) == 3


def test_slices_make_no_difference(monkeypatch):
    texts = ["Ab, ab", "12 3", "", "ÜN ïçé 1x", " a  b ", *(prose(random.Random(i), 30) for i in range(3))]
    grams = [language_id.ngram_counts(x) for x in texts]
    found = toxicity.features(texts)
    for size in (1, 2, 3, 5, 10, 64):
        monkeypatch.setattr(language_id, "SLICE", size)
        monkeypatch.setattr(toxicity, "SLICE", size)
        for text, (g, n) in zip(texts, grams, strict=True):
            again = language_id.ngram_counts(text)
            assert again[0].tolist() == g.tolist() and again[1].tolist() == n.tolist()
        assert [x.tolist() for x in toxicity.features(texts)] == [x.tolist() for x in found]


def brute_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded = " " + " ".join(letters) + " " if letters else ""
    return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n] != " "]


def test_predictions_are_those_of_the_plain_rule(spark):
    from collections import Counter

    rng = random.Random(22)
    rows = [(i, speech(rng, lang, rng.randint(3, 12)), lang) for i in range(120) for lang in [rng.choice(["xx", "yy", "zz"])]]
    rows += [(500, "a b", "ww"), (501, "12", "vv"), (502, None, "uu"), (None, "kalo mita", "xx"), (3, rows[3][1], rows[3][2])]
    # Order of equal counts: shorter n-grams first, then by letters, a blank (the least letter) counting in its place.
    ranked = lambda c: sorted(c, key=lambda g: (-c[g], sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))))[:300]
    total = {}
    for i, text, lang in rows:
        if text is not None and (i is None or fold(i) != 2):
            total.setdefault(lang, Counter()).update(brute_grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in total.items() if c}
    want = []
    for i, text, _ in rows:
        own = ranked(Counter(brute_grams(text or "")))
        cost = {lang: sum(min(300, abs(p[g] - r)) if g in p else 300 for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        want.append((i, best if own else "und", round(1 - cost[best] / (300 * len(own)), 9) if own else 0.0))
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify_languages(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_language_is_left_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i // 26]}{letters[i % 26]} " * 3, f"l{i:04}") for i in range(676)]
    rows += [(1000 + i, f"{letters[i // 26]}q{letters[i % 26]} " * 3, f"m{i:04}") for i in range(676)]
    assert len(language_id.learn_profiles(documents(spark, rows))) == sum(fold(i) != 2 for i, *_ in rows)


def test_scores_of_quality_are_those_of_the_dense_sums(spark):
    """Ridge on all rows at once, isotonic by the means of pooled blocks, from statistics counted one by one."""
    rng = random.Random(23)
    rows = [(i, prose(rng, rng.randint(5, 60)) + ("!!! ###" * rng.randrange(4))) for i in range(160)] + [(700, None), (701, "")]
    marks = [(i, int("!" not in t)) for i, t in rows[:160]] + [(3, 1), (9999, 0)]
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")
    import pyarrow as pa

    x = quality.statistics(pa.array([t for _, t in rows]))
    for (_, text), row in zip(rows, x, strict=True):
        words = WORD.findall((text or "").lower())
        assert math.isclose(row[10], math.log1p(len(words))) and math.isclose(row[12], len(set(words)) / len(words) if words else 0)
        assert math.isclose(row[0], sum(c in "!?" for c in text or "") / max(1, len((text or "").encode())))
    known = {}
    for i, y in marks:
        known[i] = max(known.get(i, 0), y)
    learnt = [i for i, _ in rows if i in known and fold(i) != 2]
    model = quality.fit_quality(docs, labels)
    z, y = model.features(x[learnt]), np.array([known[i] for i in learnt], dtype=float)
    ridge = np.linalg.solve(z.T @ z + quality.PENALTY * len(y) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(ridge, model.ridge, atol=1e-8)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    raw = model.features(x) @ ridge
    want = np.clip(np.interp(raw, model.knots, model.values), 0, 1)
    assert all(math.isclose(got[i], w, abs_tol=1e-6) for (i, _), w in zip(rows, want, strict=True))


def brute_features(text):
    """N-grams by their text, and once more in a tuple if they occur twice."""
    from collections import Counter

    if not text:
        return set()
    blank = set(map(chr, toxicity._ENDS.tolist()))
    padded = "".join(" " if c in blank else c for c in f" {text.lower()} ")
    found = Counter(padded[i : i + n] for n in (4, 5, 6, 7, 8) for i in range(len(padded) - n + 1) if n < 7 or padded[i] == " ")
    return set(found) | {(g, 2) for g, n in found.items() if n > 1}


def test_scores_of_toxicity_are_those_of_plain_features(spark):
    rng = random.Random(24)
    rows = [(i, prose(rng, 20, 300) + (" ÜBLE rüde" * rng.randint(1, 3) if i % 4 == 0 else "")) for i in range(120)] + [(700, None), (701, ""), (702, "é")]
    marks = [(i, int(i % 4 == 0)) for i in range(120)]
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    own = {i: brute_features(t) for i, t in rows}
    row, gram = toxicity.features([t for _, t in rows])
    names = {}
    for at, (i, _) in enumerate(rows):
        mine = gram[row == at]
        assert len(mine) == len(own[i])  # one hash for each feature
    learnt = [i for i, _ in marks if fold(i) != 2]
    toxic, other = [own[i] for i in learnt if i % 4 == 0], [own[i] for i in learnt if i % 4]
    df = {g: (sum(g in f for f in toxic), sum(g in f for f in other)) for g in set().union(*toxic, *other)}
    assert len(df) < toxicity.KEPT * 4
    model = toxicity.fit_toxicity(docs, labels)
    ratio = lambda a, b: math.log((a + 1) / (len(toxic) + 2)) - math.log((b + 1) / (len(other) + 2))
    signs = {}
    for at, (i, _) in enumerate(rows):
        for g in gram[row == at].tolist():
            signs.setdefault(g, set()).add(i)
    for g, w in zip(model.kept.tolist(), model.weights.tolist(), strict=True):
        a, b = sum(i % 4 == 0 for i in signs[g] & set(learnt)), sum(i % 4 != 0 for i in signs[g] & set(learnt))
        names[g] = w / ratio(a, b) if ratio(a, b) else 0.0
    # The fit: no other weights on the scaled features give a lower penalised loss.
    x = np.array([[ratio(sum(j % 4 == 0 for j in signs[g] & set(learnt)), sum(j % 4 != 0 for j in signs[g] & set(learnt))) if i in signs[g] else 0.0 for g in model.kept.tolist()] for i in learnt])
    y, v = np.array([float(i % 4 == 0) for i in learnt]), np.array([names[g] for g in model.kept.tolist()])
    p = 1 / (1 + np.exp(-(x @ v + model.intercept)))
    assert np.abs(x.T @ (p - y) / len(y) + toxicity.PENALTY * v).max() < 2e-3
    weight = dict(zip(model.kept.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for at, (i, _) in enumerate(rows):
        margin = sum(weight.get(g, 0.0) for g in gram[row == at].tolist()) + model.intercept
        assert math.isclose(got[i], 1 / (1 + math.exp(-max(-30, min(30, margin)))), rel_tol=1e-9)


def test_one_row_of_a_repeated_id_is_learnt_from(spark):
    rng = random.Random(25)
    base = [(i, prose(rng, 40) + (" vileword" if i % 3 == 0 else "")) for i in range(60)]
    marks = [(i, int(i % 3 == 0)) for i in range(60)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("quality", 1 - F.col("toxic"))
    again = base + [base[k % 60] for k in range(500)]
    for fit, of in ((toxicity.fit_toxicity, "weights"), (quality.fit_quality, "ridge")):
        one, many = fit(documents(spark, base), labels, sample=60), fit(documents(spark, again), labels, sample=60)
        assert np.allclose(getattr(one, of), getattr(many, of))


def labelled(spark, rng, column, good, bad, n=400):
    rows, marks = [], []
    for i in range(n):
        is_bad = rng.random() < 0.25
        rows.append((i, bad(rng) if is_bad else good(rng)))
        if rng.random() < 0.8:
            marks.append((i, int(is_bad) if column == "toxic" else int(not is_bad)))
    return rows, marks


@pytest.mark.parametrize("column", ["quality", "toxic"])
def test_classifiers(spark, column):
    rng = random.Random(13)
    good = lambda r: prose(r, r.randint(30, 200))
    shout = lambda r: " ".join(w.upper() + "!!" for w in prose(r, 60).split())
    rude = lambda r: prose(r, 60) + f" blorgful{r.randrange(9)} " + prose(r, 60)
    rows, marks = labelled(spark, rng, column, good, shout if column == "quality" else rude)
    odd = [(1000, None), (1001, ""), (1002, prose(rng, 60_000)), (None, good(rng)), (3, rows[3][1])]
    extra = [(None, 1), (7, None), (8, 5)] + marks[:2]
    labels = spark.createDataFrame(marks + extra, f"doc_id long, {column} int").withColumn("text", F.lit("clash"))
    docs = documents(spark, rows + odd, extra=True)
    score = quality.score_quality if column == "quality" else toxicity.score_toxicity
    found = score(docs, labels).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    said = {r.doc_id: r for r in found}
    held = [(said[i].predicted, y) for i, y in marks if fold(i) == 2]
    assert len(held) > 40 and sum(a == b for a, b in held) >= 0.95 * len(held)
    limit = 0.7 if column == "quality" else 0.3
    assert all(r.predicted == int(r.score >= limit) for r in found)
    # Labels of the held-out fold are never learnt from.
    swapped = [(i, 1 - y if fold(i) == 2 else y) for i, y in marks]
    again = score(docs, spark.createDataFrame(swapped, f"doc_id long, {column} int")).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in found}
    assert score(docs.limit(0), labels).count() == 0
    none = score(docs, labels.limit(0)).collect()
    assert len(none) == len(found) and len({round(r.score, 6) for r in none}) == 1
    one_class = score(docs, labels.where(f"{column} = 1")).collect()
    assert all(0 <= r.score <= 1 for r in one_class)


def test_isotonic_is_monotone_and_pools():
    score, label = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0.0, 1.0, 0.0, 1.0, 1.0])
    knots, values = quality.isotonic(score, label)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all() and len(values) == 3


# ------------------------------------------------------------------ the pipeline


def test_pipeline_agrees_with_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    passage = speech(rng, "xx", 30)
    rows, marks = [], []
    for i in range(160):
        bad = rng.random() < 0.2
        text = speech(rng, "xx", rng.randint(40, 120))
        rows.append([i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, "xx", rng.choice("ab"), 0])
        marks.append((i, int(not bad), 0))
    clean = [i for i, m in enumerate(marks) if m[1]]
    for k in range(12):
        rows.append([200 + k, rows[clean[k]][1] + (" extra" if k % 2 else ""), "xx", "a", 0])
    for k in range(12, 18):
        rows[clean[k]][1] += " " + passage
    rows += [[300, "12345", "xx", "a", 0], [301, None, "xx", "b", 0]]
    spark.createDataFrame(list(map(tuple, rows)), DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "ngram_jaccard", "decontamination", "mixing"]
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, kept, str(tmp_path))
        seen.append({r.doc_id for r in kept.collect()})
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {r[0] for r in rows}
    good = everything - {m[0] for m in marks if not m[1]}
    assert everything - seen[0] == {300, 301}
    assert seen[1] <= seen[0] and len((seen[1] ^ good) - {300, 301}) <= 2
    left = [r for r in rows if r[0] in seen[1]]
    assert seen[2] == {i for i, _, c in brute_components(left) if i == c}
    assert seen[2] - seen[3] == {clean[k] for k in range(12, 18)} & seen[2]
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in mixed} == seen[3] and all(r.taken <= 3 * r.size for r in mixed)


def write_tables(spark, path, docs, marks=(), items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(marks), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


CLASHES = ("gone", "gone_key", "row_key", "row_key_", "found_language", "found_quality", "_found", "k", "id", "group", "stays", "row", "label", "node", "n")


def test_stages_with_clashing_columns_repeated_and_null_ids(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(17)
    passage, texts = prose(rng, 30), [prose(rng, 60) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " more"), (None, texts[1] + " end"), (None, texts[2]), (3, texts[2]), (None, texts[3]), (4, texts[4]), (4, texts[4]), (5, passage + " " + texts[5]), (5, texts[5] + " alone"), (6, ""), (7, None), (8, "One"), (9, "one"), (10, prose(rng, 30_000))]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in CLASHES}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    write_tables(spark, tmp_path, docs, items=[(1, passage)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    gone = [(2, texts[0] + " more"), (None, texts[1] + " end"), (None, texts[2]), (4, texts[4]), (9, "one")]
    want = list(rows)
    for x in gone:
        want.remove(x)
    assert got == sorted(want, key=str)
    kept = P.decontamination(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((x for x in rows if not (x[1] or "").startswith(passage)), key=str)
    # Nothing to learn from: nothing is rejected.
    assert P.quality(spark, docs, str(tmp_path)).count() == len(rows)
    assert P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == len(rows)
    found = P.language(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == {None, 1, 2, 3, 4, 5, 8, 9, 10}
    assert {c: found.first()[c] for c in CLASHES} == dict.fromkeys(CLASHES, "x")


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    docs = documents(spark, [])
    write_tables(spark, tmp_path, docs)
    for _, step in P.STAGES[:-1]:
        assert step(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0
