"""Balanced HTML, tables in buckets, and other mechanisms, against plain restatements."""

import json
import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillon.operators import curation as C
from quillon.streaming import buckets as B

OPEN = re.compile(r"(?i)<article[^>]*>")


def plain_balanced(html, opening, tag):
    """A stack of open tags, one tag after the other."""
    found = re.search(f"(?i){opening}", html)
    if not found:
        return None
    stack = []
    for m in re.finditer(rf"(?i)</?{tag}\b", html[found.start() :]):
        if m[0].startswith("</"):
            stack.pop()
            if not stack:
                return html[found.start() :][: m.start()]
        else:
            stack.append(m.start())
    return html[found.start() :]


def test_containers_end_at_the_tag_that_pairs_with_theirs(spark, small):
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]
    pages += [f'<div id="zoom">{a}<div class="x">{b}</div>{a[:40]}</div><div>{b[:9]}</div>' for a, b in zip(pages[:10], pages[10:20], strict=True)]
    pages += ['<DIV data="1" id="zoom"><div><divider></divider></div>', '<p>none</p>', "", '<div id="zoom"></div>x', None, '<div id="zoom">' + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</div>tail"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    for opening, tag in C.CONTAINERS:
        got = {r.i: r.b for r in rows.select("i", C.balanced(F.col("html"), opening, tag).alias("b")).collect()}
        assert got == {i: plain_balanced(p, opening, tag) if p is not None else None for i, p in enumerate(pages)}
    body = {r.i: r.b for r in rows.select("i", C.html_body(F.col("html"), least=4, require_container=False).alias("b")).collect()}
    assert body[len(pages) - 1] == "deep" and body[len(pages) - 5] == "none"


def files_in(path):
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_a_batch_rewrites_the_buckets_of_its_keys_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert B.read_table(spark, path) is None
    rows = lambda xs: spark.createDataFrame(xs, "k long, at long, v string")
    first = [(i, i, "x" * 50) for i in range(4000)]
    assert B.merge(rows(first), path, "k", "at", 0, n_buckets=32) == 32
    before = files_in(path)
    held = B.read_table(spark, path)
    batch = [(7, 9, "new"), (7, 8, "late"), (4001, 1, "added"), (9, 9, "tie"), (None, 1, "null"), (None, 3, "null, later")]
    wrote = B.merge(rows(batch), path, "k", "at", 1)
    added = {p: n for p, n in files_in(path).items() if p not in before}
    assert 1 <= wrote <= 4 and len(added) == wrote and sum(added.values()) < sum(before.values()) / 4
    want = {k: (k, at, v) for k, at, v in first} | {7: (7, 9, "new"), 4001: (4001, 1, "added"), 9: (9, 9, "tie"), None: (None, 3, "null, later")}
    assert {r.k: tuple(r) for r in B.read_table(spark, path).collect()} == want
    assert held.count() == 4000  # a reader of the version before goes on
    assert B.merge(rows([(7, 99, "again")]), path, "k", "at", 1) == 0 and B.merge(rows([]), path, "k", "at", 2) == 0
    assert {r.k: tuple(r) for r in B.read_table(spark, path).collect()} == want
    for number in range(3, 7):
        B.merge(rows([(7, number + 100, f"v{number}")]), path, "k", "at", number, keep=1)
    assert len(list(Path(path).glob("manifest-*.json"))) == 2 and B.read_table(spark, path).where("k = 7").first().v == "v6"
    live = set(B.read_manifest(spark, path).buckets.values())
    assert len(live) == 32 and len([p for p in Path(path).glob("data/*/_bucket=*")]) <= 33


def test_a_batch_that_stops_midway_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = lambda v: spark.createDataFrame([(1, 1, v)], "k long, at long, v string")
    B.merge(rows("a"), path, "k", "at", 0, n_buckets=4)
    monkeypatch.setattr(B, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        B.merge(rows("b"), path, "k", "at", 1)
    monkeypatch.undo()
    assert B.read_table(spark, path).first().v == "a"
    assert B.merge(rows("b"), path, "k", "at", 1) == 1 and B.read_table(spark, path).first().v == "b"


def unit_vectors(n, seed=0, dims=12):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 3 * rng.normal(size=(16, dims))[rng.integers(0, 16, n)]
    return [(i, i % 7, i, v.tolist()) for i, v in enumerate(x)]


def test_cells_give_the_hits_of_all_vectors_and_read_only_theirs(spark, tmp_path):
    from quillon.operators import vectors as V

    rows = unit_vectors(3000) + [(9000, 0, 9000, [0.0] * 12), (9001, 0, 9001, unit_vectors(1)[0][3])]
    table = spark.createDataFrame(rows, "chunk_id long, doc_id long, ord long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, _, _, v in unit_vectors(40, seed=0)] + [(99, [0.0] * 12)], "query_id long, v array<double>")
    path = f"{tmp_path}/cells"
    V.write_cells(table, path, cells=16)
    hits = lambda index: {(r.query_id, r.vector_rank): (r.chunk_id, round(r.cosine, 8)) for r in index.search(asked, 5).collect()}
    exact = hits(V.ExactIndex(table))
    assert hits(V.CellIndex(spark, path, 16)) == exact and len(exact) == 41 * 5
    few = V.CellIndex(spark, path, 4)
    found = hits(few)
    pairs = {(q, c) for (q, _), (c, _) in exact.items() if q != 99}
    assert len(pairs & {(q, c) for (q, _), (c, _) in found.items()}) / len(pairs) >= 0.9
    one = V.CellIndex(spark, path, 1).search(asked.where("query_id = 3"), 5)
    cells = {f.split("cell=")[1].split("/")[0] for f in one.inputFiles()}
    whole = {f.split("cell=")[1].split("/")[0] for f in V.CellIndex(spark, path, 16).search(asked, 5).inputFiles()}
    assert len(whole) == 16 and one.count() == 5 and few.cosines(asked).count() < 41 * len(rows) / 2 and len(cells) >= 1
    assert "PartitionFilters: [cell" in one._jdf.queryExecution().toString().replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    V.write_cells(table.where("chunk_id < 5"), path, cells=16)  # fewer vectors than cells, in place of the old ones
    assert {c for c, _ in hits(V.CellIndex(spark, path, 16)).values()} == {0, 1, 2, 3, 4}
    empty = f"{tmp_path}/empty"
    V.write_cells(table.limit(0), empty)
    assert V.CellIndex(spark, empty, 3).search(asked, 5).collect() == []


def test_questions_in_several_passes_have_the_same_hits(spark, monkeypatch):
    from quillon.operators import search as S

    table = spark.createDataFrame(unit_vectors(300), "chunk_id long, doc_id long, ord long, v array<double>")
    asked = spark.createDataFrame([(i, v) for i, _, _, v in unit_vectors(50, seed=3)], "query_id long, v array<double>")
    want = sorted(map(tuple, S.vector_top(table, asked, 4).collect()))
    monkeypatch.setattr(S, "QUESTION_BYTES", 1000)
    assert sorted(map(tuple, S.vector_top(table, asked, 4).collect())) == want


def test_writers_of_a_registry_lose_nothing(spark, tmp_path):
    from quillon.sources import registry as R

    path = f"{tmp_path}/registry"
    assert R.read_registry(spark, path) is None
    with pytest.raises(LookupError):
        R.update_sources(spark.createDataFrame([("x", "y")], "local_path string, status string"), path)
    schema = "local_path string, category string, status string"
    make = lambda rows: spark.createDataFrame(rows, schema)

    def write(k):
        return R.add_sources(make([(f"p{k}", f"c{9 - k}", None), ("shared", "c5", f"w{k}")]), path)

    with ThreadPoolExecutor(4) as pool:
        versions = sorted(pool.map(write, range(6)))
    assert versions == [1, 2, 3, 4, 5, 6]
    rows = R.read_registry(spark, path).collect()
    assert [r.local_path for r in rows] == [r.local_path for r in sorted(rows, key=lambda r: (r.category, r.local_path))] and {r.local_path for r in rows} == {"shared", *(f"p{k}" for k in range(6))}
    kept = next(r.status for r in rows if r.local_path == "shared")
    R.add_sources(make([("shared", "other", "late"), ("p0", None, "filled")]), path)
    R.update_sources(make([("p1", None, "done"), ("unknown", "c", "x")]), path)
    got = {r.local_path: (r.category, r.status) for r in R.read_registry(spark, path).collect()}
    assert got["shared"] == ("c5", kept) and got["p0"] == ("c9", "filled") and got["p1"][1] == "done" and "unknown" not in got


def test_lines_of_files_have_one_order(spark, tmp_path):
    from quillon.sources import ordered as O

    texts = {"b.jsonl": "b0\n\nb2", "a.jsonl": "".join(f"line {i} {'x' * (i % 90)}\n" for i in range(3000)), "c.jsonl": "", "d.jsonl": "d0\r\nd1\n", "other.txt": "no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        paths = O.matching_files(spark, f"{tmp_path}/*.jsonl")
        got = [tuple(r) for r in O.ordered_lines(spark, paths).orderBy("ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f, i, line) for f, n in enumerate(sorted(n for n in texts if n.endswith("jsonl"))) for i, line in enumerate(texts[n].splitlines())]
    assert [(f, i, v) for f, i, _, v in got] == want and [o for _, _, o, _ in got] == list(range(len(want)))
    with pytest.raises(FileNotFoundError):
        O.matching_files(spark, f"{tmp_path}/*.none")


def test_a_cached_table_goes_when_its_version_does(spark, tmp_path):
    from quillon.sources.ordered import VersionedCache
    from quillon.streaming import progress as P

    path, made, cache = f"{tmp_path}/t", [], VersionedCache()

    def make():
        made.append(1)
        return P.current(spark, path).withColumn("twice", F.col("id") * 2)

    P.publish(spark.range(3), path, "v")
    first = cache.get(spark, path, "twice", make)
    assert cache.get(spark, path, "twice", make) is first and len(made) == 1 and first.storageLevel.useMemory and first.count() == 3
    P.publish(spark.range(5), path, "v")
    assert cache.get(spark, path, "twice", make).count() == 5 and len(made) == 2 and not first.storageLevel.useMemory
    cache.clear()
    assert cache.get(spark, path, "twice", make).count() == 5 and len(made) == 3
    cache.clear()


def test_documents_are_named_by_their_path_below_the_folder(spark, tmp_path):
    from quillon import index as X

    for name, text in {"a/x.md": "one", "b/x.md": "two", "x.md": "three", "b/c/x.txt": " "}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for root in (str(tmp_path), f"{tmp_path}/"):
        texts, errors = X.read_corpus(spark, root)
        assert {r.doc_id: r.text for r in texts.collect()} == {"a/x.md": "one", "b/x.md": "two", "x.md": "three"}
        assert [tuple(r) for r in errors.collect()] == [("b/c/x.txt", "empty file")]


def test_words_are_looked_for_as_they_are(spark):
    rows = spark.createDataFrame([("a.b",), ("axb",), ("c|d",)], "t string")
    assert [r[0] for r in rows.select(C.contains_any(F.col("t"), ["a.b", "|"])).collect()] == [True, False, True]


def test_sections_and_entries_are_the_same_without_a_shuffle(spark):
    import random

    from quillon.operators import chunking as K

    rng = random.Random(2)
    lines = ["# A", "## B b", "### C", "#### D", "##### no", "#no", "# ", "text", "  more ", "", "【e】x", "【】no", "【f】", "## B b", "tail【g】"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 30))) for _ in range(150)] + ["", "only", None, "\n".join(lines * 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    new = K.sections_of(docs, "d", "t")
    assert rows(new) == rows(K.heading_sections(K.lines_of(docs, "d", "t"), "d").select(*new.columns)) != []
    entries = K.entries_of(docs, "d", "t")
    old = K.entry_blocks(K.lines_of(docs, "d", "t"), "d").select(*entries.columns)
    assert rows(entries) == rows(old) != [] and "Exchange" not in new._jdf.queryExecution().toString() + entries._jdf.queryExecution().toString()


def pieces_by_offsets(text, size=600, overlap=80, marks=("\n\n", "\n", "。", "；", "，", ",", " ", "")):
    """The recursive splitting as ranges of one text: a window is a range of whole parts."""
    out = []

    def emit(lo, hi):
        if lo is not None and text[lo:hi].strip():
            out.append(text[lo:hi].strip())

    def go(lo, hi, k):
        while marks[k] and marks[k] not in text[lo:hi]:
            k += 1
        cuts = range(lo, hi + 1) if not marks[k] else sorted({lo, hi, *(lo + m.start() for m in re.finditer(re.escape(marks[k]), text[lo:hi]))})
        cuts, first = list(cuts), None  # the window goes from part ``first``
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if b - a > size and k + 1 < len(marks):
                emit(None if first is None else cuts[first], a)
                first = None
                go(a, b, k + 1)
                continue
            if first is not None and b - cuts[first] > size:
                emit(cuts[first], a)
                while first < i and (a - cuts[first] > overlap or b - cuts[first] > size):
                    first += 1
            first = i if first is None or first == i else first
        emit(None if first is None else cuts[first], hi)

    go(0, len(text), 0)
    return out


def test_recursive_pieces_are_those_of_the_restatement_by_offsets(spark, small):
    import hashlib
    import random

    from quillon import catalog
    from quillon.operators.chunking import recursive_split

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text}
    want = {i: pieces_by_offsets(t) for i, t in texts.items()}
    got = {r.doc_id: (r.n_pieces, r.longest, r.digest) for r in catalog.QUERIES["chunk_recursive_split"](spark, small).collect()}
    assert got == {i: (len(p), max(map(len, p)), hashlib.md5("\x01".join(p).encode()).hexdigest()) for i, p in want.items() if p} and len(got) > 100
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["\n\n", "\n", "。", "，", ",", " ", "词", "ab", "word", "x" * 30]) for _ in range(rng.randrange(0, 120)))
        assert recursive_split(text, 25, 6) == pieces_by_offsets(text, 25, 6)


def test_splitting_holds_the_pieces_of_a_part_of_a_batch(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from quillon.operators.chunking import recursive_split, split_blocks

    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "词。" * 500)], "d string, t string")
    got = {(r.d, r.seq): r.piece for r in split_blocks(docs, "d", "t").collect()}
    assert got == {("c", i): p for i, p in enumerate(recursive_split("词。" * 500), 1)} and len(got) == 2
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, ddl, held=type(docs).mapInArrow: runs.append(f) or held(self, f, ddl))
    split_blocks(docs, "d", "t")

    def peak(n: int) -> tuple[int, int]:
        batch = pa.record_batch({"doc": [f"{i}" for i in range(n)], "text": ["one two, " * 300] * n})
        tracemalloc.start()
        pieces = sum(out.num_rows for out in runs[0](iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return pieces, most

    (few, low), (many, high) = peak(400), peak(2400)
    assert many == 6 * few and high < 1.5 * low


def test_guarded_patterns_fit_as_with_the_guard_in_front_and_are_not_much_slower_than_without(spark):
    import random
    import time

    from quillon.operators import rules as R

    options = {"(a(c|d)|b)+e": "ab", "a|b": "ab", "a?b": None, "(a|)b": None, "(a|b)?c": None, "[ab]c": None, r"\d": None, "(?i)ab": None, "^a": None, "": None}
    assert {p: R.leads(p) for p in options} == options
    groups = (R.DIAGNOSIS, R.MEDICATION, R.ABSOLUTES, R.SELF_HARM_ECHO, ("得|您", "(您)\\1", "(?<x>您)得", "a?您", "[您得]为"))
    rng = random.Random(4)
    bits = ["不", "没", "说", "认为", "提到", "您得了", "你就是", "确诊为", "诊断为", "建议吃", "布洛芬", "2", "3.5 mg", "每天吃", "停药", "一定能", "治好", "肯定没事", "包治", "自杀", "不想活", "您您", "您得为", "a", "\n", "。", " ", "x", "\U00020000", "中文字"]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(14))),) for _ in range(1500)]
    texts = spark.createDataFrame(rows, "t string")
    both = [c for i, g in enumerate(groups) for c in (R.guarded(F.col("t"), g).alias(f"a{i}"), R.first_match(F.col("t"), [R.GUARD + p for p in g]).alias(f"b{i}"))]
    found = texts.select("t", *both).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in found for i in range(len(groups))) and all(sum(r[f"a{i}"] is not None for r in found) > 50 for i in range(len(groups)))

    def seconds(column) -> float:
        began = time.time()
        spark.range(1).select(F.concat(F.repeat(F.lit("plain words "), 200_000), F.col("id").cast("string")).alias("t")).select(column).collect()
        return time.time() - began

    plain = min(seconds(R.first_match(F.col("t"), R.DIAGNOSIS)) for _ in range(2))
    assert min(seconds(R.guarded(F.col("t"), R.DIAGNOSIS)) for _ in range(2)) < 2 + 5 * plain


def test_red_flags_are_those_of_the_plain_patterns_and_each_text_is_scanned_once(spark, small):
    import random

    from quillon import catalog
    from quillon.operators import rules as R

    rng = random.Random(5)
    bits = [o for r in R.RED_FLAGS for p in r.patterns for o in re.findall("[一-鿿0-9]+", p)] + ["x", "plain words ", " ", "\u3000", "\n", "\U00020000", "。", "一", "龥"] * 6
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(16))),) for _ in range(1500)] + [(None,), ("",), ("plain " * 50,)]
    own = (R.Rule("any", "high", (".痛", "x")), R.Rule("late", "high", ("(痛|疼)(?=x)",)))
    for rules, least in ((R.RED_FLAGS, 500), (own, 100), (own[1:], 1)):
        plain = lambda t: F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), R.first_match(R.flat(t), r.patterns).alias("matched")) for r in rules))  # noqa: B023, E731
        wanted = F.filter(plain(F.col("t")), lambda h: h["matched"].isNotNull())
        found = spark.createDataFrame(rows, "t string").select(R.rule_hits(F.col("t"), rules).alias("a"), wanted.alias("b")).collect()
        assert all(r.a == r.b for r in found) and sum(len(r.a) for r in found) >= least
    plan = catalog.QUERIES["red_flag_report"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_lines_are_stripped_of_all_white_space_and_looked_at_once_for_clauses(spark, small):
    from quillon import catalog
    from quillon.functions import text as T

    signs = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.decode(F.to_binary(F.lpad(F.hex("id"), 8, "0"), F.lit("hex")), "UTF-32").alias("c"))
    padded = signs.select("c", F.concat("c", F.lit(" "), "c", F.lit("x\n "), "c", F.lit("y"), "c", F.lit(" \r\n"), "c").alias("t"))
    by_pattern = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    seen = padded.agg(F.count_if(T.strip(F.col("t")) != by_pattern("t")), F.count_if(T.strip(F.col("c")) != by_pattern("c")), F.count_if((F.col("c") != "") & (T.strip(F.col("c")) == ""))).first()  # a byte order mark is decoded to nothing
    assert tuple(seen) == (0, 0, 25)
    rows = [("第一章 总则", "第一章", 2), ("二十、目的", "二十、", 2), ("第三节", "第三节", 3), ("第三条 x", "第三条", 3), ("（四）y", "（四）", 4), ("见第一章", None, None), ("x\n一、", None, None), ("", None, None), (None, None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", C.clause_heading(F.col("t")).alias("h")).orderBy("i").collect()
    assert [(r.h.marker, r.h.level) for r in got] == [r[1:] for r in rows]
    plan = catalog.QUERIES["clause_heading"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") == len(C.CLAUSES) and "regexp_replace(" not in plan


def test_replies_are_reviewed_at_about_the_cost_of_the_plain_patterns(spark, small):
    import time

    from quillon import catalog
    from quillon.operators import rules as R

    none = F.array().cast("array<string>")
    codes = lambda reply: R.violations(reply, F.array(F.lit("感冒")), F.lit("low"), none, none, none, F.lit("low"), none, F.lit(False))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " \u3000\n", "\u2003", " x", "说您得了感冒", "您得了感冒，肯定没事"])], "i int, t string")
    got = [r.c for r in rows.select("i", codes(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [["empty_reply"]] * 4 + [[], [], ["diagnosis_language", "absolutist_claim"]]

    def seconds(column) -> float:
        began = time.time()
        spark.range(1).select(F.concat(F.repeat(F.lit("plain words "), 50_000), F.col("id").cast("string")).alias("t")).select(column).collect()
        return time.time() - began

    plain = min(seconds(R.first_match(F.col("t"), R.DIAGNOSIS + R.MEDICATION + R.ABSOLUTES + R.SELF_HARM_ECHO)) for _ in range(2))
    assert min(seconds(codes(F.col("t"))) for _ in range(2)) < 2 + 5 * plain
    plan = catalog.QUERIES["review_actions"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("concat(text") == 1  # the reply is made once, for all checks


def test_fetched_files_are_audited(spark):
    files = [
        ("a.html", "<html><body>404 Not Found"), ("b.txt", "\n <!DOCTYPE HTML> x"), ("c.xml", "\ufeff<?xml version='1.0'?><a><b/></a>"), ("d.xml", "<a><b></a>"), ("e.xml", "plain"), ("f.pdf", "<html>"), ("g.json", ""), ("h.md", "fine " * 100 + "<html>"),
        ("i.csv", "Access Denied"), ("j.TXT", "no such file"), ("noext", "403 Forbidden"),
    ]
    registry = spark.createDataFrame([(n, "ok") for n, _ in files] + [("gone.txt", "ok"), ("todo.txt", "pending")], "local_path string, status string")
    got = {r.local_path: (r.size, r.problem) for r in C.audit(registry, spark.createDataFrame(files, "local_path string, content string")).collect()}
    want = {"a.html": None, "b.txt": "error page: <!doctype html", "c.xml": None, "d.xml": "broken XML", "e.xml": "broken XML", "f.pdf": None, "g.json": "empty", "h.md": None, "i.csv": "error page: access denied", "j.TXT": "error page: no such file", "noext": None}
    assert got == {n: (len(t), want[n]) for n, t in files} | {"gone.txt": (0, "missing")}


def test_gate_looks_into_the_head_of_the_text_and_for_a_subject(spark):
    rows = spark.createDataFrame([("guide care", "x" * 500), ("guide", "x" * 500), ("guide care", "tender " + "x" * 500), ("guide care", "x" * 290 + "tender" + "x" * 300)], "t string, b string")
    gate = C.gate(F.col("t"), F.col("b"), "tender", ["guide"], F.lit(9), subjects=["care"], body_head=200)
    assert [r[0] for r in rows.select(gate).collect()] == [None, "off subject", "noise in text: tender", None]
