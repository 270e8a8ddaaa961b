"""N-gram Jaccard join: documents whose word-shingle sets overlap, by T-occurrence search.

A document's set holds the distinct k-word shingles of its whole text.  Two
documents link when ``100 * |A & B| >= threshold * |A | B|``.  The work, in the
order it is done:

1. One pass over the texts keeps, per row, the set's size, a key of the whole
   set (rows of equal sets are one node from here on) and the set's prefix in
   hash order.
2. A set can only have a partner if enough of its prefix occurs in another
   set.  Prefixes meet by hash range; tokens that a task already saw twice are
   settled there, so a token of a third of all rows sends one record a task.
3. The sets of the nodes left are made again, from their texts alone.  Under
   the order "rare tokens by hash, then the commonest by frequency" each goes
   to the inverted lists of its prefix tokens.
4. Hubs: every member of a list is searched against a few members chosen by
   hash.  A mass of near copies thereby joins into one class in linear work.
5. The rest: in lists that still hold several classes, members of the smaller
   classes are indexed in blocks of sets of about one size, and the members of
   larger ones search each block with which they share as many prefix tokens
   as a link needs.  A block with many searchers is copied.
   Searches (DivideSkip) run on a block of inverted lists: the shortest lists
   are heap-merged, the longest probed by binary search.

No step emits the pairs of a list, gathers a list in one task, or drops a
candidate: the prefix bounds are exact.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import textkit
from quillon.llm.graph import connected_components
from quillon.staging import scratch, stage

#: Tokens that are ordered by frequency; the others are ordered by hash. Any number gives the same result.
HOT_TOKENS = 65_536
#: A token is worth ordering by frequency from this many sets on.
HOT_FROM = 32
#: Members of a list that every member is searched against before blocks are made.
HUBS = 2
#: Sets indexed together, and searches sent to one copy of them.
BLOCK, SEARCHES = 64, 256
#: Nodes up to which their ids are broadcast to filter the texts; beyond it they are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Prefix tokens that one task settles among themselves before it sends the rest.
CHUNK = 1 << 19


def least_overlap(n: int, threshold: int) -> int:
    """The fewest tokens that a set of n shares with any partner."""
    return -(-n * threshold // 100)


def _sketch_size(n: int, threshold: int) -> int:
    return n - least_overlap(n, threshold) + max(1, math.ceil(n / 10))


def _set_key(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.sum(textkit.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64) + np.uint64(len(tokens))
    return int(textkit.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def divide_skip(lists: list[list[int]], t: int) -> dict[int, int]:
    """The entries that occur in at least t of the ascending lists, with their counts.

    The longest lists (as many as DivideSkip's rule gives, t - 1 at most) are
    set aside; an entry must then occur in t minus that number of the others,
    which are heap-merged, and the long lists are probed for it one by one.
    """
    if t < 1 or len(lists) < t:
        return {}
    lists = sorted(lists, key=len)
    aside = min(t - 1, int(t / (0.1 * math.log2(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    need, found = t - aside, {}
    heads = [(x[0], i, 0) for i, x in enumerate(short) if x]
    heapq.heapify(heads)
    while heads:
        entry, count = heads[0][0], 0
        while heads and heads[0][0] == entry:
            _, i, at = heads[0]
            count += 1
            if at + 1 < len(short[i]):
                heapq.heapreplace(heads, (short[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heads)
        if count < need:
            continue
        left = len(long)
        for x in long:
            if count + left < t:
                break
            at = bisect_left(x, entry)
            count += at < len(x) and x[at] == entry
            left -= 1
        if count >= t:
            found[entry] = count
    return found


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _unpack(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) if x else np.zeros(0, dtype=np.uint64) for x in column.to_pylist()]


def _digests(k: int, threshold: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            n, node, sketch = [], [], []
            for s in textkit.shingle_sets(*textkit.text_bytes(batch.column("text")), k):
                n.append(len(s))
                node.append(_set_key(s) if len(s) else None)
                sketch.append(s[: _sketch_size(len(s), threshold)].tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary())], schema=schema)

    return run


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.int64) * buckets >> 31


_OFFER = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("tokens", pa.binary()), ("nodes", pa.binary())])
_SINGLE, _SHARED, _CREDIT = 0, 1, 2


def _offers(buckets: int):
    """Prefix tokens by hash range: those seen once with their node, those shared here alone, and what the nodes owe to the latter."""

    def cut(kind: int, bucket: np.ndarray, tokens: np.ndarray, nodes: np.ndarray | None) -> Iterator[tuple]:
        order = np.argsort(bucket, kind="stable")
        bucket, tokens = bucket[order], tokens[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for lo, hi in zip(edge, np.r_[edge[1:], len(bucket)] if len(bucket) else [], strict=True):
            yield int(bucket[lo]), kind, tokens[lo:hi].tobytes(), None if nodes is None else nodes[order[lo:hi]].tobytes()

    def settle(tokens: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        owner = np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in tokens])
        h = np.concatenate(tokens)
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        first = np.r_[True, h[1:] != h[:-1]]
        count = np.diff(np.r_[np.flatnonzero(first), len(h)])
        shared = np.repeat(count > 1, count)
        credit, much = np.unique(owner[shared], return_counts=True)
        distinct = h[first & shared]
        rows = [
            *cut(_SINGLE, _bucket_of(h[~shared], buckets), h[~shared], owner[~shared]),
            *cut(_SHARED, _bucket_of(distinct, buckets), distinct, None),
            *cut(_CREDIT, _bucket_of(credit.view(np.uint64), buckets), credit, much.astype(np.int64)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OFFER, strict=True)], schema=_OFFER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, seen, size = [], [], set(), 0
        for batch in textkit.pieces(batches, "sketch"):
            for node, s in zip(batch.column("node").to_pylist(), _unpack(batch.column("sketch")), strict=True):
                if node is None or node in seen:
                    continue
                seen.add(node)
                tokens.append(s)
                nodes.append(node)
                size += len(s)
                if size >= CHUNK:
                    yield from settle(tokens, nodes)
                    tokens, nodes, seen, size = [], [], set(), 0
        yield from settle(tokens, nodes)

    return run


_CREDITS = pa.schema([("node", pa.int64()), ("credit", pa.int64())])


def _credits(table: pa.Table) -> pa.Table:
    """For each node the number of its tokens in this hash range that another set has too (or more, for repeated sets)."""
    kind = table.column("kind").to_numpy()
    tokens, nodes = table.column("tokens").to_pylist(), table.column("nodes").to_pylist()

    def gather(values: list, which: int, as_type: type) -> np.ndarray:
        return np.frombuffer(b"".join(v for v, x in zip(values, kind, strict=True) if x == which), dtype=as_type)

    h, owner, shared = gather(tokens, _SINGLE, np.uint64), gather(nodes, _SINGLE, np.int64), np.unique(gather(tokens, _SHARED, np.uint64))
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]  # one record for each token and node
        h, owner = h[new], owner[new]
        count = np.diff(np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)])
        owner = owner[np.repeat(count > 1, count) | np.isin(h, shared)]
    node, much = np.unique(np.r_[owner], return_counts=True)
    return pa.table([np.r_[node, gather(tokens, _CREDIT, np.int64)], np.r_[much, gather(nodes, _CREDIT, np.int64)]], schema=_CREDITS)


def _sets(k: int):
    """The sets of texts, if they are those of the nodes given (any, if none is)."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "text"):
            rows = [
                (key, len(s), s.tobytes())
                for want, s in zip(batch.column("node").to_pylist(), textkit.shingle_sets(*textkit.text_bytes(batch.column("text")), k), strict=True)
                if len(s) and (key := _set_key(s)) == (key if want is None else want)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


_COUNTS = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])


def _token_counts(buckets: int):
    def settle(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        h, count = np.unique(np.concatenate(parts), return_counts=True)
        bucket = _bucket_of(h, buckets)  # ascending, as the hashes are
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = [(int(bucket[lo]), h[lo:hi].tobytes(), count[lo:hi].astype(np.int64).tobytes()) for lo, hi in zip(edge, np.r_[edge[1:], len(h)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in textkit.pieces(batches, "tokens"):
            for s in _unpack(batch.column("tokens")):
                parts.append(s)
                size += len(s)
                if size >= 2 * CHUNK:
                    yield from settle(parts)
                    parts, size = [], 0
        yield from settle(parts)

    return run


def _frequent(table: pa.Table) -> pa.Table:
    h = np.frombuffer(b"".join(table.column("tokens").to_pylist()), dtype=np.uint64)
    count = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int64)
    token, at = np.unique(h, return_inverse=True)
    total = np.zeros(len(token), dtype=np.int64)
    np.add.at(total, at, count)
    often = total >= HOT_FROM
    return pa.table([_signed(token[often]), total[often]], names=["token", "df"])


def _postings(hot: np.ndarray, threshold: int):
    """hot: the commonest tokens, the rarest of them first."""
    order = np.argsort(hot)
    known, rank = hot[order], order
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.pieces(batches, "tokens"):
            prefixes = []
            for s in _unpack(batch.column("tokens")):
                keep = _sketch_size(len(s), threshold)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    is_hot = known[at] == s
                    common = s[is_hot][np.argsort(rank[at[is_hot]])]
                    s = np.concatenate([s[~is_hot], common])
                prefixes.append(s[:keep])
            sizes = [len(p) for p in prefixes]
            if sum(sizes):
                node, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(prefixes))), pa.array(node), pa.array(n)], schema=schema)

    return run


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _invert(members: Iterable[int], tokens: dict[int, np.ndarray]) -> dict[int, list[int]]:
    inverted: dict[int, list[int]] = {}
    for j in sorted(members):
        for token in tokens[j].tolist():
            inverted.setdefault(token, []).append(j)
    return inverted


def _search(threshold: int):
    """One block: its sets are indexed token by token, and searched by sets of other classes; returns links that join classes.

    A link makes one class of two, so the searches of a class go on among the
    indexed sets that are not yet in it.
    """

    def run(table: pa.Table) -> pa.Table:
        role, node, label = (table.column(c).to_numpy() for c in ("role", "node", "label"))
        tokens = dict(enumerate(_unpack(table.column("tokens"))))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        indexed = np.flatnonzero(role == 0).tolist()
        whole = _invert(indexed, tokens)
        asking = np.flatnonzero(role == 1)
        a, b = [], []
        for _, group in groupby(asking[np.argsort(label[asking], kind="stable")].tolist(), key=lambda i: label[i]):
            mine, inverted, held = None, whole, len(indexed)
            for i in group:
                if mine is None:
                    mine = int(label[i])
                    left = {j for j in indexed if root(int(label[j])) != root(mine)}
                if not left:
                    break
                if 2 * len(left) < held:
                    inverted, held = _invert(left, tokens), len(left)
                size = len(tokens[i])
                lists = [x for token in tokens[i].tolist() if (x := inverted.get(token))]
                for j, overlap in divide_skip(lists, least_overlap(size, threshold)).items():
                    if j in left and 100 * overlap >= threshold * (size + len(tokens[j]) - overlap) and root(int(label[j])) != root(mine):
                        a.append(node[i])
                        b.append(node[j])
                        parent[root(int(label[j]))] = root(mine)
                if a and a[-1] == node[i]:
                    left = {j for j in left if root(int(label[j])) != root(mine)}
        return pa.table([np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)], schema=_EDGES)

    return run


def _run_searches(index: DataFrame, searches: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """index (block, node, label): sets of each block; searches (block, copies, part, node, label): who searches which copy of it."""
    units = searches.select("block", "copies", "part").distinct()
    held = units.join(index, "block").select("block", "copies", "part", "node", "label", F.lit(0).alias("role"))
    asked = searches.select("block", "copies", "part", "node", "label", F.lit(1).alias("role"))
    rows = held.unionByName(asked).join(sets.select("node", "tokens"), "node")
    return rows.groupBy("block", "copies", "part").applyInArrow(_search(threshold), "a long, b long")


def _dealt(asks: DataFrame) -> DataFrame:
    """asks (block, node, label) with copies and part: a block is copied as often as its searchers, counted, need it; a node searches one copy."""
    crowded = stage(asks.groupBy("block").agg(F.count("*").alias("searchers")).where(F.col("searchers") > SEARCHES), "crowded")
    if crowded.count() <= BROADCAST_NODES:
        crowded = F.broadcast(crowded)
    copies = F.coalesce(F.ceil(F.col("searchers") / SEARCHES), F.lit(1)).cast("long")
    return asks.join(crowded, "block", "left").select("block", copies.alias("copies"), F.pmod(F.xxhash64("node", F.lit(7)), copies).cast("int").alias("part"), "node", "label")


def _size_bin(n, threshold: int):
    """Sets that may link are in the same bin or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / max(1e-3, 1.001 * math.log(100 / threshold))).cast("int")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles (its set's size) and component_id (the smallest doc_id reachable by links).

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
    A text of 1 to k - 1 words is one shingle of all its words; a null or empty
    text, or one of white space, has an empty set, links with nothing and is
    its own component.  A row with a null id takes its component's smallest
    non-null id (null if there is none).  Repeated rows are rows of their own
    in the result and share a component.  Sets are compared by 64-bit hashes of
    their shingles.  Other columns of the input are ignored, whatever their
    names; an empty table gives an empty table.
    """
    with scratch(docs.sparkSession, "digests", "components"):
        return _components(docs, id_col, text_col, k, threshold)


def _components(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(texts.mapInArrow(_digests(k, threshold), "doc_id long, n long, node long, sketch binary"), "digests")
    full = rows.where("node is not null")
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = full.agg(F.sum("n")).first()[0] or 0
    buckets = max(shuffles, total * 3 // 10 // (2 * CHUNK))
    credits = (
        full.select("node", "sketch")
        .mapInArrow(_offers(buckets), "bucket int, kind byte, tokens binary, nodes binary")
        .groupBy("bucket")
        .applyInArrow(_credits, "node long, credit long")
        .groupBy("node")
        .agg(F.sum("credit").alias("credit"))
    )
    need = F.greatest(F.lit(1), F.ceil(F.col("n") / 10) - 1)
    hopeful = stage(nodes.join(credits, "node").where(F.col("credit") >= need).select("node", "first_id", "n"), "hopeful")

    chosen = hopeful.where("first_id is not null").select(F.col("first_id").alias("doc_id"), "node")
    if hopeful.count() <= BROADCAST_NODES:
        chosen = F.broadcast(chosen)
    sets_of = lambda df: df.select("node", "text").mapInArrow(_sets(k), "node long, n long, tokens binary")
    sets = sets_of(texts.where("text is not null").join(chosen, "doc_id"))  # a node twice, if its row is repeated, changes no class
    nameless = hopeful.where("first_id is null").select("node")
    if held := nameless.count():  # found by their key, as no id leads to their texts
        any_node = sets_of(texts.where("text is not null and doc_id is null").withColumn("node", F.lit(None).cast("long")))
        own = any_node.join(F.broadcast(nameless) if held <= BROADCAST_NODES else nameless, "node", "left_semi")
        sets = sets.unionByName(own.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    sets = stage(sets, "sets")

    common = (
        sets.select("tokens")
        .mapInArrow(_token_counts(shuffles), "bucket int, tokens binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(_frequent, "token long, df long")
        .orderBy(F.desc("df"), "token")
        .limit(HOT_TOKENS)
        .collect()  # HOT_TOKENS rows at most
    )
    hot = np.array([r.token for r in reversed(common)], dtype=np.int64).view(np.uint64)

    postings = stage(sets.mapInArrow(_postings(hot, threshold), "token long, node long, n long"), "postings")
    hub = lambda i: F.min_by(F.struct("node", "n"), F.struct(F.xxhash64("node", F.lit(i)), "node")).alias(f"hub{i}")
    lists = stage(postings.groupBy("token").agg(F.count("*").alias("size"), *map(hub, range(HUBS))).where("size > 1").drop("size"), "lists")
    live = stage(postings.join(lists, "token"), "live")

    # Hubs: a block is one hub, and all members of its lists search it.
    asks = live.select("node", "n", F.explode(F.array(*(f"hub{i}" for i in range(HUBS)))).alias("hub")).where(
        f"node <> hub.node and 100 * least(n, hub.n) >= {threshold} * greatest(n, hub.n)"
    )
    asks = stage(asks.select(F.col("hub.node").alias("block"), "node", F.col("node").alias("label")).distinct(), "asks")
    asks = stage(_dealt(asks), "dealt")
    hubs = asks.select("block").distinct().select("block", F.col("block").alias("node"), F.col("block").alias("label"))
    links = stage(_run_searches(hubs, asks, sets, threshold), "links")
    labels = connected_components(links)

    # The rest: lists that still hold several classes. Of two nodes that of the smaller class is indexed, the other searches.
    classes = labels.groupBy("label").agg(F.count("*").alias("held")).withColumnRenamed("label", "class")
    labels = stage(labels.join(classes, F.col("label") == F.col("class")).select("node", "label", "held"), "labels")
    rank = F.struct(F.coalesce("held", F.lit(1)).alias("held"), F.coalesce("label", "node").alias("label"))
    labelled = live.select("token", "node", "n", F.col("hub0.node").alias("home")).join(labels, "node", "left")
    labelled = stage(labelled.withColumn("rank", rank).drop("label", "held"), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high").select("token", "high")
    members = stage(labelled.join(stage(mixed, "mixed"), "token"), "members")
    minor = members.where("rank < high").groupBy("node").agg(F.mode("home", True).alias("home"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    minor = stage(minor.withColumn("bin", _size_bin(F.col("n"), threshold)), "minor")
    homes = minor.groupBy("home", "bin").agg(F.count("*").alias("held"))
    block = F.xxhash64("home", "bin", F.pmod(F.xxhash64("node", F.lit(11)), F.ceil(F.col("held") / BLOCK)))
    index = stage(minor.join(homes, ["home", "bin"]).select(block.alias("block"), "node", "rank", "bin"), "index")
    # Blocks hold sets of one bin of sizes, so a list's members meet only those of its blocks that hold sets of about their size.
    reach = members.where("rank < high").select("token", "node").join(index, "node").groupBy("token", "block", "bin").agg(F.min("rank").alias("low"))
    reach = reach.select("token", "block", "low", F.explode(F.array(*(F.col("bin") + i for i in (-1, 0, 1)))).alias("bin"))
    asking = members.select("token", "node", "n", "rank", _size_bin(F.col("n"), threshold).alias("bin"))
    shared = asking.join(reach, ["token", "bin"]).where("rank > low")
    shared = shared.groupBy("block", "node").agg(F.count("*").alias("tokens"), F.first("n").alias("n"), F.first("rank").alias("rank"))
    # Partners share a tenth of the smaller set's size, less one, in both prefixes, and a partner has ``threshold`` percent of n at least.
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold / 1000) - 1)
    asks = stage(shared.where(F.col("tokens") >= needed).select("block", "node", F.col("rank.label").alias("label")), "asks")
    asks = stage(_dealt(asks), "dealt")
    index = index.select("block", "node", F.col("rank.label").alias("label"))
    more = _run_searches(index, asks, sets, threshold)

    whole = connected_components(links.unionByName(stage(more, "links")))
    names = stage(whole.join(nodes.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("component_id")), "names")
    if names.count() <= BROADCAST_NODES:  # a class may hold a third of all nodes, so they are not dealt out by class if that can be helped
        names = F.broadcast(names)
    named = whole.join(names, "label").select(F.col("node").alias("linked"), "component_id")
    ids = stage(
        nodes.join(named, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")), "components"
    )
    return (
        rows.select("doc_id", "n", "node")
        .join(ids, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )
