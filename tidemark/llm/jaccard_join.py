"""Operator 8: an exact self-join of word n-gram sets by Jaccard similarity, and its connected components.

1. Blocks of documents count in how many texts each n-gram occurs (exchange of blocks.py). Rarer n-grams come first in the
   global order, so a set's prefix, of which any similar set must share an element, holds its rarest n-grams; those that
   occur in one text alone can't be shared and are dropped.
2. Documents that share an element of their prefixes are joined into clusters, through stars instead of pairs. Every link
   lies within a cluster, and most documents are in none.
3. A cluster's different sets are stored in a prefix tree, ordered by their frequency in the cluster. Traversal shares the overlap of
   common beginnings, and leaves a subtree when the remaining lengths can't reach the threshold, or when all its sets are
   in the query's component already: what is connected needs no further link.
4. A cluster too large for one task is dealt into parts that are joined each by itself. A few sets of each component found
   are then dealt out and joined again, round by round, so that a large group of near copies becomes one component at linear cost.
   If components remain apart, the sets that share a prefix element are joined in trees of their own, element by element:
   those of the element's largest component, in parts, each against all others, which alone are repeated.

Equal sets are one class throughout, so copies cost nothing but their row.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.blocks import NULL_ID, by_bucket, chain, mix, n_buckets, pack, pack_counts, runs_by_bucket, texts_of, unpack, unpack_counts, word_hashes, write_blocks
from tidemark.llm.common import FEW, gathered, joined, materialise, partitions_for
from tidemark.llm.components import IN_ONE_TASK, components

PART_SETS, PART_SIZE = 600, 1 << 20  #: sets, and elements of them, that one prefix tree takes in
SPEAKERS = 8  #: sets of a component that stand for it while components of a large cluster are joined
_TRUNCATE = np.uint64(24)  # bits left out while occurrences are counted; they only decide the order
_POS_BITS = 22
_DIGEST = 16  #: bytes of the sha256 that tell texts of one doc_id apart


class Sets:
    """The n-gram sets of a block's documents: doc, key sorted by both; n, and a 128-bit sum that equal sets share."""

    def __init__(self, texts: list[bytes], k: int) -> None:
        h, lens = word_hashes(texts)
        first = np.cumsum(lens) - lens
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        g = chain(np.zeros(len(h), np.uint64), h)
        keys, docs = [], []
        for j in range(1, k + 1):
            if j > 1:
                g = chain(g[:-1], h[j - 1 :])
            if j < k:  # shorter documents have their whole sequence
                short = np.flatnonzero(lens == j)
                keys.append(mix(g[first[short]] + np.uint64(j)))
                docs.append(short)
        if len(g):
            at = np.arange(len(g))
            whole = at + k <= (first + lens)[doc[: len(g)]]
            keys.append(g[whole])
            docs.append(doc[: len(g)][whole])
        key, doc = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int32)
        del h, g, keys, docs
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        self.key, self.doc = key[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(lens)).astype(np.int64)
        self.some = np.flatnonzero(self.n)
        starts = (np.cumsum(self.n) - self.n)[self.some]
        self.sums = np.zeros((2, len(lens)), np.uint64)
        if len(starts):
            self.sums[0, self.some] = np.add.reduceat(mix(self.key), starts)
            self.sums[1, self.some] = np.add.reduceat(mix(self.key ^ np.uint64(0xA0761D6478BD642F)), starts)
        seen: dict[tuple, int] = {}
        self.rep = np.zeros(len(lens), bool)  # the first document of each set in the block
        for i in self.some.tolist():
            self.rep[i] = seen.setdefault((self.n[i], self.sums[0, i], self.sums[1, i]), i) == i


_A = pa.schema([("block", pa.int64()), ("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("digest", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_A_DDL = "block long, node long, doc_id long, n long, s1 long, s2 long, digest binary, bucket int, keys binary, counts binary"
_B = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("skip", pa.int64()), ("payload", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])
_B_DDL = "node long, n long, skip long, payload binary, a long, b long, bucket int, keys binary, nodes binary"


def _table(schema: pa.Schema, rows: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in schema], schema=schema)


def _sets_and_requests(k: int, n_b: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = texts_of(row)
                sets = Sets(texts, k)
                s = sets.sums.view(np.int64)
                yield _table(_A, {"block": np.full(len(ids), row["block"]), "node": (row["block"] << _POS_BITS) + np.arange(len(ids)), "doc_id": ids, "n": sets.n, "s1": s[0], "s2": s[1]} | ({"digest": [hashlib.sha256(t).digest()[:_DIGEST] for t in texts]} if digests else {}), len(ids))
                keys, counts = np.unique(sets.key[sets.rep[sets.doc]] >> _TRUNCATE, return_counts=True)
                out = [(b, pack(keys[i:j]), pack_counts(counts[i:j])) for b, i, j in runs_by_bucket(keys << _TRUNCATE, n_b)]
                if out:
                    yield _table(_A, {"block": [row["block"]] * len(out), "bucket": [x[0] for x in out], "keys": [x[1] for x in out], "counts": [x[2] for x in out]}, len(out))

    return run


def _occurrences(bucket: int, asked: list[dict]) -> Iterator[pa.RecordBatch]:
    """Answers each block with the logarithm of its keys' occurrences (0: one text alone)."""
    held = [(r["block"], unpack(r["keys"]), unpack_counts(r["counts"], 1)[0]) for r in asked]
    _, inverse = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([h[2] for h in held]))
    code = np.minimum(np.log2(total), 255).astype(np.uint8)
    at = 0
    for block, keys, _ in held:
        body = zstandard.compress(code[inverse[at : at + len(keys)]].tobytes(), 1)
        at += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], names=["block", "bucket", "codes"])


class Forest:
    """Union-find over arbitrary integers; the smallest is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (r := self.up.get(root, root)) != root:
            root = r
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the edges."""
    pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    f = Forest()
    kept = [(x, y) for x, y in pairs.tolist() if f.union(x, y)]
    return [x for x, _ in kept], [y for _, y in kept]


def _postings(k: int, percent: int, n_b: int):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if block.num_rows and replies.num_rows:
            row = block.to_pylist()[0]
            sets = Sets(texts_of(row)[1], k)
            mine = np.flatnonzero(sets.rep[sets.doc])
            key, doc = sets.key[mine], sets.doc[mine]
            got = sorted(replies.to_pylist(), key=lambda r: r["bucket"])
            codes = np.concatenate([np.frombuffer(zstandard.decompress(r["codes"]), np.uint8) for r in got if r["codes"] is not None] + [np.zeros(0, np.uint8)])
            first_of_class = np.zeros(len(sets.n), bool)
            for r in got:
                first_of_class[r["reps"] or []] = True
            small, inverse = np.unique(key >> _TRUNCATE, return_inverse=True)
            assert len(small) == len(codes), "answers are missing"
            code = codes[inverse]
            mine = first_of_class[doc]  # a set that other blocks hold too goes on once
            key, doc, code = key[mine], doc[mine], code[mine]
            order = np.lexsort((key, code, doc))
            key, doc, code = key[order], doc[order], code[order]
            n = np.bincount(doc, minlength=len(sets.n))
            first = np.cumsum(n) - n
            prefix = n - (percent * n + 99) // 100 + 1
            shared = (np.arange(len(doc)) - first[doc] < prefix[doc]) & (code > 0)
            found = np.unique(doc[shared])
            node = (row["block"] << _POS_BITS) + np.arange(len(n))
            lone = np.bincount(doc[code == 0], minlength=len(n))
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                out.append(_table(_B, {"node": node[part], "n": n[part], "skip": lone[part], "payload": [key[first[d] : first[d] + n[d]].astype("<u8").tobytes() for d in part]}, len(part)))
            t, who = key[shared], node[doc[shared]]
            order = np.lexsort((who, t))
            t, who = t[order], who[order]
            same = np.flatnonzero(t[1:] == t[:-1])
            a, b = _forest(who[same], who[same + 1])
            out.append(_table(_B, {"a": a, "b": b}, len(a)))
            one = np.append(True, t[1:] != t[:-1]) if len(t) else np.zeros(0, bool)
            t, who = t[one], who[one]
            sent = [(i, pack(t[x:y]), who[x:y].astype("<i8").tobytes()) for i, x, y in runs_by_bucket(t, n_b)]
            out.append(_table(_B, {"bucket": [x[0] for x in sent], "keys": [x[1] for x in sent], "nodes": [x[2] for x in sent]}, len(sent)))
        return pa.Table.from_batches(out, _B)

    return run


def _stars(bucket: int, asked: list[dict]) -> Iterator[pa.RecordBatch]:
    held = [(unpack(r["keys"]), np.frombuffer(r["nodes"], "<i8")) for r in asked]
    t, who = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    order = np.lexsort((who, t))
    t, who = t[order], who[order]
    same = np.flatnonzero(t[1:] == t[:-1])
    a, b = _forest(who[same], who[same + 1])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Node:
    __slots__ = ("seg", "end", "children", "docs", "least", "most", "one")

    def __init__(self, seg: np.ndarray, end: int, least: int, most: int, one: int) -> None:
        self.seg, self.end, self.children, self.docs, self.least, self.most, self.one = seg, end, {}, [], least, most, one


class PrefixTree:
    """Sets of ranks, ascending; a node holds a stretch of ranks that all sets below share.

    least, most: lengths of the sets below. one: a set below, if all of them were in its component when last seen; else -1.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.forest = percent, Forest()
        self.root = _Node(np.zeros(0, np.int64), 0, 1 << 60, 0, -1)

    def links(self, q: int, ranks: np.ndarray, mark: np.ndarray) -> list[tuple[int, int]]:
        """New links of set q, joined into the components. mark: its ranks as a boolean vector."""
        p, find, nq = self.percent, self.forest.find, len(ranks)
        out, stack = [], [(self.root, 0)]
        mine = find(q)
        while stack:
            node, o = stack.pop()
            for d in node.docs:
                if (100 + p) * o >= p * (nq + node.end) and find(d) != mine:
                    self.forest.union(d, q)
                    out.append((d, q))
                    mine = find(q)
            for child in node.children.values():
                if child.most * 100 < p * nq or child.least * p > 100 * nq or (child.one >= 0 and find(child.one) == mine):
                    continue
                got = o + int(np.count_nonzero(mark[child.seg]))
                if (100 + p) * (got + child.most - child.end) < p * (nq + child.most):
                    continue
                rest = nq - int(np.searchsorted(ranks, child.seg[-1], "right"))
                if (100 + p) * (got + rest) < p * (nq + child.least):
                    continue
                stack.append((child, got))
        return out

    def insert(self, q: int, ranks: np.ndarray) -> None:
        n, at, node, find = len(ranks), 0, self.root, self.forest.find
        mine = find(q)
        while at < n:
            child = node.children.get(int(ranks[at]))
            if child is None:
                child = node.children[int(ranks[at])] = _Node(ranks[at:], n, n, n, q)
                node = child
                break
            wide = min(len(child.seg), n - at)
            differ = np.flatnonzero(child.seg[:wide] != ranks[at : at + wide])
            same = int(differ[0]) if len(differ) else wide
            if same < len(child.seg):  # cut the stretch in two
                upper = _Node(child.seg[:same], at + same, child.least, child.most, child.one)
                child.seg = child.seg[same:]
                upper.children[int(child.seg[0])] = child
                node.children[int(ranks[at])] = upper
                child = upper
            child.least, child.most = min(child.least, n), max(child.most, n)
            if child.one >= 0 and find(child.one) != mine:
                child.one = -1
            at += same
            node = child
        node.docs.append(q)


def tree_links(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets of distinct 64-bit keys that connect whatever the threshold connects; positions of the sets.

    known: the component each set is in already; links within one aren't looked for.
    """
    first: dict[int, int] = {}
    same = [(first.setdefault(c, i), i) for i, c in enumerate(known or [])]
    if len(sets) < 2 or (known and len(first) < 2):
        return []
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum([len(s) for s in sets])
    tree, out, mark = PrefixTree(percent), [], np.zeros(len(counts), bool)
    for x, y in same:
        tree.forest.union(x, y)
    for q in np.argsort([len(s) for s in sets], kind="stable").tolist():
        ranks = np.sort(rank[inverse[ends[q] - len(sets[q]) : ends[q]]])
        mark[ranks] = True
        out += tree.links(q, ranks, mark)
        mark[ranks] = False
        tree.insert(q, ranks)
    return out


def _join_groups(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """rows: keys, node, comp, payload. Links a, b within each group of rows that agree in the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, comps, sets = None, [], [], []

        def flush() -> pa.RecordBatch:
            got = tree_links(sets, percent, comps)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in got], pa.int64()), pa.array([nodes[j] for _, j in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if (now := tuple(r[k] for k in keys)) != key:
                        yield flush()
                        key, nodes, comps, sets = now, [], [], []
                    nodes.append(r["node"])
                    comps.append(r["comp"])
                    sets.append(np.frombuffer(r["payload"], "<u8"))
        yield flush()

    dealt = rows.select(*keys, "node", "comp", "payload").repartition(partitions_for(rows.sparkSession), *keys)
    return gathered(dealt.sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long"))


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """rows: node, n, skip, payload, comp. One row for each prefix element that another text has too."""
    out = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n"]
                t = np.frombuffer(r["payload"], "<i8")[r["skip"] : n - (percent * n + 99) // 100 + 1]
                yield pa.RecordBatch.from_arrays([pa.array(t), *(pa.array(np.full(len(t), r[c])) for c in ("node", "comp", "n"))], schema=out)

    return rows.mapInArrow(run, "token long, node long, comp long, size long")


def _sent(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few (IN_ONE_TASK, some 30 MB), so that the sets they pick needn't move."""
    return F.broadcast(rows) if rows.count() <= IN_ONE_TASK else rows


def _links(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """sets: node, n, skip, payload. members: node, cluster of one set a class. Links a, b that connect what the threshold connects."""
    sizes = members.join(sets.select("node", "n"), "node").groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("size"))
    parts = F.ceil(F.greatest(F.col("sets") / PART_SETS, F.col("size") / PART_SIZE)).cast("int")
    sizes = materialise(gathered(sizes.select("cluster", "sets", parts.alias("parts"))), "sizes")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = sets.join(_sent(joined(members, sizes, "cluster", "sets", members.count()).select("node", "cluster", "parts")), "node").withColumn("part", part).withColumn("comp", F.col("node"))
    links = materialise(_join_groups(dealt, ["cluster", "part"], percent), "links")
    large = sizes.where("parts > 1").select("cluster", "sets")
    if large.isEmpty():
        return links
    inside = materialise(gathered(joined(members, large, "cluster", "sets", members.count(), "left_semi")), "inside")
    named = _named(inside, links)
    apart = _apart(named)
    for seed in range(64):  # ends when components no longer grow together
        before = int(apart.agg(F.sum("comps")).first()[0] or 0)
        if not before:
            return links
        turn = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("node", F.lit(seed)), "node"))
        speakers = named.join(apart.select("cluster"), "cluster").withColumn("turn", turn).where(F.col("turn") <= SPEAKERS).drop("turn")
        sizes = speakers.join(sets.select("node", "n"), "node").groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("size")).select("cluster", parts.alias("parts"))
        dealt = sets.select("node", "payload").join(_sent(speakers.join(sizes, "cluster")), "node").withColumn("part", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("parts")).cast("int"))
        links = links.unionByName(materialise(_join_groups(dealt, ["cluster", "part"], percent), "links"))
        named = _named(inside, links)
        apart = _apart(named)
        if int(apart.agg(F.sum("comps")).first()[0] or 0) > 0.9 * before:
            break
    return links.unionByName(_by_element(sets, named.join(apart.select("cluster"), "cluster").select("node", "comp"), percent))


def _named(inside: DataFrame, links: DataFrame) -> DataFrame:
    """node, cluster and comp, the component by the links so far."""
    comps = components(links.join(inside.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"))
    return materialise(gathered(inside.join(comps, "node", "left").select("node", "cluster", F.coalesce("comp", "node").alias("comp"))), "named")


def _apart(named: DataFrame) -> DataFrame:
    """cluster, comps (components) of the clusters that have several."""
    return materialise(gathered(named.select("cluster", "comp").distinct().groupBy("cluster").agg(F.count("*").alias("comps")).where("comps > 1")), "apart")


def _by_element(sets: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """named: node, comp. All links between components among sets that share a prefix element."""
    left = sets.join(_sent(named), "node")
    tokens = materialise(gathered(_prefixes(left.select("node", "n", "skip", "payload", "comp"), percent)), "prefix")
    held = tokens.groupBy("token", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = F.max(F.struct("n", "size", "comp"))
    held = held.groupBy("token").agg(F.sum("n").alias("sets"), F.sum("size").alias("size"), main.alias("main"), F.count("*").alias("comps")).where("comps > 1")
    split = lambda n, size: F.ceil(F.greatest(n / PART_SETS, size / PART_SIZE)).cast("int")
    held = held.select("token", "sets", F.col("main.comp").alias("main"), split(F.col("main.n"), F.col("main.size")).alias("mains"), split(F.col("sets") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others"))
    met = joined(tokens, materialise(gathered(held), "shared"), "token", "sets", tokens.count())
    is_main = F.col("comp") == F.col("main")
    met = met.select("token", "node", "comp", "mains", "others", is_main.alias("is_main"), F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int").alias("part"))
    # a part of the largest component meets each part of the others, and these meet each other
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("others")).otherwise(F.col("mains")) - 1))
    first = met.select("token", "node", "comp", "is_main", "part", other.alias("other"))
    first = first.select("token", "node", "comp", F.when(F.col("is_main"), F.col("part")).otherwise(F.col("other")).alias("low"), F.when(F.col("is_main"), F.col("other")).otherwise(F.col("part")).alias("high"))
    second = met.where("not is_main and others > 1").select("token", "node", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other")).where("part <> other")
    second = second.select("token", "node", "comp", (-1 - F.least("part", "other")).alias("low"), F.greatest("part", "other").alias("high"))
    return materialise(_join_groups(sets.select("node", "payload").join(_sent(first.unionByName(second)), "node"), ["token", "low", "high"], percent), "links")


def _linked(docs: DataFrame, shingle: int, percent: int, digests: bool) -> DataFrame:
    """doc_id (NULL_ID for null), n, digest, component of every row: the smallest doc_id of its component, or the smallest
    (doc_id, digest) with digests, which are those of the lower-cased texts (null without)."""
    blocks = write_blocks(docs)
    n_b = n_buckets(blocks)
    first = materialise(blocks.mapInArrow(_sets_and_requests(shingle, n_b, digests), _A_DDL), "sets")
    rows = first.where("node is not null").select("node", "doc_id", "n", "s1", "s2", "digest")
    asked = first.where("keys is not null").select("block", "bucket", "keys", "counts")
    codes = by_bucket(asked, n_b, _occurrences, "block long, bucket int, codes binary")
    who = F.struct("doc_id", "digest") if digests else F.col("doc_id")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("node").alias("node"), F.min(who).alias("least"), F.count("*").alias("rows"))
    position = F.col("node").bitwiseAND((1 << _POS_BITS) - 1).cast("int")
    reps = classes.groupBy(F.shiftright("node", _POS_BITS).alias("block")).agg(F.collect_list(position).alias("reps"))
    codes = codes.withColumn("reps", F.lit(None).cast("array<int>")).unionByName(reps.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("codes"), "reps"))
    second = materialise(blocks.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_postings(shingle, percent, n_b), _B_DDL), "postings")
    sets = second.where("payload is not null").select("node", "n", "skip", "payload")
    met = by_bucket(second.where("keys is not null").select("bucket", "keys", "nodes"), n_b, _stars, "a long, b long")
    met = materialise(gathered(met), "met")
    clusters = components(met.unionByName(second.where("a is not null").select("a", "b")))
    members = clusters.select("node", F.col("comp").alias("cluster"))
    links = _links(sets, members, percent)
    comps = components(links)
    named = materialise(classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "classes")
    least, total = named.groupBy("comp").agg(F.min("least").alias("component"), F.count("*").alias("classes")), rows.count()
    classed = materialise(joined(named, least, "comp", "classes", total).select("s1", "s2", "n", "component", "rows"), "classed")
    full = joined(rows.where("n > 0"), classed, ["s1", "s2", "n"], "rows", total).select("doc_id", "n", "digest", "component")
    return full.unionByName(rows.where("n = 0").select("doc_id", "n", "digest", who.alias("component")))


def jaccard_components(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    A row's set holds its distinct runs of `shingle` words (runs of bytes other than space and \\x09-\\x0D, ASCII letters
    lowered), or its whole sequence if it has fewer; without words it is empty and linked with nothing. Rows link when
    100 * intersection >= percent * union. A null doc_id counts as the largest.
    """
    out = _linked(docs, shingle, percent, digests=False)
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))


def without_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all columns, that are the smallest of their component, and those without words.

    Rows are told apart by doc_id and text, so other texts of a dropped row's doc_id stay. A null doc_id counts as the largest;
    of rows that share the smallest doc_id the one with the smallest digest of its text, ASCII letters lowered, stays, of
    those that share both the one with the smallest text.
    """
    columns = docs.columns
    found = materialise(_linked(docs, shingle, percent, digests=True), "near")
    first = F.struct("doc_id", "digest") == F.col("component")
    gone = materialise(gathered(found.where(~first).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()), "gone")
    again = found.where("n > 0").where(first).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("rows")).where("rows > 1")
    again = materialise(gathered(again.select("__id", "__digest")), "again")
    lowered = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    id_, digest = F.coalesce("doc_id", F.lit(NULL_ID)), F.substring(F.unhex(F.sha2(lowered.cast("binary"), 256)), 1, _DIGEST)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")
    rows = docs.select(row, id_.alias("__id"), digest.alias("__digest"))
    left = rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, ["__id", "__digest"], "left_anti")
    if not again.isEmpty():
        again = F.broadcast(again) if again.count() <= FEW else again
        one = left.join(again, ["__id", "__digest"], "left_semi").groupBy("__id", "__digest").agg(F.min_by("__row", F.coalesce("__row.text", F.lit(""))).alias("__row"))
        left = left.join(again, ["__id", "__digest"], "left_anti").select("__row").unionByName(one.select("__row"))
    return left.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
