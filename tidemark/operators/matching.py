"""A stated set of queries against all rows, block by block, as products of dense matrices.

Term and vector scores of many queries share almost all their work: a block of documents is tokenised in the JVM, counted
once, and multiplied with the queries' terms. Only the best rows of each block and query leave the worker, so nothing of the
size of documents x queries is shuffled, and no document's terms are. Queries are counted first; more than fit one broadcast
are taken in several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T

PAIRS = 2_000_000  #: (query, term) pairs of a pass, some 40 MB
NUMBERS = 4_000_000  #: vector components of a pass, 32 MB
CELLS = 4_000_000  #: cells of a block's matrices
TOKENS = 2_000_000  #: tokens counted at once


@dataclass
class Terms:
    """Query terms: item and term of each pair, and how often the query has it. norm: of a query's term counts."""

    items: np.ndarray
    words: dict[str, int]
    item: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @property
    def norm(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.item, self.count**2, len(self.items)))

    def matrix(self, low: int, high: int, value: np.ndarray) -> np.ndarray:
        """[word, query] for the queries from low to high."""
        mine = (self.item >= low) & (self.item < high)
        out = np.zeros((len(self.words), high - low))
        out[self.word[mine], self.item[mine] - low] = value[mine]
        return out


def passes(queries: DataFrame) -> Iterator[Terms]:
    """queries: item_id, text. Their terms, in as many parts as their number asks for. Queries without a term are in none."""
    counts = queries.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    some = counts.limit(PAIRS + 1).toArrow()
    parts = 1 if some.num_rows <= PAIRS else -(-counts.count() // PAIRS)
    for p in range(parts):
        rows = some if parts == 1 else counts.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).toArrow()
        items, item = np.unique(rows.column("item_id").to_numpy(), return_inverse=True)
        term = rows.column("term").combine_chunks().dictionary_encode()
        term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
        yield Terms(items, {w: i for i, w in enumerate(term.dictionary.to_pylist())}, item, term.indices.to_numpy(), rows.column("n").to_numpy().astype(float))


class Block:
    """Documents of a batch with their query terms counted. tf: [document, word]; length and norm count all tokens."""

    def __init__(self, batch: pa.RecordBatch, words: dict[str, int]) -> None:
        self.batch, tokens = batch, batch.column("tokens")
        ends = tokens.offsets.to_numpy()
        flat = tokens.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        doc, code = np.repeat(np.arange(len(tokens)), np.diff(ends)), flat.indices.to_numpy()
        self.length = np.diff(ends).astype(float)
        wide = len(flat.dictionary)
        at, n = np.unique(doc * wide + code, return_counts=True) if wide else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc, code = at // max(wide, 1), at % max(wide, 1)
        self.norm, self.distinct = np.sqrt(np.bincount(doc, n.astype(float) ** 2, len(tokens))), np.bincount(doc, minlength=len(tokens)).astype(float)
        known = np.fromiter((words.get(w, -1) for w in flat.dictionary.to_pylist()), np.int64, wide)
        word = known[code] if wide else code
        self.tf = np.zeros((len(tokens), len(words)))
        self.tf[doc[word >= 0], word[word >= 0]] = n[word >= 0]


def blocks(batches: Iterator[pa.RecordBatch], words: dict[str, int]) -> Iterator[Block]:
    """The batches cut so that neither a block's matrices nor its tokens grow beyond a bound; at least one document each."""
    rows = max(1, CELLS // max(len(words), 1))
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("tokens").offsets.to_numpy())) if batch.num_rows else np.zeros(0, np.int64)
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + TOKENS
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, most, "right"))))
            yield Block(batch.slice(at, to - at), words)
            at = to


def spans(block: Block, n: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(block.batch.num_rows, 1))
    for low in range(0, n, step):
        yield low, min(n, low + step)


def best(order: list[np.ndarray], allowed: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of the `top` rows of each query, by descending order[0], then the others. order: [row, query] each; a
    one-dimensional one goes by row."""
    first = np.where(allowed, order[0], -np.inf)
    if len(first) > top:
        edge = np.partition(first, len(first) - top, axis=0)[len(first) - top]
        allowed = allowed & (first >= edge)
    row, query = np.nonzero(allowed)
    keys = [-(o[row] if o.ndim == 1 else o[row, query]) for o in reversed(order)]
    sort = np.lexsort([*keys, query])
    row, query = row[sort], query[sort]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    nth = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    return row[nth < top], query[nth < top]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out over all cores, if what they are read from is so small that there may be fewer splits than cores: a bounded
    number of bytes. Larger inputs stay as they are. Only the plan is looked at; nothing runs."""
    spark = rows.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return rows.repartition(cores) if size < cores * split else rows


def tokenised(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))


def over(rows: DataFrame, terms: Terms, emit: Callable[[Block, Terms], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """emit for each block of tokenised rows. The terms are broadcast once; their size is bounded by passes()."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, sent.value.words):
            yield from emit(block, sent.value)

    return rows.mapInArrow(run, schema)


def united(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ranked(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)


def bm25(docs: DataFrame, queries: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best documents of each query: item_id, doc_id, score, rank; ties go to the smaller doc_id. One pass counts in how many
    documents each query term is and how long they are, the other scores."""
    rows, out = tokenised(dealt(docs), "doc_id"), []
    for terms in passes(queries):
        n, length, df = corpus(rows, terms)
        distinct = np.ones(len(terms.item))
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)

        def emit(block: Block, terms: Terms, idf=idf, mean=length, distinct=distinct) -> Iterator[pa.RecordBatch]:
            weight = idf * block.tf * (k1 + 1) / (block.tf + k1 * (1 - b + b * block.length[:, None] / mean) + 1e-300)
            ids = block.batch.column("doc_id").to_numpy()
            for low, high in spans(block, len(terms.items)):
                q = terms.matrix(low, high, distinct)
                score = np.round(weight @ q, 6)
                row, query = best([score, -ids], (block.tf > 0).astype(float) @ q > 0, top)
                yield pa.RecordBatch.from_arrays([pa.array(terms.items[low + query]), pa.array(ids[row]), pa.array(score[row, query])], names=["item_id", "doc_id", "score"])

        out.append(over(rows, terms, emit, "item_id long, doc_id long, score double"))
    return ranked(united(out, rows.sparkSession.createDataFrame([], "item_id long, doc_id long, score double")), "item_id", [F.desc("score"), "doc_id"], top)


def corpus(rows: DataFrame, terms: Terms) -> tuple[int, float, np.ndarray]:
    """(documents, their mean number of tokens, documents that have each word). Each block gives one row of sums."""

    def emit(block: Block, terms: Terms) -> Iterator[pa.RecordBatch]:
        got = (block.tf > 0).sum(0)
        word = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(word, -1)), pa.array(np.append(got[word], block.batch.num_rows)), pa.array(np.append(np.zeros(len(word)), block.length.sum()))], names=["word", "n", "length"])

    sums = over(rows, terms, emit, "word long, n long, length double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).toArrow().to_pydict()
    df, n, length = np.zeros(len(terms.words)), 0, 0.0
    for word, count, size in zip(sums["word"], sums["n"], sums["length"], strict=True):
        if word < 0:
            n, length = count, size
        else:
            df[word] = count
    return n, length / n if n else 1.0, df


def tf_cosine(docs: DataFrame, queries: DataFrame, least: int = 1) -> DataFrame:
    """item_id, doc_id, cosine of term-count vectors, overlap (shared distinct terms, `least` at least)."""
    rows, out = tokenised(dealt(docs), "doc_id"), []

    def emit(block: Block, terms: Terms) -> Iterator[pa.RecordBatch]:
        ids, there = block.batch.column("doc_id").to_numpy(), (block.tf > 0).astype(float)
        for low, high in spans(block, len(terms.items)):
            dot, overlap = block.tf @ terms.matrix(low, high, terms.count), there @ terms.matrix(low, high, np.ones(len(terms.item)))
            row, query = np.nonzero(overlap >= max(least, 1))
            cosine = dot[row, query] / (block.norm[row] * terms.norm[low + query])
            yield pa.RecordBatch.from_arrays([pa.array(terms.items[low + query]), pa.array(ids[row]), pa.array(cosine), pa.array(overlap[row, query].astype(np.int64))], names=["item_id", "doc_id", "cosine", "overlap"])

    schema = "item_id long, doc_id long, cosine double, overlap long"
    return united([over(rows, terms, emit, schema) for terms in passes(queries)], rows.sparkSession.createDataFrame([], schema))


def idf_coverage(docs: DataFrame, queries: DataFrame, least: float = 0.0) -> DataFrame:
    """Share of a query's idf mass, ln(1 + N / (1 + df)), that a document covers: item_id, doc_id, coverage over `least`."""
    rows, out = tokenised(dealt(docs), "doc_id"), []
    for terms in passes(queries):
        n, _, df = corpus(rows, terms)
        idf = np.log(1 + n / (1 + df))

        def emit(block: Block, terms: Terms, idf=idf) -> Iterator[pa.RecordBatch]:
            ids, there = block.batch.column("doc_id").to_numpy(), (block.tf > 0).astype(float)
            value = idf[terms.word]
            mass = np.bincount(terms.item, value, len(terms.items))
            for low, high in spans(block, len(terms.items)):
                got = there @ terms.matrix(low, high, value)
                row, query = np.nonzero(got > 0)
                share = np.round(got[row, query] / mass[low + query], 6)
                keep = share > least
                yield pa.RecordBatch.from_arrays([pa.array(terms.items[low + query[keep]]), pa.array(ids[row[keep]]), pa.array(share[keep])], names=["item_id", "doc_id", "coverage"])

        out.append(over(rows, terms, emit, "item_id long, doc_id long, coverage double"))
    return united(out, rows.sparkSession.createDataFrame([], "item_id long, doc_id long, coverage double"))


def unit(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """([row, dims] of length 1, whether the row has a vector of these dimensions that isn't zero)."""
    size = np.diff(vectors.offsets.to_numpy())
    there = (size == dims) & ~np.asarray(vectors.is_null())
    out = np.zeros((len(vectors), dims))
    if there.any():
        out[there] = pa.concat_arrays([vectors.filter(pa.array(there)).flatten()]).to_numpy(zero_copy_only=False).reshape(-1, dims)
    norm = np.linalg.norm(out, axis=1)
    return out / np.maximum(norm, 1e-300)[:, None], there & (norm > 0)


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """vectors and queries: vec_id, embedding, all of one width. The nearest vectors of each query by cosine, itself left out:
    query_id, vec_id, cosine, rank. Zero vectors have the cosine 0 with all."""
    spark = vectors.sparkSession
    dims = int(queries.agg(F.max(F.size("embedding"))).first()[0] or 0)
    count = queries.count() if dims > 0 else 0
    parts = max(1, -(-count * dims // NUMBERS))
    schema, out = "query_id long, vec_id long, cosine double", []
    for p in range(parts if count else 0):
        rows = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p)).select("vec_id", "embedding").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), unit(rows.column("embedding").combine_chunks() if isinstance(rows.column("embedding"), pa.ChunkedArray) else rows.column("embedding"), dims)[0]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    ids, m = part.column("vec_id").to_numpy(), unit(part.column("embedding"), dims)[0]
                    step = max(1, CELLS // len(ids))
                    for low in range(0, len(names), step):
                        cosine = np.round(m @ q[low : low + step].T, 6) + 0.0
                        row, query = best([cosine, -ids], ids[:, None] != names[None, low : low + step], top)
                        yield pa.RecordBatch.from_arrays([pa.array(names[low + query]), pa.array(ids[row]), pa.array(cosine[row, query])], names=["query_id", "vec_id", "cosine"])

        out.append(vectors.select("vec_id", "embedding").mapInArrow(run, schema))
    return ranked(united(out, spark.createDataFrame([], schema)), "query_id", [F.desc("cosine"), "vec_id"], top)


ALL, NONE = -1, -2  #: a null name, and one that no query has


def numbered(names: pa.Array, known: dict[str, int]) -> np.ndarray:
    coded = names.dictionary_encode()
    table = np.array([known.get(x, NONE) for x in coded.dictionary.to_pylist()] + [ALL])
    return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def hybrid(memories: DataFrame, queries: DataFrame, top: int, floor: float = 0.0, relevance_first: bool = False, least: float = 0.05) -> DataFrame:
    """The ranked recall: item_id, memory_id, score, rank and the parts of the score.

    memories: memory_id, text, tenant, workspace (null: shared), security (rank), trust_tier, confidence, strength (the part that
    doesn't depend on the query), by_kind (array: the part that depends on the query's kind), embedding (null: none).
    queries: item_id, text, tenant (null: all), workspace (null: all), clearance, kind (place in by_kind), embedding (null: none).
    A memory is a candidate if it shares a term, or if both have vectors and their cosine reaches the floor; a cosine under the
    floor shuts it out. Totals of `least` or less are dropped. relevance_first picks by the parts that speak of the query.
    """
    columns = ("memory_id", "tenant", "workspace", "security", "trust_tier", "confidence", "strength", "by_kind", "embedding")
    rows, out = tokenised(memories, *columns), []
    schema = "item_id long, memory_id long, score double, relevance double, semantic double, lexical double, embedding double, by_kind double, strength double, trust_tier int, confidence double"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    for terms in passes(queries):
        asked = queries.select("item_id", "tenant", "workspace", "clearance", "kind", "embedding").where(F.col("item_id").isin(terms.items.tolist()) if len(terms.items) <= 1000 else F.lit(True)).toArrow()
        place = {i: n for n, i in enumerate(asked.column("item_id").to_pylist())}
        asked = asked.take([place[i] for i in terms.items.tolist()]).combine_chunks()
        one = lambda c: asked.column(c).to_pylist()
        vectors = asked.column("embedding")
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        dims = int(max(np.diff(vectors.offsets.to_numpy()), default=0))
        names_of = [{v: i for i, v in enumerate(sorted({x for x in one(c) if x is not None}))} for c in ("tenant", "workspace")]
        numbers = [np.array([ALL if x is None else known[x] for x in one(c)]) for c, known in zip(("tenant", "workspace"), names_of, strict=True)]
        context = (names_of, numbers, np.array(one("clearance")), np.array(one("kind")), *unit(vectors, dims), dims)
        sent = rows.sparkSession.sparkContext.broadcast(context)

        def emit(block: Block, terms: Terms, sent=sent) -> Iterator[pa.RecordBatch]:
            names_of, (tenant, workspace), clearance, kind, q, has, dims = sent.value
            b = block.batch
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            ids, trust, sure, strength = get("memory_id"), get("trust_tier"), get("confidence"), get("strength")
            kinds = b.column("by_kind").flatten().to_numpy().reshape(len(ids), -1)
            mine, workspaces = (numbered(b.column(c), known) for c, known in zip(("tenant", "workspace"), names_of, strict=True))
            security, there = get("security"), (block.tf > 0).astype(float)
            m, with_vector = unit(b.column("embedding"), dims)
            for low, high in spans(block, len(terms.items)):
                cosine = block.tf @ terms.matrix(low, high, terms.count)
                cosine = cosine / np.maximum(block.norm[:, None] * terms.norm[None, low:high], 1e-300)
                overlap = there @ terms.matrix(low, high, np.ones(len(terms.item)))
                near, both = m @ q[low:high].T, with_vector[:, None] & has[None, low:high]
                may = (mine[:, None] == tenant[None, low:high]) | (tenant == ALL)[None, low:high]
                may &= (workspaces[:, None] == workspace[None, low:high]) | (workspaces == ALL)[:, None] | (workspace == ALL)[None, low:high]
                may &= security[:, None] <= clearance[None, low:high]
                may &= np.where(both, near >= floor, overlap > 0)
                parts = {"semantic": 2 * cosine, "lexical": np.minimum(0.3 * overlap, 1.2), "embedding": np.where(both, 2 * near, 0.0), "by_kind": kinds[:, kind[low:high]]}
                relevance = parts["semantic"] + parts["lexical"] + parts["embedding"] + parts["by_kind"]
                score = np.round(relevance + strength[:, None], 6)
                relevance = np.round(relevance, 6)
                may &= score > least
                row, query = best([relevance, score, trust, -ids] if relevance_first else [score, trust, sure, -ids], may, top)
                pick = {"item_id": terms.items[low + query], "memory_id": ids[row], "score": score[row, query], "relevance": relevance[row, query], "strength": strength[row], "trust_tier": trust[row], "confidence": sure[row]} | {k: np.round(v[row, query], 6) for k, v in parts.items()}
                yield pa.RecordBatch.from_arrays([pa.array(pick[n]) for n in names], names=names)

        out.append(over(rows, terms, emit, schema))
    found = united(out, rows.sparkSession.createDataFrame([], schema))
    if relevance_first:
        found = ranked(found, "item_id", [F.desc("relevance"), F.desc("score"), F.desc("trust_tier"), "memory_id"], top).drop("rank")
    return ranked(found, "item_id", [F.desc("score"), F.desc("trust_tier"), F.desc("confidence"), "memory_id"], top)
