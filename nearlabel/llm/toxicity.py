"""Toxicity by the nearest labelled examples, by exact TF-IDF cosine, with a block-max inverted index.

A text's vector is over all words that occur in the examples, and over those beginnings of words that toxic examples have
far more often than chance allows (log-likelihood ratio, against the number of all terms): weight (1 + ln tf) * idf, times
``BOOST`` for such enriched terms, of length one. Document frequencies are counted over all documents. Equal vectors of
examples are one entry with its numbers of toxic and other examples.

The inverted index has posting lists of rare terms, and for common ones the entries' weights and each block's largest
weight. A query adds up its rare terms' postings; a block's bound is its largest such sum and its largest weights of the
query's common terms. The best blocks are scored for a first floor, and then those blocks alone whose bound reaches the
floor of the k-th best entry, so the k best are exact. Their votes, weighted by closeness, are turned into scores by an isotonic fit to the examples'
leave-one-out votes.

What is broadcast is bounded by ``SAMPLE`` examples of a class and ``SAMPLE_BYTES`` of their text (expected numbers of a
uniform choice by hash); examples of a class that is sampled count the more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlabel.llm import forget
from nearlabel.operators.graph import Scratch

#: Most labelled examples of a class and bytes of their texts (expected), neighbours that vote, entries in a block.
SAMPLE, SAMPLE_BYTES, NEIGHBOURS, BLOCK = 2000, 32 << 20, 15, 32
#: Lengths of word beginnings; weight of the prior in a vote; fewest toxic examples with an enriched term; its factor.
BEGINNINGS, PRIOR, LEAST, BOOST = (4, 5, 6, 7), 0.25, 4, 3.0
#: Blocks that are scored first; up to which share of the blocks the rest is scored by blocks; a term in at least one of
#: so many entries is common; slack of single-precision sums; results that a task keeps.
FIRST, SHARE, COMMON, SLACK, KNOWN = 4, 0.3, 5, 1e-5, 5000

#: Characters of texts that are counted together.
BATCH = 1 << 20


def words_of(texts: list[str | None]) -> pa.Array:
    """Lists of the texts' words, in lower case: runs of letters, digits and underscores; empty strings are none."""
    forget()
    return pc.split_pattern_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), r"[^\pL\pN_]+")


def terms_of(word: str) -> list[str]:
    """The word itself (marked by a final blank) and its beginnings."""
    return [word + " ", *(word[:n] for n in BEGINNINGS if n <= len(word))]


class Terms:
    """Numbers of terms; finds a text's ones without looking at each word's every beginning."""

    def __init__(self, names: list[str]):
        self.size = max(1, len(names))
        self.words = {t[:-1]: k for k, t in enumerate(names) if t.endswith(" ")}
        self.begins = {t: k for k, t in enumerate(names) if not t.endswith(" ")}
        self.heads = {t[: BEGINNINGS[0]] for t in self.begins}

    def count(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each text's terms, rising, and how often they occur. Distinct words of several texts are looked up once."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and size < BATCH:
                part.append(texts[at])
                size += len(part[-1] or "")
                at += 1
            yield from self._counted(words_of(part))

    def _counted(self, found: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        coded = found.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy()
        doc = np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy())
        get, n = self.words.get, BEGINNINGS[0]
        number = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        docs, terms = [doc], [number[which]]
        headed = [k for k, w in enumerate(words) if w[:n] in self.heads]
        for length in BEGINNINGS if headed else ():
            number = np.full(len(words), -1, np.int64)
            number[headed] = [self.begins.get(words[k][:length], -1) if len(words[k]) >= length else -1 for k in headed]
            own = np.flatnonzero(number[which] >= 0)
            docs.append(doc[own]), terms.append(number[which[own]])
        doc, term = np.concatenate(docs), np.concatenate(terms)
        pairs, counts = np.unique((doc * self.size + term)[term >= 0], return_counts=True)
        ids, counts = (pairs % self.size).astype(np.int32), counts.astype(np.int32)
        ends = np.searchsorted(pairs, np.arange(1, len(found) + 1) * self.size)
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield ids[a:z], counts[a:z]


def _spread(begin: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + take[i] - 1 for each i, one after another."""
    ends = np.cumsum(take)
    return np.repeat(begin - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)


def _mark(ids: np.ndarray, weights: np.ndarray) -> bytes:
    """Tells vectors apart."""
    return hashlib.blake2b(ids.tobytes() + weights.tobytes(), digest_size=16).digest()


class Index:
    """Block-max inverted index over entries (terms, weights), each with numbers of toxic and other examples.

    Rare terms have posting lists. Terms in at least a ``COMMON``th of the entries have a column of weights, and for each
    block of entries the largest of them."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray, float, float, int]], terms: int):
        # entries with the same strongest terms side by side, so that a block's largest weights are sharp
        strongest = lambda e: tuple(e[0][np.argsort(-e[1], kind="stable")[:4]].tolist())
        entries = sorted(entries, key=lambda e: (strongest(e), e[4]))
        self.toxic, self.other = (np.array([e[i] for e in entries], np.float64) for i in (2, 3))
        self.name = np.array([e[4] for e in entries], np.int64)
        size, n = np.array([len(e[0]) for e in entries], np.int64), len(entries)
        term = np.concatenate([e[0] for e in entries]) if entries else np.zeros(0, np.int32)
        weight = np.concatenate([e[1] for e in entries]) if entries else np.zeros(0, np.float32)
        entry = np.repeat(np.arange(n, dtype=np.int32), size)
        self.marks = [_mark(e[0], e[1]) for e in entries]
        held = np.bincount(term, minlength=terms)
        common = np.flatnonzero(held >= max(2, n / COMMON))
        self.column = np.full(terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.rare = np.where(self.column < 0, held, 0)
        dense = self.column[term] >= 0
        self.columns = np.zeros((n, len(common)), np.float32)
        self.columns[entry[dense], self.column[term[dense]]] = weight[dense]
        self.starts = np.arange(0, n, BLOCK)
        self.tops = np.maximum.reduceat(self.columns, self.starts, axis=0).T.copy() if n else np.zeros((0, 0), np.float32)
        order = np.argsort(term[~dense], kind="stable")
        self.entry, self.posted = entry[~dense][order], weight[~dense][order]
        self.lists = np.cumsum(self.rare) - self.rare

    def parts(self, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All entries' sums over rare terms; the query's columns; an upper bound of each block's cosines."""
        column = self.column[ids]
        take = self.rare[ids]
        at = _spread(self.lists[ids], take)
        sums = np.bincount(self.entry[at], np.repeat(weights, take) * self.posted[at], len(self.name)).astype(np.float64)  # of nothing: whole numbers
        query = np.zeros(self.columns.shape[1], np.float32)
        own = column >= 0
        query[column[own]] = weights[own]
        bound = np.maximum.reduceat(sums, self.starts) + weights[own] @ self.tops[column[own]]
        return sums, query, bound

    def of_blocks(self, sums: np.ndarray, query: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some blocks and their cosines."""
        begin = blocks * BLOCK
        entries = _spread(begin, np.minimum(begin + BLOCK, len(self.name)) - begin)
        return entries, sums[entries] + self.columns[entries] @ query

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of largest positive cosine, and all that equal the last: numbers and cosines, falling."""
        if not len(self.name):
            return np.zeros(0, np.int64), np.zeros(0)
        sums, query, bound = self.parts(ids, weights)
        best = np.sort(np.argpartition(-bound, min(FIRST, len(bound)) - 1)[:FIRST])
        found, s = self.of_blocks(sums, query, best)
        floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else 0.0
        left = bound >= max(floor - SLACK, 1e-12)
        left[best] = False
        rest = np.flatnonzero(left)
        if len(rest) > SHARE * len(bound):  # one product over all of them moves less than most blocks' rows
            found, s = np.arange(len(self.name)), sums + self.columns @ query
        elif len(rest):
            more, t = self.of_blocks(sums, query, rest)
            found, s = np.concatenate([found, more]), np.concatenate([s, t])
        floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else 0.0
        near = np.flatnonzero((s >= floor - SLACK) & (s > 0))
        found = found[near]
        s = sums[found] + self.columns[found].astype(np.float64) @ query.astype(np.float64)  # single-precision sums chose them
        floor = np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else 0.0
        keep = s >= floor - 1e-9
        found, s = found[keep], s[keep]
        o = np.lexsort((found, -s))
        return found[o], s[o]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and fitted y of each pool, both rising."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        pools.append([w[i], w[i] * x[i], w[i] * y[i]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[0] for p in pools]), np.array([(p[2] + 0.05) / (p[0] + 0.1) for p in pools])


class Model:
    """Terms, idf, index, share of toxic examples and of those without terms, calibration."""

    def __init__(self, names: list[str], idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], times: tuple[float, float] = (1.0, 1.0)):
        """examples: (document, 1 if toxic, terms, rising, their counts). times: what a toxic and another example counts for."""
        self.terms, self.idf = Terms(names), idf
        self.times = times
        merged: dict[bytes, list] = {}
        rest = [0.0, 0.0]
        for doc, toxic, ids, counts in examples:
            ids, weights = self.vector(ids, counts)
            if len(ids):
                own = merged.setdefault(_mark(ids, weights), [ids, weights, 0.0, 0.0, doc])
                own[3 - toxic] += times[1 - toxic]
                own[4] = min(own[4], doc)
            else:
                rest[1 - toxic] += times[1 - toxic]
        toxic, other = (sum(times[1 - e[1]] for e in examples if e[1] == kind) for kind in (1, 0))
        self.prior = (toxic + 0.5) / (toxic + other + 1)
        self.without = (rest[0] + self.prior) / (sum(rest) + 1)
        self.index = Index(list(merged.values()), len(names))
        self.place = {m: k for k, m in enumerate(self.index.marks)}
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms, rising, and their weights, as single-precision numbers."""
        w = (1 + np.log(counts)) * self.idf[ids]
        norm = math.sqrt(float(w @ w))
        return (ids.astype(np.int32), (w / norm).astype(np.float32)) if norm else (ids[:0].astype(np.int32), w[:0].astype(np.float32))

    def vote(self, ids: np.ndarray, cosines: np.ndarray, less: tuple[int, int] | None = None) -> float:
        """Weighted share of toxic examples; an entry of several examples counts with the logarithm of their number.
        less: entry and label of an example to leave out."""
        toxic, other = self.index.toxic[ids], self.index.other[ids]
        if less:
            own = ids == less[0]
            toxic, other = toxic - own * less[1] * self.times[0], other - own * (1 - less[1]) * self.times[1]
        n = np.maximum(toxic + other, 0)
        share = np.divide(toxic, n, out=np.zeros(len(n)), where=n > 1e-9)
        weight = cosines**2 / (1.05 - np.minimum(cosines, 1)) * np.log2(1 + n)
        return float(((weight * share).sum() + PRIOR * self.prior) / (weight.sum() + PRIOR))

    def left_out(self, ids: np.ndarray, counts: np.ndarray, label: int) -> float | None:
        """The vote on an example by all others; None without terms."""
        ids, weights = self.vector(ids, counts)
        return self.vote(*self.index.nearest(ids, weights, NEIGHBOURS + 1), less=(self.place[_mark(ids, weights)], label)) if len(ids) else None

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        if len(votes):
            self.x, self.y = isotonic(votes, labels, np.where(labels > 0, *self.times))

    def of_counts(self, ids: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, float]]]:
        """Score, and the three nearest entries as (smallest doc_id, cosine, share of toxic examples)."""
        ids, weights = self.vector(ids, counts)
        near, cosines = self.index.nearest(ids, weights) if len(ids) else (ids, weights)
        if not len(near):
            return self.without, []
        value = float(np.interp(self.vote(near, cosines), self.x, self.y))
        toxic, other = self.index.toxic[near[:3]], self.index.other[near[:3]]
        return value, [(int(self.index.name[i]), float(c), float(s)) for i, c, s in zip(near[:3], cosines, toxic / (toxic + other), strict=False)]


class Scorer:
    """A model in a task; texts with equal counts of terms, copies above all, are searched once, as far as it remembers."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, float, float]]]]:
        for ids, counts in self.model.terms.count(texts):
            mark = _mark(ids, counts)
            if mark not in self.known:
                if len(self.known) > KNOWN:
                    self.known.clear()
                self.known[mark] = self.model.of_counts(ids, counts)
            yield self.known[mark]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, toxic and other examples that hold it, summed up by task."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for words, toxic in zip(words_of(batch.column(0).to_pylist()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in {t for w in set(words) - {""} for t in terms_of(w)}:
                counts.setdefault(term, [0, 0])[1 - toxic] += 1
        if len(counts) > 300_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "toxic": pa.array([c[0] for c in counts.values()], pa.int64()), "other": pa.array([c[1] for c in counts.values()], pa.int64())})


#: Terms in a row of document frequencies.
CHUNK = 1 << 14
_CHUNKS = pa.schema([("chunk", pa.int32()), ("counts", pa.binary()), ("documents", pa.int64())])


def _chunks(total: np.ndarray, documents: int) -> pa.RecordBatch:
    parts = [total[lo : lo + CHUNK].tobytes() for lo in range(0, len(total), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([documents] * len(parts), pa.int64())], schema=_CHUNKS)


def _frequencies(shared: Broadcast):
    """A task's documents and its documents by term, in rows of CHUNK terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(shared.value), 0
        total = np.zeros(terms.size, np.int64)
        for batch in batches:
            for ids, _ in terms.count(batch.column(0).to_pylist()):
                total[ids] += 1
                n += 1
        yield _chunks(total, n)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for chunk, raw, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = total.setdefault(chunk, [np.zeros(len(raw) // 8, np.int64), 0])
            own[0] += np.frombuffer(raw, np.int64)
            own[1] += n
    rows = list(total.items())
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x.tobytes() for _, (x, _) in rows], pa.binary()), pa.array([n for _, (_, n) in rows], pa.int64())], schema=_CHUNKS)


def enriched(counts: DataFrame, toxic: int, other: int) -> list[str]:
    """Terms of toxic examples: at least LEAST examples of them, and a log-likelihood ratio above what the best of so many
    terms reaches by chance."""
    n = counts.filter(F.col("toxic") + F.col("other") >= LEAST).count()  # fewer can't reach it
    if not toxic or not other or not n:
        return []
    a, b = F.col("toxic"), F.col("other")
    rate, base = a / (a + b), toxic / (toxic + other)
    ratio = 2 * (a * F.log(rate / base) + F.when(b > 0, b * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    kept = counts.filter((a >= LEAST) & (rate > base)).withColumn("g", ratio).filter(F.col("g") > 2 * math.log(n))
    return [r.term for r in kept.select("term").collect()]


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from ``labels`` (all rows with a label of 0 or 1 count; the caller leaves out what is held out)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.filter(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(toxic).cast("int").alias("y"))
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = texts.select("k", F.octet_length("text").alias("b")).join(known, "k").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect()
    part = {r.y: min(1.0, SAMPLE / r.n, SAMPLE_BYTES / 2 / max(r.b, 1)) for r in sizes}
    limit = F.when(F.col("y") == 1, F.lit(int(part.get(1, 1) * (1 << 20)))).otherwise(F.lit(int(part.get(0, 1) * (1 << 20))))
    sample = known.filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) < limit)
    sample = scratch.cut(texts.join(F.broadcast(sample), "k"), "sample")
    number = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    counts = sample.select("text", "y").mapInArrow(_evidence, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = scratch.cut(counts, "terms")  # read three times
    more = set(enriched(counts, number.get(1, 0), number.get(0, 0)))
    words = counts.select("term").filter(F.col("term").endswith(" ")).toArrow().column("term").to_pylist()
    names = sorted(more.union(words))
    del words
    shared = spark.sparkContext.broadcast(names)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "chunk int, counts binary, documents long"
    tasks = documents.select(text).mapInArrow(_frequencies(shared), schema).withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(n)))
    found = tasks.repartition(n, "chunk", "salt").select("chunk", "counts", "documents").mapInArrow(_summed, schema).repartition(n, "chunk").mapInArrow(_summed, schema)
    found = {r.chunk: r for r in found.collect()}
    frequency = np.concatenate([np.frombuffer(found[c].counts, np.int64) for c in sorted(found)])[: len(names)] if found else np.zeros(len(names))
    total = found[0].documents if found else 0
    idf = (np.log((1 + total) / (1 + frequency)) + 1e-3) * np.array([BOOST if t in more else 1.0 for t in names])

    @F.arrow_udf("struct<t: binary, n: binary>")
    def counted(texts: pa.Array) -> pa.Array:
        terms = Terms(shared.value)
        pairs = list(terms.count(texts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([p[i].tobytes() for p in pairs], pa.binary()) for i in (0, 1)], ["t", "n"])

    rows = sample.select("k", "y", counted("text").alias("v")).select("k", "y", "v.t", "v.n").toArrow()
    examples = sorted(zip(*(rows.column(c).to_pylist() for c in ("k", "y", "t", "n")), strict=True))
    examples = [(int(k), int(y), np.frombuffer(t, np.int32), np.frombuffer(n, np.int32)) for k, y, t, n in examples]
    model = Model(names, idf, examples, (1 / part.get(1, 1.0), 1 / part.get(0, 1.0)))
    del rows, examples
    raw = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def left_out(texts: pa.Array, labels: pa.Array) -> pa.Array:
        counted = raw.value.terms.count(texts.to_pylist())
        return pa.array([raw.value.left_out(*t, y) for t, y in zip(counted, labels.to_pylist(), strict=True)], pa.float64())

    spread = sample.repartition(n, F.xxhash64("k", "text"))
    votes = spread.select("y", left_out("text", "y").alias("vote")).filter("vote IS NOT NULL").orderBy("vote", "y").toPandas()
    model.calibrate(votes["vote"].to_numpy(), votes["y"].to_numpy(float))
    raw.unpersist()
    scratch.drop()
    return model


def score(text: Column, model: Model, documents: DataFrame) -> Column:
    """struct<score: double, evidence: array<struct<doc_id, cosine, toxic_share>>> of the whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic_share", pa.float64())])))])

    @F.arrow_udf("struct<score: double, evidence: array<struct<doc_id: bigint, cosine: double, toxic_share: double>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            out = []
            for value, near in scorer.score(texts.to_pylist()):
                out.append({"score": value, "evidence": [{"doc_id": d, "cosine": c, "toxic_share": s} for d, c, s in near]})
            yield pa.array(out, kind)

    return scored(text)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` with ``score`` (0 to 1), ``predicted`` (1 if score >= threshold, else 0) and
    ``evidence`` (up to three nearest entries).

    Texts that share no term with an example, empty and null ones among them, get the share of toxic examples among the
    examples without terms. Without labelled examples all get 0.5. Equal rows get equal scores; columns of the new names
    are replaced. Text is read four times and never shuffled, but for the sample.
    """
    model = fit(documents, labels, key=key, text=text)
    scored = documents.withColumn("evidence", score(F.col(text), model, documents))
    scored = scored.withColumn("score", F.col("evidence.score")).withColumn("evidence", F.col("evidence.evidence"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
