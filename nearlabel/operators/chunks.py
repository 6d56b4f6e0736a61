"""Corpora as chunks: term frequencies of some thousand documents packed into one row, with the chunk's own vocabulary.

Texts are moved once; their words are found, counted and numbered where they lie, in numpy over the bytes of a chunk. What
meets other chunks is a row a chunk and word, not one a document and word: document frequencies are sums of these rows, and
the dictionary comes to a chunk by a join with them. Chunks are bounded by their bytes of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearlabel.functions import text as T
from nearlabel.operators import dictionary, lsh
from nearlabel.operators.graph import cut

#: Bytes of text of a chunk; a document is never parted.
CHUNK = 1 << 23
#: Bytes of text of a batch that a chunk takes.
BATCH = 1 << 26


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SMALL, WORD = _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$%<>")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The pound sign, the only letter of words that has two bytes.
POUND = (0xC2, 0xA3)


def pack(docs: DataFrame, clean: bool = False) -> DataFrame:
    """Chunks of (doc_id, text): ``T.words`` of the texts, with ``clean`` of ``T.preprocess`` of them, counted by document.

    Rows: chunk (a number), ids, sizes (of words a document), at (int32, number of the word in the chunk) and tf (int32) of
    the entries, document by document and by word, then the words and the documents that hold them. Most texts have nothing
    that ``preprocess`` knows but blanks, which end words anyway, and repeated letters; only others go through its patterns.
    """
    rows, n = _plain(docs, clean), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "doc_id").sortWithinPartitions("doc_id")

    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_parts(batches, most, "doc_id")):
            ids, _, sizes, at, tf, words, df = _counted(part)
            yield _row(("chunk", "ids", "sizes", "at", "tf", "words", "df"), first + k, ids, pa.array(sizes), at, tf, words, pa.array(df))

    kind = dict(docs.dtypes)["doc_id"]
    return cut(rows.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes array<int>, at binary, tf binary, words array<string>, df array<int>"), "chunks")


def _plain(docs: DataFrame, clean: bool, *keys: str) -> DataFrame:
    """(doc_id, keys, text, squeeze): texts as ``found`` needs them."""
    x = F.coalesce("text", F.lit(""))
    odd = x.contains("\u0130") | x.contains("\u212a")  # letters whose small form is a word's
    if clean:
        odd = odd | x.rlike("[1-9@#&]") | x.contains("http") | x.contains("www.") | x.contains("RT")
    done = F.when(odd, F.lower(T.preprocess(x) if clean else x)).otherwise(x)
    return docs.select("doc_id", *keys, done.alias("text"), (F.lit(clean) & ~odd).alias("squeeze"))


def _runs(ids: pa.Array) -> np.ndarray:
    """Where another id begins, in sorted ids; nulls are alike."""
    values = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.zeros(0, np.int64)


def _parts(batches: Iterator[pa.RecordBatch], most: int, key: str) -> Iterator[pa.Table]:
    """Sorted rows, cut between keys after about ``most`` bytes of text."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        ends = np.cumsum(_sizes(rows["text"].combine_chunks()))
        starts, lo = _runs(rows[key].combine_chunks()), 0
        while lo < len(rows):
            after = starts[starts > max(lo, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))]
            if not len(after):
                break
            yield rows.slice(lo, int(after[0]) - lo)
            lo = int(after[0])
        rest = rows.slice(lo)
    if rest is not None and len(rest):
        yield rest


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def _sizes(texts: pa.Array) -> np.ndarray:
    return np.diff(_offsets(texts))


def found(texts: pa.Array, squeeze: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and how many each has; where ``squeeze`` holds, runs of a small letter are one."""
    off = _offsets(texts)
    raw = texts.buffers()[2]
    buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    starts = lambda: off[:-1][off[:-1] < len(buf)]
    if squeeze.any() and len(buf):
        same = np.zeros(len(buf), bool)
        same[1:] = (buf[1:] == buf[:-1]) & SMALL[buf[1:]]
        same[starts()] = False
        if not squeeze.all():
            same &= np.repeat(squeeze, np.diff(off))
        buf, off = buf[~same], off - np.concatenate([[0], np.cumsum(same)])[off]
    buf = LOWER[buf]
    word = WORD[buf]
    pound = np.flatnonzero(buf[:-1] == POUND[0])
    pound = pound[buf[pound + 1] == POUND[1]]
    word[pound] = word[pound + 1] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    begins[starts()] = word[starts()]
    data, at = buf[word], np.flatnonzero(begins[word])
    upto = np.concatenate([[0], np.cumsum(begins)])[off]
    ends = np.append(at, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), np.diff(upto)


def _counted(rows: pa.Table) -> tuple:
    """Of sorted rows: the documents' ids and numbers of rows, sizes, entries (number of the word, tf), words and df."""
    ids, texts = rows["doc_id"].combine_chunks(), rows["text"].combine_chunks()
    words, n = found(texts, rows["squeeze"].combine_chunks().to_numpy(zero_copy_only=False))
    coded, runs = words.dictionary_encode(), _runs(ids)
    vocabulary, times = coded.dictionary, np.diff(np.append(runs, len(ids)))
    many = max(1, len(vocabulary))
    doc = np.repeat(np.arange(len(runs)), times)
    keys, tf = np.unique(np.repeat(doc, n) * many + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    doc, at = keys // many, (keys % many).astype(np.int32)
    sizes, df = np.bincount(doc, minlength=len(runs)).astype(np.int32), np.bincount(at, minlength=len(vocabulary)).astype(np.int32)
    return ids.take(pa.array(runs)), times, sizes, at, tf.astype(np.int32), vocabulary, df


def _row(names: tuple[str, ...], *values) -> pa.RecordBatch:
    """One row: numbers as they are, arrays as lists, numpy's as binaries."""

    def column(x) -> pa.Array:
        if isinstance(x, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.array([x.tobytes()], pa.binary()) if isinstance(x, np.ndarray) else pa.array([x])

    return pa.RecordBatch.from_arrays([column(x) for x in values], names=names)


def _words(chunks: DataFrame) -> DataFrame:
    """(chunk, at, token, df)."""
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "df")).alias("at", "x"))
    return rows.select("chunk", "at", F.col("x.words").alias("token"), F.col("x.df").alias("df"))


def entries(chunks: DataFrame, docs: DataFrame, least: int = 2, mode: str = "log_over_df") -> DataFrame:
    """The dictionary of all chunks, as ``dictionary.build`` makes it of the documents."""
    df = _words(chunks).groupBy("token").agg(F.sum("df").alias("df")).filter(F.col("df") >= least)
    return cut(dictionary.entries(cut(df, "df"), docs, mode), "dictionary")


def vectors(chunks: DataFrame, known: DataFrame, p: lsh.Params, signs) -> DataFrame:
    """(doc_id, pos, w, buckets): the documents' tf * idf in order of positions, and their bucket in every table, of
    documents with words of the dictionary ``known``, whose planes are ``lsh.signs``."""
    named = _words(chunks).join(known.select("token", "position", "idf"), "token").select(F.col("chunk").alias("own"), F.col("at").alias("number"), "position", "idf")
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def run(packed: pa.Table, named: pa.Table) -> pa.Table:
        return _weighed(packed, named, p, signs.value)

    left = chunks.select("chunk", "ids", "sizes", "at", "tf").groupBy("chunk")
    return cut(left.cogroup(named.groupBy("own")).applyInArrow(run, f"doc_id {kind}, pos array<long>, w array<double>, buckets array<int>"), "vectors")


def _weighed(packed: pa.Table, named: pa.Table, p: lsh.Params, signs: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    ids, sizes = (packed[x].combine_chunks().flatten() for x in ("ids", "sizes"))
    at, tf = (np.frombuffer(packed[x][0].as_buffer(), np.int32) for x in ("at", "tf"))
    number = named["number"].to_numpy()
    place = np.full(int(at.max(initial=-1)) + 1, -1)  # of a word among those of the dictionary, in order of positions
    order = np.argsort(named["position"].to_numpy())
    place[number[order]] = np.arange(len(order))
    position, idf = named["position"].to_numpy()[order], named["idf"].to_numpy()[order]
    doc, word = np.repeat(np.arange(len(sizes)), sizes.to_numpy()), place[at]
    use = word >= 0
    doc, word, tf = doc[use], word[use], tf[use]
    order = np.argsort(doc * max(1, len(position)) + word)
    word, w, n = word[order], (tf * idf[word])[order], np.bincount(doc, minlength=len(ids))
    there = np.flatnonzero(n)
    ends, planes = np.cumsum(n[there]), lsh.planes_of(p)
    buckets, pos = planes.buckets(word, lsh.micro(w), ends, planes.fetched(position, signs)), position[word]
    lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
    return pa.table({"doc_id": ids.take(pa.array(there)), "pos": lists(pos, ends), "w": lists(w, ends), "buckets": lists(buckets.ravel(), np.arange(1, len(there) + 1) * p.tables)})


def online(docs: DataFrame) -> DataFrame:
    """``dictionary.online_vectors`` of (doc_id, batch, text) by ``T.words``; a document's rows are of one batch.

    Chunks hold whole batches, in their order. A word's documents before a chunk are a running sum of a row a chunk and word;
    those of the chunk's own batches are counted in it. Batches of more text than ``BATCH`` don't fit chunks and go row by
    row.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    largest = docs.groupBy("batch").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) > BATCH:
        return dictionary.online_vectors(docs.select("doc_id", "batch", T.words(F.col("text")).alias("tokens")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _plain(docs.withColumn("batch", F.col("batch").cast("long")), False, "batch").repartitionByRange(n, "batch").sortWithinPartitions("batch", "doc_id")
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, part in enumerate(_parts(batches, most, "batch")):
            ids, times, sizes, at, tf, words, df = _counted(part)
            number, batch = ids.to_numpy(), part["batch"].to_numpy()[np.cumsum(times) - times]
            seq = np.full(len(words), np.iinfo(np.int64).max)
            np.minimum.at(seq, at, np.repeat(number, sizes))
            yield _row(("chunk", "docs", "ids", "batches", "times", "sizes", "at", "tf", "words", "df", "seq"), first + k, len(part), number, batch, times, sizes, at, tf, words, pa.array(df), pa.array(seq))

    kept = cut(rows.mapInArrow(run, "chunk long, docs long, ids binary, batches binary, times binary, sizes binary, at binary, tf binary, words array<string>, df array<int>, seq array<long>"), "chunks")
    held = kept.select("chunk", F.posexplode(F.arrays_zip("words", "df", "seq")).alias("number", "x"))
    held = held.select(F.col("chunk").alias("own"), "number", F.col("x.words").alias("token"), F.col("x.df").alias("df"), F.col("x.seq").alias("seq"))
    before = F.sum("df").over(Window.partitionBy("token").orderBy("own")) - F.col("df")
    named = held.select("own", "number", "token", before.alias("before")).join(dictionary.first_seen(held), "token").select("own", "number", "before", "position", "first")
    prior = kept.select("chunk", (F.sum("docs").over(Window.orderBy("chunk")) - F.col("docs")).alias("prior"))  # a row a chunk
    left = kept.select("chunk", "ids", "batches", "times", "sizes", "at", "tf").join(F.broadcast(prior), "chunk")
    return left.groupBy("chunk").cogroup(named.groupBy("own")).applyInArrow(_online, "doc_id long, pos long, w double, new_words long")


def _online(packed: pa.Table, named: pa.Table) -> pa.Table:
    kinds = {"ids": np.int64, "batches": np.int64, "times": np.int64, "sizes": np.int32, "at": np.int32, "tf": np.int32}
    ids, batches, times, sizes, at, tf = (np.frombuffer(packed[x][0].as_buffer(), kind) for x, kind in kinds.items())
    number = named["number"].to_numpy()
    before, position, first = np.zeros((3, len(number)), np.int64)
    for out, name in ((before, "before"), (position, "position"), (first, "first")):
        out[number] = named[name].to_numpy()
    _, b = np.unique(batches, return_inverse=True)
    d = packed["prior"][0].as_py() + np.cumsum(np.bincount(b, times)).astype(np.int64)  # as of each batch
    doc = np.repeat(np.arange(len(ids)), sizes)
    key = at.astype(np.int64) * (len(d) + 1) + b[doc]
    line = np.sort(key)
    df = before[at] + np.searchsorted(line, key, "right") - np.searchsorted(line, at.astype(np.int64) * (len(d) + 1), "left")
    w = tf * (np.log10(d.astype(np.float64))[b[doc]] / (df + 1))
    size = np.sqrt(np.bincount(doc, w * w, len(ids)))[doc]
    new = np.bincount(doc, first[at] == ids[doc], len(ids)).astype(np.int64)[doc]
    there = size > 0
    return pa.table({"doc_id": ids[doc], "pos": position[at], "w": pa.array(w / np.where(there, size, 1), mask=~there), "new_words": new})


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, tbl, bucket) of ``vectors``."""
    return rows.select("doc_id", F.posexplode("buckets").alias("tbl", "bucket"))


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, w) of ``vectors``, a row a word."""
    return rows.select("doc_id", F.explode(F.arrays_zip("pos", "w")).alias("x")).select("doc_id", "x.pos", "x.w")
