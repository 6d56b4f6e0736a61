"""The supervised baseline: stemmed TF-IDF features, canonical components, one linear machine a label.

Stemming (English Snowball) has no built-in and runs as an Arrow function over distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearlabel.functions import text as T
from nearlabel.operators import cca
from nearlabel.operators.dictionary import with_rank
from nearlabel.operators.graph import Scratch, cut

#: Labels that are broadcast at most.
BROADCAST_LABELS = 10_000
# Fixed values of the English Snowball stemmer (Porter 2): letters, suffixes with their replacements, exceptions.
VOWELS, DOUBLES, LI_BEFORE = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
R1_STARTS = ("gener", "commun", "arsen")
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from ``start`` on."""
    m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable; Y is a consonant."""
    return bool(re.search(f"[^{VOWELS}][{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$", word))


def _longest(word: str, ends) -> str:
    return max((e for e in ends if word.endswith(e)), key=len, default="")


@lru_cache(1 << 18)
def stem(word: str) -> str:
    """The English Snowball stemmer (Porter 2) on a lower-case word; other words than ASCII ones stay."""
    if len(word) < 3 or not word.isascii():
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word.removeprefix("'"))
    start = next((len(x) for x in R1_STARTS if word.startswith(x)), None)
    r1 = start if start is not None else _region(word, 0)
    r2 = _region(word, r1)
    has_vowel = lambda x: any(c in VOWELS for c in x)
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and has_vowel(word[:-2]):
        word = word[:-1]
    if word in AFTER_1A:
        return word
    # past and progressive forms
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        word = word[: -len(end)] + "ee" if len(word) - len(end) >= r1 else word
    elif end and has_vowel(base := word[: -len(end)]):
        if base.endswith(("at", "bl", "iz")):
            word = base + "e"
        elif base.endswith(DOUBLES):
            word = base[:-1]
        else:
            word = base + "e" if _short_end(base) and r1 >= len(base) else base
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # derivations
    end = _longest(word, STEP_2)
    if end and len(word) - len(end) >= r1 and not (end == "ogi" and word[-4:-3] != "l") and not (end == "li" and word[-3] not in LI_BEFORE):
        word = word[: -len(end)] + STEP_2[end]
    end = _longest(word, STEP_3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + STEP_3[end]
    end = _longest(word, STEP_4)
    if end and len(word) - len(end) >= r2 and not (end == "ion" and word[-4:-3] not in ("s", "t")):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


def stems(words: Column, stopped: frozenset[str] = frozenset()) -> Column:
    """Lists of words without those of ``stopped``, stemmed; each word of a batch once."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten().dictionary_encode(), np.array([0, *_ends(lists)])
        words, at = flat.dictionary.to_pylist(), flat.indices
        if stopped:
            use = np.array([w not in stopped for w in words], bool)[at.to_numpy()]
            at, ends = at.filter(pa.array(use)), np.concatenate([[0], np.cumsum(use)])[ends]
        done = pa.array([None if w in stopped else stem(w) for w in words], pa.string()).take(at)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), done)

    return run(words)


def _ends(lists: pa.Array) -> list[int]:
    at, out = 0, []
    for n in lists.value_lengths().fill_null(0).to_pylist():
        at += n
        out.append(at)
    return out


def search_terms(text: Column) -> Column:
    """The search engine's English chain for a text field: split at what is no letter, digit or inner apostrophe, lower
    case, no stop words, possessives and stems; repeats stay in order. Words of letters and digits are not split further."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*)"), F.lit(1))
    kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "'s$", "")), lambda w: ~w.isin(*T.STOP_WORDS))
    return stems(kept)


def analyzed(docs: DataFrame) -> DataFrame:
    """docs with ``tokens``: names and links gone, words of two or more characters, stop words gone, stemmed. A text without
    names, links and tags is searched for its words at once; only others go through ``plain_words``."""
    x = F.coalesce("text", F.lit(""))
    low = F.lower(x)
    odd = low.contains("#") | low.contains("@") | low.contains("http")
    words = F.regexp_extract_all(F.when(odd, T.plain_words(x)).otherwise(low), F.lit(r"\w{2,}"), F.lit(0))
    return docs.withColumn("tokens", stems(words, frozenset(StopWordsRemover.loadDefaultStopWords("english"))))


def indicator(docs: DataFrame, labels: str = "labels") -> DataFrame:
    """(doc_id, label, y) for every document and every label that occurs: whether the document has it.

    Labels are counted first. Up to ``BROADCAST_LABELS`` are broadcast; more are dealt into blocks of that expected size,
    each of which meets each partition of the documents in a task of its own."""
    all_labels = docs.select(F.explode(labels).alias("label")).distinct()
    n = all_labels.count()
    if n <= BROADCAST_LABELS:
        all_labels = F.broadcast(all_labels)
    else:
        all_labels = all_labels.repartition(-(-n // BROADCAST_LABELS), "label").hint("shuffle_replicate_nl")
    return docs.select("doc_id", labels).crossJoin(all_labels).select("doc_id", "label", F.array_contains(labels, F.col("label")).cast("int").alias("y"))


class LabelModel:
    """Terms with their weights, canonical vectors of the terms, a machine a label. All frames; the driver holds the means
    of the components and, while it trains or predicts, the machines of one block of labels."""

    def __init__(self, terms: DataFrame, vectors: DataFrame, mean: np.ndarray, labels: DataFrame, weights: DataFrame, n_labels: int, learned: DataFrame):
        self.terms, self.vectors, self.mean, self.labels, self.weights, self.n_labels, self.learned = terms, vectors, mean, labels, weights, n_labels, learned

    def predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, labels): predicted labels, sorted."""
        return self._named(docs, features(docs.select("doc_id"), weighed(counted(docs), self.terms), self.vectors, self.mean))

    def fitted(self) -> DataFrame:
        """``predict`` of the documents that the model has learned from, whose features are kept."""
        return self._named(self.learned, self.learned.select("doc_id", "z"))

    def _named(self, docs: DataFrame, z: DataFrame) -> DataFrame:
        hits = None
        for first in range(0, self.n_labels, cca.LABELS):
            block = self.weights.filter((F.col("pos") >= first) & (F.col("pos") < first + cca.LABELS)).orderBy("pos").collect()
            sent = docs.sparkSession.sparkContext.broadcast((np.array([r.w for r in block]), np.array([r.pos for r in block], np.int64)))
            found = z.mapInArrow(_hits(sent), f"doc_id {dict(docs.dtypes)['doc_id']}, pos long")
            hits = found if hits is None else hits.union(found)
        named = hits.join(self.labels, "pos").groupBy("doc_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
        return docs.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def _hits(weights):
    """(doc_id, label number) of every machine that says yes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, pos = weights.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                doc, label = np.nonzero(np.asarray(part.column("z").flatten()).reshape(-1, w.shape[1]) @ w.T > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(pos[label])], names=["doc_id", "pos"])

    return run


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, row, token, tf) of every stem of every row of docs. Texts are dealt out first: a stem costs more than its
    move, and a table may lie in one file."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = analyzed(docs.select("doc_id", "text").repartition(n)).select("doc_id", F.monotonically_increasing_id().alias("row"), "tokens")
    return tokens.select("doc_id", "row", F.explode("tokens").alias("token")).groupBy("doc_id", "row", "token").agg(F.count(F.lit(1)).alias("tf"))


def terms_of(docs: DataFrame, tf: DataFrame, least: int = 1) -> tuple[DataFrame, int]:
    """(token, pos, idf) of every stem of at least ``least`` documents, idf = ln((1 + N) / (1 + df)) + 1; and N. ``tf`` as
    ``counted`` gives it."""
    df = cut(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least), "df")
    n = docs.count()
    return with_rank(df, ["token"], "pos").select("token", "pos", (F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1).alias("idf")), n


def weighed(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, pos, w): tf * idf of known stems, at unit length."""
    rows = tf.groupBy("doc_id", "token").agg(F.sum("tf").alias("tf")).join(terms, "token").select("doc_id", "pos", (F.col("tf") * F.col("idf")).alias("w"))
    return rows.select("doc_id", "pos", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).alias("w"))


def features(ids: DataFrame, rows: DataFrame, vectors: DataFrame, mean: np.ndarray) -> DataFrame:
    """(doc_id, z): canonical components of every document and a one."""
    z = cca.times(rows, vectors, "pos", "doc_id", len(mean))
    parts = [F.coalesce(f"c{i}", F.lit(0.0)) - float(m) for i, m in enumerate(mean)]
    return ids.join(z, "doc_id", "left").select("doc_id", F.array(*parts, F.lit(1.0)).alias("z"))


def train(docs: DataFrame, components: int = 100, least: int = 1) -> LabelModel:
    """docs: (doc_id, text, labels). One linear machine for every label that occurs, on canonical components of the TF-IDF
    weights of every stem; documents without text or labels count like others. Null labels are none."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "labels")
    tf = scratch.cut(counted(docs), "tf")
    terms, n = terms_of(docs, tf, least)
    terms = scratch.cut(terms, "terms")
    x = scratch.cut(weighed(tf, terms), "weights")
    own = scratch.cut(docs.select("doc_id", F.explode("labels").alias("label")).filter("label IS NOT NULL").distinct(), "own")
    labels = scratch.cut(with_rank(own.select("label").distinct(), ["label"], "pos"), "labels")
    y = scratch.cut(own.join(labels, "label").select("doc_id", "pos", F.lit(1.0).alias("w")), "indicator")
    count = labels.count()
    vectors, _, _ = cca.canonical(x, y, n, count, scratch, components)
    k = len(vectors.columns) - 1
    means = x.groupBy("pos").agg((F.sum("w") / n).alias("mean")).join(vectors, "pos")
    mean = np.array(means.agg(*[F.coalesce(F.sum(F.col("mean") * F.col(f"c{i}")), F.lit(0.0)) for i in range(k)]).first())
    numbers = y.groupBy("doc_id").agg(F.collect_list("pos").alias("own"))
    ready = features(docs.select("doc_id"), x, vectors, mean).join(numbers, "doc_id", "left").select("doc_id", "z", F.coalesce("own", F.array().cast("array<bigint>")).alias("own"))
    ready, weights = scratch.cut(ready, "ready"), None
    for first, w in cca.machines(ready.select("z", "own"), k + 1, count):
        block = spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(w)], "pos long, w array<double>")
        block = scratch.cut(block, "machines")
        weights = block if weights is None else weights.union(block)
    return LabelModel(terms, vectors, mean, labels, weights, count, ready)
