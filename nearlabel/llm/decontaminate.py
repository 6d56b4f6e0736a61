"""Benchmark decontamination by winnowing, in DataFrame operations only.

A word span of ``WINDOW`` words that a document shares with an item is found for certain: of the K-gram hashes in every
such span the smallest is kept on both sides (winnowing with windows of WINDOW - K + 1 hashes), so both sides keep the
same one. Kept hashes of documents that may be an item's (a bit table of the items' hashes, of bounded size, tells)
become seeds with the words around them; seeds meet the items' on the hash, are checked word by word, and are extended
to both sides as far as one window reaches. A seed that grows to at least WINDOW words is a hit. Items of fewer words are
looked up whole, by the hash of all their words.

Documents are never shuffled or exploded: a row's hashes are arrays, and only seeds leave it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, WINDOW = 6, 10
#: Most bits of the items' bit table; most item seeds that are broadcast (each has at most 14 words) and bytes of their
#: words; salts beyond either.
BITS, BROADCAST_SEEDS, BROADCAST_BYTES, SALTS = 1 << 21, 1_000_000, 64 << 20, 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) runs of digits, letters a-z and characters beyond ASCII."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), _BREAK), lambda w: w != "")


def _zip(a: str, b: str, shift: int, f) -> Column:
    """f(a[i], b[i + shift]) wherever both exist."""
    n = F.greatest(F.least(F.size(a), F.size(b) - shift), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def _grams(df: DataFrame, sizes: set[int]) -> DataFrame:
    """Columns g{n} with the hashes of all runs of n words, from column ``words``: a run is the largest power of two
    below n and the rest, so a hash depends on nothing but its words."""
    todo, need = set(sizes), set()
    while todo:
        n = todo.pop()
        need.add(n)
        if n > 1:
            half = 1 << (n - 1).bit_length() - 1
            todo |= {half, n - half} - need
    for n in sorted(need):
        half = 1 << (n - 1).bit_length() - 1 if n > 1 else 0
        combined = _zip(f"g{half}", f"g{n - half}", half, lambda x, y: F.xxhash64(x, y)) if half else F.transform("words", lambda w: F.xxhash64(w))
        df = df.withColumn(f"g{n}", combined)
    return df


def _winnowed(df: DataFrame) -> DataFrame:
    """Column ``kept``: the smallest hash of each window, from g{K}."""
    g, least = f"g{K}", lambda x, y: F.least(x, y)
    df = df.withColumn("w2", _zip(g, g, 1, least)).withColumn("w4", _zip("w2", "w2", 2, least))
    return df.withColumn("kept", _zip("w4", g, WINDOW - K, least))


def _seed(i: Column, kind: int) -> Column:
    """The seed at position i (from 1) of ``words``: its hash and words, and the words before (nearest first) and after
    it as far as a window reaches. Kind 0 is a K-gram of a full window; kind n a whole item of n words, which has no
    words around it."""
    n, reach = kind or K, 0 if kind else WINDOW - K
    before = F.least(i - 1, F.lit(reach))
    return F.struct(
        i.cast("bigint").alias("at"),
        F.element_at(f"g{n}", i).alias("fp"),
        F.lit(kind).alias("kind"),
        F.array_join(F.slice("words", i, F.lit(n)), " ").alias("mid"),
        F.reverse(F.slice("words", i - before, before)).alias("before"),
        F.slice("words", i + n, F.lit(reach)).alias("after"),
    )


_SEEDS = "array<struct<at: bigint, fp: bigint, kind: int, mid: string, before: array<string>, after: array<string>>>"


def _seeds_where(chosen: str, kind: int) -> Column:
    """Seeds at all positions whose hash is among column ``chosen``; nothing is computed where that is empty."""
    g = f"g{kind or K}"
    positions = F.filter(F.sequence(F.lit(1), F.size(g)), lambda i: F.array_contains(chosen, F.element_at(g, i)))
    return F.when(F.size(chosen) > 0, F.transform(positions, lambda i: _seed(i, kind))).otherwise(F.array().cast(_SEEDS))


def _item_seeds(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, at, fp, kind, mid, before, after of all items."""
    df = benchmark.select(F.col(item).alias("item_id"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    parts = [_winnowed(_grams(df.filter(F.size("words") >= WINDOW), {K})).withColumn("seeds", _seeds_where("kept", 0))]
    for n in range(1, WINDOW):
        own = _grams(df.filter(F.size("words") == n), {n}).withColumn("all", F.col(f"g{n}"))
        parts.append(own.withColumn("seeds", _seeds_where("all", n)))
    # explode_outer: for explode, the optimizer would copy the whole chain of array expressions into a filter below it
    out = [x.select("item_id", F.explode_outer("seeds").alias("s")).select("item_id", "s.*") for x in parts]
    return reduce(DataFrame.unionByName, out).filter(F.col("fp").isNotNull())


def _bit_table(fps: DataFrame, n: int) -> tuple[Column, int]:
    """A constant array of longs in which each hash has its bit set, and its number of bits."""
    bits = 1 << 12
    while bits < min(BITS, 512 * n):
        bits *= 2
    place = F.pmod("fp", F.lit(bits)).cast("int")
    set_bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)).alias("b")
    values = {r.k: r.b for r in fps.groupBy(F.shiftright(place, 6).alias("k")).agg(set_bits).collect()}
    text = ",".join(str(values.get(k, 0)) for k in range(bits // 64))
    return F.split(F.lit(text), ",").cast("array<bigint>"), bits


def _may_hold(table: Column, bits: int) -> Callable[[Column], Column]:
    def test(h: Column) -> Column:
        place = F.pmod(h, F.lit(bits)).cast("int")
        return F.getbit(F.get(table, F.shiftright(place, 6)), place % 64) == 1

    return test


def _document_seeds(docs: DataFrame, tables: dict[int, tuple[Column, int]]) -> DataFrame:
    """Column ``seeds``: the row's kept hashes (kind 0) and n-gram hashes that items may hold."""
    parts = [F.array().cast(_SEEDS)]
    for kind, (bit_table, bits) in tables.items():
        source = f"g{kind}" if kind else "kept"
        docs = docs.withColumn(f"held{kind}", F.array_distinct(F.filter(source, _may_hold(bit_table, bits))))
        parts.append(_seeds_where(f"held{kind}", kind))
    return docs.withColumn("seeds", F.flatten(F.array(*parts)))


def _common(a: str, b: str) -> Column:
    """Length of the common prefix of two arrays of at most WINDOW - K words."""
    out = F.lit(WINDOW - K)
    for k in reversed(range(WINDOW - K)):
        out = F.when(F.coalesce(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), F.lit(False)), out).otherwise(F.lit(k))
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, text_hash (xxhash64), n_words, n_hit (words inside an occurrence of an
    item's window), n_items and items (ascending as strings), spans (hit word ranges, from 1, both ends included),
    contaminated.

    An item's windows are its runs of WINDOW words; an item of fewer words is one window, one without words has none.
    Null text has no words; null keys and item ids are kept as values (a null item is named by no id but counts its
    hits); repeated rows stay; extra columns are dropped; empty tables give no rows or no hits.
    """
    items = _item_seeds(benchmark, item, item_text)
    size = F.octet_length("mid") + F.octet_length(F.concat_ws(" ", "before", "after")) + 64
    kinds = {r.kind: (r.n, r.seeds, r.size) for r in items.groupBy("kind").agg(F.count_distinct("fp").alias("n"), F.count(F.lit(1)).alias("seeds"), F.sum(size).alias("size")).collect()}
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("words"))
    if kinds:
        docs = _grams(docs, {k or K for k in kinds})
    if 0 in kinds:
        docs = _winnowed(docs)
    docs = _document_seeds(docs, {k: _bit_table(items.filter(F.col("kind") == k).select("fp"), n) for k, (n, *_) in sorted(kinds.items())})
    rows = docs.select("row", "doc_id", "text_hash", F.size("words").cast("bigint").alias("n_words"), F.explode_outer("seeds").alias("s")).select("row", "doc_id", "text_hash", "n_words", "s.*")
    met = _meet(rows, items, sum(k[1] for k in kinds.values()), sum(k[2] for k in kinds.values()))
    whole = F.when(F.col("kind") == 0, F.lit(K)).otherwise(F.col("kind"))
    met = met.withColumn("a", F.col("at") - _common("before", "i_before")).withColumn("z", (F.col("at") + whole - 1 + _common("after", "i_after")).cast("bigint"))
    is_hit = (F.col("i_mid") == F.col("mid")) & ((F.col("kind") > 0) | (F.col("z") - F.col("a") + 1 >= WINDOW))
    found = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("text_hash").alias("text_hash"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, F.struct("a", "z")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(is_hit, F.col("item_id").cast("string")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["z"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["z"] - F.greatest(acc["upto"], s["a"] - 1))).alias("n")),
        lambda acc: acc["n"],
    )
    return found.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no item's window; all columns, repeated rows and null keys stay."""
    found = contamination(documents, benchmark, key, text).filter("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
    return documents.join(found, F.col(key).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(text) == F.col("_hit_hash")), "left_anti")


def _meet(rows: DataFrame, items: DataFrame, n_seeds: int, size: int) -> DataFrame:
    """Documents' seeds with the items' of the same kind and hash, others with nulls. Items beyond the broadcast bound
    meet salted seeds, since one passage may stand in a third of all documents."""
    named = items.select("item_id", F.col("fp").alias("i_fp"), F.col("kind").alias("i_kind"), F.col("mid").alias("i_mid"), F.col("before").alias("i_before"), F.col("after").alias("i_after")).distinct()
    same = (F.col("fp") == F.col("i_fp")) & (F.col("kind") == F.col("i_kind"))
    if n_seeds <= BROADCAST_SEEDS and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), same, "left")
    salted = named.withColumn("i_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("salt") == F.col("i_salt")), "left")
