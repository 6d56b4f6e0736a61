"""Compression of vectors into codes: one byte for each of a few equal parts, by integer codebooks that are learned here.

Components become integers, floor(scale * x). Every part position has a codebook; its first entries are that part of the
vectors of the smallest ids. In a round all codebooks are broadcast (entries x length integers, whatever the number of
vectors), Arrow batches assign each part to the nearest entry, and a task returns one row of sums and a count for each
entry that it used. These meet in a shuffle grouped by entry, so what moves in a round is bounded by tasks times entries,
and only entries come back to the driver. Distances are |x|^2 - 2 x.e + |e|^2 with one int64 matrix product a batch and
part: integer sums that are exact, and wrap around only where the distance itself would not fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Squared distances of whole vectors stay below this, so they and their sums over parts fit 64 bits.
EXACT = 2.0**63
#: Vectors whose distances are held at once.
ROWS = 4096
#: Labels up to which the sums of errors are broadcast; beyond it they are joined, rows of one label in SALTS shares.
BROADCAST_LABELS, SALTS = 100_000, 64


def _components(batch: pa.RecordBatch, scale: int, length: int) -> np.ndarray:
    x = np.asarray(batch.column("x").flatten()).astype(np.float64)
    return np.floor(scale * x).astype(np.int64).reshape(-1, length)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact in int64."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x parts the first nearest entry and its distance; ``books``: parts x entries x components."""
    parts, _, width = books.shape
    code, error = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for lo in range(0, len(x), ROWS):
        for p in range(parts):
            d = distances(np.ascontiguousarray(x[lo : lo + ROWS, p * width : (p + 1) * width]), books[p])
            code[lo : lo + ROWS, p] = best = d.argmin(axis=1)
            error[lo : lo + ROWS, p] = d[np.arange(len(d)), best]
    return code, error


def usable(vector: Column, scale: int, length: int) -> Column:
    """Rows that take part: a vector of the given length whose components are finite and so small that the distance of any
    two such vectors, at most length * (2 * scale * component)^2, is below EXACT."""
    most = F.sqrt(F.lit(EXACT / 4) / F.greatest(F.size(vector), F.lit(1))) / F.lit(float(scale)) - 1
    return F.coalesce((F.size(vector) == length) & F.forall(vector, lambda c: F.coalesce((c < most) & (c > -most), F.lit(False))), F.lit(False))


def _sums(books, scale: int):
    """A task's sums: part, entry, n, s0, s1, ... for entries that it used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, entries, width = book.shape
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _components(batch, scale, parts * width)
                at = assign(x, book)[0] + np.arange(parts) * entries
                n += np.bincount(at.ravel(), minlength=len(n))
                np.add.at(total, at.ravel(), x.reshape(-1, width))
        used = np.nonzero(n)[0]
        columns = [used // entries, used % entries, n[used], *total[used].T]
        names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return run


def learn(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> np.ndarray:
    """Codebooks (parts x entries x components) after ``rounds`` rounds over ``vectors`` (id, x: usable ones of one length).

    The smallest ids start them; of rows that share an id the least vector does. Entries that no part is nearest to stay.
    """
    spark = vectors.sparkSession
    start = vectors.filter("id IS NOT NULL").groupBy("id").agg(F.min("x").alias("x")).orderBy("id").limit(entries).collect()
    if not start:
        start = vectors.agg(F.min("x").alias("x")).filter("x IS NOT NULL").collect()
    first = np.floor(scale * np.array([r.x for r in start], np.float64)).astype(np.int64)
    book = np.ascontiguousarray(first.reshape(len(start), parts, -1).transpose(1, 0, 2))
    width = book.shape[2]
    sums = [f"s{i}" for i in range(width)]
    schema = ", ".join(["part long", "entry long", "n long", *(f"{s} long" for s in sums)])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(book)
        met = vectors.select("x").mapInArrow(_sums(sent, scale), schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect()
        book = book.copy()
        for r in met:
            book[r.part, r.entry] = [r[s] // r.n for s in sums]
        sent.unpersist()
    return book


def _codes(books, scale: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        parts, _, width = book.shape
        digits = max(2, (len(f"{book.shape[1] - 1:x}") + 1) // 2 * 2)
        for batch in batches:
            if batch.num_rows:
                code, error = assign(_components(batch, scale, parts * width), book)
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(text), pa.array(error.sum(axis=1))], schema=schema)

    return run


def encode(vectors: DataFrame, book: np.ndarray, scale: int = 1024) -> DataFrame:
    """id, label, code (the parts' entries, two hex digits each at up to 256 entries), error (sum of squared distances)."""
    types = {f.name: f.dataType for f in vectors.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(types["id"])), ("label", to_arrow_type(types["label"])), ("code", pa.string()), ("error", pa.int64())])
    sent = vectors.sparkSession.sparkContext.broadcast(book)
    return vectors.select("id", "label", "x").mapInArrow(_codes(sent, scale, schema), f"id {types['id'].simpleString()}, label {types['label'].simpleString()}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: its errors summed over equal labels, null being one; null where the sum is beyond 64 bits.

    Errors are summed before they are shuffled. The sums are broadcast while they are few (rows are coded once for them and
    once for the result); else they are copied to SALTS shares of each label, so that a label with a third of all rows is
    joined in that many tasks.
    """
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    few = sums.limit(BROADCAST_LABELS + 1).collect()
    if len(few) <= BROADCAST_LABELS:
        other = F.broadcast(coded.sparkSession.createDataFrame(few, sums.schema).withColumnRenamed("label", "of"))
        return coded.join(other, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    other = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("share"))
    mine = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return mine.join(other, (F.col("salt") == F.col("share")) & F.col("label").eqNullSafe(F.col("of")), "left").drop("of", "salt", "share")


def listed(book: np.ndarray) -> str:
    """All components by part, entry and position."""
    return ",".join(map(str, book.ravel().tolist()))


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 of every row that takes part.

    A row takes part if its vector is not null, holds no null or non-finite component and none whose distances could reach
    EXACT (185,000 in vectors of 64), and has the length of the vector of the smallest id (of several, the least vector), which must be a multiple of ``parts``; if it
    is not, or no row is left, there are no rows. Rows that repeat an id are coded one by one; a null id is coded but
    starts no codebook while others do. Equal distances go to the lower entry. Other columns are dropped.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("x"), F.col(label).alias("label"))
    head = rows.filter((F.size("x") > 0) & usable(F.col("x"), scale, F.size("x"))).agg(F.min(F.struct(F.col("id").isNull(), "id", "x")).alias("least")).first().least
    length = len(head.x) if head else 0
    if not length or length % parts:
        return spark.createDataFrame([], f"{key} {dict(rows.dtypes)['id']}, code string, error long, label_error long, codebooks_sha256 string")
    kept = rows.filter(usable(F.col("x"), scale, length))
    book = learn(kept, parts, entries, rounds, scale)
    out = with_label_error(encode(kept, book, scale)).withColumn("codebooks_sha256", F.sha2(F.lit(listed(book)), 256))
    return out.select(F.col("id").alias(key), "code", "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of the whole result: each round as two materialized steps."""
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, e[i] AS x FROM (SELECT vec_id, e, len(e) AS n, unnest(range(1, len(e) + 1)) AS i FROM v))",
        f"b0 AS MATERIALIZED (SELECT k.entry, x.part, x.pos, x.x AS c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) k JOIN x USING (vec_id))",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS (SELECT x.vec_id, x.part, b.entry, sum((x.x - b.c) * (x.x - b.c)) AS d FROM x JOIN b{i} b ON b.part = x.part AND b.pos = x.pos GROUP BY ALL)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT a.part, a.entry, x.pos, CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN x USING (vec_id, part) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.entry, b.part, b.pos, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c FROM b{i} b LEFT JOIN m{i} m USING (part, entry, pos))")
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS s FROM b{rounds}),
f AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM f JOIN v USING (vec_id), h"""
