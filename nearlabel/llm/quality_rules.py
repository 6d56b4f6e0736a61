"""Quality rules as a short-circuit cascade.

A rule is a predicate over named metrics of a text. A metric is a column expression; it is a column of the frame where
somebody needs its value anyway, and else stands inside the one branch of the cascade that asks for it. The cascade is
one CASE: a text that a rule rejects never reaches the next one. On a bounded sample each rule is run alone, which gives
its cost (seconds beyond an empty pass) and its selectivity (share rejected); rules are then ordered by rejection per
cost. The order decides cost alone: a text is kept if no rule rejects it, whatever the order.

Everything is DataFrame functions; nothing is shuffled, so a hot source or a group of copies weighs like other rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than these.
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window whose second occurrence counts as repeated.
WINDOW = 8
#: The sample that decides the order of rules: rows, and bytes of its longest text, so 32 MB at most. Results don't
#: depend on it.
SAMPLE_ROWS, SAMPLE_BYTES = 512, 1 << 16
#: Runs of each rule over the sample; the fastest counts.
RUNS = 2

Metrics = Callable[[str], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # noqa: PLW0108 - transform counts a function's parameters


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def lines(text: Column) -> Column:
    """Lines between \\n that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Hashes of all windows come from pairs of pairs; if they differ all round, so do the windows. Only else the windows
    themselves are sorted and compared, so no collision changes the count. ``window``: a power of two.
    """
    n = F.size(w)

    def pairs(h: Column, step: int) -> Column:
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))

    def hashes(h: Column, step: int = 1) -> Column:
        return F.slice(h, 1, n - (window - 1)) if step == window else let(pairs(h, step), lambda g: hashes(g, 2 * step))

    def exact(w: Column) -> Column:
        at = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("s"), i.alias("i")))

        def twice(a: Column) -> Column:
            same = F.filter(a, lambda x, k: (F.get(a, k - 1)["s"] == x["s"]) | F.coalesce(F.get(a, k + 1)["s"] == x["s"], F.lit(False)))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        return let(F.sort_array(at), twice)

    def covered(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)

    apart = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(hashes(h), lambda g: F.size(F.array_distinct(g)) == F.size(g)))
    return F.when(n <= window, F.lit(0).cast("bigint")).when(apart, F.lit(0).cast("bigint")).otherwise(exact(w))


def _of_words(body: Callable[[Column], Column]) -> Callable[[Metrics], Column]:
    return lambda m: body(m("words"))


#: Name to expression; ``m`` gives other metrics by name, and the text as m("text").
METRICS: Mapping[str, Callable[[Metrics], Column]] = {
    "words": lambda m: words(m("text")),
    "n_words": _of_words(lambda w: F.size(w).cast("bigint")),
    "word_chars": _of_words(lambda w: F.length(F.array_join(w, "")).cast("bigint")),
    "n_letter_words": _of_words(lambda w: F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("bigint")),
    "n_repeat_words": _of_words(lambda w: let(w, repeat_words)),
    "n_symbols": lambda m: F.regexp_count(F.coalesce(m("text"), F.lit("")), F.lit(SYMBOLS)).cast("bigint"),
    "n_lines": lambda m: F.size(lines(m("text"))).cast("bigint"),
    "n_dup_lines": lambda m: let(lines(m("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
}


class Rule(NamedTuple):
    """``rejects`` gets the metrics by name and says whether the text is rejected."""

    name: str
    rejects: Callable[[Metrics], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
)
#: Shares of words, of characters and of lines, as commonly used for web text in any alphabet.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("word_length", lambda m: (m("word_chars") < 3 * m("n_words")) | (m("word_chars") > 12 * m("n_words"))),
    Rule("letters", lambda m: 10 * m("n_letter_words") < 8 * m("n_words")),
    Rule("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
)


def metric(columns: Sequence[str], text: str = "text") -> Metrics:
    """Metrics by name: a column where the frame has one, else the expression."""

    def get(name: str) -> Column:
        if name == "text":
            return F.col(text)
        return F.col(name) if name in columns else METRICS[name](get)

    return get


class Estimate(NamedTuple):
    """Of one rule on the sample: seconds beyond an empty pass, and the share of rows that it rejects."""

    name: str
    cost: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.cost, 1e-4)


def estimate(df: DataFrame, rules: Sequence[Rule], have: Sequence[str], text: str = "text") -> list[Estimate]:
    """Cost and selectivity of each rule, on the first rows that Spark reads (at most SAMPLE_ROWS, without texts beyond
    SAMPLE_BYTES). They are taken from as few partitions as hold them and dealt out anew, so nothing is scanned whole or
    shuffled for them. An empty sample has no costs and rejects nothing."""
    m = metric(have, text)
    used = [text, *have]
    rows = df.filter(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES).select(*used).limit(SAMPLE_ROWS).collect()
    sample = df.sparkSession.createDataFrame(rows, df.select(*used).schema).persist()
    try:

        def timed(rejects: Column) -> tuple[float, float]:
            share = sample.agg(F.coalesce(F.avg(F.when(rejects, 1).otherwise(0)), F.lit(0.0)).alias("share"))
            seconds = []
            for _ in range(RUNS):
                began = time.perf_counter()
                found = share.first().share
                seconds.append(time.perf_counter() - began)
            return min(seconds), found

        timed(F.lit(False))  # fills the sample
        empty = timed(F.col(text).isNull())[0]
        return [Estimate(r.name, max(0.0, (t := timed(r.rejects(m)))[0] - empty), t[1]) for r in rules]
    finally:
        sample.unpersist()


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """Rules by rejection per cost, the highest first; ties stay as given."""
    rank = {e.name: e.rank for e in estimates}
    return sorted(rules, key=lambda r: -rank[r.name])


def first_failed(rules: Sequence[Rule], columns: Sequence[str], text: str = "text") -> Column:
    """The first rule, in the order given, that rejects the text; null if none does."""
    m, out = metric(columns, text), None
    for r in rules:
        hit = F.coalesce(r.rejects(m), F.lit(False))
        out = F.when(hit, r.name) if out is None else out.when(hit, r.name)
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string"))


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", have: Sequence[str] = (), order: Sequence[Rule] | None = None) -> DataFrame:
    """Each row of ``df`` with ``failed`` (the rule that rejected it, as the chosen order has it) and ``kept``.

    ``have``: metrics that are columns of ``df``. ``order``: rules as ``ordered`` gave them before, else they are
    estimated here. A null text is empty: no words, so ``few_words`` rejects it. Repeated rows are judged one by one;
    other columns stay, but ``failed`` and ``kept`` are replaced. An empty frame gives no rows.
    """
    order = order or ordered(rules, estimate(df, rules, have, text))
    return df.withColumn("failed", first_failed(order, have, text)).withColumn("kept", F.col("failed").isNull())


def judged(df: DataFrame, metrics: Sequence[str], rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the named metrics, failed, base_failed (a rule of BASE_RULES rejects it), kept."""
    base = df.select(key, F.col(text).alias("text")).withColumn("words", words(F.col("text")))
    m = metric(["words"])
    wide = base.select("*", *[m(x).alias(x) for x in metrics])
    have = ["words", *metrics]
    out = cascade(wide, rules, have=have)
    failed = first_failed(BASE_RULES, have).isNotNull()
    return out.select(key, *metrics, "failed", failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
p AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS q FROM h) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
  len(l) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words FROM w LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
    OR 10 * n_letter_words < 8 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM m
"""
