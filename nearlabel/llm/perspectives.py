"""Perspective rotation of multi-party dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as
users with a name, and a mask that covers what the speaker says. A dialogue is rendered in parts of ``PART`` messages,
because one conversation may hold any share of all rows and one string cannot; the parts of a conversation and
participant, one after another, are the whole dialogue.

Messages are numbered by one range sort of all rows and the number at which their conversation begins, so no task sees a
whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearlabel.operators.dictionary import with_rank

#: Messages in a part.
PART = 64
#: Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escaped(text: Column) -> Column:
    """The text with the format's own markers broken, so that no message can fake a turn."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|(?=im_(?:start|end)\|>)", "<| ")


def _name(role: Column) -> Column:
    """A role as it stands in a header: markers broken, and line breaks as blanks, so that no name can fake a turn."""
    return F.regexp_replace(_escaped(F.coalesce(role, F.lit("unknown"))), "[\\r\\n\\x0B\\x0C\\x85\\u2028\\u2029]", " ")


def rotate(df: DataFrame, context_roles: tuple[str, ...] = ("system",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part (from 0), n_messages, rendered, mask
    (``start:end`` of the code points the loss covers, comma-joined), n_masked (their number).

    Messages are ordered by turn, role, text, nulls first. Rows that are equal in all four columns are one message.
    ``context_roles`` are rendered as they are and are no participants; a message without a role comes from the user
    ``unknown``, who is no participant either. Null text is empty; a null conversation or turn is a value like others;
    conversations without participants give no rows, and so does the empty table. Extra columns are dropped. A part has
    whole messages, however long.
    """
    said = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("t"), F.col(role).alias("r"), _escaped(F.col(text)).alias("x")).distinct()
    ranked = with_rank(said, ["conv_id", "t", "r", "x"], "rank")
    begins = ranked.groupBy(F.col("conv_id").alias("c")).agg(F.min("rank").alias("begin"))
    placed = ranked.join(begins, ranked.conv_id.eqNullSafe(begins.c)).withColumn("part", F.floor((F.col("rank") - F.col("begin")) / PART))
    parts = placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "t", "r", "x"))).alias("m"))
    speakers = ranked.filter(F.col("r").isNotNull() & ~F.col("r").isin(*context_roles)).select(F.col("conv_id").alias("c"), F.col("r").alias("perspective")).distinct()
    seen = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.c)).drop("c")

    def head(m: Column) -> Column:
        return (
            F.when(m["r"] == F.col("perspective"), F.lit(f"{OPEN}assistant\n"))
            .when(m["r"].isin(*context_roles), F.concat(F.lit(OPEN), m["r"], F.lit("\n")))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), _name(m["r"]), F.lit("\n")))
        )

    turns = seen.withColumn("h", F.transform("m", head)).withColumn("n", F.zip_with("h", "m", lambda h, m: F.length(h) + F.length(m["x"]) + len(CLOSE) + 1))
    placed_spans = turns.withColumn(
        "spans",
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.size("m")),
                lambda i: F.struct(
                    (F.aggregate(F.slice("n", 1, i - 1), F.lit(0), lambda a, v: a + v) + F.length(F.element_at("h", i))).alias("a"),
                    (F.aggregate(F.slice("n", 1, i), F.lit(0), lambda a, v: a + v) - 1).alias("z"),
                    (F.element_at("m", i)["r"] == F.col("perspective")).alias("own"),
                ),
            ),
            lambda s: s["own"],
        ),
    )
    return placed_spans.select(
        "conv_id", "perspective", "part",
        F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.zip_with("h", "m", lambda h, m: F.concat(h, m["x"], F.lit(f"{CLOSE}\n"))), "").alias("rendered"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["a"].cast("string"), F.lit(":"), s["z"].cast("string"))), ",").alias("mask"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["z"] - s["a"]).alias("n_masked"),
    )


ORACLE = r"""
WITH d AS (SELECT DISTINCT conv_id, turn AS t, role AS r,
    regexp_replace(regexp_replace(coalesce(text, ''), '<\|im_start\|>', '<| im_start|>', 'g'), '<\|im_end\|>', '<| im_end|>', 'g') AS x FROM conversations),
m AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY t NULLS FIRST, r NULLS FIRST, x) - 1) // 64 AS part FROM d),
p AS (SELECT DISTINCT conv_id, r AS perspective FROM m WHERE r IS NOT NULL AND r <> 'system'),
s AS (SELECT m.*, p.perspective, CASE WHEN r = perspective THEN '<|im_start|>assistant' || chr(10)
    WHEN r = 'system' THEN '<|im_start|>system' || chr(10)
    ELSE '<|im_start|>user name=' || regexp_replace(regexp_replace(regexp_replace(coalesce(r, 'unknown'), '<\|im_start\|>', '<| im_start|>', 'g'), '<\|im_end\|>', '<| im_end|>', 'g'),
        '[\r\n\x0B\x0C\x{85}\x{2028}\x{2029}]', ' ', 'g') || chr(10) END AS h
    FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
l AS (SELECT *, h || x || '<|im_end|>' || chr(10) AS seg, length(h) + length(x) + 11 AS n FROM s),
o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, perspective, part ORDER BY t NULLS FIRST, r NULLS FIRST, x ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT conv_id, perspective, part, count(*) AS n_messages,
    string_agg(seg, '' ORDER BY t NULLS FIRST, r NULLS FIRST, x) AS rendered,
    coalesce(string_agg((CAST(upto AS BIGINT) - n + length(h)) || ':' || (CAST(upto AS BIGINT) - 1), ',' ORDER BY t NULLS FIRST, r NULLS FIRST, x)
        FILTER (WHERE r = perspective), '') AS mask,
    CAST(coalesce(sum(length(x) + 10) FILTER (WHERE r = perspective), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, perspective, part
"""
