"""Chat formatting with rotating perspectives, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker as the assistant and the others as
named users; what the assistant says is to be learnt, everything else is masked. A conversation's rows are numbered in
their order, and each PIECE of them is rendered as one row, so that no conversation must fit into one row or task; the
texts are shuffled as pieces, and only then meet the participants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from brindle.llm.skew import row_numbers

#: Rows of a conversation that one row of the result renders; only longer dialogues have a second piece.
PIECE = 256
#: Pieces of a conversation that meet its participants under one join key.
TOGETHER = 64
END = "<|end|>\n"


def head(role: Column, participant: Column, context_roles: tuple[str, ...]) -> Column:
    return (
        F.when(role.isin(*context_roles), F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .when(role == participant, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user:"), role, F.lit("|>\n")))
    )


def perspectives(turns: DataFrame, *, context_roles: tuple[str, ...] = ("system",), piece: int = PIECE) -> DataFrame:
    """(conv_id, participant, piece, n_turns, text, spans array<struct<start, end>>) for turns (conv_id, turn, role, text, ...).

    A conversation's participants are its roles but for context_roles, which stay what they are. Its rows stand in the
    order of turn (nulls first), role and text; piece k holds the rows from k * piece on in that order, at every size, so
    the texts of pieces 0, 1, ... joined are the whole dialogue. A null role is "unknown", a null text is empty; repeated
    rows are repeated turns. Rows with a null conv_id are left out, and a conversation without a participant has no rows.
    spans are the code point ranges of a piece's text that the assistant is to learn: its texts with their end marks.
    Other columns are ignored; an empty table gives an empty result."""
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = row_numbers(own, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], "chat-order")
    placed = placed.withColumn("piece", F.floor(F.col("row") / piece).cast("long"))
    pieces = placed.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list(F.struct("row", "role", "text"))).alias("turns"))
    # a participant stands once for each TOGETHER pieces, so a long conversation is no single join key
    people = placed.where(~F.col("role").isin(*context_roles)).groupBy("conv_id", "role").agg(F.lit(None)).select("conv_id", F.col("role").alias("participant"))
    last = placed.groupBy("conv_id").agg(F.max("piece").alias("last"))
    people = people.join(last, "conv_id").select("conv_id", "participant", F.explode(F.sequence(F.lit(0), (F.col("last") / TOGETHER).cast("int"))).alias("_group"))
    grouped = pieces.withColumn("_group", (F.col("piece") / TOGETHER).cast("int"))
    rows = grouped.hint("merge").join(people.hint("merge"), ["conv_id", "_group"])
    parts = F.transform("turns", lambda t: F.struct(
        head(t["role"], F.col("participant"), context_roles).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        (~t["role"].isin(*context_roles) & (t["role"] == F.col("participant"))).alias("own"),
    ))
    rows = rows.select("conv_id", "participant", "piece", F.size("turns").alias("n_turns"), parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        a = s["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(p["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return rows.select(
        "conv_id", "participant", "piece", "n_turns",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"),
        F.aggregate("parts", start, step)["spans"].alias("spans"),
    )


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS row FROM t),
people AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
s AS (SELECT n.*, row // {PIECE} AS piece, participant, role = participant AS own,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = participant THEN '<|assistant|>' || chr(10)
      ELSE '<|user:' || role || '|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body FROM n JOIN people USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, piece ORDER BY row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s)
SELECT conv_id, participant, piece::BIGINT AS piece, count(*)::INTEGER AS n_turns, string_agg(head || body, '' ORDER BY row) AS text,
  coalesce(string_agg(CASE WHEN own THEN (before + length(head)) || '-' || (before + length(head) + length(body)) END, ' ' ORDER BY row), '') AS mask_spans
FROM o GROUP BY conv_id, participant, piece"""
