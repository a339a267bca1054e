"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as the
prompt, the rest of each as its completion, with the assistant's words marked for training.

``format_pairs`` has a row for each rendered turn: ``part`` is prompt, chosen or rejected, ``turn`` orders a part, and ``train_from``
and ``train_to`` bound the characters of ``rendered`` that count in the loss (null: none). Prompts are never trained on.
``paired`` puts them together: one row a pair with the prompt, both completions and the trained spans within each. Turns are counted
by their rank among the pair's, whatever their numbers; only a pair of more than ``SEGMENT`` of them has a row for each so many.

Cases: equal turns have the same number, role and text; a null role or text is rendered as empty and equals only
itself; inside a role or text a backslash is doubled, and a ``<`` before ``|`` or at the end is followed by one, so that no mark can be
read there and different texts never render alike; repeated rows count once; several rows of one turn are rendered
in order of role and text; rows without a conversation or turn number belong to none and are left out; a conversation whose partner is
missing gives no rows; of two equal conversations all is prompt; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import table

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Turns in a row of ``paired``.
SEGMENT = 1000


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=\||\z)", r"<\\")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE), escaped(text), F.lit(END))


def format_pairs(turns: DataFrame) -> DataFrame:
    """For turns (pair_id, side, turn, role, text), side 0 chosen and 1 rejected: (pair_id, part, turn, place, role,
    rendered, train_from, train_to)."""
    said = F.struct(F.col("role"), F.col("text"))
    side = lambda n: F.sort_array(F.collect_set(F.when(F.col("side") == n, said)))
    both = turns.filter("pair_id IS NOT NULL AND turn IS NOT NULL").groupBy("pair_id", "turn").agg(side(0).alias("c"), side(1).alias("r"))
    parts = both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("split"), F.max(F.size("c")).alias("any_c"), F.max(F.size("r")).alias("any_r")
    )
    lined = both.join(parts.filter("any_c > 0 AND any_r > 0"), "pair_id")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    of = lambda part, column: F.transform(column, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("place"), x["role"].alias("role"), x["text"].alias("text")))
    rows = F.when(shared, of("prompt", F.col("c"))).otherwise(F.concat(of("chosen", F.col("c")), of("rejected", F.col("r"))))
    out = lined.select("pair_id", "turn", F.explode(rows).alias("x")).select("pair_id", "x.part", "turn", "x.place", "x.role", rendered(F.col("x.role"), F.col("x.text")).alias("rendered"))
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED, F.lit(False))
    return out.withColumn("train_from", F.when(trained, F.length("role") + len(OPEN) + len(CLOSE))).withColumn("train_to", F.when(trained, F.length("rendered")))


def paired(turns: DataFrame) -> DataFrame:
    """For turns (pair_id, side, turn, role, text): (pair_id, segment, prompt, chosen, chosen_spans, rejected, rejected_spans), spans
    being (from, to) in characters."""
    turn = F.struct("part", "turn", "place", "rendered", "train_from", "train_to")
    rank = F.dense_rank().over(Window.partitionBy("pair_id").orderBy("turn")) - 1
    whole = format_pairs(turns).withColumn("segment", F.floor(rank / SEGMENT)).groupBy("pair_id", "segment").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    of = lambda part: F.filter("all", lambda x: x["part"] == part)
    text = lambda part: F.array_join(F.transform(of(part), lambda x: x["rendered"]), "")
    none = F.array().cast("array<struct<from: int, to: int>>")

    def spans(part: str) -> Column:
        span = lambda acc, x: F.array(F.struct((acc["at"] + x["train_from"]).alias("from"), (acc["at"] + x["train_to"]).alias("to")))
        step = lambda acc, x: F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), F.when(x["train_from"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], span(acc, x))).alias("spans"))
        return F.aggregate(of(part), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    return whole.select(
        "pair_id", "segment", text("prompt").alias("prompt"), text("chosen").alias("chosen"), spans("chosen").alias("chosen_spans"), text("rejected").alias("rejected"), spans("rejected").alias("rejected_spans"),
    )


def answers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, answer): the last trained turn of each conversation; of several rows of it the greatest text."""
    last = turns.filter(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    return last.select("conv_id", F.col("x.turn").alias("last"), F.col("x.text").alias("answer"))


def with_other_answers(turns: DataFrame) -> DataFrame:
    """Turns of pairs (pair_id, side, turn, role, text): each conversation is chosen over itself with the last answer of the
    conversation after it (the next conv_id; a null text if there is none) in place of its own."""
    turns = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", "text")
    own = answers(turns)
    theirs = own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer").alias("other"))
    swap = own.select("conv_id", "last").join(theirs, "conv_id", "left")
    other = F.when((F.col("role") == TRAINED) & (F.col("turn") == F.col("last")), F.col("other")).otherwise(F.col("text"))
    rejected = turns.join(swap, "conv_id", "left").select("conv_id", F.lit(1).alias("side"), "turn", "role", other.alias("text"))
    return turns.select("conv_id", F.lit(0).alias("side"), "turn", "role", "text").unionByName(rejected).withColumnRenamed("conv_id", "pair_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another answer; spans are written as text."""
    found = paired(with_other_answers(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["from"], x["to"])), " ").alias(c)
    return found.select("pair_id", "segment", "prompt", "chosen", shown("chosen_spans"), "rejected", shown("rejected_spans"))


ORACLE = r"""
WITH c AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), a AS (
  SELECT conv_id, turn AS last, text AS answer FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) = 1
), t AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM c
  UNION SELECT c.conv_id, 1, turn, role, CASE WHEN role = 'assistant' AND turn = a.last THEN o.answer ELSE text END FROM c LEFT JOIN a ON c.conv_id = a.conv_id LEFT JOIN a o ON o.conv_id = c.conv_id + 1
), g AS (
  SELECT pair_id, side, turn, list({'r': role, 't': text} ORDER BY role NULLS FIRST, text NULLS FIRST) AS said FROM t GROUP BY ALL
), b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.said AS c, r.said AS r
  FROM (SELECT * FROM g WHERE side = 0) c FULL JOIN (SELECT * FROM g WHERE side = 1) r ON c.pair_id = r.pair_id AND c.turn = r.turn
), p AS (
  SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS split FROM b GROUP BY pair_id HAVING count(c) > 0 AND count(r) > 0
), x AS (
  SELECT pair_id, 'prompt' AS part, turn, c AS said FROM b JOIN p USING (pair_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT pair_id, 'chosen', turn, c FROM b JOIN p USING (pair_id) WHERE turn >= split AND c IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, r FROM b JOIN p USING (pair_id) WHERE turn >= split AND r IS NOT NULL
), u AS (
  SELECT pair_id, part, turn, unnest(range(len(said))) AS i, said FROM x
), o AS (
  SELECT pair_id, ((dense_rank() OVER (PARTITION BY pair_id ORDER BY turn) - 1) // 1000)::BIGINT AS segment, part, turn, i, said[i + 1].r AS role,
         regexp_replace(replace(replace(coalesce(said[i + 1].r, ''), '\', '\\'), '<|', '<\|'), '<$', '<\\') AS shown,
         regexp_replace(replace(replace(coalesce(said[i + 1].t, ''), '\', '\\'), '<|', '<\|'), '<$', '<\\') AS body FROM u
), w AS (
  SELECT *, '<|' || shown || '|>' || chr(10) || body || '<|end|>' || chr(10) AS rendered FROM o
), n AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, segment, part ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM w
), m AS (
  SELECT *, CASE WHEN role = 'assistant' THEN (start + 14)::VARCHAR || '-' || (start + length(rendered))::VARCHAR END AS span FROM n
)
SELECT pair_id, segment, coalesce(string_agg(rendered, '' ORDER BY turn, i) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY turn, i) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(span, ' ' ORDER BY turn, i) FILTER (part = 'chosen'), '') AS chosen_spans,
       coalesce(string_agg(rendered, '' ORDER BY turn, i) FILTER (part = 'rejected'), '') AS rejected, coalesce(string_agg(span, ' ' ORDER BY turn, i) FILTER (part = 'rejected'), '') AS rejected_spans
FROM m GROUP BY pair_id, segment
"""
