"""Preference pairs from conversations: a shared prompt and two masked completions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of a turn. A "<|" inside a text becomes "< |", so no text can forge one.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected: the turns of the two conversations, empty where one is missing."""
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0
    pairs = whole.groupBy(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    return pairs.agg(F.coalesce(F.first(F.when(even, F.col("turns")), True), empty).alias("chosen"), F.coalesce(F.first(F.when(~even, F.col("turns")), True), empty).alias("rejected"))


def _rendered(turn: Column) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("unknown")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(OPEN), F.replace(role, F.lit("<|"), F.lit("< |")), F.lit(MIDDLE), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(CLOSE))


def _rest(turns: str, prefix: str = "prefix_turns") -> Column:
    return F.expr(f"slice({turns}, cast({prefix} as int) + 1, greatest(size({turns}) - cast({prefix} as int), 0))")


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """start:end of what is trained on: the text and end marker of assistant turns, in characters of the completion."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(done, turn):
        end = done["at"] + F.length(_rendered(turn))
        head = F.length(F.replace(F.coalesce(turn["role"], F.lit("unknown")), F.lit("<|"), F.lit("< |"))) + len(OPEN) + len(MIDDLE)
        span = F.concat_ws(":", done["at"] + head, end)
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, prefix_turns, prompt, and for chosen and rejected: turns, completion, mask.

    conversations has conv_id, turn, role, text. The even conversation 2n is the chosen and 2n + 1
    the rejected one of pair n. The prompt is their longest common prefix of turns (equal role and
    text, nulls equal), rendered once; the completions are what follows. A mask lists the
    character spans of the completion to train on; the rest is masked.

    Rows without conv_id are left out. Turns are in order of turn, then role, then text; repeated
    rows are turns of their own. A null role is rendered as unknown, a null text as empty. A
    conversation without partner gets a pair with an empty prompt and the other side empty; equal
    ones have empty completions. Conversations and texts of any length are rendered whole. Without
    rows there are no pairs. Other columns are not read.
    """
    pairs = _turns(conversations)
    both = F.least(F.size("chosen"), F.size("rejected"))
    equal = F.when(both > 0, F.transform(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.element_at("chosen", i).eqNullSafe(F.element_at("rejected", i)))).otherwise(F.array().cast("array<boolean>"))
    differ = F.array_position(equal, F.lit(False))
    pairs = pairs.withColumn("prefix_turns", F.when(differ > 0, differ - 1).otherwise(both).cast("long"))
    pairs = pairs.withColumn("a", _rest("chosen")).withColumn("b", _rest("rejected"))
    return pairs.select(
        "pair_id", "prefix_turns", _text(F.expr("slice(chosen, 1, cast(prefix_turns as int))")).alias("prompt"),
        F.size("chosen").cast("long").alias("chosen_turns"), _text(F.col("a")).alias("chosen"), _mask(F.col("a")).alias("chosen_mask"),
        F.size("rejected").cast("long").alias("rejected_turns"), _text(F.col("b")).alias("rejected"), _mask(F.col("b")).alias("rejected_mask"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 <> 0 AS odd, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         '<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (NOT odd) AS nc, count(*) FILTER (odd) AS nr FROM t GROUP BY pair_id),
x AS (
  SELECT c.pair_id, min(c.i) AS i FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.i = r.i AND NOT c.odd AND r.odd
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY c.pair_id),
p AS (SELECT n.*, coalesce(x.i - 1, least(nc, nr)) AS prefix FROM n LEFT JOIN x USING (pair_id)),
w AS (
  SELECT t.*, prefix,
         coalesce(sum(length(head) + length(body)) OVER (PARTITION BY t.pair_id, odd ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM t JOIN p USING (pair_id) WHERE i > prefix)
SELECT p.pair_id, prefix AS prefix_turns,
       coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM t WHERE t.pair_id = p.pair_id AND NOT odd AND i <= prefix), '') AS prompt,
       nc AS chosen_turns,
       coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM w WHERE w.pair_id = p.pair_id AND NOT odd), '') AS chosen,
       coalesce((SELECT string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY i) FROM w WHERE w.pair_id = p.pair_id AND NOT odd AND role = 'assistant'), '') AS chosen_mask,
       nr AS rejected_turns,
       coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM w WHERE w.pair_id = p.pair_id AND odd), '') AS rejected,
       coalesce((SELECT string_agg((pos + length(head))::BIGINT || ':' || (pos + length(head) + length(body))::BIGINT, ',' ORDER BY i) FROM w WHERE w.pair_id = p.pair_id AND odd AND role = 'assistant'), '') AS rejected_mask
FROM p
"""
