"""Chat formatting (operator 6): preference pairs with a shared prompt and masked completions.

Both conversations of a pair are cut at their longest common turn prefix.  The prefix is
rendered once as the prompt; the rest of each is its completion, with the spans of it that
are trained on.  Everything stays in built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import dense_ranks

#: Opening and closing of a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Conversations are ranked within blocks of so many ids.
BLOCK = 1024


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): turns in order as structs of role and text.

    Null roles and texts are as empty; turns of one number keep the order of role and text.
    A conversation without an id is left out.
    """
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    lists = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))


def neighbours(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(chosen_id, rejected_id): among conversations with one first turn, in order of their
    id, the first and second, third and fourth, and so on; a last odd one stays alone.  No
    conversation is in two pairs, so that none is trained on twice.

    A first turn that very many share is ranked block by block of ids, and the blocks by a
    running sum of their sizes, so that no task sees all of them.
    """
    keyed = convs.select("conv_id", F.xxhash64(F.get("turns", F.lit(0)).getField("role"), F.get("turns", F.lit(0)).getField("text")).alias("first"), F.floor(F.col("conv_id") / block).alias("block"))
    sizes = keyed.groupBy("first", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("first").orderBy("block")) - F.col("n"))
    own = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("first", "block").orderBy("conv_id")) - 1)
    ranked = own.join(before, ["first", "block"]).select("first", "conv_id", F.expr("(before + rank) div 2").alias("pair"), F.expr("(before + rank) % 2").alias("side"))
    sides = ranked.groupBy("first", "pair").agg(F.max(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"))
    return sides.where("rejected_id IS NOT NULL").select("chosen_id", "rejected_id")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.role, F.lit("\n"), turn.text, F.lit(CLOSE + "\n"))


def joined(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, rendered))


def spans(turns: Column) -> Column:
    """(start, end) in code points of the trained turns' text and closing in the rendering."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.length(turn.role) + (len(OPEN) + 1)
        end = acc.at + head + F.length(turn.text) + len(CLOSE)
        one = F.array(F.struct((acc.at + head).cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(turn.role == TRAINED, F.concat(acc.spans, one)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc.spans)


def followers(convs: DataFrame) -> DataFrame:
    """(conv_id, other_id): of each conversation the one of the next higher id, whatever lies
    between them, and of the last the first; none of a conversation that is alone.

    Ids are ranked in ranges of bounded tasks; the next one is the one of the next rank."""
    ranked = dense_ranks(convs.select("conv_id"), ["conv_id"], "place")
    n = ranked.count()
    other = ranked.select(F.col("conv_id").alias("other_id"), F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"))
    return ranked.join(other, "place").where("conv_id <> other_id").select("conv_id", "other_id")


def branched(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, c, r): each conversation, and the same led on from one of its
    trained turns, the one of number conv_id modulo their count, by the turns that stand
    there and after in the next conversation, as :func:`followers` says.

    Conversations without a trained turn are left out, and one that is alone."""
    both = paired(convs, followers(convs).withColumnsRenamed({"conv_id": "chosen_id", "other_id": "rejected_id"}))
    trained = F.filter(F.transform("c", lambda t, i: F.when(t.role == TRAINED, i)), lambda i: i.isNotNull())
    at = F.get("trained", F.pmod("chosen_id", F.size("trained").cast("long")).cast("int"))
    cut = both.withColumn("trained", trained).where("size(trained) > 0").withColumn("at", at)
    r = F.concat(F.slice("c", F.lit(1), F.col("at")), F.slice("r", F.col("at") + 1, F.greatest(F.size("r") - F.col("at"), F.lit(0))))
    return cut.select("chosen_id", "rejected_id", "c", r.alias("r"))


def paired(convs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, c, r): the turns of the pairs' conversations."""
    left = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    right = convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    return pairs.select("chosen_id", "rejected_id").join(left, "chosen_id").join(right, "rejected_id").select("chosen_id", "rejected_id", "c", "r")


def preferences(pairs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per pair: the columns ``carry``, ``chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected,
    chosen_spans, rejected_spans``.

    ``pairs`` is as from :func:`paired` or :func:`branched`: pairs that name an unknown or
    null conversation are left out there, repeated pairs keep a row each.  Two conversations that are
    alike share all their turns: both completions are empty.  Without a common turn the
    prompt is empty.  Spans cover the text and closing of assistant turns in a completion.
    """
    least = F.least(F.size("c"), F.size("r"))
    differ = F.transform(F.slice("c", 1, least), lambda x, i: (x.role != F.get("r", i).role) | (x.text != F.get("r", i).text))
    first = F.array_position(differ, True)
    cut = pairs.withColumn("n_prompt_turns", F.when(first > 0, first - 1).otherwise(least.cast("long")))
    n = F.col("n_prompt_turns").cast("int")
    parts = cut.select(*carry, "chosen_id", "rejected_id", "n_prompt_turns", F.slice("c", F.lit(1), n).alias("p"), F.slice("c", n + 1, F.size("c")).alias("c"), F.slice("r", n + 1, F.size("r")).alias("r"))
    return parts.select(*carry, "chosen_id", "rejected_id", "n_prompt_turns", joined(F.col("p")).alias("prompt"), joined(F.col("c")).alias("chosen"), joined(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"))
