"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is under the loss
mask. Turns after the last reply, or of a conversation without any, become an example without a target, so no turn is lost.

The template marks turns with control strings; inside roles and texts, those strings (and those of other common templates)
get a backslash after their first character, one more if they had some, so that the text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of this template all begin with "<|"; the rest are those of other templates, escaped as well.
CONTROL = r"(\||/?s>|/?INST\])"
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples: conv_id, example (1, 2, ... in a conversation), n_context (turns), context, target (null if none).

    The formatted text is context and target, one after the other; the loss mask covers the target, without its END mark.
    Rows of a conversation follow turn (null first), then role and text, so ties and repeated rows have one order; null roles
    and texts are empty, and rows without a conversation are one conversation, whose id is null. Texts of any length are formatted whole; a conversation becomes one
    row, so it must fit in a task. Other columns are not read. An empty table gives no examples.
    """
    own = F.col("conv_id")
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    said = F.transform("turns", lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(SAYS), escape(x["text"]), F.lit(END)))
    chats = rows.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).select("conv_id", said.alias("said"), F.transform("turns", lambda x: x["role"] == "assistant").alias("replies"))
    # The place of every reply, and the end if the last turn is none.
    count = F.size("said")
    ends = F.filter(F.sequence(F.lit(1), count), lambda i: F.element_at("replies", i) | (i == count))
    cut = chats.select("conv_id", "said", "replies", F.posexplode(ends).alias("example", "at"))
    reply = F.element_at("replies", F.col("at"))
    last = F.element_at("said", F.col("at"))
    body = F.locate(SAYS, last) + len(SAYS)
    before = F.array_join(F.slice("said", F.lit(1), F.col("at") - 1), "")
    return cut.select(
        "conv_id",
        (F.col("example") + 1).alias("example"),
        F.col("at").alias("n_context"),
        F.concat(before, F.when(reply, F.substring(last, F.lit(1), body - 1)).otherwise(last)).alias("context"),
        F.when(reply, F.substring(last, body, F.length(last) - len(END) - body + 1)).alias("target"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role and text), loss (all text under the mask, in order) and formatted_chars from formatted examples."""
    whole = F.concat("context", F.coalesce("target", F.lit("")), F.when(F.col("target").isNotNull(), F.lit(END)).otherwise(F.lit("")))
    chats = examples.groupBy("conv_id").agg(
        F.max_by(whole, "example").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", unescape(F.col("target")).alias("text"))))), lambda x: x["text"]), "").alias("loss"),
        F.sum(F.length(whole)).alias("formatted_chars"),
    )
    marked = F.filter(F.split("last", r"<\|turn\|>"), lambda x: x != "")
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(x, SAYS, 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)<\|says\|>(.*)<\|end\|>", 1)).alias("text"),
        ),
    )
    return chats.select("conv_id", turns.alias("turns"), "loss", "formatted_chars")
