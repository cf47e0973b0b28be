r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example is all turns up to and including one assistant turn; only that reply's text is trainable. If turns follow
the last reply, or there is none, one more example without a target carries the whole conversation.

The template writes a turn as ``<s>role``, a line break, the text, ``</s>``. Control strings inside texts and roles get
a backslash after their first sign, and one more if they have some already, so that no text can open or close a turn
and every text is read back as it was. In roles, backslashes and line breaks are escaped as well.

Built-in expressions; a conversation is gathered once, since an example needs all its turns as one string. Examples
are quadratic in the turns of a conversation, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that may not occur in a text as they are (fixed values).
CONTROL = r"/?s>|/?INST\]|</?SYS>>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    role = F.replace(F.replace(unescape(role), F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n"))
    return F.replace(role, F.lit("\0"), F.lit("\\"))


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_col, example (from 0), text, loss_start and loss_end (code points of the reply, end
    exclusive; null where nothing is trainable).

    Turns are ordered by number, ties by role, then text; a null role or text is empty, a null number comes first.
    Rows without conversation id are one conversation. Repeated rows are turns, each. Other columns aren't looked at.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    gathered = turns.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("turn")).groupBy("conv").agg(F.array_sort(F.collect_list("turn"), _in_order).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit("<s>"), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("text"), (t["role"] == ASSISTANT).alias("reply")))
    numbers = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: F.element_at("parts", k.cast("int"))["reply"] | (k == F.size("parts")))
    exploded = gathered.select("conv", parts.alias("parts")).withColumn("numbers", numbers).select("conv", "parts", F.posexplode("numbers").alias("example", "number"))
    whole = lambda n: F.array_join(F.transform(F.slice("parts", F.lit(1), n), lambda p: F.concat(p["head"], p["text"], F.lit("</s>"))), "")
    target = F.element_at("parts", F.col("number").cast("int"))
    marked = exploded.select("conv", "example", whole(F.col("number")).alias("text"), target.alias("target"))
    end = F.length("text") - 4
    return marked.select(F.col("conv").alias(conv_col), "example", "text", F.when(F.col("target.reply"), end - F.length("target.text")).alias("loss_start"), F.when(F.col("target.reply"), end).alias("loss_end"))


def _in_order(a: Column, b: Column) -> Column:
    def before(name: str, otherwise: Column) -> Column:
        x, y = a[name], b[name]
        return (F.when(x.isNull() & y.isNull(), otherwise).when(x.isNull(), -1).when(y.isNull(), 1)
                .when(x < y, -1).when(x > y, 1).otherwise(otherwise))

    return before("turn", before("role", before("text", F.lit(0))))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of structs role, text."""
    found = [F.regexp_extract_all(formatted, F.lit(r"(?s)<s>(.*?)\n(.*?)</s>"), F.lit(k)) for k in (1, 2)]
    return F.zip_with(*found, lambda role, text: F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(trap).alias("text"))
    made = examples(turns.union(extra))
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    every = made.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"), F.collect_list(F.when(loss.isNotNull(), F.struct("example", loss.alias("loss")))).alias("losses"), F.sum(F.length("text")).alias("formatted_chars"))
    turns = read_back(F.col("longest"))
    lost = F.array_join(F.transform(F.array_sort("losses"), lambda x: x["loss"]), "")
    read = every.select("conv_id", turns.alias("turns"), lost.alias("lost"), "formatted_chars")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                       F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 8 + length(role) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS n_all FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS up_to FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(up_to) FILTER (role = 'assistant' OR n = n_all) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
