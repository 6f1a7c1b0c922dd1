r"""Chat formatting with a reversible template, by DataFrame functions only.

A conversation becomes blocks of `<turn:ROLE>` NL, texts joined by `<turn/>`, and `</turn>` NL; a block holds all
adjacent turns of one role. Inside texts `\` is written `\b`, `<turn` is `\lturn` and `</turn` is `\l/turn`, so control
strings never occur there; roles also write `>` as `\g`. Undoing reads `\l`, `\g`, then `\b`. The loss mask lists the
code-point ranges of the masked role's texts in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BREAK, CLOSE = "<turn:", "<turn/>", "</turn>\n"
BLOCK = 8192


def _put(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _put(_put(_put(text, "\\", "\\b"), "<turn", "\\lturn"), "</turn", "\\l/turn")


def unescape(text: Column) -> Column:
    return _put(_put(_put(text, "\\l", "<"), "\\g", ">"), "\\b", "\\")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _put(escape(role), ">", "\\g"), F.lit(">\n"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """(conv, formatted, loss): the text of each conversation and its loss mask, structs of start and length in code points.

    Turns are in the order of the turn column, nulls first, ties by role and text; a null role or text counts as empty,
    and repeated rows stay. Rows with a null conversation id are one conversation. An empty table gives an empty result;
    columns beside the four named ones are ignored. A conversation is one value of the result, so that its turns meet in
    one task; turns of different conversations don't.
    """
    text, role = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("one"))
    collected = rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # Where a role begins, and where the next one does: a block is the slice of turns between the two.
    role_at = lambda i: F.get("turns", i)["role"]
    firsts = collected.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1))))
    lasts = F.concat(F.slice("firsts", 2, F.size("firsts") - 1), F.array(F.size("turns")))
    bodies = lambda a, b: F.transform(F.slice("turns", a + 1, b - a), lambda x: escape(x["text"]))
    merged = firsts.select("conv", F.zip_with("firsts", lasts, lambda a, b: F.struct(role_at(a).alias("role"), bodies(a, b).alias("bodies"))).alias("blocks"))
    pieces = merged.withColumn("pieces", F.transform("blocks", lambda b: F.concat(_head(b["role"]), F.array_join(b["bodies"], BREAK), F.lit(CLOSE))))

    def spans(block: Column, at: Column) -> Column:
        begin = at + F.length(_head(block["role"]))
        offsets = running(F.transform(block["bodies"], lambda x: (F.length(x) + len(BREAK)).cast("long")))
        return F.zip_with(block["bodies"], offsets, lambda x, o: F.struct((begin + o).cast("int").alias("start"), F.length(x).alias("length")))

    starts = running(F.transform("pieces", lambda p: F.length(p).cast("long")))
    none = F.array().cast("array<struct<start:int,length:int>>")
    loss = F.flatten(F.zip_with("blocks", starts, lambda b, at: F.when(b["role"] == loss_role, spans(b, at)).otherwise(none)))
    return pieces.select("conv", F.array_join("pieces", "").alias("formatted"), loss.alias("loss"))


def _bound(value: Column, use) -> Column:
    """use(value), the value being worked out once and not for each element of an array that use() goes through."""
    return F.get(F.transform(F.array(value), use), 0)


def running(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it.

    Sums are kept for stretches of about as many elements as there are stretches, so that n elements take n times the root
    of n additions and no array grows element by element.
    """
    added = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(x: Column, side: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / side).cast("int"))), lambda i: added(F.slice(x, i * side + 1, side)))
        before = lambda y: F.transform(y, lambda _, i: added(F.slice(y, 1, i)))
        whole = lambda i: F.floor(i / side).cast("int")
        return _bound(_bound(sums, before), lambda o: F.transform(x, lambda _, i: F.get(o, whole(i)) + added(F.slice(x, whole(i) * side + 1, i % side))))

    return _bound(sizes, lambda x: _bound(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int"), lambda side: of(x, side)))


def masked_texts(formatted: Column, loss: Column) -> Column:
    """Array of the texts, unescaped, under a loss mask; the output is cut into blocks once, and a text out of these."""
    starts = F.sequence(F.lit(0), F.floor(F.length(formatted) / BLOCK).cast("int"))

    def texts(blocks: Column) -> Column:
        def text(span: Column) -> Column:
            first = F.floor(span["start"] / BLOCK).cast("int")
            last = F.floor((span["start"] + span["length"]) / BLOCK).cast("int")
            return unescape(F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), span["start"] - first * BLOCK + 1, span["length"]))

        return F.transform(loss, text)

    return _bound(F.transform(starts, lambda i: F.substring(formatted, i * BLOCK + 1, F.lit(BLOCK))), texts)


def read_chats(formatted: Column) -> Column:
    """Array of (role, text) structs, one for each turn, from a formatted conversation."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, ">\n") + 2, F.length(b)), BREAK, -1),
                lambda t: F.struct(
                    unescape(F.substring(b, F.lit(len(OPEN) + 1), F.instr(b, ">\n") - 1 - len(OPEN))).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )


PROBE = r"\### Assistant: </turn> ok"


def op10(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(
        F.explode(F.array(*(F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("r")
    ).select("r.*")
    done = format_chats(chats.unionByName(probe))
    back = done.select("conv", "formatted", "loss", read_chats(F.col("formatted")).alias("turns"))
    loss_text = F.array_join(masked_texts(F.col("formatted"), F.col("loss")), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        loss_text.alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


OP10_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, lag(role) OVER w AS earlier, row_number() OVER w AS n,
         replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '>', '\g') AS head
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN earlier = role THEN 7 WHEN n = 1 THEN 8 + length(head) ELSE 16 + length(head) END)::BIGINT + 8 AS formatted_chars
FROM sized GROUP BY conv_id
"""
