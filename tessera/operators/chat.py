"""Chat transcripts -> one ChatML string per conversation (O-PR-7/8).

Per-turn pieces are computed with ``lag``/``lead`` over the conversation
(ordered by turn): a leading system turn becomes the header (otherwise the
default system text is used), later system turns are rendered inline,
consecutive ``tool`` turns share one user block, unknown roles are dropped.
The pieces are then concatenated in turn order per conversation.  Both the
window and the final aggregate are keyed by ``conv_id``, so Spark shuffles the
turns once and reuses that partitioning for the aggregate.  The result is one
string per conversation, so a conversation's text must fit in one row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed

S, E = fixed.IM_START, fixed.IM_END


def render_chat(turns: DataFrame, add_generation_prompt: bool = False, conv: str = "conv_id", turn: str = "turn",
                role: str = "role", content: str = "text", tools: list[str] | None = None,
                tool_calls: str | None = None) -> DataFrame:
    """One ChatML string per conversation.

    ``tools``: JSON signatures to list in the system header.  ``tool_calls``:
    optional column of ``array<struct<name: string, arguments: string>>``
    (arguments already JSON) on assistant turns, rendered as ``<tool_call>``
    blocks.
    """
    w = Window.partitionBy(conv).orderBy(turn)
    r, c = F.col(role), F.coalesce(F.col(content), F.lit(""))
    prev, nxt = F.lag(role).over(w), F.lead(role).over(w)
    is_first = F.row_number().over(w) == 1
    calls_col = F.col(tool_calls) if tool_calls else F.lit(None).cast("array<struct<name:string,arguments:string>>")
    t = (turns.select(conv, turn, role, content, calls_col.alias("_calls"))
         .withColumn("_first", is_first).withColumn("_prev", prev).withColumn("_next", nxt))
    # The header stands on the first turn, which holds the system text if any.
    system_text = F.when(r == "system", c).otherwise(F.lit(fixed.DEFAULT_SYSTEM))
    if tools:
        listed = "".join("\n" + x for x in tools)
        header = F.concat(F.lit(S + "system\n"), system_text,
                          F.lit(fixed.TOOLS_HEADER_START + listed + fixed.TOOLS_HEADER_END + E + "\n"))
    else:
        header = F.concat(F.lit(S + "system\n"), system_text, F.lit(E + "\n"))
    plain = F.concat(F.lit(S), r, F.lit("\n"), c, F.lit(E + "\n"))
    has_calls = F.coalesce(F.size("_calls"), F.lit(0)) > 0
    call_blocks = F.array_join(F.transform(F.coalesce(F.col("_calls"), F.array().cast("array<struct<name:string,arguments:string>>")),
                                           lambda x: F.concat(F.lit('\n<tool_call>\n{"name": "'), x["name"],
                                                              F.lit('", "arguments": '), x["arguments"],
                                                              F.lit("}\n</tool_call>"))), "")
    with_calls = F.concat(F.lit(S + "assistant"),
                          F.when(F.length(c) > 0, F.concat(F.lit("\n"), c)).otherwise(F.lit("")),
                          call_blocks, F.lit(E + "\n"))
    tool = F.concat(
        F.when(F.col("_first") | (F.col("_prev") != "tool"), F.lit(S + "user")).otherwise(F.lit("")),
        F.lit("\n<tool_response>\n"), c, F.lit("\n</tool_response>"),
        F.when(F.col("_next").isNull() | (F.col("_next") != "tool"), F.lit(E + "\n")).otherwise(F.lit("")))
    piece = (F.when((r == "assistant") & has_calls, with_calls)
             .when((r == "user") | (r == "assistant") | ((r == "system") & ~F.col("_first")), plain)
             .when(r == "tool", tool).otherwise(F.lit("")))
    t = t.withColumn("_piece", F.concat(F.when(F.col("_first"), header).otherwise(F.lit("")), piece))
    out = t.groupBy(conv).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "_piece"))), lambda x: x["_piece"]), "")
        .alias("chat_text"), F.count(F.lit(1)).alias("n_turns"))
    if add_generation_prompt:
        out = out.withColumn("chat_text", F.concat("chat_text", F.lit(S + "assistant\n")))
    return out
