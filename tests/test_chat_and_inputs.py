from pyspark.sql import functions as F

from tessera import fixed
from tessera.operators import model_inputs as mi
from tessera.operators.chat import render_chat

S, E = fixed.IM_START, fixed.IM_END


def test_chat_tool_runs(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "tool", "T1"), (1, 3, "tool", "T2"),
            (1, 4, "assistant", "A"), (1, 5, "weird", "W"), (1, 6, "system", "S2"), (2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["chat_text"] for r in render_chat(df).collect()}
    assert out[1] == (f"{S}system\nS{E}\n{S}user\nU{E}\n{S}user\n<tool_response>\nT1\n</tool_response>"
                      f"\n<tool_response>\nT2\n</tool_response>{E}\n{S}assistant\nA{E}\n{S}system\nS2{E}\n")
    assert out[2] == f"{S}system\n{fixed.DEFAULT_SYSTEM}{E}\n{S}user\nhi{E}\n"
    gen = {r["conv_id"]: r["chat_text"] for r in render_chat(df, add_generation_prompt=True).collect()}
    assert gen[2].endswith(f"{S}assistant\n")


def test_windows_mask_and_pad(spark):
    df = spark.createDataFrame([(0, list(range(1, 6)), 2), (1, list(range(1, 4)), 9), (2, list(range(600)), 10)],
                               "doc_id long, ids array<int>, input_len int")
    every = mi.token_windows(df)
    second = every.filter("window_idx = 1").collect()
    assert [r["input_ids"] for r in second] == [list(range(512, 600))] and second[0]["labels"] == list(range(512, 600))
    audit = mi.mask_audit(every).collect()[0]
    assert (audit["n_rows"], audit["n_windows"], audit["n_tokens"], audit["n_truncated"]) == (3, 4, 608, 1)
    late = mi.token_windows(spark.createDataFrame([(0, list(range(1100)), 600), (1, [], 0)], df.schema)).collect()
    assert [sum(x == -100 for x in r["labels"]) for r in late if r["doc_id"] == 0] == [512, 88, 0]
    assert [r["input_ids"] for r in late if r["doc_id"] == 1] == [[]]
    m = every.filter("window_idx = 0")
    rows = {r["doc_id"]: r for r in m.collect()}
    assert rows[0]["labels"] == [-100, -100, 3, 4, 5]
    assert rows[1]["labels"] == [-100, -100, -100]
    assert len(rows[2]["input_ids"]) == 512 and rows[2]["labels"][:10] == [-100] * 10
    p = mi.pad_batches(m.withColumn("b", F.lit(0)), "b")
    prow = {r["doc_id"]: r for r in p.collect()}
    assert prow[0]["padded_len"] == 512 and prow[0]["padded_ids"][5:7] == [fixed.PAD_TOKEN_ID] * 2
    assert prow[0]["padded_mask"][4:6] == [1, 0] and prow[0]["padded_labels"][-1] == -100
    small = mi.pad_batches(m.filter("doc_id < 2").withColumn("b", F.lit(0)), "b").collect()
    assert all(r["padded_len"] == 8 for r in small)


def test_chat_tool_calls_and_tools_header(spark):
    rows = [(1, 0, "user", "q", None), (1, 1, "assistant", "", [("run_sql", '{"query": "SELECT 1"}')]),
            (1, 2, "tool", "1", None), (1, 3, "assistant", "one", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, "
                                     "calls array<struct<name:string,arguments:string>>")
    out = render_chat(df, tools=['{"name": "run_sql"}'], tool_calls="calls").collect()[0]["chat_text"]
    assert out.startswith(f"{S}system\n{fixed.DEFAULT_SYSTEM}{fixed.TOOLS_HEADER_START}\n" + '{"name": "run_sql"}')
    assert (f"{S}assistant\n<tool_call>\n" + '{"name": "run_sql", "arguments": {"query": "SELECT 1"}}' + f"\n</tool_call>{E}\n") in out
    assert out.endswith(f"{S}user\n<tool_response>\n1\n</tool_response>{E}\n{S}assistant\none{E}\n")
