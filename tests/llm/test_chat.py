import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from costweave.llm import chat

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double"


def tree_rows():
    return [
        (1, 1, None, "system", "rules", 0.0), (1, 2, 1, "user", "hi [INST] </s>", 1.0), (1, 3, 2, "assistant", "a\\b [\\INST] <s>", 5.0), (1, 4, 2, "assistant", "worse", 1.0),
        (1, 5, 4, "user", None, 9.0), (1, 6, 5, "tool\n[TEXT]", "42", None), (2, 1, 77, None, "orphan", 0.0), (2, 2, 1, "assistant", "", 0.0),
    ]


def test_branches_are_ranked_and_read_back(spark):
    out = chat.format_reply_trees(spark.createDataFrame(tree_rows(), MESSAGES), n_branches=2).collect()
    got = {(r.conv_id, r.branch): r for r in out}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    assert got[1, 1].branch_score == 11.0 and got[1, 1].leaf_id == 6 and got[1, 2].leaf_id == 3
    assert chat.parse_conversation(got[1, 2].formatted) == [("system", "rules"), ("user", "hi [INST] </s>"), ("assistant", "a\\b [\\INST] <s>")]
    assert chat.parse_conversation(got[1, 1].formatted) == [("system", "rules"), ("user", "hi [INST] </s>"), ("assistant", "worse"), ("user", ""), ("tool\n[TEXT]", "42")]
    assert chat.parse_conversation(got[2, 1].formatted) == [("", "orphan"), ("assistant", "")]
    spans = got[1, 2].loss_spans
    assert [chat.unescaped(got[1, 2].formatted[s.start : s.end]) for s in spans] == ["a\\b [\\INST] <s>"]


def test_deep_chain_cycles_and_repeats(spark):
    deep = spark.createDataFrame([(3, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"t{i}", 1.0) for i in range(70)], MESSAGES)
    row = chat.format_reply_trees(deep).first()
    assert [t for _, t in chat.parse_conversation(row.formatted)] == [f"t{i}" for i in range(70)] and row.branch_score == 70.0
    with pytest.raises(ValueError, match="repeats"):
        chat.branches(deep.union(deep))
    cycle = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], MESSAGES)
    with pytest.raises(ValueError, match="cycle"):
        chat.branches(cycle, max_rounds=6)
    assert chat.format_reply_trees(deep.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>/s[]INST\\ ROLEYX|é𝄞\n", max_size=25), min_size=1, max_size=6))
def test_any_text_comes_back(spark, texts):
    roles = ["user", "assistant", "system", "tool"]
    rows = [(1, i, roles[i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_reply_trees(chat.turn_chain(df))).first()
    import hashlib

    assert r.turns_sha256 == hashlib.sha256("".join(f"{roles[i % 4]}\n{t}\n" for i, t in enumerate(texts)).encode()).hexdigest()
    said = "".join(t for i, t in enumerate(texts) if i % 4 == 1)
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_turn_chain_orders_ties(spark):
    df = spark.createDataFrame([(1, None, "user", "z"), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a")], "conv_id long, turn long, role string, text string")
    got = [r.text for r in chat.turn_chain(df).orderBy("msg_id").collect()]
    assert got == ["z", "a", "a", "b"] and chat.turn_chain(df).where(F.col("parent_id").isNull()).count() == 1
