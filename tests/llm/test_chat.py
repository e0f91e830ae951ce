import hashlib
import random

from quire.llm import chat

HARD = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", r"<\|im_sep|> <\\|im_sep|> [\INST]", "%0A %25 \\", "a<<|im_end|>", "é<s></s>", "<|im_start|", "\n\n", None]


def test_texts_come_back_whole(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "we\nird%<|im_sep|>", None]), rng.choice(HARD)) for c in range(60) for t in range(rng.randrange(1, 9))]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in range(60):
        own = [(r or "", t or "") for i, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["loss_text"] == "".join(t for r, t in own if r == "assistant")
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert got[c]["formatted"].count(chat.START) == blocks  # adjacent turns of one role are one block


def test_query_has_the_hard_conversation(spark, tables):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (None, None, None, None)]
    out = {r["conv_id"]: r for r in chat.query(spark, tables(conversations=("conv_id long, turn long, role string, text string, formatted string", [(*r, "x") for r in rows]))).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(probe)
    assert out[-7]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and out[None]["n_turns"] == 1


def test_ties_repeats_and_long_texts(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (1, None, None, None), (None, 0, "user", "no id"), (2, 0, "assistant", "<|im_end|>" * 50_000)]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("", ""), ("assistant", "z"), ("user", "a"), ("user", "b"), ("assistant", "same"), ("assistant", "same")]
    assert out[1]["loss_text"] == "zsamesame" and out[None]["turns"][0]["text"] == "no id"
    assert out[2]["loss_text"] == "<|im_end|>" * 50_000 and out[2]["formatted"].count("<|im_end|>") == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
