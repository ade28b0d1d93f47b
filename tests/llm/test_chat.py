import hashlib
import random

from quarryline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, pieces long"


def digests(rows):
    by: dict = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows():
    rnd = random.Random(5)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "\\", "\\\\", "<|", "<", "|", "a", "é🙂", "\n", "", "<\\|", "assistant"]
    made = []
    for conv in range(40):
        for turn in range(rnd.choice([0, 1, 2, 5, 300])):
            role = rnd.choice(["user", "assistant", "assistant", "<|im_end|>x", None, ""])
            made.append((conv, rnd.choice([turn, turn * 700]), role, rnd.choice([None, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))]), "f", 1))
    made += [(50, None, "user", "no turn", "f", 1), (50, 3, "user", "x", "f", 1), (50, 3, "user", "x", "f", 1), (None, 0, "assistant", "no conversation", "f", 1)]
    made += [(60, k, "assistant", f"<|{k}", "f", 1) for k in range(1500)]
    return made


def test_reads_back_what_it_wrote(spark):
    made = rows()
    random.Random(1).shuffle(made)
    got = chat.digests(spark.createDataFrame(made, SCHEMA)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == digests(made)


def test_template_and_mask(spark):
    made = [(1, 0, "user", "hi <|im_end|>", "f", 1), (1, 1, "assistant", "a\\", "f", 1), (1, 2, "assistant", "b", "f", 1)]
    row = chat.formatted(spark.createDataFrame(made, SCHEMA)).first()
    assert row.formatted == "<|im_start|>user<|im_sep|>hi <\\|im_end|><|im_end|><|im_start|>assistant<|im_sep|>a\\\\<|im_turn|>b<|im_end|>"
    assert [p.text for p in row.pieces if p.loss] == ["a\\\\", "b"]
    assert "".join(p.text for p in row.pieces) == row.formatted


def test_empty(spark):
    assert chat.digests(spark.createDataFrame([], SCHEMA)).count() == 0
