import random

from gitloom.llm import chat
from tests.llm.cases import widened

KIND = "conv_id long, turn long, role string, text string"


def plain(rows, per_row):
    """(conversation, speaker, part) -> (text, the speaker's own messages)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, s or "unknown", x or "") for c, t, s, x in rows if c == conv]
        own.sort(key=lambda m: ((m[0] is not None, m[0] or 0), m[1], m[2]))
        for speaker in {s for _, s, _ in own if s != "system"}:
            for start in range(0, len(own), per_row):
                text, mine = "", []
                for _, who, said in own[start : start + per_row]:
                    text += {"system": "<|system|>", speaker: "<|assistant|>"}.get(who, f"<|user|>{who}: ")
                    body = said + "<|end|>\n"
                    if who == speaker:
                        mine.append((len(text), len(body)))
                    text += body
                found[(conv, speaker, start // per_row)] = (text, mine)
    return found


def compare(spark, rows, per_row=64):
    made = widened(spark.createDataFrame(rows, KIND))
    got = {
        (r["conv_id"], r["speaker"], r["part"]): (r["text"], [(s["start"], s["length"]) for s in r["spans"]])
        for r in chat.rotated(made, turns_per_row=per_row).collect()
    }
    assert got == plain(rows, per_row)


def test_every_speaker_gets_a_rendering(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(30):
        names = ["system", *rng.sample(["ann", "bo", "user", "assistant", "Zoë"], rng.randrange(1, 5))]
        rows += [(conv, t, rng.choice(names), f"says {t} " * rng.randrange(4)) for t in range(rng.randrange(1, 12))]
    compare(spark, rows)


def test_odd_turns_and_a_long_conversation(spark):
    rows = [(None, 1, "a", "x"), (None, 1, None, None), (1, None, "a", ""), (1, 2, "b", "y"), (1, 2, "b", "y"), (2, 1, "system", "only")]
    rows += [(9, t, ("ann", "bo")[t % 3 % 2], f"turn {t}") for t in range(150)]
    rows += [(9, 7, "bo", "漢字 \n line"), (3, 1, "a", "long " * 20000)]
    compare(spark, rows, per_row=10)


def test_empty_table(spark):
    assert chat.rotated(spark.createDataFrame([], KIND)).count() == 0
