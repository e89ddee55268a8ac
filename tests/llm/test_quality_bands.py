import collections
import random
import string

from gitloom.llm import quality_bands
from tests.llm.cases import WORDS, docs, odd_rows, widened, words


def plain(text):
    got = words(text)
    windows = list(zip(got, got[1:], got[2:]))
    many = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return (
        len(got),
        sum(map(len, got)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_match_plain_counting(spark):
    found = quality_bands.measured(widened(docs(spark))).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        want = plain(row["_row"]["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want
        assert row["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row["kept"] and row["base_failed"])


def test_bands_reject_what_is_too_regular_or_too_random(spark):
    random.seed(4)
    noise = " ".join("".join(random.choices(string.ascii_letters + string.digits, k=40)) for _ in range(200))
    same = "\n".join(f"item {i % 3} of the list is here again and again" for i in range(400))
    endings = [a + b for a in ("", "ing", "ed", "ly", "er") for b in ("", "s", ".", ",")]
    prose = " ".join(random.choice(WORDS) + random.choice(endings) for _ in range(600))
    half = prose + "\n" + same
    frame = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate((noise, same, prose, half))])
    verdict = {r["_row"]["doc_id"]: r["kept"] for r in quality_bands.measured(frame).collect()}
    assert verdict == {0: False, 1: False, 2: True, 3: False}
    assert [r["doc_id"] for r in quality_bands.kept(frame).collect()] == [2]
    assert quality_bands.kept(widened(frame)).columns == widened(frame).columns


def test_a_short_rest_is_judged(spark):
    """2,048 bytes of prose and a repetitive rest: the rest alone is over the share that may be bad."""
    endings = [a + b for a in ("", "ing", "ed", "ly", "er") for b in ("", "s", ".", ",")]
    random.seed(6)
    prose = " ".join(random.choice(WORDS) + random.choice(endings) for _ in range(600))[:2048]
    rests = {1: "one more time " * 73, 2: "one more time " * 20, 3: "one more time " * 5, 4: ""}
    frame = docs(spark, [(i, prose + r, "en", "a", 1) for i, r in rests.items()])
    found = {r["_row"]["doc_id"]: r for r in quality_bands.measured(frame).collect()}
    assert {i: r["bad_chunk_bytes"] for i, r in found.items()} == {1: 1022, 2: 280, 3: 0, 4: 0}
    assert all(r["chunk_bytes"] == r["n_bytes"] for r in found.values())
    assert not found[1]["kept"] and found[4]["kept"]


def test_empty_table(spark):
    assert quality_bands.measured(docs(spark, [])).count() == 0


def test_window_words():
    assert quality_bands.repeat_words([]) == 0
    assert quality_bands.repeat_words([b"a"] * 5) == 5
    assert quality_bands.repeat_words(b"a b c d a b c".split()) == 6
