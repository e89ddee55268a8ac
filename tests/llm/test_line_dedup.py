import random

from gitloom.llm import line_dedup
from tests.llm.cases import docs, odd_rows, sentence, widened


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(rows, min_chars=16):
    """(id, text) -> what stays: a line goes if an earlier one is equal or, both being long, within one edit."""
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    told = []
    for known, key, text in order:
        for no, line in enumerate(text.split("\n")):
            if line.strip(" \t\n\r\x0b\x0c"):
                told.append(((known, key), no, line, text))
    gone = {}
    for i, (key, no, line, text) in enumerate(told):
        before = [other for *_, other, _ in told[:i]]
        if line in before or any(
            min(len(other), len(line)) >= min_chars and distance_at_most_one(other, line) for other in before
        ):
            gone.setdefault((key, text), set()).add(no)
    kept = {}
    for known, key, text in order:
        out = gone.get(((known, key), text), set())
        kept[(key if known else None, text)] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)
    return kept


def compare(spark, rows):
    found = line_dedup.deduplicated(widened(docs(spark, rows))).collect()
    assert len(found) == len(rows)
    want = plain(rows)
    for r in found:
        text = r["_row"]["text"]
        assert r["text"] == (None if text is None else want[(r["_row"]["doc_id"], text)])


def edited(line, rng):
    at, kind = rng.randrange(len(line)), rng.randrange(3)
    other = rng.choice("abcXYZ 9ß漢")
    return line[:at] + (other if kind < 2 else "") + line[at + (kind > 0) :]


def test_random_edits(spark):
    rng = random.Random(8)
    base = [sentence(s, rng.choice((3, 5, 9, 40, 120))) for s in range(12)]
    made = []
    for i in range(60):
        lines = [rng.choice(base) for _ in range(3)]
        lines = [edited(x, rng) if rng.random() < 0.5 else x for x in lines]
        lines = [edited(x, rng) if rng.random() < 0.3 else x for x in lines]
        made.append((i, "\n".join(lines), "en", "a", 1))
    compare(spark, made)


def test_odd_rows(spark):
    compare(spark, odd_rows())


def test_one_long_line_and_many_lines_of_one_frame(spark):
    """A frame with a number in it: thousands of lines share a key, neighbours differ by one edit."""
    long = sentence(1, 4000)
    rows = [(i, f"the number of this page is {i * 7:05d} of the whole book", "en", "a", 1) for i in range(300)]
    rows += [(1000, long, "en", "a", 1), (1001, long[:9000] + "Q" + long[9001:], "en", "a", 1)]
    compare(spark, rows)


def test_exact_only(spark):
    rows = [(1, "a line that is long enough", "", "", 0), (2, "a line that is long enouhh\na line that is long enough", "", "", 0)]
    found = line_dedup.deduplicated(docs(spark, rows), line_dedup.Rule(near=False)).collect()
    assert {r["_row"]["doc_id"]: r["text"] for r in found} == {1: rows[0][1], 2: "a line that is long enouhh"}


def test_every_line_with_a_word(spark):
    """Short lines go where they are equal to an earlier one; one edit is for the longer ones."""
    rows = [
        (1, "Les.\nfifteen letters\nsixteen letters.\n \n漢", "", "", 0),
        (2, "Les.\nLez.\nfifteen letterz\nsixteen letterz.\n\n \n漢\nLes.", "", "", 0),
        (None, "Lez.\nnew", "", "", 0),
    ]
    found = line_dedup.deduplicated(docs(spark, rows), line_dedup.Rule()).collect()
    got = {r["_row"]["doc_id"]: (r["text"], r["n_removed"], r["n_near"]) for r in found}
    assert got == {1: (rows[0][1], 0, 0), 2: ("fifteen letterz\n\n ", 5, 1), None: (rows[2][1], 0, 0)}


def test_a_document_of_very_many_lines(spark):
    many = "\n".join(f"{i % 3} is a line" for i in range(60_000)) + "\nend"
    found = line_dedup.deduplicated(docs(spark, [(1, many, "", "", 0)])).first()
    assert (found["n_removed"], found["text"]) == (59_997, "0 is a line\n1 is a line\n2 is a line\nend")


def test_empty_table(spark):
    assert line_dedup.deduplicated(docs(spark, [])).count() == 0


def test_lines_are_hashed_once(spark, monkeypatch):
    """What is read twice, with different columns, is a table: only that one is built from the documents' lines."""
    built, write = {}, line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda frame, name: built.setdefault(name, frame) and write(frame, name))
    rows = docs(spark, [(1, sentence(1, 30), "en", "a", 1), (2, sentence(1, 30) + "x", "en", "a", 1)])
    line_dedup.removed_lines(rows).count()
    told = built["line-keys"]._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(" not in told
    assert "posexplode(split(" in built["line-hashes"]._jdf.queryExecution().optimizedPlan().toString()
