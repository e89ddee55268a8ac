"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_SHA = 8
DIFF_CHARACTERS = 4000

# Fixed value: every character that ends a line of text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"

HUNK = r"(?md)^@@ -\d+(?:,\d+)? \+(\d+(?:,\d+)?) @@"
CITATION = r"\[([A-Za-z][A-Za-z0-9_-]*)\]"
RANGE_REF = r"^(.+):(\d+)-(\d+)$"


def first_line(text: Column) -> Column:
    return F.split(text, LINE_BREAK, 2)[0]


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, SHORT_SHA)


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def trimmed_or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def bounded(text: Column, limit: int = DIFF_CHARACTERS) -> Column:
    """The text, cut at the ceiling, with what it was cut from."""
    whole = F.length(text)
    return F.struct(
        F.substring(text, 1, limit).alias("text"),
        F.least(whole, F.lit(limit)).alias("characters"),
        whole.alias("characters_total"),
        (whole > limit).alias("truncated"),
    )


def ordinal_word(number: Column) -> Column:
    hundreds, tens = F.pmod(number, F.lit(100)), F.pmod(number, F.lit(10))
    suffix = (
        F.when(hundreds.between(10, 20), "th")
        .when(tens == 1, "st")
        .when(tens == 2, "nd")
        .when(tens == 3, "rd")
        .otherwise("th")
    )
    return F.concat(number.cast("string"), suffix)


def enclosing_scope(qualname: Column) -> Column:
    """The scope a qualified name sits in; a local function sits in its function."""
    local = F.instr(qualname, ".<locals>.")
    dotted = F.regexp_extract(qualname, r"(?s)^(.*)\.[^.]*$", 1)
    return F.when(local > 0, F.substring(qualname, F.lit(1), local - 1)).otherwise(dotted)


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def citation_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), 1)


def unfenced(text: Column) -> Column:
    """A model answer without the code fence around it."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```[A-Za-z]*\s*\n(.*?)\n?```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))


def hex_prefix(ref: Column) -> Column:
    return F.lower(F.regexp_replace(ref, "[^0-9a-fA-F]", ""))


# ------------------------------------------------------------------ patch text


def file_sections(patch: Column) -> Column:
    """A patch as an array with one element per file."""
    parts = F.split(patch, r"(?<=\n)(?=diff --git )")
    return F.filter(parts, lambda s: F.trim(s) != "")


def _header(section: Column) -> Column:
    """The lines before the first hunk: a body line can imitate a header line."""
    # A search for plain bytes: a section that begins with a hunk has no header.
    return F.substr(F.substring_index(F.concat(F.lit("\n"), section), "\n@@ ", 1), F.lit(2))


def unquoted(value: Column) -> Column:
    """Undo git's quoting of a path; octal escapes stand for bytes, not characters."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)(\\[0-7]{3}|\\.|[^\\])"), 1)
    # git's single-letter escapes and their bytes.
    letters = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}
    table = F.create_map(*[F.lit(v) for pair in letters.items() for v in pair])

    def as_hex(piece: Column) -> Column:
        tail = F.substring(piece, 2, 3)
        plain = F.hex(F.encode(piece, "UTF-8"))
        return (
            F.when(piece.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(tail, 8, 16), 2, "0"))
            .when(piece.startswith("\\"), F.coalesce(table[tail], F.hex(F.encode(tail, "UTF-8"))))
            .otherwise(plain)
        )

    raw = F.decode(F.unhex(F.array_join(F.transform(pieces, as_hex), "")), "UTF-8")
    quoted = value.startswith('"') & value.endswith('"') & (F.length(value) > 1)
    return F.when(quoted, raw).otherwise(value)


def _named(header: Column, mark: str, side: str) -> Column:
    line = F.regexp_extract(header, rf"(?md)^{mark} (.*?)\t*$", 1)
    path = unquoted(line)
    cut = F.when(path.startswith(side), F.substring(path, F.lit(3), F.length(path))).otherwise(path)
    return F.when((line != "") & (line != "/dev/null"), cut)


def section_path(section: Column) -> Column:
    """The name a patch section goes under: the new side, else the rename, else the old."""
    header = _header(section)
    renamed = F.regexp_extract(header, r"(?md)^rename to (.*?)\t*$", 1)
    return F.coalesce(
        _named(header, r"\+\+\+", "b/"),
        F.when(renamed != "", unquoted(renamed)),
        _named(header, "---", "a/"),
    )


def is_binary_section(section: Column) -> Column:
    return _header(section).rlike(r"(?md)^(Binary files .* differ|GIT binary patch)$")


def new_side_path(section: Column) -> Column:
    """The name the section's ranges go under; NULL where the file is gone."""
    header = _header(section)
    renamed = F.regexp_extract(header, r"(?md)^rename to (.*?)\t*$", 1)
    return F.coalesce(_named(header, r"\+\+\+", "b/"), F.when(renamed != "", unquoted(renamed)))


def new_side_ranges(section: Column) -> Column:
    """array<struct<start,end>> of the lines each hunk leaves behind."""

    def placed(hunk: Column) -> Column:
        start, count = hunk_span(hunk)
        return F.struct(start.alias("start"), (start + count - 1).alias("end"), count.alias("count"))

    kept = F.filter(F.transform(new_side_hunks(section), placed), lambda h: h["count"] > 0)
    return F.transform(kept, lambda h: F.struct(h["start"], h["end"]))


def new_side_hunks(section: Column) -> Column:
    """The new side of each hunk head: ``start`` or ``start,count``."""
    return F.regexp_extract_all(section, F.lit(HUNK), 1)


def hunk_span(hunk: Column) -> tuple[Column, Column]:
    """First line and number of lines of a hunk's new side; one line where no number is given."""
    comma = F.instr(hunk, ",")
    count = F.when(comma == 0, 1).otherwise(F.substring_index(hunk, ",", -1).cast("int"))
    return F.substring_index(hunk, ",", 1).cast("int"), count
