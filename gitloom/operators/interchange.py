"""Moving memories between stores: one JSON line per memory, and the plan to take them in."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitloom.operators.sequence import SEQ, ordered
from gitloom.session import materialise

FORMAT_VERSION = "1"
# The order fields are compared and named in.
COMPARED = [
    ("statement", ["statement"]),
    ("author", ["author_name", "author_email"]),
    ("admitted_at", ["admitted_at"]),
    ("subject", ["subject_kind", "subject_path", "subject_qualname", "subject_commit_sha"]),
    ("since", ["since_commit_sha", "since_date"]),
    ("state", ["state"]),
    ("ended_at", ["ended_at"]),
    ("end_reason", ["end_reason"]),
    ("superseded_by", ["superseded_by"]),
    ("citations", ["citations"]),
]


def text(value: Column) -> Column:
    """A value as a JSON string, or null."""
    quoted = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    return F.when(value.isNull(), "null").otherwise(quoted)


def obj(**fields: Column) -> Column:
    parts = []
    for i, (key, value) in enumerate(fields.items()):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{key}": '), value]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def with_citations(memories: DataFrame, citations: DataFrame) -> DataFrame:
    """Adds ``citations``, an array in position order. One memory's citations are
    one document's content, which the writer has to hold as a line anyway."""
    listed = citations.groupBy("memory_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("position", "kind", "ref"))),
            lambda c: F.struct(c["kind"].alias("kind"), c["ref"].alias("ref")),
        ).alias("citations")
    )
    empty = F.array().cast("array<struct<kind:string,ref:string>>")
    return memories.join(listed, "memory_id", "left").withColumn(
        "citations", F.coalesce("citations", empty)
    )


def memory_lines(memories: DataFrame) -> DataFrame:
    """(memory_id, line) for rows that carry ``citations``; write them by memory_id."""
    author = F.when(
        F.col("author_name").isNull() & F.col("author_email").isNull(), F.lit("null")
    ).otherwise(obj(name=text(F.col("author_name")), email=text(F.col("author_email"))))
    kind = F.col("subject_kind")
    subject = (
        F.when(
            kind == "definition",
            obj(kind=text(kind), path=text(F.col("subject_path")), qualname=text(F.col("subject_qualname"))),
        )
        .when(kind == "commit", obj(kind=text(kind), commit=text(F.col("subject_commit_sha"))))
        .when(kind == "path", obj(kind=text(kind), path=text(F.col("subject_path"))))
        .otherwise(obj(kind=text(kind)))
    )
    since = (
        F.when(F.col("since_commit_sha").isNotNull(), obj(commit=text(F.col("since_commit_sha"))))
        .when(F.col("since_date").isNotNull(), obj(date=text(F.col("since_date"))))
        .otherwise("null")
    )
    cited = F.transform("citations", lambda c: obj(kind=text(c["kind"]), ref=text(c["ref"])))
    line = obj(
        memory_id=text(F.col("memory_id")),
        repository=text(F.col("repository_path")),
        statement=text(F.col("statement")),
        author=author,
        admitted_at=text(F.col("admitted_at")),
        state=text(F.col("state")),
        subject=subject,
        since=since,
        ended_at=text(F.col("ended_at")),
        end_reason=text(F.col("end_reason")),
        superseded_by=text(F.col("superseded_by")),
        citations=F.concat(F.lit("["), F.array_join(cited, ", "), F.lit("]")),
    )
    return memories.select("memory_id", line.alias("line"))


def import_plan(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(memory_id, decision, difference): insert, skip, or conflict in the first field that differs."""
    columns = sorted({c for _, group in COMPARED for c in group if c in incoming.columns})
    here = stored.select("memory_id", F.lit(True).alias("_here"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    difference = F.lit(None).cast("string")
    for name, group in reversed(COMPARED):
        held = [c for c in group if c in columns]
        if held:
            same = F.lit(True)
            for c in held:
                same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
            difference = F.when(~same, name).otherwise(difference)
    return (
        incoming.join(here, "memory_id", "left")
        .withColumn("difference", F.when(F.col("_here"), difference))
        .select(
            "memory_id",
            F.when(F.col("_here").isNull(), "insert")
            .when(F.col("difference").isNull(), "skip")
            .otherwise("conflict")
            .alias("decision"),
            "difference",
        )
    )


def dangling_successors(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    known = incoming.select("memory_id").unionByName(stored.select("memory_id")).distinct()
    return (
        incoming.where("superseded_by is not null")
        .select("memory_id", "superseded_by")
        .join(known.withColumnRenamed("memory_id", "superseded_by"), "superseded_by", "left_anti")
    )


def never_ending_chains(links: DataFrame) -> DataFrame:
    """Rows (memory_id, superseded_by) whose successors close on themselves.

    The distance covered doubles each round; a chain that has not ended after as
    many steps as there are links does not end.
    """
    reach = materialise(
        links.where("superseded_by is not null").select(
            F.col("memory_id").alias("child"), F.col("superseded_by").alias("parent")
        ),
        "chains",
    )
    rounds = math.ceil(math.log2(max(reach.count(), 1))) + 1
    for _ in range(rounds):
        above = reach.select(F.col("child").alias("parent"), F.col("parent").alias("_up"))
        reach = materialise(
            reach.join(above, "parent").select("child", F.col("_up").alias("parent")), "chains"
        )
        if reach.limit(1).count() == 0:
            break
    return reach.select(F.col("child").alias("memory_id"))


# ------------------------------------------------------------------ reading a file

# The keys of the two kinds of line.
VERSION_KEY = "memory_export_version"
HEADER_KEYS = [VERSION_KEY, "repository", "count", "exported_at"]
ROW_KEYS = [
    "memory_id", "repository", "statement", "author", "admitted_at", "state", "subject", "since", "ended_at",
    "end_reason", "superseded_by", "citations",
]
ROW = (
    "struct<memory_id:string,repository:string,statement:string,author:struct<name:string,email:string>,"
    "admitted_at:string,state:string,subject:struct<kind:string,path:string,qualname:string,commit:string>,"
    "since:struct<commit:string,date:string>,ended_at:string,end_reason:string,superseded_by:string,"
    "citations:array<struct<kind:string,ref:string>>>"
)
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MOMENT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{6})?[+-]\d\d:\d\d$"
DAY = r"^\d{4}-\d\d-\d\d$"


def header_line(repository: str, count: int, exported_at: str) -> str:
    import json

    fields = (FORMAT_VERSION, repository, count, exported_at)
    return json.dumps(dict(zip(HEADER_KEYS, fields)), ensure_ascii=False)


def read_document(spark, path: str) -> DataFrame:
    """(line_no, line, keys, row, is_header): the lines, numbered from 1 as they stand in the file.

    A file is read in blocks; file, block and the place inside it give the order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("line"),
    )
    numbered = ordered(lines, ["_file", "_block", "_place"]).frame
    return materialise(document_of(numbered.select(F.col(SEQ).alias("line_no"), "line")), "document")


def document_of(lines: DataFrame) -> DataFrame:
    """(line_no, line) read as a document."""
    keys = F.json_object_keys("line")
    read = lines.select("line_no", "line", keys.alias("keys"), F.from_json("line", ROW).alias("row"))
    held = F.coalesce("keys", F.array().cast("array<string>"))
    return read.withColumn("is_header", F.array_contains(held, VERSION_KEY))


def header_of(document: DataFrame) -> dict:
    import json

    return json.loads(document.where("is_header").orderBy("line_no").first()["line"])


def _strange(part: str, known: tuple[str, ...]) -> Column:
    """Does the object under that key have a key of its own making?"""
    held = F.from_json(F.get_json_object("line", f"$.{part}"), "map<string,string>")
    return F.size(F.array_except(F.map_keys(held), F.array(*map(F.lit, known)))) > 0


def _moment(text: Column) -> Column:
    return F.coalesce(text.rlike(MOMENT) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def _line_rules(repository: str) -> list[tuple[str, Column]]:
    """(what is wrong, the test that finds it), in the order they are named."""
    row = F.col("row")
    strangers = F.size(F.array_except("keys", F.array(*map(F.lit, ROW_KEYS))))
    missing = F.size(F.array_except(F.array(*map(F.lit, ROW_KEYS)), "keys"))
    state, kind, subject = row["state"], row["subject"]["kind"], row["subject"]
    no = lambda c: c.isNull()
    real_day = F.date_format(F.try_to_date(row["since"]["date"], "yyyy-MM-dd"), "yyyy-MM-dd") == row["since"]["date"]
    cites = row["citations"]
    pairs = F.transform(cites, lambda c: F.concat_ws("\0", c["kind"], c["ref"]))
    kinds = ("commit", "file", "definition", "range", "cochange", "absence")
    own = F.from_json(F.get_json_object("line", "$.citations"), "array<map<string,string>>")
    odd_citation = F.exists(own, lambda c: F.size(F.array_except(F.map_keys(c), F.array(F.lit("kind"), F.lit("ref")))) > 0)
    too_much = (
        (subject["path"].isNotNull() & ~kind.isin("path", "definition"))
        | (subject["qualname"].isNotNull() & (kind != "definition"))
        | (subject["commit"].isNotNull() & (kind != "commit"))
    )
    return [
        ("the line is blank or not a JSON object", no(F.col("keys"))),
        ("the line has a key the format does not have", strangers > 0),
        ("the line lacks a key", missing > 0),
        ("the line does not read as a memory", no(row)),
        ("a key inside the author is unknown", _strange("author", ("name", "email"))),
        ("a key inside the subject is unknown", _strange("subject", ("kind", "path", "qualname", "commit"))),
        ("a key inside since is unknown", _strange("since", ("commit", "date"))),
        ("a key inside a citation is unknown", odd_citation),
        ("the row is about another repository", row["repository"] != repository),
        ("the id is not a canonical uuid", ~row["memory_id"].rlike(UUID)),
        ("the statement is empty or over 4000 characters", ~F.length(F.trim(row["statement"])).between(1, 4000)),
        ("the moment has no offset or is not one", ~_moment(row["admitted_at"])),
        ("the state is unknown", ~state.isin("active", "superseded", "invalidated")),
        ("the subject is unknown", ~kind.isin("repository", "path", "definition", "commit")),
        ("the subject has no path", kind.isin("path", "definition") & no(row["subject"]["path"])),
        ("the subject has no name", (kind == "definition") & no(row["subject"]["qualname"])),
        ("the subject has no commit", (kind == "commit") & no(row["subject"]["commit"])),
        ("a subject holds what its kind does not", too_much),
        ("two kinds of since", row["since"]["commit"].isNotNull() & row["since"]["date"].isNotNull()),
        ("since is not a day", row["since"]["date"].isNotNull() & (~row["since"]["date"].rlike(DAY) | ~F.coalesce(real_day, F.lit(False)))),
        ("an ended memory says when, an active one does not", (state == "active") != no(row["ended_at"])),
        ("the end is not a moment", row["ended_at"].isNotNull() & ~_moment(row["ended_at"])),
        ("a superseded memory names its successor, another does not", (state == "superseded") != row["superseded_by"].isNotNull()),
        ("an invalidated memory gives its reason, another does not", (state == "invalidated") != row["end_reason"].isNotNull()),
        ("a citation kind is unknown", F.exists(cites, lambda c: ~c["kind"].isin(*kinds) | no(c["ref"]))),
        ("a citation is given twice", F.size(F.array_distinct(pairs)) != F.size(pairs)),
    ]


def line_violations(document: DataFrame, repository: str) -> DataFrame:
    """(line_no, rule): the first rule each line breaks; lines that break none are left out."""
    rule = F.lit(None).cast("string")
    for name, test in reversed(_line_rules(repository)):
        rule = F.when(F.coalesce(test, F.lit(True)) if name.startswith("the ") else F.coalesce(test, F.lit(False)), name).otherwise(rule)
    return document.where(~F.col("is_header")).select("line_no", rule.alias("rule")).where("rule is not null")


def first_violation(document: DataFrame):
    """The first line that breaks a rule, or None. One bad line refuses the file."""
    counts = document.agg(
        F.count(F.when(F.col("is_header"), 1)).alias("headers"),
        F.count(F.when(~F.col("is_header"), 1)).alias("rows"),
        F.min("line_no").alias("first"),
        F.min(F.when(F.col("is_header"), F.col("line_no"))).alias("header"),
    ).first()
    if counts["headers"] != 1:
        return {"line_no": 0, "rule": "the file has no header, or more than one"}
    if counts["header"] != counts["first"]:
        return {"line_no": counts["header"], "rule": "the header is not the first line"}
    header = header_of(document)
    if set(header) != set(HEADER_KEYS):
        return {"line_no": counts["first"], "rule": "the header's keys are not those of the format"}
    if header[VERSION_KEY] != FORMAT_VERSION:
        return {"line_no": counts["first"], "rule": "the format's version is another"}
    found = line_violations(document, header["repository"]).orderBy("line_no").first()
    if found:
        return found
    if header["count"] != counts["rows"]:
        return {"line_no": 0, "rule": "the header counts other than the lines there are"}
    twice = (
        document.where(~F.col("is_header"))
        .groupBy("row.memory_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("line_no"))
        .where("n > 1")
        .orderBy("line_no")
        .first()
    )
    return {"line_no": twice["line_no"], "rule": "the id is there twice"} if twice else None


def memory_rows(document: DataFrame) -> DataFrame:
    """The document's memories as rows of the store, with their ``citations``."""
    row = F.col("row")
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(c))
    return document.where(~F.col("is_header")).select(
        row["memory_id"].alias("memory_id"),
        row["statement"].alias("statement"),
        row["author"]["name"].alias("author_name"),
        row["author"]["email"].alias("author_email"),
        row["admitted_at"].alias("admitted_at"),
        seconds(row["admitted_at"]).alias("admitted_epoch"),
        row["subject"]["kind"].alias("subject_kind"),
        row["subject"]["path"].alias("subject_path"),
        row["subject"]["qualname"].alias("subject_qualname"),
        row["subject"]["commit"].alias("subject_commit_sha"),
        row["since"]["commit"].alias("since_commit_sha"),
        row["since"]["date"].alias("since_date"),
        row["state"].alias("state"),
        row["ended_at"].alias("ended_at"),
        seconds(row["ended_at"]).alias("ended_epoch"),
        row["end_reason"].alias("end_reason"),
        row["superseded_by"].alias("superseded_by"),
        row["citations"].alias("citations"),
    )
