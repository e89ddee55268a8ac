"""The store of statements: acts are appended, and a memory is its newest row."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gitloom import schemas
from gitloom.operators import interchange as ix
from gitloom.operators import memory as m
from gitloom.session import materialise
from gitloom.sources.store import Store

ENDED_STAYS = "this memory is over and cannot change; make a new one"


class MemoryError_(RuntimeError):
    """An act or a lookup that was refused."""


class MemoryBook:
    """The statements about one repository.

    *unheld* takes acts and their citations and gives (memory_id, refusal) for those that
    point at something the evidence does not hold; without it only their form is checked.
    """

    def __init__(
        self, spark: SparkSession, store: Store, repository: str,
        unheld: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    ):
        self.spark, self.store, self.repository, self.unheld = spark, store, repository, unheld

    def read(self) -> DataFrame:
        rows = self.store.read("memories")
        held = [c for c in rows.columns if c != "memory_id"]
        newest = rows.groupBy("memory_id").agg(F.max_by(F.struct(*held), "act_no").alias("_m"))
        return newest.select("memory_id", "_m.*")

    def citations(self) -> DataFrame:
        return self.store.read("memory_citations")

    def find(self, prefix: str):
        """The one memory whose id starts with *prefix*."""
        wanted = prefix.lower()
        if not wanted or set(wanted) - set("0123456789abcdef-"):
            raise MemoryError_(f"{prefix!r} is not a memory id")
        found = self.read().where(F.col("memory_id").startswith(wanted)).orderBy("memory_id").limit(6).collect()
        if not found:
            raise MemoryError_(f"no memory starts with {prefix}")
        if len(found) > 1:
            raise MemoryError_(f"{prefix} is ambiguous: " + ", ".join(r["memory_id"][:12] for r in found[:5]))
        return found[0]

    # -------------------------------------------------------------- acts

    def _row(self, **fields) -> dict:
        now = datetime.now(UTC)
        return {
            "repository_path": self.repository, "admitted_at": now.isoformat(),
            "admitted_epoch": int(now.timestamp()), "state": "active", "act_no": time.time_ns(), **fields,
        }

    def _frame(self, rows: list[dict]) -> DataFrame:
        schema = self.store.empty("memories").schema
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    def _checked(self, row: dict, citations: list[tuple[str, str]]) -> dict[str, DataFrame]:
        """The act as rows of both tables, refused where it is malformed or points at nothing."""
        frame = self._frame([row])
        refused = m.act_refusals(frame).first()
        if refused:
            raise MemoryError_(refused["refusal"])
        kinds = schemas.CITATION_KINDS
        if any(kind not in kinds or not ref for kind, ref in citations):
            raise MemoryError_("a citation needs one of " + ", ".join(kinds) + " and a reference")
        if len(set(citations)) != len(citations):
            raise MemoryError_("a citation is given twice")
        ordered = sorted(citations, key=lambda c: (schemas.CITATION_KINDS.index(c[0]), c[1]))
        cited = self.spark.createDataFrame(
            [(row["memory_id"], i, kind, ref) for i, (kind, ref) in enumerate(ordered)], schemas.MEMORY_CITATIONS
        )
        refused = self.unheld(frame, cited).first() if self.unheld else None
        if refused:
            raise MemoryError_(refused["refusal"])
        return {"memories": frame, "memory_citations": cited}

    def _only_ours(self) -> None:
        other = self.read().where(F.col("repository_path") != self.repository).first()
        if other:
            raise MemoryError_(f"this store holds memories made about {other['repository_path']}")

    def admit(self, statement: str, citations=(), **fields) -> str:
        self._only_ours()
        memory_id = str(uuid.uuid4())
        row = self._row(memory_id=memory_id, statement=(statement or "").strip(), **fields)
        self.store.append_together(self._checked(row, list(citations)))
        return memory_id

    def _active(self, prefix: str) -> dict:
        self._only_ours()
        old = self.find(prefix).asDict()
        if old["state"] != "active":
            raise MemoryError_(f"memory {old['memory_id'][:8]} is {old['state']}; {ENDED_STAYS}")
        return old

    def supersede(self, prefix: str, statement: str, citations=(), **fields) -> str:
        """Both rows and the citations become visible at once."""
        old = self._active(prefix)
        memory_id = str(uuid.uuid4())
        new = self._row(memory_id=memory_id, statement=(statement or "").strip(), **fields)
        frames = self._checked(new, list(citations))
        ended = {
            **old, "state": "superseded", "ended_at": new["admitted_at"], "ended_epoch": new["admitted_epoch"],
            "superseded_by": memory_id, "act_no": new["act_no"],
        }
        self.store.append_together({**frames, "memories": self._frame([new, ended])})
        return memory_id

    def invalidate(self, prefix: str, reason: str) -> str:
        old = self._active(prefix)
        if not (reason or "").strip():
            raise MemoryError_("give a reason why the memory no longer holds")
        now = self._row()
        ended = {
            **old, "state": "invalidated", "ended_at": now["admitted_at"], "ended_epoch": now["admitted_epoch"],
            "end_reason": reason.strip(), "act_no": now["act_no"],
        }
        self.store.append_together({"memories": self._frame([ended])})
        return old["memory_id"]

    def adopt(self, source: str) -> int:
        """Take over the memories made about *source*."""
        if source == self.repository:
            raise MemoryError_(f"{source} is where this repository lives: no memories to take over")
        moving = self.read().where(F.col("repository_path") == source)
        n = moving.count()
        if not n:
            raise MemoryError_(f"nothing in this store was made about {source}")
        if self.read().where(F.col("repository_path") == self.repository).limit(1).count():
            raise MemoryError_(f"this store already holds memories made about {self.repository}")
        moved = moving.withColumn("repository_path", F.lit(self.repository)).withColumn(
            "act_no", F.lit(time.time_ns())
        )
        self.store.append_together({"memories": materialise(moved, "adopted")})
        self.store.set_meta({"memory_adopted_from": source, "memory_adopted_at": datetime.now(UTC).isoformat()})
        return n

    # -------------------------------------------------------------- files

    def export(self, path: str) -> int:
        """Write ``header`` and the memories in id order as text files under *path*."""
        mine = self.read().where(F.col("repository_path") == self.repository)
        lines = materialise(ix.memory_lines(ix.with_citations(mine, self.citations())), "export")
        n = lines.count()
        header = ix.header_line(self.repository, n, datetime.now(UTC).isoformat())
        whole = self.spark.createDataFrame([("", header)], "memory_id string, line string").unionByName(lines)
        whole.orderBy("memory_id").select("line").write.mode("error").text(path)
        return n

    def take_in(self, path: str, source: str, *, dry_run: bool = False) -> dict:
        """Import a file: every row is checked before any is written."""
        document = ix.read_document(self.spark, path)
        bad = ix.first_violation(document)
        if bad:
            raise MemoryError_(f"{path}: line {bad['line_no']}: {bad['rule']}")
        header = ix.header_of(document)
        if header["repository"] != source:
            raise MemoryError_(f"{path} was made about {header['repository']}, not {source}")
        self._only_ours()
        rows = materialise(ix.memory_rows(document), "import")
        stored = ix.with_citations(self.read(), self.citations())
        plan = materialise(ix.import_plan(rows, stored), "plan")
        conflict = plan.where("decision = 'conflict'").orderBy("memory_id").first()
        if conflict:
            raise MemoryError_(f"{path}: {conflict['memory_id']} exists with another {conflict['difference']}")
        dangling = ix.dangling_successors(rows, stored).orderBy("memory_id").first()
        if dangling:
            raise MemoryError_(f"{path}: memory {dangling['memory_id']} names successor {dangling['superseded_by']}, which is nowhere")
        links = rows.select("memory_id", "superseded_by").unionByName(stored.select("memory_id", "superseded_by")).distinct()
        ring = ix.never_ending_chains(links).orderBy("memory_id").first()
        if ring:
            raise MemoryError_(f"{path}: the successors of memory {ring['memory_id']} come back to it")
        new = rows.join(plan.where("decision = 'insert'").select("memory_id"), "memory_id", "left_semi")
        counts = {r["decision"]: r["count"] for r in plan.groupBy("decision").count().collect()}
        if counts.get("insert") and not dry_run:
            fixed = materialise(
                new.withColumn("repository_path", F.lit(self.repository)).withColumn("act_no", F.lit(time.time_ns())),
                "inserts",
            )
            cited = fixed.select("memory_id", F.posexplode("citations").alias("position", "_c"))
            self.store.append_together({
                "memory_citations": cited.select("memory_id", "position", "_c.kind", "_c.ref"),
                "memories": fixed.drop("citations"),
            })
        return {
            "file": path, "file_repository": header["repository"], "repository": self.repository,
            "format_version": ix.FORMAT_VERSION, "count_in_file": header["count"],
            "imported": counts.get("insert", 0), "skipped": counts.get("skip", 0), "dry_run": dry_run,
        }
