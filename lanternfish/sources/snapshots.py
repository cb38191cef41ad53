"""A table keyed by id, as immutable Parquet folders that manifests name: upserts, deletes, hold-outs and reading as of a version.

Each commit writes what is new beside what is there, and then publishes a manifest of its version. Only manifests
say what the table holds, so a commit that dies before that leaves files nobody reads, and whoever reads a version reads it
whole, whatever is committed meanwhile. Rows are not rewritten: ids that a commit replaces or deletes go to a delete
vector, which says up to which commit they are dead.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a delete vector that is sent to every task at most; ids are short. A larger one is joined.
SENT = 500_000
#: Attempts of a commit, and seconds after which a manifest that isn't whole is taken for that of a writer who died.
TRIES, GRACE = 20, 60.0


class Conflict(RuntimeError):
    """Another commit came first, TRIES times."""


class Folder:
    """Small files under one path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, sub: str) -> list[str]:
        at = self._paths(f"{self.path}/{sub}")
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet; False if it is."""
        at = self._paths(f"{self.path}/{name}")
        try:
            out = self.fs.create(at, False)
        except Exception:  # noqa: BLE001 - py4j's error of a file that exists, by whichever file system
            if self.fs.exists(at):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self._paths(f"{self.path}/{name}")).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self._paths(f"{self.path}/{name}"), True)


@dataclass(frozen=True)
class Manifest:
    """``batches`` (folder, since, rows): rows of the commit ``since``. ``dead`` (folder, before, rows): ids whose rows of commits before
    ``before`` are dead. ``held`` (folder): values of the group column that a view leaves out."""

    version: int = 0
    batches: list[dict] = field(default_factory=list)
    dead: list[dict] = field(default_factory=list)
    held: list[dict] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps({"version": self.version, "batches": self.batches, "dead": self.dead, "held": self.held, "whole": True})

    @staticmethod
    def of(text: str) -> Manifest | None:
        """None for a manifest whose writer died in it."""
        try:
            told = json.loads(text)
        except ValueError:
            return None
        return Manifest(told["version"], told["batches"], told["dead"], told["held"]) if told.get("whole") else None


class Snapshot:
    """One version of a table; what it reads doesn't change."""

    def __init__(self, table: Table, manifest: Manifest):
        self.table, self.manifest, self.version = table, manifest, manifest.version

    def _live(self, columns: list[str], since: bool = False) -> DataFrame:
        """The columns of rows that are not dead, of every commit."""
        t = self.table
        out = None
        for b in self.manifest.batches:
            part = t.spark.read.schema(t.schema).parquet(f"{t.folder.path}/{b['folder']}").select(*{t.key: 0, **dict.fromkeys(columns)}, F.lit(b["since"]).cast("long").alias("__since"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = t.spark.createDataFrame([], t.schema).select(*{t.key: 0, **dict.fromkeys(columns)}, F.lit(0).cast("long").alias("__since"))
        if self.manifest.dead:
            dead = None
            for d in self.manifest.dead:
                part = t.spark.read.parquet(f"{t.folder.path}/{d['folder']}").select(F.col(t.key).alias("__dead"), F.lit(d["before"]).cast("long").alias("__before"))
                dead = part if dead is None else dead.unionByName(part)
            dead = F.broadcast(dead) if sum(d["rows"] for d in self.manifest.dead) <= SENT else dead
            out = out.join(dead, (F.col(t.key) == F.col("__dead")) & (F.col("__since") < F.col("__before")), "left_anti")
        return out.select(*columns, *(["__since"] if since else []))

    def read(self) -> DataFrame:
        """The rows, one an id, without what a view holds out."""
        t = self.table
        rows = self._live(t.schema.names)
        for h in self.manifest.held:
            out = t.spark.read.parquet(f"{t.folder.path}/{h['folder']}")
            rows = rows.join(F.broadcast(out) if h["rows"] <= SENT else out, t.group, "left_anti")
        return rows.select(*t.schema.names)

    def count(self) -> int:
        return self.read().count()


class Table:
    """The table at ``path``, made if there is none: rows of ``schema``, one for each value of ``key``; ``group`` is the column that hold-outs name."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", group: str = "image_id"):
        self.spark, self.schema, self.key, self.group = spark, schema, key, group
        self.folder = Folder(spark, path)
        if not self.folder.names("manifests"):
            self._publish(Manifest())

    @staticmethod
    def _name(version: int) -> str:
        return f"manifests/{version:012d}.json"

    def _publish(self, m: Manifest) -> bool:
        return self.folder.create(self._name(m.version), m.text())

    def _next(self) -> tuple[int, Snapshot]:
        """(number of the next commit, what it starts from). The number comes first: if another commit is published meanwhile, it
        has this number. A manifest that is just being written is waited for."""
        while True:
            number = max(self._numbers())
            if Manifest.of(self.folder.read(self._name(number))) or self.folder.age(self._name(number)) > GRACE:
                return number + 1, self.snapshot()
            time.sleep(0.2)

    def _numbers(self) -> list[int]:
        return [int(n[:12]) for n in self.folder.names("manifests") if re.fullmatch(r"\d{12}\.json", n)]

    def versions(self) -> list[int]:
        return [v for v in self._numbers() if Manifest.of(self.folder.read(self._name(v)))]

    def snapshot(self, version: int | None = None, view: str | None = None) -> Snapshot:
        """The last version, or that of a number or of a view that :meth:`hold_out` made."""
        if view is not None or version is not None:
            name = f"views/{view}.json" if view is not None else self._name(version)
            held = self.folder.names(name.split("/")[0])
            m = Manifest.of(self.folder.read(name)) if name.split("/")[1] in held else None
            if m is None:
                raise LookupError(f"no {name} in {self.folder.path}")
            return Snapshot(self, m)
        for v in reversed(self._numbers()):  # the last one may be torn
            if m := Manifest.of(self.folder.read(self._name(v))):
                return Snapshot(self, m)
        raise LookupError(f"no manifest in {self.folder.path}")

    def _write(self, df: DataFrame, kind: str) -> tuple[str, int]:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.path}/{name}")
        return name, self.spark.read.schema(df.schema).parquet(f"{self.folder.path}/{name}").count()

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row an id: where ids repeat, that of the least values. Rows of other ids don't shuffle."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).where(F.col(self.key).isNotNull())
        twice = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(self.key)
        if twice.isEmpty():
            return rows
        least = rows.join(twice, self.key, "left_semi").groupBy(self.key).agg(F.min(F.struct(*[c for c in self.schema.names if c != self.key])).alias("r"))
        return rows.join(twice, self.key, "left_anti").unionByName(least.select(self.key, "r.*").select(*self.schema.names))

    def _commit(self, ids: DataFrame, batch: tuple[str, int] | None) -> int:
        """Publish ``batch`` (folder, rows), whose ids, or others to delete, are ``ids``. If another commit comes first, what is
        dead is found again among the rows that are there then."""
        for _ in range(TRIES):
            number, now = self._next()
            hit = now._live([self.key], since=True).join(ids, self.key, "left_semi")
            folder, rows = self._write(hit, "dead")
            lost = {r["__since"]: r["n"] for r in self.spark.read.schema(hit.schema).parquet(f"{self.folder.path}/{folder}").groupBy("__since").agg(F.count(F.lit(1)).alias("n")).collect()} if rows else {}
            batches = [b | {"live": b["live"] - lost.get(b["since"], 0)} for b in now.manifest.batches]
            batches = [b for b in batches if b["live"]]  # what is wholly replaced is not read again
            if batch is not None and batch[1]:
                batches.append({"folder": batch[0], "since": number, "rows": batch[1], "live": batch[1]})
            dead = [*now.manifest.dead, *([{"folder": folder, "before": number, "rows": rows}] if rows else [])]
            dead = [d for d in dead if any(b["since"] < d["before"] and b["live"] < b["rows"] for b in batches)]
            if self._publish(Manifest(number, batches, dead)):
                return number
        raise Conflict(f"{TRIES} commits to {self.folder.path} were overtaken")

    def upsert(self, rows: DataFrame) -> int:
        """The version in which ``rows`` are there, in place of what had their ids. Rows without an id are left out; of rows of one id that
        of the least values stays. Only ids meet what is there already."""
        batch = self._write(self._one_each(rows), "data")
        return self._commit(self.spark.read.schema(self.schema).parquet(f"{self.folder.path}/{batch[0]}").select(self.key), batch)

    def delete(self, ids: DataFrame) -> int:
        """The version without the rows of ``ids`` (the key)."""
        return self._commit(ids.select(F.col(self.key).cast(self.schema[self.key].dataType).alias(self.key)), None)

    def hold_out(self, view: str, groups: DataFrame, version: int | None = None) -> Snapshot:
        """A view of a version without every row of ``groups`` (the group column): nothing is copied, and the table stays as it is. A view
        is made once."""
        m = self.snapshot(version).manifest
        folder, rows = self._write(groups.select(F.col(self.group).cast(self.schema[self.group].dataType).alias(self.group)).where(F.col(self.group).isNotNull()).distinct(), "held")
        made = Manifest(m.version, m.batches, m.dead, [*m.held, {"folder": folder, "rows": rows}])
        if not self.folder.create(f"views/{view}.json", made.text()):
            raise FileExistsError(f"there is a view {view!r}")
        return Snapshot(self, made)

    def compact(self) -> int:
        """The version whose rows are those of the last one in one folder, without delete vectors. A commit that comes meanwhile wins."""
        number, now = self._next()
        folder, rows = self._write(now.read(), "data")
        if not self._publish(Manifest(number, [{"folder": folder, "since": number, "rows": rows, "live": rows}] if rows else [])):
            raise Conflict("another commit came first: compact again")
        return number

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete versions but the last ``keep``, and folders that no version left and no view reads: also those of commits that died.
        To be called while nobody commits or reads an older version. What was deleted."""
        whole = self.versions()
        stay = [self.snapshot(v).manifest for v in whole[-keep:]] + [self.snapshot(view=n.removesuffix(".json")).manifest for n in self.folder.names("views")]
        used = {part["folder"] for m in stay for part in (*m.batches, *m.dead, *m.held)}
        gone = [f"{kind}/{n}" for kind in ("data", "dead", "held") for n in self.folder.names(kind) if f"{kind}/{n}" not in used]
        gone += [self._name(v) for v in self._numbers() if v < whole[-1] and v not in whole[-keep:]]
        for name in gone:
            self.folder.delete(name)
        return gone
