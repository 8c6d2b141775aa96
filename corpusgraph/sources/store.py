"""Versioned tables in one shared folder: several tables change together, in one commit, or not at all.

A table's rows lie in Parquet files that Spark writes, dealt into a fixed number of parts by a hash of the table's key (the source of
its rows, say). A version is a small JSON file that names the folders of each part; it holds no rows. A change writes its
files first, and then the next version's file, which can be made only once: whoever comes second sees that its base is gone, and
commits on top of the newer version if that left the parts which it replaced alone, else it fails. Readers see the version
that they opened. A change that dies before its commit leaves files that no version names; ``vacuum`` deletes them.

Rows of a replaced key are rewritten with the other rows of their part, so a change costs the parts that it touches; appended rows
cost themselves. Part numbers and folder names are all that passes through the driver.

``commit`` may name a stream and the number of its batch. A version knows the last batch of each stream, so a batch that comes
again (its commit done, its checkpoint not) changes nothing: rows and the state of who wrote them are exactly once.

Edge cases: an empty change commits an empty version; null keys are a key of their own; rows that repeat a key are all kept by
``append`` and ``replace``, and by ``upsert`` only the last in order; a table without rows reads as empty; reading and changing
a table that doesn't exist is an error, as are names with other characters than letters, digits and ``_``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusgraph.operators.ranking import latest_per_key

PARTS = 64
#: Rows that are written where they are: bytes of a row group, so that a few files can be read by many tasks, and files that a task has open at once.
GROUP_BYTES, OPEN_FILES = 4 << 20, 16
#: Keys of a change that travel to all tasks when the old rows of its parts are sifted.
BROADCAST_ROWS = 200_000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Conflict(RuntimeError):
    """Another change replaced the same parts since this one began."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path("").getFileSystem(self._conf)
        self._fs.mkdirs(self._path("versions"))

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *filter(None, parts))))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    # ---- versions

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last, without a number) consists of."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "batches": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"there is no version {version}")
        source = self._fs.open(self._path("versions", f"{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _publish(self, manifest: dict) -> bool:
        """Writes a version's file under another name and gives it its own, which only one writer can."""
        draft, final = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", f"{manifest['version']}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = none
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), kinds)
        except Exception:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                return False
            raise
        return True

    def rollback(self, version: int) -> int:
        """A new version with the tables of an old one; batches count as done as before, so streams go on from where they are."""
        old, last = self.manifest(version), self.manifest()
        if not self._publish({**last, "version": last["version"] + 1, "tables": old["tables"]}):
            raise Conflict("another change came first")
        return last["version"] + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes versions but the last ``keep``, and folders that none of those names; how many folders went."""
        known = self.versions()
        for v in known[: max(0, len(known) - keep)]:
            self._fs.delete(self._path("versions", f"{v}.json"), False)
        named = {d.split("/")[0] for v in known[-keep:] for t in self.manifest(v)["tables"].values() for dirs in t["files"].values() for d in dirs}
        gone = [d for d in self._names("data") if d not in named]
        for d in gone:
            self._fs.delete(self._path("data", d), True)
        return len(gone)

    # ---- reading

    def schema(self, name: str, manifest: dict | None = None) -> StructType:
        return StructType.fromJson((manifest or self.manifest())["tables"][name]["schema"])

    def read(self, name: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """A table as of a version. With ``keys`` (a frame of few keys), only the parts that may hold them are read."""
        m = self.manifest(version)
        parts = None if keys is None else _parts_of(keys, m["tables"][name])
        return self._rows(name, m, parts)

    def _rows(self, name: str, m: dict, parts: set[int] | None = None) -> DataFrame:
        t, schema = m["tables"][name], self.schema(name, m)
        dirs = sorted(f"{self.root}/data/{d}" for p, ds in t["files"].items() if parts is None or int(p) in parts for d in ds)
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    # ---- changing

    def ensure(self, name: str, schema: str | StructType, key: list[str], parts: int = PARTS) -> None:
        """Makes a table, or adds the columns that it lacks; a column of another type is an error."""
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        for n in (name, *wanted.names):
            if not _NAME.fullmatch(n):
                raise ValueError(f"{n!r} is no name")
        m = self.manifest()
        if name in m["tables"]:
            have = {f.name: f for f in self.schema(name, m).fields}
            if wrong := [f.name for f in wanted.fields if f.name in have and have[f.name].dataType != f.dataType]:
                raise ValueError(f"{name} has other types in {', '.join(wrong)}")
            new = [f for f in wanted.fields if f.name not in have]
            if not new:
                return
            m["tables"][name]["schema"] = StructType([*have.values(), *new]).jsonValue()
        else:
            m["tables"][name] = {"schema": wanted.jsonValue(), "key": key, "parts": parts, "files": {}}
        m["version"] += 1
        if not self._publish(m):
            self.ensure(name, schema, key, parts)

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def done(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream was committed."""
        return self.manifest()["batches"].get(stream, -1) >= batch


def _part(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def _parts_of(rows: DataFrame, t: dict) -> set[int]:
    return {r[0] for r in rows.select(_part(t["key"], t["parts"])).distinct().collect()}


class Change:
    """A change of several tables on the version that it began with; nothing is seen by others before ``commit``."""

    def __init__(self, store: Store, base: dict):
        self.store, self.base = store, base
        self.now = json.loads(json.dumps(base))
        self.replaced: dict[str, set[int]] = {}

    def read(self, name: str) -> DataFrame:
        """A table with what this change did so far."""
        return self.store._rows(name, self.now)

    def _write(self, name: str, rows: DataFrame, deal: bool = True) -> dict[str, list[str]]:
        """Writes rows by part; large parts are split over tasks, small ones share one. The folder of each part that has rows.

        Without ``deal`` no row leaves its task, each of which writes a file a part: for whole tables of few parts.
        """
        t, folder = self.now["tables"][name], uuid.uuid4().hex
        schema = self.store.schema(name, self.now)
        have = rows.schema
        full = rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
        full, target = full.withColumn("_part", _part(t["key"], t["parts"])), f"{self.store.root}/data/{folder}"
        if deal:
            full.hint("rebalance", "_part").write.option("compression", "zstd").partitionBy("_part").parquet(target)
        else:
            conf, several = self.store.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
            before = conf.get(several)
            conf.set(several, str(min(t["parts"], OPEN_FILES)))  # instead of a sort of all rows by part
            try:
                full.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES)).partitionBy("_part").parquet(target)
            finally:
                conf.set(several, before)
        return {n.removeprefix("_part="): [f"{folder}/{n}"] for n in self.store._names(f"data/{folder}") if n.startswith("_part=")}

    def append(self, name: str, rows: DataFrame, deal: bool = True) -> None:
        """More rows. Without ``deal`` they are written by the tasks that have them, not shuffled by part first."""
        files = self.now["tables"][name]["files"]
        for p, dirs in self._write(name, rows, deal).items():
            files[p] = files.get(p, []) + dirs

    def _swap(self, name: str, parts: set[int], *written: dict[str, list[str]]) -> None:
        files = self.now["tables"][name]["files"]
        for p in parts:
            dirs = [d for w in written for d in w.get(str(p), [])]
            files.pop(str(p), None)
            if dirs:
                files[str(p)] = dirs
        self.replaced.setdefault(name, set()).update(parts)

    def _others(self, name: str, parts: set[int], keys: DataFrame) -> DataFrame:
        """The rows of some parts whose keys aren't given."""
        key = self.now["tables"][name]["key"]
        gone = keys.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        return self.store._rows(name, self.now, parts).join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")

    def replace(self, name: str, rows: DataFrame) -> None:
        """The rows of each key that occurs in ``rows`` become these."""
        new = self._write(name, rows)
        written = self.store.spark.read.schema(self.store.schema(name, self.now)).parquet(*[f"{self.store.root}/data/{d}" for ds in new.values() for d in ds]) if new else None
        if written is not None:
            parts = {int(p) for p in new}
            self._swap(name, parts, self._write(name, self._others(name, parts, written)), new)

    def delete(self, name: str, keys: DataFrame) -> None:
        """The rows of these keys go."""
        parts = _parts_of(keys, self.now["tables"][name])
        self._swap(name, parts, self._write(name, self._others(name, parts, keys)))

    def clear(self, name: str) -> None:
        """All rows go."""
        self._swap(name, set(range(self.now["tables"][name]["parts"])))

    def upsert(self, name: str, rows: DataFrame, order: list[str] = [], update: dict[str, Column] | None = None) -> None:  # noqa: B006
        """One row a key: the last of ``rows`` in their order. Where the key is there already, the columns in ``update`` are worked
        out from ``old.*`` and ``new.*``; other columns become the new ones, and stay where ``rows`` lack them."""
        t = self.now["tables"][name]
        fresh = latest_per_key(rows, t["key"], order) if order else rows.dropDuplicates(t["key"])
        fresh = fresh.withColumn("_new", F.lit(True))
        parts = _parts_of(fresh, t)
        old = self.store._rows(name, self.now, parts).withColumn("_old", F.lit(True))
        both = old.alias("old").join(fresh.alias("new"), [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in t["key"]], "full_outer")
        met, out = F.col("old._old").isNotNull() & F.col("new._new").isNotNull(), []
        for f in self.store.schema(name, self.now).fields:
            given = f.name in rows.columns
            new = F.col(f"new.{f.name}") if given else F.lit(None)
            changed = (update or {}).get(f.name, new if given else F.col(f"old.{f.name}"))
            out.append(F.when(met, changed).when(F.col("new._new").isNotNull(), new).otherwise(F.col(f"old.{f.name}")).cast(f.dataType).alias(f.name))
        self._swap(name, parts, self._write(name, both.select(*out)))

    def insert_absent(self, name: str, rows: DataFrame, order: list[str] = []) -> None:  # noqa: B006
        """Only rows whose key isn't there; of several, the first in order."""
        t = self.now["tables"][name]
        first = rows if not order else rows.groupBy(*t["key"]).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (*t["key"], *order)])).alias("_x")).select(*t["key"], "_x.*")
        first = first.dropDuplicates(t["key"])
        there = self.store._rows(name, self.now, _parts_of(first, t)).select(*[F.col(k).alias(f"_{k}") for k in t["key"]])
        self.append(name, first.join(there, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in t["key"]], "left_anti"))
        self.replaced.setdefault(name, set()).update(_parts_of(first, t))  # a key that another writer inserts is a conflict

    def commit(self, batch: tuple[str, int] | None = None, tries: int = 20) -> int:
        """Makes the change visible; the version that has it. A batch that was committed before changes nothing."""
        for _ in range(tries):
            last = self.store.manifest()
            if batch and last["batches"].get(batch[0], -1) >= batch[1]:
                return last["version"]
            merged = json.loads(json.dumps(last))
            for name, t in self.now["tables"].items():
                base, there = self.base["tables"][name]["files"], last["tables"].get(name, {}).get("files")
                if there is None:
                    raise Conflict(f"{name} is gone")
                swapped = self.replaced.get(name, set())
                if wrong := [p for p in swapped if base.get(str(p), []) != there.get(str(p), [])]:
                    raise Conflict(f"parts {sorted(wrong)} of {name} were changed by another")
                files = merged["tables"][name]["files"]
                for p in {int(x) for x in (*t["files"], *base)}:
                    mine = t["files"].get(str(p), [])
                    if p in swapped:
                        files.pop(str(p), None)
                        files |= {str(p): mine} if mine else {}
                    elif more := mine[len(base.get(str(p), [])) :]:
                        files[str(p)] = files.get(str(p), []) + more
            merged["version"] = last["version"] + 1
            if batch:
                merged["batches"][batch[0]] = batch[1]
            if self.store._publish(merged):
                return merged["version"]
        raise Conflict("too many changes at once")


def run_batches(stream: DataFrame, store: Store, label: str, step: Callable[[DataFrame, Change, int], None]) -> None:
    """Takes all that a stream has into the store, each micro-batch as one commit that also notes the batch.

    ``step`` changes tables by the batch's rows. If the run dies between a commit and the stream's checkpoint, the batch comes
    again and is passed over; if it dies before the commit, nothing of the batch is there. The checkpoint lies beside the tables.
    """

    def batch(rows: DataFrame, k: int) -> None:
        if store.done(label, k):
            return
        change = store.begin()
        rows.persist()
        try:
            step(rows, change, k)
            change.commit((label, k))
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.root}/streams/{label}").trigger(availableNow=True).start()
    query.awaitTermination()


def take_files(change: Change, rows: DataFrame, rows_table: str, state_table: str, source: str, ok: str, state: list[str], partial: bool) -> None:
    """One batch of an ingest: the rows of each file replace those stored before, and its state is marked only if all rows succeeded.

    ``ok`` tells of a row whether it did; of a file that isn't whole the good rows are stored with ``partial``, else none, and its
    older rows stay. State and rows are part of one change.
    """
    whole = rows.groupBy(source).agg(F.min(F.col(ok)).alias("_done"), *[F.max(c).alias(c) for c in state]).where("_done").drop("_done")
    good = rows.where(ok)
    change.replace(rows_table, good if partial else good.join(whole.select(source), source, "left_semi"))
    change.upsert(state_table, whole)
