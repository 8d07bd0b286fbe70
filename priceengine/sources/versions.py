"""Published tables: whole versions behind numbered manifests, a lease for the one writer, checks before, migrations after, a layout that prunes.

A version is a folder. Its manifest, a new file that one rename makes visible, names the tables and where they are, the mark
of what they were made from, and the ledger of migrations they have been through. Readers see the old or the new version whole.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How long a writer may hold the lease without renewing it.
LEASE_SECONDS = 6 * 3600


@dataclass(frozen=True)
class Layout:
    """How a table is written: folders by `partition` (name: column), files in stretches of `sort`, Bloom filters on `bloom`."""

    partition: dict[str, Column] = field(default_factory=dict)
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()

    def write(self, df: DataFrame, path: str) -> None:
        keys = [*self.partition, *self.sort]
        out = df.withColumns(self.partition) if self.partition else df
        if keys:
            out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = out.write.partitionBy(*self.partition) if self.partition else out.write
        for column in self.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)


def month_layout() -> Layout:
    """Months as folders, products in order within: a product's history reads a few row groups, a month's its folder."""
    return Layout({"month": F.date_format("observed_at", "yyyy-MM")}, ("product_id",), ("product_id",))


@dataclass(frozen=True)
class Migration:
    """A named step: for each table it changes, a query over the tables, which it names as `{table}`."""

    name: str
    sql: dict[str, str]

    @property
    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.sql, sort_keys=True).encode()).hexdigest()


def _fs(spark: SparkSession, root: str) -> tuple[Any, Callable]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def numbered(spark: SparkSession, root: str, pattern: str) -> list[tuple[int, Any]]:
    """(number, file status) of files and folders such as LEASE-000000000003, in order."""
    fs, path = _fs(spark, root)
    found = fs.globStatus(path(f"{root}/{pattern}")) or []
    return sorted(((int(f.getPath().getName().partition("-")[2].partition(".")[0]), f) for f in found), key=lambda x: x[0])


@contextmanager
def lease(spark: SparkSession, root: str, seconds: float = LEASE_SECONDS) -> Iterator[Callable[[], None]]:
    """Within: this writer is the only one. Gives a check that raises once that is no longer so; call it before what must not happen twice.

    Leases are numbered files, each of which only one writer can create. Who finds one younger than `seconds` fails. Who finds an older one, of a
    writer that died, creates the next number; the old writer, should it still live, finds a higher number at its check.
    """
    fs, path = _fs(spark, root)
    held = numbered(spark, root, "LEASE-*")
    if held and time.time() - held[-1][1].getModificationTime() / 1000 < seconds:
        raise BlockingIOError(f"{root} has another writer, {held[-1][1].getPath().getName()}")
    number = held[-1][0] + 1 if held else 0
    own = path(f"{root}/LEASE-{number:012d}")
    fs.create(own, False).close()  # fails if another writer was first

    def check() -> None:
        now = numbered(spark, root, "LEASE-*")
        if not now or now[-1][0] != number:
            raise TimeoutError(f"{root} has been taken over by another writer")

    try:
        yield check
    finally:
        for k, f in numbered(spark, root, "LEASE-*"):
            if k <= number:
                fs.delete(f.getPath(), False)


def current(spark: SparkSession, root: str) -> dict | None:
    """The published version's manifest, the one with the highest number, or None."""
    found = numbered(spark, root, "MANIFEST-*.json")
    return json.loads("\n".join(r.value for r in spark.read.text(found[-1][1].getPath().toString()).collect())) if found else None


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    now = current(spark, root)
    return spark.read.parquet(f"{root}/{now.get('paths', {}).get(name, now['version'] + '/' + name)}")


def _reveal(spark: SparkSession, root: str, manifest: dict, check: Callable[[], None]) -> None:
    fs, path = _fs(spark, root)
    stage = path(f"{root}/{manifest['version']}/manifest.json")
    out = fs.create(stage)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    found = numbered(spark, root, "MANIFEST-*.json")
    check()
    if not fs.rename(stage, path(f"{root}/MANIFEST-{found[-1][0] + 1 if found else 0:012d}.json")):
        raise OSError(f"{root} could not be published")


def valid(df: DataFrame, checks: dict[str, Column], least: int = 0) -> list[str]:
    """What is wrong with a table, in one pass: `checks` that some row fails, each with the number of such rows, and fewer rows than `least`."""
    told = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]).first()
    return [f"{k}: {told[k]} rows" for k in checks if told[k]] + ([f"only {told.rows} rows"] if told.rows < least else [])


def _ledger(applied: Sequence[dict], migrations: Sequence[Migration]) -> list[Migration]:
    """The migrations that are not in the ledger, by name; one that is and has changed is an error."""
    known = {m["name"]: m["hash"] for m in applied}
    for m in migrations:
        if known.get(m.name, m.hash) != m.hash:
            raise ValueError(f"migration {m.name} was applied with another content, {known[m.name]}, and must not change")
    if len({m.name for m in migrations}) < len(migrations):
        raise ValueError("two migrations have one name")
    return sorted((m for m in migrations if m.name not in known), key=lambda m: m.name)


def _migrated(spark: SparkSession, root: str, paths: dict[str, str], steps: Sequence[Migration], version: str, layouts: dict[str, Layout]) -> dict[str, str]:
    """The paths of the tables after all steps; tables that no step changes stay where they are."""
    for k, m in enumerate(steps):
        tables = {name: spark.read.parquet(f"{root}/{p}") for name, p in paths.items()}
        made = {}
        for name, query in m.sql.items():
            made[name] = f"{version}/{k}-{name}"
            layouts.get(name, Layout()).write(spark.sql(query, **{t: df for t, df in tables.items() if f"{{{t}}}" in query}), f"{root}/{made[name]}")
        paths = paths | made
    return paths


def publish(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, mark: str, force: bool = False, *, checks: dict[str, dict[str, Column]] | None = None, least: dict[str, int] | None = None,
    layouts: dict[str, Layout] | None = None, migrations: Sequence[Migration] = (), lease_seconds: float = LEASE_SECONDS, records: int | None = None,
) -> dict:
    """Write all tables as a new version, through all migrations, look at what was written, then publish it.

    The same `mark` as the published one skips the work. `checks` has conditions for the rows of a table, `least` its fewest rows; both are
    asked of the written files, and if any fails nothing is published and the files go. A migration that fails publishes nothing either. `records`: how many the import read.
    """
    layouts, version = layouts or {}, uuid.uuid4().hex
    with lease(spark, root, lease_seconds) as check:
        now = current(spark, root)
        _ledger(now.get("migrations", []) if now else [], migrations)
        if now and now["fingerprint"] == mark and not force:
            return now | {"status": "skipped"}
        try:
            paths = {name: f"{version}/{name}" for name in tables}
            for name, df in tables.items():
                layouts.get(name, Layout()).write(df, f"{root}/{paths[name]}")
            steps = _ledger([], migrations)
            paths = _migrated(spark, root, paths, steps, version, layouts)
            bad = {name: valid(spark.read.parquet(f"{root}/{p}"), (checks or {}).get(name, {}), (least or {}).get(name, 0)) for name, p in paths.items() if name in (checks or {}) or name in (least or {})}
            if any(bad.values()):
                raise ValueError(f"the new version is not published: {({k: v for k, v in bad.items() if v})}")
            manifest = {"version": version, "fingerprint": mark, "tables": sorted(paths), "paths": paths, "migrations": [{"name": m.name, "hash": m.hash} for m in steps]}
            manifest |= {"built_at": datetime.now(UTC).isoformat(timespec="seconds"), "records": records}
            _reveal(spark, root, manifest, check)
        except Exception:
            fs, path = _fs(spark, root)
            fs.delete(path(f"{root}/{version}"), True)
            raise
        return manifest | {"status": "built"}


def migrate(spark: SparkSession, root: str, migrations: Sequence[Migration], layouts: dict[str, Layout] | None = None, lease_seconds: float = LEASE_SECONDS) -> list[str]:
    """Take the published tables through the migrations they have not been through, in order of name, and publish once; returns their names."""
    version = uuid.uuid4().hex
    with lease(spark, root, lease_seconds) as check:
        now = current(spark, root)
        if now is None:
            raise FileNotFoundError(f"nothing is published at {root}")
        steps = _ledger(now.get("migrations", []), migrations)
        if not steps:
            return []
        try:
            paths = _migrated(spark, root, now.get("paths") or {t: f"{now['version']}/{t}" for t in now["tables"]}, steps, version, layouts or {})
            ledger = [*now.get("migrations", []), *({"name": m.name, "hash": m.hash} for m in steps)]
            _reveal(spark, root, now | {"version": version, "tables": sorted(paths), "paths": paths, "migrations": ledger}, check)
        except Exception:
            fs, path = _fs(spark, root)
            fs.delete(path(f"{root}/{version}"), True)
            raise
        return [m.name for m in steps]


def retire(spark: SparkSession, root: str, keep: int = 2, lease_seconds: float = LEASE_SECONDS) -> int:
    """Delete all but the newest `keep` versions, and folders of writers that died; returns how many folders went. Readers of a deleted version fail."""
    fs, path = _fs(spark, root)
    with lease(spark, root, lease_seconds):
        found = numbered(spark, root, "MANIFEST-*.json")
        used = set()
        for _, f in found[-keep:]:
            told = json.loads("\n".join(r.value for r in spark.read.text(f.getPath().toString()).collect()))
            used |= {told["version"], *(p.split("/")[0] for p in told.get("paths", {}).values())}
        for _, f in found[:-keep]:
            fs.delete(f.getPath(), False)
        gone = [f.getPath() for f in fs.listStatus(path(root)) if f.isDirectory() and f.getPath().getName() not in used]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def product_history(spark: SparkSession, root: str, product_id: str, since: Any = None, until: Any = None) -> DataFrame:
    """A product's published offers, in `month_layout`: folders by month, row groups and pages by product."""
    rows = open_table(spark, root, "offers").where(F.col("product_id") == product_id)
    if since is not None:
        rows = rows.where((F.col("observed_at") >= F.lit(since)) & (F.col("month") >= F.date_format(F.lit(since), "yyyy-MM")))
    if until is not None:
        rows = rows.where((F.col("observed_at") <= F.lit(until)) & (F.col("month") <= F.date_format(F.lit(until), "yyyy-MM")))
    return rows
