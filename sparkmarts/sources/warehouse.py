"""Table store: raw, staging and mart tables as parquet folders under one root (``Warehouse``)
or as tables of the session catalog (``CatalogWarehouse``).

The root should be shared storage on a cluster (HDFS, object store, or a shared mount). A write never
touches the table that readers see: the executors write a new version through Spark's commit protocol,
and then a small pointer is switched to it in one step (a file replaced by a rename, or a view of the
catalog). A build that dies leaves the old tables readable; what it left behind is removed later. A build
may also hold its switches back and make them together at its end (``switch_at_end``).

While a table is written its rows and quality figures are observed (``quality.OBSERVED``) and kept beside
the pointer, so that checks over them need no scan of their own (``stats``).
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.contracts import SOURCE_TABLES, check_identifier
from sparkmarts.operators.ordering import MART_ORDER, ordered_spread, sort_keys
from sparkmarts.operators.quality import OBSERVED, log_rows
from sparkmarts.sources.store_files import StoreFiles
from sparkmarts.sources.normalize import empty_frame, normalize

# --- fixed values: physical layout of each built table (partition column, in-file sort) ---
TABLE_LAYOUT: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "stg_analytics_events": ("event_date", ("event_name", "admin_id")),
    "stg_organizations": (None, ("organization_id",)),
    "stg_matches": (None, ("organization_id",)),
    "mart_growth_daily": (None, MART_ORDER["mart_growth_daily"]),
    "mart_admin_usage": ("event_date", ("admin_id",)),
    "mart_product_activity": ("activity_date", ("metric", "organization_id")),
    "mart_finance": ("payment_date", ("domain", "flow")),
    "mart_retention": (None, MART_ORDER["mart_retention"]),
    "mart_entity_ranking": (None, MART_ORDER["mart_entity_ranking"]),
}
RUN_LOG = "etl_runs"

# --- fixed values: columns of each built table, in order (a table without rows has no file to
# --- infer them from, and partition columns would be read back last) ---
BUILT_TABLES: dict[str, str] = {
    "stg_analytics_events": (
        "id string, event_at timestamp_ntz, event_date date, event_name string, source string, "
        "admin_id string, organization_id string, club_id string, league_id string, "
        "entity_type string, entity_id string, path string, properties string, "
        "funnel_stage string"),
    "stg_organizations": (
        "organization_id string, created_at timestamp_ntz, created_date date, admin_id string, "
        "organization_name string, organization_slug string, is_public boolean"),
    "stg_matches": (
        "match_id string, created_at timestamp_ntz, created_date date, admin_id string, "
        "organization_id string, status string, modality string, scheduled_at timestamp_ntz, "
        "finished_at timestamp_ntz"),
    "mart_growth_daily": (
        "event_date date, source string, funnel_stage string, event_name string, events bigint, "
        "admins bigint, organizations bigint"),
    "mart_admin_usage": (
        "event_date date, admin_id string, login_events bigint, first_login_at timestamp_ntz, "
        "last_login_at timestamp_ntz"),
    "mart_product_activity": (
        "activity_date date, organization_id string, metric string, value bigint"),
    "mart_finance": (
        "payment_date date, domain string, flow string, entity_id string, status string, "
        "expected_amount double, paid_amount double, currency string"),
    "mart_retention": (
        "cohort_date date, day_number bigint, active_admins bigint, active_organizations bigint"),
    "mart_entity_ranking": (
        "organization_id string, organization_name string, created_date date, players bigint, "
        "matches_created bigint, matches_finished bigint, health_score bigint"),
}
TABLE_STATS = "etl_table_stats"
DONE = "_SUCCESS"  # Spark's committer leaves it in a version's folder when all files are there
POINTER = "_CURRENT"
#: --- fixed values: bucket column of catalog tables that are joined on it ---
BUCKETED = {"raw_players": "organization_id", "stg_organizations": "organization_id",
            "stg_matches": "organization_id"}


class IncompleteTableError(RuntimeError):
    """A table's pointer names a version that isn't complete."""


@dataclass
class Pointer:
    """What readers of a table see: its current version, older ones that are kept, observed figures."""

    version: str
    older: list[str] = field(default_factory=list)
    stats: dict[str, float] = field(default_factory=dict)
    written_at: float = 0.0


def built_schema(name: str) -> T.StructType | None:
    """Declared schema of a staging or mart table; None for any other table."""
    return T.StructType.fromDDL(BUILT_TABLES[name]) if name in BUILT_TABLES else None


class Warehouse:
    """Parquet tables under ``root``: ``root/<name>/<version>`` and the pointer ``root/<name>/_CURRENT``.

    ``keep`` superseded versions stay for readers that began before the switch. Versions that no write
    finished within ``stale_hours`` are removed by the next write of their table.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 1, stale_hours: float = 24.0):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keep, self.stale_hours = keep, stale_hours
        self._held: dict[str, Pointer] | None = None

    def path(self, name: str) -> str:
        return f"{self.root}/{check_identifier(name)}"

    @property
    def files(self) -> StoreFiles:
        return StoreFiles(self.spark)

    # -- pointers ------------------------------------------------------------------------------

    def pointer(self, name: str) -> Pointer | None:
        """The pointer of table ``name``: the held-back one of a running build, else the stored one."""
        check_identifier(name)
        if self._held and name in self._held:
            return self._held[name]
        return self._stored(name)

    def _stored(self, name: str) -> Pointer | None:
        text = self.files.read(f"{self.path(name)}/{POINTER}")
        return None if text is None else Pointer(**json.loads(text))

    def _switch(self, name: str, pointer: Pointer) -> None:
        """Readers see ``pointer`` from now on; versions beyond ``keep`` and abandoned ones go."""
        old = self._stored(name)
        older = [old.version, *old.older] if old else []
        pointer.older = older[:self.keep]
        self.files.replace(f"{self.path(name)}/{POINTER}", json.dumps(asdict(pointer)))
        for version in older[self.keep:]:
            self._remove(name, version)
        for version in self._abandoned(name, {pointer.version, *older}):
            self._remove(name, version)

    def _abandoned(self, name: str, known: set[str]) -> list[str]:
        limit = time.time() - 3600 * self.stale_hours
        return [v for v, changed in self.files.folders(self.path(name)) if v not in known and changed < limit]

    def _remove(self, name: str, version: str) -> None:
        self.files.remove(f"{self.path(name)}/{version}")

    @contextlib.contextmanager
    def switch_at_end(self) -> Iterator[None]:
        """Within, tables written are seen by this object only; all switch together at the end.

        If the block fails, no table switches.
        """
        if self._held is not None:
            yield  # part of an outer build
            return
        self._held = {}
        try:
            yield
            held, self._held = self._held, None
            for name, pointer in held.items():
                self._switch(name, pointer)
        finally:
            self._held = None

    # -- reading -------------------------------------------------------------------------------

    def exists(self, name: str) -> bool:
        """True when a version of table ``name`` was written to its end, with or without rows."""
        return self.pointer(name) is not None

    def _open(self, name: str, version: str, schema: T.StructType | None) -> DataFrame:
        path = f"{self.path(name)}/{version}"
        if not self.files.exists(f"{path}/{DONE}"):
            raise IncompleteTableError(f"{path} has no {DONE}")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(path)

    def read(self, name: str) -> DataFrame:
        """Table ``name`` as it is now; built tables come with their declared columns in order."""
        pointer = self.pointer(name)
        if pointer is None:
            raise ValueError(f"no table {name} in {self.root}")
        schema = built_schema(name)
        out = self._open(name, pointer.version, schema)
        return out if schema is None else out.select(*schema.fieldNames())

    def stats(self, name: str) -> dict[str, float]:
        """Figures observed while the current version of ``name`` was written; ``rows`` is one of them."""
        pointer = self.pointer(name)
        if pointer is None:
            raise ValueError(f"no table {name} in {self.root}")
        return dict(pointer.stats)

    # -- writing -------------------------------------------------------------------------------

    def _save(self, writer, name: str, version: str) -> None:
        writer.parquet(f"{self.path(name)}/{version}")

    def _commit(self, name: str, df: DataFrame, configure=lambda writer: writer) -> str:
        """Write ``df`` as a new version of ``name``, observed, and switch to it (or hold the switch)."""
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        observation = Observation()
        metrics = OBSERVED.get(name, lambda: [])()
        seen = df.observe(observation, F.count(F.lit(1)).alias("rows"), *metrics)
        self._save(configure(seen.write.mode("error")), name, version)
        stats = {key: float(value or 0) for key, value in observation.get.items()}
        pointer = Pointer(version, stats=stats, written_at=time.time())
        if self._held is None:
            self._switch(name, pointer)
        else:
            self._held[name] = pointer
        return name

    def write(self, name: str, df: DataFrame, partition_by: str | None = None,
              sort_within: Sequence[str] = ()) -> str:
        """Replace table ``name`` by ``df``.

        The rows are rebalanced by AQE before the write (skewed partitions split, small ones
        merged, so files are evenly sized and one hot date does not land in one task). A
        date-partitioned table gets one folder per date, which the report filters prune, sorted
        within each file. Other tables with sort keys are split into ranges of the keys, so that
        file statistics are narrow; row numbers end the key, so a frequent key is split too.
        """
        if partition_by:
            out = df.hint("rebalance", partition_by)
            out = out.sortWithinPartitions(F.col(partition_by), *sort_keys(tuple(sort_within)))
            return self._commit(name, out, lambda writer: writer.partitionBy(partition_by))
        out = ordered_spread(df, tuple(sort_within)) if sort_within else df.hint("rebalance")
        return self._commit(name, out)

    def write_table(self, name: str, df: DataFrame) -> str:
        """Write a staging or mart table with its standard layout."""
        partition_by, sort_within = TABLE_LAYOUT.get(name, (None, ()))
        return self.write(name, df, partition_by, sort_within)

    # -- raw layer -----------------------------------------------------------------------------

    def write_raw(self, frames: Mapping[str, DataFrame], full_refresh: bool = False) -> list[str]:
        """Land source frames as ``raw_<table>``, normalised to their contracts.

        Only the supplied tables are replaced; with ``full_refresh`` every contract table is
        rewritten and tables missing from ``frames`` become empty. A one-row run log follows.
        """
        written = []
        for table, spec in SOURCE_TABLES.items():
            if table in frames:
                df = normalize(frames[table], table)
            elif full_refresh:
                df = empty_frame(self.spark, table)
            else:
                continue
            self._commit(spec.raw_name, df)
            written.append(spec.raw_name)
        self.log_run(len(written))
        return written

    def ensure_raw(self) -> list[str]:
        """Create every missing raw table as an empty table of its contract."""
        created = []
        for table, spec in SOURCE_TABLES.items():
            if not self.exists(spec.raw_name):
                self._commit(spec.raw_name, empty_frame(self.spark, table))
                created.append(spec.raw_name)
        return created

    def read_raw(self, tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Raw tables by contract name; a missing one reads as an empty contract frame."""
        names = {table: SOURCE_TABLES[table].raw_name for table in tables or SOURCE_TABLES}
        return {table: self.read(name) if self.exists(name) else empty_frame(self.spark, table)
                for table, name in names.items()}

    def log_run(self, table_count: int) -> None:
        """Replace the run log with one row (loaded_at, table_count)."""
        log = self.spark.range(1).select(
            F.current_timestamp().alias("loaded_at"),
            F.lit(table_count).cast("bigint").alias("table_count"),
        )
        self._commit(RUN_LOG, log)

    def log_stats(self, names: Iterable[str]) -> None:
        """Replace the table of observed figures: (table_name, metric, value) of each of ``names``."""
        self._commit(TABLE_STATS, log_rows(self.spark, {n: self.stats(n) for n in names}))

    def present(self, names: Iterable[str]) -> list[str]:
        """Which of ``names`` exist as tables."""
        return [n for n in names if self.exists(n)]

    def query(self, sql_text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
        """Run SQL over stored tables: ``{table}`` names a table, ``:name`` a parameter.

        Tables are passed to ``spark.sql`` as DataFrame arguments (no shared temporary views)
        and values as parameter markers, so nothing from ``args`` is pasted into the SQL text.
        """
        names = set(re.findall(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", sql_text))
        frames = {n: self.read(n) for n in names}
        return self.spark.sql(sql_text, args=dict(args) if args else None, **frames)


class CatalogWarehouse(Warehouse):
    """The same table store on the session catalog: views ``<database>.<name>`` over version tables.

    Use this where a metastore names the tables; existence is a catalog lookup, not a file probe, and
    replacing the view is the switch. The database must exist. With ``buckets`` the tables of ``BUCKETED``
    are stored in that many buckets by organisation, so that the ranking's aggregates and joins on it need
    no exchange. A bucket is written and read by one task: leave it at 0 where one organisation may hold
    a large share of all players or matches.
    """

    def __init__(self, spark: SparkSession, database: str, keep: int = 1, buckets: int = 0):
        self.spark = spark
        self.database = check_identifier(database)
        self.keep, self.buckets = keep, buckets
        self._held: dict[str, Pointer] | None = None

    def table(self, name: str) -> str:
        return f"{self.database}.{check_identifier(name)}"

    def _version_table(self, name: str, version: str) -> str:
        return f"{self.table(name)}__{version.replace('-', '_')}"

    def path(self, name: str) -> str:
        raise TypeError("catalog tables are addressed by name; use table()")

    def _stored(self, name: str) -> Pointer | None:
        if not self.spark.catalog.tableExists(self.table(name)):
            return None
        shown = self.spark.sql(f"SHOW TBLPROPERTIES {self.table(name)}").collect()
        held = {r["key"]: r["value"] for r in shown}.get("sparkmarts.pointer")
        if held is None:
            raise IncompleteTableError(f"{self.table(name)} is not a view of this store")
        return Pointer(**json.loads(held))

    def _switch(self, name: str, pointer: Pointer) -> None:
        old = self._stored(name)
        older = [old.version, *old.older] if old else []
        pointer.older = older[:self.keep]
        held = json.dumps(asdict(pointer)).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.table(name)} TBLPROPERTIES ('sparkmarts.pointer' = "
                       f"'{held}') AS SELECT * FROM {self._version_table(name, pointer.version)}")
        for version in older[self.keep:]:
            self._remove(name, version)

    def _remove(self, name: str, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._version_table(name, version)}")

    def _open(self, name: str, version: str, schema: T.StructType | None) -> DataFrame:
        return self.spark.table(self._version_table(name, version))

    def _save(self, writer, name: str, version: str) -> None:
        writer.format("parquet").saveAsTable(self._version_table(name, version))

    def _commit(self, name: str, df: DataFrame, configure=lambda writer: writer) -> str:
        key = BUCKETED.get(name)
        if not (key and self.buckets):
            return super()._commit(name, df, configure)
        dealt = df.repartition(self.buckets, key).sortWithinPartitions(key)
        return super()._commit(name, dealt, lambda writer: writer.bucketBy(self.buckets, key).sortBy(key))

    def write_table(self, name: str, df: DataFrame) -> str:
        """Write a staging or mart table with its standard layout, or in buckets."""
        if name in BUCKETED and self.buckets:
            return self._commit(name, df)
        return super().write_table(name, df)
