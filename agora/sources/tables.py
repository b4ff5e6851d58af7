"""The bundle of eight marketplace tables an operator runs on."""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from agora.config import DEMO_DOMAIN, released, scratch_path, shuffle_width, written
from agora.sources import store
from agora.sources.schemas import SCHEMAS

POINTER = "_CURRENT"  # names the version that readers of a published folder see

TABLE_NAMES = tuple(SCHEMAS)


# Join key each snapshot table is bucketed by (co-located request joins).
BUCKET_KEYS = {
    "users": "id",
    "service_requests": "id",
    "bids": "request_id",
    "mkt_conversations": "request_id",
    "messages": "conversation_id",
    "reviews": "request_id",
    "promotions": "provider_id",
    "transactions": "request_id",
}


# Columns that name a user.
PARTIES = {
    "service_requests": ("client_id", "selected_provider_id"),
    "bids": ("provider_id",),
    "mkt_conversations": ("client_id", "provider_id"),
    "messages": ("sender_id",),
    "reviews": ("client_id", "provider_id"),
    "promotions": ("provider_id",),
}

# Ids of a small set that a join may broadcast: 8 bytes each, 8 MB in all.
# Beyond it the same join goes by Spark's own choice.
MOST_BROADCAST = 1_000_000


@dataclass
class Tables:
    users: DataFrame
    service_requests: DataFrame
    bids: DataFrame
    mkt_conversations: DataFrame
    messages: DataFrame
    reviews: DataFrame
    promotions: DataFrame
    transactions: DataFrame
    demo_domain: str = DEMO_DOMAIN
    dealt: int | None = field(default=None, compare=False)  # buckets in which bids and requests are kept by request; see load
    _barred: list = field(default_factory=list, repr=False, compare=False)  # see barred_ids; shared by narrowed bundles

    # ------------------------------------------------------------------ build
    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame], demo_domain: str = DEMO_DOMAIN) -> "Tables":
        return cls(**{n: frames[n] for n in TABLE_NAMES}, demo_domain=demo_domain)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, demo_domain: str = DEMO_DOMAIN) -> "Tables":
        """Read a snapshot folder ``path/<table>`` with the fixed schemas,
        and the batches committed to its tables since (``sinks.append``)."""
        from agora.sources.sinks import read_table

        base = path.rstrip("/")
        return cls.from_frames({n: read_table(spark, s, f"{base}/{n}") for n, s in SCHEMAS.items()}, demo_domain)

    @classmethod
    def from_published(cls, spark: SparkSession, path: str, demo_domain: str = DEMO_DOMAIN) -> "Tables":
        """Read a published snapshot (ST-E): the version that ``path``'s
        pointer names, or ``path`` itself if it is a version. A folder without
        its manifest, which is written after the tables, is an error."""
        base = path.rstrip("/")
        current = store.get(spark, f"{base}/{POINTER}")
        base = base if current is None else f"{base}/{current}"
        try:
            listed = spark.read.text(f"{base}/_MANIFEST", wholetext=True).first()
        except AnalysisException as missing:
            raise FileNotFoundError(f"{base} has no manifest: it was not published as a whole") from missing
        if listed is None or set(json.loads(listed[0])["tables"]) != set(SCHEMAS):
            raise FileNotFoundError(f"the manifest of {base} does not list all tables")
        return cls.from_parquet(spark, base, demo_domain)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: dict[str, list], demo_domain: str = DEMO_DOMAIN) -> "Tables":
        """Small hand-written tables (unit tests)."""
        return cls.from_frames(
            {n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()},
            demo_domain,
        )

    def frames(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES}

    def replace(self, **frames: DataFrame) -> "Tables":
        cur = self.frames()
        cur.update(frames)
        return Tables.from_frames(cur, self.demo_domain)

    def narrowed(self, **frames: DataFrame) -> "Tables":
        """``replace`` by frames with fewer of the same rows: the barred ids stay those of the whole tables."""
        out = self.replace(**frames)
        out._barred = self._barred
        return out

    def write(self, path: str, mode: str = "errorifexists") -> str:
        """Write every table as parquet under ``path`` (a snapshot)."""
        base = path.rstrip("/")
        for n, df in self.frames().items():
            df.write.mode(mode).parquet(f"{base}/{n}")
        return base

    def write_bucketed(self, path: str, buckets: int, prefix: str) -> "Tables":
        """Write a snapshot whose tables are bucketed (and sorted) by their
        join key — the request id for requests, bids, transactions,
        conversations and reviews — registered as external tables
        ``<prefix>_<table>`` located under ``path``. Joins between them on
        the request id then need no shuffle; the result reads them back."""
        spark = self.spark
        base = path.rstrip("/")
        out = {}
        for n, df in self.frames().items():
            key = BUCKET_KEYS[n]
            name = f"{prefix}_{n}"
            (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
               .option("path", f"{base}/{n}").format("parquet").saveAsTable(name))
            out[n] = spark.table(name)
        return Tables.from_frames(out, self.demo_domain)

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession

    # ------------------------------------------------------- derived helpers
    def user_flags(self) -> DataFrame:
        """(id, name, role, is_demo): users pruned to what joins need;
        ``email``'s demo test is computed once here."""
        from agora.operators.filters import is_demo_email

        return self.users.select("id", "name", "role", is_demo_email("email", self.demo_domain).alias("is_demo"))

    def barred_ids(self) -> tuple[DataFrame, int]:
        """(_uid, _demo): ids that a required party must not have, and how
        many they are: those of demo accounts, and those that a table names
        though no user has them.

        Both are few, whatever the size of ``users`` and of the facts, so a
        fact drops their rows by an anti-join with a small table and stays
        where it is. Dangling ids come from one pass over the facts' party
        columns, distinct before their shuffle. Written once a bundle in the
        shared folder.
        """
        with _LOCK:
            if not self._barred:
                users = self.user_flags()
                named = None
                for table, columns in PARTIES.items():
                    own = getattr(self, table).select(F.explode(F.array(*columns)).alias("_uid")).distinct()
                    named = own if named is None else named.unionByName(own)
                dangling = named.where(F.col("_uid").isNotNull()).distinct().join(
                    users.select(F.col("id").alias("_uid")), "_uid", "left_anti").select("_uid", F.lit(False).alias("_demo"))
                demo = users.where("is_demo").select(F.col("id").alias("_uid"), F.lit(True).alias("_demo"))
                kept = written(demo.unionByName(dangling), scratch_path(self.spark, "barred"))
                self._barred += [kept, kept.count()]
        return self._barred[0], self._barred[1]

    def _barred_where(self, condition: str) -> DataFrame:
        ids, n = self.barred_ids()
        ids = ids.where(condition).select("_uid")
        return F.broadcast(ids) if n <= MOST_BROADCAST else ids  # small by its count; beyond that Spark joins as it sees fit

    def demo_ids(self) -> DataFrame:
        """Ids of demo accounts."""
        return self._barred_where("_demo")

    def dangling_ids(self) -> DataFrame:
        """Ids that a table names and no user has."""
        return self._barred_where("not _demo")

    def unreal_ids(self) -> DataFrame:
        """Ids that are no existing real account's."""
        return self._barred_where("true")

    def real_names(self) -> DataFrame:
        """(_uid, _name) of real accounts, for joins that also need the name."""
        df = self.user_flags().where(~F.col("is_demo")).select(
            F.col("id").alias("_uid"), F.col("name").alias("_name"))
        return df

    def all_names(self) -> DataFrame:
        """(_uid, _name, _demo) of every account."""
        df = self.user_flags().select(
            F.col("id").alias("_uid"), F.col("name").alias("_name"), F.col("is_demo").alias("_demo"))
        return df


# Snapshot tables that are bucketed by request as they are derived, from so many lines on.
DEALT = {"bids": "request_id", "service_requests": "id"}
DEALT_ROWS = 2_000_000

_LOCK = threading.Lock()
_LOADED: dict[tuple, Tables] = {}


def load(spark: SparkSession, sf_dir: str, materialize: bool = True, buckets: int | None = None) -> Tables:
    """Marketplace tables for a driver data folder.

    With ``materialize`` (default) the derivation runs once per session and
    folder and is written as parquet under the shared checkpoint folder;
    later operators read that snapshot. Otherwise the derivation stays lazy.
    The bids and requests of a large snapshot are bucketed by request as they
    come out of the derivation, which deals them so anyway: what joins them by
    request moves neither again.
    ``buckets`` (default ``$AGORA_BUCKETS``, 0 = off) writes the snapshot
    bucketed by request id instead (see ``Tables.write_bucketed``).
    """
    import os
    import uuid

    from agora.sources.derive import derive_tables

    if buckets is None:
        buckets = int(os.environ.get("AGORA_BUCKETS", "0"))
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), materialize, buckets)
    with _LOCK:
        hit = _LOADED.get(key)
    if hit is not None:
        return hit
    if materialize:
        path = scratch_path(spark, "tables")

        lines = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").count()
        dealt = shuffle_width(spark) if lines >= DEALT_ROWS else None
        run, placed = uuid.uuid4().hex[:12], {}

        def persist(name: str, df: DataFrame) -> DataFrame:
            if dealt and name in DEALT:
                table = f"agora_{name}_{run}"
                df.write.option("compression", "zstd").bucketBy(dealt, DEALT[name]).option("path", f"{path}/{name}").saveAsTable(table)
                placed[name] = out = spark.table(table)
            else:
                out = written(df, f"{path}/{name}")
            released(spark)
            return out

        derive_tables(spark, sf_dir, persist, dealt)
        derived = Tables.from_parquet(spark, path).replace(**placed)
        derived.dealt = dealt
        if buckets:
            derived = derived.write_bucketed(scratch_path(spark, "bucketed"), buckets,
                                             "agora_" + uuid.uuid4().hex[:12])
    else:
        derived = Tables.from_frames(derive_tables(spark, sf_dir))
    derived.barred_ids()
    with _LOCK:
        _LOADED[key] = derived
    return derived


_BATCHES: dict[tuple, tuple[Tables, DataFrame]] = {}


def load_batch(t: Tables, name: str) -> DataFrame:
    """A derived command batch, written once as parquet in the shared
    checkpoint folder (as a real batch would arrive: as files) and read
    back, so validators and size checks never recompute its derivation."""
    from agora.sources.commands import SCHEMAS as CMD_SCHEMAS
    from agora.sources.commands import derive_batch

    key = (id(t), name)
    with _LOCK:
        hit = _BATCHES.get(key)
    if hit is not None:
        return hit[1]
    spark = t.spark
    batch = derive_batch(t, name)
    df = written(batch.select([F.col(f.name).cast(f.dataType) for f in CMD_SCHEMAS[name].fields]), scratch_path(spark, f"batch-{name}"))
    released(spark)
    with _LOCK:
        _BATCHES[key] = (t, df)  # holds t, so that its id stays its own
    return df
