"""Incremental processing: a work-item ledger with leases and fencing tokens.

Items carry events, and one fold (``fold``) gives their state:

* ``pending``  opened (registered, failed, extracted anew) after it was last done, and not leased, or with an expired lease;
* ``leased``   opened last by a lease that has not expired;
* ``done``     done by the holder of its newest token.

Tokens order the events of an item.  In ``WorkLedger`` they are commit versions; in the logs of runs (``ledger``) they are
moments.  Every fold is an aggregate with map-side combine, so an item or file that holds a third of all rows costs no
more than any other; nothing is collected.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import table

#: How long a run may stay silent before its leases return to pending.
LEASE = dt.timedelta(hours=6)


def norm_status(c: Column | str) -> Column:
    """Status without case and Unicode padding; null stays null."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def fold(events: DataFrame, keys: list[str], now: dt.datetime | None) -> DataFrame:
    """(keys, state, token, done_token) of events (keys, kind open|lease|done, token, until).

    The newest event that opens the item (open or lease) gives its token.  It is done where a done event has that token or
    a newer one: a writer whose lease was taken over carries an older token and is rejected.  It is leased while its newest
    opening is a lease with ``until`` after ``now``; None takes all leases as expired.
    """
    opens = F.col("kind") != "done"
    got = events.groupBy(*keys).agg(
        F.max(F.when(opens, F.struct("token", (F.col("kind") == "open").alias("open"), F.col("kind").alias("how"), "until"))).alias("top"), F.max(F.when(~opens, F.col("token"))).alias("done_token")
    )
    done = F.col("done_token") >= F.coalesce(F.col("top.token"), F.col("done_token"))
    held = F.lit(False) if now is None else (F.col("top.how") == "lease") & (F.col("top.until") > F.lit(now))
    return got.select(
        *keys, F.when(F.coalesce(done, F.lit(False)), "done").when(F.coalesce(held, F.lit(False)), "leased").otherwise("pending").alias("state"),
        F.coalesce(F.col("top.token"), F.lit(0)).cast("long").alias("token"), "done_token",
    )


def ledger(extractions: DataFrame, page_status: DataFrame, run_log: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """The state of every page of every extracted file: pdf_path, page_num, state.

    Each row of page_status is an event of its page: done or open.  The newest extraction of a file opens all its pages, and a
    run on it that has not finished leases them from its start until LEASE after it wrote last.  Tokens are moments in
    microseconds, an opening after a done of the same moment, an extraction before it.  ``now`` decides which leases have
    expired; None takes all as expired (the next run starts after all others).  A page of a file without extraction is no
    item.  How the run ended, and nothing else in run_log, changes a page that is done.  Rows without pdf_path, page_num or
    updated_at name no page or no moment and are left out; a null status counts as not done.
    """
    files = extractions.where("pdf_path is not null").groupBy("pdf_path").agg(F.max("created_at").alias("created_at"))
    rows = page_status.where("pdf_path is not null and page_num is not null and updated_at is not null")
    done = F.coalesce(norm_status("status") == "done", F.lit(False))
    micros = lambda c: 2 * F.unix_micros(F.col(c).cast("timestamp"))
    events = rows.select(
        "pdf_path", "page_num", F.when(done, "done").otherwise("open").alias("kind"), F.when(done, micros("updated_at")).otherwise(micros("updated_at") + 1).alias("token"), F.lit(None).cast("timestamp_ntz").alias("until")
    )
    state = fold(events, ["pdf_path", "page_num"], now)
    held = F.lit(False)
    if now is not None:
        # a row a run, then a row a file: its lease that lasts longest
        runs = run_log.where("run_id is not null").groupBy("run_id", "pdf_path").agg(F.max("started_at").alias("start"), F.max("finished_at").alias("end")).where("end is null")
        beats = rows.groupBy("run_id").agg(F.max("updated_at").alias("beat"))
        until = F.greatest("start", "beat") + F.expr(f"interval {int(LEASE.total_seconds())} seconds")
        leases = runs.join(beats, "run_id", "left").groupBy("pdf_path").agg(F.max(F.struct(until.alias("until"), "start")).alias("lease"))
        files = files.join(leases, "pdf_path", "left")
        held = F.coalesce((F.col("lease.until") > F.lit(now)) & (2 * F.unix_micros(F.col("lease.start").cast("timestamp")) + 1 >= F.col("token")), F.lit(False))
    again = F.coalesce(F.col("done_token") < micros("created_at"), F.lit(False))
    joined = state.join(files, "pdf_path")
    return joined.select("pdf_path", "page_num", F.when((F.col("state") == "done") & ~again, "done").when(held, "leased").otherwise("pending").alias("state"))


def due(extractions: DataFrame, page_status: DataFrame, run_log: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """(pdf_path, page_num) of the pages the next run has to process."""
    return ledger(extractions, page_status, run_log, now).where("state = 'pending'").select("pdf_path", "page_num")


class LedgerConflict(RuntimeError):
    """Too many others committed at the same time."""


class WorkLedger:
    """Work items in a shared folder: events in Parquet, made valid by numbered commits.

    Events: (item STRING, kind lease|done|open, token BIGINT, owner STRING, at TIMESTAMP, until TIMESTAMP).  A writer puts
    its events below a path made from its own name, then creates the file of the next version, which only one writer can
    (create-if-absent of the file system); one that comes too late reads the new state and tries again.  What is not
    committed is not read.  The token of a lease is the version of its commit, so no two leases share one, and a ``done``
    counts only where its token is the newest of its item.  A call repeated with the same owner and batch finds its commit and
    gives the same result.
    """

    SCHEMA = "item string, kind string, token long, owner string, at timestamp_ntz, until timestamp_ntz"
    TRIES = 100

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._log = self._path("log")
        self._fs = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._log)

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _commits(self) -> dict[int, str]:
        """Data folder of each version. A commit is a batch of items, so their number is that of batches."""
        out = {}
        for s in self._fs.listStatus(self._log):
            version, _, name = s.getPath().getName().partition(".")
            if version.isdigit():
                out[int(version)] = name
        return out

    def _commit(self, version: int, name: str) -> bool:
        """Takes a version for the data folder ``name``; False where another has it."""
        # the version alone is the claim; the file that names the data follows, and a claim without it is void after the data's writer is gone
        try:
            self._fs.create(self._path("claims", f"{version:020d}"), False).close()
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        self._fs.create(self._path("log", f"{version:020d}.{name}"), True).close()
        return True

    def _claimed(self) -> int:
        at = self._path("claims")
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()], default=0) if self._fs.exists(at) else 0

    def events(self) -> DataFrame:
        """All committed events; none at first."""
        names = sorted(set(self._commits().values()))
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/data/{n}" for n in names])

    def state(self, items: DataFrame, now: dt.datetime) -> DataFrame:
        """item, state, token (newest so far, 0 for none) of each distinct non-null item."""
        known = fold(self.events(), ["item"], now)
        return items.select("item").where("item is not null").distinct().join(known, "item", "left").select(
            "item", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("token", F.lit(0)).cast("long").alias("token")
        )

    @staticmethod
    def _name(owner: str, batch: str, kind: str) -> str:
        return hashlib.sha256(json.dumps([owner, batch, kind]).encode()).hexdigest()[:32]

    def _mine(self, owner: str, batch: str, kind: str) -> DataFrame | None:
        """The events of an earlier call with the same owner, batch and kind."""
        base = self._name(owner, batch, kind)
        for name in self._commits().values():
            if name.startswith(base):
                return self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/data/{name}")
        return None

    def lease(self, items: DataFrame, owner: str, batch: str, now: dt.datetime, length: dt.timedelta = LEASE) -> DataFrame:
        """Leases every pending item for ``owner``; gives (item, token). Repeated, it gives what it gave, as far as the items are still its own."""
        for _ in range(self.TRIES):
            if (mine := self._mine(owner, batch, "lease")) is not None:
                top = self.state(mine, now).select("item", F.col("token").alias("newest"))
                return mine.join(top, "item").where("token = newest").select("item", "token")
            version = self._claimed() + 1
            got = self.state(items, now).where("state = 'pending'").select(
                "item", F.lit("lease").alias("kind"), F.lit(version).cast("long").alias("token"), F.lit(owner).alias("owner"),
                F.lit(now).cast("timestamp_ntz").alias("at"), F.lit(now + length).cast("timestamp_ntz").alias("until"),
            )
            name = f"{self._name(owner, batch, 'lease')}-{version:020d}"
            got.write.mode("overwrite").parquet(f"{self.folder}/data/{name}")
            self._commit(version, name)
        raise LedgerConflict(f"{owner} {batch}")

    def finish(self, leased: DataFrame, owner: str, batch: str, now: dt.datetime, ok: bool = True) -> None:
        """Records the items of ``leased`` (item, token) as done, or (not ok) opens them again under the same token."""
        kind = "done" if ok else "open"
        for _ in range(self.TRIES):
            if self._mine(owner, batch, kind) is not None:
                return
            version = self._claimed() + 1
            name = f"{self._name(owner, batch, kind)}-{version:020d}"
            leased.select("item", F.lit(kind).alias("kind"), "token", F.lit(owner).alias("owner"), F.lit(now).cast("timestamp_ntz").alias("at"), F.lit(None).cast("timestamp_ntz").alias("until")).write.mode("overwrite").parquet(f"{self.folder}/data/{name}")
            self._commit(version, name)
        raise LedgerConflict(f"{owner} {batch}")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that the next run has to process."""
    t = {n: table(spark, sf_dir, n) for n in ("extractions", "page_status", "run_log")}
    return due(t["extractions"], t["page_status"], t["run_log"])


def as_of(logs: dict[str, DataFrame], now: dt.datetime) -> dict[str, DataFrame]:
    """The logs as they stood at a moment: later rows left out, runs that ended later not yet ended."""
    at = F.lit(now)
    runs = logs["run_log"].where(F.col("started_at") <= at).withColumn("finished_at", F.when(F.col("finished_at") <= at, F.col("finished_at")))
    return {"extractions": logs["extractions"].where(F.col("created_at") <= at), "page_status": logs["page_status"].where(F.col("updated_at") <= at), "run_log": runs}


def p7_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by state, and how many of each had been marked done once, at the moment when a run that never ended wrote last."""
    t = {n: table(spark, sf_dir, n) for n in ("extractions", "page_status", "run_log")}
    dead = t["run_log"].groupBy("run_id").agg(F.max("finished_at").alias("f")).where("f is null and run_id is not null")
    now = t["page_status"].join(dead, "run_id", "left_semi").agg(F.max("updated_at")).first()[0] or dt.datetime(2000, 1, 1)
    t = as_of(t, now)
    once = t["page_status"].where(norm_status("status") == "done").select("pdf_path", "page_num").distinct().withColumn("once", F.lit(1))
    return (
        ledger(t["extractions"], t["page_status"], t["run_log"], now).join(once, ["pdf_path", "page_num"], "left")
        .groupBy("state").agg(F.count("*").alias("pages"), F.count("once").alias("done_once"))
    )


QUERIES = {"p7_found": p7_found, "p7_ledger": p7_ledger}

_LAST = """
with ps as (
  select distinct pdf_path, page_num, coalesce(regexp_replace(lower(status), '^\\s+|\\s+$', '', 'g'), '') as s, updated_at
  from page_status where pdf_path is not null and page_num is not null and updated_at is not null
), ranked as (
  select *, row_number() over (partition by pdf_path, page_num order by updated_at desc, case when s = 'done' then 1 else 0 end, s desc) as rn from ps
), ex as (select pdf_path, max(created_at) as created_at from extractions where pdf_path is not null group by 1),
items as (
  select pdf_path, page_num, case when s = 'done' and not coalesce(updated_at < created_at, false) then 'done' else 'pending' end as state
  from ranked join ex using (pdf_path) where rn = 1
)
"""

SQL = {
    "p7_found": _LAST + "select pdf_path, page_num from items where state = 'pending'",
    "p7_ledger": """
      with m as (select max(updated_at) as now from page_status where run_id in (select run_id from run_log where run_id is not null group by 1 having max(finished_at) is null)),
      ps as (select run_id, pdf_path, page_num, coalesce(regexp_replace(lower(status), '^\\s+|\\s+$', '', 'g'), '') = 'done' as d, updated_at from page_status, m where pdf_path is not null and page_num is not null and updated_at <= now),
      ex as (select pdf_path, max(created_at) as created_at from extractions, m where pdf_path is not null and created_at <= now group by 1),
      runs as (select run_id, pdf_path, max(started_at) as s, max(case when finished_at <= now then finished_at end) as f from run_log, m where run_id is not null and started_at <= now group by 1, 2),
      beats as (select run_id, max(updated_at) as b from ps group by 1),
      le as (select pdf_path, until, s from (select pdf_path, greatest(s, b) + interval 6 hours as until, s, row_number() over (partition by pdf_path order by greatest(s, b) desc, s desc) as rn from runs left join beats using (run_id) where f is null) where rn = 1),
      pg as (select pdf_path, page_num, max(case when d then updated_at end) as u, max(case when not d then updated_at end) as o from ps group by 1, 2),
      st as (select case when u is not null and (o is null or u > o) and not u < created_at then 'done' when until > (select now from m) and (o is null or s >= o) then 'leased' else 'pending' end as state, u
        from pg join ex using (pdf_path) left join le using (pdf_path))
      select state, count(*) as pages, count(u) as done_once from st group by 1""",
}
