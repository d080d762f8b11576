"""Run state and caches as logs: upserts are the latest row of a key, insert-or-ignore the first."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.ledger import norm_status
from leafmill.session import cut, table

C = F.col


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, by aggregate; remaining ties by all other columns."""
    rest = [c for c in log.columns if c not in keys + order]
    return log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*keys, *[C(f"_x.{c}").alias(c) for c in order + rest])


def first(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is first in ``order``."""
    rest = [c for c in log.columns if c not in keys + order]
    return log.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_x")).select(*keys, *[C(f"_x.{c}").alias(c) for c in order + rest])


def append(state: DataFrame, path: str) -> None:
    """Adds rows to a log in a folder; one atomic commit a call."""
    state.write.mode("append").parquet(path)


def page_states(log: DataFrame) -> DataFrame:
    """The newest state of (run_id, pdf_path, page_num)."""
    return latest(log.select("run_id", "pdf_path", "page_num", norm_status("status").alias("status"), "updated_at"), ["run_id", "pdf_path", "page_num"], ["updated_at"])


def done(log: DataFrame) -> DataFrame:
    """(run_id, pdf_path, page_num) that are done."""
    return page_states(log).where("status = 'done'").select("run_id", "pdf_path", "page_num")


def cache(log: DataFrame, by_prompt: bool = False) -> DataFrame:
    """The stored answers: the first of each content, or of each content, prompt and model."""
    keys = ["content_hash", "prompt_hash", "model"] if by_prompt else ["content_hash"]
    return first(log, keys, ["created_at"])


def stale(seen: Column, changed: Column) -> Column:
    """Whether an extraction is missing or older than its file; both are UTC."""
    return seen.isNull() | (changed > seen)


def delete(log: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The log without the rows of ``keys``."""
    return log.join(keys.select(*on).distinct(), on, "left_anti")


def clear(path: str, spark: SparkSession) -> None:
    """Removes a log's folder with all that is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _without(kind, heavy: tuple[str, ...]):
    """A structure with its heavy fields null."""
    return lambda x: F.struct(*[(F.lit(None).cast(f.dataType) if f.name in heavy else x[f.name]).alias(f.name) for f in kind.fields])


def slim(df: DataFrame, heavy: tuple[str, ...] = ("rendered_image", "image_bytes", "data", "content")) -> DataFrame:
    """``df`` without its heavy columns, those inside arrays of structures included: these keep their place with null."""
    out = []
    for f in df.schema.fields:
        if f.name in heavy and f.dataType.typeName() == "binary":
            continue
        inner = getattr(f.dataType, "elementType", None)
        if inner is not None and inner.typeName() == "struct" and any(x.name in heavy for x in inner.fields):
            out.append(F.transform(f.name, _without(inner, heavy)).alias(f.name))
        else:
            out.append(C(f.name))
    return df.select(*out)


class Store:
    """Extractions, runs and page states below one folder.

    Each extraction is a Parquet folder of its own named by its path's hash and moment; the log that points to it is appended
    last, in one commit, so a writer that fails leaves nothing that is read.  What is heavy is left out (``slim``).
    """

    EXTRACTIONS = "pdf_path string, created_at timestamp, place string"
    RUNS = "run_id string, pdf_path string, started_at timestamp, finished_at timestamp, status string, pages_total int, pages_done int"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def save(self, pdf_path: str, pages: DataFrame, now: dt.datetime) -> None:
        """Keeps what was extracted from a file; a later one of the same file replaces it."""
        place = f"{self.folder}/data/{hashlib.sha256(pdf_path.encode()).hexdigest()[:24]}-{now:%Y%m%dT%H%M%S%f}"
        slim(pages).write.mode("overwrite").parquet(place)
        append(self.spark.createDataFrame([(pdf_path, now, place)], self.EXTRACTIONS), f"{self.folder}/extractions")

    def load(self, pdf_path: str, changed: dt.datetime | None = None) -> DataFrame | None:
        """The newest extraction of a file; None where there is none, or where the file changed after it."""
        got = latest(self._log("extractions", self.EXTRACTIONS).where(C("pdf_path") == pdf_path), ["pdf_path"], ["created_at"]).first()
        if got is None or got.place is None or changed is not None and changed > got.created_at:
            return None
        return self.spark.read.parquet(got.place)

    def delete(self, pdf_path: str | None = None) -> None:
        """Forgets one file, or all; what was kept of it is removed."""
        log = self._log("extractions", self.EXTRACTIONS)
        if pdf_path is None:
            clear(f"{self.folder}/extractions", self.spark)
            clear(f"{self.folder}/data", self.spark)
            return
        for r in log.where(C("pdf_path") == pdf_path).collect():  # the extractions of one file
            clear(r.place, self.spark)
        append(self.spark.createDataFrame([(pdf_path, dt.datetime.max.replace(year=9000), None)], self.EXTRACTIONS), f"{self.folder}/extractions")

    def start(self, run_id: str, pdf_path: str, now: dt.datetime, pages: int | None = None) -> None:
        """Enters a run as running."""
        append(self.spark.createDataFrame([(run_id, pdf_path, now, None, "running", pages, 0)], self.RUNS), f"{self.folder}/runs")

    def finish(self, run_id: str, now: dt.datetime, ok: bool, done: int) -> None:
        """Enters the end of a run: complete or failed."""
        r = self.runs().where(C("run_id") == run_id).first()
        if r is None:
            raise KeyError(run_id)
        append(self.spark.createDataFrame([(run_id, r.pdf_path, r.started_at, now, "complete" if ok else "failed", r.pages_total, done)], self.RUNS), f"{self.folder}/runs")

    def runs(self) -> DataFrame:
        """The newest state of every run."""
        return latest(self._log("runs", self.RUNS), ["run_id"], ["started_at", "finished_at"]).select("run_id", "pdf_path", "started_at", "finished_at", "status", "pages_total", "pages_done")


# --- queries -------------------------------------------------------------------------------------------------------


def status_upsert_latest(spark, d):
    """Newest state of every page of every run."""
    return page_states(table(spark, d, "page_status"))


def done_pages(spark, d):
    """Done pages of every run and file."""
    return done(table(spark, d, "page_status")).groupBy("run_id", "pdf_path").agg(F.count("*").alias("pages"))


def resume_anti_join(spark, d):
    """Pages registered in any run that are done in none."""
    log = table(spark, d, "page_status")
    return delete(log.select("pdf_path", "page_num").distinct(), done(log), ["pdf_path", "page_num"])


def cache_insert_ignore(spark, d):
    """Stored answers by content."""
    return cache(table(spark, d, "api_cache")).select("content_hash", "model", "prompt_hash", F.md5("response").alias("response"))


def cache_lookup(spark, d):
    """Requests by model, answered from the cache or not: every fifth asks with another model."""
    log = table(spark, d, "api_cache")
    ask = log.select("content_hash", "prompt_hash", F.expr("case when length(response) % 5 = 0 then 'none' else model end").alias("model"))
    hit = cache(log).select("content_hash", "prompt_hash", "model", F.lit(1).alias("hit"))
    return ask.join(hit, ["content_hash", "prompt_hash", "model"], "left").groupBy("model").agg(F.count("*").alias("asked"), F.count("hit").alias("hits"))


def cache_invalidate(spark, d):
    """Files of the run log by whether their newest extraction is missing or older than their last start."""
    files = table(spark, d, "run_log").groupBy("pdf_path").agg(F.max("started_at").alias("changed"))
    seen = table(spark, d, "extractions").groupBy("pdf_path").agg(F.max("created_at").alias("seen"))
    return files.join(seen, "pdf_path", "left").select("pdf_path", stale(C("seen"), C("changed")).alias("stale"))


def run_state(spark, d):
    """Newest state of every run."""
    log = table(spark, d, "run_log").select("run_id", "pdf_path", "started_at", "finished_at", "status", "pages_total", "pages_done")
    return latest(log, ["run_id"], ["started_at", "finished_at"])


def history(log: DataFrame, pdf_path: str | None = None) -> DataFrame:
    """Runs, newest first: all of a file, or the last 50 of all."""
    log = log.orderBy(C("started_at").desc(), "run_id")
    return log.limit(50) if pdf_path is None else log.where(C("pdf_path") == pdf_path)


def run_history_top50(spark, d):
    """The last 50 runs."""
    return history(table(spark, d, "run_log").select("run_id", "pdf_path", "started_at").distinct())


def state_delete(spark, d):
    """Page states by run, without those of files that have failed."""
    bad = table(spark, d, "run_log").where("status = 'failed'")
    return delete(page_states(table(spark, d, "page_status")), bad, ["pdf_path"]).groupBy("run_id").agg(F.count("*").alias("pages"))


def state_stats(spark, d):
    """Keys in each of the four logs."""
    one = lambda n, *k: table(spark, d, n).select(*k).distinct().agg(F.count("*").alias("n")).select(F.lit(n).alias("log"), "n")
    return one("extractions", "pdf_path").unionAll(one("page_status", "run_id", "pdf_path", "page_num")).unionAll(one("api_cache", "content_hash")).unionAll(one("run_log", "run_id"))


def state_roundtrip(spark, d):
    """Extractions written and read again, by file."""
    e = cut(table(spark, d, "extractions").select("pdf_path", "created_at", F.length("data_blob").alias("size")))
    return e.groupBy("pdf_path").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("created_at").alias("newest"))


def content_hash(spark, d):
    """Hashes of every extraction's data and of its path."""
    e = table(spark, d, "extractions")
    return e.select("pdf_path", F.sha2("data_blob", 256).alias("sha"), F.substring(F.sha2("pdf_path", 256), 1, 24).alias("key"), F.md5("data_blob").alias("md5")).distinct()


def base64_payload(spark, d):
    """Every extraction's data in base 64."""
    return table(spark, d, "extractions").select("pdf_path", F.base64("data_blob").alias("payload")).distinct()


QUERIES = {f.__name__: f for f in (
    status_upsert_latest, done_pages, resume_anti_join, cache_insert_ignore, cache_lookup, cache_invalidate, run_state, run_history_top50, state_delete, state_stats,
    state_roundtrip, content_hash, base64_payload,
)}
_PS = r"ps as (select run_id, pdf_path, page_num, status, updated_at from (select *, row_number() over (partition by run_id, pdf_path, page_num order by updated_at desc, status desc) as rn from (select run_id, pdf_path, page_num, regexp_replace(lower(status), '^\s+|\s+$', '', 'g') as status, updated_at from page_status)) where rn = 1)"
_CACHE = "cache as (select content_hash, model, prompt_hash, response from (select *, row_number() over (partition by content_hash order by created_at, model, prompt_hash, response) as rn from api_cache) where rn = 1)"
SQL = {
    "status_upsert_latest": f"with {_PS} select * from ps",
    "done_pages": f"with {_PS} select run_id, pdf_path, count(*) as pages from ps where status = 'done' group by 1, 2",
    "resume_anti_join": f"with {_PS} select distinct pdf_path, page_num from page_status p where not exists (select 1 from ps where ps.pdf_path = p.pdf_path and ps.page_num = p.page_num and ps.status = 'done')",
    "cache_insert_ignore": f"with {_CACHE} select content_hash, model, prompt_hash, md5(response) as response from cache",
    "cache_lookup": f"with {_CACHE}, ask as (select content_hash, prompt_hash, case when length(response) % 5 = 0 then 'none' else model end as model from api_cache) select a.model, count(*) as asked, count(c.content_hash) as hits from ask a left join cache c on a.content_hash = c.content_hash and a.prompt_hash = c.prompt_hash and a.model = c.model group by 1",
    "cache_invalidate": "with f as (select pdf_path, max(started_at) as changed from run_log group by 1), e as (select pdf_path, max(created_at) as seen from extractions group by 1) select f.pdf_path, seen is null or changed > seen as stale from f left join e on f.pdf_path = e.pdf_path",
    "run_state": "select run_id, pdf_path, started_at, finished_at, status, pages_total, pages_done from (select *, row_number() over (partition by run_id order by started_at desc, finished_at desc nulls last, pdf_path desc, status desc) as rn from run_log) where rn = 1",
    "run_history_top50": "select distinct run_id, pdf_path, started_at from run_log order by started_at desc, run_id limit 50",
    "state_delete": f"with {_PS} select run_id, count(*) as pages from ps where pdf_path not in (select pdf_path from run_log where status = 'failed') group by 1",
    "state_stats": "select 'extractions' as log, count(distinct pdf_path) as n from extractions union all select 'page_status', count(*) from (select distinct run_id, pdf_path, page_num from page_status) union all select 'api_cache', count(distinct content_hash) from api_cache union all select 'run_log', count(distinct run_id) from run_log",
    "state_roundtrip": "select pdf_path, count(*) as n, sum(octet_length(data_blob))::bigint as size, max(created_at) as newest from extractions group by 1",
    "content_hash": "select distinct pdf_path, sha256(data_blob) as sha, left(sha256(pdf_path), 24) as key, md5(data_blob) as md5 from extractions",
    "base64_payload": "select distinct pdf_path, to_base64(data_blob) as payload from extractions",
}
