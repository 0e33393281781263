"""The job table: reuse, claim, recovery, and admission under a token limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.upserts import ISSUE_CHARS
from strataloom.operators.windows import stale
from strataloom.plans.session import ship

# Minutes until a claim or a running job is stale, share of the token limit that is used, its least.
CLAIM_STALE, STUCK, USED_SHARE, LEAST_LIMIT, WINDOW_S = 5, 10, 0.95, 1000, 60
ACTIVE = ("queued", "running")


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (repository_id, kind, force, ..) with reused_id: the newest active job of the same repository and kind, unless forced."""
    active = jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("repository_id", "kind").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("active"))
    return wanted.join(active, ["repository_id", "kind"], "left").withColumn("reused_id", F.when(~F.col("force"), F.col("active"))).drop("active")


def claimable(now: Column) -> Column:
    return (F.col("status") == "queued") | ((F.col("status") == "running") & stale(F.col("heartbeat_at"), now, CLAIM_STALE))


def claim(jobs: DataFrame, now: Column, worker: str) -> DataFrame:
    """jobs with the oldest claimable one running for `worker`. One writer at a time, as for any table rewrite."""
    oldest = jobs.filter(claimable(now)).orderBy("created_at", "job_id").limit(1).select("job_id", F.lit(True).alias("mine"))
    out = jobs.join(F.broadcast(oldest), "job_id", "left")
    put = lambda c, v: F.when(F.col("mine"), v).otherwise(F.col(c))
    return out.withColumns({"status": put("status", F.lit("running")), "attempts": put("attempts", F.col("attempts") + 1), "locked_by": put("locked_by", F.lit(worker)), "heartbeat_at": put("heartbeat_at", now)}).drop("mine")


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    stuck = (F.col("status") == "running") & stale(F.col("heartbeat_at"), now, STUCK)
    return jobs.withColumns({"status": F.when(stuck, "queued").otherwise(F.col("status")), "locked_by": F.when(stuck, F.lit("")).otherwise(F.col("locked_by"))})


def finish(jobs: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """jobs with those of `ended` (job_id, error) over: completed where the error is null, and otherwise failed with it.

    ended holds a job once. A failed full index marks its repository by failed_repositories.
    """
    out = jobs.join(ended.select("job_id", F.lit(True).alias("__over"), F.substring("error", 1, ISSUE_CHARS).alias("message")), "job_id", "left")
    put = lambda c, v: F.when(F.col("__over"), v).otherwise(F.col(c))
    state = F.when(F.col("message").isNull(), "completed").otherwise("failed")
    return out.withColumns({"status": put("status", state), "heartbeat_at": put("heartbeat_at", now), "completed_at": F.when(F.col("__over"), now)}).drop("__over")


def failed_repositories(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'failed' AND kind = 'full_index'").select("repository_id").distinct()


def token_limit(tpm: Column) -> Column:
    return F.greatest(F.lit(LEAST_LIMIT), F.floor(tpm * USED_SHARE + 0.5)).cast("long")


def admit(requests: DataFrame, key: str, limit: int, max_wait_s: float, buckets: int | None = None) -> DataFrame:
    """requests (key, request_id, at double seconds, tokens) with started (null when rejected) and waited.

    A request starts once the tokens started within the last WINDOW_S seconds and its own stay within the limit, in
    the order of arrival; one that would wait beyond max_wait_s is rejected. The decision depends on all before it,
    so a key is one stream: rows are sorted by Spark, and the state is the started requests of one window.
    """
    ship(requests.sparkSession)
    sorted_ = requests.repartition(key) if buckets is None else requests.repartition(buckets, key)
    sorted_ = sorted_.sortWithinPartitions(key, "at", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, live, clock = None, [], 0.0
        for b in batches:
            started = []
            for k, at, tokens in zip(b[key], b["at"], b["tokens"], strict=True):
                if k != now_key:
                    now_key, live, clock = k, [], float("-inf")
                t = max(at, clock)
                live = [x for x in live if t - x[0] < WINDOW_S]
                waiting = list(live)
                while waiting and sum(x[1] for x in waiting) + tokens > limit:
                    t = max(t, waiting.pop(0)[0] + WINDOW_S)
                if t - at > max_wait_s:
                    started.append(None)
                    continue
                live, clock = [*[x for x in live if t - x[0] < WINDOW_S], (t, tokens)], t
                started.append(t)
            yield b.assign(started=pd.Series(started, index=b.index, dtype="float64"))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    out = sorted_.mapInPandas(run, f"{kept}, started double")
    out = out.withColumn("started", F.nanvl("started", F.lit(None).cast("double")))
    return out.withColumn("waited", F.col("started") - F.col("at"))


def freshness(indexed_sha: Column, head_sha: Column) -> Column:
    return F.coalesce((indexed_sha != "") & (indexed_sha != head_sha), F.lit(False))


def index_needed(status: Column, indexed_sha: Column, head_sha: Column, force: Column) -> Column:
    return ~(status.isin("indexed", "partial") & (indexed_sha == head_sha)) | force


def cache_state(stored_sha: Column, indexed_sha: Column) -> Column:
    return F.when(F.coalesce(stored_sha, F.lit("")) == "", "missing").when(stored_sha == indexed_sha, "ready").otherwise("stale")
