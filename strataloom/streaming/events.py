"""Repository events: verification, deduplication, routing and change sets, for batches and streams alike."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom.plans.session import ship

# Events with a handler, reviewed actions, statuses with an index, days that deliveries are remembered.
HANDLED = ("push", "pull_request", "installation", "installation_repositories")
REVIEWED = ("opened", "reopened", "synchronize", "ready_for_review")
INDEXED = ("indexed", "partial")
REMEMBERED = "14 days"

_COMMIT = "added:array<string>,modified:array<string>,removed:array<string>"
PAYLOAD = (
    f"action string, ref string, deleted boolean, `after` string, commits array<struct<{_COMMIT}>>, repository struct<full_name:string>, "
    "pull_request struct<number:int,draft:boolean,head:struct<sha:string>,base:struct<ref:string>>, installation struct<id:bigint>, sender struct<id:bigint>, "
    "repositories_added array<struct<full_name:string>>, repositories_removed array<struct<full_name:string>>"
)


def verified(deliveries: DataFrame, secret: str) -> DataFrame:
    """Deliveries whose signature is the HMAC-SHA256 of the raw body; the others go."""
    ship(deliveries.sparkSession)

    @F.pandas_udf("boolean")
    def valid(body: pd.Series, signature: pd.Series) -> pd.Series:
        expect = body.map(lambda b: "sha256=" + hmac.new(secret.encode(), (b or "").encode(), hashlib.sha256).hexdigest())
        return pd.Series([hmac.compare_digest(e, s or "") for e, s in zip(expect, signature, strict=True)])

    return deliveries.filter(valid("payload", "signature"))


def once(deliveries: DataFrame) -> DataFrame:
    """Each delivery id once within the days it is remembered; streams keep their state behind the watermark."""
    if deliveries.isStreaming:
        return deliveries.withWatermark("received_at", REMEMBERED).dropDuplicatesWithinWatermark(["delivery_id"])
    cols = [c for c in deliveries.columns if c != "delivery_id"]
    first = deliveries.filter("delivery_id IS NOT NULL").groupBy("delivery_id").agg(F.min_by(F.struct(*cols), "received_at").alias("d")).select("delivery_id", "d.*")
    return first.unionByName(deliveries.filter("delivery_id IS NULL"))


def change_set(commits: Column) -> Column:
    """struct<added, modified, removed> over all commits, each path once; what is removed is neither of the others."""
    none = F.array().cast("array<string>")
    every = lambda f: F.array_distinct(F.flatten(F.transform(F.coalesce(commits, F.array().cast(f"array<struct<{_COMMIT}>>")), lambda c: F.coalesce(c[f], none))))
    gone = every("removed")
    return F.struct(F.array_except(every("added"), gone).alias("added"), F.array_except(every("modified"), gone).alias("modified"), gone.alias("removed"))


def route(deliveries: DataFrame, repositories: DataFrame) -> DataFrame:
    """Deliveries (delivery_id, event, payload, ..) with outcome, reason, branch, kind and the change set.

    repositories: full_name, indexing_status, indexed_branch, default_branch; a stream is joined with them as they
    are. Rules apply in order; outcome is queued, processed or ignored.
    """
    rows = deliveries.withColumn("p", F.from_json("payload", PAYLOAD))
    known = repositories.select(F.col("full_name").alias("__repo"), "indexing_status", F.when(F.coalesce("indexed_branch", F.lit("")) != "", F.col("indexed_branch")).otherwise(F.col("default_branch")).alias("__branch"))
    rows = rows.withColumn("__repo", F.col("p.repository.full_name")).join(known, "__repo", "left").withColumn("changes", change_set(F.col("p.commits")))
    event, action, status = F.col("event"), F.coalesce(F.col("p.action"), F.lit("")), F.col("indexing_status")
    ref = F.coalesce(F.col("p.ref"), F.lit(""))
    branch = F.substring(ref, F.lit(12), F.length(ref))
    say = lambda text, *cols: F.format_string(text, *[F.coalesce(c, F.lit("")) for c in cols])
    empty = F.size("changes.added") + F.size("changes.modified") + F.size("changes.removed") == 0
    push = (
        F.when(~ref.startswith("refs/heads/"), say("non-branch ref %s", ref))
        .when(F.coalesce(F.col("p.deleted"), F.lit(False)), "branch deleted")
        .when(~F.coalesce(F.col("__repo"), F.lit("")).rlike("^[^/]+/[^/]+"), "no repository")
        .when(status.isNull(), "untracked repository")
        .when(~status.isin(*INDEXED), say("index status %s", status))
        .when(branch != F.col("__branch"), say("push to %s, indexed %s", branch, F.col("__branch")))
        .when(empty, "no file changes")
    )
    pull = (
        F.when(~action.isin(*REVIEWED), say("action %s", action))
        .when(F.coalesce(F.col("p.pull_request.draft"), F.lit(False)) & (action != "ready_for_review"), "draft")
        .when(status.isNull(), "untracked repository")
        .when(~status.isin(*INDEXED), say("index status %s", status))
    )
    install = F.when(F.col("p.installation.id").isNull() | F.col("p.sender.id").isNull(), "incomplete").when(~action.isin("created", "deleted", "suspend"), say("action %s", action))
    reason = F.when(event == "ping", "ping").when(~event.isin(*HANDLED), say("unhandled event %s", event)).when(event == "push", push).when(event == "pull_request", pull).when(event == "installation", install)
    done = event.isin("installation", "installation_repositories")
    rows = rows.withColumn("reason", reason)
    outcome = F.when(event == "ping", "processed").when(F.col("reason").isNotNull(), "ignored").when(done, "processed").otherwise("queued")
    kind = F.when(F.col("outcome") == "queued", F.when(event == "push", "incremental_sync").otherwise("pr_review"))
    rows = rows.withColumn("outcome", outcome).withColumns({"kind": kind, "branch": F.when(event == "push", branch), "forced": (event == "push") | (action == "synchronize")})
    return rows.withColumn("repository", F.col("__repo")).drop("p", "__repo", "__branch", "indexing_status")


def status_stream(statuses: DataFrame, key: str, status: str) -> DataFrame:
    """Rows of a stream of statuses whose value differs from the last one of the key."""
    ship(statuses.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in statuses.schema)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for b in batches:
            before = b[status].shift(fill_value=last)
            last = b[status].iloc[-1] if len(b) else last
            yield b[b[status] != before]
        state.update((last,))

    return statuses.groupBy(key).applyInPandasWithState(step, kept, "last string", "append", GroupStateTimeout.NoTimeout)


def rate_windows(requests: DataFrame, keys: list[str], ts: str, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """keys, window_start (seconds), n, rejected: requests of each fixed window and those beyond the limit; a batch or a stream.

    A stream keeps the windows in its state, gives them anew as they grow (update mode), and closes them when its
    watermark, `late` behind the newest request, has passed their end: a request for a closed window is dropped and
    not counted. A request without a time has no window.
    """
    rows = requests.withColumn("__at", F.col(ts).cast("timestamp")).filter("__at IS NOT NULL")
    rows = rows.withWatermark("__at", late) if rows.isStreaming else rows
    counted = rows.groupBy(*keys, F.window("__at", f"{seconds} seconds").alias("__w")).agg(F.count("*").alias("n"))
    start = F.unix_seconds("__w.start").alias("window_start")
    return counted.select(*keys, start, "n", F.greatest(F.lit(0), F.col("n") - most).alias("rejected"))


def sync(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run apply(queued changes, batch) on each micro-batch of routed push events."""

    def batch(df: DataFrame, n: int) -> None:
        apply(df.filter("outcome = 'queued' AND kind = 'incremental_sync'"), n)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()
