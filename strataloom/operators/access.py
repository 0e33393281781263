"""Permissions, access modes and the codes of upstream errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def permissions(admin: Column, maintain: Column, push: Column, triage: Column, pull: Column) -> Column:
    """struct<admin, maintain, push, triage, pull, role, can_write, can_read>; missing flags are false, but pull is true."""
    no = lambda c: F.coalesce(c, F.lit(False))
    role = F.when(no(admin), "admin").when(no(maintain), "maintain").when(no(push), "write").when(no(triage), "triage").otherwise("read")
    return F.struct(
        no(admin).alias("admin"), no(maintain).alias("maintain"), no(push).alias("push"), no(triage).alias("triage"), F.coalesce(pull, F.lit(True)).alias("pull"), role.alias("role"), (no(push) | no(maintain) | no(admin)).alias("can_write"), F.lit(True).alias("can_read")
    )


def access(can_write: Column, is_private: Column, covers_source: Column, has_installation: Column) -> Column:
    """struct<mode, can_fork, note>: a fork needs a public source that the viewer's own installation covers."""
    lacks = lambda c: F.coalesce(~c, F.lit(False))
    note = F.when(is_private, "private").when(lacks(has_installation), "not-installed").when(lacks(covers_source), "not-covered")
    return F.struct(F.when(can_write, "read_write").otherwise("read_only").alias("mode"), (can_write | note.isNull()).alias("can_fork"), F.when(~can_write, note).alias("note"))


def upstream_error(status: Column, message: Column, remaining: Column, resource: Column) -> Column:
    """The code of a failed request by status, message, rate left and resource."""
    says = lambda p: F.coalesce(message, F.lit("")).rlike(f"(?i){p}")
    missing = F.when(resource == "repository", "REPO_NOT_FOUND").otherwise("NOT_FOUND")
    return (
        F.when(status == 401, "AUTH_EXPIRED")
        .when((status == 403) & (F.coalesce(remaining == "0", F.lit(False)) | says("rate limit|secondary rate")), "RATE_LIMIT")
        .when(status == 403, "FORBIDDEN")
        .when(status == 404, missing)
        .when(status == 409, "CONFLICT")
        .when((status == 422) & says("already exists|no commits between"), "CONFLICT")
        .when(status == 422, "BAD_REQUEST")
        .when(status == 451, "FORBIDDEN")
        .otherwise("UPSTREAM")
    )


def visibility(private: Column, stated: Column) -> Column:
    return F.when(F.coalesce(private, F.lit(False)), "private").when(F.coalesce(stated, F.lit("")) != "", stated).otherwise("public")


def pull_state(state: Column, merged_at: Column) -> Column:
    return F.when(merged_at.isNotNull(), "merged").otherwise(state)
