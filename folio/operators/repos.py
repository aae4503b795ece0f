"""Tables of repositories: what they are, what to fetch, what to retire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import case, urls
from folio.operators.skew import HOT_ROWS, hot_keys, lookup


def with_repo(rows: DataFrame, url: str = "url") -> DataFrame:
    """Host, owner, name, host kind, storage path and display text of a URL column."""
    parsed = rows.selectExpr("*", f"{urls.parse_repo_url(url)} AS repo")
    fields = parsed.selectExpr(*rows.columns, "repo.host", "repo.owner", "repo.name")
    kinds = fields.selectExpr("*", f"{urls.host_kind('host')} AS host_kind")
    parts = ("host_kind", "host", "owner", "name")
    return kinds.selectExpr(
        "*",
        f"if(host IS NULL, NULL, {urls.storage_path(*parts)}) AS cache_path",
        f"if(host IS NULL, NULL, {urls.repo_display(*parts)}) AS display",
    )


def resolve_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs (input STRING) as corpora: repository URLs by storage path, the rest as paths."""
    return with_repo(inputs, "input").selectExpr(
        "input",
        "cache_path IS NOT NULL AS is_repo",
        "coalesce(cache_path, input) AS root",
        "host",
        "owner",
        "name",
    )


def refresh_plan(repos: DataFrame, snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What to do about each repository: clone, reclone, pull or use.

    A repository is present when its folder holds repository data. Many URLs may name one
    repository, so its rows are spread when there are very many of them.
    """
    present = snapshots.where("has_git").select("cache_path").distinct()
    asked = repos.where("cache_path IS NOT NULL")
    joined = lookup(
        asked,
        present.withColumn("present", F.lit(True)),
        "cache_path",
        "url",
        hot_keys(asked, "cache_path", hot_rows),
    )
    action = case(
        ("present IS NULL", "'clone'"),
        ("policy = 'force_clone'", "'reclone'"),
        ("policy = 'use_cache'", "'use'"),
        otherwise="'pull'",
    )
    return joined.selectExpr("url", "cache_path", "policy", f"{action} AS action")


def expired_snapshots(snapshots: DataFrame, days: int, now_s: int) -> DataFrame:
    """Repositories strictly older than `days`; folders without repository data stay."""
    kinds = ", ".join(f"'{kind}'" for kind in urls.STORAGE_KINDS)
    old = f"{now_s} - modified_s > {days * 86_400}"
    return snapshots.where(f"has_git AND host_kind IN ({kinds}) AND {old}")


def snapshot_retention(snapshots: DataFrame, days: int, now_s: int) -> DataFrame:
    """How many repositories of each kind are to be removed."""
    expired = expired_snapshots(snapshots, days, now_s)
    return expired.groupBy("host_kind").agg(F.expr("count(1) AS removed"))
