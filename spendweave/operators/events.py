"""Infrastructure change events: from pull requests to resources and billing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.functions import codes
from spendweave.functions.rules import lookup
from spendweave.operators.containment import among, containment_pairs
from spendweave.operators.dealing import dealt
from spendweave.operators.ranking import top_per_group
from spendweave.session import stored

EVENT = ["pr_number", "pr_title", "pr_author", "description", "event_date"]


def short_id(event_id):
    """Last ``/`` segment, else last ``:`` segment, of an event's resource id."""
    return F.when(F.contains(event_id, F.lit("/")), F.substring_index(event_id, "/", -1)).when(
        F.contains(event_id, F.lit(":")), F.substring_index(event_id, ":", -1)
    )


def change_event_match(
    events: DataFrame, window_days: int = codes.EVENT_WINDOW_DAYS, by: list[str] | None = None, tasks: int | None = None, ids: DataFrame | None = None,
) -> DataFrame:
    """Last event of each (``by``..., resource id, billing period) within the window around the period start.

    Each event is expanded to the months whose window holds it (at most two for a week), so
    matching resources is an equi-join on id and period. Rows are dealt by both, as the sides of a comparison are, or by id alone over
    so many ``tasks``, as resources are. With ``ids``, stored rows whose ``resource_id`` is all that the result is joined with, rows of
    other ids are dropped before they are dealt (by hash, so a few may stay): an event's full or short id often names nothing billed.
    """
    day = F.col("event_date")
    months = F.sequence(
        F.trunc(F.date_sub(day, window_days), "MM"),
        F.trunc(F.date_add(day, window_days), "MM"),
        F.expr("interval 1 month"),
    )
    near = F.filter(
        months, lambda m: m.between(F.date_sub(day, window_days), F.date_add(day, window_days))
    )
    named = F.array_distinct(F.array_compact(F.array(F.col("resource_id"), short_id(F.col("resource_id")))))
    key = [*(by or []), "resource_id", "current_period_start"]
    near_id = (
        events.where("resource_id is not null and event_date is not null")
        .withColumn("current_period_start", F.explode(near))
        .withColumn("resource_id", F.explode(named))
        .select(*key, "event_seq", *EVENT)
    )
    if ids is not None:
        hashed = F.xxhash64("resource_id").alias("_gram")
        near_id = among(near_id.select("*", hashed), ids.select("resource_id").distinct().select(hashed).distinct()).drop("_gram")
    place = F.struct("event_date", "event_seq", "pr_number")
    last = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct("event_seq", *EVENT), place).alias("_e")).select(*key, "_e.*")
    return dealt(near_id, "resource_id", last, tasks, None if tasks else key).groupBy(*key).agg(F.max_by(F.struct(*EVENT), place).alias("event"))


def tf_diff_changes(files: DataFrame) -> DataFrame:
    """Changes declared in the diffs of ``.tf`` files.

    ``files`` has pr_number, file_seq, filename, status, patch. A file yields its resource blocks;
    without any, its module blocks; without those, itself.
    """
    patch = F.coalesce("patch", F.lit(""))
    block = codes.RESOURCE_BLOCK
    resources = F.arrays_zip(
        F.regexp_extract_all(patch, F.lit(block), F.lit(1)).alias("t"),
        F.regexp_extract_all(patch, F.lit(block), F.lit(2)).alias("n"),
    )
    modules = F.regexp_extract_all(patch, F.lit(codes.MODULE_BLOCK), F.lit(1))
    as_change = lambda kind, name: F.struct(kind.alias("t"), name.alias("n"))
    found = (
        F.when(F.size(resources) > 0, F.transform(resources, lambda r: as_change(r["t"], r["n"])))
        .when(F.size(modules) > 0, F.transform(modules, lambda m: as_change(F.lit("module"), m)))
        .otherwise(F.array(as_change(F.lit("terraform_file"), F.col("filename"))))
    )
    folder = F.when(
        F.contains("filename", F.lit("/")), F.regexp_extract("filename", r"^(.*)/[^/]*$", 1)
    ).otherwise("root")
    return files.where(F.endswith("filename", F.lit(".tf"))).select(
        "pr_number", "file_seq", folder.alias("terraform_module"), F.col("status").alias("action"),
        F.posexplode(found).alias("block_seq", "_b"),
    ).select(
        "pr_number", "file_seq", "block_seq", "terraform_module", "action",
        F.col("_b.t").alias("resource_type"), F.col("_b.n").alias("resource_name"),
    )


def pr_resource_match(prs: DataFrame, changes: DataFrame, resources: DataFrame) -> DataFrame:
    """Distinct (billing period, PR, resource) matches, for the periods a PR falls near.

    ``prs`` has pr_number and billing_period_start (one row per period it may explain). A change
    matches a resource whose module contains its module, whose name contains its name, or whose
    service suits its type while the module contains the last segment of its module.
    """
    period = "billing_period_start"
    explained = prs.select("pr_number", period).distinct()
    # Read by all three rules, so the parsed changes are written once; a change is one row, whatever the periods of its PR.
    mine = stored(changes.join(explained.select("pr_number").distinct(), "pr_number", "left_semi").select(
        "pr_number",
        F.col("terraform_module").alias("change_module"),
        F.lower("resource_name").alias("change_name"),
        F.substring_index("terraform_module", "/", -1).alias("segment"),
        lookup(codes.TYPE_SERVICE_HINTS, F.col("resource_type")).alias("hint"),
    ).distinct(), "pr-changes")
    own = resources.select(
        period, "resource_id", F.nullif("terraform_module", F.lit("")).alias("terraform_module"),
        F.lower("resource_name").alias("name"), F.lower("service_name").alias("service"),
    )
    hints = F.array(*[F.lit(h) for h in codes.TYPE_SERVICE_HINTS.values()])
    hinted = own.withColumn("hint", F.explode(F.filter(hints, lambda h: F.contains(F.col("service"), h))))
    key = [period, "pr_number", "resource_id"]

    def matches(side: DataFrame, text: str, changes: DataFrame, part: str, also: list[str]) -> DataFrame:
        """PRs and resources whose texts match. Texts meet once without PR and period; a PR's matched texts meet its periods last."""
        texts = containment_pairs(side, changes, text, part)
        near = changes.select("pr_number", part, *also).join(texts, part).select("pr_number", text, *also).distinct().join(explained, "pr_number")
        return near.join(side.select(period, "resource_id", text, *also), [period, text, *also]).select(key)

    by_module = matches(own, "terraform_module", mine, "change_module", [])
    by_name = matches(own, "name", mine, "change_name", [])
    by_type = matches(hinted, "terraform_module", mine.where("hint is not null"), "segment", ["hint"])
    return by_module.unionByName(by_name).unionByName(by_type).distinct()


def pr_periods(prs: DataFrame, periods: DataFrame, before: int = 30, after: int = 31) -> DataFrame:
    """PRs with each billing period they were merged around. Periods are months, so a bounded broadcast."""
    day = F.col("merged_at")
    months = F.sequence(
        F.trunc(F.date_sub(day, after), "MM"), F.trunc(F.date_add(day, before), "MM"), F.expr("interval 1 month")
    )
    near = F.filter(months, lambda m: day.between(F.date_sub(m, before), F.date_add(m, after)))
    known = periods.select("billing_period_start").distinct()
    return prs.withColumn("billing_period_start", F.explode(near)).join(F.broadcast(known), "billing_period_start")


def pr_change_events(prs: DataFrame, changes: DataFrame, resources: DataFrame) -> DataFrame:
    """Change events of pull requests per billing period.

    One event per matched resource; a PR that matches none leaves events for its first three changes.
    """
    period = "billing_period_start"
    # Each is read several times. Written once, they are computed once, and no plan holds all of them: the driver keeps every plan's text.
    prs, changes = stored(prs, "prs"), stored(changes, "changes")
    matched = stored(pr_resource_match(prs, changes, resources), "pr-matches")
    place = F.struct("file_seq", "block_seq")
    head = changes.groupBy("pr_number").agg(F.min_by("terraform_module", place).alias("terraform_module"))
    label = F.concat(F.lit("PR #"), F.col("pr_number"), F.lit(": "), F.col("title"))
    facts = ["merged_at", "title", "author", "commit_sha"]
    hits = (
        matched.join(prs.select(period, "pr_number", *facts), [period, "pr_number"])
        .join(head, "pr_number", "left")
        .withColumn("description", label)
    )
    orphans = prs.join(matched.select(period, "pr_number").distinct(), [period, "pr_number"], "left_anti")
    first = top_per_group(changes, ["pr_number"], [F.col("file_seq"), F.col("block_seq")], 3)
    misses = orphans.join(first, "pr_number").withColumn(
        "resource_id", F.concat(F.lit("tf:"), F.col("terraform_module"), F.lit("/"), F.col("resource_name"))
    ).withColumn(
        "description",
        F.concat(
            label, F.lit(" ("), F.col("action"), F.lit(" "), F.col("resource_type"), F.lit("."),
            F.col("resource_name"), F.lit(")"),
        ),
    )
    columns = [
        F.col(period), F.col("resource_id"), F.lit("github_pr").alias("event_type"),
        F.col("merged_at").alias("event_date"), F.col("pr_number"), F.col("title").alias("pr_title"),
        F.col("author").alias("pr_author"), F.col("commit_sha"), F.col("terraform_module"), F.col("description"),
    ]
    return hits.select(columns).unionByName(misses.select(columns))
