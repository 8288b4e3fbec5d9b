"""Period pairs and the two sides of a comparison."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.functions.numbers import parse_period
from spendweave.schemas import PAIR

# A side's rows are keyed by resource and the current period of their pair.
SIDE_KEY = ["resource_id", PAIR[1]]
CARRIED = [
    "resource_name", "service_name", "service_category", "region", "team", "cost_center",
    "in_terraform_state", "terraform_module", "iac_source",
]
SIGNALS = ["charge_types", "description", "other_tool"]


def consecutive_pairs(periods: DataFrame) -> DataFrame:
    """Each observed month with the next observed one. The list of months is bounded by the calendar.

    This and the other pair makers give every current period exactly one prior period.
    """
    months = periods.agg(F.array_sort(F.collect_set("billing_period_start")).alias("m")).where(F.size("m") >= 2)
    earlier = F.expr("slice(m, 1, size(m) - 1)")
    later = F.expr("slice(m, 2, size(m) - 1)")
    return months.select(F.explode(F.arrays_zip(earlier.alias("p"), later.alias("c"))).alias("z")).select(
        F.col("z.p").alias(PAIR[0]), F.col("z.c").alias(PAIR[1])
    )


def one_pair(spark: SparkSession, prior: str | date, current: str | date) -> DataFrame:
    prior = parse_period(prior) if isinstance(prior, str) else prior
    current = parse_period(current) if isinstance(current, str) else current
    return spark.range(1).select(F.lit(prior).alias(PAIR[0]), F.lit(current).alias(PAIR[1]))


def last_year_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs re-aimed at the same month of the year before."""
    return pairs.select(F.add_months(PAIR[1], -12).alias(PAIR[0]), PAIR[1]).distinct()


def side(resources: DataFrame, pairs: DataFrame, role: str) -> DataFrame:
    """Resources of one side of every pair, with their signals if they have them. Pairs are months, so broadcasting them is bounded."""
    signals = [c for c in SIGNALS if c in resources.columns]
    return resources.join(F.broadcast(pairs), F.col("billing_period_start") == F.col(role)).select(
        *SIDE_KEY, *CARRIED, "total_cost", *signals
    )


def rolling_baseline(resources: DataFrame, pairs: DataFrame, months: int = 3) -> DataFrame:
    """Prior side whose cost is the mean over the months present among the last ``months``."""
    ahead = [F.add_months("billing_period_start", n).alias(f"m{n}") for n in range(1, months + 1)]
    spread = resources.withColumn("_current", F.explode(F.array(*ahead)))
    joined = spread.join(F.broadcast(pairs), F.col("_current") == F.col(PAIR[1]))
    latest = F.max_by(F.struct(*CARRIED), F.col("billing_period_start"))
    return (
        joined.groupBy(*SIDE_KEY)
        .agg(latest.alias("_a"), F.avg("total_cost").alias("total_cost"))
        .select(*SIDE_KEY, "_a.*", "total_cost")
    )


def grouped_pairs(resources: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of each (pair, resource), as :func:`variance_pairs` gives them, of resources with one row per period.

    A row is copied to the pairs it has a side in and the copies are grouped, so rows dealt by resource meet where they lie.
    """
    signals = [c for c in SIGNALS if c in resources.columns]
    prior = pairs.select(F.col(PAIR[0]).alias("billing_period_start"), PAIR[1], F.lit(False).alias("_now"))
    current = pairs.select(F.col(PAIR[1]).alias("billing_period_start"), PAIR[1], F.lit(True).alias("_now"))
    cells = F.struct(*CARRIED, "total_cost")
    copies = resources.join(F.broadcast(prior.unionByName(current)), "billing_period_start").select(
        *SIDE_KEY, F.when(~F.col("_now"), cells).alias("p"), F.when(F.col("_now"), F.struct(*CARRIED, "total_cost", *signals)).alias("c"))
    met = copies.groupBy(*SIDE_KEY).agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return met.join(F.broadcast(pairs), PAIR[1])


def grouped_rolling(resources: DataFrame, pairs: DataFrame, months: int = 3) -> DataFrame:
    """The pairs of :func:`rolling_baseline` and the current sides, grouped where rows dealt by resource lie; see :func:`grouped_pairs`.

    A row is copied to its own month and to the months whose mean it enters.
    """
    signals = [c for c in SIGNALS if c in resources.columns]
    month = F.col("billing_period_start")
    roles = [F.struct(F.add_months(month, n).alias(PAIR[1]), F.lit(n == 0).alias("_now")) for n in range(months + 1)]
    spread = resources.withColumn("_role", F.explode(F.array(*roles))).select("*", "_role.*").drop("_role")
    copies = spread.join(F.broadcast(pairs.select(PAIR[1])), PAIR[1])
    before = lambda value: F.when(~F.col("_now"), value)
    met = copies.groupBy(*SIDE_KEY).agg(
        F.max_by(before(F.struct(*CARRIED)), before(month)).alias("_a"), F.avg(before(F.col("total_cost"))).alias("_mean"),
        F.max(F.when(F.col("_now"), F.struct(*CARRIED, "total_cost", *signals))).alias("c"))
    mean = F.struct(*[F.col("_a")[c].alias(c) for c in CARRIED], F.col("_mean").alias("total_cost"))
    return met.select(*SIDE_KEY, F.when(F.col("_a").isNotNull(), mean).alias("p"), "c").join(F.broadcast(pairs), PAIR[1])


def by_month(rows: DataFrame, period: str, value: Column, name: str) -> DataFrame:
    """One map from month to value for each resource, of rows with one for each resource and month. The calendar bounds the map.

    A join on the resource alone, and a look into the map, moves nothing that is dealt by resource; a join on the month too would.
    """
    known = rows.where(F.col("resource_id").isNotNull() & F.col(period).isNotNull())
    return known.groupBy("resource_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(period), value))).alias(name))


def with_events(paired: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs whose sides carry the event of their resource and current period.

    Events travel as one map of months for each resource, which the calendar bounds, so the join is on the resource alone.
    """
    joined = paired.join(by_month(events, PAIR[1], F.col("event"), "_events"), "resource_id", "left")
    event = F.col("_events")[F.col(PAIR[1])]
    return joined.withColumns({s: F.col(s).withField("event", event) for s in ("p", "c")}).drop("_events")


def variance_pairs(prior: DataFrame, current: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of each (pair, resource) by full outer join, as structs ``p`` and ``c``.

    A current period has one prior period, so resource and current period are key enough; what was
    joined to a side on that key before needs no further shuffle here.
    """
    left = prior.select(*SIDE_KEY, F.struct(*[c for c in prior.columns if c not in SIDE_KEY]).alias("p"))
    right = current.select(*SIDE_KEY, F.struct(*[c for c in current.columns if c not in SIDE_KEY]).alias("c"))
    return left.join(right, SIDE_KEY, "full_outer").join(F.broadcast(pairs), PAIR[1])
