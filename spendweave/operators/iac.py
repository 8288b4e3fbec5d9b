"""Index of infrastructure-as-code identifiers and its match with billed resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.operators.containment import containment_pairs
from spendweave.session import stored

# Later sources win the description of an identifier they share; its place stays the earliest.
SOURCE_ORDER = ["terraform", "arm", "cloudformation", "pulumi"]


def iac_union(sources: dict[str, DataFrame]) -> DataFrame:
    """One row per identifier over all sources.

    Each source frame has ordinal, identifier, module, resource_type, resource_name.
    """
    frames = [
        sources[name].select(
            F.lit(rank).alias("_rank"), F.col("ordinal").alias("_pos"), "identifier", "module", "resource_type",
            "resource_name", F.lit(name).alias("iac_source"),
        )
        for rank, name in enumerate(SOURCE_ORDER)
        if name in sources
    ]
    place = F.struct("_rank", "_pos")
    meta = F.struct("module", "resource_type", "resource_name", "iac_source")
    return (
        reduce(DataFrame.unionByName, frames)
        .where("identifier is not null and identifier <> ''")
        .groupBy("identifier")
        .agg(F.min(place).alias("_first"), F.max_by(meta, F.struct("_rank", "_pos", "resource_name")).alias("_meta"))
        .select("identifier", F.col("_first._rank").alias("rank"), F.col("_first._pos").alias("ordinal"), "_meta.*")
    )


def iac_match_exact(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct ids that are identifiers themselves, with the identifier's description."""
    found = index.select(F.col("identifier").alias("resource_id"), "module", "iac_source")
    return ids.select("resource_id").distinct().join(found, "resource_id")


def iac_match_fuzzy(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Ids that contain an identifier or lie in one; the earliest identifier wins."""
    ids = ids.select("resource_id").where("resource_id <> ''").distinct()
    place = ["rank", "ordinal"]
    inside = containment_pairs(ids, index, "resource_id", "identifier", needle_extra=place)
    around = containment_pairs(index, ids, "identifier", "resource_id", haystack_extra=place)
    # The pairs carry the identifier's place alone, and each task keeps a minimum per id before anything is exchanged.
    first = inside.unionByName(around).groupBy("resource_id").agg(F.min(F.struct(*place, "identifier")).alias("_first"))
    found = first.select("resource_id", F.col("_first.identifier").alias("identifier"))
    return found.join(index.select("identifier", "module", "iac_source"), "identifier").select("resource_id", "module", "iac_source")


def iac_match(ids: DataFrame, index: DataFrame) -> DataFrame:
    """Managed ids with module and source: exact matches first, containment for the rest.

    The distinct ids and the index are read many times over, so both are written once.
    """
    ids, index = stored(ids.select("resource_id").distinct(), "billed-ids"), stored(index, "iac-index")
    exact = iac_match_exact(ids, index)
    rest = ids.join(exact.select("resource_id"), "resource_id", "left_anti")
    return exact.unionByName(iac_match_fuzzy(rest, index))
