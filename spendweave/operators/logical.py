"""Logical resources: clusters and the resources that belong to them by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendweave.functions.rules import blank_to_null, has_any
from spendweave.operators.containment import containment_pairs

PERIOD = "billing_period_start"


def logical_resources(resources: DataFrame) -> DataFrame:
    """Edges cluster -> child of every period, the cluster itself included.

    A cluster is a managed resource whose service is EKS, or RDS/Aurora. Its children are the
    resources of the period whose name contains its name; children of a database cluster must be
    RDS/Aurora themselves.
    """
    name = F.lower(F.coalesce(blank_to_null(F.col("resource_name")), F.col("resource_id")))
    service = F.lower(F.coalesce("service_name", F.lit("")))
    own = resources.where("resource_id is not null").select(
        PERIOD, "resource_id", "resource_name", name.alias("name"), service.alias("service"), "in_terraform_state"
    )
    database = has_any(F.col("service"), ["rds", "aurora"])
    managed = own.where("in_terraform_state")
    clusters = managed.where(F.contains("service", F.lit("eks"))).withColumn("resource_type", F.lit("eks_cluster"))
    clusters = clusters.unionByName(managed.where(database).withColumn("resource_type", F.lit("rds_cluster")))
    clusters = clusters.select(
        PERIOD, F.col("resource_id").alias("logical_resource_id"),
        F.col("resource_name").alias("logical_resource_name"), "resource_type", F.col("name").alias("cluster_name"),
    )
    eks = F.col("resource_type") == "eks_cluster"
    edge = [PERIOD, "logical_resource_id", "logical_resource_name", "resource_type", "child_resource_id", "relationship"]
    roots = clusters.withColumn("child_resource_id", F.col("logical_resource_id")).withColumn(
        "relationship", F.when(eks, "cluster").otherwise("primary")
    )
    eks_relation = (
        F.when(has_any(F.col("service"), ["ec2", "instance"]), "node")
        .when(F.contains("service", F.lit("ebs")) | F.contains("name", F.lit("vol")), "volume")
        .when(has_any(F.col("service"), ["elb", "load"]), "load_balancer")
        .when(F.contains("name", F.lit("nat")), "nat_gateway")
        .otherwise("associated")
    )
    rds_relation = (
        F.when(has_any(F.col("name"), ["replica", "reader"]), "replica")
        .when(F.contains("name", F.lit("storage")), "storage")
        .otherwise("associated")
    )
    children = (
        containment_pairs(own, clusters, "name", "cluster_name", [PERIOD])
        .join(clusters, [PERIOD, "cluster_name"])
        .join(own.select(PERIOD, "name", "service", F.col("resource_id").alias("child_resource_id")), [PERIOD, "name"])
        .where(F.col("child_resource_id") != F.col("logical_resource_id"))
        .where(eks | database)
        .withColumn("relationship", F.when(eks, eks_relation).otherwise(rds_relation))
    )
    return roots.select(edge).unionByName(children.select(edge))
