"""IaC state and template files as identifier frames.

Each reader returns ordinal, identifier, module, resource_type, resource_name. A document is one
file (``multi_line``) or one line of a JSON-lines landing file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendweave.functions.rules import blank_to_null
from spendweave.sources.order import files_of, in_load_order, with_file_place

TFSTATE = (
    "resources array<struct<module string, type string, name string, "
    "instances array<struct<attributes map<string, variant>>>>>"
)
ARM = "resources array<struct<id string, type string, name string>>"
CLOUDFORMATION = (
    "Resources map<string, struct<Type string, "
    "Properties struct<Name string, FunctionName string, BucketName string>>>"
)
_PULUMI_RESOURCE = "array<struct<type string, urn string, id string, outputs struct<name string, arn string>>>"
PULUMI = f"deployment struct<resources {_PULUMI_RESOURCE}>, resources {_PULUMI_RESOURCE}"


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """The documents with the place of each: file, and the byte where its split starts."""
    return with_file_place(spark.read.schema(schema).option("multiLine", multi_line).json(path))


PLACE = ["_file", "_start"]


def _ordered(df: DataFrame, files: list[str]) -> DataFrame:
    """Ordinal in reading order: by file, then place in it. It only breaks ties between identifiers, so gaps do not matter."""
    names = ["identifier", "module", "resource_type", "resource_name"]
    return in_load_order(df, files, "ordinal").where("identifier <> ''").select("ordinal", *names)


def _text(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def scan_tfstate(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Identifiers of a Terraform state: id, arn and text attributes whose key mentions resource_id."""
    documents = read_documents(spark, path, TFSTATE, multi_line)
    blocks = documents.select(*PLACE, F.explode("resources").alias("r"))
    instances = blocks.select(*PLACE, "r", F.explode("r.instances").alias("i"))
    attributes = instances.select(*PLACE, "r", F.explode("i.attributes").alias("key", "value"))
    wanted = F.col("key").isin("id", "arn") | F.contains("key", F.lit("resource_id"))
    is_text = F.schema_of_variant("value") == "STRING"
    return _ordered(
        attributes.where(wanted & is_text).select(
            *PLACE, F.try_variant_get("value", "$", "string").alias("identifier"),
            _text(F.col("r.module"), "root").alias("module"),
            _text(F.col("r.type"), "unknown").alias("resource_type"),
            _text(F.col("r.name"), "unknown").alias("resource_name"),
        ),
        files_of(spark, path),
    )


def scan_arm(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Identifiers of an ARM template: id or name, and the name when it differs."""
    documents = read_documents(spark, path, ARM, multi_line)
    rows = documents.select(*PLACE, F.explode("resources").alias("r"))
    name = F.coalesce("r.name", F.lit("unknown"))
    key = F.coalesce(blank_to_null(F.col("r.id")), F.col("r.name"), F.lit(""))
    kind = _text(F.col("r.type"), "unknown")
    return _ordered(
        rows.select(
            *PLACE, F.explode(F.array_distinct(F.array(key, name))).alias("identifier"),
            kind.alias("module"), kind.alias("resource_type"), name.alias("resource_name"),
        ),
        files_of(spark, path),
    )


def scan_cloudformation(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Logical ids of a CloudFormation template."""
    documents = read_documents(spark, path, CLOUDFORMATION, multi_line)
    rows = documents.select(*PLACE, F.explode("Resources").alias("id", "r"))
    properties = [blank_to_null(F.col(f"r.Properties.{p}")) for p in ("Name", "FunctionName", "BucketName")]
    return _ordered(
        rows.select(
            *PLACE, F.col("id").alias("identifier"), F.lit("cloudformation").alias("module"),
            _text(F.col("r.Type"), "unknown").alias("resource_type"),
            F.coalesce(*properties, F.col("id")).alias("resource_name"),
        ),
        files_of(spark, path),
    )


def scan_pulumi(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Identifiers of a Pulumi state: id or urn, and the ARN among the outputs."""
    documents = read_documents(spark, path, PULUMI, multi_line)
    rows = documents.select(*PLACE, F.explode(F.coalesce("deployment.resources", "resources")).alias("r"))
    urn = blank_to_null(F.col("r.urn"))
    key = F.coalesce(blank_to_null(F.col("r.id")), urn)
    # Without an urn the name stays unknown, even when the outputs carry one.
    name = F.when(
        urn.isNotNull(), F.coalesce(blank_to_null(F.col("r.outputs.name")), F.element_at(F.split(urn, "::"), -1))
    ).otherwise("unknown")
    arn = blank_to_null(F.col("r.outputs.arn"))
    return _ordered(
        rows.select(
            *PLACE, F.explode(F.array_distinct(F.array_compact(F.array(key, arn)))).alias("identifier"),
            F.lit("pulumi").alias("module"), _text(F.col("r.type"), "unknown").alias("resource_type"),
            name.alias("resource_name"),
        ),
        files_of(spark, path),
    )
