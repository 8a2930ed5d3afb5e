"""Schemas of the raw feeds and of the normalised indicator table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, NumericType, StringType, StructType

from threatlake.functions.fixed import INDICATOR_COLUMNS

INDICATOR_DDL = ", ".join(f"{name} {kind}" for name, kind in INDICATOR_COLUMNS)

OTX_INDICATOR = "struct<type:string,indicator:string>"
OTX_PULSE = (
    "struct<id:string,name:string,description:string,tags:array<string>,created:string,"
    f"adversary:string,indicators:array<{OTX_INDICATOR}>>"
)
VT_REPORT = (
    "struct<data:struct<id:string,type:string,attributes:struct<"
    "last_analysis_stats:map<string,int>,"
    "last_analysis_results:map<string,struct<category:string,result:string>>,"
    "country:string,asn:bigint,as_owner:string,last_analysis_date:bigint>>>"
)
SCC_FINDING = (
    "struct<name:string,category:string,resourceName:string,severity:string,eventTime:string,"
    "createTime:string,description:string,mute:string,state:string>"
)
ASSET = (
    "struct<name:string,assetType:string,displayName:string,updateTime:string,"
    "resource:struct<data:struct<timeCreated:string,creationTimestamp:string,createTime:string,"
    "zone:string,region:string,location:string>>>"
)
RSS_ENTRY = (
    "struct<title:string,link:string,published_iso:string,published_raw:string,"
    "summary:string,content:string,id:string>"
)
AUDIT_EVENT = (
    "struct<protoPayload:struct<serviceName:string,methodName:string,resourceName:string,"
    "resource:struct<name:string>,requestMetadata:struct<callerSuppliedResourceName:string>>,"
    "kind:string,bucket:string,name:string>"
)
RESOURCE_CONFIG = (
    "struct<name:string,iamConfiguration:struct<bindings:"
    "array<struct<role:string,members:array<string>>>>,"
    "networkInterfaces:array<struct<network:string,"
    "accessConfigs:array<struct<type:string,name:string>>>>,"
    "shieldedInstanceConfig:struct<enableSecureBoot:boolean,enableVtpm:boolean,"
    "enableIntegrityMonitoring:boolean>,"
    "spec:struct<template:struct<spec:struct<containers:array<struct<image:string>>>>>>"
)


def to_indicator_schema(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 17 columns in order and type; a column the source lacks is null."""
    columns: list[Column] = [F.col(c) for c in keep]
    for name, kind in INDICATOR_COLUMNS:
        value = F.col(name) if name in df.columns else F.lit(None)
        columns.append(value.cast(kind).alias(name))
    return df.select(*columns)


# --- rows that do not fit -------------------------------------------------------------------------

REFUSAL = "array<struct<column:string,reason:string>>"


def _typed(value: Column, have: DataType, want: str) -> Column:
    """The value in the table's type; null where it would not say the same there."""
    none = F.lit(None).cast(want)
    if want == "array<string>":
        plain = isinstance(have, ArrayType) and not isinstance(have.elementType, (ArrayType, MapType, StructType))
        return value.cast(want) if plain else none
    if isinstance(have, (ArrayType, MapType, StructType, NullType)):
        return none
    if want == "string":
        return value.cast(want)
    cast = value.try_cast(want)
    if isinstance(have, StringType) or (isinstance(have, NumericType) and want == "double"):
        return cast
    if isinstance(have, NumericType):
        # A fraction, or a number out of range, does not come back the same.
        exact = "decimal(38,10)"
        return F.when(cast.cast(exact) == value.try_cast(exact), cast)
    return none


def checked(df: DataFrame, row_col: str | None = None, refused_only: bool = False) -> DataFrame:
    """The table's 17 columns and ``refusal``: what does not fit of a row, empty if all does.

    A column that the frame lacks is null.  A value of another type is cast where it says the same
    afterwards; one that does not is null in the table's column and named in ``refusal``, and so is
    every value in a column that the table does not have.  Names match whatever their case.  With
    ``row_col`` the row as given comes too, as JSON under that name; with ``refused_only`` it is
    written out only where something does not fit, else null.
    """
    own = {field.name.lower(): field for field in df.schema}
    columns, failures = [], []

    def fail(name: str, condition: Column, reason: str) -> None:
        failure = F.struct(F.lit(name).alias("column"), F.lit(reason).alias("reason"))
        failures.append(F.when(condition, failure))

    for name, kind in INDICATOR_COLUMNS:
        field = own.pop(name, None)
        if field is None:
            columns.append(F.lit(None).cast(kind).alias(name))
            continue
        value = F.col(f"`{field.name}`")
        typed = _typed(value, field.dataType, kind)
        columns.append(typed.alias(name))
        fail(name, value.isNotNull() & typed.isNull(), f"no {kind}")
    for field in own.values():
        fail(field.name, F.col(f"`{field.name}`").isNotNull(), "unknown column")
    refusal = F.array_compact(F.array(*failures)) if failures else F.array()
    if row_col:
        given = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        columns.append((F.when(F.size(refusal) > 0, given) if refused_only else given).alias(row_col))
    return df.select(*columns, refusal.cast(REFUSAL).alias("refusal"))
