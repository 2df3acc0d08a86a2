"""Scalar rules as column expressions."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..sources.documents import XSI

BLANK = r"(?U)^\s*$"
#: Scalar names of schema drafts that differ from the observed ones.
DRAFT_TYPES = {"double": "number", "dateTime": "datetime"}
SIMPLE_TYPES = ("null", "boolean", "integer", "decimal", "number", "date", "datetime", "string")


@F.pandas_udf(BooleanType())  # an object, not a DDL string: that would need a session on import
def _iso_time(text: pd.Series) -> pd.Series:
    def reads(t: str | None) -> bool:
        try:
            return t is not None and bool(datetime.datetime.fromisoformat(t.replace("Z", "+00:00")))
        except ValueError:
            return False

    return text.map(reads)


def strip(text: Column) -> Column:
    """Without white space, Unicode's too, on either side."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def xml_type(text: Column) -> Column:
    """The narrowest type of an XML text. Only texts with a T that fit nothing else reach Python's ISO parser."""
    t = strip(text)
    number = t.try_cast("double")
    day = F.try_to_date(t, "yyyy-MM-dd")
    return (
        F.when(t == "", "null")
        .when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^[+-]?(?:0|[1-9][0-9]*)$"), "integer")
        .when(t.rlike(r"^[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)$"), "decimal")
        .when(t.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+$") & (F.abs(number) < float("inf")), "double")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.when(day.isNotNull() & (F.substring(t, 1, 4) != "0000"), "date").otherwise("string"))
        .when(_iso_time(F.when(t.contains("T"), t)), "dateTime")
        .otherwise("string")
    )


def empty_to_null(data_type: Column, value: Column) -> tuple[Column, Column]:
    """(data_type, value) in which a blank string is a null."""
    blank = (data_type == "string") & F.coalesce(value, F.lit("")).rlike(BLANK)
    return F.when(blank, "null").otherwise(data_type), F.when(~blank, value)


def plain_attributes(attributes: Column) -> Column:
    """A map of attributes without those of the schema-instance namespace."""
    return F.map_filter(attributes, lambda k, _: ~k.startswith(XSI))


def namespace(name: Column) -> Column:
    return F.regexp_extract(name, r"^\{([^}]*)\}", 1)


def local(name: Column) -> Column:
    return F.regexp_replace(name, r"^\{[^}]*\}", "")


def draft_type(data_type: Column) -> Column:
    """The scalar type of a draft; an unknown one is an error."""
    known = F.coalesce(data_type, F.lit("null"))
    for old, new in DRAFT_TYPES.items():
        known = F.when(known == old, new).otherwise(known)
    return F.when(known.isin(*SIMPLE_TYPES), known).otherwise(F.raise_error(F.concat(F.lit("not a scalar type: "), known)))


#: The simple types that a selected node or attribute may have; an element may also be null.
XSD_TYPES = (
    "string boolean decimal float double duration dateTime time date gYearMonth gYear gMonthDay gDay gMonth hexBinary base64Binary anyURI QName "
    "normalizedString token language NMTOKEN NMTOKENS Name NCName ID IDREF IDREFS ENTITY ENTITIES integer nonPositiveInteger negativeInteger long int "
    "short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger anySimpleType"
).split()
LOCAL_NAME = r"^[A-Za-zА-Яа-яЁё_][A-Za-zА-Яа-яЁё0-9_.-]*$"


def selection_violations(nodes):
    """check, id of selected schema nodes that don't hold. nodes: id, parent_id, name, kind (scalar, object, attribute),
    type, min_occurs (long), max_occurs (string: a number or unbounded)."""
    type_ = F.coalesce(F.col("type"), F.lit(""))
    most = F.col("max_occurs").try_cast("long")
    parents = nodes.select(F.col("parent_id").alias("id"), F.lit(True).alias("has_children")).where("id is not null").distinct()
    rows = nodes.join(parents, "id", "left")
    checks = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("name"), F.lit("")).rlike(LOCAL_NAME), "bad_name"),
            F.when((F.col("kind") != "object") & ~(type_.isin(*XSD_TYPES) | ((type_ == "null") & (F.col("kind") == "scalar"))), "bad_type"),
            F.when(~(F.coalesce(F.col("min_occurs"), F.lit(-1)) >= 0), "bad_min_occurs"),
            F.when((F.col("max_occurs") != "unbounded") & ~(F.coalesce(most, F.lit(-1)) >= F.col("min_occurs")), "bad_max_occurs"),
            F.when((F.col("kind") != "object") & F.col("has_children"), "scalar_with_children"),
            F.when((F.col("kind") == "attribute") & ((F.col("max_occurs") != "1") | F.col("parent_id").isNull() | (F.col("name") == "xmlns")), "bad_attribute"),
        ),
        lambda c: c.isNotNull(),
    )
    return rows.select(F.explode(checks).alias("check"), "id")
