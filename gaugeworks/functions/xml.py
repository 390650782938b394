"""Values and nodes out of event documents.

An event is ``<event name timestamp>`` with named ``data`` and ``action`` items. Parsing uses
``from_xml``: a missing item gives NULL, and so does a document that is not well formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.predicates import as_column

ITEMS = "ARRAY<STRUCT<_name STRING, value STRING>>"
EVENT_HEAD = "_name STRING, _timestamp STRING"
EVENT = f"{EVENT_HEAD}, data {ITEMS}, action {ITEMS}"


def event_head(document) -> Column:
    """Name and time of an event; the items are skipped, not parsed."""
    return F.from_xml(as_column(document), EVENT_HEAD)


def event_struct(document) -> Column:
    """The whole event."""
    return F.from_xml(as_column(document), EVENT)


def event_time(event) -> Column:
    return as_column(event)["_timestamp"].try_cast("timestamp")


def xml_item(event, kind: str, name: str, type_: str = "string") -> Column:
    """Value of the first ``data`` or ``action`` item of that name, in the given type."""
    if kind not in ("data", "action"):
        raise ValueError(f"kind must be 'data' or 'action', not {kind!r}")
    named = F.filter(as_column(event)[kind], lambda item: item["_name"] == name)
    return F.get(named, F.lit(0))["value"].try_cast(type_)


# Runs are possessive and stop at the next tag, so a match neither goes back nor recurses, however long a
# tag or a body is, and an unclosed quote ends the attempt.
_TAG_END = r"""(?=[\s/>])(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""


def _until(name: str) -> str:
    """All up to the element's end tag."""
    return rf"(?:[^<]++|<(?!/{name}>))*+"


def nodes(document, tag: str) -> Column:
    """Array of the raw ``tag`` elements in the values of a document's data items, with or without a body.

    A ``>`` inside a quoted attribute does not end a tag. Elements that are not closed are left out.
    """
    before = r"(?:[^<]++|<(?!/data>|value[\s/>]))*+"
    value = rf"<data{_TAG_END}{before}<value{_TAG_END}({_until('value')})</value>"
    element = rf"<{tag}{_TAG_END}(?:(?<=/>)|{_until(tag)}</{tag}>)"
    values = F.regexp_extract_all(as_column(document), F.lit(value), F.lit(1))
    return F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(element), F.lit(0))))


def node_count(document, tag: str) -> Column:
    """How many elements ``nodes`` gives; documents that don't name the tag are not searched."""
    named = F.coalesce(as_column(document).contains(f"<{tag}"), F.lit(False))
    return F.when(named, F.size(nodes(document, tag))).otherwise(F.lit(0))


def explode_nodes(df: DataFrame, col: str, tag: str, alias: str) -> DataFrame:
    """One row per ``tag`` element; documents without one vanish."""
    return df.withColumn(alias, F.explode(nodes(col, tag)))


def list_to_xml(col, row_tag: str, root_tag: str | None = None) -> Column:
    """An array of structs as an XML fragment; NULL for a NULL or empty list."""
    rows = F.transform(
        as_column(col),
        lambda row: F.trim(F.to_xml(row, {"rowTag": row_tag, "indent": ""}), F.lit("\n")),
    )
    text = F.nullif(F.array_join(rows, ""), F.lit(""))
    if root_tag is None:
        return text
    return F.concat(F.lit(f"<{root_tag}>"), text, F.lit(f"</{root_tag}>"))
