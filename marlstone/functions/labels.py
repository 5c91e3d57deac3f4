"""Label sets as map columns: their canonical key, and maps made from columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_key(labels: Column) -> Column:
    """A string that two label sets share if and only if they are equal: entries by name, each part after its length."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(part(e["key"]), part(e["value"]))), "")


def label_map(columns: Mapping[str, Column]) -> Column:
    """A label set from string columns; a label whose column is null is absent."""
    entries = F.array(*[F.struct(F.lit(name).alias("key"), c.alias("value")) for name, c in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def literal_map(labels: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")


#: Folders that a registry segment is dealt to.
BUCKETS = 64


def bucket_of(key: Column) -> Column:
    """The folder of a key."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def clean_labels(labels: Column) -> Column:
    """A label set without the labels that have no value; those are absent."""
    return F.map_filter(labels, lambda _, v: v.isNotNull())
