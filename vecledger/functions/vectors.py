"""Other functions of stored vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecledger.functions.filters import _Value


def size_estimate(values: Column, metadata: Column) -> Column:
    """Estimated bytes: 49 + 4 a dimension + key and value bytes of top-level metadata
    (string its length, number 8, boolean 1, other 8)."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(metadata, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def of(e: Column) -> Column:
        x = _Value(e.value)
        return F.octet_length(e.key) + F.coalesce(F.when(x.is_string, F.octet_length(x.string)).when(x.type == "BOOLEAN", 1), F.lit(8))

    return F.lit(49) + 4 * F.size(values) + F.aggregate(entries, F.lit(0), lambda n, e: n + of(e))
