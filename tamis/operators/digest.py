"""A digest of a table's keys that merges: a tree of hashes, so that no task reads all keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a key's hash that name its leaf, and those of the node above; the root is over all nodes.
LEAF, NODE = 4, 2


def digests(rows: DataFrame, by: str, key: str) -> DataFrame:
    """by, n and digest: the same for the same keys in any order, on any partitioning; another if one key changes or comes
    once more.

    Keys are counted first, so one that holds a third of all rows is a row per task. A leaf is the md5 of its keys' hashes
    and counts in order, a node that of its leaves' digests, the root that of the nodes'. The value is this tree's own; it
    isn't the md5 of one sorted list, which can't be worked out in parts. A null key counts as one of its own.
    """
    h = F.coalesce(F.md5(F.col(key).cast("binary")), F.lit("0" * 32))
    keys = rows.groupBy(by, h.alias("_h")).agg(F.count("*").alias("_c"))
    leaf, node = F.substring("_h", 1, LEAF), F.substring("_leaf", 1, NODE)

    def level(name: str, value: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(value).cast("string").alias("value"))))
        return F.md5(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["name"], p["value"])), ""))

    leaves = keys.groupBy(by, leaf.alias("_leaf")).agg(F.sum("_c").alias("n"), level("_h", "_c").alias("d"))
    nodes = leaves.groupBy(by, node.alias("_node")).agg(F.sum("n").alias("n"), level("_leaf", "d").alias("d"))
    return nodes.groupBy(by).agg(F.sum("n").alias("n"), level("_node", "d").alias("digest"))
