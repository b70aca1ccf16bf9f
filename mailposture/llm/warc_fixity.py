"""Fixity audit of web archives by Merkle trees.

Records are packed into volumes by id, each at a fixed slot, so that a lost record does not move the others.  Every record is hashed once, where it is read; only
digests are shuffled.  A node's digest covers those of up to ``FANOUT`` children and the range of bytes they take in the volume.  Two replicas compare the roots of
their volumes, then the children of nodes that differ, and so on down to records: an intact volume costs one comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailposture.session import store

FANOUT = 16
#: Slots of a volume.
SLOTS = FANOUT**3


def record(id_col: str, url_col: str, body_col: str) -> Column:
    """Bytes of a WARC record: head lines, an empty line, the body, two line ends.  Null url and body count as empty."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", slots: int = SLOTS) -> DataFrame:
    """(volume, slot, offset, length, digest): one leaf for each id; offsets are those of the volume's records in slot order.

    Repeated ids share a slot: their leaf covers the number and the sums of all digests, 32 bits at a time, so equal records do not cancel and the order does not
    matter.  Rows without an id are volume -1, slot 0.  The window that sums lengths goes over the digests of one volume, at most ``slots`` rows.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-slots))
    hashed = pages.select(F.floor(key / slots).alias("volume"), F.pmod(key, F.lit(slots)).alias("slot"), record(id_col, url_col, body_col).alias("body"))
    hashed = hashed.select("volume", "slot", F.octet_length("body").cast("bigint").alias("length"), F.sha2("body", 256).alias("digest"))
    # As whole numbers: below 2^31 records of one id no sum overflows.
    sums = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("bigint")).alias(f"sum{k}") for k in range(8)]
    merged = hashed.groupBy("volume", "slot").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest"), *sums)
    several = F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"sum{k}").cast("string") for k in range(8)]), 256)
    before = Window.partitionBy("volume").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return merged.select("volume", "slot", offset.alias("offset"), "length", F.when(F.col("n") > 1, several).otherwise(F.col("digest")).alias("digest"))


def tree(leaf: DataFrame, slots: int = SLOTS, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the trees of all volumes, records first, roots last: (volume, node, length, digest).

    A node covers the numbers, lengths and digests of its children in order, so it fixes the ranges that they take.
    """
    levels = [leaf.select("volume", F.col("slot").alias("node"), "length", "digest")]
    span = 1
    while span < slots:
        children = F.sort_array(F.collect_list(F.struct("node", "length", "digest")))  # at most ``fanout``
        grouped = levels[-1].groupBy("volume", F.floor(F.col("node") / fanout).alias("parent")).agg(F.sum("length").alias("length"), children.alias("children"))
        text = F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), c["length"].cast("string"), c["digest"])))
        # Written: every level is read for the next one and again for the comparison.
        levels.append(store(grouped.select("volume", F.col("parent").alias("node"), "length", F.sha2(text, 256).alias("digest"))))
        span *= fanout
    return levels


def audit(one: DataFrame, two: DataFrame, slots: int = SLOTS, fanout: int = FANOUT) -> DataFrame:
    """(volume, slot, kind, offset, length, digest_one, digest_two) of leaves in which two replicas differ.

    ``kind`` is changed, missing (not in the second) or extra (not in the first); ``offset`` and ``length`` are those in the replica that has the record.
    """
    one, two = store(one), store(two)
    first, second = tree(one, slots, fanout), tree(two, slots, fanout)
    differ = None
    for a, b in zip(reversed(first), reversed(second)):
        if differ is not None:  # only children of nodes that differ
            parent = [F.col("volume"), F.floor(F.col("node") / fanout).alias("parent")]
            a = a.withColumns({"parent": parent[1]}).join(differ, ["volume", "parent"], "left_semi")
            b = b.withColumns({"parent": parent[1]}).join(differ, ["volume", "parent"], "left_semi")
        a = a.select("volume", "node", F.col("digest").alias("digest_one"))
        b = b.select("volume", "node", F.col("digest").alias("digest_two"))
        found = a.join(b, ["volume", "node"], "full").filter(~F.col("digest_one").eqNullSafe(F.col("digest_two")))
        differ = found.select("volume", F.col("node").alias("parent"))
    kind = F.when(F.col("digest_two").isNull(), "missing").when(F.col("digest_one").isNull(), "extra").otherwise("changed")
    found = found.select("volume", F.col("node").alias("slot"), kind.alias("kind"), "digest_one", "digest_two")
    place = one.select("volume", "slot", "offset", "length")
    other = two.select("volume", "slot", F.col("offset").alias("offset_two"), F.col("length").alias("length_two"))
    placed = found.join(place, ["volume", "slot"], "left").join(other, ["volume", "slot"], "left")
    return placed.select("volume", "slot", "kind", F.coalesce("offset", "offset_two").alias("offset"), F.coalesce("length", "length_two").alias("length"), "digest_one", "digest_two")
