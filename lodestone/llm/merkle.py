"""Merkle fixity audit of replicated WARC archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize, running_sum

#: Levels above the leaves: each node covers 2 ** STEP nodes of the level below, by offset.
LEAF_BITS = 16
STEP = 4


def warc_record(uri: Column, body: Column) -> Column:
    """A WARC response record as text: header block, blank line, body, two line ends. Nulls are empty."""
    uri, body = F.coalesce(uri, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _bucket(key: Column, buckets: int) -> Column:
    """Archive of a record: the first 32 bits of the MD5 of its id, modulo their number."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def manifest(pages: DataFrame, archive_bytes: int = 1 << 24) -> DataFrame:
    """Lay records out in archives: page_id, archive, offset, length and sha256 of each.

    Records go to archives by hash, enough of them to hold about
    ``archive_bytes`` each, and stand there in order of id and digest; offsets
    are prefix sums of their lengths within an archive, by ranges, so an
    archive may hold any share of the records. Null ids are one id (of one
    archive), null urls and bodies are empty, repeated rows stand beside each
    other. Other columns are dropped, whatever their names.
    An empty table has an empty manifest.
    """
    record = warc_record(F.col("url"), F.col("html"))
    sized = materialize(pages.select("page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256")), "records")
    total = sized.agg(F.sum("length")).first()[0] or 0
    placed = sized.withColumn("archive", _bucket(F.col("page_id"), max(1, -(-total // archive_bytes))))
    laid = running_sum(placed, F.col("archive"), ["page_id", "sha256"], F.col("length"), "offset")
    return laid.select("page_id", "archive", "offset", "length", "sha256")


def tree(leaves: DataFrame, top: int) -> DataFrame:
    """All nodes over the records of one replica: archive, level, node and digest.

    Level 0 are ranges of 2 ** LEAF_BITS bytes of an archive, with the
    records that begin there; a node of a level covers 2 ** STEP of the one
    below; the last level has one node an archive. A digest is the SHA-256 of
    what lies below in order: offsets, lengths and digests of the records, or
    numbers and digests of the nodes. A node gathers the records of one byte
    range or a fixed number of nodes, never more.
    """
    record = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("sha256"))
    level = leaves.groupBy("archive", F.shiftright("offset", LEAF_BITS).alias("node")).agg(_ordered(F.struct("offset", record.alias("text"))).alias("digest"))
    nodes = level = level.select("archive", F.lit(0).alias("level"), "node", "digest")
    for number in range(1, top + 1):
        child = F.concat_ws(":", F.col("node").cast("string"), F.col("digest"))
        level = level.groupBy("archive", F.shiftright("node", STEP).alias("up")).agg(_ordered(F.struct("node", child.alias("text"))).alias("digest"))
        level = level.select("archive", F.lit(number).alias("level"), F.col("up").alias("node"), "digest")
        nodes = nodes.unionByName(level)
    return nodes


def _ordered(child: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["text"]), ","), 256)


def audit(expected: DataFrame, replica: DataFrame) -> DataFrame:
    """Compare two replicas' manifests and say what each record's state is.

    Both are hashed into one tree an archive. Roots are compared first, and
    only below roots that differ are the next level's nodes compared, and so
    on down; records are looked at only in byte ranges whose node differs.
    A record there is ``intact`` if the same length and digest stand at its
    offset, ``moved`` if the archive has it at another one (a record before it
    changed its length), ``corrupt`` if its id is there with another digest or
    length, ``missing`` if it is not, or ``extra`` (only in the replica).
    Repeated records and ids are paired one to one, by offset. All records
    elsewhere are ``intact``, vouched for by a root or node above.

    Records without a url or html are records with empty parts. Null ids are
    one id. Repeated rows stand beside each other in the archive. If both
    are empty, so is the result; if one is, every record of the other is
    missing or extra. Columns besides the five of a manifest are not read.

    Returns page_id, archive, offset, length, sha256 (the expected ones, the
    replica's for extra records), replica_sha256 (of the record that it was
    paired with; null unless it was looked at) and state.
    """
    largest = expected.select("offset").unionByName(replica.select("offset")).agg(F.max("offset")).first()[0] or 0
    top = 0
    while (largest >> LEAF_BITS) >> (STEP * top):
        top += 1
    one, two = (materialize(tree(r, top), "tree") for r in (expected, replica))

    def at(nodes: DataFrame, level: int, name: str) -> DataFrame:
        return nodes.where(F.col("level") == level).select("archive", "node", F.col("digest").alias(name))

    suspects = None
    for level in range(top, -1, -1):
        a, b = at(one, level, "mine"), at(two, level, "theirs")
        if suspects is not None:
            up = suspects.select("archive", F.col("node").alias("up"))
            a = a.withColumn("up", F.shiftright("node", STEP)).join(up, ["archive", "up"], "left_semi").drop("up")
            b = b.withColumn("up", F.shiftright("node", STEP)).join(up, ["archive", "up"], "left_semi").drop("up")
        compared = a.join(b, ["archive", "node"], "full_outer")
        suspects = materialize(compared.where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("archive", "node"), "suspects")
    ranges = suspects.withColumn("_suspect", F.lit(True))
    node = F.shiftright("offset", LEAF_BITS).alias("node")
    mine = expected.select("page_id", "archive", "offset", "length", "sha256", node).join(ranges, ["archive", "node"], "left")
    looked = replica.select("archive", "offset", F.col("page_id").alias("r_id"), F.col("length").alias("r_length"), F.col("sha256").alias("replica_sha256"), node).join(
        suspects, ["archive", "node"], "left_semi"
    ).drop("node")
    intact = mine.where("_suspect IS NULL").select("page_id", "archive", "offset", "length", "sha256", F.lit(None).cast("string").alias("replica_sha256"), F.lit("intact").alias("state"))
    both = mine.where("_suspect").join(looked, ["archive", "offset"], "full_outer")
    agree = F.col("sha256").eqNullSafe(F.col("replica_sha256")) & F.col("length").eqNullSafe(F.col("r_length"))
    both = materialize(both.withColumn("_agree", agree), "looked")
    same = both.where("_agree").select("page_id", "archive", "offset", "length", "sha256", "replica_sha256", F.lit("intact").alias("state"))
    apart = both.where("NOT _agree")
    lost = apart.where("sha256 IS NOT NULL").select(F.lit(0).alias("side"), "page_id", "archive", "offset", "length", "sha256")
    strays = apart.where("replica_sha256 IS NOT NULL").select(F.lit(1).alias("side"), F.col("r_id").alias("page_id"), "archive", "offset", F.col("r_length").alias("length"), F.col("replica_sha256").alias("sha256"))
    identity = [F.col("page_id").isNull().cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))]
    moved, apart = _paired(materialize(lost.unionByName(strays), "apart"), [F.col("length").cast("string"), F.col("sha256"), *identity], "moved")
    corrupt, apart = _paired(materialize(apart, "apart"), identity, "corrupt")
    rest = apart.select(
        "page_id", "archive", "offset", "length", "sha256",
        F.when(F.col("side") == 1, F.col("sha256")).alias("replica_sha256"), F.when(F.col("side") == 1, "extra").otherwise("missing").alias("state"),
    )
    return intact.unionByName(same).unionByName(moved).unionByName(corrupt).unionByName(rest)


def _paired(records: DataFrame, parts: list[Column], state: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of an expected record (side 0) and one of the replica (side 1), and the records that are in none.

    A pair is of one archive and agrees in ``parts``; of several, the n-th by
    offset of one side goes with the n-th of the other, so a key that many
    records share is spread over its numbers.
    """
    key = F.concat_ws(":", F.col("archive").cast("string"), *parts)
    numbered = running_sum(records, F.concat_ws(":", F.col("side").cast("string"), key), ["offset"], F.lit(1).cast("long"), "nth").withColumn("key", key)
    mine, theirs = (numbered.where(F.col("side") == k).select("key", "nth", F.struct(*records.columns).alias(f"r{k}")) for k in (0, 1))
    met = materialize(mine.join(theirs, ["key", "nth"], "full_outer"), "pairs")
    whole = F.col("r0").isNotNull() & F.col("r1").isNotNull()
    pairs = met.where(whole).select(*[f"r0.{c}" for c in ("page_id", "archive", "offset", "length", "sha256")], F.col("r1.sha256").alias("replica_sha256"), F.lit(state).alias("state"))
    return pairs, met.where(~whole).select(F.coalesce("r0", "r1").alias("r")).select("r.*")
