"""Near-duplicate documents: MinHash with tensored banding, verified on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import join_counted, materialize, row_key
from lodestone.llm.components import components
from lodestone.llm.textarrays import mix, set_digest, shingle_sets, text_bytes

U64 = np.uint64
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    salts = mix(np.arange(1, n + 1, dtype=U64) + U64(seed << 20))
    return salts, mix(salts) | U64(1)


def _minima(values: np.ndarray, salts: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """One minimum for each hash function, in blocks that stay in cache."""
    out = np.full(len(salts), _EMPTY, U64)
    for at in range(0, len(values), 1024):
        block = (values[None, at : at + 1024] ^ salts[:, None]) * odds[:, None]
        block ^= block >> U64(32)
        block *= odds[::-1, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def _longs(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    ends = np.cumsum([0, *map(len, rows)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))


def _digest_columns(digests: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([d[k] for d in digests], pa.int64()) for k in range(2)]


def _signer(shingle: int, bands: int, rows: int):
    salts, odds = _family(2 * bands * rows, 5)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, first, second = [], [], [], []
            for s in shingle_sets(*text_bytes(batch.column("text")), shingle):
                sizes.append(len(s))
                digests.append(set_digest(s))
                m = _minima(s, salts, odds).reshape(2, bands, rows)
                key = np.zeros((2, bands), U64)
                for k in range(rows):
                    key = mix(key * U64(0x2545F4914F6CDD1D) + m[:, :, k])
                first.append(key[0])
                second.append(key[1])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "_k1", "_k2")),
                    *_digest_columns(digests),
                    pa.array(sizes, pa.int64()),
                    _longs(first),
                    _longs(second),
                ],
                ["doc_id", "_k1", "_k2", "node", "check", "n_shingles", "a", "b"],
            )

    return sign


def _bloom_bits(column: str, log2_bits: int) -> list:
    """Three bit positions of a value in a filter of 2 ** log2_bits bits."""
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(1 << log2_bits)) for k in range(3)]


def _set_reader(shingle: int, words):
    """Sets of the rows whose ``_bits`` are all in the filter; others are passed over unread."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words.value
        for batch in batches:
            hit = np.ones(len(batch), bool)
            for k in range(3):
                bit = batch.column(f"_b{k}").to_numpy(zero_copy_only=False)
                hit &= (table[bit >> 6] >> (bit & 63).astype(U64) & U64(1)).astype(bool)
            batch = batch.filter(pa.array(hit))
            sets = list(shingle_sets(*text_bytes(batch.column("text")), shingle))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_digest_columns([set_digest(s) for s in sets]), _longs(sets)],
                ["doc_id", "node", "check", "items"],
            )

    return read


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int, node: Column) -> DataFrame:
    """Full shingle sets (node, items) of the nodes in ``wanted`` (node, rep).

    Texts are not shuffled: a Bloom filter over the representatives' ids goes
    to the mappers, 16 bits an id but from 2 MB to 64 MB in all; what it lets
    through by mistake falls to the join on ``node``.
    """
    spark = docs.sparkSession
    log2_bits = min(29, max(24, (16 * wanted.count()).bit_length()))
    bits = wanted.select(F.explode(F.array(*_bloom_bits("rep", log2_bits))).alias("bit"))
    marks = (
        bits.groupBy(F.expr("bit >> 6").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (log2_bits - 6), U64)
    words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(U64)
    shared = spark.sparkContext.broadcast(words)
    keyed = docs.select("doc_id", "text", *[b.alias(f"_b{k}") for k, b in enumerate(_bloom_bits("doc_id", log2_bits))])
    read = keyed.mapInArrow(_set_reader(shingle, shared), "doc_id long, node long, check long, items array<long>").withColumn("node", node)
    mine = wanted.select("node", F.col("rep").alias("doc_id"))
    # null ids stand for themselves here; a set read twice is one set
    kept = read.join(mine, (read["node"] == mine["node"]) & read["doc_id"].eqNullSafe(mine["doc_id"]), "left_semi")
    return kept.groupBy("node").agg(F.any_value("items").alias("items"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int, node: Column, name: str) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union."""
    size_u = nodes.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("rep").alias("ru"))
    size_v = nodes.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("rep").alias("rv"))
    near = F.lit(100) * F.least("nu", "nv") >= F.lit(percent) * F.greatest("nu", "nv")
    pairs = materialize(pairs.join(size_u, "u").join(size_v, "v").where(near), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("ru").alias("rep")), F.struct(F.col("v").alias("node"), F.col("rv").alias("rep")))).alias("w"))
    wanted = materialize(wanted.select("w.*").distinct(), f"{name}-wanted")
    sets = materialize(_sets_of(docs, wanted, shingle, node), f"{name}-sets")
    both = (
        pairs.select("u", "v", "nu", "nv")
        .join(sets.select(F.col("node").alias("u"), F.col("items").alias("su")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("items").alias("sv")), "v")
        .withColumn("common", F.size(F.array_intersect("su", "sv")).cast("long"))
    )
    ok = F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("nu") + F.col("nv") - F.col("common"))
    return materialize(both.where(ok).select("u", "v"), f"{name}-links")


def _compare_blocks(percent: int):
    """Links between the members of a sub-key's two blocks, but those of one component or of an earlier sub-key.

    A table holds some whole block pairs. Within one, a text's shingles are
    marked once and all others' marks are summed, so a pair costs additions.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("at", "sub", "left", "right")])
        at, sub, left, right, node, root, size, block = (
            table.column(c).to_numpy() for c in ("at", "sub", "left", "right", "node", "root", "n_shingles", "block")
        )
        a, b = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), -1) for c in ("a", "b"))
        items = table.column("items").combine_chunks()
        edges = np.append(0, np.cumsum(items.value_lengths().to_numpy()))
        flat = items.flatten().to_numpy()
        fresh = np.zeros(len(node), bool)
        fresh[:1] = True
        for column in (at, sub, left, right):
            fresh[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(fresh)
        found = []
        for begin, end in zip(starts, np.append(starts[1:], len(node)), strict=True):
            if end - begin > 1 and root[begin:end].min() != root[begin:end].max():
                part = slice(begin, end)
                local = np.unique(flat[edges[begin] : edges[end]], return_inverse=True)[1]
                offsets = edges[begin : end + 1] - edges[begin]
                sides = np.flatnonzero(block[part] == left[begin]), np.flatnonzero(block[part] == right[begin])
                found += [(node[begin + x], node[begin + y]) for x, y in _links(at[begin], root[part], size[part], a[part], b[part], local, offsets, sides, percent)]
        return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})

    return compare


def _links(at: int, root, size, a, b, local, offsets, sides, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join two groups of this block: fewer than it has members, however many pairs are near."""
    group = root.copy()
    mark = np.zeros(int(local.max()) + 1, np.int32)
    mine, others = sides
    same_block = mine is others or (len(mine) == len(others) and bool((mine == others).all()))
    for x in mine:
        near = others[others > x] if same_block else others
        near = near[(group[near] != group[x]) & (100 * np.minimum(size[near], size[x]) >= percent * np.maximum(size[near], size[x]))]
        near = near[(b[near] == b[x]).any(axis=1) & ~(a[near, :at] == a[x, :at]).any(axis=1)]
        if not len(near):
            continue
        own = local[offsets[x] : offsets[x + 1]]
        mark[own] = 1
        if len(near) < 8:
            common = np.array([mark[local[offsets[y] : offsets[y + 1]]].sum() for y in near])
        else:
            common = np.add.reduceat(mark[local], offsets[:-1])[near]
        mark[own] = 0
        for y in near[100 * common >= percent * (size[near] + size[x] - common)]:
            if group[y] != group[x]:
                group[group == group[y]] = group[x]
                yield x, y


def _live_keys(nodes: DataFrame) -> DataFrame:
    """Table keys of the nodes: each pair of a first and a second sub-key that other nodes have too.

    Two nodes meet in a table if they agree in both of its sub-keys, so a
    sub-key that one node has alone can be left out before pairs are formed.
    """
    each = nodes.select("node", F.explode(F.concat(F.transform("a", lambda k, i: F.struct(F.lit(0).alias("side"), i.alias("i"), k.alias("k"))), F.transform("b", lambda k, i: F.struct(F.lit(1).alias("side"), i.alias("i"), k.alias("k"))))).alias("s")).select("node", "s.*")
    common = each.groupBy("side", "i", "k").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = materialize(each.join(common, ["side", "i", "k"]), "sub-keys")
    first = live.where("side = 0").select("node", F.col("i"), F.col("k").alias("ka"))
    second = live.where("side = 1").select("node", F.col("i").alias("j"), F.col("k").alias("kb"))
    return first.join(second, "node").select(F.xxhash64("i", "j", "ka", "kb").alias("key"), "node")


def _nodes_of(signed: DataFrame) -> DataFrame:
    """One row a node: its least document, its number of rows, its size and sub-keys, and the least and greatest digest check."""
    return (
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("a").alias("a"), F.any_value("b").alias("b"),
            F.min("check").alias("check"), F.max("check").alias("other"),
        )
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 12, rows: int = 3, block_items: int = 100_000, with_keys: bool = False
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Tensored banding: two collections of ``bands`` sub-keys, each of ``rows``
    minima, are paired into ``bands ** 2`` table keys, so 2 * bands * rows
    minima serve tables of 2 * rows minima each. A pair at the threshold of
    0.8 meets in no table with a chance of 4e-4 by default, at 0.85 of 5e-5;
    links within groups hang on many pairs. Every link is confirmed on the
    full sets.

    Documents with one and the same set (by a 128-bit digest of it) collapse
    into one node first, so copies cost one row each. Sets hold 64-bit hashes
    of shingles: two different shingles of a pair of documents with n between
    them are taken for one with a chance of n² / 2^65. In a bucket, members are compared with its
    least node. Where a bucket then still holds two components, its nodes
    are compared with each other, each pair at the first sub-key it shares
    and only across components, in blocks of about ``block_items`` shingles;
    block pairs are dealt to tasks in bins of about as many shingles, whatever
    the size of a group. So no pair is given up, and none within a component needs comparing.

    Words and folding: runs of non-white-space, A to Z read as a to z. Texts
    with fewer words than ``shingle`` count as one shingle. Null, empty or
    blank texts have no set: they link with nothing and are their own
    component. Rows with the same id and text are one document. Ids that are
    null take part; a component of null ids only has a null id. Further
    columns of ``docs`` are not read. An empty table gives an empty result.

    Returns doc_id, n_shingles, component_id (the least id of the group) and
    kept (doc_id is component_id), and with ``with_keys`` the row key.
    """
    signed = materialize(
        docs.select("doc_id", "text", *row_key("doc_id", "text")).mapInArrow(
            _signer(shingle, bands, rows), "doc_id long, _k1 long, _k2 long, node long, check long, n_shingles long, a array<long>, b array<long>"
        ),
        "minhash",
    )
    # a node's name is half of its set's 128-bit digest; should two sets share it, all are named anew by another hash of the whole
    node = F.col("node")
    for turn in range(8):
        nodes = materialize(_nodes_of(signed.withColumn("node", node)), "nodes")
        if nodes.where("check != other").isEmpty():
            break
        node = F.xxhash64("node", "check", F.lit(turn))
    else:
        raise RuntimeError("different sets share a name under every hash")
    signed = signed.withColumn("node", node)
    keys = materialize(_live_keys(nodes), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).where("n > 1")
    buckets = materialize(keys.join(shared.select("key", "centre"), "key"), "buckets")
    pairs = buckets.where("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    links = _verified(pairs, nodes, docs, shingle, percent, node, "star")
    roots = materialize(components(links), "roots")

    labelled = buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    open_nodes = labelled.join(mixed.select("key"), "key", "left_semi").select("node", "root").distinct()
    live = materialize(open_nodes.join(nodes.select("node", "rep", "n_shingles", "a", "b"), "node"), "live")
    sets = materialize(_sets_of(docs, live.select("node", "rep"), shingle, node), "live-sets")
    rows_of = live.select("node", "root", "n_shingles", "a", "b", F.posexplode("a").alias("at", "sub"))
    plan = rows_of.groupBy("at", "sub").agg(F.sum("n_shingles").alias("items"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    plan = plan.select("at", "sub", "items", F.ceil(F.col("items") / block_items).cast("int").alias("blocks"))
    plan = materialize(plan, "block-plan")
    bins = max(1, -(-(plan.agg(F.sum(F.col("items") * F.col("blocks"))).first()[0] or 0) // block_items))
    spread = (
        rows_of.join(plan.drop("items"), ["at", "sub"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("at", "sub", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "node", "root", "n_shingles", "a", "b", "block")
        .join(sets, "node")
    )
    dealt = spread.withColumn("bin", F.pmod(F.xxhash64("at", "sub", "left", "right"), F.lit(bins)))
    more = dealt.groupBy("bin").applyInArrow(_compare_blocks(percent), "u long, v long")
    links = links.unionByName(materialize(more, "block-links"))
    roots = materialize(components(links), "roots")

    named = materialize(nodes.select("node", "rep", "n").join(roots, "node", "left").select("node", "rep", "n", F.coalesce("root", "node").alias("root")), "named")
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("least"), F.count("*").alias("members")), "least")
    group_of = materialize(join_counted(named, least, ["root"], "members").select("node", "least", "n"), "groups")
    columns = ["doc_id", "_k1", "_k2", "node", "n_shingles"]
    blank = signed.where("n_shingles = 0").select(*columns).withColumn("least", F.lit(None).cast("long"))
    member = join_counted(signed.where("n_shingles > 0").select(*columns), group_of, ["node"]).select(*blank.columns).unionByName(blank)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    found = member.select("doc_id", "n_shingles", component, "_k1", "_k2").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return found if with_keys else found.drop("_k1", "_k2")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that ``near_duplicates`` does not keep: one of each group stays.

    That is the one of least id; rows with its id and text all stay, as they
    are one document. A group of null ids only stays whole, and so do null,
    empty and blank texts. Columns are kept, but _k1 and _k2 are dropped. An
    empty table stays empty.
    """
    docs = docs.drop("_k1", "_k2")
    found = near_duplicates(docs, shingle, percent, with_keys=True).where(~F.col("kept")).select("_k1", "_k2")
    return docs.select("*", *row_key("doc_id", "text")).join(found, ["_k1", "_k2"], "left_anti").select(*docs.columns)
