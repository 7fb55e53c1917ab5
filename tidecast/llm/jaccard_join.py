"""Exact Jaccard join on word shingles by grouped prefixes, with the components of its links.

Shingles have a global order: rare ones first, frequent ones by their frequency. Two sets that link share
one of the first shingles of each, the prefix. Texts with equal sets are one class; classes with the same prefix and size are one
group, and only groups have entries in the index. Groups that share a prefix shingle meet in a cell;
filtered group pairs are expanded to classes, and these are verified on whole sets.

A cell with many members is not compared all with all: its members are compared with a pivot, links
join components, and only what is still in different components goes on. A link between two classes
that are already in one component cannot change the result. The pivot is the member with the smallest
share of shingles before the cell's: these are rarer, so it has least that the others lack. What is before
the cell's shingle also bounds how much two members can share when that shingle is their first common one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.joins import checked, without
from tidecast.llm.text_batches import Texts, give_back_memory, lower_ascii, slices, texts_of, words_of
from tidecast.sources.tables import staged

FREQUENT_SHINGLES = 1 << 20  # bound on the shingles that are known to be frequent
LEAST_FREQUENT = 8
SLICE_BYTES = 1 << 19
HELD_SHINGLES = 2_000_000
SMALL_CELL = 24
PIVOT_ROUNDS = 2

PREFIXES = "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>, bits binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of all texts, sorted within each text, and where each text starts.

    A text with fewer words than `size` has all its words as one shingle; one without words has none.
    """
    words = words_of(texts, lower_ascii)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), np.uint64, len(words.distinct))
    hashes = hashes[words.ids] if len(words.ids) else hashes
    counts = np.bincount(words.doc, minlength=texts.count)
    firsts = np.cumsum(counts) - counts
    last = np.repeat(firsts + counts, counts)  # end of the text of each word
    at = np.arange(len(hashes))
    starts_one = at + size <= last
    starts_one[firsts[(counts > 0) & (counts < size)]] = True
    at = at[starts_one]
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        inside = at + j < last[at]
        value = np.where(inside, mixed(value + hashes[np.minimum(at + j, len(hashes) - 1)] + np.uint64(j)), value)
    doc = words.doc[at]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(texts.count + 1))


def fingerprint(values: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set, from the sum of its hashed members."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mixed(values + np.uint64(salt)), out=sums[1:])
    return mixed(sums[starts[1:]] - sums[starts[:-1]] + (starts[1:] - starts[:-1]).astype(np.uint64))


def bitmaps(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """For each set a bitmap of two to four bits per member, a power of two long."""
    n = np.diff(starts)
    length = 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    ends = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(length, out=ends[1:])
    doc = np.repeat(np.arange(len(n)), n)
    bits = np.zeros(ends[-1], dtype=np.uint8)
    bits[ends[:-1][doc] + (mixed(values + np.uint64(5)) & (length[doc] - 1).astype(np.uint64)).astype(np.int64)] = 1
    packed, ends = np.packbits(bits, bitorder="little"), ends // 8
    return [packed[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def most_shared(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """A bound on the size of the intersection: a member whose bit the other lacks is not shared."""
    if len(x) > len(y):
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches; when it has ended, its worker holds no memory for it."""

    def tidied(batches):
        yield from run(batches)
        give_back_memory()

    return tidied


def repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values those that are there twice or more, and how often; single ones take no memory."""
    again = np.zeros(len(values) + 1, dtype=bool)
    np.equal(values[1:], values[:-1], out=again[1 : len(values)])
    starts, ends = np.flatnonzero(again[1:] > again[:-1]), np.flatnonzero(again[1:] < again[:-1])
    return values[starts], ends - starts + 1


def frequent_shingles(docs: DataFrame, size: int, most: int = FREQUENT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many different texts share, sorted, and the level of each: twice the logarithm of its count.

    Each task counts its shingles over texts with different sets and reports those it met twice or more.
    The list has all levels from the lowest, of LEAST_FREQUENT or more, that keeps it within `most` shingles.
    It sets the order of shingles only; the result does not depend on it.
    """

    def count(batches):
        held, seen, n = [], set(), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values, starts = shingle_sets(texts_of(part.column("text")), size)
                fresh = np.zeros(len(starts) - 1, dtype=bool)
                for i, print_ in enumerate(fingerprint(values, starts, 1).tolist()):
                    fresh[i] = print_ not in seen
                    seen.add(print_)
                held.append(values[np.repeat(fresh, np.diff(starts))])
                n += len(held[-1])
                if n > HELD_SHINGLES:
                    yield report(held)
                    held, seen, n = [], set(), 0
        if held:
            yield report(held)

    def report(held):
        values = np.concatenate(held)
        held.clear()
        values.sort()
        shingles, times = repeated(values)
        return pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(times)], ["shingle", "times"])

    text = docs.select(F.col("text").cast("string").alias("text"))
    counted = text.mapInArrow(tidy(count), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    level = F.floor(2 * F.log2(F.col("times").cast("double"))).cast("int")
    counted = staged(counted.filter(F.col("times") >= LEAST_FREQUENT).select("shingle", level.alias("level")), "shingles")
    least, listed = 1 << 7, 0
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        listed += row["count"]
        if listed > most:
            break
        least = row["level"]
    often = counted.filter(F.col("level") >= least).toArrow()
    shingles = often.column(0).to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], often.column(1).to_numpy()[order].astype(np.uint8)


def prefixes(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each text the size of its set, fingerprints of set and prefix, the prefix and a bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, levels = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values, starts = shingle_sets(texts_of(part.column("text")), size)
                n = np.diff(starts)
                doc = np.repeat(np.arange(len(n)), n)
                level = np.zeros(len(values), dtype=np.uint8)
                if len(often):
                    at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                    level = np.where(often[at] == values, levels[at], level)
                ordered = values[np.lexsort((values, level, doc))]
                length = np.where(n > 0, n - -(-n * percent // 100) + 1, 0)
                first = np.arange(len(values)) - starts[:-1][doc] < length[doc]
                ordered = ordered[first]
                ends = np.zeros(len(n) + 1, dtype=np.int64)
                np.cumsum(length, out=ends[1:])
                columns = [
                    part.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    *(pa.array(fingerprint(values, starts, salt).view(np.int64)) for salt in (1, 2)),
                    *(pa.array(fingerprint(ordered, ends, salt).view(np.int64)) for salt in (3, 4)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ordered.view(np.int64))),
                    pa.array(bitmaps(values, starts), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "p1", "p2", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), PREFIXES
    )


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The sorted shingles of the documents named in `wanted` (doc_id): cid, shingles as bytes."""
    wanted = checked(staged(wanted, "wanted"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                values, starts = shingle_sets(texts_of(part.column("text")), size)
                sets = [values[a:b].tobytes() for a, b in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(wanted, "doc_id", "left_semi").mapInArrow(tidy(run), "cid long, shingles binary")


def verified(docs: DataFrame, pairs: DataFrame, bits: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= percent * union.

    Bitmaps, some thirty times smaller than sets, rule out most other pairs; the sets of the rest are
    made from their texts and compared whole.
    """

    def possible(batches):
        for batch in batches:
            good = []
            for x, n, y, m in zip(*(batch.column(c) for c in ("left_bits", "left_n", "right_bits", "right_n"))):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint8) for z in (x, y))
                n, m = n.as_py(), m.as_py()
                both = most_shared(x, n, y, m)
                good.append(100 * both >= percent * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("left_set"), batch.column("right_set")):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = bits.select(F.col("cid").alias("a"), F.col("n").alias("left_n"), F.col("bits").alias("left_bits"))
    right = bits.select(F.col("cid").alias("b"), F.col("n").alias("right_n"), F.col("bits").alias("right_bits"))
    likely = pairs.select("a", "b").join(left, "a").join(right, "b")
    likely = staged(likely.mapInArrow(tidy(possible), "a long, b long"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = staged(whole_sets(docs, wanted, size), "sets")
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("right_set"))
    return likely.join(left, "a").join(right, "b").mapInArrow(tidy(check), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of (a, b): node, component.

    Alternates two steps until nothing changes: every node's larger neighbours, then its smaller ones,
    are linked to its smallest neighbour. The links of each round are written.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(small.select("u", F.col("m").alias("v")))
        after = staged(small.distinct(), "links")
        # All links are stars around smallest nodes when each node has one and no centre has any.
        crowded = after.groupBy("u").agg(F.count("*").alias("n"), F.max("v").alias("v"))
        centres = after.select(F.col("v").alias("u")).distinct()
        if not crowded.filter("n > 1").head(1) and not after.join(centres, "u", "left_semi").head(1):
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def compatible(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def reach(n: Column, pos: Column, percent: int) -> Column:
    """`percent` times the largest set that one of n shingles can link with if they share none before `pos`.

    All they share is then among n - pos shingles, and must be at least percent / (100 + percent) of both sizes.
    """
    return (100 + percent) * (n - pos) - percent * n


def in_reach(n1: str, reach1: str, n2: str, reach2: str, percent: int) -> Column:
    """Sizes can link, and so can what is left after the first common shingle on both sides."""
    possible = (percent * F.col(n2) <= F.col(reach1)) & (percent * F.col(n1) <= F.col(reach2))
    return compatible(F.col(n1), F.col(n2), percent) & possible


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, small_cell: int = SMALL_CELL) -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their shingle sets.

    One row per row of `docs`: doc_id, n_shingles, component_id, the smallest doc_id reachable by links,
    itself included. A-Z are lower-cased; words are `[^\\x20\\x09-\\x0D]+`; a text with fewer than `size`
    words has all of them as one shingle. A null, empty or blank text has no shingles and links with
    nothing, not even its like. Rows with equal texts are one class whatever their number. A row without
    a doc_id has no component and is no link. An empty table gives no rows. Other columns are ignored.
    """
    rows = staged(prefixes(docs, size, percent, frequent_shingles(docs, size)), "prefixes")
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = staged(some.groupBy("n", "s1", "s2", "p1", "p2").agg(F.min("doc_id").alias("cid"), F.first("bits").alias("bits")), "classes")
    groups = staged(
        some.groupBy("n", "p1", "p2").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix")), "groups"
    )
    members = staged(
        classes.join(groups.select("n", "p1", "p2", "gid"), ["n", "p1", "p2"]).select("gid", "cid", "n"), "members"
    )

    # Entries of the index that more than one group has.
    entries = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = entries.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1").select("shingle")
    width = float(np.log(100 / percent))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")
    met = entries.join(shared, "shingle").select("shingle", "gid", "n", "pos", band.alias("band"))
    # Sizes that can link are in one band or in neighbouring ones: each entry is in its own and the next.
    met = met.select(F.explode(F.array("band", F.col("band") + 1)).alias("cell_band"), "shingle", "gid", "n", "pos")
    met = met.withColumn("cell", F.struct("shingle", "cell_band"))
    sizes = met.groupBy("cell").agg(F.count("*").alias("k")).filter("k > 1")
    met = staged(met.join(sizes, "cell").select("cell", "gid", "n", "pos", "k"), "cells")

    # Cells of few groups: all pairs, which filters on size and on what can follow the first shared shingle.
    # A pair that passes passes in the cell of that shingle.
    met = met.withColumn("reach", reach(F.col("n"), F.col("pos"), percent))
    few = met.filter(F.col("k") <= small_cell).select("cell", "gid", "n", "reach")
    other = few.select("cell", F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("reach").alias("reach2"))
    group_pairs = (
        few.join(other, "cell")
        .filter((F.col("gid") < F.col("gid2")) & in_reach("n", "reach", "n2", "reach2", percent))
        .select("gid", "gid2")
        .distinct()
    )
    group_pairs = staged(group_pairs, "group-pairs")

    # What has to be compared, class by class, as cells: a group; a pair of groups; a crowded cell.
    members = members.withColumn("first", F.lit(0))
    one = members.groupBy("gid").agg(F.count("*").alias("k")).filter("k > 1").select("gid")
    inside = members.join(one, "gid").select(F.struct(F.lit(0).alias("kind"), F.col("gid").alias("x"), F.col("gid").alias("y")).alias("cell"), "cid", "n", "first")
    kind = F.struct(F.lit(1).alias("kind"), F.col("gid").alias("x"), F.col("gid2").alias("y")).alias("cell")
    sides = group_pairs.select(kind, F.explode(F.array("gid", "gid2")).alias("gid"))
    between = sides.join(members, "gid").select("cell", "cid", "n", "first")
    many = (
        met.filter(F.col("k") > small_cell)
        .select(F.struct(F.lit(2).alias("kind"), F.col("cell.shingle").alias("x"), F.col("cell.cell_band").cast("long").alias("y")).alias("cell"), "gid", "pos")
        .join(members, "gid")
        .select("cell", "cid", "n", F.col("pos").alias("first"))
    )
    many = with_partner(many, percent)
    work = staged(inside.union(between).union(many), "work")
    # A member that is not yet linked, or else the first of its component, with least before the cell's shingle.
    central = F.struct((F.col("component") != F.col("cid")).alias("linked"), (F.col("first") / F.col("n")).alias("before"), F.xxhash64("cid").alias("h"), "cid", "n", "component")
    bits = classes.select("cid", "n", "bits")
    found, labels = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        labelled = work.withColumn("component", F.col("cid"))
        if labels is not None:
            labelled = work.join(labels, work.cid == labels.node, "left").select(
                "cell", "cid", "n", "first", F.coalesce("component", "cid").alias("component")
            )
        mixed_cells = labelled.groupBy("cell").agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min(central).alias("pivot"),
            F.count("*").alias("k"),
        ).filter("low <> high")
        open_cells = staged(labelled.join(mixed_cells.drop("low", "high"), "cell"), "open")
        if not open_cells.head(1):
            break
        crowded = (F.col("k") > small_cell) if turn < PIVOT_ROUNDS else F.lit(False)
        with_pivot = open_cells.filter(crowded & (F.col("component") != F.col("pivot.component"))).select(
            F.col("cid").alias("a"), F.col("pivot.cid").alias("b"), F.col("n").alias("n1"), F.col("pivot.n").alias("n2")
        )
        rest = open_cells.filter(~crowded)
        pairs = with_pivot.filter(compatible(F.col("n1"), F.col("n2"), percent)).select("a", "b")
        pairs = pairs.union(remaining_pairs(rest, percent))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = staged(verified(docs, staged(pairs, "pairs"), bits, size, percent), "verified")
        found = new if found is None else found.union(new)
        labels = components(found)
        # A pivot has been compared with its whole cell; small cells are done.
        work = open_cells.filter(crowded & (F.col("cid") != F.col("pivot.cid"))).select("cell", "cid", "n", "first")

    in_class = classes.select("n", "s1", "s2", "cid")
    if labels is not None:
        in_class = in_class.join(labels, in_class.cid == labels.node, "left").select(
            "n", "s1", "s2", F.coalesce("component", "cid").alias("cid")
        )
    narrow = rows.select("doc_id", "n", "s1", "s2")
    joined = narrow.join(staged(in_class, "components"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.col("cid"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def with_partner(cells: DataFrame, percent: int) -> DataFrame:
    """The members of cells that are in reach of some size of the cell, at the longest reach met with that size.

    A frequent shingle puts all loose copies of a text in its cell; most have too much before it to link there.
    """
    cells = cells.withColumn("reach", reach(F.col("n"), F.col("first"), percent))
    sizes = cells.groupBy("cell", F.col("n").alias("n2")).agg(F.max("reach").alias("reach2"))
    same = F.struct("cell.kind", "cell.x", "cell.y")
    left, right = cells.withColumn("key", same), sizes.select(same.alias("key2"), "n2", "reach2")
    met = left.join(right, (F.col("key") == F.col("key2")) & in_reach("n", "reach", "n2", "reach2", percent), "left_semi")
    return met.select("cell", "cid", "n", "first")


def remaining_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of a cell in different components, but for those within its largest component's own rows:
    members outside it are compared with all others that are in reach."""
    sizes = cells.groupBy("cell", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("cell").agg(F.max(F.struct("m", "component")).alias("largest"))
    cells = cells.withColumn("reach", reach(F.col("n"), F.col("first"), percent))
    outside = (
        cells.join(largest, "cell")
        .filter(F.col("component") != F.col("largest.component"))
        .select("cell", F.col("cid").alias("a"), F.col("n").alias("n1"), F.col("reach").alias("r1"), F.col("component").alias("c1"))
    )
    every = cells.select("cell", F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("reach").alias("r2"), F.col("component").alias("c2"))
    return outside.join(every, "cell").filter((F.col("c1") != F.col("c2")) & in_reach("n1", "r1", "n2", "r2", percent)).select("a", "b")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with their columns: of each component the document with the smallest doc_id.

    Rows that share a doc_id go or stay together; rows without one stay.
    """
    found = jaccard_components(docs, size, percent)
    return without(docs, found.filter("component_id <> doc_id"), "doc_id")
