"""Exact duplicates through an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import text_batches  # noqa: F401  (its code travels with the tasks)
from tidecast.llm.joins import checked, without
from tidecast.sources.tables import staged

BLOCK_ROWS = 1 << 16
FINGERPRINTS_PER_OWNER = 1 << 20

BLOCKS = "sender long, doc_id array<long>, fingerprint array<long>, digest array<binary>"
MESSAGES = "owner long, sender long, n long, shift int, payload binary"
REPLIES = "owner long, sender long, bitmap binary"
HIGHEST = np.uint64(1 << 63)


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Gaps between sorted unsigned values, each in unary (gap >> shift) and `shift` plain bits.

    The Golomb parameter is 2 ** shift. All unary parts come first, so both parts decode in one step.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    ones = np.cumsum((gaps >> np.uint64(shift)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, dtype=np.uint8)
    unary[ones] = 1
    low = (gaps[:, None] >> np.arange(shift, dtype=np.uint64)[None, :]) & np.uint64(1)
    return len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(payload: bytes, n: int, shift: int) -> np.ndarray:
    length = int.from_bytes(payload[:8], "little")
    split = 8 + -(-length // 8)
    unary = np.unpackbits(np.frombuffer(payload[8:split], dtype=np.uint8), count=length)
    high = np.diff(np.flatnonzero(unary), prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(np.frombuffer(payload[split:], dtype=np.uint8), count=n * shift).reshape(n, shift)
    gaps = (high << np.uint64(shift)) | (low.astype(np.uint64) << np.arange(shift, dtype=np.uint64)).sum(
        axis=1, dtype=np.uint64
    )
    return np.cumsum(gaps, dtype=np.uint64)


def unsigned(column) -> np.ndarray:
    """Fingerprints as unsigned numbers in the order of the signed ones."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ HIGHEST


def parts_by_owner(values: np.ndarray, owners: int) -> list[tuple[int, np.ndarray]]:
    """Sorted different values cut into the ranges that the owners hold."""
    width = (1 << 64) // owners + 1
    edges = np.array([o * width for o in range(1, owners)], dtype=np.uint64)
    return [(o, part) for o, part in enumerate(np.split(values, np.searchsorted(values, edges))) if len(part)]


def fingerprint_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of at most BLOCK_ROWS documents, numbered by its sender."""
    normal = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal.alias("normal")).select(
        "doc_id",
        F.xxhash64("normal").alias("fingerprint"),
        F.unhex(F.sha2("normal", 256)).alias("digest"),
        F.spark_partition_id().cast("long").alias("part"),
    )

    def gather(batches):
        held, count, number = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                piece = batch.slice(at, BLOCK_ROWS - count)
                held.append(piece)
                count += piece.num_rows
                at += piece.num_rows
                if count == BLOCK_ROWS:
                    yield as_block(held, number)
                    held, count, number = [], 0, number + 1
        if count:
            yield as_block(held, number)

    def as_block(held, number):
        table = pa.Table.from_batches(held).combine_chunks()
        sender = (table.column("part")[0].as_py() << 24) + number

        def one(name):
            values = table.column(name).combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [pa.array([sender]), one("doc_id"), one("fingerprint"), one("digest")],
            ["sender", "doc_id", "fingerprint", "digest"],
        )

    return rows.mapInArrow(gather, BLOCKS)


def messages(blocks: DataFrame, owners: int) -> DataFrame:
    """Each sender's sorted different fingerprints, coded, one message per owner. A fingerprint that the
    sender itself holds twice goes in a second message of the same kind, so the owner sees it twice."""

    def send(batches):
        for batch in batches:
            for sender, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, times = np.unique(unsigned(values.values), return_counts=True)
                rows = []
                for part in (own, own[times > 1]):
                    for owner, values_of in parts_by_owner(part, owners):
                        mean = ((1 << 64) // owners) // len(values_of)
                        shift = max(0, mean.bit_length() - 1)
                        rows.append((owner, sender, len(values_of), shift, golomb_encode(values_of, shift)))
                columns = zip(*rows)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["owner", "sender", "n", "shift", "payload"]
                )

    return blocks.select("sender", "fingerprint").mapInArrow(send, MESSAGES)


def replies(sent: DataFrame) -> DataFrame:
    """For each message of different fingerprints, a bitmap of those that its owner has met twice."""

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [golomb_decode(x["payload"], x["n"], x["shift"]) for x in rows]
        # The first message of a sender is the longer one: it holds all of its fingerprints.
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        twice = values[times > 1]
        longest: dict[int, int] = {}
        for i, x in enumerate(rows):
            if x["sender"] not in longest or x["n"] > rows[longest[x["sender"]]]["n"]:
                longest[x["sender"]] = i
        bitmaps = [np.packbits(np.isin(lists[i], twice)).tobytes() for i in longest.values()]
        owner = pa.array([rows[i]["owner"] for i in longest.values()], pa.int64())
        return pa.table([owner, pa.array(list(longest), pa.int64()), pa.array(bitmaps, pa.binary())], names=["owner", "sender", "bitmap"])

    return sent.groupBy("owner").applyInArrow(answer, REPLIES)


def suspects(blocks: DataFrame, answered: DataFrame, owners: int) -> DataFrame:
    """The different fingerprints that occur more than once."""
    received = answered.groupBy("sender").agg(F.collect_list(F.struct("owner", "bitmap")).alias("bitmaps"))
    joined = blocks.select("sender", "fingerprint").join(received, "sender").select("fingerprint", "bitmaps")

    def read(batches):
        for batch in batches:
            for values, bitmaps in zip(batch.column(0), batch.column(1).to_pylist()):
                own = dict(parts_by_owner(np.unique(unsigned(values.values)), owners))
                found = [
                    own[x["owner"]][np.unpackbits(np.frombuffer(x["bitmap"], np.uint8), count=len(own[x["owner"]])) > 0]
                    for x in bitmaps
                ]
                signed = (np.concatenate(found) ^ HIGHEST).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed)], ["fingerprint"])

    return joined.mapInArrow(read, "fingerprint long").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal after each run of ASCII white space became one space.

    One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. The smallest doc_id of a
    group stays. Null counts as an empty text. Rows that repeat both a text and the smallest doc_id are
    counted in group_size, and one of them stays. A null doc_id sorts last. An empty table gives no
    rows. Other columns are ignored.

    Blocks of rows send sorted compressed fingerprints to the owners of ranges of fingerprints; owners
    answer with one bit for each. Only texts with a fingerprint met twice are shuffled: they are grouped
    by the text itself, in each task first, so a large group of copies is one row for each task. The
    fingerprints met twice filter the scan as a broadcast up to a checked number of them, and otherwise
    through a join; the result is the same.
    """
    blocks = staged(fingerprint_blocks(docs), "fingerprints")
    total = blocks.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)).alias("n")).first()["n"]
    owners = max(8, -(-total // FINGERPRINTS_PER_OWNER))
    doubtful = staged(suspects(blocks, replies(messages(blocks, owners)), owners), "suspects")
    doubtful = checked(doubtful)

    normal = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal.alias("normal")).withColumn(
        "fingerprint", F.xxhash64("normal")
    )
    verified = (
        texts.join(doubtful, "fingerprint", "left_semi")
        .groupBy("fingerprint", "normal")
        .agg(F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("fingerprint", F.unhex(F.sha2("normal", 256)).alias("digest"), "group_size")
    )
    rows = blocks.select("sender", F.posexplode(F.arrays_zip("doc_id", "fingerprint", "digest")).alias("pos", "row"))
    rows = rows.select("sender", "pos", "row.*")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sender", "pos")
    first = (
        rows.join(doubtful, "fingerprint", "left_semi")
        .groupBy("fingerprint", "digest")
        .agg(F.min(place).alias("first"))
        .join(verified, ["fingerprint", "digest"])
    )
    joined = rows.join(first, ["fingerprint", "digest"], "left")
    alone = F.col("first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | ((F.col("first.sender") == F.col("sender")) & (F.col("first.pos") == F.col("pos")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns: one of each group of equal texts."""
    found = exact_duplicates(docs).groupBy("doc_id", "text_sha256")
    found = staged(found.agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decisions")
    normal = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")

    def key(digest):
        return F.concat_ws(":", F.col("doc_id").cast("string"), digest)

    keyed = docs.withColumn("_dedup_key", key(F.sha2(normal, 256)))
    named = found.select("kept", "n", key(F.col("text_sha256")).alias("_dedup_key"))
    left = without(keyed, named.filter(~F.col("kept")), "_dedup_key")
    again = checked(staged(named.filter("kept AND n > 1").select("_dedup_key"), "repeated"))
    once = left.join(again, "_dedup_key", "left_anti").select(*docs.columns)
    return once.union(left.join(again, "_dedup_key", "left_semi").dropDuplicates(["_dedup_key"]).select(*docs.columns))
