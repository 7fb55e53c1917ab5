"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.bpe import byte_letters
from tidecast.llm.text_batches import pieces_of, slices, spread, texts_of, worker_cache
from tidecast.sources.tables import staged

MAX_TOKENS = 1024
END_ID = 2
PIECES_PER_GROUP = 1 << 15
CACHED_PIECES = 600_000
TOKENIZER = "byte_bpe_50k.json"

# White space outside ASCII, and the separators \x1C to \x1F: a text that has any is encoded in one go.
ODD_SPACE = (
    r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


class PieceEncoder:
    """Token ids of whole texts, equal to those of the tokenizers library.

    The tokenizer's own splitting never joins a word with white space after it, so a text is encoded as
    its pieces (white space, then a word), each different piece once. The same vocabulary in the form of
    ranks encodes pieces. Texts with other kinds of white space or a special token, where pieces are not
    independent, go to the library whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.odd = "|".join([ODD_SPACE, *(s.replace("|", r"\|") for s in sorted(special))])
        spelled = {letter: byte for byte, letter in enumerate(byte_letters())}
        ranks = {bytes(spelled[c] for c in t): i for t, i in self.whole.get_vocab().items() if t not in special}
        self.pieces = tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )._core_bpe
        self.known: dict[bytes, bytes] = {}

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and the start of each text (with the end appended)."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        texts = texts_of(pc.if_else(pa.array(~odd), column, "") if odd.any() else column)
        pieces, known, one = pieces_of(texts), self.known, self.pieces.encode_ordinary
        fresh = {p: array("I", one(p.decode())).tobytes() for p in pieces.distinct if p not in known}
        ids, starts = spread([known.get(p) or fresh[p] for p in pieces.distinct], pieces.ids, "<u4")
        known.update(list(fresh.items())[: max(0, CACHED_PIECES - len(known))])
        offsets = starts[np.searchsorted(pieces.doc, np.arange(texts.count + 1))]
        if not odd.any():
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(texts.count)]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self.whole.encode(column[int(i)].as_py(), add_special_tokens=False).ids, dtype="<u4")
        offsets = np.zeros(texts.count + 1, dtype=np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.concatenate(parts), offsets


def piece_lengths(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter than `most`."""
    first = length % most or most
    return [(0, first)] + [(at, most) for at in range(first, length, most)]


def cut_documents(docs: DataFrame, tokenizer_path: str, most: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        cache = worker_cache("packing")
        if tokenizer_path not in cache:
            cache[tokenizer_path] = PieceEncoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = cache[tokenizer_path].encode(part.column("text"))
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                    for n, (start, length) in enumerate(piece_lengths(len(own), most)):
                        rows.append((doc_id, n, start, length, zlib.crc32(own[start : start + length].tobytes())))
                columns = list(zip(*rows)) or [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.

    Each bin is filled greedily with the longest item that fits. If a gap is left, the bin's shortest
    item gives way to the two unpacked items whose sum fits the widened gap most tightly, when they
    fill it better. Items of equal length are alike, so a count for each length is all the search needs.
    """
    order = np.argsort(lengths, kind="stable")
    firsts = np.searchsorted(lengths[order], np.arange(most + 2))
    taken = firsts.copy()
    counts = np.diff(firsts)
    have = 0  # bit n is set if items of length n are left
    for n in np.flatnonzero(counts):
        have |= 1 << int(n)
    counts = counts.tolist()
    bins, offsets, bin_no = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def longest(room: int) -> int:
        return (have & ((2 << room) - 1)).bit_length() - 1

    def take(n: int) -> None:
        nonlocal have
        counts[n] -= 1
        if not counts[n]:
            have &= ~(1 << n)

    def give(n: int) -> None:
        nonlocal have
        counts[n] += 1
        have |= 1 << n

    def best_pair(room: int) -> tuple[int, int, int]:
        """Largest sum a + b <= room of two unpacked items; (0, 0, 0) if there are none."""
        best, a = (0, 0, 0), longest(room - 1)
        while a > 0 and 2 * a > best[0]:
            take(a)
            b = longest(min(room - a, a))
            give(a)
            if b > 0 and a + b > best[0]:
                best = (a + b, a, b)
                if best[0] == room:
                    break
            a = longest(a - 1)
        return best

    while have:
        held, room = [], most
        while room and (n := longest(room)) > 0:
            take(n)
            held.append(n)
            room -= n
        if room and len(held) > 1 and have:
            total, a, b = best_pair(room + held[-1])
            if total > held[-1]:
                give(held.pop())
                take(a)
                take(b)
                held += [a, b]
        at = 0
        for n in held:
            item = order[taken[n]]
            taken[n] += 1
            bins[item], offsets[item] = bin_no, at
            at += n
        bin_no += 1
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    most: int = MAX_TOKENS,
    end_id: int = END_ID,
    pieces_per_group: int = PIECES_PER_GROUP,
) -> DataFrame:
    """Pack all documents into sequences of at most `most` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts are encoded
    once; only the narrow pieces are shuffled. Pieces go by a hash of their stored row's number, so equal
    rows spread too, to groups of about `pieces_per_group`; each group is packed by itself, so a task holds
    a bounded number and the loss is at most one part-filled sequence for each group. A sequence id is the group and the
    sequence's number in it.

    A null or empty text is one piece with the end id alone. Repeated rows are packed as often as they
    occur. An empty table gives no rows. Other columns are ignored.
    """
    pieces = cut_documents(docs, tokenizer_path or public_tokenizers.path(TOKENIZER), most, end_id)
    pieces = staged(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // pieces_per_group))
    keyed = pieces.withColumn("packing_group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table.column("length").to_numpy(), most)
        group = int(table.column("packing_group")[0].as_py()) if table.num_rows else 0
        return (
            table.drop_columns(["packing_group", "row"])
            .append_column("sequence_id", pa.array((group << 32) + bins))
            .append_column("offset", pa.array(offsets))
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return keyed.groupBy("packing_group").applyInArrow(pack, schema)
