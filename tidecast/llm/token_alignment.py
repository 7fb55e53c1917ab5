"""Alignment of the tokens that two tokenizers give for the same texts."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.bpe import byte_letters
from tidecast.llm.packing import PieceEncoder
from tidecast.llm.shards import found_array, listed, regrouped, shard_numbers
from tidecast.llm.text_batches import Texts, binary_array, slices, spread, texts_of, worker_cache
from tidecast.sources.tables import staged

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
CACHED_UNITS = 250_000
PART_BYTES = 1 << 19
LANE_BYTES = 1 << 10
SPACE_MARK = "▁"

DOCUMENTS = "array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>"
SHARDS = f"shard long, docs {DOCUMENTS}, a array<long>, b array<long>, times array<long>, links binary"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class ByteTokens:
    """Tokenizer A: the bytes each id stands for, and the ids of whole texts."""

    def __init__(self, path: str):
        self.encoder = PieceEncoder(path)
        self.encoder.whole.encode_special_tokens = True  # their strings in a text are then ordinary text
        spelled = {letter: byte for byte, letter in enumerate(byte_letters())}
        vocabulary = self.encoder.whole.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(c in spelled for c in token):
                self.bytes_of[number] = bytes(spelled[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes_of])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.encoder.known) > CACHED_UNITS:
            self.encoder.known.clear()
        return self.encoder.encode(column)


class PieceTokens:
    """Tokenizer B. It puts a space before a text, and no piece holds a space after another character, so a
    text with single spaces only is encoded as its units, a space and what follows, each different one once.
    Other texts go to the library whole."""

    ODD = r"^ |  | $|▁"

    def __init__(self, path: str):
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.whole.id_to_piece(i) for i in range(self.whole.vocab_size())]
        self.bytes_of = [self.bytes_of_piece(p) for p in pieces]
        self.sizes = np.array([len(x) for x in self.bytes_of])
        self.separable = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def bytes_of_piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE_MARK, " ").encode()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(column, self.ODD).to_numpy(zero_copy_only=False)
        odd |= not self.separable
        texts = texts_of(pc.if_else(pa.array(~odd), column, "") if odd.any() else column)
        starts = np.zeros(len(texts.data), dtype=bool)
        starts[texts.data == 0x20] = True
        starts[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
        at = np.flatnonzero(starts)
        letters = texts.data != 0x20
        before = np.append(0, np.cumsum(letters))
        units = binary_array(texts.data[letters], before[np.append(at, len(letters))]).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        fresh = [u for u in distinct if u not in self.known]
        new = dict(zip(fresh, self.ids_of([u.decode() for u in fresh])))
        of_unit = units.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, first = spread([self.known.get(u) or new.get(u, b"") for u in distinct], of_unit, "<u4")
        self.known.update(list(new.items())[: max(0, CACHED_UNITS - len(self.known))])
        offsets = first[np.searchsorted(at, texts.offsets)]
        if not odd.any():
            return ids, offsets
        parts = [ids[offsets[i] : offsets[i + 1]] for i in range(texts.count)]
        where = np.flatnonzero(odd)
        for i, own in zip(where, self.ids_of([column[int(i)].as_py() for i in where])):
            parts[i] = np.frombuffer(own, dtype="<u4")
        offsets = np.zeros(texts.count + 1, dtype=np.int64)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        return np.concatenate(parts), offsets

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.whole.encode(texts, num_threads=1)] if texts else []


def equal_bytes(texts: Texts, ids: np.ndarray, offsets: np.ndarray, bytes_of: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are the text."""
    data, starts = spread(bytes_of, ids, "u1")
    same = np.diff(starts[offsets]) == np.diff(texts.offsets)
    if same.all():
        return texts.per_text(data != texts.data) == 0
    for i in np.flatnonzero(same):
        own = data[starts[offsets[i]] : starts[offsets[i + 1]]]
        same[i] = (own == texts.data[texts.offsets[i] : texts.offsets[i + 1]]).all()
    return same


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray, lane_bytes: int = LANE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B that end at the same byte, in order.

    `ends_*` are the byte ends of all documents' tokens, laid end to end, and `bounds` the byte bounds of
    the documents. A document is one lane, a long one several, each for a range of bytes: where tokens end
    in one range does not depend on others. One state vector holds the pointers of all lanes. Each step
    moves the pointer whose token ends first, or both where they end together, which is a link and a cut;
    lanes that have passed their range leave the vector.
    """
    lengths = np.diff(bounds)
    lanes = -(-lengths // lane_bytes)
    first = np.cumsum(lanes) - lanes
    low = np.repeat(bounds[:-1], lanes) + (np.arange(int(lanes.sum())) - np.repeat(first, lanes)) * lane_bytes
    high = np.minimum(low + lane_bytes, np.repeat(bounds[1:], lanes))
    beyond = np.int64(1) << np.int64(62)
    ends_a, ends_b = np.append(ends_a, beyond), np.append(ends_b, beyond)
    state = np.stack([np.searchsorted(ends_a, low, side="right"), np.searchsorted(ends_b, low, side="right"), high])
    links_a, links_b = [], []
    while state.shape[1]:
        end_a, end_b = ends_a[state[0]], ends_b[state[1]]
        inside = (end_a <= state[2]) & (end_b <= state[2])
        if not inside.all():
            state, end_a, end_b = state[:, inside], end_a[inside], end_b[inside]
        together = end_a == end_b
        links_a.append(state[0, together])
        links_b.append(state[1, together])
        state[0] += end_a <= end_b
        state[1] += end_b <= end_a
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Links of a lane come out in order, lanes side by side; both pointers rise together.
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


def digits_below(size: int) -> list[bytes]:
    """`,` and each number below a power of two that is at least `size`."""
    cache, size = worker_cache("digits"), 1 << max(16, (size - 1).bit_length())
    if size not in cache:
        cache[size] = [b"," + str(n).encode() for n in range(size)]
    return cache[size]


def group_texts(ids_a, ids_b, links_a, links_b) -> tuple[np.ndarray, np.ndarray]:
    """All groups written out, `;` in front of each, and where each token's text starts.

    A's tokens of a group come first, then B's. The place of each in the whole sequence follows from how
    many tokens of the other side come before it.
    """
    total_a, total_b = len(ids_a), len(ids_b)
    group_a = np.searchsorted(links_a, np.arange(total_a))
    group_b = np.searchsorted(links_b, np.arange(total_b))
    before_b = np.append(0, links_b + 1)  # B tokens before each group
    place_a = np.arange(total_a) + before_b[group_a]
    place_b = np.arange(total_b) + (links_a + 1)[group_b]
    sequence = np.empty(total_a + total_b, dtype=np.int64)
    sequence[place_a], sequence[place_b] = ids_a, ids_b
    text, starts = spread(digits_below(int(sequence.max(initial=0)) + 1), sequence, "u1")
    head_a = np.diff(group_a, prepend=-1) != 0
    head_b = np.diff(group_b, prepend=-1) != 0
    text[starts[place_a[head_a]]] = ord(";")
    text[starts[place_b[head_b]]] = ord("|")
    return text, starts


def doc_ranges(offsets: np.ndarray, limit: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive documents of at most `limit` bytes together, one at least."""
    start, count = 0, len(offsets) - 1
    while start < count:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, stop
        start = stop


def aligned_batch(part: pa.RecordBatch, a: ByteTokens, b: PieceTokens, lane_bytes: int = LANE_BYTES) -> dict:
    """The alignment of a slice of documents: counts and digests per document, and the id pair of each link."""
    texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(pa.array(filled), pc.binary_join_element_wise(space, texts, nothing), nothing)
    sides = [(*a.encode(spaced), a.bytes_of, a.sizes), (*b.encode(texts), b.bytes_of, b.sizes)]
    whole = texts_of(spaced)
    # Bytes and digits of tokens take many times a text's room, so they are made for some documents at a time.
    found = [
        _aligned(
            Texts(whole.data[whole.offsets[i] : whole.offsets[j]], whole.offsets[i : j + 1] - whole.offsets[i]),
            filled[i:j],
            [(ids[at[i] : at[j]], at[i : j + 1] - at[i], spelled, sizes) for ids, at, spelled, sizes in sides],
            lane_bytes,
        )
        for i, j in doc_ranges(whole.offsets)
    ]
    joined = {name: np.concatenate([x[name] for x in found]) for name in (*COUNTS, "pairs")} if found else {}
    return {**joined, "groups_sha256": [d for x in found for d in x["groups_sha256"]]}


def _aligned(texts: Texts, filled: np.ndarray, sides: list, lane_bytes: int) -> dict:
    good = filled.copy()
    for ids, at, spelled, _ in sides:
        good &= equal_bytes(texts, ids, at, spelled)
    bounds = np.append(0, np.cumsum(np.where(good, np.diff(texts.offsets), 0)))
    kept = []
    for ids, at, _, sizes in sides:
        own = ids[np.repeat(good, np.diff(at))].astype(np.int64)
        kept.append((own, np.append(0, np.cumsum(np.where(good, np.diff(at), 0))), np.cumsum(sizes[own])))
    (ids_a, at_a, ends_a), (ids_b, at_b, ends_b) = kept
    links_a, links_b = lockstep(ends_a, ends_b, bounds, lane_bytes)
    text, starts = group_texts(ids_a, ids_b, links_a, links_b)
    cut = starts[at_a + at_b]
    n_links = np.diff(np.searchsorted(links_a, at_a))
    return {
        "n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": n_links, "n_links": n_links,
        "groups_sha256": [
            hashlib.sha256(text[s + 1 : e].tobytes()).hexdigest() if e > s else "" for s, e in zip(cut[:-1], cut[1:])
        ],
        "pairs": (ids_a[links_a] << 32) | ids_b[links_b],
    }


def place_type(size: int) -> str:
    """The smallest type for places in a list of so many pairs."""
    return "<u2" if size <= 1 << 16 else "<u4"


def alignment_shards(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Slices of documents with the different id pairs of their links and the place of each link's pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, numbers = worker_cache("alignment"), shard_numbers()
        if (byte_path, piece_path) not in cache:
            cache[byte_path, piece_path] = ByteTokens(byte_path), PieceTokens(piece_path)
        for batch in batches:
            for part in slices(batch, "text"):
                found = aligned_batch(part, *cache[byte_path, piece_path])
                columns = [part.column("doc_id"), *[pa.array(found[n]) for n in COUNTS], pa.array(found["groups_sha256"])]
                rows = pa.StructArray.from_arrays(columns, ["doc_id", *COUNTS, "groups_sha256"])
                pairs, place, times = np.unique(found["pairs"], return_inverse=True, return_counts=True)
                lists = [listed(pa.array(x)) for x in (pairs >> 32, pairs & 0xFFFFFFFF, times)]
                links = pa.array([place.astype(place_type(len(pairs))).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(numbers)]), listed(rows), *lists, links],
                    ["shard", "docs", "a", "b", "times", "links"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SHARDS)


def pair_counts(shards: DataFrame) -> DataFrame:
    """Each id pair's links in the whole corpus, and whether no other A id is linked with the B id oftener.

    Shards list a pair once, so pairs are summed before the shuffle. B ids are at most as many as B's
    vocabulary has entries.
    """
    pairs = shards.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).groupBy("p.a", "p.b")
    pairs = staged(pairs.agg(F.sum("p.times").alias("count")), "token-pairs")
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """Groups and links between the tokens of a byte-level and a sentence-piece tokenizer for each text.

    One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Both
    tokenizers encode a space and the text. Byte offsets where a token of A and one of B end cut the tokens
    into groups; the two tokens there are linked. A pair's count is the number of its links in all
    documents; n_best counts links whose pair has the highest count of its B id, ties included, and
    count_sum adds up the counts over the links. The digest is of `a1,a2|b1;a3|b2,b3`, ids in order.

    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens:
    its numbers are 0 and its digest is empty. Repeated rows and equal doc_ids are rows of their own and
    count each time; a null doc_id stays null. A very long text is a slice of its own and is merged in
    lanes, so the steps do not grow with its length. An empty table gives no rows. Other columns are ignored.

    Texts are encoded once. The aligned slices are stored with the place of each link in a list of the
    slice's pairs, so the corpus-wide counts reach the links by one row per slice and pair.
    """
    byte_path = byte_path or public_tokenizers.path(BYTE_TOKENIZER)
    piece_path = piece_path or public_tokenizers.path(PIECE_TOKENIZER)
    shards = staged(alignment_shards(docs, byte_path, piece_path), "alignment")
    pairs = staged(pair_counts(shards), "token-pairs")
    entries = shards.select("shard", F.posexplode(F.arrays_zip("a", "b")).alias("pos", "p"))
    entries = entries.select("shard", "pos", "p.a", "p.b").join(pairs, ["a", "b"])
    narrow = shards.select("shard", "docs", "links", F.size("a").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("docs")[i].values
                found, size = batch.column("found")[i].values, batch.column("size")[i].as_py()
                place = np.frombuffer(batch.column("links")[i].as_buffer(), dtype=place_type(size))
                ends = np.append(0, np.cumsum(rows.field("n_links").to_numpy(zero_copy_only=False)))

                def summed(name):
                    values = found_array(found, name, size, np.int64)
                    return np.diff(np.append(0, np.cumsum(values[place]))[ends])

                sums = [pa.array(summed("best")), pa.array(summed("count"))]
                columns = [rows.field("doc_id"), *[rows.field(n) for n in COUNTS], *sums, rows.field("groups_sha256")]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
                )

    resolved = regrouped(narrow, entries, ["count", "best"])
    return resolved.select("docs", "links", "size", "found").mapInArrow(run, RESULT)
