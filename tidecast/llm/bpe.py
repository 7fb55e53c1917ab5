"""Byte-pair encoding by speculation: greedy longest matches, checked in one go, merged only on failure."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.text_batches import pieces_of, slices, spread, texts_of, worker_cache

TOKENIZER = "word_bpe_49k.json"
CACHED_PIECES = 600_000
NEVER = 1 << 30
WORD_END = "\n"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printed}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(printed))
    return [letters[b] for b in range(256)]


class SpeculativeEncoder:
    """Encodes words with the merges of a vocabulary file and decodes ids.

    A sequence of tokens is what the merges produce exactly if no adjacent pair would have been merged
    across its boundary earlier. Left of a boundary the symbols at the edge are the token, its right
    half, the right half of that and so on; each exists from its own merge until its parent's. The same
    holds on the right with left halves. The pair is broken if a merge of two such edges comes first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        size = max(self.names) + 1
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.made = np.full(size, -1)  # rank of the merge that makes a token, -1 for single symbols
        merges = [merge if isinstance(merge, list) else merge.split(" ") for merge in model["merges"]]
        pairs = np.array([(self.vocab[a], self.vocab[b]) for a, b in merges], dtype=np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        first = np.unique(self.merged, return_index=True)[1]
        self.left[self.merged[first]], self.right[self.merged[first]] = pairs[first].T
        self.made[self.merged[first]] = first
        self.pair_keys, self.pair_ranks = np.unique((pairs[:, 0] << 32) | pairs[:, 1], return_index=True)
        self.matcher, self.spelled = ahocorasick.Automaton(), np.zeros(size, dtype=np.int64)
        for token, i in self.vocab.items():
            token = token.removesuffix(self.suffix) + WORD_END if token.endswith(self.suffix) else token
            self.spelled[i] = len(token)
            self.matcher.add_word(token, i)
        self.matcher.make_automaton()
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.splitter = regex.compile("\n|" + splits[0]["pattern"]["Regex"])
        self.special_splitter = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def normalise(self, text: str) -> str:
        """NFC, then lower case letter by letter (a capital sigma at the end of a word is no exception)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest matches over all words at once: token ids, the word of each, and for each word
        whether its tokens cover it. One letter stands for the word end, so only a last token has it."""
        text = WORD_END.join(words) + WORD_END
        found = np.fromiter((x for match in self.matcher.iter_long(text) for x in match), np.int64).reshape(-1, 2)
        stops = np.cumsum([len(w) + 1 for w in words])
        owner = np.searchsorted(stops, found[:, 0], side="right")
        covered = np.bincount(owner, self.spelled[found[:, 1]], len(words))
        return found[:, 1], owner, covered == np.diff(stops, prepend=0)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER if there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def pairs_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair (left token, right token) can stand side by side."""
        holds = np.ones(len(left), dtype=bool)
        a, a_until = left.copy(), np.full(len(left), NEVER)
        while len(on := np.flatnonzero(a >= 0)):
            b, b_until = np.where(a >= 0, right, -1), np.full(len(left), NEVER)
            while len(both := np.flatnonzero(b >= 0)):
                rank = self.rank_of(a[both], b[both])
                # Of merges of one rank the leftmost comes first: before the right parent's, after the left one's.
                holds[both[(rank < a_until[both]) & (rank <= b_until[both]) & (rank < NEVER)]] = False
                b_until[both] = self.made[b[both]]
                b[both] = self.left[b[both]]
            a_until[on] = self.made[a[on]]
            a[on] = self.right[a[on]]
        return holds

    def merge(self, words: list[str]) -> list[list[int]]:
        """The merges applied exactly, to all words side by side: in each round every word makes its merge
        of lowest rank, at all places from the left."""
        spelled = [[*w[:-1], w[-1] + self.suffix] for w in words]
        ids = np.fromiter((self.vocab[c] for w in spelled for c in w), np.int64)
        owner = np.repeat(np.arange(len(words)), list(map(len, words)))
        ranks = np.full(len(ids), NEVER)
        ranks[:-1] = np.where(owner[1:] == owner[:-1], self.rank_of(ids[:-1], ids[1:]), NEVER)
        while True:
            starts = np.searchsorted(owner, np.arange(len(words) + 1))
            best = np.repeat(np.minimum.reduceat(ranks, starts[:-1]), np.diff(starts))
            at = np.flatnonzero((ranks == best) & (best < NEVER))
            if not len(at):
                flat, bounds = ids.tolist(), starts.tolist()
                return [flat[bounds[i] : bounds[i + 1]] for i in range(len(words))]
            # Of overlapping places, as in "aaa", every other one counts.
            first = np.append(True, np.diff(at) > 1)
            at = at[(at - at[first][np.cumsum(first) - 1]) % 2 == 0]
            ids[at] = self.merged[ranks[at]]
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            ids, owner, ranks = ids[kept], owner[kept], ranks[kept]
            at = at - np.arange(len(at))
            at = np.union1d(at, at[at > 0] - 1)
            ranks[at] = NEVER
            at = at[at < len(ids) - 1]
            at = at[owner[at] == owner[at + 1]]
            ranks[at] = self.rank_of(ids[at], ids[at + 1])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of different words given in vocabulary letters: all proposals are verified in one check."""
        ids, owner, good = self.propose(words)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, where = np.unique((ids[inside] << 32) | ids[inside + 1], return_inverse=True)
        holds = self.pairs_hold(keys >> 32, keys & 0xFFFFFFFF)[where]
        good[owner[inside[~holds]]] = False
        starts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        flat = ids.tolist()
        out = [flat[a:b] for a, b in zip(starts, starts[1:])]
        failed = np.flatnonzero(~good).tolist()
        for i, exact in zip(failed, self.merge([words[i] for i in failed]) if failed else []):
            out[i] = exact
        return out

    def encode_texts(self, texts: list[str], known: dict[str, list[int]] | None = None) -> list[list[int]]:
        """Ids of texts without line ends in them. `known` keeps words already encoded."""
        known = {} if known is None else known
        if any("<" in t for t in texts) and self.special_splitter:
            parts = [self.special_splitter.split(t) for t in texts]
        else:
            parts = [[t] for t in texts]
        flat = [("" if x in self.special else x) for p in parts for x in p]
        found = self.splitter.findall(self.normalise("\n".join(flat)) + "\n")
        missing = list(dict.fromkeys(w for w in found if w != "\n" and w not in known))
        for at in range(0, len(missing), 100_000):
            some = missing[at : at + 100_000]
            spelled = [w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()]) for w in some]
            known.update(zip(some, self.encode_words(spelled)))
        out, at = [], 0
        for p in parts:
            ids = []
            for x in p:
                if x in self.special:
                    ids.append(self.special[x])
                while found[at] != "\n":
                    ids += known[found[at]]
                    at += 1
                at += 1
            out.append(ids)
        return out

    def decode(self, ids) -> str:
        """Names of the tokens, one space between them: the vocabulary file names no decoder."""
        return " ".join([self.names[i] for i in ids])


def encode_decode(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Encode every text and decode the ids again: doc_id, ids array<int>, decoded.

    Null counts as empty: no ids and an empty string. Rows are handled one by one, so repeated rows and
    doc_ids are kept as they are. An empty table gives no rows. Other columns are ignored.
    """
    return _mapped(docs, tokenizer_path, _whole, "doc_id long, ids array<long>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """As `encode_decode`, but with digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, tokenizer_path, _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _whole(doc_id, ids, decoded):
    return doc_id, ids.tolist(), decoded


def _digest(doc_id, ids, decoded):
    return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _mapped(docs: DataFrame, tokenizer_path: str | None, finish, schema: str) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    names = [field.split(" ")[0] for field in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[field.split(" ")[1]] for field in schema.split(", ")]

    def run(batches):
        cache = worker_cache(f"bpe {path}")
        coder = cache.get("coder") or SpeculativeEncoder(path)
        cache["coder"], known = coder, cache.setdefault("known", {})
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = encoded_pieces(coder, texts_of(part.column("text")), known)
                rows = []
                for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = ids[starts[i] : starts[i + 1]]
                    rows.append(finish(doc_id, own, coder.decode(own.tolist())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def encoded_pieces(coder: SpeculativeEncoder, texts, known: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts laid end to end and the start of each text, from one encoding of each different piece.

    White space is dropped and joins nothing, and so a text's ids are those of its pieces in turn.
    `known` takes pieces until it is full; those met first are mostly the frequent ones.
    """
    pieces = pieces_of(texts)
    missing = [p for p in pieces.distinct if p not in known]
    coded = coder.encode_texts([p.strip(b" \t\n\x0b\x0c\r").decode() for p in missing])
    fresh = {p: np.array(ids, dtype="<u4").tobytes() for p, ids in zip(missing, coded)}
    at = np.searchsorted(pieces.doc, np.arange(texts.count + 1))
    ids, starts = spread([known.get(p) or fresh.get(p, b"") for p in pieces.distinct], pieces.ids, "<u4")
    known.update(list(fresh.items())[: max(0, CACHED_PIECES - len(known))])
    return ids, starts[at]
