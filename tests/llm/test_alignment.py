"""Alignment of two tokenizers' tokens against a plain loop over the libraries' own results."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from tests.llm.awkward import awkward, empty, texts
from tidecast.llm import token_alignment as t
from tidecast.llm.bpe import byte_letters


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens_of(text, a, b):
    """(id, bytes) lists of both tokenizers; two empty ones where the bytes are not the text's."""
    if not text:
        return [], []
    spelled = {letter: byte for byte, letter in enumerate(byte_letters())}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(spelled[c] for c in a.id_to_token(i))) for i in ids]
    right = [(i, t.PieceTokens.bytes_of_piece(b.id_to_piece(i))) for i in b.encode(text)]
    wanted = (" " + text).encode()
    if any(b"".join(x for _, x in side) != wanted for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    out, i, j = [], 0, 0
    while i < len(left):
        group, ends = ([left[i][0]], [right[j][0]]), [len(left[i][1]), len(right[j][1])]
        i, j = i + 1, j + 1
        while ends[0] != ends[1]:
            if ends[0] < ends[1]:
                group[0].append(left[i][0])
                ends[0] += len(left[i][1])
                i += 1
            else:
                group[1].append(right[j][0])
                ends[1] += len(right[j][1])
                j += 1
        out.append(group)
    return out


def brute(rows, a, b):
    sides = [tokens_of(text, a, b) for _, text in rows]
    groups = [groups_of(*s) for s in sides]
    counts = collections.Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    best = collections.defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (doc_id, _), (left, right), own in zip(rows, sides, groups):
        pairs = [(g[0][-1], g[1][-1]) for g in own]
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((
            doc_id, len(left), len(right), len(own), len(own), sum(counts[p] == best[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest() if own else "",
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*[f.split(" ")[0] for f in t.RESULT.split(", ")]).collect()), key=str)


def test_units_give_the_librarys_ids(libraries):
    import pyarrow as pa

    rng = random.Random(1)
    letters = ["a", "é", " ", " ", "\n", "\t", "  ", "▁", "日本", "🙂", "x y", "<0x41>", "</s>", "the ", "\x00", "ing", ".", "12", "́"]
    column = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(400)]
    column += ["plain words only here", " lead", "trail ", "", "two  spaces"]
    b = t.PieceTokens(P.path("piece_bpe_32k.model"))
    assert b.separable
    for _ in range(2):  # the second time from the cache
        ids, offsets = b.encode(pa.array(column))
        got = [ids[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:])]
        assert got == libraries[1].encode(column)


@pytest.mark.parametrize("lane_bytes", [1, 3, 1000])
def test_lockstep(lane_bytes):
    rng = np.random.default_rng(lane_bytes)
    bounds = np.cumsum(np.append(0, rng.choice([0, 1, 5, 400, 3000], 60)))
    ends = [
        np.unique(np.concatenate([bounds[1:][np.diff(bounds) > 0], rng.integers(1, bounds[-1] + 1, 4000)])) for _ in range(2)
    ]
    links = t.lockstep(*ends, bounds, lane_bytes)
    common = np.intersect1d(*ends)
    assert (ends[0][links[0]] == common).all() and (ends[1][links[1]] == common).all()
    assert len(t.lockstep(np.zeros(0, int), np.zeros(0, int), np.array([0, 0]))[0]) == 0


def test_awkward_rows(spark, libraries):
    extra = [(20, "</s><s> <unk>"), (21, "a▁b"), (22, "  two  spaces "), (22, "  two  spaces "), (23, "fi ½ ﬁ é́"), (24, "<|endoftext|>x")]
    docs = awkward(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    assert rows_of(t.align_tokens(docs)) == brute(texts() + extra, *libraries)
    assert t.align_tokens(empty(spark)).collect() == []


def test_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(t.align_tokens(docs)) == brute(rows, *libraries)
