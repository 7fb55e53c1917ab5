"""Phrases against brute force, and the filters' round trips."""

import collections
import random
import re

import numpy as np
import pytest

from tests.llm.awkward import awkward, empty, texts
from tidecast.llm import collocations as c


def brute(rows, minimum, percent=50, reported=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    around = collections.defaultdict(int)
    for (lang, *h), b in f.items():
        if len(h) == 3 and b >= minimum:
            for inner in (h[:2], h[1:]):
                around[lang, *inner] = max(b, around[lang, *inner])
    out = collections.defaultdict(list)
    for (lang, *g), a in f.items():
        if len(g) < 2 or a < minimum:
            continue
        cuts = [(1000000 * a * a // (f[(lang, *g[:k])] * f[(lang, *g[k:])]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        if (lang, *g) in around and 100 * around[lang, *g] >= percent * a:
            continue
        out[lang].append((-score, -a, " ".join(g).encode(), f[(lang, *g[:k])], f[(lang, *g[k:])]))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:reported], 1)
    )


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_permutation_can_be_undone():
    rng = np.random.default_rng(1)
    for bits in (2, 7, 20, 21, 22, 27, 32):
        ids = [rng.integers(0, 1 << bits, 500).astype(np.uint64) for _ in range(3)]
        high, low = c.permuted(*ids, bits)
        assert int(high.max()) < 1 << c.half_bits(bits) > int(low.max())
        assert all((a == b).all() for a, b in zip(c.restored(high, low, bits), ids))


@pytest.mark.parametrize("bits", [3, 9, 30, 45, 64])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    for n in (1, 2, 300, 5000):
        values = np.unique(rng.integers(0, 1 << min(bits, 63), n).astype(np.uint64) << np.uint64(bits == 64))
        if bits > 9:  # some crowded quotients
            values = np.unique(np.concatenate([values, np.arange(40, dtype=np.uint64) + values[0]])) & c.mask(bits)
            values = np.unique(values)
        counts = rng.choice([1, 1, 1, 2, 3, 255, 256, 257, 10**6, 2**40], len(values)).astype(np.int64)
        got, times = c.filter_items(c.filter_of(values, counts, bits), bits)
        assert (got == values).all() and (times == counts).all()


def test_merge_adds_counts():
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, 3000, 1000).astype(np.uint64)) for _ in range(5)]
    values, counts = c.merged([(p, np.arange(1, len(p) + 1)) for p in parts])
    wanted = collections.Counter()
    for p in parts:
        wanted.update(dict(zip(p.tolist(), range(1, len(p) + 1))))
    assert dict(zip(values.tolist(), counts.tolist())) == dict(wanted) and (np.diff(values.astype(int)) > 0).all()


def test_blocks_end_at_breaks():
    rng = random.Random(3)
    data = "".join(rng.choice("ab ,.") for _ in range(2000)) + "x" * 700 + ".end"
    parts = [bytes(b) for b in c.blocks(np.frombuffer(data.encode(), np.uint8), 100)]
    assert b"".join(parts).decode() == data and len(parts) > 15
    assert all(p[-1:] in b".,;:!?\n" for p in parts[:-1])


def test_wide_ids_use_two_limbs():
    rng = np.random.default_rng(5)
    for bits in (10, 26):
        ids = [rng.integers(0, 12, 4000).astype(np.uint64) << np.uint64(bits - 4) for _ in range(3)]
        high, low, counts = c.counted(*c.permuted(*ids, bits), c.half_bits(bits))
        found = zip(*(w.tolist() for w in c.restored(high, low, bits)), counts.tolist())
        assert {x[:3]: x[3] for x in found} == collections.Counter(zip(*(w.tolist() for w in ids)))


def prose():
    rng = random.Random(7)
    words = ["Red", "green", "blue", "ÉTÉ", "été", "x y", "日本", "of", "the", "\x1c"]
    out = []
    for k in range(150):
        parts = [rng.choice(words) for _ in range(rng.randrange(30))]
        if k % 3 == 0:
            parts.insert(len(parts) // 2, "new  York\tcity")
        out.append((rng.choice(["en", "fr", None, "und"]), "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n"]) for p in parts)))
    return out + [("en", None), (None, ""), ("de", "only once here")] + [("en", "same row same row same row")] * 12


def test_collocations(spark):
    rows = prose()
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert rows_of(c.collocations(docs.repartition(5))) == brute(rows, 10)
    # Many owners, and a short report.
    assert rows_of(c.collocations(docs, minimum=3, percent=80, reported=7, per_owner=20)) == brute(rows, 3, 80, 7)


def test_awkward_rows(spark):
    langs = ["en" if k % 3 else None for k in range(len(texts()))]
    got = rows_of(c.collocations(awkward(spark), minimum=4))
    assert got == brute([(lang, t) for lang, (_, t) in zip(langs, texts())], 4)
    assert c.collocations(empty(spark)).collect() == []
