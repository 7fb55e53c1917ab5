"""The pipeline against the operators it is made of."""

import collections

import re
import tracemalloc

import corpus_pipeline
import numpy as np
from tests.llm.awkward import awkward, empty
from tidecast.llm import jaccard_join, secret_scan
from tidecast.llm.queries import QUERIES
from tidecast.sources.tables import staged

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF_DIR), name)
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(now) <= kept and len(now) == len(set(now))
        assert (len(now) == len(kept)) == (name == "secrets") or name == "toxicity"
        kept = set(now)
    assert docs.filter("text rlike '[0-9a-f]{24}' or length(text) <> n_chars").count() == 0
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == kept
    filled = collections.Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def shingles(text, size=5):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, min(len(words), 1)))}


def smallest_linked(rows):
    """The smallest doc_id that each document reaches by links of 0.8 or more, all pairs compared."""
    sets, root = {r.doc_id: shingles(r.text) for r in rows}, {r.doc_id: r.doc_id for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in root}


def test_stages_keep_what_brute_force_keeps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in QUERIES["op8_toxicity_kneser_ney"](spark, SF_DIR).collect()}
    docs = staged(stages["toxicity"](spark, docs, SF_DIR), "toxicity")
    rows = docs.select("doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {i for i, score in scores.items() if score < 0.5}

    smallest = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        smallest.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    docs = staged(stages["exact_dedup"](spark, docs, SF_DIR), "exact")
    rows = docs.select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in rows) == sorted(smallest.values())

    near = smallest_linked(rows)
    left = stages["near_duplicates"](spark, docs, SF_DIR).select("doc_id").collect()
    assert sorted(r.doc_id for r in left) == sorted(i for i, low in near.items() if i == low) and len(left) < len(rows)


def test_awkward_rows(spark):
    for docs in (awkward(spark), empty(spark)):
        docs = staged(docs, "awkward")
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = staged(stage(spark, docs, SF_DIR), name)
    assert docs.count() == 0


def test_moves_are_counted_in_little_memory():
    data = np.random.default_rng(1).integers(0, 256, 4 << 20).astype(np.uint8)
    classes = secret_scan.CLASS_OF_BYTE[data].tolist()
    expected = collections.Counter(zip(classes, classes[1:]))
    tracemalloc.start()
    moves = secret_scan.moves_in(data)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    width = secret_scan.END + 1
    assert {(i // width, i % width): n for i, n in enumerate(moves.tolist()) if n} == expected
    assert most < 2 * len(data)
    for short in (0, 1, 2):
        assert secret_scan.moves_in(data[:short]).sum() == max(0, short - 1)


def test_repeated_shingles_are_counted_in_little_memory():
    values = np.random.default_rng(2).integers(0, 1 << 20, 1 << 21).astype(np.uint64)
    expected = {v: n for v, n in collections.Counter(values.tolist()).items() if n > 1}
    single = np.arange(1 << 21, dtype=np.uint64)
    tracemalloc.start()
    none = jaccard_join.repeated(single)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert not none[0].size and most < single.nbytes
    found, times = jaccard_join.repeated(np.sort(values))
    assert dict(zip(found.tolist(), times.tolist())) == expected
    for few in ([], [3], [3, 3], [3, 4], [3, 3, 4, 5, 5, 5]):
        found, times = jaccard_join.repeated(np.array(few, dtype=np.uint64))
        assert dict(zip(found.tolist(), times.tolist())) == {v: few.count(v) for v in few if few.count(v) > 1}
