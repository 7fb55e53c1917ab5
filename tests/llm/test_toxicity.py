"""The toxicity models count every window, against the same models over windows in memory."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.awkward import awkward
from tidecast.llm import toxicity
from tidecast.llm.text_batches import texts_of


def test_rare_expressions_of_a_large_table_count(spark):
    """An expression in some 13 of over 7 million windows of its class, which was below a share of 2 ** -19."""
    rows = [(i, f"{'vilexpression' if i % 2 else 'kindwords'} number{i}", i % 2, 1) for i in range(40)]
    rows += [(100 + i, "walk ", i % 2, 600_000) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, times int").repartition(8)
    docs = table.select("doc_id", F.expr("repeat(text, times)").alias("text"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table.select("doc_id", "toxic")).collect()}
    assert len(got) == 52 and sum(got[i].held_out for i in range(40)) > 4
    scores = [[got[i].score for i in range(k, 40, 2)] for k in (0, 1)]
    assert min(scores[1]) > 2 * max(scores[0]), scores


def corpus(spark):
    rng = np.random.default_rng(3)
    syllables = ["ba", "ke", "Li", "mo", "né", "ru", "st", "İ", "日", "x-", "7"]
    words = ["".join(rng.choice(syllables, rng.integers(1, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words[:300] if i % 3 else words[100:], 60)), int(i % 3 == 0)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)


def test_ratios_equal_the_models_in_memory(spark):
    rows, table = corpus(spark)
    seen = table.withColumn("label", F.when(F.col("doc_id") < 200, F.col("label")))  # the others only get scored
    counts = {}
    for _, text, label in rows[:200]:
        for word in text.split(" "):
            for key in toxicity.windows([word.encode()])[0]:
                counts.setdefault(int(key), [0, 0])[1 - label] += 1
    grams = np.array(list(counts), dtype=np.uint64)
    model = toxicity.kneser_ney(grams, *np.array(list(counts.values())).T)
    words = toxicity.toxic_words(seen)
    evidence = model.evidence(texts_of(pa.array([r[1] for r in rows])), toxicity.MARGINS)
    assert (evidence > 0).any() and words.count() > 0
    for how in (toxicity.with_evidence, toxicity.joined_evidence):
        got = {r.doc_id: r.evidence for r in how(table, words, toxicity.MARGINS).collect()}
        np.testing.assert_allclose([got[i] for i in range(300)], evidence, atol=1e-9)


def test_joins_give_the_same_scores(spark, monkeypatch):
    docs, labels = awkward(spark), spark.createDataFrame([(1, 0), (3, 1), (8, 1), (16, 0), (17, 1), (2, 0)], "doc_id long, toxic int")
    wanted = toxicity.toxicity(docs, labels).collect()
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", -1)
    got = toxicity.toxicity(docs, labels).collect()
    listed = lambda rows: sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in rows)
    assert listed(got) == listed(wanted)


def plain_ratio(word, seen, counts):
    """The log-ratio of a word of single-byte letters, by dictionaries: the definition, gram by gram."""
    n, d = toxicity.ORDER, toxicity.DISCOUNT

    def shared(gram):
        longer = {g[-len(gram) - 1 :] for g in seen}
        if len(gram) == 1:
            return sum(g.endswith(gram) for g in longer) / len(longer)
        inside = [g for g in longer if g[1:-1] == gram[:-1]]
        kinds, own = len({g[-1] for g in inside}), sum(g[1:] == gram for g in inside)
        return (own - d) / len(inside) + d * kinds / len(inside) * shared(gram[1:])

    total = 0.0
    spaced = b" " * (n - 1) + word + b" "
    for i in range(len(word) + 1):
        window, sides = spaced[i : i + n], []
        for side in counts:
            inside = {g: c for g, c in side.items() if g[:-1] == window[:-1] and c}
            if inside:
                own, left = max(inside.get(window, 0) - d, 0) / sum(inside.values()), d * len(inside) / sum(inside.values())
            else:
                own, left = 0.0, 1.0
            sides.append(np.log(own + left * (shared(window[1:]) if window in seen else 1.0)))
        total += sides[0] - sides[1]
    return total


def test_ratios_equal_a_plain_loop(spark, monkeypatch):
    """Many owners and blocks of one word give the ratios of the definition."""
    monkeypatch.setattr(toxicity, "MARGINS", (-1000.0,))
    monkeypatch.setattr(toxicity, "WORDS_PER_OWNER", 3)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 12)
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abc"), rng.integers(1, 12))) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 25 + 5 * (i % 3)], 20)), i % 2 if i < 20 else None) for i in range(30)]
    counts = [{}, {}]
    for _, text, label in rows:
        for word in text.split(" ") if label is not None else []:
            spaced = " " * (toxicity.ORDER - 1) + word + " "
            for i in range(len(word) + 1):
                gram = spaced[i : i + toxicity.ORDER].encode()
                counts[1 - label][gram] = counts[1 - label].get(gram, 0) + 1
    seen = set(counts[0]) | set(counts[1])
    words = sorted({w.encode() for _, text, _ in rows for w in text.split(" ")})
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4)
    got = {r.word_id: r.ratio for r in toxicity.toxic_words(table).collect()}
    assert len(got) == len(words)
    for word, key in zip(words, toxicity.word_ids(words).tolist()):
        np.testing.assert_allclose(got[key], plain_ratio(word, seen, counts), atol=1e-9)


def test_evidence_does_not_grow_with_length():
    """The same share of words with evidence says as much in a long text, and less in a very short one."""
    ids, ratios = np.minimum(np.arange(10**5) % 50, 1), np.array([9.0, 0.0])
    levels = [toxicity.text_evidence(ids[:n], np.zeros(n, np.int64), ratios, 1, (4.0,))[0, 0] for n in (50, 1000, 10**4, 10**5)]
    assert levels[0] < levels[1] < levels[2] <= levels[3] < 1.02 * levels[2]
