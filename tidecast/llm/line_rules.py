"""Rules on whole texts and on lines that many documents of one host share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.joins import checked
from tidecast.sources.tables import staged

WHITE_SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# A line is removed if it is in more than this many documents of its host.
LINE_DOCUMENTS = 20
# A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, though the body names it often."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by 64-bit hashes."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    def places(hashes: Column) -> Column:
        """Starts of the windows that are not unique, in order."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(
                p, lambda x, k: (F.get(p, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, k + 1)["h"].eqNullSafe(x["h"]))
            ),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        """Words under the windows: each adds up to three, fewer if the one before it reaches in."""
        return F.aggregate(
            F.transform(starts, lambda s, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), s - F.get(starts, k - 1)))),
            F.lit(0),
            lambda total, x: total + x,
        )

    def count(hashes: Column) -> Column:
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, 0).otherwise(let(places(hashes), covered))

    return let(words, lambda w: F.when(F.size(w) < 4, 0).otherwise(let(windows(w), count)))


def base_measures(docs: DataFrame) -> DataFrame:
    """Counts of words, symbols, repeated lines and repeated words, beside `host` and `text_hash`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        text.alias("text"),
        F.array_remove(F.split(text, WHITE_SPACE), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """Each different line of each different text of a host, once: host, text_hash, line, words.

    Lines are compared in lower case with single spaces; `words` counts all of the text's words on lines
    equal to this one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(
        F.split(F.lower(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")), "\n"), lambda line: F.trim(line)
    )
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(lines).alias("place", "line"),
    ).filter("line != ''")
    words = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long")
    hashed = rows.select("host", "text_hash", "place", F.xxhash64("line").alias("line"), words.alias("words"))
    # The place keeps equal lines of one text apart and equal rows together.
    once = hashed.groupBy("host", "text_hash", "line", "place").agg(F.max("words").alias("words"))
    return once.groupBy("host", "text_hash", "line").agg(F.sum("words").alias("words"))


def copied_texts(docs: DataFrame) -> DataFrame:
    """Texts that several documents of a host share: host, text_hash, and their number.

    Documents are told apart by doc_id, so repeated rows are one; all rows without an id are one too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.xxhash64(text).alias("text_hash"),
        F.struct(F.col("doc_id")).alias("document"),
    )
    return rows.groupBy("host", "text_hash").agg(F.count_distinct("document").alias("copies")).filter("copies > 1")


def line_rules(
    docs: DataFrame,
    line_documents: int = LINE_DOCUMENTS,
    left_share: float = LEFT_SHARE,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """Base rules, then cross-document line frequency; one row per row of `docs`.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    words_removed, kept. A line is removed from the documents of a host if more than `line_documents`
    documents of the host have it; copies of a text are documents of their own. A document is kept if it
    passes the base rules and at least `left_share` of its words remain.

    A null or empty text has no words and fails the base rules. A null source counts as the host "".
    Repeated rows get equal results and do not change the counts. An empty table gives no rows. Other
    columns are ignored.

    Lines are held once for each different text, so a large group of copies collapses in each task before
    the shuffle; the number of copies joins them as a count. A frequent line is one partial count for each
    task.
    """
    lines = staged(host_lines(docs), "lines")
    copies = checked(staged(copied_texts(docs), "copies"))
    frequent = (
        lines.join(copies, ["host", "text_hash"], "left")
        .groupBy("host", "line")
        .agg(F.sum(F.coalesce("copies", F.lit(1))).alias("documents"))
        .filter(F.col("documents") > line_documents)
        .select("host", "line")
    )
    removed = lines.join(frequent, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("words").alias("removed"))
    rows = base_measures(docs).join(removed, ["host", "text_hash"], "left")
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")
    )
    words_removed = F.coalesce("removed", F.lit(0)).cast("long")
    depleted = F.col("n_words") - words_removed < F.lit(left_share) * F.col("n_words")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        words_removed.alias("words_removed"),
        (~base_failed & ~depleted).alias("kept"),
    )
