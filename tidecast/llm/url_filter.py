"""Verdicts on urls from a sorted array of digests that executors map into memory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.text_batches import give_back_memory, worker_cache
from tidecast.sources.tables import staging_path

MOST_ENTRIES = 1 << 25
MOST_BYTES = 1 << 31
CHUNK = 4 << 20

# Rules of the query: (verdict, host and path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
# Words of a host name that block a url no rule fits, as in public url lists of such sites.
BLOCKED_WORDS = [
    "adult", "ads", "bet", "bets", "betting", "casino", "gambling", "hentai", "lottery", "malware", "phishing", "pills",
    "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx",
]

HOST, RULE, WORD = b"h", b"r", b"w"
ALLOW, BLOCK = 0, 1
VERDICTS = ["allow", "block"]
RESULT = "page_id long, host string, path string, rule string, verdict string"


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


class DigestArray:
    """Keys sorted by a 64-bit digest, each with its full string and a value, as one run of bytes.

    The layout is a head of two numbers (entries, bytes of strings), the digests, the places of the
    strings, the values, and the strings. It is used where it lies, so a file can be mapped into memory.
    """

    def __init__(self, data: np.ndarray, hashed: Callable[[bytes], int] = digest):
        size, self.hashed = int(data[:8].view("<u8")[0]), hashed
        at = 16
        self.digests = data[at : at + 8 * size].view("<u8")
        at += 8 * size
        self.places = data[at : at + 8 * (size + 1)].view("<u8")
        at += 8 * (size + 1)
        self.values = data[at : at + 8 * size].view("<i8")
        self.strings = data[at + 8 * size :]

    @staticmethod
    def packed(entries: dict[bytes, int], hashed: Callable[[bytes], int] = digest) -> bytes:
        if len(entries) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries for one digest array")
        order = sorted((hashed(k), k) for k in entries)
        places = np.zeros(len(order) + 1, dtype="<u8")
        np.cumsum([len(k) for _, k in order], out=places[1:])
        parts = [
            np.array([len(order), int(places[-1])], "<u8"), np.array([d for d, _ in order], "<u8"), places,
            np.array([entries[k] for _, k in order], "<i8"),
        ]
        out = b"".join([*(p.tobytes() for p in parts), *(k for _, k in order)])
        if len(out) > MOST_BYTES:
            raise ValueError(f"more than {MOST_BYTES} bytes for one digest array")
        return out

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    def look_up(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is an entry, and its value (0 if not).

        All digests are searched at once. Where one matches, the stored string must be the key; entries
        with the same digest lie side by side and are tried one after the other.
        """
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        if not keys or not len(self.digests):
            return found, values
        wanted = np.fromiter(map(self.hashed, keys), np.uint64, len(keys))
        place = np.searchsorted(self.digests, wanted)
        open_ = np.arange(len(keys))
        while True:
            at = place[open_]
            near = at < len(self.digests)
            near[near] = self.digests[at[near]] == wanted[open_[near]]
            open_, at = open_[near], at[near]
            if not len(open_):
                return found, values
            same = np.fromiter((self.string(p) == keys[k] for k, p in zip(open_, at)), bool, len(open_))
            found[open_[same]], values[open_[same]] = True, self.values[at[same]]
            open_ = open_[~same]
            place[open_] += 1

    def string(self, place: int) -> bytes:
        return self.strings[int(self.places[place]) : int(self.places[place + 1])].tobytes()


def entries_of(rules: Iterable[tuple[str, str]], words: Iterable[str]) -> tuple[dict[bytes, int], list[tuple[int, ...]]]:
    """The entries of rules and words, and the sets of path lengths that hosts refer to.

    A rule is its host (up to the first `/`) and a path. A host's entry has the number of the set of
    lengths, in bytes, of its rules' paths, so only these prefixes of a url's path are looked up.
    """
    lengths: dict[bytes, set[int]] = {}
    entries: dict[bytes, int] = {}
    for verdict, rule in rules:
        if "/" not in rule or verdict not in VERDICTS:
            raise ValueError(f"not a rule: {verdict!r}, {rule!r}")
        host, path = rule.split("/", 1)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host).encode()
        path = b"/" + path.encode()
        key = RULE + host + path
        if entries.get(key, VERDICTS.index(verdict)) != VERDICTS.index(verdict):
            raise ValueError(f"two verdicts for {rule!r}")
        entries[key] = VERDICTS.index(verdict)
        lengths.setdefault(host, set()).add(len(path))
    sets = sorted({tuple(sorted(x, reverse=True)) for x in lengths.values()})
    for host, own in lengths.items():
        entries[HOST + host] = sets.index(tuple(sorted(own, reverse=True)))
    for word in words:
        entries[WORD + word.encode()] = BLOCK
    return entries, sets


def suffixes(host: bytes) -> list[bytes]:
    """The host and the hosts it is a subdomain of, longest first."""
    out = [host]
    while b"." in host:
        host = host.split(b".", 1)[1]
        out.append(host)
    return out


def host_words(host: bytes) -> list[bytes]:
    return host.replace(b"-", b".").split(b".")


def judged(hosts: list[bytes], paths: list[bytes], array: DigestArray, sets: list[tuple[int, ...]]):
    """The rule (None if none fits) and verdict of each host and path."""
    distinct = list(dict.fromkeys(hosts))
    chains = [suffixes(h) if h else [] for h in distinct]
    flat = list(dict.fromkeys(s for chain in chains for s in chain))
    known, which = array.look_up([HOST + s for s in flat])
    lengths = {s: sets[w] for s, k, w in zip(flat, known, which) if k}
    ruled = {h: [s for s in chain if s in lengths] for h, chain in zip(distinct, chains)}
    spelled = [host_words(h) for h in distinct]
    words = list(dict.fromkeys(w for own in spelled for w in own))
    blocked = {w for w, hit in zip(words, array.look_up([WORD + w for w in words])[0]) if hit}
    spoiled = {h: any(w in blocked for w in own) for h, own in zip(distinct, spelled)}

    probes, of = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for suffix in ruled[host]:
            for length in lengths[suffix]:
                if length <= len(path):
                    probes.append(RULE + suffix + path[:length])
                    of.append(i)
    hit, verdict = array.look_up(probes)
    rules: list[bytes | None] = [None] * len(hosts)
    verdicts = [BLOCK if spoiled[h] else ALLOW for h in hosts]
    for n in np.flatnonzero(hit):
        i, rule = of[n], probes[n][1:]
        # Probes come with the longest host first, so of two rules of one length it stays.
        if rules[i] is None or len(rule) > len(rules[i]):
            rules[i], verdicts[i] = rule, int(verdict[n])
    return rules, verdicts


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def published(spark: SparkSession, data: bytes) -> str:
    """Write the array to the shared folder once, and have Spark hand the file to every executor."""
    name = f"url-digests-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{staging_path(spark, 'urls')}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for start in range(0, len(data), CHUNK):
            out.write(bytearray(data[start : start + CHUNK]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]] = tuple(RULES), words: Iterable[str] = tuple(BLOCKED_WORDS)
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (verdict, host and path) fits its host and all subdomains where the url's path starts with the
    rule's; the longest fitting rule decides, of two equally long ones that with the longer host. Without
    one a url is blocked if a part of its host name, between dots and hyphens, is one of `words`, else
    allowed.

    A null url, and one without `://`, has an empty host and path, fits no rule and is allowed; so is an
    empty host. Repeated rows and equal page_ids are rows of their own, a null page_id stays null. A very
    long url is looked at only at the lengths of rules' paths. An empty table gives no rows. Other columns,
    the html among them, are not read.

    Rules and words (at most 2^25 entries and 2 GB) are one file of sorted digests, which executors fetch
    once and map into memory; pages are not shuffled.
    """
    spark = pages.sparkSession
    entries, sets = entries_of(rules, words)
    name = published(spark, DigestArray.packed(entries))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("urls")
        if name not in cache:
            cache.clear()
            cache[name] = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
            found, verdicts = judged(hosts, paths, cache[name], sets)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "host", "path")),
                    pa.array(found, pa.binary()).cast(pa.string()),
                    pc.take(pa.array(VERDICTS), pa.array(verdicts, pa.int32())),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )
            give_back_memory()

    return rows.mapInArrow(run, RESULT)
