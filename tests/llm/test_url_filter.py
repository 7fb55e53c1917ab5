"""Url verdicts against a plain loop over all rules, and the digest array with and without collisions."""

import random
import re

import numpy as np
import pytest

from tidecast.llm import url_filter as u


def brute(url, rules=u.RULES, words=u.BLOCKED_WORDS):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        rule_host, rule_path = rule.split("/", 1)
        fits = host == rule_host or host.endswith("." + rule_host)
        if fits and path.startswith("/" + rule_path):
            order = (len(rule.encode()), len(rule_host.encode()))
            if best is None or order > best[0]:
                best = (order, rule, verdict)
    if best:
        return host, path, best[1], best[2]
    return host, path, None, "block" if set(re.split("[.-]", host)) & set(words) else "allow"


@pytest.mark.parametrize("hashed", [u.digest, lambda k: len(k) % 3, lambda k: (1 << 64) - 1])
def test_digest_array(hashed, tmp_path):
    rng = random.Random(1)
    entries = {bytes(rng.choices(b"abc\x00\xff", k=rng.randrange(6))): k for k in range(300)}
    path = tmp_path / "digests"
    path.write_bytes(u.DigestArray.packed(entries, hashed))
    array = u.DigestArray(np.memmap(path, np.uint8, "r"), hashed)
    keys = [*entries, *(bytes(rng.choices(b"abcd", k=rng.randrange(6))) for _ in range(300))]
    found, values = array.look_up(keys)
    assert found.tolist() == [k in entries for k in keys]
    assert values.tolist() == [entries.get(k, 0) for k in keys]
    empty = u.DigestArray(np.frombuffer(u.DigestArray.packed({}), np.uint8))
    assert not empty.look_up([b"a"])[0].any() and len(array.look_up([])[0]) == 0


URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "https://ORG/x", "http://a.ORG?x=/", "http://a.org#f",
    "http://example.org/es/", "http://example.org/es", "http://m.Example.org/es/1?q", "http://myexample.org/es/1",
    "http://example.org/en/1", "http://example.org/en/12", "http://x.y.example.org/en/2", "http://com/fr/", "http://a.com/FR/",
    "http://a.com/de/?a=http://b.org/", "http://casino.com/en/", "http://a-Casino.com/fr/x", "http://casinos.net/", "http://x.org:80/",
    "http://poker.org", "a://b://c.org/x", "http://.org/", "http://org./", "http://..com/de/", "http://ÉTÉ.org/é", "http://İ.com/fr/é\n?x",
    "HTTP://user@a.com/de/x", "//a.org/x", "http:/a.org/", "http://x.com/de/" + "y" * 100_000, "x\n://a.com/de/z",
]


def test_filter(spark):
    rows = [(k, url, "<p>", "r", "v") for k, url in enumerate(URLS)] + [(None, "http://a.com/de/", "", "r", "v")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, verdict string")
    got = [tuple(r) for r in u.filter_urls(pages.repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(k, *brute(url)) for k, url, *_ in rows], key=str)
    assert u.filter_urls(pages.limit(0)).collect() == []


def test_many_rules(spark):
    rng = random.Random(2)

    def host():
        return ".".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randrange(1, 4)))

    def path():
        return "/" + "".join(rng.choice("xyé/") for _ in range(rng.randrange(5)))

    rules = list({h + p: (rng.choice(u.VERDICTS), h + p) for h, p in ((host(), path()) for _ in range(400))}.values())
    urls = [f"http://{host()}{path()}{path()}" for _ in range(1500)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.filter_urls(pages, rules, ["ab"]).collect()}
    for k, url in enumerate(urls):
        assert got[k] == brute(url, rules, ["ab"]), url


def test_bad_rules():
    with pytest.raises(ValueError):
        u.entries_of([("allow", "org")], [])
    with pytest.raises(ValueError):
        u.entries_of([("allow", "org/"), ("block", "org/")], [])
