"""SimHash near-duplicates and URL filters against plain versions."""
import random
import re

import numpy as np
import pytest
import xxhash

from llm_support import EDGES, edges, no_rows, prose  # noqa: F401
from strike_analytics.llm import simhash, url_filter


def fingerprint(text, shingle=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    """Plain: the smallest place connected with each."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def near_fingerprints(seed, n):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(3)] + [0]
    while len(fps) < n:
        x = rng.choice(fps)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    return fps


def test_bit_sliced_groups():
    for seed in range(8):
        fps = near_fingerprints(seed, 150)
        cell = np.sort(np.random.default_rng(seed).integers(0, 4, len(fps)))
        got = simhash.groups_in(np.array(fps, np.uint64), cell, 4)
        for c in range(4):
            at = np.flatnonzero(cell == c)
            if len(at):
                assert (got[at] - at[0]).tolist() == groups([fps[i] for i in at], 4)


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = random.Random(1)
    for radius in (0, 2, 4, 6):
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), radius):
                b ^= 1 << bit
            assert any(a & m == b & m for m in simhash.masks(radius))


@pytest.mark.parametrize("cell", [4, 2048])
def test_components(spark, cell):
    fps = near_fingerprints(11, 120)
    signed = [(k, simhash._signed(x)) for k, x in enumerate(fps)]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    import pyspark.sql.functions as F
    found = {r.fp: r.least for r in simhash.classes(df, F.col("doc_id"), 4, cell).collect()}
    assert [found[x] for _, x in signed] == groups(fps, 4)


def test_long_chain(spark):
    """Steps of four bits each, so that only the chain connects its ends."""
    chain = [0]
    for k in range(15):
        chain.append(chain[-1] | (0b1111 << (4 * k)))
    rows = [(99 - k, simhash._signed(x)) for k, x in enumerate(chain)]
    import pyspark.sql.functions as F
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    assert {r.least for r in simhash.classes(df, F.col("doc_id"), 4, 2048).collect()} == {84}


def test_near_duplicates_edges(spark, edges, no_rows):
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.near_duplicates(edges).collect())
    fps = [fingerprint(r[1]) for r in EDGES]
    label = groups(fps, 4)
    ids = {c: min((r[0] for r, x in zip(EDGES, label) if x == c and r[0] is not None), default=-1) for c in set(label)}
    assert got == sorted((r[0] or -1, format(f, "016x"), ids[c]) for r, f, c in zip(EDGES, fps, label))
    assert simhash.near_duplicates(no_rows).count() == 0


def test_one_row_of_each_group_stays(spark, edges, no_rows):
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    label = groups([fingerprint(r[1]) for r in EDGES], 4)
    ids = {c: min((r[0] for r, x in zip(EDGES, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in ids.values())
    assert simhash.drop_near_duplicates(no_rows).count() == 0


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    best = None
    for h, p, v in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, "", ""), (len(h + p), h + p, v))
    return host, path, best and best[1], best[2] if best else "allow"


def some_urls(n):
    rng = random.Random(4)
    labels = ["com", "net", "example", "www", "a-b", "a", "b", "example.com", "xcom"]
    urls = [rng.choice(["http", "HTTPS", "ftp"]) + "://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
            + rng.choice(["", "/", "/en/", "/en", "/es/x", "?q=/en/", "#://", "/EN/", ":80/en/", "/en/?a#b", "/fr/é\n/"]) for _ in range(n)]
    return urls + [None, "", "example.com/en/", "http://", "://com/", "http://COM/", "http://com./", "http://.com/", "x://y://com/"]


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_urls_against_all_rules(spark, partitions):
    rules = url_filter.RULES + [("a.com", "/", "block"), ("a.com", "/en", "allow"), ("b.a.com", "/", "allow"), ("net", "/", "block"),
                                ("example.net", "/e", "allow"), ("com", "/", "allow")]
    rows = list(enumerate(some_urls(900)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"),
                                    spark.createDataFrame(rules, "host string, path string, verdict string"))
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: judged(u, rules) for k, u in rows}


def test_url_edges(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.com/a", "k"), (1, "http://x.com/a", "k"), (None, "http://x.com", "k"), (None, None, "k"),
                                   (2, "http://x.com/" + "a" * 100_000, None)], "page_id long, url string, host string")
    got = sorted(((r.page_id or 0), r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == [(0, "", "allow"), (0, "", "allow"), (1, "com/", "block"), (1, "com/", "block"), (2, "com/", "block")]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).where("verdict = 'block'").count() == 0


def test_very_many_path_rules_on_one_host():
    """The sweep finds what a scan of all rules does, in time that doesn't grow with them."""
    import time

    rng = random.Random(4)
    paths = sorted({"/" + "/".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 6))) + rng.choice(["", "/"])
                    for _ in range(150_000)})
    one = url_filter.Paths(b"com\0")
    start = time.time()
    for k, p in enumerate(paths):
        one.add(p, "com" + p, str(k))
    urls = [rng.choice(paths) + rng.choice(["", "x", "/y/z", "a"]) for _ in range(100_000)] + ["", "/", "0", "zzz"]
    found = [one.longest(u) for u in urls]
    assert time.time() - start < 20
    known = set(paths)
    for u, fit in list(zip(urls, found))[::50]:
        want = next((u[:n] for n in range(len(u), -1, -1) if u[:n] in known), None)
        assert (fit and fit[1]) == (want if want is None else "com" + want)
