import random

import pytest

from airseries.llm import url_filter as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h.encode()), h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[2] if best else None, best[3] if best else default


URLS = [None, "", "no scheme/en/", "http://example.net/en/1", "HTTP://WWW.Example.NET/en/", "https://a.b.example.net/EN/",
        "https://net/", "https://net", "https://xnet/", "https://example.com/de/x?y#z", "https://example.com/de",
        "https://sub.example.org/fr/", "https://example.org?x=/fr/", "https://example.org#/fr/", "x://://y/z",
        "https://user@example.net:80/en/", "https://ÄB.net/ü", "https://.net/", "https://net./", "https://a..net/",
        "https://example.net" + "/en/" * 3000, "https://example.net/\nen/", "://net/"]


def frame(spark, urls):
    return spark.createDataFrame([(i if i % 5 else None, u, "r", 1) for i, u in enumerate(urls)],
                                 "page_id long, url string, rule string, host int")


@pytest.mark.parametrize("rules", [U.RULES, [], [("block", "ü.de", "/ä"), ("allow", "de", "/"), ("block", "de", "/"), ("block", "b.de", "")]])
def test_matches_brute_force(spark, rules):
    rng = random.Random(2)
    hosts = ["net", "example.net", "www.example.net", "example.com", "a.example.com", "org", "x.org", "ü.de", "b.de", "a.b.de"]
    urls = URLS + [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/x', '/fr/', '/ä/b', '/en'])}"
                   f"{rng.choice(['', '?q=/en/', '#/de/'])}" for _ in range(400)]
    # of rules with one host and path a block wins
    kept = [(v, h, p) for v, h, p in rules if v == "block" or ("block", h, p) not in rules]
    got = [tuple(r) for r in U.filter_urls(frame(spark, urls), rules).collect()]
    want = [(i if i % 5 else None, *brute(u, kept)) for i, u in enumerate(urls)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_equal_digests_are_told_apart(tmp_path):
    """With a hash that always collides, the stored strings alone decide."""
    import numpy as np
    rules = [("block", "a.com", "/"), ("allow", "b.com", "/"), ("block", "c.com", "/x")]
    path = tmp_path / "array"
    path.write_bytes(U.DigestArray.pack(rules, hasher=lambda x: 7))
    array = U.DigestArray.mapped(str(path))
    found = array.find(np.array(["b.com/", "d.com/", "c.com/x"], dtype=object), np.array([5, 5, 5]), hasher=lambda x: 7)
    assert [array.string(k) if k >= 0 else None for k in found] == ["b.com/", None, "c.com/x"]


def test_too_many_rules_are_an_error(monkeypatch):
    monkeypatch.setattr(U, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        U.DigestArray.pack([("block", f"h{i}", "/") for i in range(3)])


def test_empty(spark):
    assert U.filter_urls(frame(spark, []), U.RULES).count() == 0


def test_a_million_entries_are_mapped_and_probed(spark, tmp_path):
    """52 MB of file for a million rules: four 8-byte columns and the strings; a task maps it and holds none of it."""
    import resource
    import numpy as np
    import pandas as pd
    n = 1_000_000
    data = U.DigestArray.pack(("block" if i % 3 else "allow", f"h{i}.example", "/p/") for i in range(n))
    assert len(data) < 60 * n
    path = tmp_path / "array"
    path.write_bytes(data)
    del data
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    array = U.DigestArray.mapped(str(path))
    rng = np.random.default_rng(0)
    picks = rng.integers(0, 2 * n, 20_000)
    hosts = pd.Series([f"{'www.' * (i % 2)}h{i}.example" for i in picks])
    best, _ = array.judge(hosts, pd.Series(["/p/x"] * len(picks)))
    assert [array.string(k) if k >= 0 else None for k in best] == [f"h{i}.example/p/" if i < n else None for i in picks]
    assert all(bool(array.verdicts[k]) == (i % 3 == 0) for i, k in zip(picks, best) if k >= 0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 120_000  # KB, mapped pages included
