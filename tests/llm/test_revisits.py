import random

import pytest

from airseries.llm import revisits as V

SCHEMA = ("record_id string, url string, captured long, kind string, http_status int, headers map<string,string>, "
          "payload_digest string, row string, key long")
HOUR = 3_600_000_000


def brute(rows, keys):
    out = []
    for rid, url, t, kind, status, headers, digest, *_ in rows:
        if kind != "revisit" or status != 304:
            continue
        headers = headers or {}
        earlier = [r for r in rows if r[3] == "response" and r[4] == 200 and url is not None and r[1] is not None
                   and keys[r[1]] == keys[url] and t is not None and r[2] is not None and r[2] < t]
        if not earlier:
            out.append((rid, "no-earlier-response", None, None, None))
            continue
        best = max(earlier, key=lambda r: (r[2], r[0]))
        stored = best[5] or {}
        if "etag" in headers:
            ok = "etag" in stored and stored["etag"].removeprefix("W/") == headers["etag"].removeprefix("W/")
        elif "last-modified" in headers:
            ok = stored.get("last-modified") == headers["last-modified"]
        else:
            out.append((rid, "no-validator", None, None, None))
            continue
        if ok:
            merged = stored | {k: v for k, v in headers.items() if k not in V.NOT_UPDATED}
            out.append((rid, "resolved", best[0], best[6], tuple(sorted(merged.items()))))
        else:
            out.append((rid, "validator-mismatch", None, None, None))
    return sorted(out, key=str)


def got(spark, rows, buckets=V.BUCKETS):
    found = V.resolve_revisits(spark.createDataFrame(rows, SCHEMA).repartition(4), buckets).collect()
    return sorted(((r["record_id"], r["status"], r["response_id"], r["payload_digest"],
                    None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in found), key=str)


@pytest.mark.parametrize("buckets", [(1, 1), V.BUCKETS, (HOUR, HOUR // 4), (10**15, HOUR), (10**15, 10**15)])
def test_matches_brute_force(spark, buckets):
    rng = random.Random(9)
    keys = {"http://a.org/x": "a.org/x", "https://www.A.org/x/": "a.org/x", "http://a.org/x#f": "a.org/x",
            "http://a.org/x?utm_source=q": "a.org/x", "http://b.org/?b=1&a=2": "b.org?a=2&b=1",
            "https://b.org:443?a=2&b=1&ref=z": "b.org?a=2&b=1", "hot": "hot"}
    rows = []
    for k in range(400):
        full = rng.random() < 0.4
        headers = rng.choice([None, {}, {"etag": rng.choice(['"1"', 'W/"1"', '"2"']), "content-length": "0", "date": str(k)},
                              {"last-modified": rng.choice(["m1", "m2"]), "content-type": "t", "x": str(k)}])
        url = rng.choice([*keys, *["hot"] * 6, None])
        t = rng.choice([None, *[rng.randint(0, 40) * HOUR // 4 for _ in range(9)]])  # many ties
        rows.append((f"r{k}", url, t, "response" if full else "revisit", rng.choice([200, 200, 404]) if full else rng.choice([304, 304, 200]),
                     headers, f"d{k}" if rng.random() < 0.8 else None, "c", 1))
    rows += rows[:30]  # repeated rows
    assert got(spark, rows, buckets) == brute(rows, keys)


def test_canonical_urls(spark):
    pairs = [("HTTP://WWW.Ex.org:80/A/b//?z=1&utm_medium=x&&a=2#f", "ex.org/A/b?a=2&z=1"), ("ex.org", "ex.org"), ("", ""),
             (None, None), ("https://ex.org/?ref", "ex.org"), ("https://ex.org/?reference=1", "ex.org?reference=1")]
    frame = spark.createDataFrame([(u, w) for u, w in pairs], "url string, want string")
    for r in frame.withColumn("got", V.canonical_url(frame["url"])).collect():
        assert r["got"] == r["want"]


def test_empty(spark):
    assert got(spark, []) == []


def test_pages_without_an_id_keep_their_captures(spark):
    schema = "page_id long, url string, html string, record_id string, n int"
    rows = [(None, "http://a.org/1", "x", "c", 1), (None, "http://a.org/2", None, "c", 1), (None, None, "y", "c", 1),
            (6, "http://a.org/6", "z", "c", 1), (6, "http://a.org/6", "z", "c", 1)]
    found = V.resolve_revisits(V.page_captures(spark.createDataFrame(rows, schema))).collect()
    assert len(found) == 6 * len(rows)
    mine = {r["record_id"].rsplit("-", 1)[1]: (r["status"], (r["response_id"] or "").rsplit("-", 1)[-1])
            for r in found if r["url_key"] == "a.org/6"}
    assert mine == {"b": ("no-earlier-response", ""), "e": ("resolved", "a"), "f": ("resolved", "a2"),
                    "g": ("validator-mismatch", ""), "c": ("validator-mismatch", ""), "h": ("resolved", "a3")}
    assert sum(r["record_id"].startswith("none-") for r in found) == 18
    assert {r["status"] for r in found if r["url_key"] is None} == {"no-earlier-response"}
