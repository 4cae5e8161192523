"""URL filter against a plain scan of the log."""

import random

import pytest

from vigil.llm.urlfilter import evaluate_captures


def keys(url):
    if not url or "://" not in url:
        return []
    rest = url.split("://", 1)[1]
    h = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    if not h:
        return []
    path = rest.split("?")[0].split("#")[0].split("/", 1)
    step = path[1].split("/")[0] if len(path) > 1 else ""
    labels = h.split(".")
    return ([f"{h}/{step}"] if step else []) + [".".join(labels[k:]) for k in range(max(1, len(labels) - 1))]


def brute(captures, entries):
    log = {}
    for k, t, a in entries:
        if k is not None and t is not None and a in ("add", "remove"):
            log.setdefault(k, {})[t] = max(a, log.get(k, {}).get(t, ""))
    out = []
    for i, u, t in captures:
        hit = (False, None, None, None)
        for k in keys(u) if t is not None else []:
            past = [x for x in log.get(k, {}) if x <= t]
            if past and log[k][max(past)] == "add":
                later = [x for x in log[k] if x > max(past)]
                hit = (True, k, max(past), min(later) if later else None)
                break
        out.append((i, u, t, *hit))
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [256, 5])
def test_matches_a_plain_scan(spark, buckets):
    rng = random.Random(buckets)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "x.org", "com", "localhost"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p/q?x=1", "/r", ":80/p", "?q=http://x.org/p")]
    caps = [(i, rng.choice([*urls, None, "mailto:x", "http://"]), rng.choice([None] + [rng.randint(0, 500)] * 9)) for i in range(400)]
    caps += caps[:20]
    caps += [(1000 + i, "http://x.org/", i) for i in range(500)]
    ents = [(rng.choice([*hosts, "x.org/p", "a.example.com/p", None]), rng.choice([None] + [rng.randint(-50, 550)] * 9),
             rng.choice(["add", "remove", "add", None, "other"])) for _ in range(300)]
    ents += ents[:30]
    c = spark.createDataFrame(caps, "capture_id long, url string, fetched long")
    e = spark.createDataFrame(ents, "key string, at long, action string")
    got = sorted((tuple(r) for r in evaluate_captures(c, e, buckets).collect()), key=str)
    assert got == brute(caps, ents)


def test_empty_sides_and_extra_columns(spark):
    c = spark.createDataFrame([(1, "http://a.b/", 5, "k")], "capture_id long, url string, fetched long, key string")
    e = spark.createDataFrame([("a.b", 1, "add", 2)], "key string, at long, action string, iv long")
    assert evaluate_captures(c, e).first()["blocked"]
    assert not evaluate_captures(c, e.limit(0)).first()["blocked"]
    assert evaluate_captures(c.limit(0), e).count() == 0
    assert evaluate_captures(c.limit(0), e.limit(0)).count() == 0
