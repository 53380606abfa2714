import random

import pytest

from factloom.llm import url_filter

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("", "allow")]


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and host and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "no scheme", "://", "http://", "http://ORG/", "http://a.b.Example.ORG/es/", "x://example.org?q=/es/", "y://u@example.org:80/en/12#f",
            "http://notexample.org/es/x", "http://example.org./es/", "a://b://c.com/fr/", "http://É.com/de/\nx", "http://com/de/" + "x" * 50_000]
    for _ in range(300):
        urls.append(f"http://{'.'.join(rng.choice(['a', 'Example', 'org', 'com', 'fr']) for _ in range(rng.randrange(1, 5)))}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(30)}{rng.choice(['', '?x', '#y'])}")
    pages = spark.createDataFrame([(None if i == 1 else i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h")], "page_id long, url string, HOST string")
    rules = RULES[:-1]
    got = url_filter.judge(pages, rules)
    assert got.columns == ["page_id", "url", "HOST", "_host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert tuple(r)[3:] == brute(r.url, rules), r.url[:80]
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, []).collect()} == {"allow"}


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_keys", lambda texts: url_filter.np.array([len(t) % 2 for t in texts], dtype=url_filter.np.uint64))
    (tmp_path / "rules").write_bytes(url_filter.build(RULES[:-1]))
    held = url_filter.Digests(str(tmp_path / "rules"))
    assert held.match(["x.example.org", "b.com", "nothing.net"], ["/es/1", "/de/", "/"]) == [("example.org/es/", True), ("com/de/", True), (None, False)]


def test_size_is_checked(monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.build(RULES)
