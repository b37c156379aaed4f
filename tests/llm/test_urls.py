import random

import numpy as np

from newsloom.llm import urls


def brute(url, rules=urls.RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c, 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and host:
            fits.append((len(rule), rule, verdict))
    if not fits:
        return host, path, None, "allow"
    _, rule, verdict = max(fits)
    return host, path, rule, verdict


def fuzz():
    r = random.Random(2)
    hosts = ["example.net", "EXAMPLE.net", "a.example.net", "net", "xnet", "b.org", "org", "m.example.com", "example.com", "É.net", "", "u:p@example.com:80", "a..net", ".net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/fr/?q", "#f", "?x=/en/", "/en/#/de/", "//en/"]
    return [None, "", "example.net/en/", "://", "x://", "http://", "a://b://c.net/"] + [f"{r.choice(['http', 'x', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(400)]


def test_against_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(fuzz())] + [(0, "http://a.net/", "again"), (None, "http://a.net/", "no id")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = sorted(map(str, map(tuple, urls.filter_urls(df).collect())))
    assert got == sorted(str((i, *brute(u))) for i, u, _ in rows)
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_collisions_are_confirmed(tmp_path):
    """With a digest that takes four values only, strings decide."""
    weak = lambda strings: np.array([len(s) % 4 for s in strings], np.uint64)
    rules = [("block", f"h{i}.org/{'x' * (i % 5)}") for i in range(40)]
    path = tmp_path / "d"
    path.write_bytes(urls.DigestArray.build(rules, key=weak))
    index = urls.DigestArray(str(path))
    found = index.probe([r for _, r in rules] + ["none/", "h1.org/xx"], key=weak)
    assert [index.string(k).decode() for k in found[:-2]] == [r for _, r in rules] and (found[-2:] == -1).all()


def test_no_rules(tmp_path):
    path = tmp_path / "d"
    path.write_bytes(urls.DigestArray.build([]))
    assert urls.judge(urls.DigestArray(str(path)), ["http://a.net/", None]).verdict.tolist() == ["allow", "allow"]


def test_long_urls(tmp_path):
    """Hosts and paths of a megabyte, with as many labels as they can have."""
    path = tmp_path / "d"
    path.write_bytes(urls.DigestArray.build([*urls.RULES, ("block", "a.very.long.host.name.org/x/")]))
    index = urls.DigestArray(str(path))
    many = "http://" + "a." * 500_000
    got = [many + "example.net/en/", many + "xexample.net/", "http://" + "b" * 1_000_000 + ".org/fr/" + "c/" * 500_000, "http://" + "." * 1_000_000, many + "very.long.host.name.org/x/", "http://.org/fr/"]
    out = urls.judge(index, got)
    assert out.rule.tolist() == ["example.net/en/", "net/", "org/fr/", None, "a.very.long.host.name.org/x/", "org/fr/"]
    short = fuzz()
    assert urls.judge(index, short).rule.tolist() == [brute(u, [*urls.RULES, ("block", "a.very.long.host.name.org/x/")])[2] for u in short]
