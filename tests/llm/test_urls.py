import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomtrace.llm.urls import RULES, url_verdicts

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]


def plain(pages, labels, least=20, m=5.0, z=2.0, reject=0.5):
    """The same tree by dictionaries, one page after the other."""
    import re

    bad = {}
    for doc, quality, toxic in labels:
        if doc is not None:
            bad[doc] = max(bad.get(doc, 0), int(toxic == 1 or quality == 0))
    rows = []
    for page, url in pages:
        host, path = host_path(url)
        parts = re.sub("[0-9]+", "*", path).removeprefix("/").split("/")
        number = re.search("([0-9]{1,18})[^0-9]*$", path)
        label = bad.get(int(number[1])) if number else None
        rows.append([page, host, path, [host, parts[0], parts[1] if len(parts) > 1 else "", "/".join(parts[2:])], label])
    for level in (1, 2, 3):  # wildcards from the top down
        kids, count = defaultdict(set), defaultdict(int)
        for r in rows:
            kids[tuple(r[3][:level])].add(r[3][level])
            count[tuple(r[3][:level])] += 1
        for r in rows:
            key = tuple(r[3][:level])
            if len(kids[key]) >= least and count[key] < 2 * len(kids[key]):
                r.append(level)
        for r in rows:
            if len(r) > 5:
                r[3][level] = "*"
                del r[5:]
    seen = [r[4] for r in rows if r[4] is not None]
    score = {(): (sum(seen) + 1) / (len(seen) + 2)}
    for level in (1, 2, 3, 4):
        n, b = defaultdict(int), defaultdict(int)
        for r in rows:
            key = tuple(r[3][:level])
            n[key] += r[4] is not None
            b[key] += r[4] or 0
        alone, pool = {}, defaultdict(lambda: [0, 0])
        for key in n:
            up = score[key[:-1]]
            alone[key] = n[key] > 0 and abs(b[key] / n[key] - up) > z * math.sqrt(up * (1 - up) / n[key])
            if not alone[key] and level > 1:
                pool[key[:-1]][0] += n[key]
                pool[key[:-1]][1] += b[key]
        for key in n:
            k, x = (n[key], b[key]) if alone[key] else pool[key[:-1]] if level > 1 else (0, 0)
            score[key] = (x + m * score[key[:-1]]) / (k + m)
    out = []
    for page, host, path, key, _ in rows:
        rule = max(((h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None))
        out.append((page, host, path, rule[0], rule[1] or ("block" if score[tuple(key)] > reject else "allow")))
    return sorted(out, key=str)


def site():
    pages, labels = [], []
    for k in range(30):  # users with names of their own, and below them good and bad sections
        for j, section in enumerate(("news", "spam")):
            doc = 2 * k + j
            pages.append((doc, f"http://a.org/u{chr(97 + k % 26)}{chr(97 + k // 26)}x/{section}/item-{doc}"))
            if k < 25:
                labels.append((doc, 1 - j, j if k % 2 else 0))
    pages += [(100 + k, f"https://B.Org/page/{100 + k}?q=1#x") for k in range(10)]
    labels += [(100 + k, 0, 0) for k in range(8)] + [(100, 1, 0), (None, 0, 1)]
    pages += [(200, None), (201, ""), (202, "no scheme"), (203, "x://"), (204, "ftp://h?x/y"), (205, "http://www.Example.com/en/1"), (206, "http://m.example.com/en/1"), (207, "http://example.com/de"), (208, "http://my.net/es/9"), (209, "http://net/fr/"), (210, "http://xnet/fr/"), (None, "http://b.org/page/7"), (100, "https://B.Org/page/100?q=1#x"), (211, "http://b.org"), (212, "http://a.org/é/ü")]
    return pages, labels


@pytest.mark.parametrize("most", [20_000, 0])  # the second joins by salt
def test_verdicts_equal_a_plain_tree(spark, most):
    pages, labels = site()
    df = spark.createDataFrame(pages, PAGES).withColumns({"host": F.lit("clash"), "n": F.lit(1), "path": F.lit("p")}).repartition(3)
    marks = spark.createDataFrame(labels, LABELS).withColumn("url", F.lit("u"))
    got = sorted((tuple(r) for r in url_verdicts(df, marks, most_broadcast=most).collect()), key=str)
    assert got == plain(pages, labels)
    verdict = {r[0]: r[4] for r in got}
    assert verdict[59] == "block" and verdict[58] == "allow"  # unlabelled pages below the wildcard follow their section


def test_empty_tables(spark):
    pages, labels = site()
    none, marks = spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)
    assert url_verdicts(none, spark.createDataFrame(labels, LABELS)).count() == 0
    got = sorted((tuple(r) for r in url_verdicts(spark.createDataFrame(pages, PAGES), marks).collect()), key=str)
    assert got == plain(pages, [])
