"""Operators 11 to 13 against brute-force forms, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest

from panelia.llm import centroids, fill_in_middle, url_filter

SF = "/root/testdata/sf0.1"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- 11 --------------------------------------------------------------------------------------

URLS = [
    "https://a.example.com/en/1", "https://www.example.com/en/1", "http://x.www.example.com/en/", "http://WWW.Example.COM/EN/", "http://com/", "http://com",
    "https://example.com/de/x.html?a=1&b=2#c", "https://example.net/es/1", "https://n.net/fr/", "https://n.net/fr", "ftp://net/es/?x://y.com/en/", "net/es/",
    "://net/es/", "https://notcom/", "https://exampleXcom/", "https://u@p.com:80/", "https://com./", "https://org/a?b", "https://org?/com/", "https://org#x",
    "x\ny://b.com/e\nn/", "", "http://", "http:///en/", "https://İ.com/", None,
]


def brute_rule(url):
    """(host, path, rule, verdict) read off the contract."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None))


PAGES = "page_id long, url string, host string, path string, rule string, label double, features string, kind string, bucket int, top_seen int"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "p", "r", 1.0, "f", "k", 3, 4) for i, u in enumerate(urls)], PAGES)


def test_url_rules(spark):
    rng = random.Random(3)
    parts = ["http", "://", "/", "?", "#", ".", "com", "net", "example", "www", "en", "es", "fr", "COM", "x"]
    urls = URLS + URLS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    df = pages(spark, urls)
    got = {r.page_id: r for r in url_filter.url_verdicts(df, url_filter.fit(df)).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = brute_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (verdict or ("block" if got[i].block_score >= 0.5 else "allow"))


def test_url_features(spark):
    urls = ["https://ab1.example.com/x/22/y.html?a=1&b=2#t", "", "aab", "http://a-b.c/" + "é" * 5000]
    rows = url_filter.with_lexical(url_filter.with_rules(pages(spark, urls))).orderBy("page_id").collect()
    first = rows[0]
    assert (first.depth, first.parameters, first.labels, first.query_chars, first.has_fragment) == (3, 2, 3, 7, 1)
    assert first.digit_ratio == pytest.approx(5 / len(urls[0]))
    for url, row in zip(urls, rows):
        share = [url.count(c) / len(url) for c in set(url)]
        assert row.entropy == pytest.approx(-sum(p * np.log2(p) for p in share), abs=1e-9)


def test_url_trees_on_held_out_hosts(spark):
    """Labelled URLs of hosts that the fit has not seen."""
    df = spark.read.parquet(f"{SF}/pages.parquet")
    unseen = url_filter.F.crc32(url_filter.host_of(url_filter.F.col("url"))) % 4 == 0
    model = url_filter.fit(df.filter(~unseen))
    scored = url_filter.block_scores(df.filter(unseen), model).filter("ruled IS NOT NULL").collect()
    right = sum((r.block_score >= 0.5) == (r.ruled == "block") for r in scored)
    assert len(scored) > 150 and right >= 0.95 * len(scored)


def test_url_sample_bound_and_missing_classes(spark):
    urls = [f"https://h{i % 7}.example.com/{'en' if i % 2 else 'de'}/{i}" for i in range(3000)]
    df = pages(spark, urls)
    small = url_filter.fit(df, sample=200)
    right = [r.block_score >= 0.5 for r in url_filter.block_scores(df, small).orderBy("page_id").collect()]
    assert sum(a == bool(i % 2) for i, a in enumerate(right)) > 2900
    assert {r.verdict for r in url_filter.url_verdicts(pages(spark, ["http://x.org/"]), url_filter.fit(pages(spark, ["http://x.org/"]))).collect()} == {"allow"}
    one = pages(spark, ["http://n.net/es/", "http://x.org/", None])
    assert [r.verdict for r in url_filter.url_verdicts(one, url_filter.fit(one)).orderBy("page_id").collect()] == ["block"] * 3
    empty = df.limit(0)
    assert url_filter.url_verdicts(empty, url_filter.fit(empty)).count() == 0


def test_url_filter_is_native(spark):
    df = pages(spark, URLS)
    plan = url_filter.url_verdicts(df, url_filter.fit(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 12 --------------------------------------------------------------------------------------


def brute_nearest(vectors, middles):
    apart = ((vectors[:, None, :] - middles[None, :, :]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


@pytest.mark.parametrize("spread, width, count", [(2, 3, 16), (40, 8, 16), (1000, 64, 16), (5, 1, 4), (10, 5, 1)])
def test_nearest_by_threshold(spread, width, count):
    rng = np.random.default_rng(spread)
    middles = rng.integers(-spread, spread + 1, (count, width))
    middles[-1] = middles[0]  # a tie on every vector
    vectors = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, width)), middles])
    got = centroids.SortedLists(middles).nearest(vectors)
    want = brute_nearest(vectors, middles)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_threshold_stops_early():
    """Far apart groups: most centroids are never measured."""
    middles = np.arange(16)[:, None] * np.full((1, 8), 1000)
    lists = centroids.SortedLists(middles)
    vectors = middles.repeat(50, axis=0) + np.random.default_rng(1).integers(-9, 10, (800, 8))
    measured, einsum = [], np.einsum
    centroids.np.einsum = lambda *a: measured.append(len(a[1])) or einsum(*a)
    try:
        assert (lists.nearest(vectors)[0] == np.arange(16).repeat(50)).all()
    finally:
        centroids.np.einsum = einsum
    assert sum(measured) <= 2 * len(vectors)


def test_components_at_the_limit():
    ends = np.array([[-centroids.LARGEST] * 64, [centroids.LARGEST] * 64])
    cluster, distance = centroids.SortedLists(ends).nearest(np.concatenate([ends, ends[:1] + 1]))
    assert cluster.tolist() == [0, 1, 0] and distance.tolist() == [0, 0, 64]


def brute_clusters(rows, clusters, rounds, width, seed=1):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    middles = [list(map(int, v)) for _, v in sorted(kept, key=lambda x: (digest(x[0]), x[1].tolist()))[:clusters]]
    for turn in range(rounds + 1):
        chosen = []
        for i, v in kept:
            apart = [sum((int(a) - b) ** 2 for a, b in zip(v, m)) for m in middles]
            chosen.append((i, apart.index(min(apart)), min(apart)))
        if turn < rounds:
            for k in range(len(middles)):
                mine = [v for (_, v), c in zip(kept, chosen) if c[1] == k]
                if mine:
                    middles[k] = [int(sum(map(int, column))) // len(mine) for column in zip(*mine)]
    return sorted(chosen, key=str), middles


VECTORS = "vec_id long, embedding array<double>, label int, cluster int, distance long, h string"


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (3, 2), (200, 1)])
def test_clusters(spark, clusters, rounds):
    rng = random.Random(clusters)
    rows = [(i, [rng.choice([0.1, -0.4, 0.03, 2.0, -0.0156]) for _ in range(4)]) for i in range(150)]
    rows += [(3, rows[3][1])] * 20 + [(None, [0.5] * 4), (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0])]
    rows += [(904, [float("nan")] * 4), (905, [float("-inf"), 0.0, 0.0, 0.0]), (906, [1.0] * 5), (907, [-0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "h") for i, v in rows], VECTORS).repartition(3)
    found, middles = centroids.cluster_vectors(df, clusters, rounds, 4)
    want, at = brute_clusters(rows, clusters, rounds, 4)
    assert rows_of(found) == want
    assert middles.tolist() == at


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1, 2, 3, "h")], VECTORS)
    for x in (df, df.limit(0)):
        found, middles = centroids.cluster_vectors(x)
        assert found.count() == 0 and found.columns == ["vec_id", "cluster", "distance"] and len(middles) == 0
    with pytest.raises(Exception, match="overflow"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e7] * 2, 1, 2, 3, "h")], VECTORS), width=2)


# --- 13 --------------------------------------------------------------------------------------


def brute_fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return i, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return i, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def fim_texts():
    rng = random.Random(8)
    parts = ["a", "Word", " ", "\n", "é", "日", "😀", "<", ">", "P", "S", "M", "<P", "S>", "<M>", "0", "\x00", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(700)]
    texts += [None, "", "<P", ">", "<S>", "P><", "x" * 5000, "日" * 300, "<" * 9, "a<S", "<P<S<M", "Zz[`az{@AZ"]
    return list(enumerate(texts)) + [(None, "null id"), (5, texts[5]), (5, texts[5]), (-7, "minus"), (1 << 62, "large id")]


DOCS = "doc_id long, text string, output string, form string, n int, h1 string, restored string"


def test_fill_in_middle(spark):
    rows = fim_texts()
    rows.append((99999, "long words of many letters, 日本語. " * 100_000))  # over BLOCK bytes
    df = spark.createDataFrame([(i, t, "o", "f", 1, "h", "r") for i, t in rows], DOCS).repartition(3)
    got = rows_of(fill_in_middle.restored(fill_in_middle.fill_in_middle(df)))
    assert got == sorted((brute_fim(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restored(fill_in_middle.fill_in_middle(df.limit(0))).count() == 0


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_scatter_by_blocks(limit):
    """Small blocks and slices of Arrow arrays give the same outputs; all forms return."""
    rows = fim_texts()
    texts = fill_in_middle.pa.array([t or "" for _, t in rows]).slice(3)
    drawn = np.random.default_rng(4).integers(0, 1 << 32, (len(rows), 4))[3:]
    flat, borders = fill_in_middle.text_bytes(texts)
    back = []
    for a, b in fill_in_middle.blocks(np.diff(borders), limit):
        part = borders[a : b + 1]
        out, targets, *_, form, _, _ = fill_in_middle.scatter(flat[part[0] : part[-1]], part - part[0], drawn[a:b], 100, 50)
        assert set(form[[len(t) > 0 and not re.search("<[PSM]>", t) for t in texts[a:b].to_pylist()]].tolist()) <= {1, 2}
        back += fill_in_middle.text_array(*fill_in_middle.gather(out, targets, form > 0)).to_pylist()
    assert back == texts.to_pylist()
