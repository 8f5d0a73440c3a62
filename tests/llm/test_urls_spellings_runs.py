"""URL rules, spelling variants and periodic runs against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import brute
import numpy as np
import pytest

from argentum.llm import periodic, spellings, url_rules

CLASHES = "host string, path string, `query` string, tokens string, key string, verdict string, rule string, word string, n long, body string, root string, start string, n_runs string"
CLASH = ("h", "p", "q", "t", "k", "v", "r", "w", 7, "b", "o", "s", "u")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- URL rules


def plain_parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut].translate(brute.LOWER), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    query = rest[len(path) + 1 :].split("#")[0] if rest[len(path) : len(path) + 1] == "?" else ""
    return host, path, query


def plain_tokens(url):
    host, path, query = plain_parts(url)
    digits = lambda x: "".join("0" if c.isdigit() and c.isascii() else c for c in x)
    squeeze = lambda x: "".join(c for i, c in enumerate(digits(x)) if not (x[i] in "0123456789" and i and x[i - 1] in "0123456789"))
    out = {f"h={x}" for x in host.split(".") if x} | {f"p={squeeze(x)}" for x in path.split("/") if x}
    return out | {f"q={x.split('=')[0]}" for x in query.split("&") if x}


def plain_listed(host, path):
    fits = []
    for rule, verdict in url_rules.LISTED:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start):
            fits.append((len(rule), len(name), rule, verdict))
    return max(fits)[2:] if fits else (None, None)


def plain_mine(labelled, rows, confidence, per_basket, most):
    spread = Counter(t for has, _ in labelled for t in has)
    sets, both = Counter(), Counter()
    for has, verdict in labelled:
        kept = sorted(sorted((t for t in has if spread[t] >= rows), key=lambda t: (spread[t], t))[:per_basket])
        for k in range(1, most + 1):
            for part in combinations(kept, k):
                sets[part] += 1
                both[part, verdict] += 1
    rules = {key: n / sets[key[0]] for key, n in both.items() if n >= rows and 100 * n >= confidence * sets[key[0]]}
    kept = {}
    for (part, verdict), sure in rules.items():
        if all(rules.get((p, verdict), -1) < sure for k in range(1, len(part)) for p in combinations(part, k)):
            kept[part, verdict] = sure, both[part, verdict]
    return kept


@pytest.fixture(scope="module")
def web():
    rng = random.Random(3)
    hosts = ["a.example.org", "shop.example.com", "casino-win.example.net", "blog.x.net", "example.org", "www.y.fr", "org"]
    pages = []
    for i in range(400):
        host = rng.choice(hosts) if i % 3 else "casino-win.example.net"  # a third of the rows has one host
        path = rng.choice(["", "/", "/es/12", "/en/1", "/en/27.html", "/fr/3", "/de/", "/win/now/5", "/en/win"])
        pages.append((i, f"http{rng.choice(['', 's'])}://{rng.choice([host, host.upper()])}{path}{rng.choice(['', '?page=2&ref=x', '#top', '?&&id#q?z=1'])}"))
    pages += [(400, None), (401, ""), (402, "no scheme.org/"), (403, "://"), (404, "x://a.org?p=://b"), (405, "http://u:p@ORG:80/x"), (406, "a://org/es/ñ\n/1"), (None, "http://k.org/"), (None, None)]
    pages += [pages[0], pages[0], (500, "http://h.net/" + "/".join(f"s{k}x" for k in range(3000)))]
    labels = []
    for i, url in pages:
        if i is not None and i % 2 == 0:
            bad = url and ("casino" in url.lower() and "win" in plain_parts(url)[1]) or rng.random() < 0.1
            labels.append((i, 0 if bad else 1, rng.choice([0, None])))
    return pages, [*labels, (0, None, 1), (None, 0, 0), (9999, 1, 0)]


def test_url_rules_equal_plain_mining(spark, web):
    pages, labels = web
    source = spark.createDataFrame([(*p, *CLASH) for p in pages], f"page_id long, url string, {CLASHES}")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mined = url_rules.mine(url_rules.labelled_urls(source, said), per_mille=20, per_basket=6)
    bad = defaultdict(bool)
    for k, quality, toxic in labels:
        bad[k] |= (1 if quality is None else quality) == 0 or toxic == 1
    labelled = [(plain_tokens(u), "block" if bad[p] else "allow") for p, u in pages if p is not None and p in bad and plain_tokens(u)]
    want = plain_mine(labelled, max(5, -(-len(labelled) * 20 // 1000)), url_rules.CONFIDENCE, 6, url_rules.MOST_TOKENS)
    assert {(r.tokens, r.verdict): (r.confidence, r.support) for r in mined} == want
    blocks = [r for r in mined if r.verdict == "block"]
    assert any("h=casino-win" in r.tokens and len(r.tokens) > 1 for r in blocks)

    got = collected(url_rules.judge(source, mined=mined), "page_id", "host", "path", "rule", "verdict", "mined_rule")
    expected = []
    for p, url in pages:
        host, path, _ = plain_parts(url)
        rule, verdict = plain_listed(host, path)
        fires = sorted((-sure, -n, part, said) for (part, said), (sure, n) in want.items() if plain_tokens(url).issuperset(part))
        first = fires[0] if fires else None
        expected.append((p, host, path, rule, verdict or (first[3] if first else "allow"), " ".join(first[2]) if first else None))
    assert got == sorted(expected, key=repr)


def test_url_rules_of_long_urls(spark):
    rng = random.Random(5)
    names = [f"{x}{y}" for x in "abcdefgh" for y in "klmn"]
    pages, labels = [], []
    for i in range(240):
        path = [x for x in names if rng.random() < 0.6] + ["one", "two"]  # one and two always come together
        pages.append((i, "http://x.net/" + "/".join(path)))
        labels.append((i, 0 if "ak" in path and "hn" in path and rng.random() < 0.95 else rng.choice([1, 1, 0]), None))
    source, said = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled = [(plain_tokens(u), "allow" if q else "block") for (_, u), (_, q, _) in zip(pages, labels, strict=True)]
    assert min(len(has) for has, _ in labelled) > url_rules.PER_BASKET
    want = plain_mine(labelled, 24, url_rules.CONFIDENCE, None, url_rules.MOST_TOKENS)
    table = url_rules.mined_rules(url_rules.labelled_urls(source, said), per_mille=100)
    mined = [url_rules.Rule(tuple(r["tokens"]), *r[1:]) for r in table.collect()]
    assert {(r.tokens, r.verdict): (r.confidence, r.support) for r in mined} == want and len(mined) == len(want)
    assert {len(r.tokens) for r in mined} >= {2, 3}

    columns = "page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence"
    more = source.unionAll(spark.createDataFrame([(None, None), (0, pages[0][1]), (900, "http://a.org/none"), (901, "http://y.com/de/ak/hn/bl")], source.schema))
    got = collected(url_rules.judge(more, mined=mined), *columns)
    assert got == collected(url_rules.judge(more, mined=table), *columns) == collected(url_rules.judge(more, mined=table, max_broadcast=0), *columns)
    assert len(got) == 244 and any(row[5] for row in got)


def test_no_rule_is_dropped_for_its_number(spark):
    many = url_rules.MOST_RULES + 500
    letters = str.maketrans("0123456789", "abcdefghij")
    url = "http://x.net/" + "/".join(str(k).translate(letters) for k in range(many))
    source = spark.createDataFrame([(i, url) for i in range(5)], "page_id long, url string")
    said = spark.createDataFrame([(i, 0, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert len(url_rules.mine(url_rules.labelled_urls(source, said))) == many + 2


def test_url_rules_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "http://x.net/a"), (2, "http://q.com/de/")], pages.schema)
    assert url_rules.mine(url_rules.labelled_urls(pages, labels)) == []
    assert url_rules.mine(url_rules.labelled_urls(some, labels)) == []
    assert url_rules.judge(pages).collect() == []
    assert collected(url_rules.judge(some), "page_id", "rule", "verdict") == [(1, None, "allow"), (2, "com/de/", "block")]


def test_longest_listed_rule_wins():
    index = url_rules.Index([("b.c/xx", "allow"), ("a.b.c/", "block"), ("a.b.c/x", "allow"), ("c/xxxxxxxx", "block")], [])
    assert index.listed_rule("a.b.c", "/xxxxxxxxx") == ("c/xxxxxxxx", "block")
    assert index.listed_rule("a.b.c", "/xx") == ("a.b.c/x", "allow")
    assert index.listed_rule("z.a.b.c", "/y") == ("a.b.c/", "block")
    assert index.listed_rule("xa.b.c", "/y") is None and index.listed_rule("a.b.c", "") is None
    assert url_rules.Index([("b.c/xx", "allow"), ("a.b.c/", "block")], []).listed_rule("a.b.c", "/xx") == ("a.b.c/", "block")


# ---------------------------------------------------------------- spelling variants


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in _letters(text):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _letters(text):
    import re

    return re.findall("[a-z\u00c0-\u00ff]+", (text or "").translate(brute.LOWER))


def plain_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spellings(docs):
    words = plain_words(docs)
    forms, out = {}, []
    for w, n in words.items():
        near = sorted((-words[x], x) for x in words if plain_near(w, x))
        if near and -near[0][0] >= 5 * n:
            forms[w] = near[0][1]
        out.append((w, n, len(near)))
    rows = []
    for w, n, k in out:
        root = w
        while root in forms:
            root = forms[root]
        rows.append((w, forms.get(w), root, n, k, words.get(forms.get(w))))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(5)
    base = ["harmonie", "Éclatante", "pneumonie", "aaaaaaa", "xy" * 40, "ÿ" * 9, "z" * 130, "münchen"]
    docs = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base[:3] if rng.random() < 0.6 else base)
            while rng.random() < 0.25:
                at, c = rng.randrange(len(w)), rng.choice("aeß÷×é")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, rng.choice([" ", "-", "1", "\u0100", "日"]).join(words)))
    docs += [(1000, None), (1001, ""), (1002, "a" * 300_000), (None, "harmonie harmoniee harmonie"), (7, docs[7][1]), (1003, "chainword " * 700 + "chainwore " * 100 + "chainwere " * 15), (1004, " 12 !? 日本 ")]
    return docs


@pytest.mark.parametrize("filter_bytes", [spellings.FILTER_BYTES, 8 * spellings.CHUNK])
def test_spellings_equal_brute_force(spark, misspelt, filter_bytes):
    source = spark.createDataFrame([(*d, *CLASH) for d in misspelt], f"doc_id long, text string, {CLASHES}")
    got = collected(spellings.group_spellings(source, filter_bytes=filter_bytes), "word", "form", "root", "n", "n_near", "form_n")
    want = plain_spellings(misspelt)
    assert got == want
    chain = {r[0]: r[1:3] for r in got}
    assert chain["chainwere"] == ("chainwore", "chainword")
    assert sum(r[1] is not None for r in got) > 20


def test_spellings_of_empty_tables(spark):
    for docs in ([], [(1, None), (2, "short words only")]):
        source = spark.createDataFrame(docs, "doc_id long, text string")
        assert spellings.group_spellings(source).collect() == []


def test_filters_miss_nothing(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(6, 9))) for _ in range(3000)})
    own = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = spellings.filter_sizes(own)
    (wanted,) = spellings._passes(sizes, spellings.FILTER_BYTES)
    filters = spellings.Filters(sizes, spellings.build_filters(own, sizes, wanted))
    passed = tried = 0
    for length, places, letters in spellings._by_length(words):
        sums = (spellings._values()[letters] * spellings._powers(length)).sum(axis=1, dtype=np.uint64)
        assert filters.have(sums, length).all()
        others = np.array([list(f"q{w}"[:length].encode("latin-1")) for w in (words[i] for i in places)], np.uint8)
        passed += int(filters.have((spellings._values()[others] * spellings._powers(length)).sum(axis=1, dtype=np.uint64), length).sum())
        tried += len(places)
    assert passed < 0.02 * tried


def test_crc_of_ranges_is_the_librarys():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.integers(0, 2 * spellings.SHORT, 300)
    begun = np.array([zlib.crc32(bytes([k % 7])) for k in range(300)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(v)) for a, b, v in zip(start, end, begun, strict=True)]
    assert spellings.crc32_of(data, start, end, begun).tolist() == want


# ---------------------------------------------------------------- periodic runs


def plain_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and not any(q % p == 0 and s <= i and s + m >= j + q for s, m, p in found):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_periods(doc, text):
    words = brute.spaced(text)
    n, h = len(words), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return len(runs), *best, best[1] and 1000 * best[1] // best[2], brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), brute.sha(kept), kept


def test_periodic_runs_equal_brute_force(spark):
    rng = random.Random(9)
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a"), (4, "a " * 5), (5, "a " * 6), (6, "é b " * 9), (7, "x " * 400)]
    for i in range(8, 200):
        size = rng.choice([2, 3, 8, 300])
        words = [f"w{rng.randrange(size)}" for _ in range(rng.randrange(1, 260))]
        if rng.random() < 0.5:
            at, q, times = rng.randrange(len(words)), rng.randrange(1, 12), rng.randrange(3, 9)
            phrase = words[at : at + q]
            words[at:at] = (phrase * times)[: len(phrase) * times - rng.randrange(len(phrase))]
        docs.append((i, " ".join(words)))
    docs += [(None, "a b c d e f g h " * 20), (8, docs[8][1]), (300, "p q " * 3 + ("p q " * 5 + "r ") * 6)]
    source = spark.createDataFrame([(*d, *CLASH) for d in docs], f"doc_id long, text string, {CLASHES}")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
    got = collected(periodic.detect_runs(source, plant=True, with_text=True), "doc_id", *columns)
    assert got == sorted(((d, *plain_periods(d, t)) for d, t in docs), key=repr)
    assert sum(r[1] > 0 for r in got) > 60


def test_runs_of_random_binary_words():
    """Few words make every kind of overlap."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        sizes = rng.integers(0, 60, 4)
        words = rng.integers(0, int(rng.integers(2, 4)), int(sizes.sum()))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        got = periodic.find_runs(words.astype(np.uint64), bounds, np.repeat(np.arange(4), sizes))
        want = [(int(bounds[k]) + s, m, q) for k in range(4) for s, m, q in plain_runs(words[bounds[k] : bounds[k + 1]].tolist())]
        assert [tuple(r) for r in got.tolist()] == want


def test_runs_of_a_long_text():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 60, 400_000).astype(np.uint64)
    words[1000:201_000] = np.tile(words[1000:41_000], 5)
    words[300_000:390_000] = 7
    got = periodic.find_runs(words, np.array([0, len(words)]), np.zeros(len(words), np.int64)).tolist()
    assert got == [[1000, 200_000, 40_000], [300_000, 90_000, 1]]


def test_runs_of_an_empty_table(spark):
    assert periodic.detect_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
