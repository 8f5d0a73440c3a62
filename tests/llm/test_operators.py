import random
import zlib
from collections import defaultdict

import brute
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from argentum.llm import decontaminate, html_text, licenses, ngram_join, packing, quality, sharding, substrings, token_counts

SCHEMA = "doc_id long, text string, n_words long, spans string, `row` string, doc string, th string, size string, shard string, length string"
WORDS = "the of and to in a is that for on was as with by at from it be this have or an are not".split()


def prose(rng, n, names=40):
    return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(names)}x" for _ in range(n))


def table(spark, docs):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "s", "r", "d", "t", "z", "h", "l") for d, t in docs], SCHEMA)


def near(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs():
    """Nulls, empty and long texts, copies, near copies, shared passages, odd characters."""
    rng = random.Random(7)
    base, passage = prose(rng, 160, 10_000), prose(rng, 60, 10_000)
    out = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one"), (5, "One two"), (6, "Apache License, version"), (7, "x the MIT\nLicense y mit license")]
    out += [(10 + k, near(rng, base, k // 2)) for k in range(14)]
    out += [(30 + k, f"{prose(rng, 30, 10_000)} {passage} {prose(rng, 25, 10_000)}") for k in range(4)]
    out += [(40 + k, base) for k in range(3)]
    out += [(50, "a " * 70), (51, "a b c d e " * 12), (52, "Été naïve 　  déjà vu 東京 🙂 " * 8), (53, prose(rng, 30_000, 10_000)), (54, "line one here\nline one here\nother | # line\n\n" * 4)]
    out += [(60 + k, prose(rng, 300, 12)) for k in range(6)]
    return out


@pytest.fixture(scope="module")
def benchmark(docs):
    text = dict(docs)
    return [(1, " ".join(text[30].split()[40:62])), (2, "Été, NAÏVE!"), (None, "one"), (3, None), (4, " ?"), (1, "nowhere to be found"), (5, text[53][2000:2300])]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_rules(spark, docs):
    found = quality.verdicts(quality.ledger(table(spark, docs)))
    got = rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((d, *brute.quality(t)) for d, t in docs), key=repr)
    for row in found.collect():
        assert row["base_failed"] == (row["n_words"] < 50 or 100 * row["n_repeat_words"] > 50 * row["n_words"])
        assert not (row["base_failed"] and row["kept"])


def test_quality_keeps_columns_and_prose(spark, docs):
    kept = quality.keep(table(spark, docs))
    assert kept.columns == table(spark, docs).columns
    assert {r["doc_id"] for r in kept.collect()} >= {10, 30, 53}
    assert {r["n_words"] for r in kept.collect()} == {1}


def test_quality_ablations(spark, docs):
    found = quality.ledger(table(spark, docs))
    masks = [r["failed"] & quality.DEFAULT.mask for r in found.collect()]
    for row in quality.ablations(found).collect():
        bit = quality.mask_of([row["rule"]])
        assert row["n_failed"] == sum(bool(m & bit) for m in masks)
        assert row["n_alone"] == sum(m == bit for m in masks)
        assert row["n_kept_without"] == sum(m in (0, bit) for m in masks)


def test_licenses(spark, docs):
    got = rows(licenses.scan_licenses(table(spark, docs)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((d, *brute.licenses(t)) for d, t in docs), key=repr)


def test_ledger_leaves_columns_of_any_name(spark):
    odd = spark.createDataFrame([("a b", 1, "m", "n", "o")], "text string, _words int, _lines string, _Symbols string, _measured string")
    found = quality.verdicts(quality.ledger(odd))
    assert found.select(odd.columns).collect() == odd.collect() and found.first()["n_words"] == 2
    assert quality.keep(odd).columns == odd.columns


def test_license_notices_chain_over_changes(spark):
    notice = licenses.NOTICES[0][1]
    changed = notice.replace("software and associated", "library with its associated")
    half = " ".join(notice.split()[:8])
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, [(1, f"x y {changed} z"), (2, half), (3, "software permission granted")])).collect()}
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 0 and 0.8 < found[1]["score"] < 1
    assert found[2]["labels"] == "" and 0 < found[2]["score"] < 0.5
    assert found[3]["score"] == 0
    span = found[1]["spans"][0]
    assert span["start"] == 2 and span["end"] == 2 + len(brute.lowered(changed))


def test_license_keeps_its_label_over_one_changed_word(spark):
    words = licenses.NOTICES[0][1].split()
    texts = [f"ahead {licenses.TEXTS[0][1]} behind"]
    for k in range(len(words)):
        texts += [" ".join([*words[:k], *new, *words[k + 1 :]]) for new in ([], ["another"], [words[k], words[k]])]
    for row in licenses.scan_licenses(table(spark, list(enumerate(texts)))).collect():
        assert row["labels"] == "mit" and row["score"] >= 0.8, texts[row["doc_id"]]


def test_license_labels_and_scores_follow_the_plain_version(spark):
    rng = random.Random(4)
    templates = [("a", "one two three four five six one two three four five seven eight nine"), ("b", "two three four five six one two nine nine"), ("c", "x y z"), ("a", "four five seven eight nine ten")]
    texts = [None, "", "x y z", "x y y z"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 5)):
            own = rng.choice(templates)[1].split()
            at = rng.randrange(len(own))
            words += own[at : at + rng.randrange(2, 15)] + rng.choices(["x", "one", "two", "gap"], k=rng.randrange(4))
        texts.append(" ".join(words))
    found = licenses.scan_licenses(table(spark, list(enumerate(texts))), notices=templates).collect()
    assert len(found) == len(texts)
    for row in found:
        shares = brute.license_shares(texts[row["doc_id"]], templates)
        assert row["labels"] == ",".join(sorted({x for x, share in shares if share >= licenses.SHARE}))
        assert row["score"] == pytest.approx(max(share for _, share in shares))
        for label in "bc":  # one template each: spans don't overlap
            spans = [s for s in row["spans"] if s["label"] == label]
            assert all(a["end"] <= b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_automaton_matching_statistics():
    rng = random.Random(1)
    templates = [[rng.randrange(4) for _ in range(rng.randrange(1, 25))] for _ in range(6)]
    automaton = licenses.Automaton(templates)
    text = [rng.randrange(5) for _ in range(300)]
    parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for k, (_, length) in enumerate(automaton.stream(text)):
        assert length == max((n for n in range(1, min(k + 1, 25) + 1) if tuple(text[k + 1 - n : k + 1]) in parts), default=0)


@pytest.mark.parametrize(("block", "searched"), [(1 << 20, 200_000), (40, 3)])
def test_phrases_are_the_windows_of_the_items(monkeypatch, block, searched):
    monkeypatch.setattr(decontaminate, "SEARCHED", searched)
    rng = random.Random(2)
    items = [(f"i{k % 7}", prose(rng, rng.randrange(30), 6)) for k in range(25)] + [("n", None), ("e", " . "), ("s", "one two"), ("t", "One, two")]
    phrases = decontaminate.Phrases.of(items, block=block)
    want = defaultdict(set)
    for name, text in items:
        for w in brute.windows(text):
            want[w].add(name)
    word = {}
    for _, text in items:
        words = brute.lowered(text)
        found = phrases.symbols(decontaminate.words_of(pa.array([text], pa.string()))[1]).tolist() if words else []
        word |= dict(zip(found, words, strict=True))
    got = {}
    for at, matrix in phrases.matrices():
        for k, row in enumerate(matrix.tolist(), at):
            got[tuple(word[x] for x in row)] = {phrases.names[i] for i in phrases.items[phrases.first[k] : phrases.first[k + 1]]}
    assert got == want and len(phrases) == len(want)
    assert len(decontaminate.Phrases.of([])) == len(decontaminate.Phrases.of([("a", None)])) == 0


@pytest.mark.parametrize("limits", [{}, {"shard_symbols": 50, "block": 150}])
def test_decontamination(spark, docs, benchmark, limits):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    found = decontaminate.digest(decontaminate.contamination(table(spark, docs + docs[:8]), items, **limits))
    got = rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((d, *brute.leaks(t, benchmark)) for d, t in docs + docs[:8]), key=repr)


def test_leaks_are_cut(spark, docs, benchmark):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    source = table(spark, docs)
    left = decontaminate.remove_leaks(source, items, shard_symbols=200)
    assert left.columns == source.columns
    for row in left.collect():
        old = dict(docs)[row["doc_id"]]
        n, hit, *_ = brute.leaks(old, benchmark)
        assert len(brute.lowered(row["text"])) == n - hit
        if not hit:
            assert row["text"] == old


@pytest.mark.parametrize("block", [60, 10_000])
@pytest.mark.parametrize("words", [30, 10**6])
def test_leaks_are_cut_from_rows_of_any_names(spark, docs, benchmark, block, words, monkeypatch):
    """Names that the operator uses inside, and clean text that closes a shard several times."""
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
    names = ["_row", "_cut", "_of", "no", "row", "body", "cut", "spans", "key"]
    source = spark.createDataFrame([(d, t, *names) for d, t in docs], ", ".join(["doc_id long, text string", *(f"`{n}` string" for n in names)]))
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    left = decontaminate.remove_leaks(source, items, block=block)
    assert left.columns == source.columns
    for row in left.collect():
        assert list(row)[2:] == names
        n, hit, *_ = brute.leaks(dict(docs)[row["doc_id"]], benchmark)
        assert len(brute.lowered(row["text"])) == n - hit
    found = decontaminate.contamination(source.withColumnRenamed("doc_id", "no2").withColumnRenamed("no", "doc_id").withColumnRenamed("no2", "no"), items, key="no", block=block)
    assert found.columns == ["no", "n_words", "spans", "items"] and found.count() == len(docs)


@pytest.mark.parametrize("block", [60, 150, 1000])
def test_leaks_of_overlapping_items_in_many_blocks_are_cut_whole(spark, docs, benchmark, block):
    rng = random.Random(11)
    passage = prose(rng, 60, 10_000).split()
    ahead, behind = prose(rng, 20, 10_000).split(), prose(rng, 20, 10_000).split()
    more = [(900, " ".join(ahead + passage + behind)), (901, " ".join(passage[:15])), (902, None), (None, " ".join(ahead + passage[5:40]))]
    items = [*benchmark, *((20 + k, " ".join(passage[k : k + 10])) for k in range(0, 51, 5))]
    items += [(90, " ".join(ahead[-5:] + behind[:5]))]  # stands nowhere, unless texts are joined at a cut
    source = table(spark, docs + more)
    left = decontaminate.remove_leaks(source, spark.createDataFrame(items, "item_id long, text string"), shard_symbols=200, block=block)
    assert left.columns == source.columns
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert brute.lowered(got[900]) == brute.lowered(" ".join(ahead + behind)) and brute.lowered(got[901]) == []
    for d, old in docs + more:
        n, hit, *_ = brute.leaks(old, items)
        assert len(brute.lowered(got[d])) == n - hit
        if not hit:
            assert got[d] == old


def test_token_counts(spark, docs):
    docs = [*docs, (70, "x <|endoftext|>\n\n y's  <|endoftext|>"), (71, "abc" * 500), (72, "  lead\t and trail \n ")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in docs]
    found = token_counts.count_tokens(table(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_packing(spark, docs):
    docs = [*docs, *docs[:5], (70, "x <|endoftext|> y's.a,b"), (71, "(É) ß×ß ĳ 3.5 don't")]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs}
    found = packing.pack(table(spark, docs), public_tokenizers.path("word_bpe_49k.json")).collect()
    copies, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        own = b"".join(i.to_bytes(4, "little") for i in ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(own) and r["doc_tokens"] == len(ids[r["doc_id"]])
        copies[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in ids:
        n = sum(x == d for x, _ in docs)
        cuts = [(a, min(2048, len(ids[d]) - a)) for a in range(0, len(ids[d]), 2048)]
        assert sorted(copies[d]) == sorted(cuts * n)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing_plan_has_little_padding():
    import numpy as np

    rng = np.random.default_rng(3)
    lengths = np.minimum(np.exp(rng.normal(6, 0.8, 40_000)).astype(int) + 1, 2047)
    histogram = np.bincount(lengths, minlength=2049)
    plan = packing.solve(histogram)
    assert plan.n_sequences * 2048 < 1.02 * lengths.sum()
    assert plan.fitted.sum() > 0.5 * len(lengths)


@pytest.mark.parametrize(("edits", "width", "percent"), [(1, 4, 85), (4, 4, 85), (4, 5, 80), (2, 3, 60)])
def test_classes(spark, docs, edits, width, percent):
    rng = random.Random(edits)
    base = prose(rng, 120, 10_000)
    more = [(100 + k, near(rng, base, rng.randrange(3 * edits))) for k in range(25)]
    chain = [prose(rng, 90, 10_000)]
    for _ in range(10):
        chain.append(near(rng, chain[-1], 1))
    more += [(200 + k, t) for k, t in enumerate(chain)]
    want = brute.classes(docs + more, width, percent)
    found = ngram_join.link_classes(table(spark, docs + more + docs[:6]), width=width, percent=percent)
    assert rows(found, "doc_id", "n_shingles", "component_id") == sorted(((d, *want[d]) for d, _ in docs + more + docs[:6]), key=repr)


def test_compare_finds_all_components():
    import numpy as np

    rng = random.Random(5)
    for _ in range(60):
        centre = rng.sample(range(300), rng.randrange(8, 60))
        sets = []
        for _ in range(rng.randrange(2, 25)):
            start = rng.choice(sets) if sets and rng.random() < 0.5 else centre
            kept = [x for x in start if rng.random() > 0.06]
            sets.append(sorted({*kept, *rng.sample(range(300, 340), rng.randrange(4))}) or [1])
        members = [(k, np.array(s, np.uint64)) for k, s in enumerate(sets)]
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        other = list(root)
        for a, b in ngram_join._compare(members):
            assert ngram_join.enough(len({*sets[a]} & {*sets[b]}), len(sets[a]), len(sets[b]))
            root[find(a)] = find(b)
        for a in range(len(sets)):
            for b in range(a):
                if ngram_join.enough(len({*sets[a]} & {*sets[b]}), len(sets[a]), len(sets[b])):
                    other[find(a, other)] = find(b, other)
        assert len({find(x) for x in range(len(sets))}) == len({find(x, other) for x in range(len(sets))})


def test_leaders_of_many_near_copies_meet_in_few_rows(spark, monkeypatch):
    """Near copies of one text that follow different leaders: rows grow with the sets, not with their pairs."""
    rng = random.Random(12)
    made = {}

    def counted(df, label):
        out = staged(df, label)
        made.setdefault(label, []).append(out.count())
        return out

    staged = ngram_join.stage
    monkeypatch.setattr(ngram_join, "stage", counted)
    base = prose(rng, 120, 10_000)
    for n in (300, 1_200):
        made.clear()
        near_copies = [(k, near(rng, base, rng.randrange(1, 4))) for k in range(n)]
        found = {r["doc_id"]: r["component_id"] for r in ngram_join.link_classes(table(spark, near_copies)).collect()}
        assert sum(made["met"]) + sum(made["pairs"]) < 2 * n
        got = defaultdict(set)
        for d, c in found.items():
            got[c].add(d)
        if n == 300:
            assert found == {d: c for d, (_, c) in brute.classes(near_copies).items()}


def test_one_of_each_class_stays(spark, docs):
    source = table(spark, docs + docs[:6])
    kept = ngram_join.keep_one(source)
    assert kept.columns == source.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in brute.classes(docs, 5, 80).items() if d == c)


def test_one_of_each_class_stays_with_null_and_repeated_keys(spark):
    rng = random.Random(12)
    texts = [prose(rng, 80, 10_000) for _ in range(9)]
    source = [(None, t) for t in texts[:4]]  # unlinked, without a key
    source += [(7, texts[4]), (7, texts[5]), (7, texts[5]), (8, texts[6]), (8, near(rng, texts[6], 1)), (None, near(rng, texts[6], 1))]
    source += [(None, texts[7]), (None, texts[7]), (5, texts[8]), (None, texts[8]), (7, near(rng, texts[8], 1))]
    source += [(None, None), (None, None), (None, ""), (9, None), (9, " "), (9, " ")]
    numbered = [(k, t) for k, (_, t) in enumerate(source)]
    of_class = defaultdict(set)
    for k, (_, c) in brute.classes(numbered, 5, 80).items():
        of_class[c].add(source[k])
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(table(spark, source)).collect()]
    full = [x for x in kept if brute.spaced(x[1])]
    classes = [m for m in of_class.values() if any(brute.spaced(t) for _, t in m)]
    assert len(full) == len(classes) == 9
    for members in classes:
        (d, _), = members & {*full}
        assert d == min((x for x, _ in members if x is not None), default=None)
    assert sorted((x for x in kept if not brute.spaced(x[1])), key=repr) == sorted([(None, None), (None, None), (None, ""), (9, None), (9, " ")], key=repr)


@pytest.mark.parametrize("limits", [{}, {"shard_symbols": 100}])
def test_substrings(spark, docs, limits):
    want = brute.repeats(docs)
    source = table(spark, docs + docs[10:14])
    if limits:
        spans = substrings.repeated_spans(source, **limits)
        removed = {r["doc"]: len({i for s in r["spans"] for i in range(s["start"], s["end"])}) for r in spans.collect()}
        assert removed == {d: n for d, (_, n, _) in want.items() if n}
    else:
        found = substrings.digest(source)
        assert rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(((d, *want[d]) for d, _ in docs + docs[10:14]), key=repr)


def test_repeats_are_cut(spark, docs):
    source = table(spark, docs)
    left = substrings.remove_repeats(source)
    assert left.columns == source.columns
    for row in left.collect():
        assert brute.sha(" ".join(brute.spaced(row["text"]))) == brute.repeats(docs)[row["doc_id"]][2]


def test_sharding(spark, docs):
    rng = random.Random(2)
    docs = [x for x in docs if x[0] != 53]  # longer than a shard
    docs = [*docs, *docs[:6], *((1000 + k, prose(rng, rng.randrange(1, 60))) for k in range(600)), *((5000 + k, "same text") for k in range(300)), *[(7, "repeat " * 20)] * 50]
    found = sharding.shard(table(spark, docs), 10, piece_rows=20).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found)) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(10))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 2500  # no document is longer


def test_shards_are_written_whole(spark, docs, tmp_path):
    sharding.write_shards(table(spark, docs), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.where("text is not null").collect()) == sorted((d, t) for d, t in docs if t is not None)


def test_empty_tables(spark):
    none, items = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path
    for found in (
        quality.verdicts(quality.ledger(none)),
        quality.keep(none),
        html_text.extract(none.select("doc_id", F.lit("u").alias("url"), F.col("text").alias("html")), "doc_id"),
        licenses.scan_licenses(none),
        decontaminate.digest(decontaminate.contamination(none, items)),
        decontaminate.remove_leaks(none, items),
        token_counts.count_tokens(none, path("byte_bpe_50k.json"), public_tokenizers.PATTERN),
        packing.pack(none, path("word_bpe_49k.json")),
        ngram_join.link_classes(none),
        ngram_join.keep_one(none),
        substrings.digest(none),
        substrings.remove_repeats(none),
        sharding.shard(none),
    ):
        assert found.count() == 0


def test_null_keys(spark):
    rng = random.Random(9)
    text = prose(rng, 80, 10_000)
    source = table(spark, [(None, text), (3, text), (None, None), (5, "b c")])
    assert rows(substrings.digest(source), "doc_id", "n_removed") == sorted([(None, 0), (3, 80), (None, 0), (5, 0)], key=repr)
    assert rows(ngram_join.link_classes(source), "doc_id", "component_id") == sorted([(None, 3), (3, 3), (None, None), (5, 5)], key=repr)
    assert sharding.shard(source, 2).count() == packing.pack(source, public_tokenizers.path("word_bpe_49k.json")).count() == 4


PAGE = """<html><head><title>x</title><style>p{}</style><body>Hi<p>one<p>two <b>bold</b>!<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>
<table><tr><th>name<th>n<tr><td>long name<td>1</table><div hidden>no</div><p style="display:none">no</p><!-- no --><script>no()</script>
<pre>  keep
   this</pre>a<br>b &amp; c</p><template>no</template></b>end"""
TEXT = """Hi

one

two bold!

- a
- b
  3. c
  4. d

name       n
long name  1

  keep
   this

a
b & c

end"""


def test_html_layout(spark):
    assert html_text.page_text(PAGE) == TEXT
    pages = [(1, PAGE), (2, None), (3, ""), (None, "<p>x"), (1, PAGE), (4, "<div>" * 5000 + "deep"), (5, "<td>a<td>b<tr><td>c"), (6, "a < b && c <3")]
    found = html_text.extract(spark.createDataFrame([(p, h, "t", 0) for p, h in pages], "page_id long, html string, text string, n_lines long"))
    assert rows(found, "page_id", "text") == sorted([(1, TEXT), (2, ""), (3, ""), (None, "x"), (1, TEXT), (4, "deep"), (5, html_text.page_text(pages[6][1])), (6, "a < b && c <3")], key=repr)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
        ("a<svg><title>no</title><defs><text>no</text><text id=u>yes</text></defs><use href='#u'/><text x=1>left</text>no<g><text>ri<tspan>ght</tspan></text></g></svg>b", "a yes left right b"),
        ("<svg><foreignObject><div>inside</div></foreignObject></svg>out", "inside\nout"),
        ("<div>a<svg/>b<math/>c</div>", "a bc"),
        ("<svg><defs/><g/><text>t</text></svg>", "t"),
        ("<svg><path d=''><p>out", "out"),
        ("<head><title>x</title>Hello <b>you</b><p>there", "Hello you\n\nthere"),
        ("<head><meta charset=x><b>bold</b> text", "bold text"),
        ("<html><head>\n<title>x</title><style>no</style><script>no</script></head>y", "y"),
        ("<head><template>no<div>no</div></template>yes", "yes"),
    ],
)
def test_html_shows_formulas_drawings_and_text_behind_an_open_head(page, text):
    assert html_text.page_text(page) == text


LONG = "A" * 73


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td colspan=1>f</table>", "a  b  c\nd     e\nf"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g</table>", "ab    c\n      d\ne  f  g"),
        (f"<table><tr><td>{LONG}<td>B<tr><td>x<td>C</table>", f"{LONG}\n{' ' * 62}B\nx{' ' * 61}C"),
        ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\n\nb"),
        ("<table><tr><td><td></table>x", "x"),
        ("<table><tr><td>\u6771\u4eac<td>b<tr><td>abcd<td>c</table>", "\u6771\u4eac  b\nabcd  c"),
    ],
)
def test_html_cells_begin_at_their_columns(page, text):
    assert html_text.page_text(page) == text


def test_html_cells_of_any_width_and_span_are_aligned():
    """Against the places that a plain grid gives the cells."""
    rng = random.Random(8)
    for _ in range(60):
        taken, home, page, n_rows = set(), {}, ["<table>"], rng.randrange(1, 7)
        for r in range(n_rows):
            page.append("<tr>")
            c = 0
            for _ in range(rng.randrange(1, 6)):
                while (r, c) in taken:
                    c += 1
                down, across = rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])
                name = f"w{len(home)}x" + "y" * rng.choice([0, 3, 20, 80])
                home[name] = c
                page.append(f"<td rowspan={down} colspan={across}>{name}")
                taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
                c += across
        place, seen = {}, []
        for line in html_text.page_text("".join(page)).split("\n"):
            for word in line.split():
                seen.append(word)
                assert place.setdefault(home[word], line.index(word)) == line.index(word)
        assert seen == list(home)
        assert [place[c] for c in sorted(place)] == sorted(place.values())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no<br>no<img alt=no></div>end", "yes\nend"),
        ("<ul style='visibility:collapse'><li>no<li><b style='visibility:VISIBLE !important;visibility:hidden'>yes</b></ul>", "  yes"),
        ("<div style='visibility:hidden'><p style='visibility:inherit'>no</div>x", "x"),
        ("<p style='--x-display:none'>yes", "yes"),
        ("<p style='display:none;display:block'>yes", "yes"),
        ("<p style='display:none!important;display:block'>no</p>x", "x"),
        ("<p style='/* display:none; */background:url(a;display:none;b);content:\"; display:none\"'>yes", "yes"),
        ("<p hidden style='display:block'>yes<p hidden>no", "yes"),
        ("<svg visibility=hidden><text>no</text><text visibility=visible>yes</text></svg>", "yes"),
        ("<table style='visibility:hidden'><tr><td>no<td>no</table>x", "x"),
    ],
)
def test_html_shows_what_styles_show(page, text):
    assert html_text.page_text(page) == text


def test_html_long_pages_and_deep_tables():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert html_text.page_text(f"<p>{words}") == words
    assert html_text.page_text("<table><tr>" + "<td>a" * 3_000 + "</table>").split() == ["a"] * 3_000
    assert html_text.page_text("<table><tr><td>" * 300 + "deep").strip() == "deep"


def test_html_emits_all_visible_words():
    """Against a plain walk of well-formed pages: every visible word, in order."""
    rng = random.Random(4)
    for _ in range(50):
        said, out = [], []

        def grow(depth):
            for _ in range(rng.randrange(1, 4)):
                if depth == 0 or rng.random() < 0.4:
                    said.append(f"w{rng.randrange(1000)}")
                    out.append(said[-1] + " ")
                else:
                    tag = rng.choice(["div", "section", "blockquote", "ul", "b", "span", "script", "article"])
                    before = len(said)
                    out.append(f"<{tag}>" + ("<li>" if tag == "ul" else ""))
                    if tag == "script":
                        out.append("no()")
                    else:
                        grow(depth - 1)
                    out.append(("</li>" if tag == "ul" else "") + f"</{tag}>")
                    assert len(said) >= before

        grow(4)
        shown = [w for w in html_text.page_text("".join(out)).split() if w not in ("-", ">")]
        assert shown == said


def test_sql_of_leaks_and_quality_holds_on_odd_texts(spark, docs, benchmark):
    from argentum.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = sorted(con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words FROM ({ORACLES['op7_quality_rules']})").fetchall())
    assert got == sorted((d, *brute.quality(t)) for d, t in docs)
