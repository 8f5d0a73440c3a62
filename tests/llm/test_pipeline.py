import zlib
from collections import defaultdict
from pathlib import Path

import brute
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_the_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SMALL)
        assert docs.columns == columns
        docs = docs.cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality_rules":
            for d, text in before.items():
                n, _, symbols, _, repeated = brute.quality(text)
                assert (d in after) or n < 50 or 100 * repeated > 50 * n or 100 * symbols > 10 * n or text.count("!!") > 10
        elif name == "near_duplicates":
            assert set(after) == {d for d, (_, c) in brute.classes(list(before.items()), 5, 80).items() if c == d}
        elif name == "substring_dedup":
            for d, (n, removed, sha) in brute.repeats(list(before.items())).items():
                assert brute.sha(" ".join(brute.spaced(after.get(d)))) == sha
                assert (d in after) == (n > removed)
        else:
            for d, text in before.items():
                n, hit, *_ = brute.leaks(text, items)
                assert len(brute.lowered(after.get(d))) == n - hit
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in pieces} == set(before)


def test_packed_pieces_hold_their_token_ids(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(1, "some words, to be packed"), (2, "a b c " * 1500), (None, "no key"), (None, "no key either"), (3, "twice"), (3, "twice")]
    pieces = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL).collect()
    got = defaultdict(bytes)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        got[r["sequence_id"]] += r["ids"]
    ids = [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in docs]
    want = sorted(b"".join(i.to_bytes(4, "little") for i in x[a : a + 2048]) for x in ids for a in range(0, len(x), 2048))
    assert sorted(r["ids"] for r in pieces) == want
    assert sum(map(len, got.values())) == sum(map(len, want)) and max(map(len, got.values())) <= 4 * 2048


def test_operators_are_apart():
    root = Path(__file__).resolve().parents[2]
    for path in [*root.glob("argentum/**/*.py"), *root.glob("driver_queries/**/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
