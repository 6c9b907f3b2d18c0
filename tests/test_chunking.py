"""Tokens, sentences and chunkers on the contract documents."""

import random

import pytest

from quern.functions.text import sentences, token_offsets
from quern.operators import chunking as C


def contract_texts():
    r = random.Random(0)
    texts = ["Plain prose here. It has two sentences! Does it? Yes.", "messy \t\n\n  white   space.\n\n\nNew paragraph", "Türkçe metin ve 数字 karışık. É voilà. 你好", "a" * 500, "one", "", " \n\t ", "(Brackets) end. [Next] one. \"Quoted\" too.\nLine\nbreaks"]
    for _ in range(10):
        texts.append(" ".join("".join(r.choice("abcXYZ.,!?") for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 400))))
    return texts


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(enumerate(contract_texts())), "doc_id long, text string").cache()


def test_offsets_are_exact(documents):
    texts = contract_texts()
    rows = token_offsets(documents).collect()
    assert all(texts[r["doc_id"]][r["tok_start"] : r["tok_end"]] == r["token"] for r in rows)
    import re

    for d, t in enumerate(texts):
        assert [r["token"] for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["tok_idx"])] == re.findall(r"\w+|[^\w\s]", t)


def test_sentences_cover_all_tokens(documents):
    texts = contract_texts()
    for r in sentences(documents).collect():
        piece = texts[r["doc_id"]][r["sent_start"] : r["sent_end"]]
        assert piece == r["sentence"] == piece.strip() != ""
    assert [r["sentence"] for r in sentences(documents).filter("doc_id = 0").orderBy("sent_idx").collect()] == ["Plain prose here.", "It has two sentences!", "Does it?", "Yes."]


@pytest.mark.parametrize("limit", [1, 7, 64, 512])
@pytest.mark.parametrize("kind", ["fixed", "sentence", "sentence_overlap", "recursive"])
def test_contract(documents, kind, limit):
    """Within the limit, at least a token, every token covered, starts in order."""
    made = {"fixed": lambda: C.fixed_chunks(documents, limit, limit // 2), "sentence": lambda: C.sentence_chunks(documents, limit), "sentence_overlap": lambda: C.sentence_chunks(documents, limit, 1), "recursive": lambda: C.recursive_chunks(documents, limit)}[kind]()
    counts = {r["doc_id"]: 0 for r in documents.collect()}
    for r in token_offsets(documents).groupBy("doc_id").count().collect():
        counts[r["doc_id"]] = r["count"]
    rows = {}
    for r in made.orderBy("doc_id", "chunk_idx").collect():
        rows.setdefault(r["doc_id"], []).append((r["tok_lo"], r["tok_hi"]))
        assert 1 <= r["n_tokens"] == r["tok_hi"] - r["tok_lo"] + 1 <= limit
    for d, n in counts.items():
        spans = rows.get(d, [])
        assert {t for a, b in spans for t in range(a, b + 1)} == set(range(n))
        assert [a for a, _ in spans] == sorted(a for a, _ in spans)


def test_fixed_windows_by_hand(spark):
    docs = spark.createDataFrame([(0, "aa bb cc dd ee ff gg hh ii jj")], "doc_id long, text string")
    assert [(r["tok_lo"], r["tok_hi"]) for r in C.fixed_chunks(docs, 4, 2).orderBy("chunk_idx").collect()] == [(0, 3), (2, 5), (4, 7), (6, 9)]
    with pytest.raises(ValueError):
        C.fixed_chunks(docs, 4, 4)


def test_sentence_overlap_repeats_the_tail():
    assert C.pack_with_overlap([1, 1, 1, 1, 1], 10, 1) == [(0, 4), (4, 4)]
    assert C.pack_with_overlap([3, 12, 2], 5, 0) == [(0, 2), (3, 7), (8, 12), (13, 14), (15, 16)]


def test_semantic_breaks_are_strict(spark):
    rows = [(0, k, 3, e) for k, e in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])] + [(1, 0, 3, [1.0, 0.0])] + [(2, k, 3, [1.0, 0.0]) for k in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, sent_idx int, n_tokens int, embedding array<double>")
    got = {(r["doc_id"], r["sent_idx"]): r["breaks"] for r in C.semantic_breaks(table).collect()}
    assert [got[0, k] for k in range(4)] == [False, False, True, False]
    assert not any(got[2, k] for k in range(4)) and got[1, 0] is False
    chunks = [(r["tok_lo"], r["tok_hi"]) for r in C.semantic_chunks(table, 100).filter("doc_id = 0").orderBy("chunk_idx").collect()]
    assert chunks == [(0, 5), (6, 11)]
    with pytest.raises(ValueError):
        C.semantic_breaks(table, 100.0)


def test_upper_median(spark):
    table = spark.createDataFrame([(1, n) for n in (5, 1, 9, 3)], "size int, n_tokens int")
    r = C.chunk_stats(table, "size").first()
    assert (r["n_chunks"], r["tokens_min"], r["tokens_median"], r["tokens_mean"], r["tokens_max"]) == (4, 1, 5, 4.5, 9)
