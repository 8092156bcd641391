"""Token sequences against whole texts encoded one by one."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortwise.llm import token_packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "one two three", "", None, " ", "  two  spaces  ", "line\nbreaks \n\n and\ttabs\t x", "don't we'll 12 345!? ...",
    "naïve café 漢字 漢字 🙂 🙂", "<|endoftext|> not an end <|endoftext|>", " hard  space 　 wide", "a" * 5000,
    "word " * 3000, "x\x1c y \x85 z", "one two three", "trailing ", "  line  sep", "'s 't 'sx ' s",
]


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_parts_give_the_ids_of_whole_texts(whole, monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = token_packing.Encoder(file.read(), 2)
    assert encoder._by_parts
    texts = [t or "" for t in [*TEXTS, *reversed(TEXTS)]]
    monkeypatch.setattr(token_packing, "_REMEMBERED", 20)
    for found in (encoder.encode(texts), [encoder.encode([t])[0] for t in texts]):
        assert [np.frombuffer(x, "<u2").tolist() for x in found] == [whole(t) for t in texts]


def test_latin_words_are_those_of_the_pattern():
    """Every character and pair of unlike ones, against the tokenizer's own cutting."""
    own = Tokenizer.from_file(VOCABULARY).pre_tokenizer
    chars = [c for c in map(chr, range(0x250)) if token_packing._LATIN.fullmatch(c)]
    text = "".join(f"a{c}1{c} {c}!{c}\n" for c in chars) + " ''s't're'vex  \n  y\t z"
    assert token_packing._LATIN.fullmatch(text)
    spans = [span for _, span in own.pre_tokenize_str(text)]
    assert token_packing._WORDS.findall(text) == [text[a:b] for a, b in spans]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(vocabulary):
    path = public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as file:
        encoder = token_packing.Encoder(file.read(), 2)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    assert not encoder._by_parts
    for text in TEXTS:
        got = np.frombuffer(encoder.encode([text or ""])[0], "<u2").tolist()
        assert got == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("length", "parts"), [(8, 1), (8, 5), (1024, 3), (4096, 17)])
def test_every_token_lies_in_one_piece(spark, whole, monkeypatch, length, parts):
    rows = [(i % 15, t, "n", 5) for i, t in enumerate(TEXTS)]  # two ids occur twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, width int").repartition(parts)
    monkeypatch.setattr(token_packing, "_BATCH_BYTES", 4000)
    monkeypatch.setattr(token_packing, "_TEXT_CHARS", 40)
    packed = token_packing.pack_tokens(docs, VOCABULARY, length, end_id=0)
    sequences = sorted(packed.collect())
    assert [s["sequence_id"] for s in sequences] == list(range(len(sequences)))
    assert all(s["n_tokens"] == length for s in sequences[:-1])
    assert all(len(s["ids"]) == 4 * s["n_tokens"] for s in sequences)
    stream = b"".join(s["ids"] for s in sequences)
    got, at = [], 0
    while at < len(stream) // 4:
        ids = np.frombuffer(stream, "<u4", offset=4 * at)
        n = int(np.flatnonzero(ids == 0)[0]) + 1  # "!" has id 0, but no text here holds it apart
        got.append(tuple(ids[:n].tolist()))
        at += n
    pieces = token_packing.pieces_of(packed).collect()
    for s in sequences:
        places = sorted((p["offset"], p["length"]) for p in pieces if p["sequence_id"] == s["sequence_id"])
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
    want = sorted((*whole(t), 0) for t in TEXTS)
    assert sorted(got) == want
    assert sum(p["length"] for p in pieces) == sum(map(len, want))
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["length"] * 4 == len(p["ids"]) and p["start"] + p["length"] <= p["doc_tokens"]
        if p["start"] == 0:
            by_doc.setdefault(p["doc_id"], []).append(b"")
        by_doc[p["doc_id"]][-1] += bytes(p["ids"])
    for i, text in enumerate(TEXTS):
        assert np.array([*whole(text), 0], "<u4").tobytes() in by_doc[i % 15]


def test_null_ids_and_empty_tables(spark, whole):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    pieces = token_packing.pieces_of(token_packing.pack_tokens(docs, VOCABULARY)).collect()
    assert sorted(p["length"] for p in pieces) == [1, 3] and {p["doc_id"] for p in pieces} == {None}
    assert token_packing.pack_tokens(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError, match="not supported"):
        token_packing.pack_tokens(docs.selectExpr("1.5D AS doc_id", "text"), VOCABULARY)


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    tokens = token_packing.tokenized(docs, VOCABULARY)
    plan = token_packing._placed(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(ids" not in plan
