"""Byte-level BPE against the library, round trips, appends and edits."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gradewise.llm import byte_bpe

ALPHABET = "ab cA1  \n\t\r'st're!?.é中😀\x1c\x1d\x85\xa0​　᠎\x00½Ⅷ٣ªº"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY))


def _random_text(r, longest):
    return "".join(r.choice(ALPHABET) for _ in range(r.randrange(longest)))


def test_ids_equal_the_librarys(codec, library):
    r = random.Random(1)
    texts = [_random_text(r, 40) for _ in range(3000)] + ["", " ", "<|endoftext|>", "a" * 5000, " " * 3000, "=" * 700 + "\n\n\n x"]
    ids, offsets = codec.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode_ordinary(t)
    assert codec.surface.joined(ids, offsets) == [t.encode() for t in texts]


def test_the_table_holds_the_encoding_of_every_prefix(codec, library):
    for word in (" internationalisation", " çeéeuîon", " 中文字", "'" * 9):
        match = word.encode().decode("latin-1")
        starts = codec.forward.starts(match)
        for n in range(1, len(match) + 1):
            tokens = codec.forward.tokens(match[:n], starts[:n + 1])
            assert [codec.ids[t] for t in tokens] == library._encode_single_piece(match[:n].encode("latin-1"))


def test_appends_and_edits_equal_encoding_anew(codec, library):
    r = random.Random(2)
    for _ in range(400):
        text = _random_text(r, 60)
        held = byte_bpe.Encoded(codec, text)
        for _ in range(4):
            put = _random_text(r, 6)
            if r.random() < 0.4:
                text += put
                held.append(put)
            else:
                at = r.randrange(len(text) + 1)
                gone = r.randrange(min(5, len(text) - at) + 1)
                text = text[:at] + put + text[at + gone:]
                held.edit(at, gone, put)
            assert held.text == text
            assert held.ids == library.encode_ordinary(text)


def test_an_append_goes_on_from_the_table(codec):
    held = byte_bpe.Encoded(codec, "some words and interna")
    held.append("tional")
    assert (held.reused, held.filled) == (len(" interna"), len("tional"))
    long = byte_bpe.Encoded(codec, "word " * 2000)
    long.edit(5000, 4, "sword")
    assert long.reused + long.filled < 30


def test_a_small_memory_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    texts = ["one two three four five", "five four three two one", "", "two two six"] * 3
    for t in texts:
        assert codec.encode(t) == library.encode_ordinary(t)


def test_query_cases(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "Hallo Welt,  wie\ngeht's?", 5), (3, "Hallo Welt,  wie\ngeht's?", 5),
            (None, "<|endoftext|>", 5), (4, "x" * 20_000 + " é" * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    got = byte_bpe.digests(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(d), len(i := library.encode_ordinary(t or "")), sha(" ".join(map(str, i)).encode()), sha((t or "").encode()))
                  for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert byte_bpe.digests(docs.limit(0)).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(docs))
    assert sorted((str(r.doc_id), bytes(r.decoded).decode()) for r in back.collect()) == sorted((str(d), t or "") for d, t, _ in rows)


def test_query_on_the_table(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in byte_bpe.op12_byte_bpe(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
