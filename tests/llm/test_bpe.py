"""Encoding and decoding against the tokenizers library, and the forced boundaries themselves."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filigree.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = (
    "a", "e", "th", " ", "'s", "'LL", "\n", "é", "é", "Σ", "ς", "İ", "ß", "日本", "0", "９", "½", "!", "...", "\x1c", "\x85", "　", "<|endoftext|>", "<|startoftext|>", "<|end",
    "\U0001f600", "՘", "Ᲊ", "Ǆ", "ﬁ", "́", "‍", "x" * 30, "aaaa", "̸", "한", "가", "\U00010d50", "\x00", "�",
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(2)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(8)) for _ in range(1000)]
    out += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall() if r[0]]
    return [*out, "", "ab" * 60_000 + " " + "".join(rng.choice("0123456789abcdef") for _ in range(60_000)), "word  \n" * 300_000]


def test_columns_equal_the_library(spark, library):
    texts = _texts()
    want = library.encode_batch(texts, add_special_tokens=False)
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(-1, None, "clash"), (0, texts[0], "again")], "id long, text string, ids string").repartition(5)
    both = df.select("id", bpe.encode(F.col("text"), PATH).alias("packed"), bpe.encode_and_decode(F.col("text"), PATH).alias("b"))
    got = both.select("id", "packed", "b", bpe.n_tokens(F.col("packed")).alias("n"), bpe.decode(F.col("packed"), PATH).alias("back")).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = want[r["id"]].ids if r["id"] >= 0 else []
        assert np.frombuffer(bytes(r["packed"]), "<u4").tolist() == ids, texts[r["id"]][:80]
        assert (r["b"]["ids"], r["b"]["decoded"]) == (r["packed"], r["back"])
        assert r["n"] == len(ids)
        assert r["back"] == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string").select(bpe.encode(F.col("text"), PATH).alias("ids"))
    assert df.select(bpe.decode(F.col("ids"), PATH)).collect() == []


def test_no_token_crosses_a_boundary_and_fragments_are_independent():
    codec = bpe.codec(PATH)
    rng = random.Random(4)
    words = ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(48, 58), 0x65E5, 0xE9])) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    cut = 0
    for w in words:
        whole = w.encode() + b"\n"
        fragments = codec.fragments([w])
        assert b"".join(fragments) == whole
        cut += len(fragments) - 1
        assert codec.merged(whole) == [i for f in fragments for i in codec.merged(f)]
    assert cut > 500  # the boundaries do cut words
    assert codec.fragments(["the", "cat"]) == [b"the\n", b"cat\n"]


def test_table_holds_every_pair_inside_tokens():
    codec = bpe.codec(PATH)
    for token, i in Tokenizer.from_file(PATH).get_vocab(with_added_tokens=False).items():
        assert bpe.decoder(PATH).token[i] == token
    back = {s: b for b, s in enumerate(bpe.byte_symbols())}
    for token in ("ing</w>", "str", "!!!</w>"):
        raw = bytes(back[c] for c in token.removesuffix("</w>")) + b"\n" * token.endswith("</w>")
        assert all(codec.inside[x, y] for x, y in zip(raw, raw[1:], strict=False))
    assert not codec.inside[0x0A].any()


def test_special_strings_and_long_blocks(monkeypatch, library):
    monkeypatch.setattr(bpe, "_BLOCK", 16)
    codec = bpe.Codec(PATH)
    for text in _texts()[:400]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
