import random
import zlib
from array import array
from unicodedata import category

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoquarry.llm import token_codes, token_counts
from geoquarry.llm.token_text import Encoder, Pieces

from .conftest import rows_of

FILES = (("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped"))


def odd_texts():
    chance = random.Random(3)
    signs = [" ", "\n", "\t", "a", "b", ".", ",", "'s", "1", "é", "́", "日", "<|endoftext|>", "  "]
    return [
        "",
        " ",
        "a" * 3000,
        " " * 2000,
        "x  y\n" * 500,
        "foo\n bar \n\n baz" * 200,
        "<|endoftext|> a <|startoftext|>b " * 100,
        "́ é Å" * 300,
        "日本語テキスト" * 300,
        *("".join(chance.choices(signs, k=2500)) for _ in range(12)),
    ]


@pytest.mark.parametrize(("name", "boundary"), FILES)
def test_chunks_and_pieces_give_the_ids_of_the_whole(name, boundary):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path).encode_batch(odd_texts(), add_special_tokens=False)
    expected = [np.array(e.ids, "<u4").tobytes() for e in whole]
    chunked = Encoder(path, boundary, chunk=300, overlap=30)
    assert chunked.encode(odd_texts()) == expected
    assert chunked.widened > 0
    assert Encoder(path, boundary).encode(odd_texts()) == expected


@pytest.mark.parametrize(("name", "boundary"), FILES)
def test_every_letter_before_a_mark(name, boundary):
    """All letters, digits and marks of Unicode, in shapes in which pieces are cut again."""
    signs = [c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() or category(c)[0] == "M"]
    shapes = ("x {}.", "{}!c\n{}d ok", "y {}e;f{}\ng")
    path = public_tokenizers.path(name)
    tokenizer, encoder = Tokenizer.from_file(path), Encoder(path, boundary)
    for start in range(0, len(signs), 20_000):
        texts = [s.format(*[c] * s.count("{}")) for c in signs[start : start + 20_000] for s in shapes]
        whole = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        found = encoder.encode(texts)
        assert [t for t, e, f in zip(texts, whole, found, strict=True) if np.array(e.ids, "<u4").tobytes() != f] == []


@pytest.mark.parametrize(("name", "boundary"), FILES)
def test_short_texts_next_to_each_other(name, boundary):
    """Texts are cut in one array, so the ends of one must not matter to the next."""
    chance = random.Random(11)
    signs = ["", " ", "\n", "\t", "a", "B", ".", ";", "'s", "1", "é", "\u0301", "\u0130", "\u00a0", "\u3000", "日", "\0"]
    texts = ["".join(chance.choices(signs, k=5)) for _ in range(30_000)]
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    found = Encoder(path, boundary).encode(texts)
    assert [t for t, e, f in zip(texts, whole, found, strict=True) if np.array(e.ids, "<u4").tobytes() != f] == []


def test_counts(spark, make):
    rows = [(k, t) for k, t in enumerate(odd_texts())] + [(1, None), (None, "a b"), (1, "a b"), (1, "a b")]
    found = rows_of(token_counts.count_tokens(make(rows), "word_bpe_49k.json", limit=100, chunk=500, overlap=50))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc, text in rows:
        text = text or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        expected.append((doc, len(text.encode()), n, n > 100, len(text)))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_file_gives_any_token():
    chance = np.random.default_rng(5)
    ids = chance.choice([0, 3, 255, 256, 65_535, 65_536, 2**32 - 1, 50_000], 3000).astype(np.uint32)
    starts = np.array([0, 0, 1700, 3000])
    raw = token_codes.encode_file(ids, [7, None, 9], starts)
    reads = []

    def read(place, size):
        reads.append(size)
        return raw[place : place + size]

    file = token_codes.TokenFile(read)
    assert file.n_tokens == 3000
    reads.clear()
    for at in chance.integers(0, 3000, 200).tolist():
        assert file.token(at) == ids[at]
    assert max(reads) <= 64  # single chunks, directory entries and a block of a bitmap
    assert (file.tokens(511, 1025) == ids[511:1025]).all()
    assert (file.tokens(0, 3000) == ids).all()
    assert len(file.tokens(9, 9)) == 0
    doc_ids, found = file.documents()
    assert doc_ids == [7, None, 9]
    assert found.tolist() == starts.tolist()
    with pytest.raises(IndexError):
        file.tokens(0, 3001)
    with pytest.raises(ValueError, match="token codes"):
        token_codes.TokenFile(lambda place, size: b"x" * size)


def test_file_without_tokens():
    raw = token_codes.encode_file(np.empty(0, np.uint32), [], np.array([0]))
    file = token_codes.TokenFile(lambda place, size: raw[place : place + size])
    assert (file.n_tokens, file.n_docs, len(file.tokens(0, 0))) == (0, 0, 0)


def test_written_files_hold_all_documents_in_order(spark, make, tmp_path):
    texts = odd_texts()
    rows = [(3 * k % 41, t) for k, t in enumerate(texts)] + [(5, None), (None, "null id"), (5, "x"), (5, "x")]
    files = token_codes.write_tokens(
        make(rows).repartition(3), "byte_bpe_50k.json", folder=f"file://{tmp_path}/ids", file_tokens=900
    )
    assert files.count() > 3
    found = sorted(rows_of(token_codes.read_tokens(files)), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((d, n, c) for d, _, n, c in found), key=str) == sorted(expected, key=str)
    one = token_codes.TokenFile.open(files.first()["file"])
    assert one.token(one.n_tokens - 1) == 0


def test_rerun_agrees(spark, make):
    rows = make([(k % 5, f"text {k}") for k in range(40)])
    once, twice = (
        sorted(rows_of(token_codes.read_tokens(token_codes.write_tokens(d, "byte_bpe_50k.json"))), key=str)
        for d in (rows, rows.repartition(7))
    )
    assert once == twice


def test_known_pieces_are_not_looked_up_again():
    """Pieces of this generation and of the last one are kept, in the order they are asked for."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, asked = Pieces(tokenizer, True), []
    encode = pieces._encode
    pieces._encode = lambda some, together: (asked.extend(some), encode(some, together))
    first, second = [" one", "two,", " drei"], [" drei", " \u00e9t\u00e9", " one", "\n"]
    for some in (first, second, second[::-1]):
        found = pieces.ids_of(some)
        assert found == [array("I", tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in some]
    pieces.last = dict(pieces)
    pieces.clear()
    assert pieces.ids_of(["two,", " new"])[0] == pieces.last["two,"]
    assert sorted(asked) == sorted({*first, *second, " new"})
