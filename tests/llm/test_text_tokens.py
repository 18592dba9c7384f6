"""Token ids: equal to the libraries', and exact round trips through the file format."""

import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from conftest import SMALL
from tabwright.llm import token_codes
from tabwright.llm.sentencepiece_bpe import op8_sentencepiece, sentencepiece_encode

PARTS = [" ", "  ", "\n", "\t", "a", "the", "▁", "é", "日本", "\U0001f600", "\x00", "-", "12", ".", " ", "　", "<s>", "</s>", "<|endoftext|>", "'s", "İ", "Σ", "ς", "é", "Ａ",
         "\x85", "<0x0A>", "ǅ", "ing", "xyzzy", "___", "====", " " * 21, "WORD,", "word;x", "<|EndOfText|>"]


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(5)
    rows = [(random.choice([None, i, i, i, 7]), random.choice([None, "", " "]) if i % 9 == 0 else "".join(random.choice(PARTS) for _ in range(random.randrange(30))), 1) for i in range(1500)]
    rows += [(9001, " " * n, 1) for n in range(1, 90)] + [(9002, "x" * 3000 + " " * 500 + "\n" * 40, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int")


def codes(rows):
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in sorted(rows, key=lambda r: (brute.LAST if r["doc_id"] is None else r["doc_id"], r["text"] or "")):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        out.append((r["doc_id"], start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return brute.in_order(out)


def test_sentencepiece(spark, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in sentencepiece_encode(odd).collect())
    assert got == Counter((r["doc_id"], (*sp.encode(r["text"] or ""), 2), sp.decode(sp.encode(r["text"] or ""))) for r in odd.collect())
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = [*sp.encode(r["text"] or ""), 2]
        want.append((r["doc_id"], len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(sp.decode(ids).encode()).hexdigest()))
    assert brute.in_order(op8_sentencepiece(spark, SMALL).collect()) == brute.in_order(want)
    assert sentencepiece_encode(odd.limit(0)).count() == 0


def test_token_codes(spark, odd, tmp_path):
    assert brute.in_order(token_codes.op3_token_codes(spark, SMALL).collect()) == codes(spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    path = f"file://{tmp_path}/codes"
    token_codes.write_token_codes(odd, path, image_tokens=500)
    assert brute.in_order(token_codes.read_token_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()) == codes(odd.collect())
    empty = f"file://{tmp_path}/empty"
    token_codes.write_token_codes(odd.limit(0), empty)
    assert token_codes.read_token_codes(spark, empty).count() == 0


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_direct_access(bits):
    ids = np.random.default_rng(0).choice([0, 3, 200, 255, 256, 49_000, 65_535], 3000)
    image = token_codes.Image(token_codes.write_image(np.array([4, 9]), np.array([0, 10, 3000]), ids, 77, bits))
    assert (image.all() == ids).all() and image.before == 77
    assert all(image.token(i) == ids[i] for i in range(0, 3000, 7))


def test_plain_words_as_one_text():
    random.seed(9)
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        vocabulary = f.read()
    letters = [*"abcdefghijklmnopqrstuvwxyz", *"ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", *"ÀÉÜÞẞİŁ÷×µªº1'_|", "e\u0301", "\u0301", "ﬁ", "日"]
    words = ["".join(random.choices(letters, weights=[9] * 26 + [2] * 32 + [1] * (len(letters) - 58), k=random.randrange(1, 14))).encode() for _ in range(4000)]
    words += [b"the", "été".encode(), "é".encode(), b"z"]
    (values, lens), = token_codes._encoder(vocabulary)(words)
    plain = Tokenizer.from_str(vocabulary)
    want = [plain.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert lens.tolist() == [len(x) for x in want] and values.tolist() == [i for x in want for i in x]
    for only in (["été".encode(), b"ab"], [b"12", "É.".encode()]):
        (values, lens), = token_codes._encoder(vocabulary)(only)
        assert values.tolist() == [i for w in only for i in plain.encode(w.decode(), add_special_tokens=False).ids]


def test_marks_after_letters_of_two_bytes():
    import pyarrow as pa
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        vocabulary = f.read()
    texts = ["é.", "chené, pa! É... ÷. ×, é", ".", "é", "", None, "aé", "é.é", "È;ß:ÿ?", "\u00e9\u0301. e\u0301, ñ's"]
    ids, off = token_codes.encode_chunk(pa.array(texts, pa.large_string()), token_codes._memo(vocabulary))
    plain = Tokenizer.from_str(vocabulary)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_a_reading_task_gets_few_images(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} " * 200_000) for i in range(3)], "doc_id long, text string")
    token_codes.write_token_codes(docs, str(tmp_path / "codes"), image_tokens=100)
    images = spark.read.parquet(str(tmp_path / "codes"))
    files = images.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) == images.count() > 1


def test_memo_finds_what_it_encoded():
    import pyarrow as pa
    from tabwright.llm.units import Memo
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))]
    memo = Memo(encode, ["u1"], entries=3)
    for words in (["a", "bb", "a"], ["bb", "cc", ""], ["dd", "a"], ["a", "ee", "bb"], []):
        got, = memo.answers(pa.array([w.encode() for w in words], pa.large_binary()))
        assert got.gather().tobytes() == "".join(words).encode()
    assert asked == [b"a", b"bb", b"cc", b"", b"dd", b"ee"]
