"""Token ids as directly addressable codes.

Documents are dealt by ranges of the id, sorted, encoded and written as images. An image holds the ids of some whole documents:
each id is split into chunks of `bits` bits, the lowest first. Level 1 has the first chunk of all ids and a bitmap that says which
ids go on; level 2 has the second chunk of those that go on, and so forth. A rank directory (ones before each 512 bits)
leads from a place in one level to its place in the next, so any token is read without its neighbours.

Layout, little-endian: magic `DAC1`; documents and tokens (8 bytes each); bits and levels (4 each); tokens of the file before
this image (8); document keys (8 each); token offsets (8 each, one more); then for each level: length (8), chunks (1 or 2
bytes each), bitmap (bits in little order, padded to 64), directory (8 bytes for each 512 bits, one more). Images are rows of a
Parquet folder (file, place, image), so that any store that Spark reads can hold them and a repeated task leaves no second copy.
Each image is a file of its own: Spark counts 4 MB for opening one, so a reading task, whose rows travel to Python as one
batch, gets some 20 images at most and not 128 MB of them.

Defined cases: a null text is empty and has the end id only; a null id sorts after all others; repeated ids keep all
their rows, ordered by text; other columns are ignored; an empty table gives an empty folder.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from ..session import shared_table_path
from . import arrays as A
from .tables import keyed, named_id, text_bytes
from .units import Memo, text_chunks

VOCABULARY = "word_bpe_49k.json"
END = 1
MAGIC = b"DAC1"
STRIDE = 512
IMAGE_TOKENS = 1 << 20
FILE_BYTES = 24 << 20


def write_levels(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bitmap (64-bit words) and rank directory of each level."""
    kind = np.uint8 if bits <= 8 else np.uint16
    rest, out = ids.astype(np.uint64), []
    while True:
        chunk = (rest & np.uint64((1 << bits) - 1)).astype(kind)
        rest = rest >> np.uint64(bits)
        on = rest > 0
        padded = np.zeros(ceil(len(on) / STRIDE) * STRIDE, np.uint8)
        padded[: len(on)] = on
        words = np.packbits(padded, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).reshape(-1, STRIDE // 64).sum(1, dtype=np.int64))]).astype("<i8")
        out.append((chunk, words, ranks))
        rest = rest[on]
        if not len(rest):
            return out


def write_image(key: np.ndarray, off: np.ndarray, ids: np.ndarray, before: int, bits: int = 8) -> bytes:
    levels = write_levels(ids, bits)
    parts = [MAGIC, np.array([len(key), len(ids)], "<i8").tobytes(), np.array([bits, len(levels)], "<i4").tobytes(), np.array([before], "<i8").tobytes(),
             key.astype("<i8").tobytes(), off.astype("<i8").tobytes()]
    for chunk, words, ranks in levels:
        parts += [np.array([len(chunk)], "<i8").tobytes(), chunk.tobytes(), words.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Image:
    """Reader of one image."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not an image of token codes")
        docs, self.tokens = (int(x) for x in np.frombuffer(raw, "<i8", 2, 4))
        self.bits, levels = (int(x) for x in np.frombuffer(raw, "<i4", 2, 20))
        self.before = int(np.frombuffer(raw, "<i8", 1, 28)[0])
        at = 36
        self.key = np.frombuffer(raw, "<i8", docs, at)
        at += 8 * docs
        self.off = np.frombuffer(raw, "<i8", docs + 1, at)
        at += 8 * (docs + 1)
        kind = np.dtype("u1" if self.bits <= 8 else "<u2")
        self.levels = []
        for _ in range(levels):
            n = int(np.frombuffer(raw, "<i8", 1, at)[0])
            at += 8
            chunk = np.frombuffer(raw, kind, n, at)
            at += n * kind.itemsize
            blocks = ceil(n / STRIDE)
            words = np.frombuffer(raw, "<u8", blocks * STRIDE // 64, at)
            at += words.nbytes
            ranks = np.frombuffer(raw, "<i8", blocks + 1, at)
            at += ranks.nbytes
            self.levels.append((chunk, words, ranks))

    def token(self, i: int) -> int:
        """The id at one place."""
        out = 0
        for level, (chunk, words, ranks) in enumerate(self.levels):
            out |= int(chunk[i]) << (self.bits * level)
            word, bit = divmod(i, 64)
            if not (int(words[word]) >> bit) & 1:
                break
            block = i // STRIDE
            first = block * (STRIDE // 64)
            i = int(ranks[block]) + int(np.bitwise_count(words[first:word]).sum()) + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.tokens, np.uint32)
        where = np.arange(self.tokens)
        for level, (chunk, words, _) in enumerate(self.levels):
            out[where] |= chunk.astype(np.uint32) << np.uint32(self.bits * level)
            where = where[np.unpackbits(words.view(np.uint8), bitorder="little")[: len(chunk)].astype(bool)]
        return out


_READY: dict[int, Memo] = {}
#: words of small letters of Latin-1 in UTF-8: one piece, which normalizer and regex leave as it is
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _letters_only(vocabulary: str) -> tuple[Tokenizer, np.ndarray] | None:
    """The same model without normalizer and regex, for plain words, and which ids end a word. None where the vocabulary does not
    mark the end of a word, or lacks a byte."""
    rules = json.loads(vocabulary)
    model = rules["model"]
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type") != "BPE" or not suffix or model.get("dropout") or not all(c in vocab and c + suffix in vocab for c in ByteLevel.alphabet()):
        return None
    tokenizer = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    tokenizer.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
    return tokenizer, ends


def _encoder(vocabulary: str):
    """Ids of words one after another and their numbers: plain words as one text, all others one by one."""
    tokenizer, letters = Tokenizer.from_str(vocabulary), _letters_only(vocabulary)

    def whole(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens

    def encode(words: list[bytes]):
        plain = np.fromiter((_PLAIN(w) is not None for w in words), bool, len(words))
        if letters is None or not plain.any():
            return [whole(words)]
        lines, ends = letters
        first = np.array(lines.encode_batch_fast([b" ".join([w for w, p in zip(words, plain) if p]).decode()], add_special_tokens=False)[0].ids, np.uint32)
        other, counts = whole([w for w, p in zip(words, plain) if not p])
        lens = np.empty(len(words), np.int64)
        lens[plain] = np.diff(np.flatnonzero(ends[first]), prepend=-1)
        lens[~plain] = counts
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(lens[order]) - lens[order]
        return [(A.gather(np.concatenate([first, other]), start, lens), lens)]
    return encode


def _memo(vocabulary: str) -> Memo:
    key = hash(vocabulary)
    if key not in _READY:
        _READY[key] = Memo(_encoder(vocabulary), ["<u4"])
    return _READY[key]


#: a letter, then one of these: the tokenizer parts there anyway (marks that special tokens hold are not among them)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: last byte of a letter that begins with 0xC3: all of them but the signs of times and division
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?#*$%&"]] = True


def encode_chunk(text: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id, and offsets by text.

    The tokenizer drops white space and nothing it does crosses it; it folds case, and parts letters from other marks. So words
    are encoded apart, and letters apart from the marks after them, unless the chunk might hold a special token."""
    buf, off = A.column_bytes(pc.fill_null(text, ""))
    w = A.Words(buf, off)
    start, end, first = w.start, w.end, w.first
    special = (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
    if not special.any():
        inner = np.flatnonzero(_LETTER[buf[:-1]] & _STOP[buf[1:]]) + 1
        marks = np.flatnonzero(_LATIN[buf[1:-1]] & _STOP[buf[2:]]) + 2
        inner = np.concatenate([inner, marks[buf[marks - 2] == 0xC3]])
        inner = inner[~np.isin(inner, off)] if len(inner) else inner
        start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        first = np.searchsorted(start, off)
        buf = A.FOLD[buf]
    (ids,) = memo.answers(A.gather_bytes(buf, start, end))
    ends = ids.ends[first]
    return np.insert(ids.gather(), ends[1:], END), ends + np.arange(len(ends))


def write_token_codes(docs: DataFrame, path: str, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", bits: int = 8,
                      image_tokens: int = IMAGE_TOKENS) -> None:
    """Encode all texts and write the images, in ascending order of the id, to a Parquet folder."""
    with open(vocabulary_path or public_tokenizers.path(VOCABULARY)) as f:
        vocabulary = f.read()
    base = keyed(docs, id_col, text_col)
    files = max(1, ceil(text_bytes(base) / FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memo = _memo(vocabulary)
        file, place, before, held = TaskContext.get().partitionId(), 0, 0, []

        def image():
            key, lens, ids = (np.concatenate(x) for x in zip(*held))
            raw = write_image(key, np.concatenate([[0], np.cumsum(lens)]), ids, before, bits)
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "place": pa.array([place], pa.int32()), "tokens": pa.array([len(ids)], pa.int64()), "image": pa.array([raw], pa.binary())}), len(ids)
        for batch, text in text_chunks(batches, limit=1 << 20):
            ids, off = encode_chunk(text, memo)
            held.append((batch.column("key").to_numpy(), np.diff(off), ids))
            if sum(len(x[2]) for x in held) >= image_tokens:
                out, n = image()
                place, before, held = place + 1, before + n, []
                A.release()
                yield out
        if held:
            yield image()[0]
        held.clear()
        A.release()

    dealt = base.repartitionByRange(files, "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(run, "file int, place int, tokens long, image binary").write.option("maxRecordsPerFile", 1).parquet(path)


def read_token_codes(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row for each document, from the images: the id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit numbers)."""
    images = spark.read.parquet(path)
    # one row for each file, and as many files as the writer had partitions
    sums = images.groupBy("file").agg(F.sum("tokens").alias("tokens"))
    sums = sums.select("file", (F.sum("tokens").over(Window.orderBy("file")) - F.col("tokens")).alias("ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ahead in zip(batch.column("image"), batch.column("ahead").to_pylist()):
                image = Image(raw.as_py())
                ids = image.all().astype("<u4")
                for a, b in A.row_chunks(image.off, 1 << 18):
                    off = image.off[a: b + 1]
                    own = A.from_bytes(ids[off[0]: off[-1]].view(np.uint8), 4 * (off - off[0])).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(image.key[a:b]), pa.array(off[:-1] + image.before + ahead), pa.array(np.diff(off)), own], ["key", "start", "n_tokens", "ids"])

    out = images.join(F.broadcast(sums), "file").select("ahead", "image").mapInArrow(run, "key long, start long, n_tokens long, ids binary")
    return out.select(named_id().alias(id_col), "start", "n_tokens", "ids")


def op3_token_codes(spark, sf_dir: str) -> DataFrame:
    path = shared_table_path(spark, "token-codes")
    write_token_codes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
