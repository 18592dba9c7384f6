"""SentencePiece byte-pair encoding through a prefix table, and decoding.

For every prefix of a piece of text there is one token that its encoding ends with. An automaton over all tokens lists, for every
place, the tokens that end there, longest first; the one that belongs in the table is the one whose start is compatible with the
token of the prefix before it: the pair, encoded alone, stays that pair. Reading the table backwards from the end gives the ids.

Merging never crosses two neighbouring characters that no token holds side by side, so a text falls into parts that are encoded
independently (a word with the space before it, a comma, a line end, which has no token and becomes bytes); a task encodes each
distinct part once. Tokens of several spaces have the lowest score, all the same: spaces join last and from the left.

Defined cases: a null text is empty; an empty text has the end id only and decodes to an empty text; rows are independent,
so repeated rows and ids give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .tables import keyed, named_id
from .units import Memo, text_chunks

MODEL = "piece_bpe_32k.model"
MARK = "▁"


class PrefixTable:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.end = sp.eos_id()
        self.ids, self.score, self.bytes_of, self.byte_id = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        pieces = [self.bytes_of.get(i, b"") for i in range(sp.get_piece_size())]
        self.sizes = np.array([len(p) for p in pieces], np.int64), np.frombuffer(b"".join(pieces), np.uint8)
        self.spaces = {len(p) for p in self.ids if set(p) == {MARK}}
        self.piece = {i: p for p, i in self.ids.items()}
        self.tokens = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if set(piece) != {MARK} or len(piece) == 1:
                self.tokens.add_word(piece, (len(piece), i))
        self.tokens.make_automaton()
        self.stays: dict[int, bool] = {}
        #: bytes between which a text may be cut: two ASCII characters that no token holds side by side
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        self.apart[128:, 32] = not any(a != MARK == b for piece in self.ids for a, b in zip(piece, piece[1:]))
        for piece in self.ids:
            for pair in zip(piece.replace(MARK, " "), piece[1:].replace(MARK, " ")):
                if max(pair) < "\x80":
                    self.apart[ord(pair[0]), ord(pair[1])] = False

    def merged(self, text: str) -> list[str]:
        """Plain merging: the neighbours with the best score join first, the leftmost on ties."""
        parts = list(text)
        while True:
            best = None
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = s, i
            if best is None:
                return parts
            i = best[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pair of tokens, encoded alone, stays the pair (left 0: whether the token stays itself)."""
        pair = [self.piece[left], self.piece[right]] if left else [self.piece[right]]
        return self.merged("".join(pair)) == pair

    def space_run(self, n: int) -> list[int]:
        """Ids of n spaces: they join from the left while a longer token of spaces exists."""
        done: list[int] = []
        for _ in range(n):
            done.append(1)
            while len(done) > 1 and done[-1] + done[-2] in self.spaces:
                done[-2:] = [done[-1] + done[-2]]
        return [self.ids[MARK * k] for k in done]

    def core(self, text: str) -> list[int]:
        """Ids of a text without unknown characters and with a space mark at its start at most."""
        last = [0] + [-1] * len(text)
        stays = self.stays
        for stop, (n, token) in self.tokens.iter(text):
            if last[stop + 1] < 0:
                left = last[stop + 1 - n]
                if left >= 0:
                    pair = left << 32 | token
                    ok = stays.get(pair)
                    if ok is None:
                        ok = stays[pair] = self.compatible(left, token)
                    if ok:
                        last[stop + 1] = token
        out, at = [], len(text)
        while at > 0:
            out.append(last[at])
            at -= len(self.piece[last[at]])
        return out[::-1]

    def stretch(self, text: str) -> list[int]:
        if text[0] != MARK:
            return self.core(text)
        body = text.lstrip(MARK)
        spaces = len(text) - len(body)
        if not body:
            return self.space_run(spaces)
        ids = self.core(MARK + body)
        if spaces == 1:
            return ids
        if ids[0] == self.ids[MARK]:
            return self.space_run(spaces) + ids[1:]
        return self.space_run(spaces - 1) + ids

    def part(self, raw: bytes) -> list[int]:
        """Ids of a part of a text."""
        text = raw.decode("utf-8", "replace").replace(" ", MARK)
        known = self.ids
        if all(c in known for c in text):
            return self.stretch(text) if text else []
        out, begin = [], 0
        for i, c in enumerate(text):
            if c not in known:
                if i > begin:
                    out += self.stretch(text[begin:i])
                out += [self.byte_id[b] for b in c.encode()]
                begin = i + 1
        return out + self.stretch(text[begin:]) if begin < len(text) else out

    def answers(self, parts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of many parts, each with their numbers."""
        ids = [self.part(p) for p in parts]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        size, every = self.sizes
        bounds = np.concatenate([[0], np.cumsum(size)])
        per = np.concatenate([[0], np.cumsum(size[flat])])
        ends = np.concatenate([[0], np.cumsum(lens)])
        return [(flat, lens), (A.gather(every, bounds[flat], size[flat]), np.diff(per[ends]))]

    def decode(self, ids) -> bytes:
        """Bytes of ids, the leading space included; control ids say nothing."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids)


_READY: dict[int, tuple[PrefixTable, Memo]] = {}


def _of(model: bytes) -> tuple[PrefixTable, Memo]:
    key = hash(model)
    if key not in _READY:
        table = PrefixTable(model)
        _READY[key] = table, Memo(table.answers, ["<i4", "u1"])
    return _READY[key]


def encode_chunk(text: pa.Array, table: PrefixTable, memo: Memo) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Ids of all texts (end ids included), offsets by text, decoded texts."""
    text = pc.fill_null(text, "")
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, " ")
    raw, off = A.column_bytes(text)
    full = np.diff(off) > 0
    buf = np.insert(raw, off[:-1][full], 32)
    off = off + np.concatenate([[0], np.cumsum(full)])
    inner = np.flatnonzero(table.apart[buf[:-1], buf[1:]]) + 1
    cut = np.unique(np.concatenate([off, inner]))
    ids, plain = memo.answers(A.from_bytes(buf, cut))
    first = np.searchsorted(cut, off)
    ioff, doff = ids.ends[first], plain.ends[first]
    tokens = np.insert(ids.gather(), ioff[1:], table.end)
    data = plain.gather()
    keep = np.ones(len(data), bool)
    keep[doff[:-1][full]] = False  # the space that every text is given at its start
    decoded = A.from_bytes(data[keep], doff - np.concatenate([[0], np.cumsum(full)]), pa.large_string())
    return tokens, ioff + np.arange(len(ioff)), decoded


def sentencepiece_encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: the id, ids (the end id last), decoded (what the ids say)."""
    with open(model_path or public_tokenizers.path(MODEL), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, memo = _of(model)
        for batch, text in text_chunks(batches, limit=1 << 20):
            tokens, off, decoded = encode_chunk(text, table, memo)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tokens)), decoded.cast(pa.string())], ["key", "ids", "decoded"])

    out = keyed(docs, id_col, text_col).mapInArrow(run, "key long, ids array<int>, decoded string")
    return out.select(named_id().alias(id_col), "ids", "decoded")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = sentencepiece_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
