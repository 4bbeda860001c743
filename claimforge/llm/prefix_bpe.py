"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding: a token t whose start is a prefix that ends in token p
such that the merges keep the boundary between p and t. One table of last tokens therefore holds the encodings of all
prefixes; appending bytes extends it and leaves what is there, and reading it backwards gives the ids.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from claimforge.llm.common import keyed, read_table, release

NEVER = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a token in base 64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PrefixBPE:
    """Encoder of single pieces; `memory` bounds the pieces whose ids are kept for reuse."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 500_000):
        self.ranks, self.memory = ranks, memory
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.size = list(map(len, self.bytes))
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.suffixes.add_word(token.decode("latin-1"), rank)
        self.suffixes.make_automaton()
        self.split: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _build(self, token: int) -> None:
        """The last merge that makes a token, by merging its bytes; tokens that merging never makes have none."""
        ranks, parts, last = self.ranks, [bytes([b]) for b in self.bytes[token]], None
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.whole[token] = len(parts) == 1
        self.split[token] = (ranks[last[0]], ranks[last[1]]) if len(parts) == 1 and last else None

    def made(self, token: int) -> bool:
        if token not in self.whole:
            self._build(token)
        return self.whole[token]

    def keeps(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again; after the check of token pairs in the `bpe` crate of GitHub's rust-gems.

        Goes back in time: of the two tokens at the boundary the one that was made later is undone. If at some time the
        two that then met make a token that would have been merged before either was used up, the boundary is lost.
        """
        if not (self.made(left) and self.made(right)):
            return False
        ranks, names, split = self.ranks, self.bytes, self.split
        until_left = until_right = NEVER  # ranks of the merges that use up the two
        while True:
            rank = ranks.get(names[left] + names[right], NEVER)
            if rank < until_left and rank <= until_right and rank != NEVER:
                return False
            a, b = split[left], split[right]
            if a and (not b or left > right):
                until_left, left = left, a[1]
                self.made(left)
            elif b:
                until_right, right = right, b[0]
                self.made(right)
            else:
                return True

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Extends the last tokens of the prefixes of a piece (last[i]: of its first i bytes; last[0] = -1) to all of it."""
        pairs, size, put = self.pairs, self.size, last.append
        have = len(last)
        for end, token in self.suffixes.iter(piece.decode("latin-1"), max(0, have - 1 - self.longest)):  # all tokens that end at a byte
            if end + 1 != have:
                continue
            start = have - size[token]
            if start:
                pair = last[start] << 32 | token
                good = pairs.get(pair)
                if good is None:
                    good = self.keeps(last[start], token)
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    pairs[pair] = good
            else:
                good = self.made(token)
            if good:
                put(token)
                have += 1
        if have <= len(piece):
            raise ValueError(f"no token ends the prefix {piece[:have]!r}")
        return last

    def ids(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:  # a piece that is a token is this token
            return [whole]
        return self.read(piece, self.extend(piece, [-1]))

    def read(self, piece: bytes, last: list[int]) -> list[int]:
        """Ids of a piece from its table of last tokens."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out, i = [], len(piece)
        while i:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit numbers, from memory if the piece was met lately."""
        if (out := self.old.pop(piece, None)) is None:
            ids = self.ids(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.young) >= self.memory // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = out
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def forget(self) -> None:
        """Drops what was kept of pieces and pairs, as an idle worker would hold it while other stages need the memory."""
        self.pairs, self.young, self.old = {}, {}, {}


class EditableText:
    """A text with its pieces and their tables of last tokens that follows appends and edits by encoding only near them.

    Pieces cut before a change stay unless the change touches them or what the pattern looks at behind them. A piece that is cut
    anew keeps its table as far as its bytes stay, so an append to a piece is exact and costs its new bytes only. After the change,
    cutting goes on until it falls in step with the old pieces.
    """

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text = bpe, regex.compile(pattern), ""
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        self.fresh = 0  # bytes encoded so far
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces text[start:stop] by new."""
        text = self.text[:start] + new + self.text[stop:]
        at, keep = 0, 0
        # the pattern looks one character ahead and may give white space back, so two pieces before the change are cut anew
        while keep < len(self.pieces) and at + len(self.pieces[keep]) < start:
            at += len(self.pieces[keep])
            keep += 1
        for _ in range(2):
            if keep:
                keep -= 1
                at -= len(self.pieces[keep])
        shift, begins, after, pos = len(text) - len(self.text), {}, {}, at
        for i in range(keep, len(self.pieces)):
            if pos <= start:
                begins[pos] = i
            if pos >= stop:
                after[pos + shift] = i
            pos += len(self.pieces[i])
        pieces, tables, rest = self.pieces[:keep], self.tables[:keep], len(self.pieces)
        for m in self.pattern.finditer(text, at):
            if m.start() in after and m.start() >= start + len(new):
                rest = after[m.start()]
                break
            b, table = m[0].encode(), [-1]
            if (i := begins.get(m.start())) is not None:
                old = self.pieces[i].encode()
                same = next((k for k, (x, y) in enumerate(zip(old, b, strict=False)) if x != y), min(len(old), len(b)))
                table = self.tables[i][: same + 1]
            self.fresh += len(b) + 1 - len(table)
            pieces.append(m[0])
            tables.append(self.bpe.extend(b, table))
        self.pieces, self.tables, self.text = pieces + self.pieces[rest:], tables + self.tables[rest:], text

    def ids(self) -> list[int]:
        return [x for piece, table in zip(self.pieces, self.tables, strict=True) for x in self.bpe.read(piece.encode(), table)]


_BPE: dict[bytes, PrefixBPE] = {}


def _encoder(data: bytes) -> PrefixBPE:
    key = hashlib.sha256(data).digest()
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = PrefixBPE(read_ranks(data))
    return _BPE[key]


def bpe_round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, ids (little-endian unsigned 32-bit numbers) and decoded (bytes decoded from the ids).

    Each match of the pattern is encoded separately, without special tokens. ranks is the content of a tiktoken file, of
    bounded size. Uses doc_id and text only. A null text is empty and has no ids; repeated rows come back as often; text that
    the pattern leaves out is in no piece. The file must have all 256 bytes as tokens.
    """
    if missing := [b for b in range(256) if bytes([b]) not in read_ranks(ranks)]:
        raise ValueError(f"no token for the bytes {missing}")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        bpe, pieces = _encoder(shared.value), regex.compile(pattern).findall
        slow = bpe.packed
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column("text"):
                packed = bpe.young.get
                out = b"".join([packed(p) or slow(p) for p in pieces(text.as_py() or "")])
                ids.append(out)
                decoded.append(bpe.decode(np.frombuffer(out, "<u4").tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])
        bpe.forget()
        release()

    return keyed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op9_prefix_bpe(spark, sf_dir: str, name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    with open(public_tokenizers.path(name), "rb") as f:
        out = bpe_round_trip(read_table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
