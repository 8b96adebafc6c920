"""Encoding of a corpus with a byte-level BPE vocabulary, as a streaming transducer.

The encoder reads text block by block and emits ids once no later text can change them:

* A match of the splitting pattern is final when it ends ``MARGIN`` characters before the block's end; the
  pattern looks ahead one character behind white space and its longest contraction has three.
* Every match, short or longer than many blocks, is fed to ``BytePairStream``: after each byte it
  knows the last token of the encoding of the bytes so far. By the compatibility property of BPE that
  token is the only one whose pair with the token before it encodes to itself. The merge list's sufficient
  lookahead is the length of its longest token: every later token starts within it, so a boundary that all states of
  that window descend from is final, and everything before it is emitted and forgotten. A match that runs on through whole
  blocks (one long word, one long gap) is fed as it arrives.

Memory is bounded by the block, the window and the capped memo of words, whatever the text's length. The memo keeps what the
stream gave for a word; its size changes no id.
"""

from __future__ import annotations

import ast
import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("VEDOMOST_TOKENIZERS", "/opt/tokenizers")
BLOCK = 1 << 16
MARGIN = 3
MEMO = 200_000
MEMO_BYTES = 256


@cache
def splitting_pattern(directory: str = TOKENIZER_DIR) -> regex.Pattern:
    """The pattern stated beside the vocabulary files."""
    with open(os.path.join(directory, "__init__.py"), encoding="utf-8") as f:
        stated = next(x for x in f if x.startswith("PATTERN")).partition("=")[2]
    return regex.compile(ast.literal_eval(stated.strip()))


@cache
def merge_ranks(name: str, directory: str = TOKENIZER_DIR) -> dict[bytes, int]:
    with open(os.path.join(directory, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _sizes_by_tail(name: str, directory: str) -> dict[bytes, tuple[int, ...]]:
    """The lengths of the tokens that end in given two bytes, longest first; the state machine tries no others."""
    sizes: dict[bytes, set[int]] = {}
    for token in merge_ranks(name, directory):
        if len(token) > 1:
            sizes.setdefault(token[-2:], set()).add(len(token))
    return {tail: tuple(sorted(found, reverse=True)) for tail, found in sizes.items()}


class BytePairStream:
    """The BPE of one unbroken run of bytes, fed piecewise."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR):
        self.ranks, self.sizes = merge_ranks(name, directory), _sizes_by_tail(name, directory)
        self.lookahead = max(map(len, self.ranks))
        self.compatible = lru_cache(MEMO)(self._compatible)
        self.reset()

    def reset(self) -> None:
        self.data = b""
        self.last: list[int] = [0]  # length of the last token of the encoding of data[:i]

    def bpe(self, piece: bytes) -> list[bytes]:
        """Plain merging by rank, of two tokens at most."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: bytes, b: bytes) -> bool:
        return a + b not in self.ranks and self.bpe(a + b) == [a, b]

    def feed(self, piece: bytes) -> list[int]:
        """Takes bytes; returns the ids that became final."""
        out: list[int] = []
        step = 8 * self.lookahead
        for at in range(0, len(piece), step):
            self._advance(piece[at : at + step])
            if len(self.data) >= step:
                out += self._emit()
        return out

    def _advance(self, piece: bytes) -> None:
        first, data, last, ranks, compatible, sizes = len(self.data), self.data + piece, self.last, self.ranks, self.compatible, self.sizes
        self.data = data
        for i in range(first + 1, len(data) + 1):
            for size in sizes.get(data[i - 2 : i], ()) if i > 1 else ():
                start = i - size
                if start < 0 or (token := data[start:i]) not in ranks:
                    continue
                if start == 0 or compatible(data[start - last[start] : start], token):
                    last.append(size)
                    break
            else:
                last.append(1)

    def _emit(self) -> list[int]:
        """Emits up to the boundary that all states of the last window descend from."""
        n = len(self.data)
        heads = set(range(n - self.lookahead, n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(top - self.last[top])
        common = heads.pop()
        out = self._tokens(common)
        self.data = self.data[common:]
        self.last = [0, *self.last[common + 1 :]]
        return out

    def _tokens(self, end: int) -> list[int]:
        out = []
        while end > 0:
            start = end - self.last[end]
            out.append(self.ranks[self.data[start:end]])
            end = start
        return out[::-1]

    def close(self) -> list[int]:
        out = self._tokens(len(self.data))
        self.reset()
        return out


class StreamingEncoder:
    """Text in blocks to ids; one instance encodes one text after the other."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR, block: int = BLOCK):
        self.pattern, self.block = splitting_pattern(directory), max(block, 2 * MARGIN + 2)
        self.run = BytePairStream(name, directory)
        self.memo: dict[str, tuple[int, ...]] = {}

    def word(self, piece: str) -> tuple[int, ...]:
        """The ids of a complete match, from the stream or the memo of what it gave."""
        ids = self.memo.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            ids = tuple(self.run.feed(raw) + self.run.close())
            if len(raw) <= MEMO_BYTES:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text, block by block."""
        return [i for part in self.stream(text[j : j + self.block] for j in range(0, len(text), self.block)) for i in part]

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Yields final ids as blocks arrive."""
        held, going = "", None  # going: the class of a run that is open in self.run
        for block in blocks:
            held += block
            out: list[int] = []
            if going:
                held, done = self._continue(held, going, out)
                going = None if done else going
            if not going:
                at, final, known = 0, len(held) - MARGIN, self.memo.get
                for m in self.pattern.finditer(held):
                    if m.end() > final:
                        break
                    out += known(m[0]) or self.word(m[0])
                    at = m.end()
                held = held[at:]
                if (m := self.pattern.match(held)) and m.end() > self.block // 2 and (kind := self._kind(m[0])):
                    going = kind
                    held, _ = self._continue(held, going, out, first=True)
            yield out
        out = []
        if going:
            keep, _ = self._continue(held, going, out, last=True)
            held = keep
        for piece in self.pattern.findall(held):
            out += self.word(piece)
        yield out

    @staticmethod
    def _kind(piece: str) -> str | None:
        """The character class that a long match goes on in."""
        body = piece[1] if piece[0] == " " and not piece.isspace() else piece[0]
        return r"\p{L}" if regex.match(r"\p{L}", body) else r"\p{N}" if regex.match(r"\p{N}", body) else r"\s" if regex.match(r"\s", body) else r"[^\s\p{L}\p{N}]"

    def _continue(self, held: str, kind: str, out: list[int], first: bool = False, last: bool = False) -> tuple[str, bool]:
        """Feeds the open run; returns what is left and whether the run ended."""
        m = regex.compile(("[ ]?" if first and kind != r"\s" else "") + f"(?:{kind})*").match(held)
        end, ended = m.end(), m.end() < len(held) or last
        if kind == r"\s":  # white space before a visible character leaves its last character to the next piece
            end = end if last and end == len(held) else max(0, end - 1)
        if ended and not first and kind == r"\s" and m.end() < len(held) and end == 0 and not self.run.data:
            end = m.end()
        out += self.run.feed(held[:end].encode("utf-8"))
        if ended:
            out += self.run.close()
        return held[end:], ended


class StreamingDecoder:
    """Ids to text, one id at a time; bytes of an unfinished character wait for the next id."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR):
        self.words = {i: b for b, i in merge_ranks(name, directory).items()}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := state.decode(self.words[int(i)]):
                yield text
        if text := state.decode(b"", final=True):
            yield text

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


@cache
def _encoder(name: str, directory: str) -> StreamingEncoder:
    return StreamingEncoder(name, directory)


def encode_column(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR):
    """A column function: text to ``array<int>``; NULL and empty text give an empty array."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encoder = _encoder(name, directory)
        for texts in batches:
            yield pd.Series([np.array(encoder.encode(t) if t else [], dtype="int32") for t in texts.array], dtype="object")

    return encode


def count_column(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR):
    """A column function: text to its number of tokens; NULL and empty text have 0."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(name, directory)
        for texts in batches:
            yield pd.Series([len(encoder.encode(t)) if t else 0 for t in texts.array], dtype="int32")

    return count


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id, ids)``, one row per row of documents; repeated rows stay. Special-token strings are ordinary text."""
    return documents.select("doc_id", encode_column(name, directory)("text").alias("ids"))


def decode_ids(encoded: DataFrame, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id, text)`` back from ``encode_documents``; NULL comes back as an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = StreamingDecoder(name, directory)
        for rows in batches:
            yield pd.Series([decoder.decode(ids) for ids in rows.array], dtype="object")

    return encoded.select("doc_id", decode("ids").alias("text"))
