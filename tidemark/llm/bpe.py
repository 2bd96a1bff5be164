"""Operator 10: BPE encoding and decoding; long texts by tree concatenation.

A text over leaf_chars is halved until its leaves are short (no cut is inside a special token). All leaves are encoded;
then halves are joined from the bottom up. A join re-encodes a window of tokens around it, growing until the window's
ids agree with the left half's at its start and with the right half's at its end, up to and including a place on each
side where an encoding cannot depend on what lies beyond:
- white space after another character, a special token's end, or the end of a run of letters, digits or marks: a pre-token
  ends there; or
- a token inside a run of letters or of marks that goes on past it on both sides: the run is one pre-token, and there a
  BPE encoding is valid exactly if each two neighbouring tokens are, which agreement on one token shows for the seam.
Where a window over a quarter of the halves has not settled a join, the join stays open and the halves lie side by side;
a text with open joins at the root is encoded whole, the largest window there is. So the ids are the library's, always,
and the work is in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLASS_CHANGE, CONTRACTION, RUN, SPACES, piece_encoder, slices

LEAF_CHARS = 8192
WINDOW_TOKENS = 12
SLICE_BYTES = 2 << 20

_STABLE = re.compile(f"(?<=[^\\s\\u180e])(?=[{SPACES}])|{CLASS_CHANGE}")
_RUN = re.compile(RUN)


def token_bytes(tokenizer) -> list[bytes]:
    """Each id's bytes, of a byte-level tokenizer; an added token stands for its own text."""
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    # Byte-level alphabet: bytes that print stand for themselves, the others follow from 256 on in their order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = [b""] * size
    for text, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = bytes(of[c] for c in text) if all(c in of for c in text) else text.encode()
    return out


class _Places:
    """Where a window's ids are settled, whatever lies beyond the window."""

    def __init__(self, text: str, special: re.Pattern | None):
        size = len(text)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        upto = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        self.upto = upto  # bytes before each character
        self.stable = np.zeros(size + 1, dtype=bool)
        self.stable[[m.start() for m in _STABLE.finditer(text)]] = True
        if special:
            self.stable[[p for m in special.finditer(text) for p in m.span()]] = True
        self.low, self.high = np.full(size + 1, size + 1), np.full(size + 1, -1)  # of each character's run, without its start's and end's margins
        for m in _RUN.finditer(text):
            self.low[m.start() : m.end()], self.high[m.start() : m.end()] = m.start() + CONTRACTION, m.end() - 1

    def settled(self, ends: np.ndarray, starts: np.ndarray, left: bool) -> bool:
        """Whether one of the tokens (byte offsets) ends (left) or starts (right) at a stable place, or lies inside a run."""
        edge = ends if left else starts
        at = np.searchsorted(self.upto, edge)
        if (self.stable[at] & (self.upto[at] == edge)).any():
            return True
        first, last = np.searchsorted(self.upto, starts, "right") - 1, np.searchsorted(self.upto, ends)
        return bool(((self.low[first] <= first) & (last <= self.high[first])).any())


class TreeEncoder:
    """Encodes and decodes with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_TOKENS):
        self.pieces, self.leaf_chars, self.window = piece_encoder(path), leaf_chars, window
        self.bytes = token_bytes(self.pieces.tokenizer)
        self.sizes = np.array([len(x) for x in self.bytes], dtype=np.int64)
        special = [x.content for x in self.pieces.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.joins = self.grown = 0

    def _cuts(self, text: str) -> list[int]:
        """Ends of the leaves of text."""
        if len(text) <= self.leaf_chars:
            return [len(text)]
        whole = [m.span() for m in self.special.finditer(text)] if self.special else []
        out: list[int] = []
        open_ = [(0, len(text))]
        while open_:
            low, high = open_.pop()
            middle = (low + high) // 2
            k = bisect_left(whole, (middle, 0)) - 1
            if k >= 0 and middle < whole[k][1]:
                middle = whole[k][0]
            if high - low <= self.leaf_chars or middle <= low:
                out.append(high)
            else:
                open_ += [(middle, high), (low, middle)]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        leaves: list[str] = []
        cuts = [self._cuts(x or "") for x in texts]
        for text, ends in zip(texts, cuts, strict=True):
            at = 0
            for end in ends:
                leaves.append((text or "")[at:end])
                at = end
        ids, counts = self.pieces.encode(leaves)
        parts = np.split(ids, np.cumsum(counts)[:-1]) if leaves else []
        out, at = [], 0
        for text, ends in zip(texts, cuts, strict=True):
            level = [[part] for part in zip(leaves[at : at + len(ends)], parts[at : at + len(ends)], strict=True)]
            at += len(ends)
            while len(level) > 1:
                level = [level[i] if i + 1 == len(level) else self._join(level[i], level[i + 1]) for i in range(0, len(level), 2)]
            out.append(level[0][0][1] if len(level[0]) == 1 else self._plain(text or ""))
        return out

    def _join(self, left: list[tuple[str, np.ndarray]], right: list[tuple[str, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
        """Two lists of parts as one; where they meet, two parts become one if a window of a quarter of them at most shows how."""
        self.joins += 1
        (a, a_ids), (b, b_ids), size = left[-1], right[0], self.window
        while size == self.window or 4 * size <= max(len(a_ids), len(b_ids)):
            if (found := self._window(a, a_ids, b, b_ids, size)) is not None:
                return [*left[:-1], (a + b, found), *right[1:]]
            size *= 2
            self.grown += 1
        return left + right

    def _plain(self, text: str) -> np.ndarray:
        """The library's ids; nothing of the text is remembered."""
        return np.asarray(self.pieces.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _window(self, a: str, left: np.ndarray, b: str, right: np.ndarray, size: int) -> np.ndarray | None:
        """The joined ids, if a window of about size tokens on each side shows them."""
        l_at, r_to = max(0, len(left) - size), min(len(right), size)
        whole = b"".join(self.bytes[i] for i in left[l_at:].tolist()), b"".join(self.bytes[i] for i in right[:r_to].tolist())
        while whole[0] and l_at and whole[0][0] & 0xC0 == 0x80:  # not inside a character
            l_at -= 1
            whole = self.bytes[left[l_at]] + whole[0], whole[1]
        tail = whole[1]
        while r_to < len(right) and self.bytes[right[r_to]][0] & 0xC0 == 0x80:
            tail += self.bytes[right[r_to]]
            r_to += 1
        try:
            before, after = whole[0].decode(), tail.decode()
        except UnicodeDecodeError:
            return None
        if not a.endswith(before) or not b.startswith(after):
            return None
        text = before + after
        window = self._plain(text)
        l_ids, r_ids = left[l_at:], right[:r_to]
        n = min(len(window), len(l_ids))
        same = window[:n] == l_ids[:n]
        n_left = n if same.all() else int(np.argmin(same))
        n = min(len(window), len(r_ids))
        same = window[len(window) - n :] == r_ids[len(r_ids) - n :]
        n_right = n if same.all() else int(np.argmin(same[::-1]))
        if not (n_left or l_at == 0) or not (n_right or r_to == len(right)):
            return None
        ends = np.cumsum(self.sizes[window])
        places = _Places(text, self.special)
        done = l_at == 0 or places.settled(ends[:n_left], ends[:n_left] - self.sizes[window[:n_left]], True)
        at = len(window) - n_right
        done = done and (r_to == len(right) or places.settled(ends[at:], ends[at:] - self.sizes[window[at:]], False))
        return np.concatenate([left[:l_at], window, right[r_to:]]) if done else None

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD as the library has it."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS, keep_ids: bool = False) -> DataFrame:
    """One row for each of documents(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids and decoded.

    A null text is empty: no ids, the digests of nothing. Rows are independent; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder(tokenizer_path, leaf_chars)
        shown = [str(i) for i in range(len(encoder.bytes))]
        for batch in slices(batches, "text", SLICE_BYTES):
            found = encoder.encode(batch.column(1).to_pylist())
            texts = [encoder.decode(x) for x in found]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(shown.__getitem__, x.tolist())).encode()).hexdigest() for x in found], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.uint32), *found]).astype(np.int32))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
