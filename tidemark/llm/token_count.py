"""Operator 5: exact token counts, huge documents by overlap resynchronisation.

A document over chunk_chars is cut into overlapping chunks; all are encoded with offsets. Two neighbours are spliced at
a stable place of their overlap, where both encodings have the same token boundary and it cannot depend on what was cut
off:
- white space, a special token's end, or the end of a run of letters, digits or marks, whatever stands around: a pre-token
  always ends there;
- inside a run of letters or of marks, a token that both encodings have there: a BPE encoding of a pre-token is valid
  exactly if each two neighbouring tokens are, and the shared token shows that for the seam.
Where an overlap has no such place, it is widened: a bridge around it, twofold longer each time, is spliced with both
sides. Chunks that no bridge joins are encoded as one. So the work is in proportion to the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CLASS_CHANGE, CONTRACTION, DIGITS, RUN, SPACES, slices, tokenizer

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
SLICE_BYTES = 2 << 20

#: What is stable in files that drop white space and take digits one by one, and in byte-level files.
_DROPS_SPACE = re.compile(f"(?<=[{SPACES}])(?=\\S)|(?<=[{DIGITS}])(?=[{DIGITS}])|{CLASS_CHANGE}")
_BYTE_LEVEL = re.compile(f"(?<=[^\\s\\u180e])(?=[{SPACES}])|{CLASS_CHANGE}")
_RUN = re.compile(RUN)
#: A text that tells the kinds of files apart, and its pre-tokens.
_PROBE = "ab'st 12.-x\n y"
_PROBED = {("ab", "'s", "t", "1", "2", ".-", "x", "y"): _DROPS_SPACE, ("ab", "'s", "t", "Ġ12", ".-", "x", "Ċ", "Ġy"): _BYTE_LEVEL}


class Part(NamedTuple):
    """text[start:end] and its encoding."""

    start: int
    end: int
    encoding: object

    def token_at(self, place: int) -> int | None:
        """Index of the token that starts at a place of the text, if one does."""
        if not self.start <= place < self.end:
            return None
        char = place - self.start
        token = self.encoding.char_to_token(char)
        if token is None or self.encoding.token_to_chars(token)[0] != char:
            return None
        return token if not token or self.encoding.token_to_chars(token - 1)[1] <= char else None


class Counter:
    """Counts tokens with a file of the tokenizers library."""

    def __init__(self, made):
        self.made = made
        probed = made.pre_tokenizer.pre_tokenize_str(_PROBE) if made.pre_tokenizer else []
        self.stable = _PROBED.get(tuple(x for x, _ in probed))
        special = [x.content for x in made.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _parts(self, text: str, spans: list[tuple[int, int]]) -> list[Part]:
        found = self.made.encode_batch([text[s:e] for s, e in spans], add_special_tokens=False)
        return [Part(s, e, x) for (s, e), x in zip(spans, found, strict=True)]

    def _seam(self, text: str, left: Part, right: Part, whole: list[tuple[int, int]]) -> tuple[int, int] | None:
        """Tokens of left before, and of right before, the stable place nearest the middle of their overlap."""
        low, high = right.start, left.end
        middle = (low + high) // 2
        places = {m.start() for m in self.stable.finditer(text, low, high)}
        places.update(p for span in whole[bisect_left(whole, (low, 0)) : bisect_left(whole, (high, 0))] for p in span)
        for p in sorted((p for p in places if low < p < high), key=lambda p: abs(p - middle)):
            a, b = left.token_at(p), right.token_at(p)
            if a is not None and b is not None:
                return a, b
        for run in _RUN.finditer(text, low, high):
            for p in range(run.start() + CONTRACTION, run.end() - 1):
                a, b = left.token_at(p), right.token_at(p)
                if a is None or b is None or left.encoding.ids[a] != right.encoding.ids[b]:
                    continue
                to = left.encoding.token_to_chars(a)[1] + left.start
                if to < run.end() and to == right.encoding.token_to_chars(b)[1] + right.start:
                    return a + 1, b + 1
        return None

    def _bridge(self, text: str, left: Part, right: Part, most: int, whole: list[tuple[int, int]], before: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """The seams of two with a part around their overlap, the first not under `before` tokens of left."""
        wide = left.end - right.start
        while wide <= most:
            span = _clear(max(left.start, right.start - wide), min(right.end, left.end + wide), whole)
            between = self._parts(text, [span])[0]
            a, b = self._seam(text, left, between, whole), self._seam(text, between, right, whole)
            if a and b and a[1] <= b[0] and before <= a[0]:
                return a, b
            wide *= 2
        return None

    def count(self, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        """Tokens of text."""
        if len(text) <= chunk + overlap or self.stable is None:
            return len(self.made.encode(text, add_special_tokens=False).ids)
        whole = [m.span() for m in self.special.finditer(text)] if self.special else []  # no chunk begins or ends inside a special token
        spans = [_clear(s, min(len(text), s + chunk + overlap), whole) for s in range(0, len(text), chunk)]
        parts = self._parts(text, spans)
        while True:
            total, before, open_ = 0, 0, []
            for k, (left, right) in enumerate(zip(parts, parts[1:], strict=False)):
                if (seam := self._seam(text, left, right, whole)) and seam[0] >= before:
                    total, before = total + seam[0] - before, seam[1]
                elif found := self._bridge(text, left, right, (chunk - overlap) // 2, whole, before):
                    a, b = found
                    total, before = total + a[0] - before + b[0] - a[1], b[1]
                else:
                    open_.append(k)
            if not open_:
                return total + len(parts[-1].encoding.ids) - before
            parts = self._joined(text, parts, set(open_))

    def _joined(self, text: str, parts: list[Part], open_: set[int]) -> list[Part]:
        """The parts, those joined by the open seams (k: after part k) encoded as one."""
        out, k = [], 0
        while k < len(parts):
            first = k
            while k in open_:
                k += 1
            out += [parts[k]] if first == k else self._parts(text, [(parts[first].start, parts[k].end)])
            k += 1
        return out


def _clear(start: int, end: int, whole: list[tuple[int, int]]) -> tuple[int, int]:
    """The span, widened to hold what it cuts of the spans in whole."""
    k = bisect_left(whole, (start, 0)) - 1
    if k >= 0 and start < whole[k][1]:
        start = whole[k][0]
    k = bisect_left(whole, (end, 0)) - 1
    return start, max(end, whole[k][1]) if k >= 0 else end


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(tokenizer(path))
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """One row for each of documents(doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: no bytes, no tokens. Rows are independent; repeated ones give repeated rows and other
    columns are not read. Files whose pre-tokens are of neither known kind have their texts encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(tokenizer_path)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            counts = np.zeros(len(texts), dtype=np.int64)
            plain = [k for k, x in enumerate(texts) if len(x) <= chunk + overlap]
            counts[plain] = [len(x) for x in counts_of.made.encode_batch_fast([texts[k] for k in plain], add_special_tokens=False)]
            for k, x in enumerate(texts):
                if len(x) > chunk + overlap:
                    counts[k] = counts_of.count(x, chunk, overlap)
            sizes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
