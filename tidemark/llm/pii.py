"""Operator 7: personal data by patterns and a linear-chain conditional random field.

Base spans are regular expressions with checks (fixed by the contract below). The model adds spans that they miss: a
linear-chain CRF over word-shape features, trained here on a small labelled table, tags the words of every text and is
decoded by Viterbi in numpy batches. Words without a digit, "@" or "+" can only be outside of a span; that is part of
the model (their other states are masked), so each stretch of other words is a chain of its own and all stretches of a
batch are decoded at once. A tagged span is added if it touches no base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices

KINDS = ("email", "ip", "card", "phone")
SLICE_BYTES = 4 << 20
#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")  # runs of digits are taken whole, so long ones cost no retries
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, leftmost and without overlap; looks only where an @ stands."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans of a text, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


# The model. Words are runs of non-space characters without brackets, quotes and closing marks around them.
_WORD = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*")  # tried once a word, so long ones cost no retries
_SYMBOL = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_ODD = re.compile(r"[^0-9A-Za-z@.+()/:-]")
SHAPE = 24
#: Cells of words that one step of decoding holds at most, words from which a chain is decoded in segments, and those in each.
CELLS, LONG_CHAIN, SEGMENT = 1 << 16, 2048, 512
_OUTER = "\"'<>[]{},;:!?|*#$&=."
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The labelled table: text, with spans as [kind text]. Kept small and readable; the model is trained from it.
LABELLED = (
    "call [phone 555-0134] today", "tel [phone (212) 555-0187] or mail", "fax [phone 212-555-0142] now", "phone [phone 212.555.0199] please", "at [phone 020 7946 0958] daily",
    "ring [phone (020) 7946 0123] soon", "dial [phone 1-800-555-0111] free", "from [phone +1 (377) 555-0271] on", "number [phone +44 20 7946 0018] in", "cell [phone 555-0178] home",
    "card [card 4111 1111 1111 1111] exp 12/26", "visa [card 5500-0000-0000-0004] valid", "pay [card 4012 8888 8888 1881] total", "amex [card 3782 822463 10005] paid 20",
    "at [phone +1 (269) 555-0196] [card 4111111111111111] and", "by [phone +1 (017) 555-0113] [card 5500000000000004] now", "[card 4012888888881881] [phone +1 (578) 555-0137] x", "see [card 378282246310005] paid",
    "to [email a.b@mail7.example.com] [phone +1 (212) 555-0187] or", "[ip 10.0.0.1] [card 6011111111111117] in", "[phone +1 (314) 555-0132] [ip 172.16.4.9] [email x@y.example.com]", "of [phone +1 (487) 555-0109] 4736962973099582 ble", "was 9807915762804491 raie",
    "tel [phone 06 39 98 12 34] svp", "au [phone 02 61 91 45 67] demain", "unter [phone 040 669412] oder", "Telefon [phone 089 555 0123] abends", "the years 1990 1991 and 1992", "in 2008 2009 2010 or 2012 they", "lines 10 20 30 40 and 50",
    "host [ip 10.0.0.1:8080] up", "server [ip 192.168.1.20/24] net", "from [ip 172.16.4.9:22] to", "peer [ip 10.1.2.3/16] ok", "ping [ip 8.8.8.8] done",
    "mail [email ann@mailhost] now", "write [email bob.lee@intranet] soon", "to [email j.doe@localhost] and", "at [email x99@mail7.example.com] by", "ask [email info@server2] first",
    "in 1999 there were 35 of 1200", "on 2024-05-06 at 10:30 we", "version 3.2.1 of 2020 has 1.5 percent", "costs 1,200.50 in 2019", "page 12 of 340 from 1987-1993", "the 3rd of 10 and 4th",
    "id 2390409500648960 was 14", "token 04dbebab91ab85687d33eeaaf9ac699e1188f962 in", "hash f3ef4d6b2755a36d7d9c25bd72c4d5f6 of", "room 101-203 or 7a", "ratio 3-2 and 10-4 at 5", "follow @handle and @name2 here",
    "a + b + c3", "c++ and g++ in 2011", "rfc 2822 section 3.4.1", "isbn 978-3-16-148410-0 in", "range 1000-2000 of 5000-6000", "is 12.5 or 13.75 and 99.99", "on 05/06/2024 from 9am to 5pm", "issue #1234 and 5678",
)


def shape(word: str) -> str:
    """The word with letters as a, digits as 0 and runs shortened to one, two or many (counts 1-2, 3, 4, more for digits).

    A feature, as the end of it is: it tells of a word's first SHAPE symbols only, and the model knows no others.
    """
    out = []
    for run in _SYMBOL.finditer(word):
        if len(out) == SHAPE:
            break
        x = run[0]
        if "0" <= x[0] <= "9":
            n = len(x)
            out.append("0" * min(n, 5) if n < 8 else "L" if n < 12 else "N" if n < 20 else "X")
        else:
            out.append("a" if x[0].isalpha() else x)
    return "".join(out)[:SHAPE]


def _odd(word: str) -> bool:
    return _ODD.search(word) is not None


def is_card_number(word: str) -> bool:
    """12 to 19 digits and nothing else, passing the Luhn check."""
    return 12 <= len(word) <= 19 and word.isascii() and word.isdigit() and luhn(word)


def features(word: str, before: str, after: str) -> list[str]:
    """Features of a word among its neighbours' shapes ("" where a plain word or the text's end stands)."""
    s = shape(word)
    parts = re.findall(r"0+|L|N|X", s)
    return [
        "s=" + s, "b=" + before + ">" + s, "a=" + s + ">" + after, "at" if "@" in word else "no-at", "plus" if word[0] == "+" else "no-plus",
        f"dots={min(s.count('.'), 4)}", f"dashes={min(s.count('-'), 3)}", f"groups={min(len(parts), 5)}", "letters" if "a" in s else "digits", "odd" if _odd(word) else "even", "end=" + s[-4:],
        "luhn" if is_card_number(word) else "no-luhn",
    ]


def words_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words that can be in a span."""
    out = []
    for m in _WORD.finditer(text):
        s, e = m.span()
        while s < e and text[s] in _OUTER:
            s += 1
        while e > s and text[e - 1] in _OUTER:
            e -= 1
        if s < e and any(c in "@+" or "0" <= c <= "9" for c in text[s:e]):
            out.append((s, e))
    return out


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of such words with white space and brackets at most between neighbours."""
    out: list[list[tuple[int, int]]] = []
    for s, e in words_of(text):
        if out and s - out[-1][-1][1] == 1 and text[s - 1] == " ":
            out[-1].append((s, e))
        else:
            out.append([(s, e)])
    return out


def _allowed() -> np.ndarray:
    """May a state follow another: an inside state follows its own kind only."""
    ok = np.ones((len(STATES), len(STATES)), dtype=bool)
    for j, b in enumerate(STATES):
        if b[0] == "I":
            ok[:, j] = [a[2:] == b[2:] for a in STATES]
    return ok


class Crf:
    """A linear-chain CRF: weights by feature and state, and by state and next state."""

    def __init__(self, labelled: tuple[str, ...] = LABELLED, rounds: int = 120, rate: float = 0.5, decay: float = 2e-3):
        rows = [self._parsed(x) for x in labelled]
        names = sorted({f for xs, _ in rows for x in xs for f in x})
        self.index = {f: k for k, f in enumerate(names)}
        n, k = len(names), len(STATES)
        self.emit, self.step = np.zeros((n + 1, k)), np.zeros((k, k))
        self.ok = _allowed()
        self.start_ok = np.array([s[0] != "I" for s in STATES])
        self.memo: dict[tuple, int] = {}
        self.known = np.zeros((1024, k))
        grads = [np.zeros_like(self.emit), np.zeros_like(self.step)]
        squares = [np.full_like(self.emit, 1e-6), np.full_like(self.step, 1e-6)]
        for _ in range(rounds):  # full-batch adaptive gradient ascent of the penalised likelihood
            for g in grads:
                g[:] = 0
            for xs, ys in rows:
                self._gradient([[self.index[f] for f in x] for x in xs], ys, *grads)
            for weights, g, s in zip((self.emit, self.step), grads, squares, strict=True):
                g -= decay * len(rows) * weights
                s += g * g
                weights += rate * g / np.sqrt(s)

    @staticmethod
    def _parsed(row: str) -> tuple[list[list[str]], list[int]]:
        """A labelled row's chains on end are trained as one chain each; returned joined by plain words being dropped."""
        text, spans = "", []
        for part in re.finditer(r"\[(\w+) ([^\]]*)\]|[^\[]+", row):
            if part[1]:
                spans.append((len(text), len(text) + len(part[2]), part[1]))
                text += part[2]
            else:
                text += part[0]
        xs, ys = [], []
        for chain in chains(text):
            shapes = ["", *(shape(text[s:e]) for s, e in chain), ""]
            for k, (s, e) in enumerate(chain):
                xs.append(features(text[s:e], shapes[k], shapes[k + 2]))
                hit = next((x for x in spans if x[0] <= s and e <= x[1]), None)
                ys.append(0 if hit is None else STATES.index(("B-" if s == hit[0] or text[hit[0] : s] in "(\"'" else "I-") + hit[2]))
        return xs, ys

    def _gradient(self, xs: list[list[int]], ys: list[int], emit: np.ndarray, step: np.ndarray) -> None:
        if not xs:
            return
        scores = np.array([self.emit[x].sum(axis=0) for x in xs])
        moves = np.where(self.ok, self.step, -1e9)
        n = len(xs)
        f, b = np.zeros_like(scores), np.zeros_like(scores)
        f[0] = np.where(self.start_ok, scores[0], -1e9)
        for t in range(1, n):
            f[t] = scores[t] + np.logaddexp.reduce(f[t - 1][:, None] + moves, axis=0)
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(moves + (scores[t + 1] + b[t + 1])[None, :], axis=1)
        z = np.logaddexp.reduce(f[-1])
        for t in range(n):
            p = -np.exp(f[t] + b[t] - z)
            p[ys[t]] += 1
            for x in xs[t]:
                emit[x] += p
            if t:
                step -= np.exp(f[t - 1][:, None] + moves + (scores[t] + b[t])[None, :] - z)
                step[ys[t - 1], ys[t]] += 1

    def number(self, word: str, own: str, before: str, after: str) -> int:
        """The row of `known` with the emission scores of a word (own: its shape); words with the same features share it. Unknown features weigh nothing."""
        key = (own, "@" in word, word[0] == "+", _odd(word), is_card_number(word), before, after)
        if (found := self.memo.get(key)) is None:
            found = self.memo[key] = len(self.memo)
            if found == len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[found] = self.emit[[self.index.get(f, len(self.index)) for f in features(word, before, after)]].sum(axis=0)
        return found

    def forget(self) -> None:
        """Between batches: the rows of `known` go when they are many."""
        if len(self.memo) > 50_000:
            self.memo.clear()
            self.known = self.known[:1024].copy()

    def decode(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many chains (each one's rows of `known`), in batches of like lengths and bounded size."""
        out: list = [None] * len(numbers)
        order = sorted(range(len(numbers)), key=lambda k: len(numbers[k]))
        while order and len(numbers[order[-1]]) > LONG_CHAIN:
            k = order.pop()
            out[k] = self._long(numbers[k])
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < len(order) and (upto + 1 - at) * len(numbers[order[upto]]) <= CELLS:
                upto += 1
            part = order[at:upto]
            sizes = np.array([len(numbers[k]) for k in part])
            grid = np.zeros((len(part), int(sizes.max())), dtype=np.int64)
            for row, k in enumerate(part):
                grid[row, : sizes[row]] = numbers[k]
            first = np.where(self.start_ok, self.known[grid[:, 0]], -1e9)
            paths = self._trace(grid, sizes, first, np.full(len(part), -1))
            for row, k in enumerate(part):
                out[k] = paths[row, : sizes[row]]
            at = upto
        return out

    def _trace(self, grid: np.ndarray, sizes: np.ndarray, best: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Best paths of chains in lockstep, from the first word's scores to the last state in final (-1: the best one)."""
        moves = np.where(self.ok, self.step, -1e9)
        rows, longest = grid.shape
        last, back = best.copy(), np.zeros((rows, longest, len(STATES)), dtype=np.int8)
        for t in range(1, longest):
            ways = best[:, :, None] + moves[None]
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + self.known[grid[:, t]]
            on = sizes > t
            last[on] = best[on]
        state = np.where(final >= 0, final, last.argmax(axis=1))
        path = np.zeros((rows, longest), dtype=np.int8)
        for t in range(longest - 1, -1, -1):
            on = t < sizes
            path[on, t] = state[on]
            state = np.where(on & (t > 0), back[np.arange(rows), t, state], state)
        return path

    def _long(self, numbers: np.ndarray) -> np.ndarray:
        """The Viterbi path of a long chain: its segments advance in lockstep from every state that the word before may have,
        a pass over the segments settles those states, and the segments are traced again."""
        moves = np.where(self.ok, self.step, -1e9)
        k, n = len(STATES), len(numbers)
        many = -(-n // SEGMENT)
        sizes = np.full(many, SEGMENT)
        sizes[-1] = n - SEGMENT * (many - 1)
        grid = np.zeros(many * SEGMENT, dtype=np.int64)
        grid[:n] = numbers
        grid = grid.reshape(many, SEGMENT)
        best = moves[None] + self.known[grid[:, 0]][:, None, :]  # segment, state before, state now
        best[0] = np.where(self.start_ok, self.known[grid[0, 0]], -1e9)
        for t in range(1, SEGMENT):
            on = np.flatnonzero(sizes > t)
            for s in range(0, len(on), CELLS // SEGMENT):
                some = on[s : s + CELLS // SEGMENT]
                best[some] = (best[some][:, :, :, None] + moves).max(axis=2) + self.known[grid[some, t]][:, None, :]
        total, came = best[0, 0], np.zeros((many, k), dtype=np.int8)
        for g in range(1, many):
            ways = total[:, None] + best[g]
            came[g] = ways.argmax(axis=0)
            total = ways.max(axis=0)
        ends = np.zeros(many, dtype=np.int64)
        ends[-1] = total.argmax()
        for g in range(many - 1, 0, -1):
            ends[g - 1] = came[g, ends[g]]
        path = np.empty((many, SEGMENT), dtype=np.int8)
        for s in range(0, many, CELLS // SEGMENT):
            part = slice(s, s + CELLS // SEGMENT)
            first = self.known[grid[part, 0]] + moves[np.concatenate([[0], ends[:-1]])[part]]
            if not s:
                first[0] = np.where(self.start_ok, self.known[grid[0, 0]], -1e9)
            path[part] = self._trace(grid[part], sizes[part], first, ends[part])
        return path.reshape(-1)[:n]


def model_spans(model: Crf, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) of what the model tags in each text."""
    out: list[list] = [[] for _ in texts]
    where, numbers = [], []
    model.forget()
    for d, text in enumerate(texts):
        if not _DIGIT.search(text) and "@" not in text and "+" not in text:
            continue
        for chain in chains(text):
            shapes = ["", *(shape(text[s:e]) for s, e in chain), ""]
            where.append((d, chain))
            numbers.append(np.array([model.number(text[s:e], *(shapes[k + i] for i in (1, 0, 2))) for k, (s, e) in enumerate(chain)], dtype=np.int64))
    for (d, chain), path in zip(where, model.decode(numbers), strict=True):
        open_ = None
        for (s, e), state in zip(chain, path.tolist(), strict=True):
            name = STATES[state]
            if name[0] == "I" and open_:
                open_[2] = e
                continue
            open_ = [s, KINDS.index(name[2:]), e] if name != "O" else None
            if open_:
                out[d].append(open_)
    return [[tuple(x) for x in spans] for spans in out]


def merged(base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and the added ones that touch none of them, sorted."""
    free, at, reach = [], 0, -1
    for x in added:  # both are sorted; base spans may overlap each other, so the furthest end so far counts
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= x[0]:
            free.append(x)
    return sorted(base + free)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by its first span's kind in angle brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


_models: list[Crf] = []


def _found(texts: list[str]) -> list[tuple[list, list]]:
    if not _models:
        _models.append(Crf())
    base = [base_spans(x) for x in texts]
    return [(b, merged(b, a)) for b, a in zip(base, model_spans(_models[0], texts), strict=True)]


def personal_data(docs: DataFrame) -> DataFrame:
    """One row for each of documents(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are of the base spans, spans has all, as kind:start:end in code points. A null text is empty and
    has none. Rows are independent; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            found = _found([x or "" for x in batch.column(1).to_pylist()])
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every span in text replaced by its kind, and n_chars (if there) the new length; null texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            found = _found([x or "" for x in texts])
            new = pa.array([x and mask(x, every) for x, (_, every) in zip(texts, found, strict=True)], pa.string())
            batch = batch.set_column(at, text, new)
            if (k := batch.schema.get_field_index(n_chars)) >= 0:
                batch = batch.set_column(k, n_chars, pc.utf8_length(new).cast(batch.column(k).type))
            yield batch

    return in_arrow(docs, run, docs.schema)
