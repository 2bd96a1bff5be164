"""What several corpus operators share: durable cut points, Arrow helpers, the word-cached encoder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct pieces that one Python worker remembers before it forgets those used once; some 200 bytes each.
CACHE_PIECES = 250_000
#: Longer pieces are encoded each time and never remembered; remembered ones have so many ids each on average at most.
LONG_PIECE, IDS_A_PIECE = 64, 8


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")


def durable(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about most_bytes of the column at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then those of starts[1], and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    steps = np.ones(total, dtype=np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    steps[0] = starts[0]
    steps[np.cumsum(lengths)[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(steps, out=steps)


#: Characters that every version of Unicode puts in one class, as regular expressions' brackets hold them.
#: Lower-casing and normal form C leave letters what they are, one for one, and join none of them to what stands before.
SPACES = "\t-\r \xa0\u2000-\u200a\u3000"
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGITS = "0-9"
MARKS_BUT_APOSTROPHE = "!-&(-/:-@\\[-`{-~\u3001\u3002\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
MARKS = MARKS_BUT_APOSTROPHE + "'"

#: Where a pre-token ends whatever else the text holds: a run of letters, digits or marks ends where the class changes. An
#: apostrophe before a letter is left out, as a contraction may begin there.
CLASS_CHANGE = f"(?<=[{LETTERS}])(?=[{MARKS}{DIGITS}])|(?<=[{DIGITS}])(?=[{LETTERS}{MARKS}])|(?<=[{MARKS_BUT_APOSTROPHE}])(?=[{LETTERS}{DIGITS}])|(?<=')(?=[{DIGITS}])"
#: Runs of one class, which are one pre-token but for a contraction at their start.
RUN = f"[{LETTERS}]{{6,}}|[{MARKS}]{{6,}}"
#: Characters at a run's start that may be a contraction's.
CONTRACTION = 4


def quoted(name: str) -> str:
    """A column's name as expressions and schema strings take it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, by names that may hold dots or backticks."""
    return [F.col(quoted(c)) for c in df.columns]


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) whatever its columns' names: that method itself takes none with a dot or backtick."""
    names = df.columns
    if not any(c in name for name in names for c in ".`"):
        return df.mapInArrow(run, schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.rename_columns(names) for batch in batches)

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(named, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed as little as makes it no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


_UNSAFE = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?= (?!\n)|\n)")
#: White space that is neither a space nor a line end, as ASCII has it.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"


def _uneven(text: str) -> bool:
    """Whether white space may follow white space; the plain cases are told without a regular expression."""
    if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
        return True
    if text.isascii():
        return any(c in text for c in _RARE_SPACE)
    return _UNSAFE.search(text) is not None


#: Pieces that are letters after one space at most, of scripts that every version of Unicode knows alike.
_LETTERS = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizers-library file, loaded once in each worker, without truncation or padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _loaded[path] = made
    return _loaded[path]


class _Numbers(dict):
    """Numbers pieces as they come. A key is a piece without its leading space, or with its leading line end.

    New pieces wait to be learnt. One that is a line end and a word, or a word and closing marks, is made of the numbers of
    its parts instead: a pre-token ends between them. A long one is not numbered but passes, as -1 and down.
    """

    def __init__(self, lead: str, waiting: list, passing: list):
        self.lead, self.waiting, self.passing, self.start, self.bare = lead, waiting, passing, 0, self

    def __missing__(self, key: str) -> int:
        if len(key) > LONG_PIECE:
            self.passing.append(key if key[0] == "\n" else self.lead + key)
            return -len(self.passing)
        item: str | tuple[int, int] = self.lead + key
        if key[:1] == "\n":
            item = key
            if len(key) > 1 and self.lead and not key[1].isspace():
                item = (self.bare["\n"], self.bare[key[1:]])
        else:
            word = key.rstrip(".,")
            if 0 < len(word) < len(key) and word[-1].isalnum():
                item = (self[word], self.bare[key[len(word) :]])
        waiting = self.waiting
        self[key] = number = self.start + len(waiting)
        waiting.append(item)
        return number


class PieceEncoder:
    """Encodes texts with a byte-level file of the tokenizers library, each distinct piece of text once.

    A piece begins at a space or line end that follows a non-space character. No pre-token reaches across such a place
    (the pattern takes white space only at a token's start), and neither does a special token, so a text's ids are its
    pieces' ids in order.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tokenizer, self.cache_pieces = tokenizer(path), cache_pieces
        # Pieces are learnt many to a string where a line end stays a token of its own between them.
        line, both = self._plain("\n"), self._plain(" a\nb\n c")
        self.line = line[0] if len(line) == 1 and both == self._plain(" a") + line + self._plain("b") + line + self._plain(" c") else None
        self.words = self._word_tokenizer() if self.line is not None else None
        self._clear()

    def _word_tokenizer(self):
        """The same model cut at line ends only: for pieces that are one run of letters, and so one pre-token."""
        from tokenizers import Tokenizer, pre_tokenizers

        made = Tokenizer(self.tokenizer.model)
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), pre_tokenizers.Split(self.tokenizer.id_to_token(self.line), "isolated")])
        return made

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.waiting: list[str | tuple[int, int]] = []
        self.passing: list[str] = []
        self.spaced, self.bare = _Numbers(" ", self.waiting, self.passing), _Numbers("", self.waiting, self.passing)
        self.spaced.bare = self.bare
        self.starts = np.zeros(1024, dtype=np.int64)
        self.lengths = np.zeros(1024, dtype=np.int64)
        self.uses = np.zeros(1024, dtype=np.uint16)
        self.flat = np.zeros(8192, dtype=np.uint32)
        self.n = self.used = 0

    def _forget(self) -> None:
        """Keeps only the pieces that more than one batch has used since the last time; none, if those are too many."""
        old = self.starts, self.lengths, self.flat
        again = np.flatnonzero(self.uses[: self.n] > 1)
        new_number = np.full(self.n, -1, dtype=np.int64)
        new_number[again] = np.arange(len(again))
        known = self.spaced, self.bare
        few = len(again) <= self.cache_pieces // 2 and int(old[1][again].sum()) <= IDS_A_PIECE * self.cache_pieces // 2
        self._clear()
        if not few:
            return
        for old_known, new_known in zip(known, (self.spaced, self.bare), strict=True):
            while old_known:  # moved one by one, so that the two never stand side by side
                key, number = old_known.popitem()
                if (m := int(new_number[number])) >= 0:
                    new_known[key] = m
        sizes = old[1][again]
        self._room(len(again), int(sizes.sum()))
        self.starts[: len(again)], self.lengths[: len(again)] = np.cumsum(sizes) - sizes, sizes
        self.flat[: int(sizes.sum())] = old[2][ranges(old[0][again], sizes)]
        self.n, self.used = len(again), int(sizes.sum())
        self.spaced.start = self.bare.start = self.n

    def _room(self, pieces: int, ids: int) -> None:
        while self.n + pieces > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def _ids(self, pieces: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids on end, and how many each has."""
        found = [e.ids for e in (self.words if plain else self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._room(0, len(ids))
        self.starts[numbers], self.lengths[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self) -> None:
        if not self.waiting:
            return
        self._room(len(self.waiting), 0)
        texts = [(k, x) for k, x in enumerate(self.waiting, self.n) if type(x) is str]
        done: set[int] = set()
        if self.line is not None:
            letters = [x for x in texts if _LETTERS.fullmatch(x[1])]
            done.update(x[0] for x in letters)
            others = [x for x in texts if x[0] not in done and (y := x[1][x[1][:1] == " " :]).split() == [y] and "<|" not in y]
            done.update(x[0] for x in others)
            for easy, plain in ((letters, True), (others, False)):
                if easy:
                    words = [x[1] for x in easy]
                    joined, _ = self._ids(["\n".join(words[i : i + 256]) + "\n" for i in range(0, len(words), 256)], plain)
                    ends = np.flatnonzero(joined == self.line)
                    self._store(np.array([x[0] for x in easy]), joined[joined != self.line], np.diff(ends, prepend=-1) - 1)
        if hard := [x for x in texts if x[0] not in done]:
            self._store(np.array([x[0] for x in hard]), *self._ids([x[1] for x in hard]))
        composed = [(k, *x) for k, x in enumerate(self.waiting, self.n) if type(x) is tuple]
        if composed:  # parts come before what is made of them; one part may be made of parts itself
            made = np.array(composed, dtype=np.int64)
            pending = np.zeros(self.n + len(self.waiting), dtype=bool)
            pending[made[:, 0]] = True
            while len(made):
                ready = ~(pending[made[:, 1]] | pending[made[:, 2]])
                now = made[ready]
                parts = now[:, 1:].ravel()
                sizes = self.lengths[parts]
                self._store(now[:, 0], self.flat[ranges(self.starts[parts], sizes)], sizes.reshape(-1, 2).sum(axis=1))
                pending[now[:, 0]] = False
                made = made[~ready]
        self.n += len(self.waiting)
        self.waiting.clear()
        self.spaced.start = self.bare.start = self.n

    def _pass(self) -> None:
        """Ids of the pieces that pass, behind the known ones: the next batch writes over them."""
        if not self.passing:
            return
        ids, sizes = self._ids(self.passing)
        many = len(self.passing)
        self._room(many, len(ids))
        self.starts[self.n : self.n + many], self.lengths[self.n : self.n + many] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.passing.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and each text's number of ids.

        The collector of cycles rests meanwhile: there are none, and each of its rounds would walk all known pieces.
        """
        rests = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if rests:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.cache_pieces or self.used > IDS_A_PIECE * self.cache_pieces:
            self._forget()
        if len(self.flat) > 8 * max(self.used, 1 << 20):  # room that pieces in passing took
            self.flat = self.flat[: 2 * max(self.used, 4096)].copy()
        heads: list[str] = []
        rest: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            if text[0].isspace() or _uneven(text):
                pieces = _SAFE_CUT.split(text)
                rest += [x[x[:1] == " " :] for x in pieces[1:]]
                counts[k] = len(pieces)
            else:
                pieces = text.replace("\n", " \n").split(" ")
                counts[k] = len(pieces)
                rest += pieces[1:]
            heads.append(pieces[0])
        if not heads:
            return np.zeros(0, dtype=np.uint32), counts
        a, b = (np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces)) for known, pieces in ((self.bare, heads), (self.spaced, rest)))
        many = len(self.passing)
        self._learn()
        self._pass()
        for used in (a, b):
            if many:
                used[used < 0] = self.n - 1 - used[used < 0]
            self.uses[used] += 1  # counts batches, not occurrences
        self.uses[self.n : self.n + many] = 0
        numbers = np.empty(len(a) + len(b), dtype=np.int64)
        full = counts[counts > 0]
        at_head = np.cumsum(full) - full
        is_head = np.zeros(len(numbers), dtype=bool)
        is_head[at_head] = True
        numbers[is_head], numbers[~is_head] = a, b
        sizes = self.lengths[numbers]
        ids = self.flat[ranges(self.starts[numbers], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return ids, upto[ends] - upto[ends - counts]


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """The worker's own encoder of a file: what one task has learnt serves the next."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].cache_pieces = cache_pieces
    return _encoders[path]
