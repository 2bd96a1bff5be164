"""Operator 9: URL filters by a bit-parallel wildcard automaton.

Glob rules (* any run, ? any one character, everything else itself) are packed one after another into the bits of as
many 64-bit words as they need. One Shift-And step per character moves all rules of all URLs of a batch at once:
bits enter through the character's mask, a bit in front of a * stays, and a rule matches whose last bit is set at the
end. Rules are matched against the canonical form "host#path" with host lower-cased; neither part can hold a #.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The site rules (host, path, verdict) of the filter.
SITE_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Globs over host#path that block what no site rule judges; the rest is allowed.
BLOCK_GLOBS = ("*#*/login*", "*#*/signup*", "*#*/cart/*", "*#*/admin/*", "*#*.exe", "*#*.zip", "*#*.apk", "ads.*#*", "*.ads.*#*", "*tracker.*#*", "*#*/tag/*/feed/", "*casino*#*", "*cheap-pills*#*", "*free-bets*#*", "*ads-track*#*")
URLS_AT_ONCE = 8192


class GlobAutomaton:
    """All globs at once; characters are bytes of the UTF-8 form (? stands for one byte of it)."""

    def __init__(self, globs: list[str]):
        self.globs = list(globs)
        self.start_bits: list[int] = []
        self.final_bits: list[int] = []
        star_bits: list[int] = []
        position = 0
        masks: list[tuple[int, int | None]] = []
        for glob in self.globs:
            # Bit `position` is the state before the glob's first symbol; each symbol has the state after it.
            self.start_bits.append(position)
            for c in glob.encode():
                if c == 0x2A:
                    star_bits.append(position)
                else:
                    position += 1
                    masks.append((position, None if c == 0x3F else c))
            self.final_bits.append(position)
            position += 1
        self.words = position // 64 + 1
        self.mask = np.zeros((256, self.words), dtype=np.uint64)
        for bit, c in masks:
            rows = slice(None) if c is None else c
            self.mask[rows, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        self.stay, self.initial = self._bits(star_bits), self._bits(self.start_bits)

    def _bits(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs) booleans."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        raw = np.frombuffer(b"".join(texts) + b"\0", dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")  # the longest first: those still running are a prefix
        state = np.tile(self.initial, (len(texts), 1))
        falling = -sizes[order]
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(falling, -t, "left"))
            now = state[:n]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            shifted &= self.mask[raw[starts[order[:n]] + t]]
            state[:n] = shifted | (now & self.stay)
        out = np.empty((len(texts), len(self.globs)), dtype=bool)
        for k, b in enumerate(self.final_bits):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or # (or the end), A-Z lower-cased; "" for null or no ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _site_globs(host: str, path: str) -> list[str]:
    return [f"{host}#{path}*", f"*.{host}#{path}*"]


def judge_urls(pages: DataFrame, rules: tuple = SITE_RULES, globs: tuple = BLOCK_GLOBS) -> DataFrame:
    """One row for each of pages(page_id, url): page_id, host, path, rule, verdict.

    rule: the longest site rule (host + path) whose host is the url's or a parent domain of it and whose path the url's
    starts with, else null. verdict: the rule's; without one, block if a glob matches, else allow. A null url, or one
    without ://, has empty host and path. Rows are independent; other columns are not read.
    """
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))  # the first that fits is the longest
    every = [g for host, path, _ in order for g in _site_globs(host, path)] + list(globs)
    names, verdicts = [h + p for h, p, _ in order], [v for _, _, v in order]
    own: list[GlobAutomaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own:
            own.append(GlobAutomaton(every))
        for whole in batches:
            for at in range(0, whole.num_rows, URLS_AT_ONCE):
                batch = whole.slice(at, URLS_AT_ONCE)
                hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                found = own[0].matches([f"{h}#{p}".encode() for h, p in zip(hosts, paths, strict=True)])
                n = len(order)
                site = found[:, : 2 * n].reshape(-1, n, 2).any(axis=2)
                which = np.where(site.any(axis=1), site.argmax(axis=1), -1)
                blocked = found[:, 2 * n :].any(axis=1)
                rule = [names[k] if k >= 0 else None for k in which.tolist()]
                verdict = [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(which.tolist(), blocked.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    cut = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return cut.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def glob_regex(glob: str) -> str:
    """The glob as a regular expression, for checks."""
    import re

    return "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c) or re.escape(c) for c in glob)


def oracle() -> str:
    """DuckDB SQL for judge_urls over the pages table with the default rules."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = " ".join(f"WHEN (host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)}) THEN {quoted(h + p)}" for h, p, _ in sorted(SITE_RULES, key=lambda r: -len(r[0] + r[1])))
    verdicts = " ".join(f"WHEN {quoted(h + p)} THEN {quoted(v)}" for h, p, v in SITE_RULES)
    globs = " OR ".join(f"(host || '#' || path) GLOB {quoted(g)}" for g in BLOCK_GLOBS)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
    named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
    ruled AS (SELECT *, CASE {rules} END AS rule FROM named)
    SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {globs} THEN 'block' ELSE 'allow' END END AS verdict FROM ruled
    """
