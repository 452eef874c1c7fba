"""Byte-pair encoding by rank-synchronous merging of ragged numpy arrays.

Pre-tokens are held in one flat array of symbols with a sequence number each. In every round each sequence applies its
lowest-rank pair at all its places at once (a run of one repeated symbol pairs up from the left); sequences without a
pair leave. What survives are the tokens. The vocabulary is a public ``tokenizers`` file (byte-level BPE, with or
without an end-of-word suffix), read by path; pre-tokens come from its own split rule.

Texts are looked up run by run between single spaces and line feeds, where that cannot change the result, in a bounded
table of runs seen before; only new runs are merged.
"""

from __future__ import annotations

import itertools
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

_NONE = np.int64(1) << 40
#: Count of a run that cannot be looked up alone; far above any text's count.
_BREAK = 1 << 50
#: Runs kept at most by a worker; beyond, the table is emptied and filled again.
MAX_RUNS = 700_000
#: The usual characters, on whose classes all Unicode versions agree; texts with others are split by the library.
_USUAL = re.compile("[\x00-\x1b\x20-\u024f\u2010-\u2027]*\\Z")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, more = {b: chr(b) for b in plain}, itertools.count(256)
    return [out[b] if b in out else chr(next(more)) for b in range(256)]


class Merger:
    """The merge rules of a tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.last_id = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made  # made: by rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def symbols(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens one after another, and the number of each pre-token's."""
        n = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        flat = np.frombuffer(b"".join(pretokens), np.uint8)
        ids = self.byte_id[flat]
        full = np.flatnonzero(n)
        ids[np.cumsum(n)[full] - 1] = self.last_id[flat[np.cumsum(n)[full] - 1]]
        seq = np.repeat(np.arange(len(n)), n)
        rank = np.full(len(ids), _NONE)  # of the pair that begins at each symbol
        if len(ids):
            same = np.flatnonzero(seq[:-1] == seq[1:])
            rank[same] = self.ranks(ids[same], ids[same + 1])
        done = []
        while len(ids):
            head = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(head, len(ids)))
            low = np.minimum.reduceat(rank, head)
            over = low == _NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((seq[gone], ids[gone]))
                ids, seq, rank = ids[~gone], seq[~gone], rank[~gone]
                low, size = low[~over], size[~over]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, size)
            i = np.flatnonzero(hit)
            if (hit[1:] & hit[:-1]).any():  # a repeated symbol: every other place of each run, from its first
                start = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(i) > 1)), np.arange(len(i)), 0))
                i = i[((np.arange(len(i)) - start) & 1) == 0]
            ids[i] = self.made[rank[i]]
            keep = np.ones(len(ids), bool)
            keep[i + 1] = False
            i -= np.arange(len(i))  # where the merged symbols come to lie
            ids, seq, rank = ids[keep], seq[keep], rank[keep]
            rank[i] = _NONE
            for at in (i, i[i > 0] - 1):
                at = at[at < len(ids) - 1]
                at = at[seq[at] == seq[at + 1]]
                rank[at] = self.ranks(ids[at], ids[at + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
        s, t = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        o = np.argsort(s, kind="stable")
        return t[o], np.bincount(s, minlength=len(n))


class ByteCounter:
    """Token counts of whole texts under a byte-level vocabulary with the usual split rule."""

    def __init__(self, path: str, max_runs: int = MAX_RUNS):
        self.m, self.max_runs = Merger(path), max_runs
        self.split = regex.compile(_GPT2)
        self.first: dict[str, int] = {}  # runs at the start of a line
        self.spaced: dict[str, int] = {}  # runs after a space
        self.tokens: dict[str, int] = {}  # pre-tokens
        self.marks = re.compile("|".join(map(re.escape, self.m.special))) if self.m.special else None

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() and not _ODD_SPACE.search(text) or _USUAL.match(text):
            return self.split.findall(text)
        return [text[a:b] for _, (a, b) in self.m.library.pre_tokenizer.pre_tokenize_str(text)]

    def _count(self, kinds: set[str]) -> None:
        """Counts of new pre-tokens into the table."""
        kinds = list(kinds.difference(self.tokens))
        _, n = self.m.symbols([x.encode() for x in kinds])
        self.tokens.update(zip(kinds, n.tolist(), strict=True))

    def _learn(self, table: dict[str, int], new: set[str], lead: str) -> None:
        table.update(dict.fromkeys(new, _BREAK))
        plain = [r for r in new if r and not r[0].isspace() and not r[-1].isspace()]
        parts = [self.pretokens(lead + r) for r in plain]
        self._count(set(itertools.chain.from_iterable(parts)))
        get = self.tokens.__getitem__
        table.update(zip(plain, [sum(map(get, x)) for x in parts], strict=True))

    def whole(self, text: str) -> int:
        """Tokens of a text whose white space is irregular."""
        parts = self.pretokens(text)
        self._count(set(parts))
        return sum(map(self.tokens.__getitem__, parts))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special token's string counts as one token."""
        flat, owner, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            parts = [t] if self.marks is None or not self.marks.search(t) else self.marks.split(t)
            extra[k] = len(parts) - 1
            for p in parts:
                if p:
                    flat.append(p)
                    owner.append(k)
        split = [[line.split(" ") for line in t.split("\n")] for t in flat]
        for table in (self.first, self.spaced, self.tokens):
            if len(table) > self.max_runs:
                table.clear()
        first = {r[0] for lines in split for r in lines}.difference(self.first)
        if first:
            self._learn(self.first, first, "")
        spaced = set()
        for lines in split:
            for r in lines:
                spaced.update(r[1:])
        spaced.difference_update(self.spaced)
        if spaced:
            self._learn(self.spaced, spaced, " ")
        a, b = self.first.__getitem__, self.spaced.__getitem__
        for k, t, lines in zip(owner, flat, split, strict=True):
            n = len(lines) - 1 + sum(a(r[0]) + sum(map(b, r[1:])) for r in lines)
            extra[k] += n if n < _BREAK else self.whole(t)
        return extra


class _Ragged:
    """Id lists by string, in one flat array that grows by doubling."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.start, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def add(self, keys: list[str], flat: np.ndarray, n: np.ndarray) -> None:
        first, last = len(self.at), len(self.at) + len(keys)
        while last > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.start[first:last] = self.used + np.cumsum(n) - n
        self.size[first:last] = n
        self.pool[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(keys, range(first, last), strict=True))

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))

    def gather(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings with the numbers ``k`` one after another, and the number of each's."""
        n = self.size[k]
        end = np.cumsum(n)
        return self.pool[np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[k] - (end - n), n)], n


class WordEncoder:
    """Token ids of whole texts under a vocabulary that drops white space and lower-cases (end-of-word suffix). Runs
    between spaces and line feeds are encoded alone: nothing of the split rule reaches across white space. Arrow finds
    the distinct runs of a call; only these are looked up."""

    def __init__(self, path: str, max_runs: int = MAX_RUNS):
        self.m, self.max_runs = Merger(path), max_runs
        # a line feed, which no run holds, ends each run
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t\n\r\x0b\x0c]+|\n")  # of lower-cased ASCII runs
        self.clear()

    def clear(self) -> None:
        self.runs, self.tokens = _Ragged(), _Ragged()
        self.runs.add([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self.tokens.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))  # number 0: the end of a run

    def _learn(self, new: list[str]) -> None:
        ascii_, usual, odd = [], [], []  # the library splits the odd ones
        for r in new:
            if "<" in r and any(s in r for s in self.m.special):
                odd.append(r)
            else:
                (ascii_ if r.isascii() else usual if _USUAL.match(r) else odd).append(r)
        flat = self.ascii.findall("\n".join([*ascii_, ""]).lower()) + self.split.findall("\n".join([*usual, ""]).lower())
        kinds = list(set(flat).difference(self.tokens.at))
        ids, n = self.m.symbols([x.encode() for x in kinds])
        self.tokens.add(kinds, ids.astype(np.uint32), n)
        k = self.tokens.numbers(flat)
        ids, n = self.tokens.gather(k)
        ends = np.cumsum(n)[k == 0]
        self.runs.add(ascii_ + usual, ids, np.diff(ends, prepend=0))
        if odd:
            made = [np.array(self.m.library.encode(r, add_special_tokens=False).ids, np.uint32) for r in odd]
            self.runs.add(odd, np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made)))

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        runs = split.flatten().dictionary_encode()
        names = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.runs.at) > self.max_runs or len(self.tokens.at) > self.max_runs:
            self.clear()
        k = list(map(self.runs.at.get, names))
        if None in k:
            self._learn([r for r, x in zip(names, k, strict=True) if x is None])
            k = [self.runs.at[r] if x is None else x for r, x in zip(names, k, strict=True)]
        flat, n = self.runs.gather(np.array(k, np.int64)[runs.indices.to_numpy()])
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(split.value_lengths().to_numpy())]
        return np.split(flat, ends[:-1])


_MADE: dict[tuple, object] = {}


def shared(kind, path: str, max_runs: int = MAX_RUNS):
    """One counter or encoder for each worker process, file and table size; its table of runs outlives a task. A worker keeps
    the last one only: workers serve many stages, and the tables of earlier ones would stay in their memory."""
    if (kind, path, max_runs) not in _MADE:
        _MADE.clear()
        _MADE[kind, path, max_runs] = kind(path, max_runs)
    return _MADE[kind, path, max_runs]


def release() -> None:
    """Forgets the worker's counter or encoder."""
    _MADE.clear()
