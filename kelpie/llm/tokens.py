"""Whole-document token ids by a public tokenizer, with a bounded store of pieces.

A pre-token never runs across a change from a visible character to a space (a byte-level
vocabulary takes the space to what follows, a word vocabulary drops it), so a text falls into
pieces that can be encoded one by one with the same result. Pieces are hashed all at once with
numpy, each distinct one goes through the tokenizers library once, and its ids are then reused.
A special token's string in a text is that token, as the library has it; what lies between such
strings is encoded by itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept by a worker (about 40 bytes each); longer ones, in bytes, are encoded each time.
STORE_PIECES, PIECE_BYTES = 800_000, 48
SIGNS = r"[!-&(-/:-@\[-`{-~]"
RUNS = re.compile(rf"[^\W\d_]+|{SIGNS}+|\n")
#: Possessive, as the kinds of runs have no character in common: nothing is ever tried twice.
PLAIN = re.compile(rf"(?:[^\W\d_]++|{SIGNS}++|\n(?!\n))*+")
_RANDOM = np.random.default_rng(20_240_229)
#: A multiplier for each byte value (none for the separator) and each place in a piece.
BYTE, PLACE = (_RANDOM.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, PIECE_BYTES + 1))
BYTE[32] = 0
FIRST = np.uint64(0x9E3779B97F4A7C15)


class Store:
    """Ids by a piece's 64-bit hash: sorted keys, and one flat array of ids."""

    def __init__(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.size, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def append(self, pieces: list[bytes]) -> np.ndarray:
        """Slots of new ids; without remember() they last until forget()."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), "<u4")
        while self.n + len(pieces) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        slots = np.arange(self.n, self.n + len(pieces))
        self.begin[slots], self.size[slots] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(pieces), self.used + len(flat)
        return slots

    def remember(self, keys: np.ndarray, slots: np.ndarray) -> None:
        keys, slots = np.concatenate([self.keys, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def forget(self, n: int, used: int) -> None:
        self.n, self.used = n, used

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all slots in turn, and how many each has."""
        sizes = self.size[slots]
        shift = self.begin[slots] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


class Encoder:
    def __init__(self, path: str, keeps_space: bool):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        #: Whether added tokens are found as plain strings; any others are left to the library.
        self.simple = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.between = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.keeps_space = keeps_space
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level spelling leaves as they are
        hidden = [b for b in range(256) if b not in shown]
        self.spell = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.store, self.odd, self.parts = Store(), set(), {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    @staticmethod
    def _plain(runs: list[str]) -> bool:
        return all(r.isascii() or r.isalpha() and r.lower().isalpha() for r in runs)

    def _spelt(self, run: str, lead: bool) -> str:
        """A pre-token as the model's vocabulary spells it."""
        if not self.keeps_space:
            return run.lower() if run.isascii() else "".join(self.spell[b] for b in "".join(c.lower() for c in unicodedata.normalize("NFC", run)).encode())
        if not run.isascii() or run == "\n":
            run = "".join(self.spell[b] for b in run.encode())
        return "\u0120" + run if lead else run

    def _pieces(self, pieces: list[str], first: list[bool]) -> list[bytes | None]:
        """Ids of pieces as they stand after a space, or at a text's beginning; None: cut at white space, not to be used.

        Where letters, signs and single line ends take turns, each run is a pre-token and goes
        straight to the model; any other piece goes through the whole tokenizer.
        """
        plans, whole, spelt = [], {}, {}
        for p, f in zip(pieces, first, strict=True):
            lead = self.keeps_space and not f
            if p and not p.isascii() and p[-1].isspace():
                plans.append(None)
                continue
            if p.isascii() and p.isalpha():
                plan = [self._spelt(p, lead)]
            elif p and p[0] != "\n" and PLAIN.fullmatch(p) and self._plain(runs := RUNS.findall(p)):
                plan = [self._spelt(r, lead and not k) for k, r in enumerate(runs) if self.keeps_space or r != "\n"]
            else:
                plan = " " + p if lead else p
                whole[plan] = None
                plans.append(plan)
                continue
            for x in plan:
                if x not in self.parts:
                    spelt[x] = None
            plans.append(plan)
        if len(self.parts) > 100_000:
            self.parts.clear()
            spelt = dict.fromkeys(x for plan in plans if isinstance(plan, list) for x in plan)
        tokenize, ids, bounds = self.tokenizer.model.tokenize, array("I"), [0]
        for x in spelt:
            ids.extend([t.id for t in tokenize(x)])
            bounds.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        self.parts.update(zip(spelt, (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)), strict=True))
        whole = dict(zip(whole, self._encode(list(whole)), strict=True))
        parts = self.parts
        return [None if x is None else whole[x] if isinstance(x, str) else parts[x[0]] if len(x) == 1 else b"".join([parts[r] for r in x]) for x in plans]

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 40_000) -> np.ndarray:
        """A hash of each piece of up to PIECE_BYTES bytes; longer ones' hashes mean nothing."""
        out, lens = [], ends - starts
        bounds = [0, *np.searchsorted(ends, np.arange(step * 8, int(ends[-1]) + 1, step * 8)).tolist(), len(starts)]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if lo == hi:
                continue
            own = np.minimum(lens[lo:hi], PIECE_BYTES) + 1  # with the separator, which counts as nothing
            begin = np.cumsum(own) - own
            place = np.arange(int(own.sum())) - np.repeat(begin, own)
            h = np.add.reduceat(BYTE[data[np.repeat(starts[lo:hi], own) + place]] * PLACE[place], begin)
            h ^= h >> np.uint64(29)
            out.append((h + (lens[lo:hi] + 1).astype(np.uint64)) * FIRST)
        return np.concatenate(out)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's encode(text, add_special_tokens=False) gives them."""
        if not self.simple:
            return [np.frombuffer(x, "<u4") for x in self._encode(texts)]
        if not self.between or not any(map(self.between.search, texts)):
            return self._batch(texts)
        parts, plans = [], []
        for t in texts:
            at, plan = 0, []
            for m in self.between.finditer(t):
                parts.append(t[at : m.start()])
                plan.append(self.special[m[0]])
                at = m.end()
            parts.append(t[at:])
            plans.append(plan)
        coded, out = iter(self._batch(parts)), []
        for plan in plans:
            ids = [next(coded)]
            for i in plan:
                ids += [np.array([i], np.uint32), next(coded)]
            out.append(np.concatenate(ids) if plan else ids[0])
        return out

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens' strings."""
        if not texts:
            return []
        if len(self.store.keys) > STORE_PIECES:
            self.store, self.odd = Store(), set()
        store = self.store
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        stops = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1) - 1
        white = (data == 32) | ((data >= 9) & (data <= 13))
        cut = data == 32
        cut[1:] &= ~white[:-1]  # a run of white space stays with what follows
        cut[stops] = True
        ends = np.flatnonzero(cut)
        starts = np.append(0, ends[:-1] + 1)
        last = np.searchsorted(ends, stops)
        firsts = np.append(0, last[:-1] + 1)
        keys = self._hashes(data, starts, ends)
        keys[firsts] ^= FIRST
        long = ends - starts > PIECE_BYTES
        keys[long] = np.arange(1, long.sum() + 1, dtype=np.uint64) * PLACE[0]
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        fleeting = long[where]
        slots = store.find(distinct)
        slots[fleeting] = -1
        is_first = np.zeros(len(keys), bool)
        is_first[firsts] = True
        n, used = store.n, store.used
        odd = np.zeros(len(distinct), bool)
        for keep in (True, False):
            new = np.flatnonzero((slots < 0) & (fleeting != keep))
            if not len(new):
                continue
            at = where[new]
            strings = [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            ids = self._pieces(strings, is_first[at].tolist())
            bad = np.array([x is None for x in ids])
            slots[new] = store.append([x or b"" for x in ids])
            odd[new] = bad
            if keep:
                store.remember(distinct[new], slots[new])
                self.odd.update(distinct[new][bad].tolist())
                n, used = store.n, store.used
        if self.odd:
            odd |= np.isin(distinct, np.fromiter(self.odd, np.uint64, len(self.odd)))
        flat, sizes = store.gather(slots[back])
        store.forget(n, used)
        bounds = np.append(0, np.cumsum(np.add.reduceat(sizes, firsts)))
        out = [flat[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        if odd.any():
            for i in np.flatnonzero(np.add.reduceat(odd[back], firsts)).tolist():
                out[i] = np.frombuffer(self._encode([texts[i]])[0], "<u4")
        return out


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One a worker process, whose store lives through its tasks."""
    return Encoder(path, keeps_space)
