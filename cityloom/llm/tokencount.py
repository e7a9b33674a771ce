"""Token counts of a byte-level BPE by finite-state transducers.

Two deterministic transducers, both run over numpy arrays:

* The *pre-tokenizer* has eight states over character classes (letter, number, other, white space, contraction) and
  emits where a pre-token begins. A chunk of characters is a map from state to state; the maps of all chunks of a block
  are composed by a parallel prefix scan, after which every chunk runs from its true start state.
* The *merge transducer* reads the bytes of a pre-token. Its transitions carry the change of the number of tokens of the
  bytes read so far. It is compiled from the vocabulary state by state as texts need them: a state is the longest suffix
  that begins some token, with the last token and the relative count at each position from which a token may still grow.
  The last token of a prefix is the only one that is compatible with the last token before it. All pre-tokens start in
  one state, so a text's chunk maps are constants there and counts add up.
"""

from __future__ import annotations

import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import pre_tokenizers

from cityloom.llm import textkit
from cityloom.llm.storage import ship

OVER = 1024
CHUNK = 64
SLOTS = 1 << 21
MAX_STATES = 400_000
MAX_FITS = 1_000_000
_OPEN = struct.Struct("<Bib")
_SPREAD, _MASK64 = 0x9E3779B97F4A7C15, 2**64 - 1
_SHIFT = 64 - 21

# characters of the Unicode property White_Space (fixed values)
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# symbols: class of a character with what follows it in the text
_L, _N, _O, _A1, _A2, _SN, _SW, _WN, _WW = range(9)
# states: nothing open, run of letters, numbers, others, white space, one space that joins what follows, 1 or 2 letters of a contraction to come
_END, _RL, _RN, _RO, _RW, _SP, _C1, _C2 = range(8)
_RESET = 9  # added to the symbol of a text's first character


def _pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token begins here" by symbol and state."""
    step, begins = np.zeros((18, 8), np.uint8), np.ones((18, 8), bool)
    for state in range(8):
        for symbol, run in ((_L, _RL), (_N, _RN), (_O, _RO), (_A1, _C1), (_A2, _C2)):
            if state in (_C1, _C2):
                step[symbol, state], begins[symbol, state] = (_END if state == _C1 else _C1), False
            elif state == _SP or state == (_RO if run in (_C1, _C2) else run):
                step[symbol, state], begins[symbol, state] = (_RO if run in (_C1, _C2) else run), False
            else:
                step[symbol, state] = run
        step[_SN, state], step[_WN, state] = _SP, _END
        for symbol in (_SW, _WW):
            step[symbol, state], begins[symbol, state] = _RW, state != _RW
    for symbol in range(9):
        step[symbol + _RESET] = step[symbol, _END]
    return step, begins


_STEP, _BEGINS = _pretokenizer()
_classes: np.ndarray | None = None


def _char_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 space, 4 other white space, by code point.

    Code points that Python's tables do not know yet are put to the library's own pre-tokenizer.
    """
    global _classes
    if _classes is None:
        names = [unicodedata.category(chr(cp)) for cp in range(0x110000)]
        kinds = np.array([{"L": 0, "N": 1}.get(c[0], 2) for c in names], np.uint8)
        young = "".join(chr(cp) for cp, c in enumerate(names) if c == "Cn")
        split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        for c in regex.findall(r"[\p{L}\p{N}]", young):
            for kind, beside in enumerate("a1"):
                if len(split(beside + c + beside)) == 1:
                    kinds[ord(c)] = kind
        kinds[_WHITE] = 4
        kinds[32] = 3
        _classes = kinds
    return _classes


def _start_states(symbols: np.ndarray) -> np.ndarray:
    """State before every symbol: chunk maps, their prefix composition, then all chunks in step."""
    n = -(-len(symbols) // CHUNK)
    grid = np.zeros(n * CHUNK, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for row in grid:
        maps = _STEP[row[:, None], maps]
    shift = 1
    while shift < n:  # maps[i] becomes the composition of all maps up to i
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift], axis=1)
        shift *= 2
    state = np.zeros(n, np.uint8)
    state[1:] = maps[:-1, _END]
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        out[j] = state
        state = _STEP[row, state]
    return out.T.reshape(-1)[: len(symbols)]


def pretokens(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokens begin, for texts ``buf[at[d]:at[d+1]]``."""
    where = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _char_classes()[points]
    n = len(points)
    heads = np.zeros(n + 1, bool)
    heads[np.searchsorted(where, at)] = True
    last = heads[1:]  # last character of its text
    symbols = kind.copy()
    white = kind >= 3
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~white[1:]
    next_solid &= ~last
    symbols[white] = np.where(kind[white] == 3, _SN, _WN) + ~next_solid[white]
    marks = np.flatnonzero((points == 39) & ~last)
    if len(marks):
        far = np.append(points, [0, 0])
        one, two = far[marks + 1], far[marks + 2]
        two = np.where(np.append(last, [True, True])[marks + 1], 0, two)
        symbols[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
        pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbols[marks[pair]] = _A2
    symbols[heads[:-1]] += _RESET
    begins = _BEGINS[symbols, _start_states(symbols)]
    return where[begins | heads[:-1]]


class Merges:
    """The merge transducer of a byte-level BPE vocabulary, compiled as it is used."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbours along are not supported")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.token = [bytes([b]) for b in range(256)] + [a + b for a, b in self.rank]
        self.number = {t: i for i, t in enumerate(self.token)}
        self.begins = {t[:n] for t in self.token for n in range(1, len(t))}  # what a longer token begins with
        self.fits: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.full(SLOTS, -1, np.int64)  # open addressing: state and byte, to next state and change of the count
        self.values = np.zeros(SLOTS, np.int32)
        self.used = 0
        self.states: list[bytes] = []
        self.state_number: dict[bytes, int] = {}
        self._state(b"", [(0, -1, 0)])

    def _state(self, suffix: bytes, open_: list[tuple[int, int, int]]) -> int:
        """Number of a state; ``open_`` has size, last token before and relative count, longest first."""
        key = bytes([len(suffix)]) + suffix + b"".join(_OPEN.pack(*o) for o in open_)
        at = self.state_number.get(key)
        if at is None:
            at = self.state_number[key] = len(self.states)
            self.states.append(key)
        return at

    def encode(self, word: bytes) -> list[bytes]:
        """Tokens of a short byte string by its merges."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 40))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                joined = parts[i : i + 2] == list(best)
                out.append(best[0] + best[1] if joined else parts[i])
                i += 1 + joined
            parts = out
        return parts

    def _fit(self, before: int, token: int) -> bool:
        key = (before + 1) << 24 | token
        ok = self.fits.get(key)
        if ok is None:
            own = [self.token[token]] if before < 0 else [self.token[before], self.token[token]]
            ok = self.encode(b"".join(own)) == own
            if len(self.fits) > MAX_FITS:
                self.fits.clear()
            self.fits[key] = ok
        return ok

    def _compile(self, at: int) -> None:
        """Fill in the transition of one state on one byte."""
        key = self.states[at >> 8]
        n = key[0] + 1
        grown = key[1:n] + bytes([at & 255])
        open_ = list(_OPEN.iter_unpack(key[n:]))
        for size, before, count in open_:
            token = self.number.get(grown[len(grown) - size - 1 :])
            if token is not None and self._fit(before, token):
                break
        else:
            raise AssertionError("a single byte always fits")
        change = count + 1
        kept = [(size + 1, t, n - change) for size, t, n in open_ if grown[len(grown) - size - 1 :] in self.begins]
        longest = kept[0][0] if kept else 0
        kept.append((0, token, 0))
        to = self._state(grown[len(grown) - longest :], kept)
        slot = ((at * _SPREAD) & _MASK64) >> _SHIFT
        while self.keys[slot] != -1:
            slot = (slot + 1) & (SLOTS - 1)
        self.keys[slot], self.values[slot] = at, to << 8 | (change + 128)
        self.used += 1

    def _next(self, at: np.ndarray) -> np.ndarray:
        slot = ((at.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(_SHIFT)).astype(np.int64)
        found = self.keys.take(slot)
        out = self.values.take(slot)
        left = np.flatnonzero(found != at)
        while len(left):
            found = self.keys.take(slot[left])
            new = found == -1
            if new.any():
                for missing in np.unique(at[left[new]]).tolist():
                    self._compile(missing)
                continue
            hit = found == at[left]
            out[left[hit]] = self.values.take(slot[left[hit]])
            left = left[~hit]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out

    def count(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, all pre-tokens in step."""
        order = np.argsort(-size, kind="stable")
        start, falling = start[order], size[order]
        total, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        n = len(start)
        for j in range(int(falling[0]) if n else 0):
            n = int(np.searchsorted(-falling[:n], -j, "left"))
            if self.used > SLOTS // 2 or len(self.states) > MAX_STATES:
                state[:n] = self._restart(state[:n])
            packed = self._next(state[:n] << 8 | buf[start[:n] + j])
            total[:n] += (packed & 255) - 128
            state[:n] = packed >> 8
        out = np.empty_like(total)
        out[order] = total
        return out

    def _restart(self, state: np.ndarray) -> np.ndarray:
        """Drop all compiled states but those in use, so that memory stays bounded."""
        used, place = np.unique(state, return_inverse=True)
        keys = [self.states[s] for s in used.tolist()]
        self._clear()
        for k in keys:
            if k not in self.state_number:
                self.state_number[k] = len(self.states)
                self.states.append(k)
        return np.array([self.state_number[k] for k in keys], np.int64)[place]


_compiled: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _compiled:
        _compiled[path] = Merges(path)
    return _compiled[path]


def _cuts(buf: np.ndarray, at: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with long texts cut before white space that follows something else; such a place always begins a pre-token."""
    extra = []
    for d in np.flatnonzero(np.diff(at) > piece):
        lo, hi = at[d], at[d + 1]
        solid = textkit.PLAIN[buf[lo:hi]]
        places = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1 + lo
        if len(places):
            extra.append(places[np.unique(np.searchsorted(places, np.arange(lo + piece, hi, piece), "left").clip(max=len(places) - 1))])
    if not extra:
        return at, np.arange(len(at) - 1)
    every = np.union1d(at[:-1], np.concatenate(extra)) if len(at) > 2 else np.unique(np.concatenate([at[:-1], *extra]))
    return np.append(every, at[-1]), np.searchsorted(at, every, "right") - 1


def count_tokens(model: Merges, buf: np.ndarray, at: np.ndarray, piece: int = textkit.BLOCK_BYTES) -> np.ndarray:
    """Tokens of the texts ``buf[at[d]:at[d+1]]``; special strings count as one token each."""
    out = np.zeros(len(at) - 1, np.int64)
    if not len(buf):
        return out
    body = buf.tobytes()
    spans = sorted((p, p + len(s)) for s in model.special for p in _find(body, s, at))
    if spans:  # special strings separate what stands around them
        edges = np.array(spans).ravel()
        doc = np.searchsorted(at, edges[::2], "right") - 1
        np.add.at(out, doc, 1)
        plain = np.ones(len(buf), bool)
        for a, b in spans:
            plain[a:b] = False
        keep = np.flatnonzero(plain)
        left = np.searchsorted(keep, np.concatenate([edges[1::2], at[:-1]]))
        order = np.argsort(left, kind="stable")  # of parts that begin at one place only the last has text
        owner = np.concatenate([doc, np.arange(len(at) - 1)])[order]
        parts = np.append(left[order], len(keep))
        np.add.at(out, owner, count_tokens_plain(model, buf[keep], parts, piece))
        return out
    return count_tokens_plain(model, buf, at, piece)


def _find(body: bytes, s: bytes, at: np.ndarray) -> list[int]:
    found, p = [], body.find(s)
    while p >= 0:
        d = int(np.searchsorted(at, p, "right")) - 1
        if p + len(s) <= at[d + 1]:
            found.append(p)
            p = body.find(s, p + len(s))
        else:
            p = body.find(s, p + 1)
    return found


def count_tokens_plain(model: Merges, buf: np.ndarray, at: np.ndarray, piece: int) -> np.ndarray:
    out = np.zeros(len(at) - 1, np.int64)
    cuts, owner = _cuts(buf, at, piece)
    lo = 0
    while lo < len(owner):  # about a piece at a time
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + piece, "right")) - 1)
        part, own = buf[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo]
        if len(part):
            begin = pretokens(part, own)
            n = model.count(part, begin, np.diff(np.append(begin, len(part))))
            segment = np.searchsorted(own, begin, "right") - 1
            np.add.at(out, owner[lo:hi][segment], n)
        lo = hi
    return out


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = OVER) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row, counted as the tokenizer file ``path`` defines, without added tokens.

    ``path`` must be readable on the executors. Null or empty texts have 0 bytes and 0 tokens; null ids and repeated rows
    are kept row by row; other columns are not read. A long text is counted in pieces that begin at a sure pre-token.
    """

    def run(batches):
        model = merges(path)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, at in textkit.blocks(batch.column(1)):
                n = count_tokens(model, buf, at)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
