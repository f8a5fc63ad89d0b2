"""A byte-level BPE vocabulary compiled to two deterministic transducers.

1. The *split transducer* reads character classes and marks where pre-tokens start. It has
   a dozen states, so a chunk of text is a map from start state to end state; the maps of
   all chunks compose through a parallel prefix scan, after which each chunk knows its
   start state and emits its marks, all chunks in step.
2. The *count transducer* reads the bytes of a pre-token. Its transitions carry the change
   in the number of tokens that a further byte brings. It is built lazily: a state is what
   the future can depend on, that is the longest suffix that a vocabulary entry starts with
   and the last token of every prefix that ends inside that suffix.

A pre-token never looks beyond itself, so counts of distinct pre-tokens are kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import pairwise

import numpy as np

from .arrow import runs

# Character classes of the split pattern
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, SHORT, R, E, V, LL, END = range(12)
# States of the split transducer.
START, IN_L, IN_N, IN_O, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, IN_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before
WIDTH = 16
STATES = 12
SPECIAL = "<|endoftext|>"
CHUNK = 256
NEAR = 4096  # bytes before the end of a slice from which a place to cut is looked for


def _kind(cls: int) -> int:
    return LETTER if cls in (LETTER, SHORT, R, E, V, LL) else cls


def _open(cls: int) -> int:
    """State after the first character of a pre-token."""
    return {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK}[_kind(cls)]


def _step(state: int, cls: int) -> tuple[int, int]:
    """Next state and marks."""
    kind = _kind(cls)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if (state, cls) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, LL)):
            return START, 0
        to, marks = _step(IN_L, cls)
        return to, marks | BEFORE
    if cls == END:
        return START, 0
    if state == START:
        return _open(cls), HERE
    if state == IN_QUOTE:
        if cls == SHORT:
            return START, 0
        if cls in (R, V, LL):
            return {R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}[cls], 0
        state = IN_O
    if kind in (SPACE, BLANK):
        if state in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
            return (RUN_SPACE if kind == SPACE else RUN_BLANK), 0
        return _open(cls), HERE
    joined = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O}[kind]
    if state == ONE_SPACE:
        return joined, 0
    if state == RUN_SPACE:
        return joined, BEFORE
    if state == RUN_BLANK:
        return _open(cls), HERE | BEFORE
    if state == joined:
        return state, 0
    return _open(cls), HERE


@lru_cache(1)
def _tables() -> tuple[bytes, bytes]:
    """Next states (times WIDTH) and marks, by state * WIDTH + class."""
    to, out = bytearray(256), bytearray(256)
    for s in range(STATES):
        for c in range(12):
            nxt, marks = _step(s, c)
            to[s * WIDTH + c], out[s * WIDTH + c] = nxt * WIDTH, marks
    return bytes(to), bytes(out)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        cat = unicodedata.category(chr(cp))
        if cat[0] == "L":
            table[cp] = LETTER
        elif cat[0] == "N":
            table[cp] = NUMBER
        elif cat in ("Zs", "Zl", "Zp") or 9 <= cp <= 13 or cp == 0x85:
            table[cp] = BLANK
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for c in "stmd":
        table[ord(c)] = SHORT
    table[ord("r")], table[ord("e")], table[ord("v")], table[ord("l")] = R, E, V, LL
    return table


def _apply(table: bytes, index: np.ndarray) -> np.ndarray:
    return np.frombuffer(index.tobytes().translate(table), np.uint8).reshape(index.shape)


def _marks(classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; texts are parted by END."""
    to, out = _tables()
    n = len(classes)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    # The state map of each chunk: from every state at once.
    maps = np.repeat((np.arange(STATES, dtype=np.uint8) * WIDTH)[:, None], chunks, axis=1)
    for row in steps:
        maps = _apply(to, maps + row)
    # Parallel prefix scan: after each round a map covers twice as many chunks.
    maps, reach = maps // WIDTH, 1
    while reach < chunks:
        maps = np.concatenate([maps[:, :reach], np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0)], axis=1)
        reach *= 2
    state = np.concatenate([np.full(1, START, np.uint8), maps[START, :-1]]) * np.uint8(WIDTH)
    marks = np.empty_like(steps)
    for t, row in enumerate(steps):
        index = state + row
        marks[t] = _apply(out, index)
        state = _apply(to, index)
    flat = np.ascontiguousarray(marks.T).reshape(-1)
    starts = (flat & HERE).astype(bool)
    starts[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return starts[:n]


class Compiled:
    """The count transducer of one vocabulary file, with the counts or ids of pre-tokens.

    What a worker remembers is bounded in bytes (``WORDS``) and in states (``STATES_KEPT``);
    beyond that it starts afresh, which changes no result.
    """

    WORDS = 48 << 20  # bytes of pre-tokens and what is known of them
    LONG = 256  # a longer pre-token is not remembered
    STATES_KEPT = 250_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = {c: b for b, c in _printable().items()}
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.path = path
        self.ids = {raw(t): i for t, i in vocab.items() if t != SPECIAL}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs[x, y] = (rank, z)
            self.parts.setdefault(z, (rank, x, y))
        self.longest = max(map(len, self.ids))
        self.prefixes = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.words: dict[bytes, int] = {}
        self.held = 0
        self._forget()

    def _forget(self) -> None:
        # A state: the longest live suffix, and for each live suffix its length, the last token
        # before it (None at the start of the pre-token) and the number of tokens up to there,
        # less those up to here. Moves are by state * 256 + byte.
        self.states: list[tuple[bytes, tuple]] = [(b"", ((0, None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.valid: dict[int, bool] = {}
        self.tails: dict[bytes, tuple[bytes, tuple, list]] = {}

    def _stays(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` apart when they stand side by side.

        The pair is taken apart merge by merge, latest merge first. What meets at the
        border at each moment must not have a merge that would have come before the merge
        that was just undone.
        """
        key = left << 16 | right
        if (known := self.valid.get(key)) is not None:
            return known
        never = len(self.pairs)
        limit, on_left = never, False  # the undone merge comes at ``limit``
        a, b = left, right
        while True:
            if (m := self.pairs.get((a, b))) is not None:
                # Equal ranks: the same pair occurs again; BPE takes the leftmost first.
                if m[0] < limit or (m[0] == limit and not on_left):
                    self.valid[key] = False
                    return False
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                self.valid[key] = True
                return True
            if pb is None or (pa is not None and pa[0] > pb[0]):
                limit, on_left, a = pa[0], True, pa[2]
            else:
                limit, on_left, b = pb[0], False, pb[1]

    def _tail(self, text: bytes) -> tuple[bytes, tuple, list[tuple[int, int]]]:
        """The longest suffix that a longer vocabulary entry starts with, the lengths of all
        such suffixes, and the entries that end the text, longest first."""
        n = len(text)
        live = tuple(k for k in range(n, 0, -1) if text[n - k :] in self.prefixes)
        tokens = [(k - 1, t) for k in range(min(n, self.longest), 0, -1) if (t := self.ids.get(text[n - k :])) is not None]
        return text[n - live[0] :] if live else b"", live, tokens

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The transition on a byte, and the tokens that it adds."""
        suffix, held = self.states[state]
        text = suffix + bytes((byte,))
        known = self.tails.get(text)
        if known is None:
            known = self.tails[text] = self._tail(text)
        suffix, live, tokens = known
        at = {k: (before, n) for k, before, n in held}
        for k, token in tokens:
            before, count = at[k]
            if before is None or self._stays(before, token):
                break
        count += 1
        key = (suffix, (*((k, at[k - 1][0], at[k - 1][1] - count) for k in live), (0, token, 0)))
        found = self.numbers.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        made = self.moves[state << 8 | byte] = (found, count)
        return made

    def count(self, word: bytes) -> int:
        state, total, moves = 0, 0, self.moves
        for b in word:
            state, more = moves.get(state << 8 | b) or self._move(state, b)
            total += more
        return total

    def known(self, words: list[bytes]) -> list[int]:
        """The number of tokens of each pre-token."""
        if len(self.states) > self.STATES_KEPT or len(self.valid) > self.STATES_KEPT:
            self._forget()
        return _remembered(self, words, self.count)

    @cached_property
    def library(self):
        return _library(self.path)


class Ids:
    """Token ids of pre-tokens, from the library's own model, remembered as ``Compiled`` does."""

    WORDS, LONG = 24 << 20, Compiled.LONG

    def __init__(self, path: str):
        self.library = _library(path)
        self.model, self.printable = self.library.model, _printable()
        self.words: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, word: bytes) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.printable))], "<u4").tobytes()

    def known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian bytes."""
        return _remembered(self, words, self.encode)


def _remembered(own: Compiled | Ids, words: list[bytes], find: Callable) -> list:
    """``find`` of every word; words are told apart by their bytes."""
    if own.held > own.WORDS:
        own.words, own.held = {}, 0
    out = list(map(own.words.get, words))
    fresh: dict = {}
    for i, got in enumerate(out):
        if got is None:
            word = words[i]
            if (got := fresh.get(word)) is None:
                got = fresh[word] = find(word)
            out[i] = got
    for word, got in fresh.items():
        if len(word) <= own.LONG:
            own.words[word] = got
            own.held += 120 + len(word) + (len(got) if isinstance(got, bytes) else 0)
    return out


def split(data: bytes, lengths: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Pre-tokens of UTF-8 texts that lie side by side (``lengths`` in bytes), and the text
    that each belongs to."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    wide = (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000) + 1
    at = np.cumsum(wide) - wide
    text_of = np.searchsorted(np.cumsum(lengths), at, side="right")
    classes = np.full(len(points) + len(lengths), END, np.uint8)
    places = np.arange(len(points)) + text_of
    classes[places] = _classes()[points]
    first = np.flatnonzero(_marks(classes)[places])
    edges = [*at[first].tolist(), len(data)]
    return [data[a:b] for a, b in pairwise(edges)], text_of[first]


def slices(raw: memoryview, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows ``a`` to ``b`` with their bytes and lengths, up to ``limit`` bytes at a time.

    A longer text comes in several parts, each of one row. A pre-token starts wherever white
    space follows something else, so a cut there is one that the pattern makes anyway; text
    without such a place near ``limit`` goes on to the next one.
    """
    for a, b in runs(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > limit:
            place = _CUT.search(raw, max(lo, lo + limit - NEAR), hi)
            cut = place.start() + 1 - lo if place else hi - lo
            yield a, b, bytes(raw[lo : lo + cut]), np.array([cut])
            lo += cut
        if hi > lo:
            yield a, b, bytes(raw[lo:hi]), np.diff(offsets[a : b + 1]) if b - a > 1 else np.array([hi - lo])


def with_special(raw: memoryview, offsets: np.ndarray) -> list[int]:
    """The rows whose text holds the special token's string."""
    found = [m.start() for m in re.finditer(re.escape(SPECIAL.encode()), raw)]
    ends = np.array(found, np.int64) + len(SPECIAL)
    row = np.searchsorted(offsets, found, side="right") - 1
    return np.unique(row[ends <= offsets[row + 1]]).tolist() if found else []


_CUT = re.compile(rb"[!-~][\x20\x09-\x0D]")


def _library(path: str):
    """The tokenizers library over the same file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _printable() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(1)
def compiled(path: str) -> Compiled:
    """One transducer a worker."""
    return Compiled(path)


@lru_cache(1)
def ids(path: str) -> Ids:
    """One table of ids a worker."""
    return Ids(path)
