"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

A byte-pair tokenization is decided by its neighbours: a row of pieces is the tokenizer's result exactly when each piece,
and each two neighbours, are the result for their own text. So the last piece of every prefix is found from the last
pieces of shorter prefixes, no longer back than the longest piece. What of those is still open (the beginnings of pieces
that may yet be completed, the piece before each, and its count against the present one) is the state; a transition on a
character carries how many tokens it adds. States and transitions are compiled when a text first needs them, and kept for
the life of the worker.

Texts run in chunks of a fixed length, all chunks of a batch in step. What a chunk does is a map from the state before it
to the state after it and a count, known for the states it was run from. No piece joins a space to a character before it,
so a chunk at a space has one state before it, whatever came earlier. Another chunk is first run from the state that some
characters before it lead to. Then the maps are composed from each text's start: where a map is not known for the state
that comes out of the chunk before, the chunk is run from that one too, and the composition is made again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.llm import text as tx

SPACE = "▁"
#: Open texts with at most so many completions share states among the pieces before them that allow the same ones.
COMPLETIONS = 16
#: Characters of a chunk, and of what is run before it to guess its state.
CHUNK, LEAD = 48, 16
#: Characters that run together, and entries of all tables from which a worker starts anew; both bound its memory.
UNIT, MOST_ENTRIES = 1 << 17, 700_000
SLOTS_LOG2, CLASS_BITS = 21, 21
#: Rounds in which all chunks are composed at once; what is open then is composed chunk by chunk.
ROUNDS = 8
_compiled: dict[str, Transducer] = {}


class Unsure(ValueError):
    """The pieces of a text are not decided by its neighbours."""


class Transducer:
    """The compiled tokenizer: states, and a table of transitions by state and character, filled as texts need them."""

    def __init__(self, ranks: dict[str, float]) -> None:
        self.ranks = ranks
        self.longer: dict[str, list[str]] = {}
        for p in ranks:
            for k in range(1, len(p)):
                self.longer.setdefault(p[:k], []).append(p)
        if any(SPACE in p.lstrip(SPACE) for p in ranks):
            raise ValueError("pieces that join a space to a character before it can't be cut at spaces")
        self.split: dict[str, tuple[str, str] | None] = {}
        self.class_of = np.full(0x110000, -1, np.int32)
        self.characters: list[str] = []
        self.reset()

    def reset(self) -> None:
        """Empties all tables that grow with the texts."""
        self.alike: dict[tuple, str | None] = {}
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.slot_key = np.full(1 << SLOTS_LOG2, -1, np.int64)
        self.slot_to = np.zeros(1 << SLOTS_LOG2, np.int32)
        self.slot_adds = np.zeros(1 << SLOTS_LOG2, np.int16)
        self.n_transitions = 0
        self.start = self.state((("", "", 0),))
        self.first, self.first_adds = self.walk(self.start, SPACE)

    def entries(self) -> int:
        return len(self.alike) + len(self.states) + self.n_transitions

    def pieces(self, text: str) -> list[str]:
        """Merges of the best pairs, leftmost first, as the tokenizer does them."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank > best):
                    best, at = rank, k
            if best is None:
                break
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of the last merge that makes a piece; None for what merges don't make."""
        if piece not in self.split:
            parts, last = self._merged(piece)
            self.split[piece] = last if len(parts) == 1 else None
        return self.split[piece]

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the two pieces (``left`` may be empty) are the result for their own text.

        Merges are undone from the last back, and the pieces that then meet are looked up: one that the vocabulary joins
        better than the merge undone on either side would have been joined across the border.
        """
        if (len(right) > 1 and not self.halves(right)) or (len(left) > 1 and not self.halves(left)):
            return False
        if not left:
            return True
        above, beyond = float("-inf"), float("-inf")
        while True:
            rank = self.ranks.get(left + right)
            if rank is not None and rank > above and rank >= beyond:
                return False
            # Of the two, the one that was made later; of equals, the right one.
            a = self.ranks[left] if len(left) > 1 else float("inf")
            b = self.ranks[right] if len(right) > 1 else float("inf")
            if a == b == float("inf"):
                return True
            if a < b:
                above, left = a, self.halves(left)[1]
            else:
                beyond, right = b, self.halves(right)[0]

    def stand_in(self, text: str, before: str) -> str | None:
        """A piece that allows the same pieces as ``before`` does to begin with ``text``; None if it allows none of them."""
        completions = self.longer[text]
        if len(completions) > COMPLETIONS:
            return before
        key = (text, before)
        if key not in self.alike:
            allowed = tuple(self.neighbours(before, p) for p in completions)
            self.alike[key] = self.alike.setdefault((text, allowed), before) if any(allowed) else None
        return self.alike[key]

    def state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def walk(self, state: int, char: str) -> tuple[int, int]:
        """The state after ``char``, and the tokens it adds. A state lists (open text, piece before it, count)."""
        if char not in self.ranks:
            return self.start, len(char.encode("utf-8", "surrogatepass"))
        grown = [(text + char, before, count) for text, before, count in self.states[state]]
        done = [(text, count) for text, before, count in grown if text in self.ranks and self.neighbours(before, text)]
        if len(done) != 1:
            raise Unsure(f"{len(done)} pieces after {self.states[state]} with {char!r}")
        piece, count = done[0]
        adds = count + 1
        # What stands before a space can't matter to pieces that start with it.
        open_ = [(t, "" if t[0] == SPACE and not b.endswith(SPACE) else b, c - adds) for t, b, c in grown if t in self.longer]
        open_ = [(t, r, c) for t, b, c in open_ if (r := self.stand_in(t, b)) is not None]
        return self.state((*open_, ("", piece, 0))), adds

    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self.class_of[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]).tolist():
                self.class_of[p] = len(self.characters)
                self.characters.append(SPACE if p == 0x20 else chr(p))
            found = self.class_of[points]
        return found

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each transition, or the empty one where it belongs."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        seen = self.slot_key[slot]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << SLOTS_LOG2) - 1)
            seen = self.slot_key[slot[open_]]
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        return slot

    def step(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one character each, and the tokens that it adds; compiles transitions that are new."""
        keys = (states.astype(np.int64) << CLASS_BITS) | classes
        slot = self._slots(keys)
        missing = self.slot_key[slot] < 0
        if missing.any():
            fresh = np.unique(keys[missing])
            found = np.array([self.walk(k >> CLASS_BITS, self.characters[k & ((1 << CLASS_BITS) - 1)]) for k in fresh.tolist()], np.int64)
            self.n_transitions += len(fresh)
            while len(fresh):
                # Of new transitions that belong in one slot, the first takes it and the others look on.
                at, first = np.unique(self._slots(fresh), return_index=True)
                self.slot_key[at], self.slot_to[at], self.slot_adds[at] = fresh[first], found[first, 0], found[first, 1]
                fresh, found = np.delete(fresh, first), np.delete(found, first, 0)
            slot = self._slots(keys)
        return self.slot_to[slot], self.slot_adds[slot]

    def run(self, classes: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after stretches of characters and the tokens that these add, all in step, longer ones first."""
        order = np.argsort(-size, kind="stable")
        at, size, now = at[order], size[order], state[order].astype(np.int32)
        total = np.zeros(len(at), np.int64)
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))
            now[:m], adds = self.step(now[:m], classes[at[:m] + k])
            total[:m] += adds
        after, counts = np.empty_like(now), np.empty_like(total)
        after[order], counts[order] = now, total
        return after, counts

    def compose(self, classes: np.ndarray, at: np.ndarray, size: np.ndarray, fixed: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after chunks and the tokens that they add; ``state`` is right where ``fixed``, a guess elsewhere.

        All chunks whose map was used from another state than the chunk before ends in are run again from that one, all at
        once, until none is left. Texts that never settle (one letter over and over) are finished chunk by chunk, where
        equal chunks are run once from each state.
        """
        after, counts = self.run(classes, at, size, state)
        for _ in range(ROUNDS):
            wrong = np.flatnonzero(~fixed[1:] & (state[1:] != after[:-1])) + 1
            if not len(wrong):
                return after, counts
            state[wrong] = after[wrong - 1]
            after[wrong], counts[wrong] = self.run(classes, at[wrong], size[wrong], state[wrong])
        known: dict[tuple[bytes, int], tuple[int, int]] = {}
        for k in range(1, len(at)):
            if not fixed[k] and state[k] != after[k - 1]:
                state[k] = after[k - 1]
                key = (classes[at[k] : at[k] + size[k]].tobytes(), int(state[k]))
                if key not in known:
                    to, adds = self.run(classes, at[k : k + 1], size[k : k + 1], state[k : k + 1])
                    known[key] = int(to[0]), int(adds[0])
                after[k], counts[k] = known[key]
        return after, counts

    def counts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row of code points."""
        n_rows = len(offsets) - 1
        if not len(points):
            return np.zeros(n_rows, np.int64)
        points = np.where(points == ord(SPACE), 0x20, points)
        classes = self.classes(points)
        space = points == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[firsts] = True
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, len(points)))
        # A stretch from a space to the next is cut into chunks.
        chunks = -(-length // CHUNK)
        inner = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = np.repeat(start, chunks) + CHUNK * inner
        size = np.minimum(CHUNK, np.repeat(start + length, chunks) - at)
        fixed = inner == 0
        head = np.zeros(len(points), bool)
        head[firsts] = True
        head = fixed & head[at]
        total = np.zeros(len(at), np.int64)
        low, carried = 0, None
        while low < len(at):
            if self.entries() > MOST_ENTRIES:
                self.reset()
            high = max(low + 1, int(np.searchsorted(at, at[low] + UNIT, "left")))
            part = slice(low, high)
            state = np.where(head[part], self.first, self.start).astype(np.int32)
            guess = np.flatnonzero(~fixed[part])
            if len(guess):
                before = at[part][guess]
                state[guess] = self.run(classes, before - LEAD, np.full(len(guess), LEAD), np.full(len(guess), self.start))[0]
            known = fixed[part].copy()
            if not known[0]:
                # The unit before ends in the middle of a stretch.
                known[0], state[0] = True, self.state(carried)
            after, adds = self.compose(classes, at[part], size[part], known, state)
            total[part] = adds + np.where(head[part], self.first_adds, 0)
            carried = self.states[after[-1]]
            low = high
        sums = np.concatenate([[0], np.cumsum(total)])
        bounds = np.searchsorted(at, offsets)
        return sums[bounds[1:]] - sums[bounds[:-1]]


def compiled(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model with byte fallback, once for each worker process."""
    if path not in _compiled:
        model = library(path)
        ids = range(model.vocab_size())
        _compiled[path] = Transducer(
            {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        )
    return _compiled[path]


def library(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _each(machine: Transducer, path: str, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row by row; a row whose pieces its neighbours don't decide is counted by the library."""
    out = []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        try:
            out.append(int(machine.counts(points[low:high], np.array([0, high - low]))[0]))
        except Unsure:
            out.append(len(library(path).encode(points[low:high].astype(np.uint32).tobytes().decode("utf-32-le", "replace"))))
    return np.array(out, np.int64)


def _count(path: str, key: str, text: str, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            data, offsets = tx.column_bytes(batch.column(text))
            for low, high in tx.pieces(offsets):
                part, cuts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                before = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                try:
                    n = machine.counts(points, before[cuts])
                except Unsure:
                    n = _each(machine, path, points, before[cuts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(low, high - low), pa.array(np.diff(cuts)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"]
                )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the sentencepiece model at ``path`` (BPE with byte fallback, spaces escaped, a space put before
    each text) without begin, end or special tokens; special strings in a text are ordinary text. A null or empty text
    has none. Whole texts count, rows are kept one to one, extra columns are ignored, an empty table gives no rows. A very
    long text, with spaces or without, runs in chunks like any other, and a worker's tables are bounded whatever its texts.
    A text that the transducer can't decide (none is known) is counted by the library itself.

    Plan: no shuffle; every worker compiles the states that its texts need.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_count(path, key, text, limit), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
