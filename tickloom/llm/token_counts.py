"""Token counts by a compiled finite-state transducer (operator 12).

A byte-pair vocabulary is compiled into a deterministic transducer over characters. A state holds, for each
place at which a token can still be open, the part read since then, the token before it, and how many
tokens fewer there are up to it. That is all a next character needs: the last token of a text is the one
that can stand beside the last token before it, and two tokens can stand side by side when merging
their joined text gives just these two. Each transition says by how much the number of tokens changes (it can
fall, as "a" and "b" are two tokens until "c" makes them one). A space after something else leads to one state
whatever was before, as no token goes on there. Runs of spaces merge last of all, and have states of their own.

States are made when a text first reaches them. Texts are cut into chunks of ``CHUNK`` characters, which all run
side by side. A chunk is a map from states to (state, count), known for some states: at first for the one that a short
run over the characters before it ends in. Where the state that one chunk ends in is not yet among those of the next,
it is added, until all maps fit together. A prefix scan by doubling then composes the maps of all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import _bytes, mix, slices

#: Characters in a chunk, and before it to find the state it is most likely entered with.
CHUNK, BEFORE = 128, 24
#: States kept; with more, a worker starts again from none.
STATES = 1 << 20
SPACE = "▁"
#: Classes of characters: the space, and by UTF-8 length those that the vocabulary does not have.
BLANK_CLASS, UNKNOWN, FIRST_KNOWN = 0, 1, 5
FRESH = 0
NEVER = -float("inf")


class Vocabulary:
    """Pieces of a byte-pair model with their merge order."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        if any(SPACE in p[1:] and p.strip(SPACE) for p in scores):
            raise ValueError("a piece goes on over a space")
        words = [s for p, s in scores.items() if p.strip(SPACE) and len(p) > 1]
        runs = [s for p, s in scores.items() if not p.strip(SPACE) and len(p) > 1]
        if words and runs and max(runs) >= min(words):
            raise ValueError("runs of spaces do not merge last")
        self.heads = {p[:i] for p in scores for i in range(1, len(p))}
        self._edges: dict[str, tuple[list, list] | None] = {}
        self._beside: dict[tuple[str, str], bool] = {}

    def merges(self, text: str) -> Iterator[tuple[list[str], float]]:
        """The parts of a text after each merge, and its score.

        The neighbours with the highest score merge first, the left ones of equals.
        """
        parts = list(text)
        while True:
            joined = [self.scores.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in joined if s is not None), default=None)
            if best is None:
                return
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts, best

    def edges(self, piece: str) -> tuple[list, list] | None:
        """The parts at the right and at the left end of a piece while it is merged, each with when it ends.

        A merge with a high score can only come when a lower one has made its part, so it counts as
        late as that. None if merging gives something else than the piece.
        """
        if piece not in self._edges:
            right, left = [[piece[-1], NEVER]], [[piece[0], NEVER]]
            parts, when = [piece], -NEVER
            if len(piece) > 1:
                parts = []
                for parts, score in self.merges(piece):
                    when = min(when, score)
                    for row, part in ((right, parts[-1]), (left, parts[0])):
                        if row[-1][0] != part:
                            row[-1][1] = when
                            row.append([part, NEVER])
            self._edges[piece] = (right, left) if parts == [piece] else None
        return self._edges[piece]

    def beside(self, before: str | None, piece: str) -> bool:
        """Whether ``piece`` can stand after ``before`` in a result: no merge over the border comes in time."""
        key = (before, piece)
        known = self._beside.get(key)
        if known is None:
            known = self._beside[key] = self._apart(before, piece)
        return known

    def _apart(self, before: str | None, piece: str) -> bool:
        own = self.edges(piece)
        if own is None or before is None:
            return own is not None
        right, left = self.edges(before)[0], own[1]
        i = j = 0
        while True:
            (a, a_ends), (b, b_ends) = right[i], left[j]
            over = self.scores.get(a + b)
            if over is not None and over > a_ends and over >= b_ends:
                return False
            if a_ends == b_ends == NEVER:
                return True
            if a_ends >= b_ends:
                i += 1
            else:
                j += 1


class Transducer:
    """The transducer of a vocabulary, with the states that were needed so far."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.vocabulary = Vocabulary(scores)
        self.known = sorted(p for p in scores if len(p) == 1 and p != SPACE)
        self.classes = FIRST_KNOWN + len(self.known)
        self.class_of = np.full(0x110000, UNKNOWN + 3, np.uint16)
        for length, end in ((2, 0x10000), (1, 0x800), (0, 0x80)):
            self.class_of[:end] = UNKNOWN + length
        self.class_of[[ord(c) for c in self.known]] = np.arange(FIRST_KNOWN, self.classes)
        self.class_of[[0x20, 0x2581]] = BLANK_CLASS
        # tokens in a run of spaces; from ``cycle`` on, so many spaces more are one token more
        self.cycle = max((len(p) for p in scores if not p.strip(SPACE)), default=1)
        self.run = [self._tokens_of_run(k) for k in range(5 * self.cycle + 1)]
        if any(b != a + 1 for a, b in zip(self.run[self.cycle :], self.run[2 * self.cycle :])):
            raise ValueError("runs of spaces have no period")
        self.forget()

    def _tokens_of_run(self, spaces: int) -> int:
        parts = [SPACE] * spaces
        for parts, _ in self.vocabulary.merges(SPACE * spaces):
            pass
        return len(parts)

    def forget(self) -> None:
        self.states: list[tuple | int] = []
        self.number: dict[tuple | int, int] = {}
        self._state((("", None, 0),))  # FRESH: nothing before can be merged with
        self.start = self._state(1)  # a text begins with a space of its own
        self._resize(1 << 16)

    def _state(self, state: tuple | int) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def _resize(self, size: int) -> None:
        """A hash table of transitions with room for half of ``size``."""
        self.keys = np.full(size, -1, np.int64)
        self.target = np.zeros(size, np.int32)
        self.emitted = np.zeros(size, np.int16)
        self.filled = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _put(self, keys: np.ndarray, target: np.ndarray, emitted: np.ndarray) -> None:
        """Add transitions, whose keys differ from each other and from those that are there."""
        if 2 * (self.filled + len(keys)) > len(self.keys):
            used = self.keys >= 0
            old = self.keys[used], self.target[used], self.emitted[used]
            self._resize(4 * max(len(self.keys), len(keys)))
            self._put(*old)
        self.filled += len(keys)
        at, rest = self._place(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            self.keys[at[free]] = keys[free]
            own = free[self.keys[at[free]] == keys[free]]
            self.target[at[own]], self.emitted[at[own]] = target[own], emitted[own]
            rest = rest[self.keys[at[rest]] != keys[rest]]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)

    def _compile(self, state: int, kind: int) -> tuple[int, int]:
        """The state after a character of a class, and by how much the number of tokens changes."""
        config = self.states[state]
        spaces = config if isinstance(config, int) else 0
        if kind == BLANK_CLASS:
            if not spaces:
                return self._state(1), self.run[1]
            after = spaces + 1 if spaces < 2 * self.cycle else spaces + 1 - self.cycle
            return self._state(after), self.run[spaces + 1] - self.run[spaces]
        if kind < FIRST_KNOWN:
            return FRESH, kind - UNKNOWN + 1
        if spaces:  # the last space is open; before it anything may stand
            rise = self.run[spaces] - self.run[spaces - 1]
            config = ((SPACE, None, -rise), ("", SPACE, 0))
        char = self.known[kind - FIRST_KNOWN]
        last = fewer = None
        opened = []
        for part, before, count in config:
            longer = part + char
            if last is None and longer in self.vocabulary.scores and self.vocabulary.beside(before, longer):
                last, fewer = longer, count + 1
            if longer in self.vocabulary.heads:
                opened.append((longer, before, count))
        state = (*((part, before, count - fewer) for part, before, count in opened), ("", last, 0))
        return self._state(state), fewer

    def step(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character for many runs at once."""
        keys = states.astype(np.int64) * self.classes + kinds
        while True:
            at = self._place(keys)
            apart = np.flatnonzero(self.keys[at] != keys)
            missing = []
            while len(apart):
                have = self.keys[at[apart]]
                missing.append(apart[have < 0])
                apart = apart[have >= 0]
                at[apart] = (at[apart] + 1) & (len(self.keys) - 1)
                apart = apart[self.keys[at[apart]] != keys[apart]]
            missing = np.concatenate(missing) if missing else apart
            if not len(missing):
                return self.target[at], self.emitted[at]
            new = np.unique(keys[missing])
            made = np.array([self._compile(*divmod(key, self.classes)) for key in new.tolist()])
            self._put(new, made[:, 0], made[:, 1])

    def walk(self, kinds: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray):
        """The state each run over kinds[begin:end] leaves, and the tokens it adds, all side by side."""
        order = np.argsort(begin - end, kind="stable")
        length = (end - begin)[order]
        state, total = entry[order].astype(np.int32), np.zeros(len(order), np.int64)
        first, going = begin[order], len(order)
        for j in range(int(length[0]) if len(length) else 0):
            going = int(np.searchsorted(-length, -j, "left"))
            state[:going], added = self.step(state[:going], kinds[first[:going] + j])
            total[:going] += added
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], total[back]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null and empty ones have none."""
        if len(self.states) > STATES:
            self.forget()
        data, edges = _bytes(texts)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        kinds = self.class_of[chars]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        edges = lead[edges]
        number = -(-np.diff(edges) // CHUNK)
        text = np.repeat(np.arange(len(texts)), number)
        head = np.cumsum(number) - number
        begin = edges[:-1][text] + (np.arange(len(text)) - head[text]) * CHUNK
        end = np.minimum(begin + CHUNK, edges[1:][text])
        first = begin == edges[:-1][text]
        # the first guess of the state each chunk is entered with
        entry, _ = self.walk(kinds, np.where(first, begin, begin - BEFORE), begin, np.full(len(begin), FRESH))
        entry[first] = self.start
        total = self._composed(kinds, begin, end, entry, np.append(first[1:], True))
        out = np.zeros(len(texts), np.int64)
        out[number > 0] = total[head[number > 0]] + self.run[1]
        return out

    def _composed(self, kinds, begin, end, entry, final) -> np.ndarray:
        """The tokens from each chunk to the end of its text, for the first state it is entered with."""
        chunk = np.arange(len(begin))
        rows = [chunk, entry, *self.walk(kinds, begin, end, entry)]
        while True:
            have = rows[0].astype(np.int64) << 32 | rows[1]
            order = np.argsort(have)
            want = (rows[0] + 1).astype(np.int64) << 32 | rows[2]
            at = np.minimum(np.searchsorted(have[order], want), len(have) - 1) if len(have) else have
            found = have[order][at] == want
            missing = np.unique(want[~found & ~final[rows[0]]])
            if not len(missing):
                break
            chunk, entry = missing >> 32, (missing & 0xFFFFFFFF).astype(np.int32)
            more = [chunk, entry, *self.walk(kinds, begin[chunk], end[chunk], entry)]
            rows = [np.concatenate(pair) for pair in zip(rows, more)]
        # doubling: each map row takes in the one it leads to, twice as far each time
        stop = len(have)
        follow = np.append(np.where(final[rows[0]], stop, order[at] if stop else at), stop)
        total = np.append(rows[3], 0)
        while (follow != stop).any():
            total = total + total[follow]
            follow = follow[follow]
        return total[: len(begin)]


#: Texts that show whether a model adds a space in front and leaves everything else as it is.
_PROBES = ["", "a", " a  b ", "Ａﬁ", "a\u0301 x\u3000\u2028\ty", "▁ " * 40, "ab<s>\ue000\n"]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """Compiled from a sentencepiece byte-pair model with byte fallback and texts left as they are."""
    import sentencepiece

    if not path.endswith(".model"):
        raise ValueError("only sentencepiece models are compiled")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    machine = Transducer({model.id_to_piece(i): model.get_score(i) for i in ids})
    if machine.counts(pa.array(_PROBES)).tolist() != [len(model.encode(text)) for text in _PROBES]:
        raise ValueError("the model changes texts before it cuts them")
    return machine


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text), repeated rows included.

    ``vocabulary`` is the path of a sentencepiece model, the same on all machines. Null and empty texts have
    no bytes and no tokens, whatever the doc_id; an empty table has no rows. A text takes some 100 bytes of
    memory a character while it is counted; others are taken together up to two megabytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                size = np.diff(_bytes(part.column("text"))[1])
                counts = machine.counts(part.column("text"))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(size), pa.array(counts), pa.array(counts > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
