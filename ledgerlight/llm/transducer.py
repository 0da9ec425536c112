"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

Merging by rank leaves a prefix of a text with one last token at each place, and that token is
decided by bounded context: it must be a vocabulary piece and form a valid pair with the last token
where it starts.  A state is therefore the longest suffix read that still begins some piece, with
the last token at each place in it where a piece may begin.  Each transition carries the change in
the number of tokens that the text read so far has, so the weights along a path add up to the token
count.  States and transitions are compiled when first met.

A chunk of text is a map from states to (state, count).  No piece holds a space mark after another
character, so such a mark resets the state: a chunk's map is what its head before the first mark
does to the incoming state, and a constant behind it.  A head without a mark, however long, is run
once from the reset state; from another state only the letters are run until both runs are in the
same state.  Maps compose associatively without copying text, so a text's chunks can be composed in
any bracketing: in groups, whose maps are paired up level by level, as in the up-sweep of a parallel
prefix scan.  A text is counted in one task and only its last prefix is asked for, so the down-sweep,
which gives the others, is left out.  Characters outside the vocabulary count as their UTF-8 bytes
(byte fallback) and reset the state too.

What has been compiled is forgotten between groups once there is much of it; the state reached is then
made anew, so that nothing holds the old ones.  A text of any length thus needs its own size and that.

Null and empty texts have no tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Sequence
from math import inf
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.common import free_name, text_of

MARK = "▁"
CHUNK = 8192
LIMIT = 4096
#: Places at which a head remembers the state of its run from the reset state.
SYNC = 256
#: States and pairs remembered before they are forgotten and compiled again, and words.
MEMORY, WORDS = 600_000, 250_000
#: Chunks whose maps are composed before they act on the state.
GROUP = 16


class Head:
    """A stretch without reset: its run from the reset state, and what that run met first."""

    __slots__ = ("text", "states", "counts", "end", "count")

    def __init__(self, text: str, states: list, counts: list, end: State, count: int) -> None:
        self.text, self.states, self.counts, self.end, self.count = text, states, counts, end, count


class ChunkMap(NamedTuple):
    """``head`` acts on the incoming state; behind it follow ``count`` tokens up to state ``end``.

    A head is a ``Head``, a pair of heads of which the left one acts first, or empty.
    """

    head: Head | tuple
    end: State | None
    count: int


class State(dict):
    """Transitions by character: (next state, change in the token count)."""

    __slots__ = ("suffix", "cuts", "machine")

    def __init__(self, machine: Transducer, suffix: str, cuts: tuple) -> None:
        self.machine, self.suffix, self.cuts = machine, suffix, cuts

    def __missing__(self, letter: str):
        step = self[letter] = self.machine.step(self, letter)
        return step


class Words(dict):
    """Token counts of words between resets."""

    __slots__ = ("machine",)

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine

    def __missing__(self, word: str) -> int:
        return self.machine.count_word(word)


class Transducer:
    """Compiled from the normal pieces of a vocabulary with their scores."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.states: dict[tuple, State] = {}
        self.made: dict[str, tuple[str, str] | None] = {}
        #: Whether what some piece begins with is a piece itself.
        self.prefixes = {piece[:n]: False for piece in scores for n in range(1, len(piece) + 1)}
        self.prefixes.update(dict.fromkeys(scores, True))
        if any(MARK in piece.lstrip(MARK) for piece in scores):
            raise ValueError("a piece holds a space mark after another character; marks do not reset this vocabulary")
        self.clear()

    @classmethod
    def from_file(cls, path: str) -> Transducer:
        """Compile a sentencepiece BPE model with byte fallback and without normalisation rules."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        special = [p.piece for p in model.pieces if p.type in (4, 5)]  # user-defined, unused
        if (
            trained.model_type != 2 or not trained.byte_fallback or special or spec.precompiled_charsmap
            or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces)
        ):
            raise ValueError("only BPE with byte fallback, a leading mark and no other normalisation is compiled")
        return cls({p.piece: p.score for p in model.pieces if p.type == 1})

    def clear(self) -> None:
        """Forget what was compiled; transitions go first, as those back to the start make circles."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = Words(self)
        self.older: dict[str, int] = {}
        self.reset = self._state("", ((0, None, 0),))

    def _state(self, suffix: str, cuts: tuple) -> State:
        state = self.states.get((suffix, cuts))
        if state is None:
            state = self.states[suffix, cuts] = State(self, suffix, cuts)
        return state

    def _parts(self, token: str) -> tuple[str, str] | None:
        """The two parts of the merge that makes ``token``; None if merging never makes it."""
        if token not in self.made:
            parts, last = list(token), None
            while len(parts) > 1:
                best = max(
                    ((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores),
                    default=None,
                )
                if best is None:
                    break
                at = -best[1]
                last = tuple(parts[at:at + 2])
                parts[at:at + 2] = ["".join(last)]
            self.made[token] = last if len(parts) == 1 else None
        return self.made[token]

    def valid(self, left: str | None, right: str) -> bool:
        """Whether the two tokens stay apart: undo their merges from the last, and at no time may
        the parts that then touch have made a better merge."""
        known = self.pairs.get((left, right))
        if known is None:
            if left is None:
                known = len(right) == 1 or self._parts(right) is not None
            else:
                known = self._apart(left, right)
            self.pairs[left, right] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        scores = self.scores
        if len(right) > 1 and self._parts(right) is None:
            return False
        limit = -inf
        strict = True
        while True:
            joint = scores.get(left + right)
            if joint is not None and (joint > limit or joint == limit and not strict):
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if len(right) == 1 or len(left) > 1 and scores[left] < scores[right]:
                limit, strict = scores[left], True
                left = self._parts(left)[1]
            else:  # of equal merges the left one comes first
                limit, strict = scores[right], False
                right = self._parts(right)[0]

    def step(self, state: State, letter: str) -> tuple[State, int]:
        if letter == MARK and state.suffix.strip(MARK):
            state = self.reset
        text = state.suffix + letter
        prefixes, pairs = self.prefixes, self.pairs
        gain, kept = None, []
        for cut in state.cuts:
            start, last, count = cut
            token = text[start:]
            piece = prefixes.get(token)
            if piece is None:
                continue
            kept.append(cut)
            if piece and gain is None:
                fits = pairs.get((last, token))
                if fits or fits is None and self.valid(last, token):
                    gain, found = count + 1, token
        if gain is None:
            if letter not in self.scores:
                return self.reset, len(letter.encode("utf-8", "surrogatepass"))
            raise AssertionError(f"no last token after {text!r}")
        first = kept[0][0] if kept else len(text)
        cuts = [(start - first, last, count - gain) for start, last, count in kept]
        cuts.append((len(text) - first, found, 0))
        return self._state(text[first:], tuple(cuts)), gain

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for letter in text:
            state, gain = state[letter]
            count += gain
        return state, count

    def _head(self, text: str) -> Head:
        state, count = self.reset, 0
        states, counts = [state], [0]
        for letter in text[:SYNC]:
            state, gain = state[letter]
            count += gain
            states.append(state)
            counts.append(count)
        end, rest = self.run(state, text[SYNC:])
        return Head(text, states, counts, end, count + rest)

    def _through(self, state: State, head: Head) -> tuple[State, int]:
        text, count = head.text, 0
        for n, (met, before) in enumerate(zip(head.states, head.counts)):
            if state is met:
                return head.end, count + head.count - before
            if n < len(text):
                state, gain = state[text[n]]
                count += gain
        state, rest = self.run(state, text[len(head.states):])
        return state, count + rest

    def act(self, state: State, heads: Head | tuple) -> tuple[State, int]:
        """What ``heads`` make of ``state``, and how many tokens they add."""
        count, left = 0, [heads]
        while left:
            part = left.pop()
            if isinstance(part, tuple):
                left.extend(reversed(part))
            else:
                state, more = self._through(state, part)
                count += more
        return state, count

    def count_word(self, word: str) -> int:
        count = self.older.get(word)
        if count is None:
            count = self.run(self.reset, word)[1]
        if len(word) <= 64:  # a longer run will hardly come again
            if len(self.words) >= WORDS:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = count
        return count

    def chunk_map(self, chunk: str) -> ChunkMap:
        """``chunk`` uses marks for spaces; words between resets are looked up."""
        first = _RESET.search(chunk)
        if first is None:
            return ChunkMap(self._head(chunk), None, 0)
        at = first.end()
        words = _WORDS.findall(chunk, at)
        end, count = self.run(self.reset, words.pop())
        count += sum(map(self.words.__getitem__, words))
        return ChunkMap(self._head(chunk[:at]), end, count)

    def compose(self, one: ChunkMap, two: ChunkMap) -> ChunkMap:
        """First ``one``, then ``two``; associative."""
        if one.end is None:
            return ChunkMap((one.head, two.head), two.end, two.count)
        state, count = self.act(one.end, two.head)
        return ChunkMap(one.head, state if two.end is None else two.end, one.count + count + two.count)

    def total(self, maps: Sequence[ChunkMap]) -> ChunkMap:
        """All ``maps`` composed, in pairs level by level."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + list(maps[2 * len(pairs):])
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        state, count, marked = self.reset, 0, MARK + text.replace(" ", MARK)
        for begin in range(0, len(marked), chunk * GROUP):
            if len(self.states) + len(self.pairs) > MEMORY:
                self.clear()
                state = self._state(state.suffix, state.cuts)
            end = min(begin + chunk * GROUP, len(marked))
            whole = self.total([self.chunk_map(marked[n:min(n + chunk, end)]) for n in range(begin, end, chunk)])
            _, state, more = self.compose(ChunkMap((), state, 0), whole)
            count += more
        return count


_RESET = re.compile(f"[^{MARK}](?={MARK})")
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


def count_tokens(
    docs: DataFrame, model: str, text_column: str = "text", limit: int = LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Columns of these names are replaced.
    """
    machine: list[Transducer] = []

    @F.pandas_udf("long")
    def counted(texts):
        if not machine:
            machine.append(Transducer.from_file(model))
        collecting = gc.isenabled()
        gc.disable()  # nothing here is left in circles, and looking for them takes a tenth of the time
        try:
            return texts.map(lambda text: machine[0].count(text, chunk)).astype("int64")
        finally:
            if collecting:
                gc.enable()

    length = free_name(docs, "_tokens")
    return (
        docs.withColumn(length, counted(text_of(text_column)))
        .withColumn("n_bytes", F.octet_length(text_of(text_column)).cast("long"))
        .withColumn("n_tokens", F.col(length))
        .withColumn("over_limit", F.col(length) > limit).drop(length)
    )
