"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked (a ``▁`` in front and for every space) and cut before each
``▁`` that follows another character; no piece crosses such a place. The
distinct marked words of a batch are sorted, which lays out their trie; each
node, a prefix that words share, gets one forward state. Words of a usual length
are walked level by level, all nodes of a level in arrays: an automaton over the
pieces, in step with the trie, names those that end at a node. Longer words, and
all words of a unigram vocabulary, are walked depth-first: each character adds
one state to the stack, and a word starts with the states of the prefix it
shares with the one before.

A forward state is the best last piece of the prefix and where that piece
starts. For a unigram vocabulary best is the greatest sum of scores (ties: the
longest last piece). For a BPE vocabulary a sum of scores would not give the
merges' result; there a path is admissible if each two neighbouring pieces,
merged on their own, come out as these two, and every prefix has exactly one
admissible last piece. Both give the ids of the SentencePiece library.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import small_batches

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
CACHE_WORDS = 500_000
LONG = 64
LEVEL_WORDS = 50_000
_CHAR_BITS = 21


class Vocabulary:
    """Pieces of a model file, normal ones by text; no dropped or joined white space."""

    def __init__(self, path: str, bpe: bool = True):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bpe, self.unknown = bpe, model.unk_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: list[int] = [self.unknown] * 256
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.surface.append(b"" if model.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        lengths: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                lengths.setdefault(piece[-2:], set()).add(len(piece))
        # Lengths of the pieces that end in two given characters, longest first.
        self.endings = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self.missing = min(self.scores.values(), default=0.0) - 10.0


class Automaton:
    """Aho-Corasick over pieces: states are their prefixes, the root is 0.

    ``out`` is the longest piece that ends in a state, as a state, or the root;
    ``out[fail[s]]`` the next shorter one after the piece ``s``.
    """

    def __init__(self, ids: dict[str, int]):
        edges: dict[int, int] = {}
        piece, depth = [-1], [0]
        for text, i in ids.items():
            state = 0
            for c in map(ord, text):
                key = state << _CHAR_BITS | c
                to = edges.get(key)
                if to is None:
                    to = edges[key] = len(piece)
                    piece.append(-1)
                    depth.append(depth[state] + 1)
                state = to
            piece[state] = i
        fail, out = [0] * len(piece), [0] * len(piece)
        for key, to in sorted(edges.items(), key=lambda edge: depth[edge[1]]):
            state, c = key >> _CHAR_BITS, key & (1 << _CHAR_BITS) - 1
            while state:
                state = fail[state]
                shorter = edges.get(state << _CHAR_BITS | c)
                if shorter is not None:
                    fail[to] = shorter
                    break
            out[to] = to if piece[to] >= 0 else out[fail[to]]
        self.piece, self.depth = np.array(piece, np.int64), np.array(depth, np.int64)
        self.fail, self.out = np.array(fail, np.int64), np.array(out, np.int64)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        # The last key is above all others, so that every search ends at a key.
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._to = np.append(np.fromiter(edges.values(), np.int64, len(edges))[order], 0)

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        found = np.zeros(len(states), np.int64)
        left = np.arange(len(states))
        while len(left):
            keys = states << _CHAR_BITS | chars[left]
            at = np.searchsorted(self._keys, keys)
            hit = self._keys[at] == keys
            found[left[hit]] = self._to[at[hit]]
            more = ~hit & (states > 0)
            left, states = left[more], self.fail[states[more]]
        return found


class Viterbi:
    """Forward states along sorted words."""

    def __init__(self, vocabulary: Vocabulary, most_pairs: int = 1_000_000):
        self._v, self._most = vocabulary, most_pairs
        self._pairs: dict[tuple[str, str], bool] = {}
        self._coded = {piece: i.to_bytes(4, "little") for piece, i in vocabulary.ids.items()}
        self._alone: dict[str, list[tuple[float, str, str]]] = {}
        if vocabulary.bpe:
            self._automaton = Automaton(vocabulary.ids)
            # A last piece by number: its id, or for a character that is no piece, ``_chars`` and its code point.
            self._texts = {i: piece for piece, i in vocabulary.ids.items()}
            self._chars = len(vocabulary.surface)
            self._start = self._chars + (1 << _CHAR_BITS)
            self._known: dict[int, bool] = {}

    def _merges(self, text: str) -> list[tuple[float, str, str]]:
        """The merges of a piece on its own, best scored neighbours first, then leftmost.

        The score of each, and the first and the last part before it; at the
        end, with no more to merge, minus infinity and these parts.
        """
        known = self._alone.get(text)
        if known is not None:
            return known
        parts, score, found = list(text), self._v.scores.get, []
        joined = [score(a + b, -math.inf) for a, b in pairwise(parts)]
        while True:
            best = max(joined, default=-math.inf)
            found.append((best, parts[0], parts[-1]))
            if best == -math.inf:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score(parts[at - 1] + parts[at], -math.inf)
            if at < len(joined):
                joined[at] = score(parts[at] + parts[at + 1], -math.inf)
        if text in self._coded:
            self._alone[text] = found
        return found

    def _admissible(self, before: str, piece: str) -> bool:
        """Whether the two, merged on their own, stay these two; nothing before: whether the piece forms."""
        if len(self._pairs) > self._most:
            self._pairs.clear()
        known = self._pairs[before, piece] = self._agree(before, piece)
        return known

    def _agree(self, before: str, piece: str) -> bool:
        """The merges of both sides in their common order; the two stay if none across the border comes first."""
        right = self._merges(piece)
        if right[-1][1] != piece:
            return False
        if not before:
            return True
        left = self._merges(before)
        if left[-1][1] != before:
            return False
        score, i, j = self._v.scores.get, 0, 0
        while True:
            (a, _, end), (b, begin, _) = left[i], right[j]
            across = score(end + begin)
            if across is not None and across > a and across >= b:
                return False
            if a >= b:
                if a == -math.inf:
                    return True
                i += 1
            else:
                j += 1

    def encode(self, words: list[str]) -> Iterator[bytes]:
        """Ids, as little-endian 32-bit words, of each of the sorted, distinct ``words``."""
        if not self._v.bpe:
            yield from self._walk(words)
            return
        walked = self._walk([w for w in words if len(w) > LONG])
        for start in range(0, len(words), LEVEL_WORDS):
            part = words[start : start + LEVEL_WORDS]
            coded = self._levels([w for w in part if len(w) <= LONG])
            for word in part:
                yield next(walked if len(word) > LONG else coded)

    def _levels(self, words: list[str]) -> Iterator[bytes]:
        """``encode`` of words of bounded length, by the levels of their trie.

        ``at[n]`` has the node of each word's first n characters. A node's state
        is the number and the length of its best last piece, which leads back to
        the node of the prefix before it.
        """
        if not words:
            return
        automaton = self._automaton
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(lengths) - lengths
        at = np.zeros((lengths.max() + 1, len(words)), np.int32)
        last, length, states = [np.array([self._start])], [np.array([0])], np.array([0])
        base, alive = 0, np.arange(len(words))  # number of the level's first node, words that reach the level
        for end in range(1, len(at)):
            alive = alive[lengths[alive] >= end]
            up, c = at[end - 1, alive], chars[first[alive] + end - 1]
            new = np.ones(len(alive), bool)
            new[1:] = (up[1:] != up[:-1]) | (c[1:] != c[:-1])
            before = base
            base += len(states)
            at[end, alive] = base - 1 + np.cumsum(new)
            states = automaton.step(states[up[new] - before], c[new])
            number, size = self._best(c[new], states, alive[new], end, at, last)
            last.append(number)
            length.append(size)
        yield from self._back(lengths, at, np.concatenate(last), np.concatenate(length))

    def _best(self, chars: np.ndarray, states: np.ndarray, words: np.ndarray, end: int, at: np.ndarray, last: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Number and length of the best last piece of a level's nodes, longest candidates first; ``words`` pass through the nodes."""
        automaton = self._automaton
        number, size = self._chars + chars, np.ones(len(chars), np.int64)
        starts = np.cumsum([0, *map(len, last)])
        left, ending = np.arange(len(chars)), automaton.out[states]
        while True:
            some = ending > 0
            left, ending = left[some], ending[some]
            if not len(left):
                return number, size
            piece, long = automaton.piece[ending], automaton.depth[ending]
            fits = long == 1
            for n in np.unique(long[~fits]).tolist():
                own = np.flatnonzero(long == n)
                before = last[end - n][at[end - n, words[left[own]]] - starts[end - n]]
                fits[own] = self._agreeing(before << 32 | piece[own])
            number[left[fits]], size[left[fits]] = piece[fits], long[fits]
            left, ending = left[~fits], automaton.out[automaton.fail[ending[~fits]]]

    def _agreeing(self, pairs: np.ndarray) -> list[bool]:
        """``_agree`` of pairs of numbers, the first in the upper half."""
        if len(self._known) > self._most:
            self._known.clear()
        keys, known = pairs.tolist(), self._known
        for key in set(keys).difference(known):
            before, piece = key >> 32, key & 0xFFFFFFFF
            text = "" if before == self._start else chr(before - self._chars) if before >= self._chars else self._texts[before]
            known[key] = self._agree(text, self._texts[piece])
        return list(map(known.__getitem__, keys))

    def _back(self, lengths: np.ndarray, at: np.ndarray, last: np.ndarray, length: np.ndarray) -> Iterator[bytes]:
        """The ids of each word, from its last piece back to its first."""
        words, end, found = np.arange(len(lengths)), lengths, []
        count = np.zeros(len(lengths), np.int64)
        while len(words):
            node = at[end, words]
            found.append((words, last[node]))
            count[words] += 1
            end = end - length[node]
            words, end = words[end > 0], end[end > 0]
        stop = np.cumsum(count)
        numbers = np.empty(stop[-1], np.int64)
        for back, (words, number) in enumerate(found, 1):
            numbers[stop[words] - back] = number
        ids, begin = numbers.astype("<i4").tobytes(), 0
        spelled = np.zeros(len(lengths), bool)
        spelled[np.searchsorted(stop, np.flatnonzero(numbers >= self._chars), side="right")] = True
        for stopped, odd in zip(stop.tolist(), spelled.tolist(), strict=True):
            if odd:
                yield b"".join(
                    self._spelled(chr(n - self._chars)) if n >= self._chars else n.to_bytes(4, "little") for n in numbers[begin:stopped].tolist())
            else:
                yield ids[4 * begin : 4 * stopped]
            begin = stopped

    def _walk(self, words: list[str]) -> Iterator[bytes]:
        """``encode`` word by word.

        The states of the current word's prefixes: best last piece, which leads
        back to the prefix before it, and, for sums, their score. Ids are put
        together once a word, so memory is linear in its length.
        """
        last: list[str] = [""]
        total = [0.0]
        previous = ""
        step = self._by_merges if self._v.bpe else self._by_sum
        for word in words:
            shared = 0
            for a, b in zip(previous, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                last.append(step(word, end, last, total))
            previous = word
            ids, end = [], len(word)
            while end:
                piece = last[end]
                known = self._coded.get(piece)
                ids.append(known if known is not None else self._spelled(piece))
                end -= len(piece)
            ids.reverse()
            yield b"".join(ids)

    def _spelled(self, piece: str) -> bytes:
        return b"".join(self._v.bytes[b].to_bytes(4, "little") for b in piece.encode("utf-8", "replace"))

    def _by_merges(self, word: str, end: int, last: list[str], total: list[float]) -> str:
        if end > 1:
            coded, pairs = self._coded, self._pairs
            for length in self._v.endings.get(word[end - 2 : end], ()):
                start = end - length
                if start < 0:
                    continue
                piece = word[start:end]
                if piece in coded:
                    before = last[start]
                    known = pairs.get((before, piece))
                    if known or known is None and self._admissible(before, piece):
                        return piece
        return word[end - 1]

    def _by_sum(self, word: str, end: int, last: list[str], total: list[float]) -> str:
        scores = self._v.scores
        best, chosen = total[end - 1] + scores.get(word[end - 1], self._v.missing), word[end - 1]
        for start in range(end - 2, max(0, end - self._v.longest) - 1, -1):
            score = scores.get(word[start:end])
            if score is not None and total[start] + score >= best:
                best, chosen = total[start] + score, word[start:end]
        total.append(best)
        return chosen


class Encoder:
    """Ids of whole texts; words are cached, ``cache_words`` of them at most."""

    def __init__(self, vocabulary: Vocabulary, cache_words: int = CACHE_WORDS):
        self._viterbi, self._most = Viterbi(vocabulary), cache_words
        self._cache: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Marked words without their first mark."""
        words = text.split(" ")
        if "" in words or MARK in text:
            return [w[1:] for w in _SEGMENT.findall(MARK + text.replace(" ", MARK))]
        return words

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words(t) if t else [] for t in texts]
        if len(self._cache) > self._most:
            self._cache.clear()
        new = sorted(set().union(*split).difference(self._cache))
        for word, ids in zip(new, self._viterbi.encode([MARK + w for w in new]), strict=True):
            self._cache[word] = ids
        return [np.frombuffer(b"".join(map(self._cache.__getitem__, words)), dtype="<i4") for words in split]


def encode(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", bpe: bool = True, batch_texts: int = 1000) -> DataFrame:
    """``keep`` columns and ``ids``, the pieces of the whole text; null and empty texts have none.

    A repeated row is encoded again; other columns are not read, whatever their
    names. ``bpe`` says how the model file's vocabulary was made.
    """
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(model_path, bpe))
        for texts in batches:
            found: list[np.ndarray] = []
            for start in range(0, len(texts), batch_texts):
                found.extend(encoder.encode(list(texts.iloc[start : start + batch_texts])))
            yield pd.Series(found, dtype=object)

    return docs.select(*keep, F.pandas_udf(apply, "array<int>")(F.col(text)).alias("ids"))


ROUND_TRIP = "ids array<int>, restored boolean"


def round_trip(docs: DataFrame, model_path: str, keep: list[str], text: str = "text", bpe: bool = True, batch_texts: int = 1000) -> DataFrame:
    """``encode`` with ``restored``: whether decoding the ids gives the text back, a ``▁`` as a space.

    Both happen in the same task, so that ids cross to Python's side and back
    once and one vocabulary serves both. Null and empty texts are restored.
    """
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(model_path, bpe)
        encoder, surface = Encoder(vocabulary), vocabulary.surface
        for texts in batches:
            found: list[np.ndarray] = []
            same: list[bool] = []
            for start in range(0, len(texts), batch_texts):
                part = list(texts.iloc[start : start + batch_texts])
                ids = encoder.encode(part)
                same.extend(_plain(surface, i) == (t or "").replace(MARK, " ") for i, t in zip(ids, part, strict=True))
                found.extend(ids)
            yield pd.DataFrame({"ids": pd.Series(found, dtype=object), "restored": same})

    return docs.select(*keep, F.pandas_udf(apply, ROUND_TRIP)(F.col(text)).alias("__trip")).select(*keep, "__trip.ids", "__trip.restored")


def decoded(ids: Column, model_path: str) -> Column:
    """The text of pieces: marks are spaces, the first one falls away; null for null.

    Runs of byte pieces are read as UTF-8; a ``▁`` of the original text comes
    back as a space, all else as it was.
    """

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        surface = Vocabulary(model_path).surface
        for rows in batches:
            yield pd.Series([None if r is None else _plain(surface, r) for r in rows], dtype=object)

    return F.pandas_udf(apply, "string")(ids)


def _plain(surface: list[bytes], ids: np.ndarray) -> str:
    text = b"".join(map(surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text.removeprefix(" ")
