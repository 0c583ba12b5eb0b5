"""The piece lattice of a unigram vocabulary, and its best segmentations."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np

SPACE = "▁"
_NONE = float("-inf")
#: Characters of the longest parts that are searched together with others.
TOGETHER = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, the ids of the 256 byte pieces (empty: no byte fallback), and the id of unknown."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    ids: tuple[int, ...]
    byte_ids: tuple[int, ...]
    unknown: int
    #: What decoding writes for each id.
    written: tuple[bytes, ...] = field(repr=False)

    @property
    def unknown_score(self) -> float:
        """An unknown character costs 10 more than the worst piece, by the tokenizer's rule."""
        return min(self.scores, default=0.0) - 10.0


def load(path: str) -> Vocabulary:
    """The vocabulary of a SentencePiece model file, read on the driver; control pieces match no text.

    The pieces and scores are used as a unigram model whatever the file's own kind.
    Files with user-defined pieces or a normalisation other than marking blanks are
    refused, since texts would be changed before the lattice is made.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    if model.normalize("ﬁ Ａ  b") != "▁ﬁ▁Ａ▁▁b":
        raise ValueError("the model's normalisation is more than marking blanks")
    normal = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_of = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
    written = []
    for i in size:
        piece = model.id_to_piece(i)
        written.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace(SPACE, " ").encode())
    return Vocabulary(
        tuple(model.id_to_piece(i) for i in normal),
        tuple(model.get_score(i) for i in normal),
        tuple(normal),
        tuple(byte_of[b] for b in range(256)) if len(byte_of) == 256 else (),
        model.unk_id(),
        tuple(written),
    )


def marked(text: str | None) -> str:
    """The text with blanks marked and one mark in front; nothing for no text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def splitter(vocabulary: Vocabulary) -> Callable[[str], list[str]]:
    """Cuts a marked text where no piece can reach across, so that each part has its own lattice.

    A part starts at a run of marks, and a line end stands alone, as far as the
    vocabulary has no piece that crosses there; else the text is one part. Without
    byte pieces a run of unknown characters is one piece, so the character
    at a cut must be known too.
    """
    bytes_left = bool(vocabulary.byte_ids)
    lines = not any("\n" in p for p in vocabulary.pieces if p != "\n") and (bytes_left or "\n" in vocabulary.pieces)
    marks = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in vocabulary.pieces) and (bytes_left or SPACE in vocabulary.pieces)
    if lines and marks:
        return re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
    if lines:
        return re.compile("\n|[^\n]+").findall
    if marks:
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
    return lambda text: [text] if text else []


class Lattice:
    """Best segmentations of parts of texts; an automaton finds all pieces that end at each place.

    Scores add up in double precision. Among equal scores the tokenizer's rule holds:
    at each end, from the last one back, the longest piece. Unknown characters are their
    byte pieces; without those, a run of them is one unknown piece, whose score is the sum.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score, piece_id in zip(vocabulary.pieces, vocabulary.scores, vocabulary.ids):
            self.automaton.add_word(piece, (len(piece), score, piece_id))
        self.automaton.make_automaton()
        # The same pieces by number, for many parts at once.
        self.numbers = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, piece in enumerate(vocabulary.pieces):
            self.numbers.add_word(piece, number)
        self.numbers.make_automaton()
        self.lengths, self.scores = np.array([len(p) for p in vocabulary.pieces], np.int32), np.array(vocabulary.scores, float)
        self.ids = np.array(vocabulary.ids, np.int32)
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        self.unknown_score = vocabulary.unknown_score

    def unknown_ids(self, char: str) -> tuple[int, ...]:
        byte_ids = self.vocabulary.byte_ids
        return tuple(byte_ids[b] for b in char.encode("utf-8", "surrogatepass")) if byte_ids else (self.vocabulary.unknown,)

    def merged(self, pieces: list[tuple[int, ...]]) -> tuple[int, ...]:
        """The ids of a path; without byte pieces, adjacent unknown characters are one piece."""
        ids = [i for piece in pieces for i in piece]
        if self.vocabulary.byte_ids:
            return tuple(ids)
        unknown = self.vocabulary.unknown
        return tuple(i for k, i in enumerate(ids) if i != unknown or not k or ids[k - 1] != unknown)

    def count(self, part: str) -> tuple[int, float]:
        """Number of pieces and score of the best segmentation; only the two are carried forward."""
        n = len(part)
        best, pieces, open_run = [0.0] + [_NONE] * n, [0] * (n + 1), [False] * (n + 1)
        single, unknown, at, merge = self.single, self.unknown_score, 1, not self.vocabulary.byte_ids

        def skip(at: int) -> None:
            # All pieces that end here are seen: an unknown character may end here too.
            char = part[at - 1]
            if char not in single and best[at - 1] + unknown > best[at]:
                best[at], open_run[at] = best[at - 1] + unknown, True
                pieces[at] = pieces[at - 1] + (0 if merge and open_run[at - 1] else len(self.unknown_ids(char)))

        for last, (length, score, _) in self.automaton.iter(part):
            end = last + 1
            while at < end:
                skip(at)
                at += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], pieces[end] = total, pieces[end - length] + 1
        while at <= n:
            skip(at)
            at += 1
        return pieces[n], best[n]

    def edges(self, part: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the pieces that end there: start, score and ids, the longest first."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(part) + 1)]
        for last, (length, score, piece_id) in self.automaton.iter(part):
            into[last + 1].append((last + 1 - length, score, (piece_id,)))
        for at, char in enumerate(part):
            if char not in self.single:
                into[at + 1].append((at, self.unknown_score, self.unknown_ids(char)))
        return into

    def best(self, part: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best segmentation, and by how much the second is worse (0 or less).

        The second leaves the best path, seen from the end, at one of its places, by
        the second-best edge there; so the gap needs no search.
        """
        n = len(part)
        forward, second, back = [0.0] + [_NONE] * n, [_NONE] * (n + 1), [None] * (n + 1)
        single, unknown, at = self.single, self.unknown_score, 1
        for last, edge in self.automaton.iter(part):
            end = last + 1
            while at < end:
                if part[at - 1] not in single:
                    self._unknown_edge(part, at, unknown, forward, second, back)
                at += 1
            total = forward[end - edge[0]] + edge[1]
            if total > forward[end]:
                second[end], forward[end], back[end] = forward[end], total, edge
            elif total > second[end]:
                second[end] = total
        while at <= n:
            if part[at - 1] not in single:
                self._unknown_edge(part, at, unknown, forward, second, back)
            at += 1
        pieces, least, at = [], _NONE, n
        while at:
            least = max(least, second[at] - forward[at])
            length, _, piece = back[at]
            pieces.append(piece if length == 0 else (piece,))
            at -= length or 1
        pieces.reverse()
        return forward[n], self.merged(pieces), least

    def best_of_all(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`best` of many parts: scores, gaps, ends of each part's ids, and all ids.

        Parts without unknown characters advance together, a character at a time; long
        ones and those with unknown characters go one by one.
        """
        known = self.single.issuperset
        fits = [len(p) <= TOGETHER and known(p) for p in parts]
        together = np.flatnonzero(np.array(fits, bool))
        scores, gaps = np.empty(len(parts)), np.empty(len(parts))
        sizes = np.zeros(len(parts), np.int64)
        order, ids = [], []
        if len(together):
            scores[together], gaps[together], owner, own = self._viterbi([p for p, fit in zip(parts, fits) if fit])
            sizes[together] = np.bincount(owner, minlength=len(together))
            order.append(together[owner])
            ids.append(own)
        for k in [k for k, fit in enumerate(fits) if not fit]:
            scores[k], found, gaps[k] = self.best(parts[k])
            sizes[k] = len(found)
            order.append(np.full(len(found), k))
            ids.append(np.array(found, np.int32))
        if not parts:
            return scores, gaps, np.zeros(1, np.int64), np.zeros(0, np.int32)
        place = np.argsort(np.concatenate(order), kind="stable")
        return scores, gaps, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(ids)[place]

    def _viterbi(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, gaps, and the ids of all parts in order with the part of each."""
        sizes = np.array([len(p) for p in parts], np.int64)
        # A part has a node before each character and one at its end.
        first = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        # Place of the last character and number of a piece, in turn.
        matches = np.fromiter(chain.from_iterable(self.numbers.iter("".join(parts))), np.int32)
        last, piece = matches[0::2], matches[1::2]
        depth = (np.arange(1, len(owner) + 1) - (first - np.arange(len(parts)))[owner]).astype(np.int16)[last]
        # Pieces that begin in an earlier part don't count. Stable: at each node the longest piece stays first, as the automaton names it.
        inside = np.flatnonzero(self.lengths[piece] <= depth)
        inside = inside[np.argsort(depth[inside], kind="stable")]
        last, piece, depth = last[inside], piece[inside], depth[inside]
        end = last + 1 + owner[last]
        begin = end - self.lengths[piece]
        levels = np.concatenate([[0], np.cumsum(np.bincount(depth)[1:])])
        forward, gap, back = np.zeros(len(owner) + len(parts)), np.zeros(len(owner) + len(parts)), np.zeros(len(owner) + len(parts), np.int64)
        score = self.scores[piece]
        for a, b in zip(levels, levels[1:]):
            node = end[a:b]
            total = forward[begin[a:b]] + score[a:b]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            best = np.maximum.reduceat(total, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, b - a)))
            ties = np.flatnonzero(total == best[group])
            # Written from the last to the first, so the first of equal ones stays.
            winner = np.empty(len(heads), np.int64)
            winner[group[ties][::-1]] = ties[::-1]
            total[winner] = _NONE
            nodes = node[heads]
            forward[nodes], gap[nodes], back[nodes] = best, np.maximum.reduceat(total, heads) - best, piece[a:b][winner]
        at, going = first + sizes, np.flatnonzero(sizes > 0)
        least, owners, pieces = np.full(len(parts), _NONE), [], []
        scores = forward[at]
        while len(going):
            here = at[going]
            least[going] = np.maximum(least[going], gap[here])
            owners.append(going)
            pieces.append(back[here])
            at[going] -= self.lengths[back[here]]
            going = going[at[going] > first[going]]
        if not owners:
            return scores, least, np.zeros(0, np.int64), np.zeros(0, np.int32)
        # Paths were walked from the end.
        owners, pieces = np.concatenate(owners[::-1]), np.concatenate(pieces[::-1])
        place = np.argsort(owners, kind="stable")
        return scores, least, owners[place], self.ids[pieces[place]]

    def _unknown_edge(self, part: str, at: int, unknown: float, forward: list, second: list, back: list) -> None:
        """An unknown character as the last edge into a place; length 0 marks it."""
        total = forward[at - 1] + unknown
        if total > forward[at]:
            second[at], forward[at], back[at] = forward[at], total, (0, unknown, self.unknown_ids(part[at - 1]))
        elif total > second[at]:
            second[at] = total

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids), best first, by A-star from the end.

        The forward Viterbi scores are what the rest of a path costs at best, exactly,
        so complete paths leave the agenda in the order of their scores. Of equal scores
        the tokenizer's choice comes first.
        """
        into = self.edges(part)
        forward = [0.0] + [_NONE] * len(part)
        for end in range(1, len(part) + 1):
            forward[end] = max((forward[start] + score for start, score, _ in into[end]), default=_NONE)
        # Loss of the whole path, age (the youngest of equals first), place, score and pieces of its tail.
        agenda: list[tuple] = [(-forward[-1], 0, len(part), 0.0, None)]
        found, age = [], 0
        while agenda and len(found) < n:
            _, _, at, tail, pieces = heapq.heappop(agenda)
            if at == 0:
                path = []
                while pieces:
                    path.append(pieces[0])
                    pieces = pieces[1]
                found.append((tail, self.merged(path)))
                continue
            for start, score, piece in reversed(into[at]):
                age -= 1
                heapq.heappush(agenda, (-(forward[start] + score + tail), age, start, tail + score, (piece, pieces)))
        return found
