"""Subword lattices of words: marginal probability over all segmentations.

A word is spelled by one starting piece of an existing vocabulary and any
number of continuing pieces (or single bytes).  The forward recursion, in log
space, sums over all ways to do so; forward and backward together give expected
piece counts, from which the unigram scores are re-estimated.  A word may be a
piece of its own too, an arc from its start to its end.  Words of one length are
worked on together, very long ones one by one in time linear in their bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from marginalia.llm.textblocks import BYTE_VALUE, powers
from marginalia.llm.tokens import vocabulary

U64 = np.uint64
_SPREAD = U64(0xD6E8FEB86659FD93)
NEVER = -1e30
#: Words of more bytes are worked on one by one, arc by arc.
LONG = 1024


def substring_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[raw] * p[:-1], out=sums[1:])
    return sums, inverse


class HashTable:
    """Places of 64-bit keys; two slots a key, what fits in neither is searched for."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.shift = keys.astype(np.uint64), U64(64 - bits)
        self.one, self.two = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
        at = np.arange(len(keys), dtype=np.int32)
        slot = self._first(self.keys)
        self.one[slot[::-1]] = at[::-1]
        rest = at[self.one[slot] != at]
        slot = self._second(self.keys[rest])
        self.two[slot[::-1]] = rest[::-1]
        rest = rest[self.two[slot] != rest]
        self.rest = rest[np.argsort(self.keys[rest])]

    def _first(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> self.shift).astype(np.int64)

    def _second(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> U64(29))) * U64(0x94D049BB133111EB)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        got = self.one[self._first(h)]
        lost = np.flatnonzero((got < 0) | (self.keys[got] != h))
        got[lost] = -1
        if len(lost):
            own = h[lost]
            second = self.two[self._second(own)]
            hit = (second >= 0) & (self.keys[second] == own)
            got[lost[hit]] = second[hit]
            if len(self.rest):
                own, lost = own[~hit], lost[~hit]
                keys = self.keys[self.rest]
                k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[k] == own
                got[lost[hit]] = self.rest[k[hit]]
        return got


def _sums(begin: np.ndarray, end: np.ndarray, score: np.ndarray, n: int, first: dict[int, float]) -> np.ndarray:
    """log-space sums over paths of arcs in order of ``end``, from the scores of ``first`` places."""
    out = [NEVER] * (n + 1)
    for t, x in first.items():
        out[t] = x
    exp, log1p = math.exp, math.log1p
    for a, b, x in zip(begin.tolist(), end.tolist(), score.tolist(), strict=True):
        x, y = out[a] + x, out[b]
        if x < y:
            x, y = y, x
        out[b] = x + log1p(exp(y - x)) if y > x - 40 else x
    return np.array(out)


@dataclass
class Pieces:
    """Spellings of a vocabulary's starting and continuing pieces, and their rank there."""

    start: list[bytes]
    start_rank: np.ndarray
    cont: list[bytes]
    cont_rank: np.ndarray

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        """From a SentencePiece model file; pieces that no lower-cased word holds are left out.

        Continuing pieces end with the 256 single bytes, the fallback of the vocabulary.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary("piece_bpe_32k.model"))
        start, cont = {}, {}
        for k in range(sp.get_piece_size()):
            if sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k):
                continue
            piece = sp.id_to_piece(k)
            into, text = (start, piece[1:]) if piece.startswith("▁") else (cont, piece)
            if text and "▁" not in text and not any("A" <= c <= "Z" or c in " \t\n\r\v\f" for c in text):
                into.setdefault(text.encode(), k)
        for b in range(256):
            cont.setdefault(bytes([b]), sp.get_piece_size() + b)
        return cls(list(start), np.array(list(start.values())), list(cont), np.array(list(cont.values())))


class Lattice:
    """A unigram model over pieces; ``empty`` starts a word that begins with a continuing piece."""

    def __init__(self, pieces: Pieces, start: np.ndarray, empty: float, cont: np.ndarray, stop: float):
        self.pieces = pieces
        self.log_start, self.log_cont = np.log(start), np.log(cont)
        self.log_empty, self.log_go, self.log_stop = float(np.log(empty)), float(np.log1p(-stop)), float(np.log(stop))
        self.prepare()

    @classmethod
    def initial(cls, pieces: Pieces) -> Lattice:
        """Zipf's law over the vocabulary's own order, which is all that its scores tell."""
        start, cont = 1 / (pieces.start_rank + 10.0), 1 / (pieces.cont_rank + 10.0)
        return cls(pieces, 0.9 * start / start.sum(), 0.1, cont / cont.sum(), 0.4)

    def prepare(self) -> None:
        self.tables = []
        for spelled in (self.pieces.start, self.pieces.cont):
            raw = np.frombuffer(b"".join(spelled), dtype=np.uint8)
            end = np.cumsum([len(s) for s in spelled])
            start = end - [len(s) for s in spelled]
            sums, inverse = substring_hash(raw)
            h = (sums[end] - sums[start]) * inverse[start]
            self.tables.append(HashTable(h, 18))
        self.lengths = [sorted({len(s) for s in spelled}) for spelled in (self.pieces.start, self.pieces.cont)]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("tables", "lengths")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.prepare()

    def arcs(self, raw: np.ndarray, begin: np.ndarray, n: int) -> tuple[dict, dict]:
        """By length, piece places (-1: none) of the words of ``n`` bytes from ``begin``: at the start, and at each offset."""
        sums, inverse = substring_hash(raw)
        starts = {k: self.tables[0].find((sums[begin + k] - sums[begin]) * inverse[begin]) for k in self.lengths[0] if k <= n}
        conts = {}
        for k in self.lengths[1]:
            if k <= n:
                at = begin[:, None] + np.arange(n - k + 1)[None]
                conts[k] = self.tables[1].find(((sums[at + k] - sums[at]) * inverse[at]).ravel()).reshape(at.shape)
        return starts, conts

    def forward(self, starts: dict, conts: dict, count: int, n: int) -> np.ndarray:
        """log-space sums over all paths from the start to each offset; the last column still lacks the stop."""
        alpha = np.full((count, n + 1), NEVER)
        alpha[:, 0] = self.log_empty - self.log_go
        for t in range(1, n + 1):
            terms = []
            if t in starts:
                own = starts[t]
                terms.append(np.where(own >= 0, self.log_start[own], NEVER))
            for k, ids in conts.items():
                if k <= t:
                    own = ids[:, t - k]
                    if (own >= 0).any():
                        terms.append(np.where(own >= 0, self.log_cont[own], NEVER) + (self.log_go + alpha[:, t - k]))
            stacked = np.stack(terms)
            top = stacked.max(axis=0)
            alpha[:, t] = top + np.log(np.exp(stacked - top).sum(axis=0))
        return alpha

    def walk(self, starts: dict, conts: dict, n: int, backward: bool = False) -> tuple[np.ndarray, ...]:
        """The same sums for one long word, arc by arc: alpha, and with ``backward`` beta and the arcs (begin, end, place)."""
        begin, end, place = self._listed(conts, n)
        order = np.argsort(end, kind="stable")
        begin, end, place = begin[order], end[order], place[order]
        score = self.log_cont[place] + self.log_go
        first = {k: float(self.log_start[ids[0]]) for k, ids in starts.items() if ids[0] >= 0}
        alpha = _sums(begin, end, score, n, {0: self.log_empty - self.log_go} | first)
        if not backward:
            return (alpha,)
        order = np.argsort(-begin, kind="stable")
        beta = _sums(n - end[order], n - begin[order], score[order], n, {0: 0.0})[::-1]
        return alpha, beta, begin, end, place

    @staticmethod
    def _listed(conts: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and place of all continuing arcs of one word."""
        found = [(np.flatnonzero(ids[0] >= 0), k) for k, ids in conts.items()]
        begin = np.concatenate([at for at, _ in found])
        end = np.concatenate([at + k for at, k in found])
        return begin, end, np.concatenate([conts[k][0][at] for at, k in found])

    def _groups(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray):
        length = end - begin
        order = np.argsort(length, kind="stable")
        edge = np.append(np.flatnonzero(np.append(True, np.diff(length[order]) > 0)), len(order)) if len(order) else np.zeros(1, int)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            n = int(length[order[lo]])
            step = 1 if n > LONG else max(1, (1 << 18) // max(n, 1))
            for at in range(lo, hi, step):
                own = order[at : min(at + step, hi)]
                # The bytes of these words side by side, so that no work grows with the block.
                index = begin[own][:, None] + np.arange(n)[None]
                yield own, raw[index].ravel(), np.arange(len(own)) * n, n

    def log10(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray | None = None, free: float = 0.0) -> np.ndarray:
        """log10 of the marginal probability of each (non-empty) word.

        ``whole``: natural-log score of the arc that spans the word, where the
        word itself is one more piece of the vocabulary (``NEVER`` where it is
        not); ``free`` is then the natural log of what is left to the others.
        """
        out = np.empty(len(begin))
        for own, text, at, n in self._groups(raw, begin, end):
            arcs = self.arcs(text, at, n)
            alpha = self.walk(*arcs, n)[0][None] if n > LONG else self.forward(*arcs, len(own), n)
            total = alpha[:, n] + self.log_stop
            out[own] = total if whole is None else np.logaddexp(whole[own], free + total)
        return out / np.log(10)

    def expected(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected uses of starting pieces (the empty start last) and continuing pieces, and the weight of words."""
        start, cont = np.zeros(len(self.pieces.start) + 1), np.zeros(len(self.pieces.cont))
        for own, text, at, n in self._groups(raw, begin, end):
            starts, conts = self.arcs(text, at, n)
            w = weight[own]
            if n > LONG:
                alpha, beta, left, right, place = self.walk(starts, conts, n, backward=True)
                share = np.exp(np.minimum(alpha[left] + self.log_cont[place] + self.log_go + beta[right] - alpha[n], 0.0))
                cont += np.bincount(place, share * w[0], minlength=len(cont))
                alpha, beta = alpha[None], beta[None]
            else:
                alpha = self.forward(starts, conts, len(own), n)
                beta = np.full((len(own), n + 1), NEVER)
                beta[:, n] = 0
                used, shares = [], []
                for t in range(n - 1, -1, -1):
                    terms = []
                    for k, ids in conts.items():
                        if t + k <= n:
                            hit = np.flatnonzero(ids[:, t] >= 0)
                            if not len(hit):
                                continue
                            own_ids = ids[hit, t]
                            arc = np.full(len(own), NEVER)
                            arc[hit] = self.log_cont[own_ids] + (self.log_go + beta[hit, t + k])
                            terms.append(arc)
                            used.append(own_ids)
                            shares.append(np.exp(np.minimum(alpha[hit, t] + arc[hit] - alpha[hit, n], 0.0)) * w[hit])
                    stacked = np.stack(terms)
                    top = stacked.max(axis=0)
                    beta[:, t] = top + np.log(np.exp(stacked - top).sum(axis=0))
                # One count a group of words: each costs the length of the vocabulary.
                cont += np.bincount(np.concatenate(used), np.concatenate(shares), minlength=len(cont))
            total = alpha[:, n]
            for k, ids in starts.items():
                hit = ids >= 0
                share = np.exp(np.minimum(self.log_start[ids[hit]] + beta[hit, k] - total[hit], 0.0)) * w[hit]
                np.add.at(start, ids[hit], share)
            start[-1] += (np.exp(np.minimum(alpha[:, 0] + beta[:, 0] - total, 0.0)) * w).sum()
        return start, cont, float(weight.sum())

    def refit(self, start: np.ndarray, cont: np.ndarray, words: float, prior: float = 100.0) -> Lattice:
        """Unigram scores from expected counts, with ``prior`` counts spread as they were."""
        s = start[:-1] + prior * np.exp(self.log_start)
        empty = start[-1] + prior * np.exp(self.log_empty)
        c = cont + prior * np.exp(self.log_cont)
        inner = max(cont.sum() - start[-1], 0.0)  # the piece after an empty start is no going on
        stop = (words + 1) / (words + inner + 2)
        total = s.sum() + empty
        return Lattice(self.pieces, s / total, empty / total, c / c.sum(), stop)
