"""Subword lattice: all segmentations of words into pieces of a given vocabulary.

Scores are log probabilities; the forward recursion adds the paths in log space, for all
words of one length at once. A word of over LONG bytes goes alone through a recursion that keeps
only as many sums as the longest piece has bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels as K

#: Words of more bytes than this are walked one by one; fitting takes them in parts of it.
LONG = 256
_STEP = K.U64(0x9E3779B97F4A7C15 | 1)
_PRINT = K.U64(0xD6E8FEB86659FD93)
_BLOCK = 1 << 18


def existing_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model, without word marks, upper case and control
    pieces, and all single bytes; their first log probabilities follow the model's own
    scores (merge ranks become Zipf's law)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    best: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", "").encode()
        if piece and not any(65 <= c < 91 for c in piece):
            score = sp.get_score(i)
            best[piece] = max(best.get(piece, -np.inf), score)
    for c in range(256):
        best.setdefault(bytes([c]), -1e6)
    pieces = sorted(best)
    weight = 1.0 / (10.0 + np.array([-min(0.0, best[p]) for p in pieces]))
    return pieces, np.log(weight / weight.sum() * 0.8)


class Lattice:
    """pieces with log probabilities, and that of a word's end."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray, end: float):
        self.pieces, self.end = pieces, end
        self.logp = np.append(logp, -np.inf)  # the last stands for no piece
        self.longest = max(map(len, pieces))
        sums = np.zeros(len(pieces), dtype=K.U64)
        for rows, block in by_length(pieces):
            h = np.zeros(len(rows), dtype=K.U64)
            for column in block.T:
                h = h * _STEP + K.RAW[column]
            sums[rows] = h + K.U64(block.shape[1])
        key = K.mix64(sums)
        self.tables = [np.full(1 << 20, len(pieces), dtype=np.int32) for _ in range(3)]
        self.keys = np.append(key, K.U64(0))
        #: which 20-bit prints of a running hash some piece has: most stretches of a word have none
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._print(sums)] = True
        left = np.arange(len(pieces))
        for t, table in enumerate(self.tables):
            slot = self._slot(key[left], t)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]] = left[first]
            left = np.delete(left, first)
        assert not len(left), "too many pieces"

    @staticmethod
    def _slot(key: np.ndarray, t: int) -> np.ndarray:
        return ((key >> K.U64(44 - 20 * t)) & K.U64((1 << 20) - 1)).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h * _PRINT) >> K.U64(44)).astype(np.int64)

    def _ids(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), len(self.pieces), dtype=np.int32)
        for t, table in enumerate(self.tables):
            i = table[self._slot(key, t)]
            ok = self.keys[i] == key
            out[ok] = i[ok]
        return out

    def edges(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """For each end j: (begin, rows, piece ids) of the pieces words[rows, begin:j] (rows are words)."""
        values = np.ascontiguousarray(K.RAW[words.T])
        running: list[np.ndarray] = []  # hash of words[:, i:j], newest first
        for j in range(1, words.shape[1] + 1):
            new = values[j - 1]
            running = [new, *[h * _STEP + new for h in running[: self.longest - 1]]]
            found = []
            for k, h in enumerate(running):
                h = h + K.U64(k + 1)
                rows = np.flatnonzero(self.maybe[self._print(h)])
                if len(rows):
                    ids = self._ids(K.mix64(h[rows]))
                    real = ids < len(self.pieces)
                    found.append((j - 1 - k, rows[real], ids[real]))
            yield j, found

    def _step(self, alpha: list[np.ndarray], found: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        total = np.full(n, -np.inf)
        for i, rows, ids in found:
            total[rows] = np.logaddexp(total[rows], alpha[i][rows] + self.logp[ids])
        return total

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all segmentations of each row, with the end."""
        alpha = [np.zeros(len(words))]
        for j, found in self.edges(words):
            alpha.append(self._step(alpha, found, len(words)))
            if j >= self.longest:
                alpha[j - self.longest] = None  # no longer reached
        return alpha[-1] + self.end

    def expected(self, words: np.ndarray, counts: np.ndarray) -> None:
        """Adds each piece's expected uses over the rows to counts."""
        n, length = words.shape
        alpha, kept = [np.zeros(n)], []
        for _, found in self.edges(words):
            kept.append(found)
            alpha.append(self._step(alpha, found, n))
        beta = [np.full(n, -np.inf) for _ in range(length)] + [np.zeros(n)]
        uses, which = [], []
        for j in range(length, 0, -1):
            for i, rows, ids in kept[j - 1]:
                path = self.logp[ids] + beta[j][rows]
                uses.append(np.exp(alpha[i][rows] + path - alpha[length][rows]))
                which.append(ids)
                beta[i][rows] = np.logaddexp(beta[i][rows], path)
        counts += np.bincount(np.concatenate(which), weights=np.concatenate(uses), minlength=len(counts))

    def score(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for rows, block in by_length([words[i] for i in short]):
            out[np.array(short)[rows]] = self.forward(block) if block.shape[1] else self.end
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.forward_long(w)
        return out

    def forward_long(self, word: bytes) -> float:
        """forward() of one word, in blocks; the sums in reach are scaled to stay in a double's range."""
        sums = np.zeros(self.longest)  # of the last positions, newest first
        sums[0], log = 1.0, 0.0
        tail = np.zeros(self.longest, dtype=np.uint8)
        for lo in range(0, len(word), 1 << 16):
            part = np.frombuffer(word[lo : lo + (1 << 16)], dtype=np.uint8)
            near = np.concatenate([tail, part])
            h, odds = np.zeros(len(part), dtype=K.U64), np.zeros((len(part), self.longest))
            power = K.U64(1)
            for k in range(self.longest):  # piece of k + 1 bytes ending at each place
                at = self.longest - k
                h = h + K.RAW[near[at : at + len(part)]] * power
                power = K.U64((int(power) * int(_STEP)) & ((1 << 64) - 1))
                odds[:, k] = np.exp(self.logp[self._ids(K.mix64(h + K.U64(k + 1)))])
                odds[: max(0, k - lo), k] = 0.0  # it would begin before the word
            for row in odds:
                total = float(row @ sums)
                sums[1:] = sums[:-1]
                sums[0] = total
                top = float(sums.max())
                if not 1e-100 < top < 1e100:
                    if top == 0.0:
                        return -np.inf
                    sums /= top
                    log += float(np.log(top))
            tail = near[-self.longest :]
        return float(np.log(sums[0])) + log + self.end if sums[0] > 0 else -np.inf


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, byte matrix) of words of equal length, in blocks."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        length = int(size[order[a]])
        step = max(1, _BLOCK // max(1, length))
        for lo in range(a, b, step):
            rows = order[lo : min(b, lo + step)]
            yield rows, np.frombuffer(b"".join([words[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), length)
