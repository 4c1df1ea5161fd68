"""SentencePiece encoding with the N best segmentations, and decoding.

The segmentations of a text are the paths through its lattice of vocabulary
pieces; a path's score is the sum of its pieces' scores. A forward Viterbi pass
gives the exact best score of every prefix. The N best paths come from a
backward A* search from the end of the lattice: the forward score of a node is
its exact heuristic, so partial paths leave the queue in the order of their
completed scores.

No piece holds a word-start mark after another character, nor a line end within,
so the lattice of a text is a chain of the lattices of its words (checked when
the vocabulary is read; else a text is one word). The forward pass runs once for
each distinct word that a worker meets, and not again over what a word shares with the one that sorts before it. It also gives the word's loss, the gap
between its two best paths: only the N - 1 occurrences of least loss can differ
from the best path within the N best, so A* runs on those words and the same
search over their alternatives joins them. The result is
exact, ties aside, for whole texts of any length.

A character outside the vocabulary becomes its UTF-8 bytes' pieces, with a score
below every piece. Defined results: null counts as empty; an empty text has one
segmentation of no pieces with score 0; among equal scores the earlier word keeps
its best path last; repeated rows stay; an empty table gives an empty table. A
text that has the mark U+2581 itself decodes to blanks there. Extra columns are
not carried.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: How far below the lowest piece an unknown character scores.
UNKNOWN_GAP = 10.0
#: Words a worker keeps; beyond, it begins anew.
CACHE = 400_000
#: Ids whose bytes are gathered at once.
GATHERED = 4096
NEVER = -1e300


@dataclass
class Vocabulary:
    """Pieces with ids and scores, the ids of the 256 bytes, and all pieces by id for decoding."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    names: list[str | None]
    longest: int = 0
    unknown: float = 0.0
    by_word: bool = True
    trie: dict[str, tuple] | None = None
    #: The bytes of all ids one after the other, where each id's begin, and how many they are.
    blob: np.ndarray | None = None
    begin: np.ndarray | None = None
    size: np.ndarray | None = None

    @classmethod
    def read(cls, model: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): (i, float(sp.get_score(i))) for i in range(n) if not special[i]}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        names = [None if special[i] else sp.id_to_piece(i) for i in range(n)]
        return cls(pieces, byte_ids, names).prepare()

    def prepare(self) -> Vocabulary:
        self.longest = max(map(len, self.pieces), default=1)
        ordinary = [s for _, s in self.pieces.values() if s > -1e8]
        self.unknown = min(ordinary, default=0.0) - UNKNOWN_GAP
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p, re.S) for p in self.pieces)
        # last character: (score or None, id or -1, the same for the character before)
        self.trie = {}
        for piece, i, score in sorted((p[::-1], i, score) for p, (i, score) in self.pieces.items()):  # ends come before what they end
            level = self.trie
            for c in piece[:-1]:
                level = level.setdefault(c, (None, -1, {}))[2]
            level[piece[-1]] = (score, i, {})
        values = {b: i for i, b in enumerate(self.byte_ids)}
        parts = [name.encode() if name is not None else bytes([values[i]]) if i in values else b"" for i, name in enumerate(self.names)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        return self


def split_words(text: str, voc: Vocabulary) -> list[str]:
    """The words whose lattices make up the text's lattice, in order."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    return _WORD.findall(marked) if voc.by_word else [marked]


_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


#: A character that ends no piece.
_NO_PIECE = (None, -1, None)


def forward(word: str, voc: Vocabulary) -> tuple[list[float], list[int], list[int], float]:
    """Best score of each prefix, where its last piece begins and that piece's id (-1: bytes), and the loss: best less second best path."""
    return next(forward_each([word], voc))


def forward_each(words: list[str], voc: Vocabulary) -> Iterator[tuple[list[float], list[int], list[int], float]]:
    """forward() of each word, in lists that the next one changes.

    A prefix is settled by the pieces that end at it, so what a word shares with the one before it stays: sorted words share most.
    """
    root, unknown, before = voc.trie, voc.unknown, ""
    best, second, back, last = [0.0], [NEVER], [0], [-1]
    for word in words:
        n, same = len(word), 0
        for c, d in zip(word, before):  # noqa: B905
            if c != d:
                break
            same += 1
        before = word
        del best[same + 1 :], second[same + 1 :], back[same + 1 :], last[same + 1 :]
        for at in range(same, n):
            # a single character is always a piece: its own, or its bytes
            s, own, children = root.get(word[at], _NO_PIECE)
            if s is None:
                s = unknown
            top, two, begin, a = best[at] + s, second[at] + s, at, at
            while children and a:
                a -= 1
                c = word[a]
                if c not in children:
                    break
                s, i, children = children[c]
                if s is not None:
                    x = best[a] + s
                    if x >= top:  # of equal paths the one whose last piece is longest
                        y = second[a] + s
                        two = top if top > y else y
                        top, begin, own = x, a, i
                    elif x > two:
                        two = x
            best.append(top)
            second.append(two)
            back.append(begin)
            last.append(own)
        yield best, back, last, best[n] - second[n] if second[n] > -1e200 else float("inf")


def path_ids(word: str, cuts: list[int], voc: Vocabulary) -> list[int]:
    """Piece ids of the segments between cuts (from 0 to the word's length)."""
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        p = voc.pieces.get(word[a:b])
        out += [p[0]] if p else [voc.byte_ids[x] for x in word[a:b].encode("utf-8", "surrogatepass")]
    return out


def a_star(word: str, n_best: int, voc: Vocabulary) -> list[tuple[float, list[int]]]:
    """The n best (score, cuts) of a word: backward search with the forward scores as exact heuristic.

    Scores that differ by less than 1e-6 count as ties, and of tied partial paths
    the longest goes first: a run of one character has as many tied paths as
    places for its odd piece. Partial paths share their tails.
    """
    ahead = forward(word, voc)[0]
    queue, out, tie = [(-round(ahead[-1], 6), len(word), 0, 0.0, (len(word), None))], [], 0
    while queue and len(out) < n_best:
        _, at, _, tail, path = heapq.heappop(queue)
        if at == 0:
            cuts = []
            while path:
                cuts.append(path[0])
                path = path[1]
            out.append((tail, cuts))
            continue
        for a in range(max(0, at - voc.longest), at):
            piece = voc.pieces.get(word[a:at])
            if piece is None and a < at - 1:
                continue
            done = tail + (piece[1] if piece else voc.unknown)
            tie += 1
            heapq.heappush(queue, (-round(ahead[a] + done, 6), a, tie, done, (a, path)))
    return sorted(out, key=lambda x: -x[0])


class Segmenter:
    """Caches words within a worker."""

    def __init__(self, voc: Vocabulary, n_best: int):
        self.voc, self.n_best = voc, n_best
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.others: dict[str, list] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > CACHE and len(self.at) + len(words.difference(self.at)) > CACHE:
            self._clear()
        score, loss, count, ids = [], [], [], []
        new = sorted(words.difference(self.at))
        for w, (best, back, last, gap) in zip(new, forward_each(new, self.voc), strict=True):
            own, at = [], len(w)
            while at:
                if last[at] >= 0:
                    own.append(last[at])
                else:
                    own.extend([self.voc.byte_ids[x] for x in reversed(w[at - 1].encode("utf-8", "surrogatepass"))])
                at = back[at]
            own.reverse()
            score.append(best[-1])
            loss.append(gap)
            count.append(len(own))
            ids += own
            self.at[w] = len(self.at)
        if score:
            self.score, self.loss, self.ids = np.r_[self.score, score], np.r_[self.loss, loss], np.r_[self.ids, np.array(ids, np.int32)]
            self.begin = np.r_[self.begin, self.begin[-1] + np.cumsum(count, dtype=np.int64)]

    def alternatives(self, word: str) -> list[tuple[float, list[int]]]:
        """(loss, ids) of the best paths of a word."""
        if word not in self.others:
            got = a_star(word, self.n_best, self.voc)
            self.others[word] = [(got[0][0] - s, path_ids(word, cuts, self.voc)) for s, cuts in got]
        return self.others[word]

    def segment(self, words: list[str]) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids); learn() has seen the words."""
        if not words:
            return [(0.0, np.zeros(0, np.int32))]
        index = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        count = self.begin[index + 1] - self.begin[index]
        start = np.r_[0, np.cumsum(count)]
        best = self.ids[np.repeat(self.begin[index] - start[:-1], count) + np.arange(start[-1])]
        total = float(self.score[index].sum())
        out = [(total, best)]
        loss = self.loss[index]
        few = np.flatnonzero(loss <= (np.partition(loss, self.n_best - 2)[self.n_best - 2] if len(loss) >= self.n_best else np.inf))
        few = few[np.argsort(loss[few], kind="stable")][: self.n_best - 1]
        few = [int(i) for i in few if np.isfinite(loss[i])]
        if self.n_best < 2 or not few:
            return out
        lists = [self.alternatives(words[i]) for i in few]
        queue, seen = [(0.0, (0,) * len(few))], {(0,) * len(few)}
        while queue and len(out) <= self.n_best:
            cost, choice = heapq.heappop(queue)
            if any(choice):
                ids, at = [], 0
                for i, c, alts in sorted(zip(few, choice, lists, strict=True)):
                    if c:
                        ids += [best[at : start[i]], np.array(alts[c][1], np.int32)]
                        at = start[i + 1]
                out.append((total - cost, np.concatenate([*ids, best[at:]])))
            for j in range(len(few)):
                if choice[j] + 1 < len(lists[j]):
                    nxt = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(queue, (cost - lists[j][choice[j]][0] + lists[j][choice[j] + 1][0], nxt))
        return out[: self.n_best]


def decode(ids: list[int] | np.ndarray, voc: Vocabulary) -> str:
    """The text of piece ids: bytes joined, marks to blanks, the first mark dropped."""
    return next(decode_rows([np.asarray(ids, np.int64)], voc))


def decode_rows(rows: list[np.ndarray], voc: Vocabulary) -> Iterator[str]:
    """The text of each row of piece ids; the bytes of some rows are gathered at once, few enough for a core's cache."""
    at = 0
    while at < len(rows):
        own, n = [], 0
        while at < len(rows) and (not own or n < GATHERED):
            own.append(rows[at])
            n += len(rows[at])
            at += 1
        ids = np.concatenate(own)
        size = voc.size[ids]
        end = np.r_[0, np.cumsum(size)]
        data = voc.blob[np.repeat(voc.begin[ids] - end[:-1], size) + np.arange(end[-1])].tobytes()
        cuts = end[np.cumsum([0, *map(len, own)])].tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            text = data[lo:hi].decode("utf-8", "replace").replace(MARK, " ")
            yield text[1:] if text[:1] == " " else text


_kept: dict[tuple, Segmenter] = {}


def encode(docs: DataFrame, model: str, *, n_best: int = 3, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, rank, score, n_pieces, ids) of the n best segmentations; digest: in place of the ids their sha256, that of the text they decode to, and whether that is the text."""
    voc = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model))
    with open(model, "rb") as f:
        mark = hashlib.sha256(f.read()).hexdigest()  # a changed file is another vocabulary
    last = "ids_sha256 string, text_sha256 string, round_trip boolean" if digest else "ids array<int>"

    def digests(found: list[tuple], texts: list[str]) -> list[tuple]:
        decoded = decode_rows([x[-1] for x in found], voc.value)
        hashed = lambda data: hashlib.sha256(data).hexdigest()
        return [(*x[:-1], hashed(x[-1].astype("<i4").tobytes()), hashed(text.encode()), text == t) for x, text, t in zip(found, decoded, texts, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _kept.setdefault((mark, n_best), Segmenter(voc.value, n_best))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, ids, own, size = [], [], [], 0
                while at < batch.num_rows and size < 500_000:
                    t = batch.column(1)[at].as_py() or ""
                    texts.append(split_words(t, seg.voc))
                    ids.append(batch.column(0)[at].as_py())
                    own.append(t)
                    size += len(t)
                    at += 1
                seg.learn(set().union(*texts))
                found = [seg.segment(ws) for ws in texts]
                out = [(i, r + 1, s, len(x), x) for i, best in zip(ids, found, strict=True) for r, (s, x) in enumerate(best)]
                if digest:
                    out = digests(out, [t for t, best in zip(own, found, strict=True) for _ in best])
                c = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), *([pa.string(), pa.string(), pa.bool_()] if digest else [pa.list_(pa.int32())])]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=[key, "rank", "score", "n_pieces", *(x.split()[0] for x in last.split(", "))])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, f"{key} long, rank int, score double, n_pieces long, {last}")


def decode_all(encoded: DataFrame, model: str, *, key: str = "doc_id") -> DataFrame:
    """(key, text) of each row of ids."""
    voc = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x.as_py() or [], np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(decode_rows(rows, voc.value)), pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).cast("long"), "ids").mapInArrow(run, f"{key} long, text string")
