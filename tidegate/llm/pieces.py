"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text becomes marked words (a run of word marks and what follows it up to the next mark, parted also at
white space that no piece holds). The distinct ones of a block are sorted, which lays out their trie, and
are walked depth-first: each word keeps the forward states of the prefix it shares with the one before and only
the rest is computed.

The forward state of a prefix depends on the kind of model. Unigram: the best score and the start of its
last piece (Viterbi). BPE: the start of the last piece of the prefix's own encoding. Greedy merging has no
best score, so Viterbi would not give the library's pieces there, but the last piece can be told the same way,
from left to right: it is the only piece t for which the encoding of what comes before t ends in a piece u with
merge(u + t) = [u, t]. Nothing that merges inside the parts can then merge across.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegate.llm import _worker
from tidegate.llm._scratch import small_batches

MARK = "▁"
#: Characters of text handled at a time; words and piece pairs remembered by a worker.
BLOCK_CHARS, WORDS_KEPT, PAIRS_KEPT = 1 << 20, 300_000, 400_000
#: Kinds of model and of piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs below the lowest score, as the library has it.
UNKNOWN_PENALTY = 10.0


def _alike(a: str, b: str) -> int:
    """Characters that both begin with, found by halves."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0  # the first lo characters are equal, the first hi aren't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Model:
    def __init__(self, serialized: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(serialized)
        self.kind, self.library = m.trainer_spec.model_type, SentencePieceProcessor(model_proto=serialized)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        if any(p.type == USER for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.spec = m.normalizer_spec
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = [p.score for p in m.pieces]
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.bytes_of = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.chars = set(chain.from_iterable(self.ids))
        self.raw = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else m.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        apart = "".join(c for c in "\n\t\r\x0b\x0c" if c not in self.chars)
        self.word = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark inside: words can't be told apart")
        self.pairs: dict[int, dict[int, bool]] = {-1: {}}  # by left piece, -1 for none, and right piece
        self.n_pairs = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.backward: list = [{}, -1]  # pieces from last character to first: children and id
        for p, k in self.ids.items():
            node = self.backward
            for c in reversed(p):
                node = node[0].setdefault(c, [{}, -1])
            node[1] = k
        self.piece = {k: p for p, k in self.ids.items()}
        self.n_strange = 0
        for c in sorted(self.chars - set(self.ids)):
            self._strange(c)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.spec.precompiled_charsmap or self.spec.remove_extra_whitespaces:
            return self.word.findall(self.library.normalize(text))
        return self.word.findall((MARK if self.spec.add_dummy_prefix else "") + text.replace(" ", MARK))

    def merged(self, s: str) -> list[str]:
        """BPE by definition: the adjacent pair whose union scores best is merged, the leftmost of equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (k := self.ids.get(parts[i] + parts[i + 1])) is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _strange(self, char: str) -> None:
        """Gives a character that is no piece a number beyond the ids and a place among the pieces."""
        k = len(self.scores) + self.n_strange
        self.n_strange += 1
        self.piece[k] = char
        self.backward[0].setdefault(char, [{}, -1])[1] = k

    def stays(self, u: int, t: int) -> bool:
        """Whether pieces u and t, or t alone where u is -1, come out of merging as they are."""
        row = self.pairs.setdefault(u, {})
        found = row.get(t)
        if found is None:
            b = self.piece[t]
            if u < 0:
                found = len(b) == 1 or self.merged(b) == [b]
            else:
                a = self.piece[u]
                found = a + b not in self.ids and self.stays(-1, u) and self.stays(-1, t) and self.merged(a + b) == [a, b]
            row[t] = found
            self.n_pairs += 1
        return found

    def _bpe_forward(self, word: str, same: int, start: list[int], last: list[int]) -> None:
        """Extends the states of word[:same], start and number of the last piece, to the whole word."""
        children, pairs, rows = self.backward[0], self.pairs, [self.pairs[k] for k in last]
        for i in range(same + 1, len(word) + 1):
            j = i - 1
            try:
                below, k = children[word[j]]
            except KeyError:
                self._strange(word[j])
                below, k = children[word[j]]
            while True:
                if k >= 0:
                    ok = rows[j].get(k)
                    if self.stays(last[j], k) if ok is None else ok:
                        break
                j -= 1
                below, k = below[word[j]]  # some last piece always fits
            start.append(j)
            last.append(k)
            if k not in pairs:
                pairs[k] = {}
            rows.append(pairs[k])

    def _unigram_forward(self, word: str, same: int, start: list[int], best: list[float]) -> None:
        """Viterbi: extends start of the last piece and best score."""
        for i in range(same + 1, len(word) + 1):
            top, at = -np.inf, i - 1
            for j in range(max(0, i - self.longest), i):
                k = self.ids.get(word[j:i])
                if k is None and i - j > 1:
                    continue
                score = best[j] + (self.lowest if k is None else self.scores[k])
                if score > top:
                    top, at = score, j
            start.append(at)
            best.append(top)

    def _spelt(self, char: str) -> list[int]:
        return [self.bytes_of[x] for x in char.encode()] if self.bytes_of else [self.unknown]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Words with their ids, in sorted order."""
        start, best, last, before, ids = [0], [0.0], [-1], "", len(self.scores)
        if self.n_pairs > PAIRS_KEPT:
            self.pairs, self.n_pairs = {-1: {}}, 0
        for word in sorted(words):
            same = _alike(before, word)
            del start[same + 1 :], best[same + 1 :], last[same + 1 :]
            before, i = word, len(word)
            if self.kind == BPE:
                self._bpe_forward(word, same, start, last)
                found = []
                while i:
                    found.append(last[i])
                    i = start[i]
                found.reverse()
                if max(found) >= ids:
                    found = list(chain.from_iterable([k] if k < ids else self._spelt(self.piece[k]) for k in found))
            else:
                self._unigram_forward(word, same, start, best)
                spans = []
                while i:
                    spans.append(word[start[i] : i])
                    i = start[i]
                found = list(chain.from_iterable([k] if (k := self.ids.get(p)) is not None else self._spelt(p) for p in reversed(spans)))
            yield word, tuple(found)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text i are ids[bounds[i] : bounds[i + 1]]."""
        parted = [self.words(t) for t in texts]
        coded = pa.array(chain.from_iterable(parted), pa.large_string(), size=sum(map(len, parted))).dictionary_encode()
        distinct, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        now, old = {}, self.known
        now.update(self.encode_words(w for w in distinct if w not in old))
        found = [old[w] if w in old else now[w] for w in distinct]
        self.known = old | now if len(old) + len(now) <= WORDS_KEPT else dict(zip(distinct, found, strict=True))
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, size.sum())
        begin = np.cumsum(size) - size
        length = size[place]
        end = np.cumsum(length)
        ids = flat[np.repeat(begin[place] - (end - length), length) + np.arange(length.sum())]
        bounds = np.zeros(len(texts) + 1, np.int64)
        upto = np.concatenate([np.zeros(1, np.int64), end])
        bounds[1:] = upto[np.cumsum([len(p) for p in parted])]
        if not self.bytes_of and len(ids):  # the library makes one unknown of several in a row
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[bounds[:-1][bounds[:-1] < len(ids)]] = False
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(~again)])[bounds]
            ids = ids[~again]
        return bounds, ids

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.add_dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


_worker.keeps(model.cache_clear)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def encoded(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of ``text``; null and empty texts have none. A column named like ``ids`` is
    replaced. ``path`` names the model's file, which every executor has. Rows are encoded alone, so ties and repeated
    rows change nothing; an empty table gives an empty table. A text is taken whole, however long: a task holds
    about BLOCK_CHARS characters, or one longer text, with its ids. The session's Arrow batches stay small afterwards.
    """
    small_batches(df.sparkSession)
    schema = df.drop(ids).schema.add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.begins("pieces")
        m = model(path)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            column = table.column(text).to_pylist()
            for lo, hi in _slices([len(t or "") for t in column], BLOCK_CHARS):
                offsets, values = m.encode([t or "" for t in column[lo:hi]])
                part = table.slice(lo, hi - lo)
                part = part.drop_columns([ids]) if ids in part.column_names else part
                yield from part.append_column(ids, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))).combine_chunks().to_batches()
        _worker.ends()

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``; null for null, empty for none. A column named like ``text`` is replaced. Rows are
    decoded alone and whole; an empty table gives an empty table. The session's Arrow batches stay small afterwards.
    """
    small_batches(df.sparkSession)
    schema = df.drop(text).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _worker.begins("pieces")
        m = model(path)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = table.column(ids).combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            out = [None if x is None else m.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in (s if s.is_valid else None for s in lists)]
            table = table.drop_columns([text]) if text in table.column_names else table
            yield from table.append_column(text, pa.array(out, pa.string())).combine_chunks().to_batches()
        _worker.ends()

    return df.mapInArrow(run, schema)
