"""Splitting long texts at natural boundaries, with overlap, by pointer doubling.

A text is a row of atoms whose tokens add up exactly: runs of white space with the characters after them. Every boundary between
atoms is joined to the end of the piece that begins there and to the start of the next piece; the table of next starts is squared
again and again, and all starts that the first one reaches are marked in parallel.

A piece ends at the farthest boundary within the limit, at an end of line or sentence where one lies in its second half, else at
white space. Only where there is none, or none that leaves room for the overlap, an atom is cut between words, or inside a word at a
boundary of its tokens; such texts are walked piece by piece, with real counts. The next piece starts at the last boundary that gives
at least the overlap, which only characters of many tokens can prevent, where the limit is a few tokens, or a few more than the
overlap. An overlap that isn't smaller than the limit is refused. Null and empty texts have no
pieces; texts within the limit are one piece. Pieces cover the text without gaps, and each ends beyond the one before.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlog.llm import tokenizers

#: So many chunks of texts, at least, are cut together.
TOGETHER = 40_000
_SENTENCE_ENDS = tuple(".!?…。！？")
_LINE, _SPACE, _INSIDE, _WITHIN = 2, 1, 0, -1


class _Walk:
    """The pieces of one text, one after another, where whole chunks don't do: they are too long, or leave no room for the overlap.

    Boundaries are those of chunks, of words, and of tokens inside words that fall on characters. Tokens between boundaries of words
    add up; from or to a place inside a word they are counted, where the tokenizer's don't. Only what has more tokens than `least` is
    parted: smaller chunks and words always leave room for the overlap and for going on."""

    def __init__(self, tokenizer, text: str, chunks: list[str], counts: list[int], most: int, overlap: int):
        self.tokenizer, self.text, self.most, self.overlap = tokenizer, text, most, overlap
        self.at, self.before, kinds, self.whole = [0], [0], [_LINE], [True]
        self.counted: dict[tuple[int, int], int] = {}
        self.farthest: dict[int, int] = {}
        least = (most - overlap) // 4
        for i, (chunk, count) in enumerate(zip(chunks, counts)):
            parts = tokenizer.parts(chunk, least) if count > least else [(len(chunk), count, count or 1)]
            for length, tokens, ends in parts:
                self.at.append(self.at[-1] + length)
                self.before.append(self.before[-1] + tokens)
                self.whole.append(bool(ends) or tokenizer.additive and not text[self.at[-1] - 1].isspace())
                kinds.append(_INSIDE if ends else _WITHIN)
            self.whole[-1] = True
            kinds[-1] = _LINE if i + 1 == len(chunks) or "\n" in chunks[i + 1] or chunk.endswith(_SENTENCE_ENDS) else _SPACE
            if count > most:
                self._too_long(kinds, len(kinds) - len(parts), parts)
        self.last = len(kinds) - 1
        here = np.arange(len(kinds))
        #: For each kind, the last boundary of at least this kind up to each boundary.
        self.up_to = {kind: np.maximum.accumulate(np.where(np.array(kinds) >= kind, here, -1)).tolist() for kind in (_LINE, _SPACE, _INSIDE, _WITHIN)}

    def _too_long(self, kinds: list[int], first: int, parts: list[tuple[int, int, int]]) -> None:
        """Boundaries inside words beyond the limit are as good as those between words."""
        begin = 0
        for k, (_, _, ends) in enumerate(parts):
            if ends:
                if ends > self.most:
                    kinds[first + begin : first + k] = [_INSIDE] * (k - begin)
                begin = k + 1

    def tokens(self, a: int, b: int) -> int:
        if self.whole[a] and self.whole[b]:
            return self.before[b] - self.before[a]
        if (a, b) not in self.counted:
            self.counted[a, b] = self.tokenizer.count_once(self.text[self.at[a] : self.at[b]])
        return self.counted[a, b]

    def far(self, a: int) -> int:
        """The farthest boundary within the limit."""
        if a in self.farthest:
            return self.farthest[a]
        b = min(max(bisect_right(self.before, self.before[a] + self.most) - 1, a + 1), self.last)
        while b > a + 1 and self.tokens(a, b) > self.most:
            b -= 1
        while b < self.last and self.tokens(a, b + 1) <= self.most:
            b += 1
        self.farthest[a] = b
        return b

    def end(self, a: int, beyond: int) -> int:
        """The end of the piece that begins at a boundary, where the one before ends at another."""
        far = self.far(a)
        if far == self.last:
            return far
        line = self.up_to[_LINE][far]
        found = [line] if line > a and self.tokens(a, line) >= self.most / 2 else []
        for b in (*found, self.up_to[_SPACE][far], self.up_to[_INSIDE][far]):
            if b > max(a + 1, beyond) and self.tokens(a + 1, b) >= self.overlap:  # else the next one begins where this does
                return b
        return far

    def start(self, a: int, end: int) -> int:
        """The start of the piece after the one between two boundaries."""
        if not self.overlap:
            return end
        b = min(max(bisect_right(self.before, self.before[end] - self.overlap) - 1, a + 1), end)
        while b > a + 1 and self.tokens(b, end) < self.overlap:
            b -= 1
        while b + 1 < end and self.tokens(b + 1, end) >= self.overlap:
            b += 1
        possible = []
        for kind in (_SPACE, _INSIDE, _WITHIN):
            c = self.up_to[kind][b]
            while c > a and self.tokens(c, end) < self.overlap:
                c = self.up_to[kind][c - 1]
            if kind == _INSIDE and self.tokens(c, end) > 2 * self.overlap:
                continue  # a long word
            if c > a and (far := self.far(c)) > end and self.tokens(c, far) <= self.most:
                if far == self.last or self.up_to[_SPACE][far] > end:
                    return c
                possible.append(c)
        if possible:
            return possible[0]
        while b < end and self.tokens(b, end + 1) > self.most:  # single characters of many tokens: as much as there is room for
            b += 1
        return b

    def pieces(self) -> list[tuple[int, int, int]]:
        out, a, b = [], 0, self.end(0, 0)
        while True:
            out.append((self.at[a], self.at[b], self.tokens(a, b)))
            if b == self.last:
                return out
            a = self.start(a, b)
            b = self.end(a, b)
            self.counted.clear()
            self.farthest.clear()


class Lexicon(dict):
    """Chunks by number, with the length, the kind of its ends and the tokens of each, for all tokenizers at once."""

    def __init__(self, names: list[str], folder: str):
        super().__init__()
        self.tokenizers = [tokenizers.load(n, folder) for n in names]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.lengths, self.ends, self.counts = array("i"), array("b"), [array("i") for _ in self.tokenizers]

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self.lengths)
        self.lengths.append(len(chunk))
        self.ends.append(("\n" in chunk) + 2 * chunk.endswith(_SENTENCE_ENDS))
        for tokenizer, counts in zip(self.tokenizers, self.counts):
            counts.append(tokenizer.counts.make(chunk))
        return number

    def numbers(self, chunks: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chunks), "int64", count=len(chunks))


def _with_starts(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums over texts that stand one after another: each text has one boundary more than chunks."""
    padded = np.zeros(len(values) + len(sizes), "int64")
    at = np.arange(len(values)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded[at] = values
    return np.cumsum(padded)


def cuts(before: np.ndarray, kinds: np.ndarray, first: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and last boundary of each piece, for texts whose boundaries stand one after another.

    before: tokens before each boundary, running on from text to text; first: where each text's boundaries begin."""
    n = len(before)
    here = np.arange(n)
    edge = np.append(first[1:], n) - 1
    stop = np.repeat(edge, np.diff(np.append(first, n)))
    far = np.minimum(np.searchsorted(before, before + most, "right") - 1, stop)
    line = np.maximum.accumulate(np.where(kinds >= _LINE, here, -1))[far]
    space = np.maximum.accumulate(np.where(kinds >= _SPACE, here, -1))[far]
    end = np.where(space > here, space, far)
    end = np.where((line > here) & (before[line] - before >= most / 2), line, end)
    end = np.where(far == stop, stop, np.maximum(end, np.minimum(here + 1, stop)))
    start = np.minimum(np.searchsorted(before, before[end] - overlap, "right") - 1, end) if overlap else end
    start = np.maximum(start, np.minimum(here + 1, end))
    start = np.where(end[start] <= end, end, start)
    table = np.where(end == stop, here, start)  # the last piece leads to itself
    reached = np.zeros(n, bool)
    reached[first] = True
    marked = len(first)
    while True:
        reached[table[np.nonzero(reached)[0]]] = True
        now = int(np.count_nonzero(reached))
        if now == marked:
            break
        marked = now
        table = table[table]
    starts = np.nonzero(reached)[0]
    return starts, end[starts]


def _kinds(ends: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The kind of each boundary from the ends of the chunks around it."""
    total = len(ends) + len(sizes)
    after, prior = np.zeros(total, "int8"), np.zeros(total, "int8")
    at = np.arange(len(ends)) + np.repeat(np.arange(len(sizes)), sizes)
    after[at], prior[at + 1] = ends & 1, ends & 2
    kinds = np.where((after > 0) | (prior > 0), _LINE, _SPACE)
    kinds[first] = _LINE
    kinds[first + sizes] = _LINE
    return kinds


def pieces(tokenizer, text: str, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of one text, in characters."""
    chunks = tokenizers.CHUNK.findall(text)
    if not chunks:
        return []
    counts = tokenizer.chunk_counts(chunks)
    if sum(counts) <= most:
        return [(0, len(text), sum(counts))]
    if max(counts) > most:
        return _Walk(tokenizer, text, chunks, counts, most, overlap).pieces()
    kinds = [_LINE if not i or "\n" in chunk or chunks[i - 1].endswith(_SENTENCE_ENDS) else _SPACE for i, chunk in enumerate(chunks)]
    at = np.concatenate(([0], np.cumsum(list(map(len, chunks)))))
    before = np.concatenate(([0], np.cumsum(counts)))
    first, last = cuts(before, np.array([*kinds, _LINE]), np.array([0]), most, overlap)
    if np.any(before[last[:-1]] - before[first[1:]] < overlap):
        return _Walk(tokenizer, text, chunks, counts, most, overlap).pieces()
    return list(zip(at[first].tolist(), at[last].tolist(), (before[last] - before[first]).tolist()))


class Group:
    """Texts that are cut together: (key, text) of each, and the numbers of their chunks one after another."""

    def __init__(self):
        self.keys: list[int] = []
        self.texts: list[str] = []
        self.numbers: list[np.ndarray] = []
        self.waiting = 0

    def add(self, key: int, text: str, numbers: np.ndarray) -> None:
        self.keys.append(key)
        self.texts.append(text)
        self.numbers.append(numbers)
        self.waiting += len(numbers)


def _one(lexicon: Lexicon, which: int, group: Group, k: int, most: int, overlap: int, out: tuple[list, ...]) -> None:
    found = pieces(lexicon.tokenizers[which], group.texts[k], most, overlap)
    for column, values in zip(out, ([group.keys[k]] * len(found), range(1, len(found) + 1), *zip(*found))):
        column.extend(values)


def pieces_of_many(lexicon: Lexicon, which: int, group: Group, most: int, overlap: int) -> tuple[list, list, list, list, list]:
    """(key, piece_no, start, end, tokens) of the texts' pieces as lists: texts within the limit at once, those whose whole chunks
    are too long or leave no room for the overlap one by one, all others together."""
    all_numbers, sizes = np.concatenate(group.numbers), np.array([len(x) for x in group.numbers])
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.array(lexicon.counts[which])[all_numbers]
    totals, longest = np.add.reduceat(counts, begin), np.maximum.reduceat(counts, begin)
    whole = np.nonzero(totals <= most)[0].tolist()
    out = ([group.keys[k] for k in whole], [1] * len(whole), [0] * len(whole), [len(group.texts[k]) for k in whole], totals[whole].tolist() if whole else [])
    for k in np.nonzero((totals > most) & (longest > most))[0].tolist():
        _one(lexicon, which, group, k, most, overlap, out)
    together = (totals > most) & (longest <= most)
    if together.any():
        chosen = np.nonzero(together)[0]
        mine = np.repeat(together, sizes)
        numbers, sizes = all_numbers[mine], sizes[chosen]
        first = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
        before = _with_starts(counts[mine], sizes)
        at = _with_starts(np.array(lexicon.lengths)[numbers], sizes)
        starts, ends = cuts(before, _kinds(np.array(lexicon.ends)[numbers], first, sizes), first, most, overlap)
        owner = np.searchsorted(first, starts, "right") - 1
        base = at[first][owner]
        keys = np.array(group.keys)[chosen]
        short = np.append((owner[1:] == owner[:-1]) & (before[ends[:-1]] - before[starts[1:]] < overlap), False)
        alone = np.isin(owner, owner[short])
        for k in chosen[np.unique(owner[short])].tolist():
            _one(lexicon, which, group, k, most, overlap, out)
        rows = (keys[owner], np.arange(len(starts)) - np.searchsorted(owner, owner, "left") + 1, at[starts] - base, at[ends] - base, before[ends] - before[starts])
        for column, values in zip(out, rows):
            column.extend(values[~alone].tolist())
    return out


def split(documents: DataFrame, limits: list[tuple[str, str, int, int]], folder: str = tokenizers.FOLDER) -> DataFrame:
    """(doc_id, limit_name, piece_no, start_char, end_char, n_tokens, text); limits: (limit_name, tokenizer_name, max_tokens, overlap_tokens).

    ValueError for an overlap that leaves no room for going on: it must be smaller than the limit."""
    for name, _, most, overlap in limits:
        if not 0 <= overlap < most:
            raise ValueError(f"{name}: an overlap of {overlap} tokens can't be had in pieces of {most}")
    used = sorted({t for _, t, _, _ in limits})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(used, folder)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            group = Group()
            for k, text in enumerate(texts):
                if text:
                    group.add(k, text, lexicon.numbers(tokenizers.CHUNK.findall(text)))
                if group.keys and (group.waiting >= TOGETHER or k + 1 == len(texts)):
                    for name, tokenizer, most, overlap in limits:
                        at, number, start, end, tokens = pieces_of_many(lexicon, used.index(tokenizer), group, most, overlap)
                        columns = ([ids[x] for x in at], [name] * len(at), number, start, end, tokens, [texts[x][a:b] for x, a, b in zip(at, start, end)])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                    group = Group()
                    if len(lexicon) > tokenizers.REMEMBERED:
                        lexicon.forget()

    names = ["doc_id", "limit_name", "piece_no", "start_char", "end_char", "n_tokens", "text"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, limit_name string, piece_no int, start_char long, end_char long, n_tokens long, text string")
