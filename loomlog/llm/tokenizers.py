"""Encoding with public tokenizers whose vocabulary files lie in a folder given as a parameter.

The merges are our own: a contiguous rank array per word. Boundaries of the parts and the ranks of adjacent parts are held in two
arrays; the least rank is searched again and again, the boundary in it deleted, and the ranks beside it refreshed. Words of more
than LONG symbols use a heap instead of the search, with the same result.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import regex

FOLDER = os.environ.get("LOOMLOG_TOKENIZERS", "/opt/tokenizers")
LONG = 400
#: Most words or chunks that a worker remembers; beyond it the memory starts anew, with the same results.
REMEMBERED = 600_000

#: Unicode White_Space: fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same, for strip().
STRIP = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: How the two vocabularies part a text into words: fixed values.
_BYTE_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_WORD_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: The same for texts of ASCII alone.
_BYTE_WORDS_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+"
_WORD_WORDS_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\t\n\x0b\x0c\r A-Za-z0-9]+"
_NONE = 1 << 60
#: A chunk is a run of white space and the run of other characters after it; words never go beyond a chunk.
CHUNK = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_TWO_SPACES = regex.compile(rf"[{SPACE}][{SPACE}]")


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The boundaries that are left when all merges of a word's bytes are done."""
    n, get = len(data), ranks.get
    if n > LONG:
        return _merge_long(n, lambda a, b, c: get(data[a:c], _NONE))
    bounds = list(range(n + 1))
    beside = [get(data[i : i + 2], _NONE) for i in range(n - 1)]
    while beside:
        least = min(beside)
        if least == _NONE:
            break
        i = beside.index(least)
        del bounds[i + 1], beside[i]
        if i < len(beside):
            beside[i] = get(data[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            beside[i - 1] = get(data[bounds[i - 1] : bounds[i + 1]], _NONE)
    return bounds


def merge_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts that are left when all merges of a word's symbols are done; here the parts themselves stand for the boundaries."""
    n, get = len(symbols), ranks.get
    if n > LONG:
        joined = lambda a, b: "".join(symbols[a:b])
        bounds = _merge_long(n, lambda a, b, c: get((joined(a, b), joined(b, c)), _NONE))
        return [joined(a, b) for a, b in zip(bounds, bounds[1:])]
    parts = symbols
    beside = [get(pair, _NONE) for pair in zip(parts, parts[1:])]
    while beside:
        least = min(beside)
        if least == _NONE:
            break
        i = beside.index(least)
        parts[i] += parts.pop(i + 1)
        del beside[i]
        if i < len(beside):
            beside[i] = get((parts[i], parts[i + 1]), _NONE)
        if i:
            beside[i - 1] = get((parts[i - 1], parts[i]), _NONE)
    return parts


def _merge_long(n: int, rank) -> list[int]:
    after, before = list(range(1, n + 2)), list(range(-1, n))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(i, i + 1, i + 2)) != _NONE]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if not alive[a] or after[a] != b or b >= n or not alive[b] or after[b] != c:
            continue
        alive[b] = False
        after[a] = c
        if c < n:
            before[c] = a
            end = after[c]
            if (r := rank(a, c, end)) != _NONE:
                heapq.heappush(heap, (r, a, c, end))
        if a:
            p = before[a]
            if (r := rank(p, a, c)) != _NONE:
                heapq.heappush(heap, (r, p, a, c))
    bounds, at = [], 0
    while at < n:
        bounds.append(at)
        at = after[at]
    return [*bounds, n]


class _Memory(dict):
    """A dictionary that computes what it hasn't got."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _inner(word: str, sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """The characters and tokens up to each boundary of a word's tokens that falls on a character, counted from the one before; sizes: the
    tokens' bytes. An apostrophe stays with what stands before it: at the start of a text it could begin another word."""
    ends = accumulate(len(c.encode("utf-8", "replace")) for c in word) if not word.isascii() else range(1, len(word) + 1)
    at, chars, end = 0, 0, 0
    tokens = 0
    ends = iter(ends)
    for size in sizes:
        at += size
        tokens += 1
        while end < at:
            end = next(ends)
            chars += 1
        if end == at and word[chars : chars + 1] != "'":
            yield chars, tokens
            tokens = 0


class ByteBPE:
    """Byte-level BPE from a file of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.sizes = {number: len(data) for data, number in self.ranks.items()}
        any_text, ascii_text = regex.compile(_BYTE_WORDS).findall, re.compile(_BYTE_WORDS_ASCII).findall
        self.find = lambda text: ascii_text(text) if text.isascii() else any_text(text)
        self.words = _Memory(self._word)
        self.chunks = _Memory(self._chunk)
        self.spaced = _Memory(lambda piece: self._chunk(piece if piece[:1] == "\n" else " " + piece))
        self.counts = _Memory(lambda chunk: sum(map(len, map(self.words.__getitem__, self.find(chunk)))))

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "replace")
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        bounds = merge_bytes(data, ranks)
        return tuple(ranks[data[a:b]] for a, b in zip(bounds, bounds[1:]))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        words = self.find(chunk)
        return self.words[words[0]] if len(words) == 1 else tuple(chain.from_iterable(map(self.words.__getitem__, words)))

    def _parts(self, text: str):
        if _TWO_SPACES.search(text):
            return map(self.chunks.__getitem__, CHUNK.findall(text))
        pieces = text.replace("\n", " \n").split(" ")
        return chain((self.chunks[pieces[0]],), map(self.spaced.__getitem__, pieces[1:]))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none of a null or an empty one. Spellings of special tokens are ordinary text."""
        return list(chain.from_iterable(self._parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self._parts(text))) if text else 0

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        return list(map(self.counts.__getitem__, chunks))

    def spans(self, chunk: str) -> tuple[list[int], list[int]]:
        """The lengths and tokens of a chunk's words; its white space stays with the first word after it."""
        words = self.find(chunk)
        lengths, counts = list(map(len, words)), list(map(len, map(self.words.__getitem__, words)))
        lead = next((i for i, w in enumerate(words) if w.strip(STRIP)), len(words) - 1)
        return [sum(lengths[: lead + 1]), *lengths[lead + 1 :]], [sum(counts[: lead + 1]), *counts[lead + 1 :]]

    #: Whether the tokens of a part of a word between boundaries of its tokens are those that stand there in the word.
    additive = True

    def parts(self, chunk: str, least: int) -> list[tuple[int, int, int]]:
        """The parts of a chunk: (characters, tokens, tokens of the word if it ends here, else 0); words of up to `least` tokens are one."""
        out = []
        for word in self.find(chunk):
            ids, at = self.words[word], 0
            ends = len(ids) if word.strip(STRIP) else 0  # what white space is one word depends on what follows it
            if ends and ends <= least:
                out.append((len(word), ends, ends))
                continue
            for end, tokens in _inner(word, (self.sizes[i] for i in ids)):
                out.append((end - at, tokens, ends if end == len(word) else 0))
                at = end
        return out

    def count_once(self, text: str) -> int:
        """As count, but long words aren't remembered."""
        return sum(len(self.words[w] if len(w) <= 40 else self._word(w)) for w in self.find(text))

    def most(self, char: str) -> int:
        """No text has more tokens than the sum of this over its characters."""
        return len(char.encode("utf-8", "replace"))


def _visible_bytes() -> list[str]:
    """Byte-level BPE writes each byte as one character: printable ones as themselves, the others as those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """BPE with word ends over NFC, lower case text without white space, from a file of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.sizes = {number: len(token) for token, number in self.vocab.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.visible = _visible_bytes()
        any_text, ascii_text = regex.compile(_WORD_WORDS).findall, re.compile(_WORD_WORDS_ASCII).findall
        self.find = lambda text: ascii_text(text) if text.isascii() else any_text(text)
        self.words = _Memory(self._word)
        self.counts = _Memory(lambda chunk: sum(map(len, map(self.words.__getitem__, self.find(self.normal(chunk))))))

    @staticmethod
    def normal(text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _word(self, word: str) -> tuple[int, ...]:
        symbols = [self.visible[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.suffix
        return tuple(map(self.vocab.__getitem__, merge_symbols(symbols, self.ranks)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.find(self.normal(text))))) if text else []

    def count(self, text: str | None) -> int:
        return sum(self.chunk_counts(CHUNK.findall(text))) if text else 0

    def chunk_counts(self, chunks: list[str]) -> list[int]:
        return list(map(self.counts.__getitem__, chunks))

    def spans(self, chunk: str) -> tuple[list[int], list[int]] | None:
        """As for bytes; None where the words of the normal form aren't those of the text."""
        low = chunk.lower()
        if len(low) != len(chunk) or self.normal(chunk) != low:
            return None
        words = self.find(low)
        lengths, counts = list(map(len, words)), list(map(len, map(self.words.__getitem__, words)))
        if not words:
            return [len(chunk)], [0]
        lengths[0] += len(chunk) - sum(lengths)  # only the white space before them belongs to no word
        return lengths, counts

    def _places(self, chunk: str) -> tuple[str, list[int] | None]:
        """The normal form, and for each place in it the place in the chunk, or -1 where a cut would change the form; None: the same."""
        low = chunk.lower()
        if len(low) == len(chunk) and self.normal(chunk) == low:
            return low, None
        places, forms, form, begin = [0], [], "", 0
        for i, c in enumerate(chunk):
            alone = self.normal(c)
            if i and not unicodedata.combining(c) and self.normal(chunk[begin:i] + c) == form + alone:
                forms.append(form)
                places += [-1] * (len(form) - 1) + [i]
                begin, form = i, alone
            else:
                form = self.normal(chunk[begin : i + 1])
        return "".join([*forms, form]), [*places, *[-1] * (len(form) - 1), len(chunk)]

    additive = False

    def parts(self, chunk: str, least: int) -> list[tuple[int, int, int]]:
        """As for bytes, but a cut inside a word gives other tokens, as those at its end know of it."""
        low, places = self._places(chunk)
        out, at, begin, tokens, words = [], 0, 0, 0, self.find(low)
        for word in words:
            begin = low.index(word, begin)
            ids = self.words[word]
            sizes = [self.sizes[i] for i in ids]
            sizes[-1] -= len(self.suffix)
            for end, n in _inner(word, sizes) if len(ids) > least else ((len(word), len(ids)),):
                tokens += n
                place = places[begin + end] if places else begin + end
                if place > at:
                    out.append((place - at, tokens, len(ids) if end == len(word) else 0))
                    at, tokens = place, 0
            begin += len(word)
        if at < len(chunk):
            out.append((len(chunk) - at, tokens, max(tokens, 1)))
        return out

    def count_once(self, text: str) -> int:
        return sum(len(self.words[w] if len(w) <= 40 else self._word(w)) for w in self.find(self.normal(text)))

    def most(self, char: str) -> int:
        return max(len(self.normal(char).encode("utf-8", "replace")), len(char.encode("utf-8", "replace")))


#: The tokenizers and their files: fixed values.
FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken", "word_bpe_49k": "word_bpe_49k.json"}
_LOADED: dict[tuple[str, str], ByteBPE | WordBPE] = {}


def load(name: str, folder: str = FOLDER) -> ByteBPE | WordBPE:
    """A tokenizer by name, once per process."""
    key = (name, folder)
    if key not in _LOADED:
        path = os.path.join(folder, FILES[name])
        _LOADED[key] = (ByteBPE if path.endswith(".tiktoken") else WordBPE)(path)
    return _LOADED[key]
