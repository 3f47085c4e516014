"""Token counts by prefix dynamic programming over a byte-pair vocabulary with word ends.

A segmentation is the one that merging gives exactly when every two neighbours in it are what merging gives for the two
alone. So the last token of every prefix of a word is the one token that ends there, begins where a shorter prefix
ended, and gets on with that prefix's last token; the number of tokens of the prefix is one more than the shorter one's.
A document's counts are summed over its words and kept at every word, and a word's at every character, so that questions
about budgets and truncation read a count and never encode again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import fresh, steps

#: Words, and pairs of tokens, that a Python task remembers; beyond that it forgets all and goes on.
REMEMBERED = 600_000
END = "</w>"
#: White space to Python alone.
SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


class Bounded(dict):
    """A dict that computes what it lacks and empties itself when it is full."""

    def __init__(self, make, most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class PrefixCounter:
    """Counts for one tokenizer file of the kind `BPE with word ends`."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["ignore_merges"]:
            raise ValueError("a BPE file with word ends is asked for")
        self.vocab = model["vocab"]
        self.ranks = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.begun = {t[:k]: False for t in self.vocab for k in range(1, len(t)) if not t.endswith(END) or k < len(t) - len(END)}
        self.begun |= dict.fromkeys((t for t in self.vocab if not t.endswith(END)), True)
        self.longest_end = max((len(t) - len(END) for t in self.vocab if t.endswith(END)), default=0)
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split)
        self.symbols = byte_symbols()
        self.alone = Bounded(lambda t: self.merge(self.split(t)) == [t])
        self.edges = Bounded(lambda t: (self.spine(t, 1), self.spine(t, 0)))
        self.fits = Bounded(lambda ab: not self.crossed(*ab))
        self.counts = Bounded(lambda w: self.word(w)[-1])
        self.prefixes = Bounded(lambda w: self.word(w, every=True))
        self.chunks = Bounded(lambda c: tuple([self.counts[w] if w else 1 for w in self.words_of_chunk(c)]))

    @staticmethod
    def split(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else [*token]

    def merge(self, parts: list[str]) -> list[str]:
        """What merging makes of a few symbols; only used on one or two vocabulary entries."""
        while len(parts) > 1:
            rank, k = min((self.ranks.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
        return parts

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts of a token at its right (1) or left (0) edge, from the whole to one symbol, and the rank of the
        merge that takes each into the next larger one (none for the whole token: a rank above all)."""
        out, taken = [], len(self.ranks)
        while True:
            out.append((token, taken))
            parts = self.split(token)
            if len(parts) == 1:
                return out
            while len(parts) > 2:
                _, k = min((self.ranks[a, b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in self.ranks)
                parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
            token, taken = parts[side], self.ranks[parts[0], parts[1]]

    def crossed(self, a: str, b: str) -> bool:
        """Whether some merge over the border of two tokens comes before what takes its parts into the tokens.

        Parts of a token have lower ranks than itself, so ranks order the merges of one word in time; of two equal
        ranks the left one is first."""
        for x, before in self.edges[a][0]:
            for y, until in self.edges[b][1]:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < before and rank <= until:
                    return True
        return False

    def word(self, word: str, every: bool = False) -> list[int]:
        """Tokens of every prefix of the word's bytes, taken as a word; without every, of the whole alone."""
        text = "".join([self.symbols[b] for b in word.encode()])
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        begun, alone, fits = self.begun.get, self.alone, self.fits
        for i in range(n):
            before, tokens = last[i], count[i] + 1
            for j in range(i + 1, n):
                token = text[i:j]
                whole = begun(token)
                if whole is None:  # no token begins so
                    break
                if whole and last[j] is None and alone[token] and (not i or fits[before, token]):
                    last[j], count[j] = token, tokens
        counts = []
        for j in range(1 if every else n, n + 1):
            for i in range(max(0, j - self.longest_end), j):
                token = text[i:j] + END
                if token in self.vocab and alone[token] and (not i or fits[last[i], token]):
                    counts.append(count[i] + 1)
                    break
        return counts

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special token is a word of one token."""
        if self.special is None or not self.special.search(text):
            return self.pieces.findall(self.normalize(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pieces.findall(self.normalize(text[at : m.start()])), None]
            at = m.end()
        return out + self.pieces.findall(self.normalize(text[at:]))

    def words_of_chunk(self, chunk: str) -> list[str | None]:
        """As words. Letters up to U+00FF are normal and have one lower case, so that the library isn't asked."""
        if max(chunk) <= "\xff":
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return [chunk[:-1].lower(), chunk[-1]]
        return self.words(chunk)

    def at_words(self, text: str) -> list[int]:
        """Tokens of the text up to the end of each word. No word crosses white space, so chunks without are remembered."""
        if SEPARATORS.isdisjoint(text):
            return list(accumulate(chain.from_iterable(map(self.chunks.__getitem__, text.split()))))
        return list(accumulate(1 if w is None else self.counts[w] for w in self.words(text)))


@cache
def counter(path: str) -> PrefixCounter:
    """One a process."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """docs, n_bytes and prefix_tokens: the text's UTF-8 bytes, and its tokens up to the end of each word.

    The last entry is the count of the whole text; a text without words, or null, has no entry (and null has no bytes).
    New columns get longer names where docs has theirs; other columns pass unchanged, and repeated rows all stay.
    """
    columns, (size, prefix) = docs.columns, fresh(docs, "n_bytes", "prefix_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in steps(batches):
            text = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(text.cast(pa.binary())), 0).cast(pa.int64())
            at = [tokens.at_words(t or "") for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, pa.array(at, pa.list_(pa.int32()))], [*columns, size, prefix])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(count, f"{schema}, {size} bigint, {prefix} array<int>")


def words_within(prefix_tokens: list[int], budget: int) -> int:
    """How many whole words fit in a budget of tokens."""
    from bisect import bisect_right

    return bisect_right(prefix_tokens, budget)


def truncated_word(word: str, budget: int, path: str) -> str:
    """The longest prefix of one word, in whole characters, that as a word takes no more tokens than the budget."""
    counts, best = counter(path).prefixes[word], ""
    for k in range(1, len(word) + 1):
        if counts[len(word[:k].encode()) - 1] <= budget:
            best = word[:k]
    return best
