"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after the other in one numpy array of symbols. In each round
every pre-token finds its lowest-ranked pair and merges all places of that pair at once;
pre-tokens without a known pair leave the array. The symbols that are left are the tokens. A pass over a very long
pre-token for each of its ranks would take time in the square of its length; the places of long ones are kept by rank
instead, and only pairs beside a merge are looked up again.

Pre-tokens are those of the tokenizers library. Its Unicode tables may be older than those of the regular expressions
here; characters that only the newer tables call letters or digits are found once, by asking the library, and texts that
hold some are split by a pattern without them.

Null and empty texts have no tokens. Very long texts are split in parts of bounded size. Rows, ties and copies are independent of each other:
the count is a function of the text alone. An empty table gives no rows. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import slices, whole_text

LIMIT = 512
NONE = np.int64(1 << 40)
CACHED_WORDS = 300_000
LONG_WORD = 2000  # bytes of a pre-token from which its places are kept by rank
CHUNK = 200_000  # pre-tokens of one text that are held at a time


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary files."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merger:
    """Pair ranks as sorted arrays: key = left id * 2**32 + right id."""

    def __init__(self, byte_ids: list[int], pairs: Iterable[tuple[int, int, int, int]]) -> None:
        """pairs: (left id, right id, rank, merged id)"""
        table = np.array(sorted((left << 32 | right, rank, merged) for left, right, rank, merged in pairs), np.int64)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.keys, self.ranks, self.merged = (np.ascontiguousarray(c) for c in table.reshape(-1, 3).T)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each word: (word of each symbol, symbol), words in no fixed order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = (sizes >= LONG_WORD)[word]
        if long.any():
            done.append(self._merge_long(word[long], symbol[long]))
            word, symbol = word[~long], symbol[~long]
        while len(symbol):
            rank = np.full(len(symbol), NONE)
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank[:-1][known] = self.ranks[at[known]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
            live = lowest < NONE
            if not live.all():
                done.append((word[~live], symbol[~live]))
            place = np.flatnonzero(live & (rank == lowest))
            if not len(place):
                break
            # Places that overlap (a a a) take turns from the left.
            turn = np.arange(len(place))
            turn -= np.maximum.accumulate(np.where(np.r_[True, np.diff(place) != 1], turn, 0))
            place = place[turn % 2 == 0]
            symbol[place] = self.merged[at[place]]
            live[place + 1] = False
            word, symbol = word[live], symbol[live]
        if not done:
            return word[:0], symbol[:0]
        return np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])

    def _merge_long(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `merge`, over a chain of symbols: the lowest rank of all is merged at all its places in each round.

        Words do not depend on each other, so the lowest rank of all is the lowest of every word that has it.
        """
        n = len(symbol)
        follows = np.r_[np.arange(1, n), -1]
        follows[:-1][word[:-1] != word[1:]] = -1
        before = np.full(n, -1)
        before[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def pairs(left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the places with a known pair: place, number of the pair."""
            left = left[alive[left] & (follows[left] >= 0)]
            key = symbol[left] << 32 | symbol[follows[left]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            return left[known], at[known]

        def note(left: np.ndarray) -> None:
            left, at = pairs(left)
            rank = self.ranks[at]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, own in zip(rank[first].tolist(), np.split(left, first[1:]), strict=True):
                if r not in places:
                    heappush(waiting, r)
                places.setdefault(r, []).append(own)

        note(np.arange(n))
        while waiting:
            lowest = heappop(waiting)
            # Places noted earlier may have been merged away or have another neighbour by now.
            place, at = pairs(np.unique(np.concatenate(places.pop(lowest))))
            still = self.ranks[at] == lowest
            place, at = place[still], at[still]
            if not len(place):
                continue
            turn = np.arange(len(place))
            turn -= np.maximum.accumulate(np.where(np.r_[True, place[1:] != follows[place[:-1]]], turn, 0))
            place, at = place[turn % 2 == 0], at[turn % 2 == 0]
            gone = follows[place]
            symbol[place] = self.merged[at]
            alive[gone] = False
            follows[place] = follows[gone]
            linked = follows[place] >= 0
            before[follows[place[linked]]] = place[linked]
            left = before[place]
            note(np.unique(np.r_[place, left[left >= 0]]))
        return word[alive], symbol[alive]

    def counts(self, words: list[bytes]) -> np.ndarray:
        return np.bincount(self.merge(words)[0], minlength=len(words))


def odd_characters() -> str:
    """Characters that are letters or digits here and not in the tokenizers library, as ranges of a character class.

    All letters stand in one line after a letter (digits after a digit): the library cuts it where its own class
    changes, so one character of each piece tells the class of the piece.
    """
    from tokenizers import pre_tokenizers

    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranges = []
    for known, kind in (("a", r"\p{L}+"), ("1", r"\p{N}+")):
        line = known + "".join(regex.findall(kind, everything))
        for _, (start, end) in library.pre_tokenize_str(line):
            piece = line[max(start, 1) : end]
            if piece and len(library.pre_tokenize_str(known + piece[0])) > 1:
                at = 0
                while at < len(piece):
                    stop = at
                    while stop + 1 < len(piece) and ord(piece[stop + 1]) == ord(piece[stop]) + 1:
                        stop += 1
                    ranges.append(f"\\U{ord(piece[at]):08X}-\\U{ord(piece[stop]):08X}")
                    at = stop + 1
    return "".join(sorted(ranges))


class Splitter:
    """The splitting rule for a text."""

    def __init__(self, pattern: str, odd: str) -> None:
        self.usual = regex.compile(pattern)
        self.odd = re.compile(f"[{odd}]") if odd else None
        # Most texts have no character as high as the lowest odd one; one range is looked through far faster than many.
        self.high = re.compile(f"[^\\U00000000-\\U{int(odd[2:10], 16) - 1:08X}]") if odd else None
        without = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{odd}]]").replace(r"\p{N}", rf"[\p{{N}}--[{odd}]]")
        self.other = regex.compile(without, regex.V1) if odd else self.usual

    def of(self, text: str) -> regex.Pattern:
        if self.odd is None or text.isascii() or not self.high.search(text):
            return self.usual
        return self.other if self.odd.search(text) else self.usual


def load(path: str) -> tuple[Merger, tuple[str, ...]]:
    """The merges of a tokenizer file and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    pairs = []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((vocab[left], vocab[right], rank, vocab[left + right]))
    specials = tuple(x["content"] for x in spec["added_tokens"])
    return Merger([vocab[x] for x in byte_letters()], pairs), specials


def pre_tokens(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text in lists of bounded length."""
    if len(text) <= CHUNK:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while chunk := list(islice(found, CHUNK)):
        yield chunk


def count_tokens(texts: list[str], loaded: tuple[Merger, tuple[str, ...]], splitter: Splitter, cache: dict[str, int]) -> list[int]:
    """Tokens of each text; `cache` holds the counts of pre-tokens seen before."""
    merger, specials = loaded
    split = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    totals = []
    for text in texts:
        parts = split.split(text) if split else [text]
        total = len(parts) - 1  # each special string is one token
        for part in parts:
            for chunk in pre_tokens(splitter.of(part), part):
                fresh = list({w for w in chunk if w not in cache})
                if len(cache) + len(fresh) > CACHED_WORDS:
                    cache.clear()
                    fresh = list(set(chunk))
                if fresh:
                    cache.update(zip(fresh, merger.counts([w.encode() for w in fresh]).tolist(), strict=True))
                total += sum(map(cache.__getitem__, chunk))
        totals.append(total)
    return totals


def count_batch(texts: list[str], loaded: tuple[Merger, tuple[str, ...]], splitter: Splitter, cache: dict[str, int]) -> list[int]:
    """As `count_tokens`; the new pre-tokens of many texts are merged together first."""
    merger, specials = loaded
    totals: list[int] = []
    for start, end in slices(texts):
        part = texts[start:end]
        if sum(map(len, part)) <= 4_000_000 and not any(s in t for s in specials for t in part):
            found = [splitter.of(t).findall(t) for t in part]
            fresh = list({w for chunk in found for w in chunk if w not in cache})
            if len(cache) + len(fresh) > CACHED_WORDS:
                cache.clear()
                fresh = list({w for chunk in found for w in chunk})
            if fresh:
                cache.update(zip(fresh, merger.counts([w.encode() for w in fresh]).tolist(), strict=True))
            totals += [sum(map(cache.__getitem__, chunk)) for chunk in found]
        else:
            totals += count_tokens(part, loaded, splitter, cache)
    return totals


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, n_tokens, over_limit.

    `tokenizer` is a byte-level BPE file that every executor can read, `pattern` its splitting rule.
    """
    odd = odd_characters()

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, int] = {}
        loaded, splitter = load(tokenizer), Splitter(pattern, odd)
        for texts in batches:
            yield pd.Series(count_batch(texts.tolist(), loaded, splitter, cache), dtype="int64")

    counted = docs.select(
        "doc_id",
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        tokens(whole_text()).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
