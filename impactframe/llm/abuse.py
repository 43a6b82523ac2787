"""Abusive, hateful or sexual content (problem 8).

A support vector machine over a subsequence string kernel with Nyström landmarks. The kernel works on two levels: words
match softly by their gapped common character subsequences, so insults with inserted, doubled or replaced characters
still match, and passages match by gapped common subsequences of such words, so that the same word counts differently in
"kill the child process" and in a threat. Landmarks are passages of labelled documents.

Labels belong to documents and raters err, so training is by multiple instances: all passages of clean documents are
negative; in an abusive document the passages that the machine scores highest are taken as positive, in a few rounds. It
uses at most LABELLED documents of each class, in an order given by a hash. Scoring covers every passage of every
document with the full kernel, through an index of the landmarks' subsequences.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.session import spread

#: Labelled documents of each class that training uses at most, and landmarks of each class.
LABELLED = 700
LANDMARKS = 220
#: Decay of a gap inside words and between words; words of a passage window; similarity below which words do not match.
CHAR_DECAY, WORD_DECAY, WINDOW, LEAST = 0.65, 0.75, 48, 0.55
ROUNDS = 5
#: Soft matches in a passage from which the plain recursion is used, and squared matches in a batch of the index.
CROWDED, BATCH = 250, 1_000_000
#: Documents scored together.
TOGETHER = 3_000
#: Cells of an index table that is kept as it is; a larger one is hashed.
DENSE = 4_000_000
#: Distance above the machine's boundary from which a passage counts as abusive; subtracted from every score.
MARGIN = 0.35

# Look-alike letters of other scripts, and digits and signs that stand for letters inside words.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһӏνοαρικτυ", "aeopcyxijsdhlvoapiktu")
LEET = str.maketrans("013457@$!", "oieastasi")

_END = re.compile(r"(?<=[.?])\s+|(?<=!)\s+(?![a-zà-ÿ])|(?<=[。？！])|\n+")
_CODE = re.compile(r"`[^`\n]*`|\b\w*[_\d/\\.]\w*[_/\\]\w*\b|\b[^\W\d_]*[a-z][A-Z]\w*\b|\b\w*_\w*\b|(?<![\w@$])\d+(?!\w)")
_TOKEN = re.compile(r"[^\W\d_]['’]?(?:[\w@$!*'’]*[\w@$*])?|\d[\w@$!*]*[^\W\d_][\w@$*]*|[^\W_]")
_RUN = re.compile(r"(.)\1{2,}")


_MARK = re.compile(r"[.?!]\s|[。？！]")


def passages(text: str | None) -> list[str]:
    if not text:
        return []
    parts: list[str] = []
    for line in text.split("\n"):
        parts += _END.split(line) if _MARK.search(line) else (line,)
    return [s for s in map(str.strip, parts) if s]


def _is_cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


_WORDS = re.compile("§|" + _TOKEN.pattern)
_QUOTED = re.compile(r"`[^`\n]*`")
_chunks: dict[str, tuple[str, ...]] = {}
_lettered: dict[str, int] = {}  # stretches that hold single letters, and how many


def _pieces(chunk: str) -> tuple[str, ...]:
    """Normalised words of a stretch without blanks."""
    if chunk.isascii():
        found = _WORDS.findall(_CODE.sub(" § ", chunk).lower())
    else:
        text = unicodedata.normalize("NFKC", chunk)
        text = "".join(c for c in text if c < "\x7f" or unicodedata.category(c) != "Cf")
        found = []
        for w in _WORDS.findall(_CODE.sub(" § ", text).casefold().translate(LOOK_ALIKE)):
            found += list(w) if not w.isascii() and any(map(_is_cjk, w)) else [w]
    return tuple(_RUN.sub(r"\1", w if w.isalpha() or w == "§" or not any(map(str.isalpha, w)) else w.translate(LEET)) for w in found)


def _is_single(w: str) -> bool:
    return len(w) == 1 and w.isalpha() and not _is_cjk(w)


def tokens(passage: str) -> list[str]:
    """Normalised words: names of code become one sign, look-alikes and letter digits fold, spaced letters join."""
    if "`" in passage:
        passage = _QUOTED.sub(" § ", passage)
    if len(_chunks) > 500_000:
        _chunks.clear()
        _lettered.clear()
    stretches = passage.split()
    found = [_chunks.get(c) for c in stretches]
    if None in found:
        found = [_learn(c) if words is None else words for c, words in zip(stretches, found)]
    out = list(chain.from_iterable(found))
    if _lettered.keys().isdisjoint(stretches) or sum([_lettered.get(c, 0) for c in stretches]) < 3:
        return out
    return _joined(out)


def _learn(chunk: str) -> tuple[str, ...]:
    words = _chunks[chunk] = _pieces(chunk)
    letters = sum(map(_is_single, words))
    if letters:
        _lettered[chunk] = letters
    return words


def _joined(words: list[str]) -> list[str]:
    """Three or more single letters in a row become one word."""
    out: list[str] = []
    single: list[str] = []
    for w in [*words, ""]:
        if w and _is_single(w):
            single.append(w)
            continue
        out += [_RUN.sub(r"\1", "".join(single))] if len(single) >= 3 else single
        single = []
        out.append(w)
    return out[:-1]


class Postings:
    """Index from pairs of integers below `size` to (row, weight) entries."""

    def __init__(self, size: tuple[int, int], left: np.ndarray, right: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        self.size = size
        keys = self._key(left, right)
        order = np.argsort(keys, kind="stable")
        self.rows, self.weights = rows[order], weights[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.left, self.right = left[order][first].astype(np.int32), right[order][first].astype(np.int32)
        self.ends = np.append(first, len(keys))
        self._hash()

    def _hash(self) -> None:
        self.dense = None
        if self.size[0] * self.size[1] <= DENSE:  # a plain table where it is small
            self.dense = np.full(self.size[0] * self.size[1], -1, np.int32)
            self.dense[self.left.astype(np.int64) * self.size[1] + self.right] = np.arange(len(self.keys))
            return
        self.bits = np.uint32(32 - max(10, (8 * len(self.keys)).bit_length()))
        slot = (self.spin(self.left, 0) + self.spin(self.right, 1)) >> self.bits
        self.place = np.full(1 << (32 - int(self.bits)), -1, np.int32)
        self.place[slot] = np.arange(len(self.keys))
        self.shared = np.zeros(len(self.place), bool)
        self.shared[slot[self.place[slot] != np.arange(len(slot))]] = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": None, "shared": None, "dense": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._hash()

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) + right

    @staticmethod
    def spin(values: np.ndarray, side: int) -> np.ndarray:
        """What a value adds to the hash of a pair on either side."""
        return values.astype(np.uint32) * np.uint32((0x9E3779B1, 0x85EBCA77)[side])

    def find(self, left: np.ndarray, right: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which of the pairs (left[x], right[y]) are there, their places in the index).

        By a plain table or a hash table, by search where pairs share a slot of the latter. Without x and y, all pairs in turn.
        """
        pick = (lambda values, at: values if at is None else values[at])
        if self.dense is not None:
            at = self.dense[pick(left * np.int32(self.size[1]), x) + pick(right, y)]
            hit = np.flatnonzero(at >= 0)
            return hit, at[hit]
        slot = (pick(self.spin(left, 0), x) + pick(self.spin(right, 1), y)) >> self.bits
        at = self.place[slot]
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        l, r = left[hit if x is None else x[hit]], right[hit if y is None else y[hit]]
        same = (self.left[at] == l) & (self.right[at] == r)
        other = np.flatnonzero(~same & self.shared[slot[hit]])
        if len(other):
            key = self._key(l[other], r[other])
            at[other] = np.searchsorted(self.keys, key).clip(0, len(self.keys) - 1)
            same[other] = self.keys[at[other]] == key
        return hit[same], at[same]

    def add(self, at: np.ndarray, owner: np.ndarray, value: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Sums of value times weight by (owner, row) over all entries of the places."""
        item, entry = _spread(self.ends[at], self.ends[at + 1])
        cells = owner[item] * shape[1] + self.rows[entry]
        return np.bincount(cells, value[item] * self.weights[entry], shape[0] * shape[1]).reshape(shape)

    def fold(self, by_row: np.ndarray) -> np.ndarray:
        """One number per key: the sum of its entries' weights times by_row."""
        return np.add.reduceat(self.weights * by_row[self.rows], self.ends[:-1]) if len(self.keys) else np.zeros(0)


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, position) of every position in the ranges [begin, end) of the items."""
    size = end - begin
    item = np.repeat(np.arange(len(size), dtype=np.int32), size)
    shift = (begin - np.cumsum(size) + size).astype(np.int32)
    return item, np.arange(len(item), dtype=np.int32) + shift[item]


class WordKernel:
    """Soft matches between any word and a fixed vocabulary, by gapped character subsequences of up to three letters.

    A word of one or two letters has no subsequence of three and matches itself alone.
    """

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = vocabulary
        self.exact = {w: i for i, w in enumerate(vocabulary)}
        self.own = np.ones((3, len(vocabulary)))
        entries: dict[str, list[tuple[int, float]]] = {}
        for i, w in enumerate(vocabulary):
            if len(w) >= 3:
                found = subsequences(w)
                self.own[:, i] = _squares(found)
                for part, weight in found.items():
                    entries.setdefault(part, []).append((i, weight))
        self.index = {part: (np.array([i for i, _ in e]), np.array([x for _, x in e])) for part, e in entries.items()}
        self.forget()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "found": [], "counts": [], "joined": None}

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[int] = []  # of matches
        self.joined: tuple | None = None

    def number(self, word: str) -> int:
        """Place of the word's matches in `found`."""
        no = self.known.get(word)
        if no is None:
            no = self.known[word] = len(self.found)
            self.found.append(self._matches(word))
            self.counts.append(len(self.found[-1][0]))
        return no

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, vocabulary indexes, similarities) of the matches of every known word, one after the other."""
        if self.joined is None or len(self.joined[0]) != len(self.found) + 1:
            words = np.concatenate([np.zeros(0, np.int32), *(at for at, _ in self.found)])
            sims = np.concatenate([np.zeros(0, np.float32), *(s for _, s in self.found)])
            self.joined = (np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64))), words, sims)
        return self.joined

    def matches(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary indexes, similarity in (0, 1]) of the words that match; none is filtered out beforehand."""
        return self.found[self.number(word)]

    def _matches(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        if len(word) < 3:
            at = self.exact.get(word)
            return np.array([] if at is None else [at], np.int32), np.ones(0 if at is None else 1, np.float32)
        sim = self.similarity(word)
        rows = np.flatnonzero(sim > LEAST)
        return rows.astype(np.int32), ((sim[rows] - LEAST) / (1 - LEAST)).clip(0, 1).astype(np.float32)

    def similarity(self, word: str) -> np.ndarray:
        """Weighted mean of the normalised kernels with every vocabulary word; 0 with those under three letters."""
        mine = subsequences(word)
        own = _squares(mine)
        rows: list[list[np.ndarray]] = [[], [], []]
        values: list[list[np.ndarray]] = [[], [], []]
        for part, weight in mine.items():
            entry = self.index.get(part)
            if entry is not None:
                rows[len(part) - 1].append(entry[0])
                values[len(part) - 1].append(weight * entry[1])
        sim = np.zeros(len(self.vocabulary))
        for k, share in enumerate((0.2, 0.3, 0.5)):
            if rows[k]:
                cross = np.bincount(np.concatenate(rows[k]), np.concatenate(values[k]), len(sim))
                sim += share * cross / np.sqrt(np.maximum(self.own[k] * own[k], 1e-12))
        return sim


def subsequences(word: str) -> dict[str, float]:
    """Weights of the subsequences of one to three letters: each occurrence counts by its gaps.

    One pass over the word, so long ones cost no more for each letter; what gaps bring below 1e-12 is dropped.
    """
    out: dict[str, float] = {}
    one: dict[str, float] = {}
    two: dict[str, float] = {}
    for c in word:
        for part, weight in two.items():
            out[part + c] = out.get(part + c, 0.0) + weight
        two = {part: weight * CHAR_DECAY for part, weight in two.items() if weight > 1e-12}
        for part, weight in one.items():
            out[part + c] = out.get(part + c, 0.0) + weight
            two[part + c] = two.get(part + c, 0.0) + weight
        one = {part: weight * CHAR_DECAY for part, weight in one.items() if weight > 1e-12}
        out[c] = out.get(c, 0.0) + 1.0
        one[c] = one.get(c, 0.0) + 1.0
    return out


def _squares(found: dict[str, float]) -> np.ndarray:
    total = np.zeros(3)
    for part, weight in found.items():
        total[len(part) - 1] += weight * weight
    return total


class PassageKernel:
    """Kernel of a passage with every landmark: gapped common subsequences of one to three softly matching words."""

    def __init__(self, landmarks: list[list[str]]):
        self.landmarks = landmarks
        vocabulary = list(dict.fromkeys(w for words in landmarks for w in words))
        self.words = WordKernel(vocabulary)
        self.longest = max((len(w) for w in landmarks), default=1)
        self.span = WINDOW + 1
        self.norms: list[np.ndarray] = []
        self.places = np.full((len(landmarks), self.longest), len(vocabulary), np.int64)
        for i, words in enumerate(landmarks):
            self.places[i, : len(words)] = [self.words.exact[w] for w in words]
        steps = np.arange(self.longest)
        self.scan = np.where(
            steps[:, None] <= steps[None, :], WORD_DECAY ** (steps[None, :] - steps[:, None]).clip(0), 0.0
        ).astype(np.float32)
        self.row = np.zeros(len(vocabulary) + 1, np.float32)
        self._index()
        self.own = np.zeros((3, len(landmarks)))
        for plain, part, ids, lengths in self._batches(*self._numbers(landmarks)):  # soft matches within a landmark count in its own norm
            if plain:
                self.own[:, part] = self._kernels(landmarks[part[0]])[:, part]
            else:
                for k, (p, (at, owner, value)) in enumerate(zip(self.index, self._hits(ids, lengths))):
                    item, entry = _spread(p.ends[at], p.ends[at + 1])
                    mine = part[owner[item]] == p.rows[entry]
                    self.own[k, part] = np.bincount(owner[item][mine], (value[item] * p.weights[entry])[mine], len(part))

    def _index(self) -> None:
        """Postings of the landmarks' subsequences of one, two and three words, weighted by their gaps.

        A subsequence of one word is keyed (word, 0), of two (word, word), of three (place of the first two, word).
        """
        parts: list[list[tuple]] = [[], [], []]
        for row, words in enumerate(self.landmarks):
            ids = self.places[row, : len(words)]
            a, b = np.triu_indices(len(ids), 1)
            x, c = _spread(b + 1, np.full(len(b), len(ids)))
            parts[0].append((ids, np.zeros_like(ids), np.full(len(ids), row), np.ones(len(ids))))
            parts[1].append((ids[a], ids[b], np.full(len(a), row), WORD_DECAY ** (b - a - 1.0)))
            parts[2].append((ids[a[x]], ids[b[x]], ids[c], np.full(len(x), row), WORD_DECAY ** (c - a[x] - 2.0)))
        columns = lambda part, n: [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in part)]) for i in range(n)]
        n = len(self.words.vocabulary)
        self.ones, self.twos = Postings((n, 1), *columns(parts[0], 4)), Postings((n, n), *columns(parts[1], 4))
        a, b, c, rows, weights = columns(parts[2], 5)
        self.threes = Postings((len(self.twos.keys), n), self.twos.find(a.astype(np.int32), b.astype(np.int32))[1], c, rows, weights)
        self.index = (self.ones, self.twos, self.threes)

    def _hits(self, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For subsequences of one, two and three words: (place in the index, passage, value) of every soft match.

        ids: the numbers of the words of all passages, lengths: how many each passage has.
        """
        owners, at = _spread(np.cumsum(lengths) - lengths, np.cumsum(lengths))
        places = at - (np.cumsum(lengths) - lengths).astype(np.int32)[owners]
        ends, all_words, all_sims = self.words.flat()
        item, entry = _spread(ends[ids], ends[ids + 1])
        word, sim = all_words[entry], all_sims[entry]
        owner, place = owners[item], places[item]
        hit, one = self.ones.find(word, np.zeros_like(word))
        out = [(one, owner[hit], sim[hit])]
        after = np.cumsum(np.bincount(item, minlength=len(ids)))[item]  # partners at later places of the same passage
        last = np.cumsum(np.bincount(owner, minlength=len(lengths)))[owner]
        x, y = _spread(after, last)
        hit, pair = self.twos.find(word, word, x, y)
        x, y = x[hit], y[hit]  # x never falls, so the pairs that go on from y are a range
        decay = (WORD_DECAY ** np.arange(self.span)).astype(np.float32)
        out.append((pair, owner[x], sim[x] * sim[y] * decay[place[y] - place[x] - 1]))
        begin = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(word)))))
        former, latter = _spread(begin[y], begin[y + 1])
        third = y[latter]
        hit, three = self.threes.find(pair, word, former, third)
        former, c = former[hit], third[hit]
        a, b = x[former], y[former]
        out.append((three, owner[a], sim[a] * sim[b] * sim[c] * decay[place[c] - place[a] - 2]))
        return out

    def _kernels(self, words: list[str]) -> np.ndarray:
        n = len(self.landmarks)
        total = np.zeros((3, n), np.float32)
        first = np.zeros((n, self.longest), np.float32)
        second = np.zeros_like(first)
        touched = False
        for w in words:
            at, sim = self.words.matches(w)
            if not len(at):
                first *= WORD_DECAY
                second *= WORD_DECAY
                continue
            self.row[at] = sim
            match = self.row[self.places]
            self.row[at] = 0
            total[0] += match.sum(1)
            if touched:
                step1 = match[:, 1:] * first[:, :-1]
                step2 = match[:, 1:] * second[:, :-1]
                total[1] += step1.sum(1)
                total[2] += step2.sum(1)
                second *= WORD_DECAY
                second[:, 1:] += step1 @ self.scan[1:, 1:]
            first *= WORD_DECAY
            first += match @ self.scan
            touched = True
        return total

    def self_norms(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Kernels of passages with themselves, (3, passages), words matching exactly; of distinct words by their number."""
        owners = np.repeat(np.arange(len(lengths)), lengths)
        key = np.sort(owners * (len(self.words.found) + 1) + ids)
        again = np.unique(key[1:][key[1:] == key[:-1]] // (len(self.words.found) + 1))
        most = int(lengths.max(initial=0))
        while len(self.norms) <= most:
            self.norms.append(self._norms(np.arange(len(self.norms)).reshape(1, -1))[:, 0])
        out = np.array(self.norms)[lengths].T
        starts = np.cumsum(lengths) - lengths
        for n in np.unique(lengths[again]):
            at = again[lengths[again] == n]
            out[:, at] = self._norms(ids[starts[at][:, None] + np.arange(n)])
        return out

    @staticmethod
    def _norms(codes: np.ndarray) -> np.ndarray:
        rows, n = codes.shape
        out = np.zeros((3, rows))
        steps = np.arange(n)
        scan = np.where(steps[:, None] <= steps[None, :], WORD_DECAY ** (steps[None, :] - steps[:, None]).clip(0), 0.0)
        first, second = np.zeros((rows, n)), np.zeros((rows, n))
        for i in range(n):
            match = (codes == codes[:, i : i + 1]).astype(float)
            step1, step2 = np.zeros_like(match), np.zeros_like(match)
            step1[:, 1:] = match[:, 1:] * first[:, :-1]
            step2[:, 1:] = match[:, 1:] * second[:, :-1]
            out += [match.sum(1), step1.sum(1), step2.sum(1)]
            first = WORD_DECAY * first + match @ scan
            second = WORD_DECAY * second + step1 @ scan
        return out

    def _numbers(self, batch: list) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all passages, how many each has)."""
        if len(self.words.known) > 300_000:
            self.words.forget()
        known = self.words.known
        for word in set().union(*batch) - known.keys():
            self.words.number(word)
        return np.array([known[w] for words in batch for w in words], np.int64), np.fromiter(map(len, batch), np.int64, len(batch))

    def _batches(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
        """(whether the plain recursion is cheaper, indexes, word numbers, lengths) of groups that take bounded memory."""
        ends = np.cumsum(lengths)
        counts = np.array(self.words.counts, np.int64)[ids] if len(ids) else ids
        matched = np.concatenate(([0], np.cumsum(counts)))
        size = matched[ends] - matched[ends - lengths]
        plain = (size > CROWDED) | (lengths >= self.span)
        for k in np.flatnonzero(plain):
            yield True, np.array([k]), ids[ends[k] - lengths[k] : ends[k]], lengths[k : k + 1]
        rest = np.flatnonzero(~plain)
        group = np.cumsum(size[rest] ** 2) // BATCH
        for part in np.split(rest, np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                yield False, part, ids[_spread(ends[part] - lengths[part], ends[part])[1]], lengths[part]

    def features(self, batch: list[list[str]]) -> np.ndarray:
        """Normalised kernel of every passage with every landmark: the mean of the orders."""
        out = np.zeros((len(batch), len(self.landmarks)), np.float32)
        numbers = self._numbers(batch)
        mine = self.self_norms(*numbers)
        for plain, part, ids, lengths in self._batches(*numbers):
            if plain:
                cross = self._kernels(batch[part[0]])[:, None]
            else:
                shape = (len(part), len(self.landmarks))
                cross = np.stack([p.add(at, owner, value, shape) for p, (at, owner, value) in zip(self.index, self._hits(ids, lengths))])
            out[part] = self._normal(cross, mine[:, part])
        return out

    def _normal(self, cross: np.ndarray, mine: np.ndarray) -> np.ndarray:
        norm = self.own[:, None, :] * mine[:, :, None]
        return np.where(norm > 1e-9, cross / np.sqrt(np.maximum(norm, 1e-9)), 0.0).mean(0)

    def fold(self, weights: np.ndarray) -> None:
        """Prepare `weighted`: the weights of the landmarks are summed into the index, once for each of its keys."""
        self.by_row = np.where(self.own > 1e-9, weights / np.sqrt(np.maximum(self.own, 1e-9)), 0.0) / 3
        self.folded = [p.fold(r) for p, r in zip(self.index, self.by_row)]

    def weighted(self, batch: list[list[str]]) -> np.ndarray:
        """features(batch) @ weights: a machine that is linear in the kernels needs no row for each landmark."""
        numbers = self._numbers(batch)
        cross = np.zeros((3, len(batch)))
        for plain, part, ids, lengths in self._batches(*numbers):
            if plain:
                cross[:, part] = (self._kernels(batch[part[0]]) * self.by_row).sum(1, keepdims=True)
            else:
                for k, (f, (at, owner, value)) in enumerate(zip(self.folded, self._hits(ids, lengths))):
                    cross[k, part] = np.bincount(owner, value * f[at], len(part))
        mine = self.self_norms(*numbers)
        return np.where(mine > 1e-9, cross / np.sqrt(np.maximum(mine, 1e-9)), 0.0).sum(0)


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps; y in {-1, 1}, cost by row."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    active = np.zeros(len(z), bool)
    now = ~active
    square, side = np.zeros_like(ridge), np.zeros(z.shape[1])
    for _ in range(rounds):
        rows = np.flatnonzero(now != active)  # the sums change by the rows that come and go
        signed = z[rows] * np.where(now[rows], cost[rows], -cost[rows])[:, None]
        square += signed.T @ z[rows]
        side += signed.T @ y[rows]
        active = now
        w = np.linalg.solve(ridge + square, side)
        now = y * (z @ w) < 1
        if (now == active).all():
            break
    return w[:-1], float(w[-1])


class Machine:
    """The trained scorer: a kernel machine over the landmarks."""

    def __init__(self, landmarks: list[list[str]], weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.kernel = PassageKernel(landmarks)
        self.kernel.fold(weights)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[tuple, float] = {}
        self.raw: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "raw": {}}

    def score(self, passage: str) -> float:
        """Distance from the machine's boundary less MARGIN: above 0 is abusive. Long passages are scored in overlapping windows."""
        return self.scores([passage])[0]

    def scores(self, several: list[str]) -> list[float]:
        """The score of each passage; every window is asked of the full kernel."""
        if len(self.memo) + len(self.raw) > 400_000:
            self.forget()
        unseen = [p for p in dict.fromkeys(several) if p not in self.raw]
        cut = [windows(tokens(p)) for p in unseen]
        new = [w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.memo]
        if new:
            self.memo.update(zip(new, (self.kernel.weighted(new) + self.bias).tolist()))
        self.raw.update(zip(unseen, (max([self.memo[w] for w in ws], default=-1.0) - MARGIN for ws in cut)))
        return [self.raw[p] for p in several]


def windows(words: list[str]) -> list[tuple[str, ...]]:
    """The words in overlapping windows of WINDOW at most; none for no words."""
    if len(words) <= WINDOW:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]


def _landmarks(groups: list[list[list[str]]], most: int) -> list[list[str]]:
    """Passages that differ from each other, `most` at most of each group: a new one shares under 60 % of its words."""
    chosen: list[list[str]] = []
    sets: list[tuple[int, int]] = []  # words as bits, and how many
    bits: dict[str, int] = {}
    for group in groups:
        taken = 0
        for words in group:
            if taken >= most:
                break
            own = 0
            for w in set(words) - {"§"}:
                own |= 1 << bits.setdefault(w, len(bits))
            n = own.bit_count()
            if n >= 2 and all((own & s).bit_count() < 0.6 * min(n, m) for s, m in sets):
                chosen.append(words[:WINDOW])
                sets.append((own, n))
                taken += 1
    return chosen


def train(labelled: list[tuple[str, float, int]], landmarks: int = LANDMARKS) -> Machine | None:
    """Fit a machine to (text, mean rating, raters); null where either class is missing."""
    bags = [([w for p in passages(text) for w in windows(tokens(p))], rating, raters) for text, rating, raters in labelled]
    dirty = [(b, n) for b, r, n in bags if r > 0.5 and b]
    clean = [b for b, r, _ in bags if r < 0.5 and b]
    if not dirty or not clean:
        return None
    common: dict[str, int] = {}
    for bag in clean:
        for w in {w for p in bag for w in p}:
            common[w] = common.get(w, 0) + 1
    usual = {w for w, n in common.items() if n > 0.004 * len(clean)}
    strange = lambda p: sum([w not in usual for w in p]) / len(p) ** 0.5
    likely = sorted((p for bag, _ in dirty for p in bag if len(p) >= 2), key=lambda p: (-strange(p), p))
    seen: dict[tuple, list[str]] = {}
    for bag in clean:
        for p in bag:
            seen.setdefault(tuple(p), p)
    plain = sorted(seen.values(), key=lambda p: (-strange(p), p))
    marks = _landmarks([likely, plain], landmarks)
    kernel = PassageKernel(marks)
    gram = kernel.features(marks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-3 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    rows: dict[tuple, int] = {}
    where = lambda p: rows.setdefault(p, len(rows))
    clean_rows = sorted({where(p) for bag in clean for p in bag})
    dirty_rows = [(sorted({where(p) for p in bag}), n) for bag, n in dirty]
    parts = list(rows)
    full_x = kernel.features(parts) @ root.astype(np.float32)
    unit = full_x / np.maximum(np.linalg.norm(full_x, axis=1, keepdims=True), 1e-9)
    weight = np.zeros(len(parts))
    for bag in clean:
        for p in bag:
            weight[rows[p]] += 1
    negative = weight > 0
    strangeness = np.array([strange(list(p)) for p in parts])
    score = strangeness - 3.0 * negative
    model = None
    for k in range(ROUNDS):
        y = -np.ones(len(parts))
        vote = np.zeros(len(parts))
        for ids, raters in dirty_rows:
            best = max(ids, key=lambda i: score[i])
            for i in ids:
                if i == best or (k and score[i] > 0):
                    vote[i] += 0.5 + 0.5 * min(raters, 3)
        positive = vote > np.minimum(weight, 50) * 0.5
        if k:  # an erring rater's pick looks like what clean documents are full of
            at = np.flatnonzero(positive)
            near = unit[at] @ unit.T > 0.45
            positive[at[near @ negative > 2 * (near @ positive)]] = False
        y[positive] = 1
        cost = np.where(positive, 2.0 + np.minimum(vote, 20), np.where(weight > 0, 1.0 + np.minimum(weight, 20) ** 0.5, 0.3))
        model = svm(full_x, y, cost)
        score = full_x @ model[0] + model[1]
    return Machine(marks, root @ model[0], model[1])


def labelled_texts(documents: DataFrame, content_label: DataFrame, most: int = LABELLED) -> list[tuple[str, float, int]]:
    """At most `most` labelled documents of each class with their mean rating, in the order of a hash; ties are left out."""
    rated = (
        content_label.where(F.col("abusive").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col("abusive").cast("double")).alias("rating"), F.count("*").cast("int").alias("raters"))
        .where("rating <> 0.5")
    )
    pick = lambda side: rated.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    some = pick(F.col("rating") > 0.5).unionByName(pick(F.col("rating") < 0.5))
    texts = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    rows = texts.orderBy(F.col("rating") < 0.5, "doc_id", "text").collect()  # at most `most` documents of each class
    return [(r.text, r.rating, r.raters) for r in rows]


def score_documents(documents: DataFrame, content_label: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(doc_id, source, score, passage): every document with its highest passage score and that passage.

    score > 0 means abusive. A null or empty text, and every text where nothing could be learned (no labelled document of
    one class), scores null with a null passage. Repeated rows are scored each, rows
    without doc_id are left out.
    """
    machine = machine or train(labelled_texts(documents, content_label))
    carried = documents.sparkSession.sparkContext.broadcast(machine)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = carried.value
        for frame in frames:
            scores, worst = [], []
            for first in range(0, len(frame), TOGETHER):
                texts = [passages(t) if model is not None else [] for t in frame.text.iloc[first : first + TOGETHER]]
                values = iter(model.scores([p for ps in texts for p in ps]) if model is not None else [])
                for ps in texts:
                    best = max(((next(values), -k) for k in range(len(ps))), default=(None, None))
                    scores.append(best[0])
                    worst.append(None if best[0] is None else ps[-best[1]])
            yield pd.DataFrame({"doc_id": frame.doc_id, "source": frame.source, "score": scores, "passage": worst})

    rows = spread(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text"))
    return rows.mapInPandas(run, "doc_id bigint, source string, score double, passage string")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """(source, docs, abusive, rate) over the scored documents; a null source is a group of its own."""
    bad = F.coalesce((F.col("score") > 0).cast("int"), F.lit(0))
    return scored.groupBy("source").agg(F.count("*").alias("docs"), F.sum(bad).alias("abusive"), F.avg(bad).alias("rate"))
