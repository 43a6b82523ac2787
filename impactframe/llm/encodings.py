"""Garbled text from wrong character encoding (problem 1).

Every record has a latent encoding chain: the bytes of its true text were read in a wrong encoding, once or more often.
Expectation-maximization fits, over all records, a character model of true text and a prior of chains per source and
field, so that weak evidence of single words adds up; each record is then repaired by the posterior of its chain.

The character model lives in count tables of fixed size (hashed n-grams), the only thing broadcast. Priors are joined by
source. Only text with characters outside ASCII, or with NUL, enters Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.session import spread, stage

#: Buckets of each n-gram table; three tables of float32 are 3 MB.
BUCKETS = 1 << 18
ROUNDS = 4
#: Weight of the next shorter n-gram against counted ones, and of all sources' prior against one source's.
BACKOFF, POOL = 4.0, 20.0
#: Taken off every n-gram count, so that no word vouches for itself.
DISCOUNT = 1.0
#: In the first round, odds for a chain by every foreign character that it explains away.
EVIDENCE = 100.0
#: Share of a garbled record's words that stay intact, and of words that follow another chain than their record's.
INTACT, STRAY = 0.05, 1e-4
#: Rows of priors (one number per chain each) up to which they are broadcast; copies of them in the salted join beyond.
FEW_SOURCES, SALTS = 20_000, 16
LOST = "�"

# Encodings in which UTF-8 is misread, pairs (true, read as) of other misreadings, and UTF-16 accidents.
UTF8_READ_AS = (
    "western", "cp437", "cp850", "cp1251", "gbk", "cp1250", "cp1254", "koi8_r", "mac_roman", "cp866", "shift_jis", "big5",
    "euc_kr", "iso8859_15", "cp1253",
)
READ_AS = (
    ("cp1251", "western"), ("cp1250", "western"), ("iso8859_2", "western"), ("cp1254", "western"), ("gbk", "western"),
    ("cp932", "western"), ("big5", "western"), ("euc_jp", "western"), ("euc_kr", "western"), ("koi8_r", "western"),
    ("cp866", "western"), ("cp1253", "western"), ("cp1255", "western"), ("cp437", "western"), ("cp850", "western"),
    ("mac_roman", "western"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("western", "cp437"), ("western", "cp850"), ("western", "cp1251"), ("western", "gbk"), ("western", "mac_roman"),
    ("western", "cp1250"), ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "big5"), ("big5", "gbk"), ("euc_jp", "cp932"),
    ("cp1251", "cp437"), ("gbk", "cp437"), ("cp1250", "cp437"), ("cp1250", "cp850"),
)

IDENTITY = 0
CHAINS: list[tuple[str, tuple]] = [("intact", ())]
CHAINS += [(f"utf-8 as {w}", ((w, "utf-8"),)) for w in UTF8_READ_AS]
CHAINS += [("utf-8 as western twice", (("western", "utf-8"),) * 2), ("utf-8 as western three times", (("western", "utf-8"),) * 3)]
CHAINS += [("utf-8 as cp1251 twice", (("cp1251", "utf-8"),) * 2), ("utf-8 as gbk twice", (("gbk", "utf-8"),) * 2)]
CHAINS += [(f"{r} as {w}", ((w, r),)) for r, w in READ_AS]
CHAINS += [("utf-16 with bytes swapped", (("utf-16-le", "utf-16-be"),)), ("utf-16-le as western", (("western", "utf-16-le"),))]
CHAINS += [("utf-16-be as western", (("western", "utf-16-be"),))]
CHAINS += [("characters lost", ())]
GONE = len(CHAINS) - 1
#: Chains back to an encoding that few byte sequences fit by chance.
SELF_CHECKING = frozenset(i for i, (_, steps) in enumerate(CHAINS) if steps and steps[-1][1].startswith("utf-"))

_WORD = re.compile(r"[A-Za-z0-9_]*[^\x01-\x7f](?:[^ \t\r\n\f\v\"'<>]*[^\x01-\x7f])?[A-Za-z0-9_]*")
_BLANK = re.compile(r"[ \t\r\n\f\v]+")
_NUL = re.compile(r"[^\x00]?\x00(?:[\s\S]*\x00)?[^\x00]?")


@lru_cache(8)
def _western() -> tuple[dict, dict]:
    """Windows-1252 whose five undefined bytes read as C1 controls, as most software has it."""
    chars = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
    return {c: b for b, c in chars.items()} | {chr(b): b for b in range(0x80, 0xA0)}, chars


@lru_cache(64)
def _loose(codec: str) -> dict:
    """Single-byte codec whose undefined bytes read as C1 controls."""
    return {(bytes([b]).decode(codec, "ignore") or chr(b)): b for b in range(256)}


_SINGLE = {"cp437", "cp850", "cp1251", "cp1250", "cp1254", "koi8_r", "mac_roman", "cp866", "iso8859_15", "cp1253"}


def _to_bytes(text: str, codec: str) -> bytes | None:
    try:
        if codec == "western":
            return bytes(map(_western()[0].__getitem__, text))
        if codec in _SINGLE:
            return bytes(map(_loose(codec).__getitem__, text))
        return text.encode(codec)
    except (KeyError, UnicodeError):
        return None


def _to_text(data: bytes, codec: str) -> str | None:
    try:
        if codec == "western":
            return "".join(map(_western()[1].__getitem__, data))
        return data.decode(codec)
    except UnicodeError:
        return None


def undo(text: str, steps: tuple) -> str | None:
    """The text before it was misread, or null where the chain cannot have made this text.

    Where characters were lost (U+FFFD), what is between them is undone and the gaps stay.
    """
    for wrong, right in steps:
        if LOST in text:
            if right != "utf-8":
                return None
            parts = [_to_bytes(p, wrong) for p in text.split(LOST)]
            if any(p is None for p in parts):
                return None
            text = re.sub(LOST + "+", LOST, b"\xff".join(parts).decode("utf-8", "replace"))
            if text.count(LOST) * 2 > len(text) + 1:
                return None
            continue
        data = _to_bytes(text, wrong)
        if data is None:
            return None
        if right.startswith("utf-16") and len(data) % 2:
            data = data + b"\0" if data[-1] else data[:-1]
        text = _to_text(data, right)
        if text is None:
            return None
    return text


_PLAIN = {"\t", "\n", "\r", "\f", LOST}


def _written(text: str) -> bool:
    """Whether people write such text: no controls, private or unassigned characters."""
    return all(c.isprintable() or c in _PLAIN or unicodedata.category(c) in ("Zs", "Cf") for c in text)


@lru_cache(200_000)
def candidates(word: str) -> tuple[tuple[int, str], ...]:
    """(chain, true text) of every chain that can have made the word, intact first."""
    found = [(IDENTITY, word)]
    for chain, (_, steps) in enumerate(CHAINS):
        if steps:
            before = undo(word, steps)
            if before and before != word and _written(before):
                found.append((chain, before))
    if LOST in word:
        found.append((GONE, word))
    return tuple(found)


def words_of(text: str) -> list[tuple[int, int]]:
    """Spans of the text that may be garbled: words with characters outside ASCII, or one stretch around NULs."""
    if "\0" in text:
        m = _NUL.search(text)
        return [m.span(), *[(a + m.end(), b + m.end()) for a, b in words_of(text[m.end() :])]]
    return [m.span() for m in _WORD.finditer(text)]


class CharacterModel:
    """Interpolated character trigrams in hashed count tables."""

    def __init__(self, one: np.ndarray, two: np.ndarray, three: np.ndarray):
        self.one, self.two, self.three, self.total = one, two, three, float(one.sum())

    @staticmethod
    def counts(weights: dict[str, float]) -> list[np.ndarray]:
        """Weighted n-gram counts of texts; an n-gram counts once in each text."""
        texts, each = list(weights), np.array(list(weights.values()))
        _, *keys, _ = CharacterModel.keys(texts)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        tables = []
        for key in keys:
            once = np.unique(owner * BUCKETS + key[1:])
            tables.append(np.bincount(once % BUCKETS, weights=each[once // BUCKETS], minlength=BUCKETS))
        return tables

    @staticmethod
    def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the three bucket arrays and the start of each text; every text ends with a mark."""
        codes = np.frombuffer(("\x02" + "\x02".join(texts) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = codes.astype(np.uint64)
        before = np.concatenate(([2], codes[:-1])).astype(np.uint64)
        second = np.where(before == 2, np.uint64(2), np.concatenate(([2, 2], codes[:-2])).astype(np.uint64))
        mix = lambda x: (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
        pair = before * np.uint64(0x200003) + codes
        triple = (second * np.uint64(0x400009) + before) * np.uint64(0x200003) + codes + np.uint64(77)
        starts = np.concatenate(([1], np.cumsum([len(t) + 1 for t in texts])[:-1] + 1)).astype(np.int64)
        return codes, mix(codes), mix(pair), mix(triple), starts

    def score(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text."""
        codes, k1, k2, k3, starts = self.keys([_BLANK.sub("\x02", t) for t in texts])
        ascii_ = (codes >= 32) & (codes < 127)
        base = np.where(ascii_, 0.5 / 95, np.where(codes == 0xFFFD, 1e-9, 0.5 / 1.1e6))
        less = lambda table, k: np.maximum(table[k] - DISCOUNT, 0.0)
        p1 = (less(self.one, k1) + BACKOFF * base) / (self.total + BACKOFF)
        back1, back2 = np.concatenate(([0], k1[:-1])), np.concatenate(([0], k2[:-1]))
        p2 = (less(self.two, k2) + BACKOFF * p1) / (self.one[back1] + BACKOFF)
        begun = np.where(np.concatenate(([True], codes[:-1] == 2)), self.one[back1], self.two[back2])  # a text begins without a pair
        p3 = (less(self.three, k3) + BACKOFF * p2) / (begun + BACKOFF)
        return np.add.reduceat(np.log(np.minimum(p3, 1.0)), starts)


#: Words of records that are judged together.
CHUNK = 40_000


class Batch:
    """Records as arrays: their words by number, and the true forms of each distinct word."""

    def __init__(self, records: list[list[str]]):
        self.vocabulary = list(dict.fromkeys(chain.from_iterable(records)))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.word = np.array([number[w] for words in records for w in words], np.int64)
        self.sizes = np.fromiter(map(len, records), np.int64, len(records))
        self.owner = np.repeat(np.arange(len(records)), self.sizes)
        self.options = [candidates(w) for w in self.vocabulary]
        sizes = [len(o) for o in self.options]
        self.row = np.repeat(np.arange(len(sizes)), sizes)  # of each (distinct word, chain, text)
        self.chain = np.array([c for o in self.options for c, _ in o], np.int64)
        self.text = [t for o in self.options for _, t in o]

    def table(self, values: np.ndarray, empty: float) -> np.ndarray:
        """Values of the forms as a matrix, distinct words by chains."""
        out = np.full((len(self.vocabulary), len(CHAINS)), empty)
        out[self.row, self.chain] = values
        return out

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sums over the words of each record."""
        out = np.zeros((len(self.sizes), per_word.shape[1]))
        filled = np.flatnonzero(self.sizes)
        if len(filled):
            starts = np.cumsum(self.sizes) - self.sizes
            out[filled] = np.add.reduceat(per_word, starts[filled], axis=0)
        return out

    def credits(self, per_word: np.ndarray) -> dict[str, float]:
        """Weight of every part of the true forms; per_word: each record's words by chains."""
        total = np.zeros((len(self.vocabulary), len(CHAINS)))
        for c in np.flatnonzero(per_word.any(axis=0)):
            total[:, c] = np.bincount(self.word, per_word[:, c], len(self.vocabulary))
        weights: dict[str, float] = {}
        for k in np.flatnonzero(total[self.row, self.chain]):
            _credit(weights, self.text[k], total[self.row[k], self.chain[k]])
        return weights

    def first_guess(self) -> np.ndarray:
        """Posterior of each record's chain before any text is known: by the foreign characters that a chain explains away."""
        foreign = np.array([sum(c > "\x7f" or c == "\0" for c in w) for w in self.vocabulary], float)
        left = np.array([sum(c > "\x7f" for c in t) if c in SELF_CHECKING else 0 for c, t in zip(self.chain.tolist(), self.text)], float)
        checks = np.isin(self.chain, list(SELF_CHECKING))
        gain = self.sums(self.table(np.where(checks, foreign[self.row] - left, 0.0), 0.0)[self.word])
        fits = self.sums(self.table(np.ones(len(self.row)), 0.0)[self.word])
        odds = np.log(START) + np.log(EVIDENCE) * np.minimum(gain, 100)
        odds[fits < 0.5 * self.sizes[:, None]] = -np.inf
        odds[:, IDENTITY] = np.log(START[IDENTITY])
        post = np.exp(odds - odds.max(axis=1, keepdims=True))
        return post / post.sum(axis=1, keepdims=True)

    def first_credits(self) -> dict[str, float]:
        fits = self.table(np.ones(len(self.row)), 0.0)[self.word]
        post = self.first_guess()[self.owner]
        each = np.where((post > 1e-4) & (fits > 0), post, 0.0)
        each[:, IDENTITY] = 0.0
        each[:, IDENTITY] = 1.0 - each.sum(axis=1)
        return self.credits(each)

    def judge(self, model: CharacterModel, prior: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each record's chain (records x chains), and of each word's own chain (words x chains, not normed).

        prior: one row per record; counts: how often its record has each word.
        """
        n = len(CHAINS)
        texts = list(dict.fromkeys(self.text))
        score = dict(zip(texts, model.score(texts))) if texts else {}
        like = np.array([score[t] for t in self.text]) + np.where(self.chain == GONE, 18.0, 0.0)  # a lost character costs little once some were lost
        rel = self.table(like, -np.inf)
        rel = np.exp(rel - rel.max(axis=1, keepdims=True)) if len(rel) else rel
        stray = STRAY * rel.sum(axis=1, keepdims=True) / n
        own = (1 - INTACT) * rel + INTACT * rel[:, [IDENTITY]] + stray
        own[:, [IDENTITY]] = (1 - STRAY) * rel[:, [IDENTITY]] + stray
        own = np.maximum(own, 1e-300)
        weights = counts.astype(float) ** 0.5  # repeats of a word in one record are not independent evidence
        total = np.log(prior + 1e-12) + self.sums(np.log(own)[self.word] * weights[:, None])
        post = np.exp(total - total.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        # P(word's chain w | record's chain z): z itself, intact, or stray
        share = np.where(post > 1e-6, post, 0.0)[self.owner] / own[self.word]
        mine = rel[self.word]
        every = share.sum(axis=1)
        joint = mine * ((1 - INTACT) * share + (STRAY / n * every)[:, None])
        intact = (1 - STRAY) * share[:, IDENTITY] + INTACT * (every - share[:, IDENTITY])
        joint[:, IDENTITY] = mine[:, IDENTITY] * (intact + STRAY / n * every)
        return post, joint


def _chunks(sizes: list[int]) -> Iterator[slice]:
    """Runs of records with about CHUNK words each."""
    begin = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= CHUNK or i + 1 == len(sizes):
            yield slice(begin, i + 1)
            begin, total = i + 1, 0


def _prior_rows(priors) -> np.ndarray:
    return np.array([START if p is None else p for p in priors], float).reshape(-1, len(CHAINS))


def suspects(records: DataFrame) -> DataFrame:
    """(origin, source, words, counts) of every record with characters outside ASCII; words are distinct."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame.text:
                found: dict[str, int] = {}
                for a, b in words_of(text):
                    found[text[a:b]] = found.get(text[a:b], 0) + 1
                rows.append((list(found), list(found.values())))
            out = frame[["origin", "source"]].copy()
            out["words"], out["counts"] = [r[0] for r in rows], [r[1] for r in rows]
            yield out

    return _foreign(records).mapInPandas(run, "origin string, source string, words array<string>, counts array<int>")


def _foreign(records: DataFrame) -> DataFrame:
    return spread(records.where(F.col("text").rlike(r"[^\x01-\x7F]")))


START = np.array([0.9] + [0.1 / (len(CHAINS) - 1)] * (len(CHAINS) - 1))


def _credit(weights: dict[str, float], text: str, weight: float) -> None:
    for part in set(_BLANK.split(text)):
        if part:
            weights[part] = weights.get(part, 0.0) + weight


def fit(found: DataFrame, rounds: int = ROUNDS) -> tuple[tuple[np.ndarray, ...], DataFrame | None]:
    """Character counts and chain priors (origin, source, prior) after `rounds` of expectation-maximization.

    The first model counts each word in the forms that explain its foreign characters best. `found` is read once a round.
    """
    spark = found.sparkSession
    model: tuple | None = None
    priors: DataFrame | None = None
    for k in range(rounds + 1):
        carried = spark.sparkContext.broadcast(model)
        first = k == 0

        def run(frames: Iterator[pd.DataFrame], carried=carried, first=first) -> Iterator[pd.DataFrame]:
            tables = [np.zeros(BUCKETS) for _ in range(3)]
            chains: dict[tuple, np.ndarray] = {}
            model = None if first else CharacterModel(*carried.value)
            for frame in frames:
                words = [list(w) for w in frame.words]
                weights: dict[str, float] = {}
                for part in _chunks([len(w) for w in words]):
                    batch = Batch(words[part])
                    if first:
                        more = batch.first_credits()
                    else:
                        counts = np.concatenate([np.zeros(0, int), *frame.counts.iloc[part]])
                        post, joint = batch.judge(model, _prior_rows(frame.prior.iloc[part]), counts)
                        for key, one in zip(zip(frame.origin.iloc[part], frame.source.iloc[part]), post):
                            chains[key] = chains.get(key, 0) + one
                        more = batch.credits(np.where(joint > 1e-4, joint, 0.0))
                    for text, weight in more.items():
                        weights[text] = weights.get(text, 0.0) + weight
                if weights:
                    for table, more in zip(tables, CharacterModel.counts(weights)):
                        table += more
            for order, table in enumerate(tables):
                at = np.flatnonzero(table)
                yield pd.DataFrame({"kind": order, "bucket": at, "origin": None, "source": None, "n": table[at]})
            rows = [(9, c, o, s, p[c]) for (o, s), p in chains.items() for c in np.flatnonzero(p > 1e-6)]
            yield pd.DataFrame(rows, columns=["kind", "bucket", "origin", "source", "n"])

        read = found.withColumn("prior", F.lit(None).cast("array<double>")) if priors is None else _with_prior(found, priors)
        partial = read.mapInPandas(run, "kind int, bucket bigint, origin string, source string, n double")
        summed = partial.groupBy("kind", "bucket", "origin", "source").agg(F.sum("n").alias("n"))
        summed = stage(summed, "p1-counts")
        counts = summed.where("kind < 9").select("kind", "bucket", "n").toPandas()  # at most 3 * BUCKETS rows
        tables = [np.zeros(BUCKETS, np.float32) for _ in range(3)]
        for order, part in counts.groupby("kind"):
            tables[int(order)][part.bucket.to_numpy(np.int64)] = part.n.to_numpy(np.float32)
        model = tuple(tables)
        if not first:
            priors = _priors(summed.where("kind = 9"))
    return model, priors


def _priors(chains: DataFrame) -> DataFrame:
    """(origin, source, prior): each source's chains, drawn towards those of all sources."""
    overall = chains.groupBy("bucket").agg(F.sum("n")).collect()  # one row per chain
    world = np.full(len(CHAINS), 1e-3)
    for chain, n in overall:
        world[chain] += n
    world /= world.sum()
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), "n")))  # one entry per chain
    mine = chains.groupBy("origin", "source").agg(entries.alias("m"), F.sum("n").alias("total"))
    prior = F.transform(
        F.lit(list(world)),
        lambda p, i: (F.coalesce(F.col("m")[i], F.lit(0.0)) + F.lit(POOL) * p) / (F.col("total") + POOL),
    )
    return mine.select("origin", "source", prior.alias("prior"))


def _with_prior(rows: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds each row's prior; `priors` (one row per origin and source) is broadcast up to FEW_SOURCES rows, counted first,
    else the join is salted, so that a source with many rows spreads."""
    p = priors.withColumnRenamed("origin", "o").withColumnRenamed("source", "s")
    if p.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        return rows.join(F.broadcast(p), (rows.origin == p.o) & rows.source.eqNullSafe(p.s), "left").drop("o", "s")
    own = F.xxhash64(*[c for c in ("record_key", "words") if c in rows.columns])
    salted = rows.withColumn("salt", F.pmod(own, F.lit(SALTS)).cast("int"))
    p = p.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (salted.origin == p.o) & salted.source.eqNullSafe(p.s) & (salted.salt == p.p_salt)
    return salted.join(p, same, "left").drop("o", "s", "salt", "p_salt")


def repair(records: DataFrame, model: tuple, priors: DataFrame | None) -> DataFrame:
    """(origin, record_key, source, chain, garbled_words, lost_words, repaired) of every garbled record.

    chain is the likeliest of the record; repaired is the text with each garbled word replaced by its likeliest true
    form. Characters that were lost stay as U+FFFD and count in lost_words.
    """
    carried = records.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = CharacterModel(*carried.value)
        for frame in frames:
            spans = [words_of(t) for t in frame.text]
            distinct = [list(dict.fromkeys(t[a:b] for a, b in s)) for t, s in zip(frame.text, spans)]
            rows = []
            for part in _chunks([len(w) for w in distinct]):
                batch = Batch(distinct[part])
                counted = [Counter(t[a:b] for a, b in s) for t, s in zip(frame.text.iloc[part], spans[part])]
                counts = np.array([c[w] for c, words in zip(counted, distinct[part]) for w in words])
                _, joint = batch.judge(model, _prior_rows(frame.prior.iloc[part]), counts)
                bad = joint[:, IDENTITY] < 0.5 * joint.sum(axis=1)
                ends = np.cumsum(batch.sizes)
                for i in np.unique(batch.owner[bad]):
                    at = np.flatnonzero(bad[ends[i] - batch.sizes[i] : ends[i]]) + ends[i] - batch.sizes[i]
                    fixed = {}
                    for k in at:
                        options = batch.options[batch.word[k]]
                        fixed[options[0][1]] = max((o for o in options if o[0] != IDENTITY), key=lambda o: joint[k, o[0]])[1]
                    row = part.start + i
                    text, parts, last = frame.text.iloc[row], [], 0
                    for a, b in spans[row]:
                        parts += [text[last:a], fixed.get(text[a:b], text[a:b])]
                        last = b
                    chain_no = int(np.argmax(np.where(np.arange(len(CHAINS)) == IDENTITY, 0, joint[at].sum(axis=0))))
                    lost = sum(LOST in f for f in fixed.values())
                    rows.append((frame.origin.iloc[row], frame.record_key.iloc[row], frame.source.iloc[row], CHAINS[chain_no][0], len(fixed), lost, "".join(parts) + text[last:]))
            yield pd.DataFrame(rows, columns=["origin", "record_key", "source", "chain", "garbled_words", "lost_words", "repaired"])

    schema = "origin string, record_key string, source string, chain string, garbled_words int, lost_words int, repaired string"
    foreign = _foreign(records)
    read = _with_prior(foreign, priors) if priors is not None else foreign.withColumn("prior", F.lit(None).cast("array<double>"))
    return read.mapInPandas(run, schema)


def garbled_records(records: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Affected records of (origin, record_key, source, text) with their repair; see `repair`.

    Null and empty texts and plain ASCII are never affected. A null source is a source of its own. Repeated rows are
    judged each and give repeated results; with no foreign text at all the result is empty.
    """
    records = records.select("origin", "record_key", "source", "text")
    model, priors = fit(stage(suspects(records), "p1-words"), rounds)
    return repair(records, model, priors)


def source_records(source_file: DataFrame, content_snapshot: DataFrame) -> DataFrame:
    """The records of both tables: source_file.content, and content_snapshot.text where availability is `text`."""
    files = source_file.select(
        F.lit("source_file").alias("origin"), F.col("source_id").alias("record_key"), F.col("repo").alias("source"),
        F.col("content").alias("text"),
    )
    sides = content_snapshot.where(F.col("availability") == "text").select(
        F.lit("content_snapshot").alias("origin"), F.col("snapshot_id").cast("string").alias("record_key"),
        F.col("repo").alias("source"), "text",
    )
    return files.unionByName(sides).where(F.col("record_key").isNotNull() & F.col("text").isNotNull())
