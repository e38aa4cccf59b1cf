"""Evaluation passages inside corpus documents, by SimHash windows.

Every window of WIDTH consecutive words of an item and of a document, the size of a passage,
has a 64-bit fingerprint of BLOCKS blocks: block b is the SimHash, the majority of the hash
bits, of the window's words 3b to 3b + 2. So a changed word touches one block, and windows
with up to BLOCKS - 1 changed words agree in a block: tables of the items' blocks find all of
them (multi-index Hamming search), as they find all fingerprints whose differences leave a
block alone. Those within RADIUS bits are candidates. A candidate is verified by the weighted
similarity of its shingles, rare ones weighing more; for exact passages that similarity must
be 1 and the words the same in order. Documents are never shuffled; only the items' windows,
in slices of bounded size, are sent to the tasks.
"""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WIDTH, RADIUS, BLOCKS = 12, 18, 4
SHINGLE = 2
ITEM_WINDOWS_AT_ONCE = 1 << 20
WINDOWS_AT_ONCE = 1 << 17

WORD = regex.compile(r"[\p{L}\p{N}]+")
UNSEEN = regex.compile(r"[\p{M}\p{Cf}ᅟᅠㅤﾠ]+|(?![\t-\r\x1c-\x1f\x85])\p{Cc}")
#: Letters with a stroke or without a dot, which have no decomposition.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ħ": "h", "ŧ": "t", "ı": "i"})


def words_of(text: str | None) -> list[str]:
    """The words a reader sees: runs of letters and digits, without case, accents,
    character width, invisible characters and HTML character references."""
    return [w for token in (text or "").split() for w in token_words(token)]


def token_words(text: str) -> list[str]:
    """words_of a text without white space; nothing in it depends on its neighbours."""
    for _ in range(3):
        if "&" not in text:
            break
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    if text.isascii():
        return WORD.findall(UNSEEN.sub("", text.lower()))
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return WORD.findall(UNSEEN.sub("", text).translate(PLAIN))


class TokenHashes(dict):
    """Hashes of the words of a token, remembered up to a bounded number of tokens."""

    MOST = 400_000

    def __missing__(self, token: str) -> tuple[int, ...]:
        hashes = tuple(xxhash.xxh64_intdigest(w) for w in token_words(token))
        if len(token) <= 64:
            if len(self) >= self.MOST:
                self.clear()
            self[token] = hashes
        return hashes

    def of(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, text.split())))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of each window of WIDTH = 12 consecutive words, by their hashes."""
    n = len(hashes) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    a, b, c = hashes[:-2], hashes[1:-1], hashes[2:]
    most = (a & b) | (a & c) | (b & c)
    out = np.zeros(n, np.uint64)
    for block in range(BLOCKS):
        out |= most[3 * block : 3 * block + n] & np.uint64(0xFFFF << 16 * block)
    return out


class Passages:
    """Windows of evaluation items and their block tables."""

    def __init__(self, items: list[tuple[int, str]]):
        known, prints, at, seen = TokenHashes(), [], [], set()
        self.items, self.of, self.texts = [], [], []
        self.hashes, total, count = [], 0, Counter()
        for item, text in items:
            words, hashes = words_of(text), np.array(known.of(text or ""), np.uint64)
            count.update(set(shingles(words)))
            f = fingerprints(hashes)
            # a passage repeated within the item is one
            new = [i for i in range(len(f)) if (item, key := hashes[i : i + WIDTH].tobytes()) not in seen and not seen.add((item, key))]
            if not new:
                continue
            prints.append(f[new])
            at.append(np.array(new) + total)
            self.of.append(np.full(len(new), len(self.items)))
            self.items.append(item)
            self.texts.append((total, words))
            self.hashes.append(hashes)
            total += len(hashes)
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.prints, self.at, self.of, self.hashes = joined(prints, np.uint64), joined(at, np.int64), joined(self.of, np.int64), joined(self.hashes, np.uint64)
        self.weight = {w: 1 / n for w, n in count.items()}
        self.tables = []
        for b in range(BLOCKS):
            value = self._block(self.prints, b)
            n = np.bincount(value, minlength=1 << 16)
            self.tables.append((np.argsort(value, kind="stable"), np.cumsum(n) - n, n))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return prints.astype("<u8", copy=False).view("<u2").reshape(-1, 4)[:, b]

    def words(self, window: int) -> tuple[str, ...]:
        first, words = self.texts[self.of[window]]
        return tuple(words[self.at[window] - first :][:WIDTH])

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item window) whose fingerprints agree in a block and differ in at most RADIUS bits."""
        at, windows = [], []
        for b, (order, starts, sizes) in enumerate(self.tables):
            value = self._block(prints, b)
            some = np.flatnonzero(sizes[value])
            for s in range(0, len(some), 1 << 14):
                part = some[s : s + (1 << 14)]
                n = sizes[value[part]]
                row = np.repeat(part, n)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                other = order[np.repeat(starts[value[part]], n) + inside]
                close = np.bitwise_count(prints[row] ^ self.prints[other]) <= RADIUS
                at.append(row[close])
                windows.append(other[close])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a pair that agrees in several blocks is found by each
        pairs = np.unique(np.concatenate(at) * len(self.prints) + np.concatenate(windows))
        return np.divmod(pairs, len(self.prints))

    def similarity(self, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        """Weighted Jaccard similarity of the shingles of two windows as multisets."""
        if a == b:
            return 1.0
        x, y = Counter(shingles(a)), Counter(shingles(b))
        w = self.weight
        low = sum(min(x[t], y[t]) * w.get(t, 1) for t in x.keys() & y.keys())
        high = sum(max(x[t], y[t]) * w.get(t, 1) for t in x.keys() | y.keys())
        return low / high


def shingles(words: list[str] | tuple[str, ...]) -> list[tuple[str, ...]]:
    """Runs of SHINGLE words."""
    return list(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: float = 1.0) -> DataFrame:
    """(doc_id, item_id): documents holding WIDTH consecutive words of an item.

    least: smallest weighted similarity of the shingles of a document's window to those of an
    item's; 1.0 asks for the same words in the same order. With less, passages of which a word
    or two were replaced, added or left out are found: of twelve words, one replaced in the
    middle leaves about 0.7, two at least 0.45. The corpus is read once for every
    ITEM_WINDOWS_AT_ONCE windows of items. Items and documents of fewer than WIDTH words,
    null and empty texts never match; repeated rows do not repeat results.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    # a word has two characters at least with its space
    size = items.agg(F.sum(F.length(item_text) / 2)).first()[0] or 0
    slices = int(-(-max(1, size) // ITEM_WINDOWS_AT_ONCE))
    result = None
    for s in range(slices):
        part = items.where(F.pmod(F.xxhash64(item_id), F.lit(slices)) == s) if slices > 1 else items
        rows = part.select(item_id, item_text).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct().collect()
        shared = spark.sparkContext.broadcast(Passages([(r[0], r[1]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            passages, known = shared.value, TokenHashes()
            if not len(passages.prints):
                return
            for batch in batches:
                found: set[tuple] = set()
                waiting, size = [], 0
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    body = body.as_py() or ""
                    hashes = known.of(body)
                    if len(hashes) >= WIDTH:
                        waiting.append((doc, body, hashes))
                        size += len(hashes)
                    if size >= WINDOWS_AT_ONCE:
                        found |= matches(passages, waiting, least)
                        waiting, size = [], 0
                found |= matches(passages, waiting, least)
                if found:
                    d, i = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, type=batch.column(0).type), pa.array(i, item_type)], ["doc", "item"])

        hits = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).mapInArrow(run, f"doc {doc_kind}, item {item_kind}")
        result = hits if result is None else result.unionByName(hits)
    return result.distinct().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))


def matches(passages: Passages, docs: list[tuple[int, str, list[int]]], least: float) -> set[tuple]:
    """Pairs (doc, item) among documents (id, text, hashes of words)."""
    if not docs:
        return set()
    ends = np.cumsum([len(h) for _, _, h in docs])
    hashes = np.fromiter(chain.from_iterable(h for _, _, h in docs), np.uint64, int(ends[-1]))
    words: dict[int, list[str]] = {}
    found: set[tuple] = set()
    for s in range(0, max(0, len(hashes) - WIDTH + 1), WINDOWS_AT_ONCE):
        part = hashes[s : s + WINDOWS_AT_ONCE + WIDTH - 1]
        at, windows = passages.near(fingerprints(part))
        at += s
        doc = np.searchsorted(ends, at, side="right")
        good = at + WIDTH <= ends[doc]
        if least >= 1:  # similarity 1 needs the same words
            for k in range(WIDTH):
                good[good] = hashes[at[good] + k] == passages.hashes[passages.at[windows[good]] + k]
        for a, w, d in zip(at[good].tolist(), windows[good].tolist(), doc[good].tolist(), strict=True):
            pair = (docs[d][0], passages.items[passages.of[w]])
            if pair in found:
                continue
            if d not in words:
                words[d] = words_of(docs[d][1])
            first = a - int(ends[d]) + len(words[d])
            window, passage = tuple(words[d][first : first + WIDTH]), passages.words(w)
            if passages.similarity(window, passage) >= least and (least < 1 or window == passage):
                found.add(pair)
    return found
