"""Byte-level BPE of whole texts by content-defined chunks.

A chunk ends where a rolling hash over the last WINDOW bytes of a word says so. Such a
place depends on nearby content only, so passages shared by documents (menus, notices,
mirrored pages) give the same chunks and each is encoded once per worker; the others are
found in a bounded table. This keeps the corpus out of any shuffle.

Joins: the pre-tokenizer never puts a non-space character and a following space into one
piece and never looks back, so a chunk that ends between the two joins exactly. Where a
text has no such place for LONG bytes, a chunk ends at a hashed character boundary
instead; there the joined text is split again, and between the pieces in which that agrees
with the split of the chunks alone, the tokens are encoded anew.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"|\s+", r"|\p{White_Space}+"))
WINDOW, MASK, LONG, LONG_MASK, KEPT = 8, 15, 4096, 4095, 50_000
FACTORS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WINDOW)], dtype=np.uint32)

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a vocabulary file of base64 tokens and ranks, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _hash_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Polynomial hash of the WINDOW bytes before each position."""
    h = np.zeros(len(at), dtype=np.uint32)
    for k in range(WINDOW):
        h += data[at - 1 - k].astype(np.uint32) * FACTORS[k]
    return h ^ (h >> np.uint32(15))


def chunk_ends(data: np.ndarray, bounds: np.ndarray, mask: int = MASK, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Sorted chunk boundaries of texts laid end to end, and which of them need repair.

    bounds: offsets of the texts, first and last included.
    """
    space = np.flatnonzero((data == 0x20) | (data == 0x0A))
    space = space[space >= WINDOW]
    start = bounds[np.searchsorted(bounds, space, side="right") - 1] if len(space) else space
    space = space[space - start >= WINDOW]
    if len(space):
        one, two, three = data[space - 1], data[space - 2], data[space - 3]
        # the last byte of a character that might be white space is no end of a word
        wide = (one >= 0x80) & ((two == 0xC2) | (np.isin(three, (0xE1, 0xE2, 0xE3)) & np.isin(two, (0x80, 0x81, 0x9A))))
        space = space[(one > 0x20) & (one != 0x7F) & ~wide]
    cuts = space[(_hash_at(data, space) >> np.uint32(4)) & np.uint32(mask) == 0] if len(space) else space
    exact = np.union1d(bounds, cuts)
    gaps = np.flatnonzero(np.diff(exact) > long)
    hard = []
    for g in gaps:
        inside = np.arange(exact[g] + WINDOW, exact[g + 1])
        inside = inside[(data[inside] & 0xC0) != 0x80]
        inside = inside[(_hash_at(data, inside) >> np.uint32(4)) & np.uint32(LONG_MASK) == 0]
        hard.append(inside)
    if not hard:
        return exact, np.zeros(len(exact), dtype=bool)
    ends = np.union1d(exact, np.concatenate(hard))
    return ends, ~np.isin(ends, exact)


def joined(chunks: list[str], ids_of: Callable[[str], Sequence[int]], encode: Callable[[str], list[int]]) -> Iterator[Sequence[int]]:
    """Ids of chunks laid end to end, of which the joins may cut pieces, in parts.

    The whole is split into pieces once. Of each chunk the pieces that it has alone and in
    the whole keep their ids; the pieces around joins are encoded anew, each once, so the
    cost is linear whatever their length.
    """
    whole = [m.span() for m in PIECES.finditer("".join(chunks))]
    text, number = "".join(chunks), {span: i for i, span in enumerate(whole)}
    done, at = 0, 0  # pieces of the whole that have ids; characters of earlier chunks
    for chunk in chunks:
        alone = [(a + at, b + at) for a, b in (m.span() for m in PIECES.finditer(chunk))]
        shared = [i for i, span in enumerate(alone) if span in number]
        if shared and alone[shared[0] : shared[-1] + 1] == whole[number[alone[shared[0]]] : number[alone[shared[-1]]] + 1]:
            first, last = shared[0], shared[-1]
            for a, b in whole[done : number[alone[first]]]:
                yield encode(text[a:b])
            ids = ids_of(chunk)
            before = sum(len(encode(text[a:b])) for a, b in alone[:first])
            after = sum(len(encode(text[a:b])) for a, b in alone[last + 1 :])
            yield ids[before : len(ids) - after]
            done = number[alone[last]] + 1
        at += len(chunk)
    for a, b in whole[done:]:
        yield encode(text[a:b])


def encode_texts(texts: pa.Array, path: str = VOCABULARY, cache: list[dict] | None = None, mask: int = MASK, long: int = LONG) -> pa.Array:
    """List of token ids of each text; null for a null text, an empty list for an empty one."""
    encode = encoder(path).encode_ordinary
    young, old = cache if cache is not None else ({}, {})
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    raw = memoryview(raw)[offsets[0] : offsets[-1]].tobytes() if raw is not None else b""
    bounds = offsets - offsets[0]
    ends, repair = chunk_ends(np.frombuffer(raw, dtype=np.uint8), bounds, mask, long)
    flat = array("i")
    sizes = np.zeros(len(ends), dtype=np.int64)  # ids before each end
    ends_list, i = ends.tolist(), 0
    repair_list = repair.tolist()

    def ids_of(chunk: bytes) -> array:
        nonlocal young, old
        ids = young.get(chunk)
        if ids is None:
            ids = old.get(chunk)
            if ids is None:
                ids = array("i", encode(chunk.decode()))
            if len(chunk) <= 512:
                young[chunk] = ids
                if len(young) >= KEPT:
                    young, old = {}, young
        return ids

    while i + 1 < len(ends_list):
        j = i + 1
        if not repair_list[j]:
            flat.extend(ids_of(raw[ends_list[i] : ends_list[j]]))
        else:
            while repair_list[j]:
                j += 1
            chunks = [raw[a:b].decode() for a, b in zip(ends_list[i:j], ends_list[i + 1 : j + 1], strict=True)]
            for ids in joined(chunks, lambda chunk: ids_of(chunk.encode()), encode):
                flat.extend(ids if isinstance(ids, array) else array("i", ids))
        sizes[i + 1 : j + 1] = len(flat)
        i = j
    if cache is not None:
        cache[0], cache[1] = young, old
    return pa.ListArray.from_arrays(pa.array(sizes[np.searchsorted(ends, bounds)], type=pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.zeros(0, np.int32)))


def token_ids(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row, without special tokens.

    Text that looks like a special token is ordinary text. The ids of an empty text are
    an empty list, those of a null text are null. Extra columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: list[dict] = [{}, {}]
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1)
                ids = encode_texts(texts, path, cache)
                if texts.null_count:
                    ids = pc.if_else(texts.is_valid(), ids, pa.scalar(None, ids.type))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc", "ids"])

    out = df.select(df[id_col].alias("doc"), df[text_col].alias("text")).mapInArrow(run, f"doc {kind}, ids array<int>")
    return out.withColumnRenamed("doc", id_col)
