"""Byte-level BPE over a corpus with content-defined chunk reuse.

A rolling hash over the text's bytes places chunk cuts where the content says so, so
equal passages give equal chunks in every document.  Chunks that occur more than once
are encoded once, by the document with the smallest id among those that hold them; the
ids travel to the other documents.  What no one else shares is encoded in place.

Chunk joins are repaired.  A token sequence is fixed by the pre-tokens (pattern
matches) of the text; a scan of the text depends only on what follows the place it has
reached.  A chunk scanned by itself agrees with the whole text up to a safe place
shortly before its end.  From there the text is scanned on across the join until the
scan reaches a place that is also a boundary of the next chunk's own scan; from that
place both agree exactly, and the ids in between are encoded anew.

Added special tokens are matched first, as the tokenizer does, and never cut.

Texts travel compressed.  A null text counts as empty and has no ids; a row whose id
repeats or is null is encoded like any other; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, rows_of

VOCABULARY = "byte_bpe_50k.tiktoken"
# Special strings of the tokenizer and their ids.
SPECIALS = (("<|endoftext|>", 50256),)
# A cut on average every CUT_MASK + 1 bytes, and no chunk shorter than MIN_CHUNK.
CUT_MASK = 1023
MIN_CHUNK = 64
WINDOW = 16
# The pattern looks at most two characters past a match ('ll), so a match that ends this
# many characters before the end of a chunk is the same in the whole text.
LOOKAHEAD = 3
# The encoder's pattern engine backtracks over a run of white space on a bounded stack.
MAX_BLANKS = 50_000


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str, specials: tuple = SPECIALS) -> dict[int, bytes]:
    """Bytes of each id, special strings included."""
    return {i: t for t, i in read_ranks(vocabulary).items()} | {i: s.encode() for s, i in specials}


def decode(tokens: dict[int, bytes], ids: Iterable[int]) -> str:
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


class Codec:
    """Encoder for one vocabulary file; built once per Python worker."""

    def __init__(self, vocabulary: str, specials: tuple[tuple[str, int], ...] = SPECIALS):
        ranks = read_ranks(vocabulary)
        self.specials = dict(specials)
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s, _ in specials) + ")")
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.blanks = regex.compile(r"\s{%d}" % MAX_BLANKS)
        self.bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN,
                                     mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        """Ids of a text without special strings.

        A run of white space too long for the encoder's pattern engine is scanned here.
        """
        if len(text) > MAX_BLANKS and self.blanks.search(text):
            return [i for m in self.words.finditer(text) for i in self.match(m[0])]
        return self.bpe.encode_ordinary(text)

    def match(self, word: str) -> list[int]:
        """Ids of one match of the pattern."""
        return self.bpe._encode_single_piece(word)

    def pieces(self, text: str) -> Iterator[str]:
        """The text split at special strings, which are pieces of their own."""
        return (p for p in self.splitter.split(text) if p)


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def cut_places(raw: bytes) -> list[int]:
    """Places at which the content cuts the text (byte offsets, ends included).

    The hash covers the WINDOW bytes before a place, so it depends on nothing else;
    a cut falls on the start of a character.
    """
    n = len(raw)
    if n <= WINDOW + MIN_CHUNK:
        return [0, n]
    b = np.frombuffer(raw, dtype=np.uint8)
    h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    factor, width = 0x9E3779B1, 1
    while width < WINDOW:
        h = h[width:] + h[:-width] * np.uint32(factor)
        factor, width = factor * factor & 0xFFFFFFFF, width * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    places = np.nonzero((h & np.uint32(CUT_MASK)) == 0)[0] + WINDOW
    places = places[places < n]
    places = places[(b[places] & 0xC0) != 0x80]
    out = [0]
    for p in places.tolist():
        if p - out[-1] >= MIN_CHUNK and n - p >= MIN_CHUNK:
            out.append(p)
    return [*out, n]


def chunks(piece: str) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the content-defined chunks of a piece, in order."""
    raw = piece.encode()
    at = cut_places(raw)
    return [(xxhash.xxh3_128_digest(raw[s:e]), raw[s:e]) for s, e in zip(at, at[1:])]


# In the reversed text: a space after (in reading order) a character that is neither
# white space nor an apostrophe, and before a character that is not white space.  No
# match holds a space after another character, so every scan has a boundary there.
_ANCHOR = regex.compile(r"(?<=\S) (?=[^\s'])")


def _safe_end(c: Codec, text: str, floor: int) -> int:
    """The last boundary of the scan of ``text`` that also holds when more text follows.

    ``floor`` is a boundary; the scan begins there or at a later place that is a
    boundary in every scan.
    """
    start = floor
    for m in _ANCHOR.finditer(text[::-1]):
        at = len(text) - 1 - m.start()
        if at <= floor:
            break
        if m.start() >= 8 * LOOKAHEAD:
            start = at
            break
    safe = start
    for m in c.words.finditer(text, start):
        if m.end() > len(text) - LOOKAHEAD:
            break
        safe = m.end()
    return safe


def _meeting(c: Codec, carry: str, text: str) -> int | None:
    """First place in ``text`` where the scan of carry + text meets the scan of text."""
    shift, limit = len(carry), len(text) - LOOKAHEAD
    ours = (m.end() - shift for m in c.words.finditer(carry + text))
    theirs = (m.end() for m in c.words.finditer(text))
    a, b = next(ours, None), 0
    while a is not None and b is not None and a <= limit and b <= limit:
        if a == b:
            return a
        if a < b:
            a = next(ours, None)
        else:
            b = next(theirs, None)
    return None


def _scanned(c: Codec, text: str, start: int, stop: int) -> list[int]:
    """Ids of the matches of the scan of ``text`` from one boundary to another."""
    out: list[int] = []
    if start < stop:
        for m in c.words.finditer(text, start):
            out += c.match(m[0])
            if m.end() >= stop:
                break
    return out


def encode_piece(c: Codec, piece: str, known: dict[bytes, np.ndarray]) -> list[int]:
    """Ids of a piece; ``known`` holds ids of chunks that need no encoding.

    Chunks that are not known are encoded together with their neighbours of the same
    kind; each join next to a known chunk is repaired.
    """
    parts: list[tuple[str, np.ndarray | None]] = []
    pending: list[bytes] = []
    for digest, raw in chunks(piece) if known else [(b"", piece.encode())]:
        ids = known.get(digest)
        if ids is None:
            pending.append(raw)
            continue
        if pending:
            parts.append((b"".join(pending).decode(), None))
            pending = []
        parts.append((raw.decode(), ids))
    if pending:
        parts.append((b"".join(pending).decode(), None))
    if len(parts) == 1:
        text, ids = parts[0]
        return c.plain(text) if ids is None else ids.tolist()
    return _join(c, parts)


def _join(c: Codec, parts: list[tuple[str, np.ndarray | None]]) -> list[int]:
    """Ids of the parts' concatenation: each part's own ids, repaired at the joins."""
    out: list[int] = []
    carry = ""       # text before the current part that no part's ids cover yet
    for i, (text, ids) in enumerate(parts):
        start = 0
        if carry:
            start = _meeting(c, carry, text)
            if start is None:                      # the scans do not meet in this part
                carry += text
                continue
            out += _scanned(c, carry + text, 0, len(carry) + start)
        own = c.plain(text) if ids is None else ids.tolist()
        end = len(text) if i == len(parts) - 1 else _safe_end(c, text, start)
        first = len(_scanned(c, text, 0, start))
        last = len(_scanned(c, text, end, len(text)))
        out += own[first:len(own) - last]
        carry = text[end:]
    return out + c.plain(carry) if carry else out


def encode(c: Codec, text: str, known: dict[bytes, np.ndarray] | None = None) -> list[int]:
    """Ids of a whole text, special strings included."""
    out: list[int] = []
    for piece in c.pieces(text):
        if piece in c.specials:
            out.append(c.specials[piece])
        else:
            out += encode_piece(c, piece, known or {})
    return out


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([squeeze.compress((t or "").encode())
                                        for t in batch.column(1).to_pylist()], pa.binary())],
            names=["id", "packed"])


def _unpack(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode()


def _references(batches: Iterable[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    c = codec(vocabulary)
    out = Emitter(pa.schema([("digest", pa.binary()), ("id", pa.int64())]), max_rows=1 << 15)
    for doc, text in rows_of(batches, "id", "text"):
        found = dict.fromkeys(d for p in c.pieces(text or "") if p not in c.specials
                              for d, _ in chunks(p))
        for digest in found:
            out.add((digest, doc))
        if out.full:
            yield out.batch()
    yield out.batch()


def _encode_owned(batches: Iterable[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    c = codec(vocabulary)
    out = Emitter(pa.schema([("digest", pa.binary()), ("ids", pa.binary())]))
    for packed, owned in rows_of(batches, "packed", "owned"):
        wanted = set(owned)
        for piece in c.pieces(_unpack(packed)):
            for digest, raw in chunks(piece) if piece not in c.specials else ():
                if digest in wanted:
                    wanted.discard(digest)
                    ids = np.array(c.plain(raw.decode()), dtype=np.uint32)
                    data = (ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16
                            else ids).tobytes()
                    wide = b"\x01" if len(ids) and ids.max() >= 1 << 16 else b"\x00"
                    out.add((digest, wide + data), len(data))
        if out.full:
            yield out.batch()
    yield out.batch()


def _known(shared: list[dict] | None) -> dict[bytes, np.ndarray]:
    return {s["digest"]: np.frombuffer(s["ids"], dtype=np.uint32 if s["ids"][0] else np.uint16,
                                       offset=1) for s in shared or ()}


def _encode_rows(batches: Iterable[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    c = codec(vocabulary)
    out = Emitter(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]),
                  max_rows=1024)
    for doc, packed, shared in rows_of(batches, "id", "packed", "shared"):
        ids = np.array(encode(c, _unpack(packed), _known(shared)), dtype=np.int32)
        out.add((doc, ids), 4 * len(ids))
        if out.full:
            yield out.batch()
    yield out.batch()


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, ids (array of int)."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_pack, "id long, packed binary")
    refs = rows.mapInArrow(lambda b: _references(b, vocabulary), "digest binary, id long")
    shared = (refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"))
              .filter("n > 1 and owner is not null"))
    owned = (shared.groupBy(F.col("owner").alias("id"))
             .agg(F.collect_list("digest").alias("owned")))
    # Both joins of the texts use the same key expressions, so they share one shuffle.
    ids = (packed.alias("d").join(owned.alias("o"), F.expr("d.id <=> o.id"))
           .select("d.packed", "o.owned").mapInArrow(
               lambda b: _encode_owned(b, vocabulary), "digest binary, ids binary"))
    arriving = (refs.join(ids, "digest").groupBy("id")
                .agg(F.collect_list(F.struct("digest", "ids")).alias("shared")))
    joined = packed.alias("d").join(arriving.alias("x"), F.expr("d.id <=> x.id"), "left").select(
        "d.id", "d.packed", "x.shared")
    return joined.mapInArrow(lambda b: _encode_rows(b, vocabulary),
                             "doc_id long, ids array<int>")


def token_digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (ids decoded again)."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = token_bytes(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                            ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        out = Emitter(schema)
        for batch in batches:
            docs, lists = batch.column(0).to_pylist(), batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for doc, start, end in zip(docs, ends, ends[1:]):
                ids = values[start:end].tolist()
                out.add((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(decode(decoder, ids).encode()).hexdigest()))
                if out.full:
                    yield out.batch()
        yield out.batch()

    return encoded.mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
