"""Operator 2: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions, chunk by chunk; a chunk keeps its distinct words and,
for every position, the word's number.  The words of all chunks are dealt out by hash, so each
distinct word is encoded once; its ids go back to the chunks that hold it, where texts are put
together again by position.  Only distinct words of a chunk cross the network as text, so a word
that makes up a third of all positions is one row of a chunk like any other.
Decoding looks ids up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import row_windows, tidy, utf8_column

CHUNK = 8 << 20  # bytes of text in a chunk
WINDOW = CHUNK // 16  # bytes of text whose lengths are counted at a time
REMEMBERED = 256  # signs of a word that a task remembers by its hash, at most
KNOWN = 400_000  # encoded words that a task remembers at most; what it forgets it encodes again
PATTERN = K.PATTERN

_PIECES = "kind int, chunk long, bucket int, ids array<long>, counts array<int>, lengths binary, data binary"
_PIECES_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("lengths", pa.binary()), ("data", pa.binary())])


def _pack(values: np.ndarray, width: int) -> bytes:
    """Integers below 256 ** width, byte plane by byte plane, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    return bytes([width]) + _squeeze(np.ascontiguousarray(planes).tobytes())


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosen(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(_loosen(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u4").ravel()


def gather_ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[i]:start[i] + length[i]] of all i, end to end."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return flat[np.repeat(start - at, length) + np.arange(total)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def cut_texts(offsets: np.ndarray, data: np.ndarray):
    """(text of all rows, code points, starts, ends, hash of each pre-token, pre-tokens per row)."""
    text = data.tobytes().decode("utf-8", "replace")
    if text.isascii():
        cp, rows = data, offsets
    else:
        cp = K.code_points(text)
        # a row's first code point: code points before its first byte
        lead = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        rows = np.where(offsets > 0, lead[np.maximum(offsets, 1) - 1], 0).astype(np.int64)
    starts = K.pretoken_starts(cp, np.unique(rows[:-1][np.diff(rows) > 0]))
    ends = np.append(starts[1:], len(cp))[: len(starts)]
    return text, cp, starts, ends, K.span_hashes(cp, starts, ends, 0x110000), np.diff(np.searchsorted(starts, rows))


def home_by_word(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each word by its hash."""
    return (words >> np.uint64(16)) % np.uint64(buckets)


def home_by_prefix(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each word by its first four signs, so that words that share a longer prefix meet."""
    key = np.zeros(len(starts), np.uint64)
    for k in range(4):
        at = starts + k
        key = K.mix64(key + np.where(at < ends, cp[np.minimum(at, len(cp) - 1)] + 1, 0).astype(np.uint64)) if len(cp) else key
    return key % np.uint64(buckets)


def bucket_count(docs: DataFrame) -> int:
    """Buckets of words: a few for each input partition, so that a bucket's size doesn't follow the input's."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())


def _chunks(batches, buckets: int, home):
    """Yields (chunk id, doc ids, text, starts, ends, order, which, bucket of each word, pre-tokens per row).

    A chunk's id is a digest of its rows, so the two passes over the texts name equal chunks alike."""
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        offsets, data, _ = utf8_column(batch.column(1))
        for a, b in row_windows(offsets, CHUNK):
            part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            own = ids.slice(a, b - a).to_pylist()
            name = hashlib.blake2b(part.tobytes(), digest_size=8)
            name.update(repr(own).encode() + cut.tobytes())
            text, cp, starts, ends, hashes, per_row = cut_texts(cut, part)
            words, first, which, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            s, e = starts[first[order]], ends[first[order]]
            yield int.from_bytes(name.digest(), "little", signed=True), own, text, s, e, order, which, home(cp, s, e, words[order], buckets), per_row


def _cut_words(buckets: int, at_home):
    """Rows (kind 0, chunk, bucket, lengths, data): a chunk's distinct words, dealt to buckets by hash."""

    def run(batches):
        for chunk, _, text, s, e, _, _, home, _ in _chunks(batches, buckets, at_home):
            bucket, lengths, blobs = [], [], []
            for h in np.unique(home).tolist():
                mine = [text[x:y].encode() for x, y in zip(s[home == h].tolist(), e[home == h].tolist())]
                bucket.append(h)
                lengths.append(_pack(np.fromiter(map(len, mine), np.int64, len(mine)), 4)), blobs.append(_squeeze(b"".join(mine)))
            n = len(bucket)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(bucket, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.array(lengths, pa.binary()), pa.array(blobs, pa.binary())], schema=_PIECES_ARROW)

    return run


def _cut_positions(buckets: int, at_home):
    """Rows (kind 1, chunk, ids, counts, lengths: bucket of each word, data: word number at each position)."""

    def run(batches):
        for chunk, ids, _, _, _, order, which, home, per_row in _chunks(batches, buckets, at_home):
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([chunk], pa.int64()), pa.array([2**31 - 1], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([per_row.tolist()], pa.list_(pa.int32())), pa.array([_pack(home, 3)], pa.binary()), pa.array([_pack(number[which], 3 if len(order) < 1 << 24 else 4)], pa.binary())], schema=_PIECES_ARROW)

    return run


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe.encode_single_piece


def words_of(lengths: bytes, data: bytes) -> list[bytes]:
    """The words of a row of kind 0, in their order."""
    data, ends = _loosen(data), np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _encode_words(path: str):
    def run(batches):
        encode = _encoder(path)
        now, known = None, {}
        for batch in batches:
            chunk, bucket = batch.column(0), batch.column(1).to_pylist()
            counts, blobs = [], []
            for b, lengths, data in zip(bucket, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != now or len(known) > KNOWN:
                    now, known = b, {}
                ids = []
                for word in words_of(lengths, data):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word)
                    ids.append(got)
                counts.append(_pack(np.fromiter(map(len, ids), np.int64, len(ids)), 4))
                blobs.append(_pack(np.fromiter((i for x in ids for i in x), np.int64), 3))
            n = len(bucket)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), chunk.cast(pa.int64()), pa.array(bucket, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.array(counts, pa.binary()), pa.array(blobs, pa.binary())], schema=_PIECES_ARROW)

    return run


def whole_chunks(batches):
    """Yields (doc ids, ends of the rows, word number at each position, {bucket: (lengths, data)}, order of words by bucket) for each
    chunk.  order puts the words of the buckets, the least bucket first, back at their numbers."""
    now, parts = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != now:
                now, parts = row["chunk"], {}
            if row["kind"] == 0:
                parts[row["bucket"]] = (_unpack(row["lengths"]).astype(np.int64), _unpack(row["data"]))
                continue
            home = _unpack(row["lengths"])
            if sum(len(c) for c, _ in parts.values()) != len(home):
                raise RuntimeError("texts changed between two reads: write the table first")
            order = np.argsort(home, kind="stable")  # words of a bucket keep their order
            yield row["ids"], np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))]), _unpack(row["data"]).astype(np.int64), dict(sorted(parts.items())), order


_ENCODED_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reassemble(step: int = 1 << 20):
    """Yields rows (doc_id, n_tokens, ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for ids, ends, words, parts, order in whole_chunks(batches):
            count, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            count[order] = np.concatenate([c for c, _ in parts.values()]) if parts else []
            flat = np.concatenate([d for _, d in parts.values()]) if parts else np.zeros(0, np.uint32)
            start[order] = np.cumsum(count[order]) - count[order]
            for a, b in row_windows(ends, step):
                part = words[ends[a] : ends[b]]
                tokens = gather_ragged(flat, start[part], count[part])
                upto = np.concatenate([[0], np.cumsum(count[part])])[ends[a : b + 1] - ends[a]]
                rows = [tokens[x:y].tobytes() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(np.diff(upto)), pa.array(rows, pa.binary())], schema=_ENCODED_ARROW)

    return run


def bpe_encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    ranks_path: a rank file that every executor can open, as installed with the tokenizer.  A null or
    empty text has no tokens.  Texts are read twice, for words and for positions, so docs must be a table or
    another input that reads the same again; if it doesn't, the job fails rather than mix texts up.  Null and repeated doc_ids keep a row each.  Other columns aren't read.
    A text of any length stays whole, in one chunk of its own; a task needs about 40 times its largest text's bytes, so that
    a text beyond 50 MB asks for larger executors.  No rows: no rows.
    """
    return _encode(docs, ranks_path, _reassemble(), "doc_id long, n_tokens long, ids binary")


def deal_words(docs: DataFrame, solve, finish, schema: str, home=home_by_word) -> DataFrame:
    """Distinct words of every chunk of docs go to their bucket, solve turns each into numbers, and finish gets them chunk by chunk."""
    buckets = bucket_count(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = docs.mapInArrow(_cut_words(buckets, home), _PIECES).select("chunk", "bucket", "lengths", "data").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    solved = words.mapInArrow(solve, _PIECES)
    together = solved.unionByName(docs.mapInArrow(_cut_positions(buckets, home), _PIECES)).repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket")
    return together.mapInArrow(finish, schema)


def _encode(docs: DataFrame, ranks_path: str, finish, schema: str) -> DataFrame:
    return deal_words(docs, _encode_words(ranks_path), finish, schema)


def _lengths(path: str):
    """(doc_id, text) -> doc_id, n_tokens.  A task remembers words by their 64-bit hashes, as a window does: 12 bytes for each."""

    def run(batches):
        encode = _encoder(path)
        known, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # ascending hashes, tokens of each
        for batch in batches:
            offsets, data, _ = utf8_column(batch.column(1))
            found = [np.zeros(0, np.int64)]
            for a, b in row_windows(offsets, WINDOW):
                text, _, starts, ends, hashes, per_row = cut_texts(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                words, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                if len(known) > KNOWN:
                    known, sizes = known[:0], sizes[:0]
                at = np.searchsorted(known, words)
                seen = np.zeros(len(words), bool)
                seen[at < len(known)] = known[at[at < len(known)]] == words[at < len(known)]
                size = np.empty(len(words), np.int64)
                size[seen] = sizes[at[seen]]
                s, e = starts[first[~seen]], ends[first[~seen]]
                size[~seen] = [len(encode(text[x:y].encode())) for x, y in zip(s.tolist(), e.tolist())]
                keep = np.flatnonzero(~seen)[e - s <= REMEMBERED]
                known, sizes = np.insert(known, at[keep], words[keep]), np.insert(sizes, at[keep], size[keep])
                upto = np.concatenate([[0], np.cumsum(size[which])])
                found.append(np.diff(upto[np.concatenate([[0], np.cumsum(per_row)])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], names=["doc_id", "n_tokens"])

    return run


def bpe_lengths(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens: numbers of tokens only, without a shuffle; a row for each row.

    A task encodes a distinct word once, as long as it remembers it.  A null or empty text has 0 tokens.  No rows: no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_lengths(ranks_path)), "doc_id long, n_tokens long")


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = {i: b for b, i in read_ranks(path).items()}
    parts = [table.get(i, b"") for i in range(max(table) + 1)]
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length


def decode_ids(ids: bytes, ranks_path: str) -> bytes:
    """The bytes of packed ids."""
    flat, start, length = _token_bytes(ranks_path)
    tokens = np.frombuffer(ids, "<u4")
    return gather_ragged(flat, start[tokens], length[tokens]).tobytes()


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds column decoded (binary: the bytes that ids stand for) to rows with ids; null ids give null."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield batch.append_column("decoded", pa.array([None if x is None else decode_ids(x, ranks_path) for x in ids], pa.binary()))

    return encoded.mapInArrow(run, encoded.schema.simpleString()[7:-1].replace(":", " ") + ", decoded binary")


def bpe_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs -> doc_id, n_tokens, ids_sha256, decoded_sha256: texts are encoded, and their ids decoded, in the same task."""
    reassemble = _reassemble()

    def run(batches):
        for batch in reassemble(batches):
            ids = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(decode_ids(x, ranks_path)).hexdigest() for x in ids], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encode(docs, ranks_path, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
