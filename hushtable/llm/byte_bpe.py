"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, offsets from the byte-to-character mapping, decoding by the reversed byte table.

The ranks of a tiktoken file become a ``tokenizers`` BPE model: every way to
split a token into two tokens is a merge, in the order of the ranks. A text is
cut only before a single space with a non-space after it, where no match of
the pattern can cross, and each distinct piece of a batch is encoded once.

Nulls and empty texts have no tokens. Rows are never merged or dropped, so
repeated rows give repeated results; an empty table gives an empty table.
Further columns of the input are left out unless named in ``keep``. A very long
text is encoded whole, by its task alone.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import small_batches, table

#: Text that a task looks at at once.
PIECE_BYTES = 2 << 20
#: Bytes of pieces and their ids that a worker remembers between batches, and what a remembered piece costs besides.
REMEMBERED_BYTES, ENTRY_BYTES = 36 << 20, 200
#: Marks after a Latin letter or a digit, at the end (U+0130 becomes a letter and a mark in lower case).
FINAL_MARKS = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])[.,!#$%&*]+$"
#: A space before any white space: such texts are encoded whole.
LOOSE_SPACE = r" [\s\x0B\x{85}\p{Z}\x1c-\x1f]"


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@functools.cache
def vocabulary_of(path: str) -> dict[str, int]:
    """The tokens of a rank file in the characters of their bytes, and their ranks."""
    chars = byte_chars()
    with open(path, "rb") as f:
        return {"".join(chars[b] for b in base64.b64decode(token)): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def load_tokenizer(path: str, pattern: str):
    """The tokenizers model of a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = vocabulary_of(path)
    merges = [(t[:i], t[i:]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab=ranks, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


@functools.cache
def token_bytes(path: str) -> pa.Array:
    """The bytes of each id, through the reversed byte table; needs no model. Ids that the file leaves out have none."""
    reverse = {c: b for b, c in enumerate(byte_chars())}
    vocab = vocabulary_of(path)
    found = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        found[i] = bytes(reverse[c] for c in token)
    return pa.array(found, pa.large_binary())


@functools.cache
def token_facts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The length of each id in bytes, and whether it begins within a character."""
    table = token_bytes(path)
    return pc.binary_length(table).to_numpy(zero_copy_only=False).astype(np.int64), np.array([x[:1] != b"" and x[0] & 0xC0 == 0x80 for x in table.to_pylist()], bool)


class PieceEncoder:
    """Encodes lists of distinct strings and remembers those that occur more than once in a batch, up to ``REMEMBERED_BYTES``."""

    def __init__(self, tokenizer):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known, self.held = tokenizer, {}, 0

    def __call__(self, pieces: list[str], occur: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one piece after another, and the number of ids of each piece."""
        known = self.known
        found = [known.get(p) for p in pieces]
        new = [k for k, ids in enumerate(found) if ids is None]
        for a in range(0, len(new), 10_000):
            part = new[a : a + 10_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = ids = array("I", e.ids).tobytes()
                if occur[k] > 1 and self.held < REMEMBERED_BYTES and len(ids) < 128:
                    known[pieces[k]] = ids
                    self.held += ENTRY_BYTES + len(pieces[k]) + len(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), sizes


@functools.cache
def encoder_of(vocabulary: str, pattern: str) -> PieceEncoder:
    """One for each worker, as it remembers pieces from task to task."""
    return PieceEncoder(load_tokenizer(vocabulary, pattern))


def spread(flat: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` (of the given sizes) in the order ``of``, one after another, and the size of each."""
    starts = np.cumsum(sizes) - sizes
    got = sizes[of]
    ends = np.cumsum(got)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[of] - (ends - got), got)
    return flat[at], got


def strings(values: pa.Array) -> list[str]:
    """The strings of an array without nulls; faster than one Arrow scalar after another."""
    return values.to_numpy(zero_copy_only=False).tolist()


def encode_pieces(encoder: PieceEncoder, pieces: pa.Array, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of n texts given as pieces, and the number of ids of each text; ``of`` is the text of each piece, ascending.

    Marks at the end of a piece, after a letter or digit, are a match of their own for every pattern used
    here, so they are encoded apart and fewer distinct strings remain.
    """
    coded = pieces.dictionary_encode()
    occur = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
    stems = pc.replace_substring_regex(coded.dictionary, FINAL_MARKS, r"\1")
    marks = np.full(len(stems), "", object)
    marked = np.flatnonzero(pc.not_equal(pc.binary_length(coded.dictionary), pc.binary_length(stems)).to_numpy(zero_copy_only=False))
    marks[marked] = [x[len(y) :] for x, y in zip(strings(coded.dictionary.take(pa.array(marked))), strings(stems.take(pa.array(marked))), strict=True)]
    parts = pa.concat_arrays([stems, pa.array(marks, pa.string())]).dictionary_encode()
    at = parts.indices.to_numpy()
    flat, sizes = encoder(strings(parts.dictionary), np.bincount(at, weights=np.tile(occur, 2), minlength=len(parts.dictionary)).tolist())
    flat, sizes = spread(flat, sizes, at.reshape(2, -1).T.reshape(-1))  # stem, mark, stem, mark ...
    ids, per_piece = spread(flat, sizes.reshape(-1, 2).sum(1), coded.indices.to_numpy())
    return ids, np.bincount(of, weights=per_piece, minlength=n).astype(np.int64)


def encode_texts(encoder: PieceEncoder, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and the number of ids of each."""
    text, n = pc.fill_null(text, ""), len(text)
    loose = pc.match_substring_regex(text, LOOSE_SPACE)
    parts = pc.split_pattern(pc.if_else(loose, "", text), " ")
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    words, of = pc.list_flatten(parts), np.repeat(np.arange(n), counts)
    first = np.zeros(len(words), bool)
    first[np.cumsum(counts) - counts] = True
    pieces = pc.binary_join_element_wise(pa.array(np.where(first, "", " ")), words, "")
    whole = loose.to_numpy(zero_copy_only=False)
    if whole.any():  # one piece for such a text, in place of its one empty part
        pieces = pc.replace_with_mask(pieces, pa.array(first & whole[of]), text.filter(loose))
    return encode_pieces(encoder, pieces, of, n)


def packed(values: np.ndarray, sizes: np.ndarray, width: int = 4) -> pa.Array:
    """A binary array of runs of numbers, without a copy of each run; null runs don't occur."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * width
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def char_spans(text: pa.Array, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 character of each token. A token that holds a part of a character has that character in its span."""
    raw = np.frombuffer(b"".join(pc.cast(pc.fill_null(text, ""), pa.binary()).to_pylist()), np.uint8)
    opens = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that open before each byte
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    of = np.repeat(np.arange(len(sizes)), sizes)
    text_bytes = np.bincount(of, weights=lengths[ids], minlength=len(sizes)).astype(np.int64)
    base = opens[np.cumsum(text_bytes) - text_bytes][of]
    inside = np.concatenate([(raw & 0xC0) == 0x80, [False]])
    return opens[starts] - inside[starts] - base, opens[ends] - base


def decode_runs(table: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of each run of ids: those of a run's tokens lie next to each other, so characters split between tokens come together again."""
    taken = table.take(pa.array(ids.astype(np.int64)))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[ends] if len(taken) else np.zeros(len(ends), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.ascontiguousarray(offsets)), taken.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())


def n_splits(splits: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """How many tokens of each run begin within a character."""
    return pa.array(np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=splits[ids], minlength=len(sizes)).astype(np.int64))


def _kept(df: DataFrame, keep: tuple[str, ...], *own: T.StructField) -> T.StructType:
    return T.StructType([*(f for c in keep for f in df.schema.fields if f.name == c), *own])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The ``keep`` columns, ``ids`` (unsigned 32-bit little-endian, in a binary column) and, if asked for, ``starts`` and ``ends``
    of the tokens in characters (signed 32-bit), and ``decoded`` and ``n_split`` as of ``decode``, in the same pass."""
    names = ["ids", *(["starts", "ends"] if offsets else []), *(["decoded"] if decoded else [])]
    own = _kept(df, keep, *(T.StructField(c, T.BinaryType()) for c in names), *([T.StructField("n_split", T.LongType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, pattern)
        for batch in small_batches(batches, text, PIECE_BYTES):
            ids, sizes = encode_texts(encoder, batch[text])
            columns = [batch[c] for c in keep] + [packed(ids.astype("<u4"), sizes)]
            if offsets:
                columns += [packed(x.astype("<i4"), sizes) for x in char_spans(batch[text], ids, sizes, token_facts(vocabulary)[0])]
            if decoded:
                columns += [decode_runs(token_bytes(vocabulary), ids, sizes), n_splits(token_facts(vocabulary)[1], ids, sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=own.names)

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, own)


def decode(df: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The ``keep`` columns, ``decoded`` (the bytes of all ids) and ``n_split``: how many tokens begin within a character, whose bytes come together again here."""
    own = _kept(df, keep, T.StructField("decoded", T.BinaryType()), T.StructField("n_split", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, splits = token_bytes(vocabulary), token_facts(vocabulary)[1]
        for batch in small_batches(batches, "ids", PIECE_BYTES):
            raw = pc.fill_null(batch["ids"], b"")
            sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            ids = np.frombuffer(b"".join(raw.to_pylist()), "<u4")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), decode_runs(table, ids, sizes), n_splits(splits, ids, sizes)], names=own.names)

    return df.select(*dict.fromkeys((*keep, "ids"))).mapInArrow(run, own)


def decoded_text(raw: bytes) -> str:
    """Decoded bytes as text; bytes that are part of a character only, as at a cut between tokens, become U+FFFD."""
    return raw.decode("utf-8", errors="replace")


def tokenized(df: DataFrame) -> DataFrame:
    """Encodes and decodes with the multilingual 50k ranks; the digests of both."""
    import public_tokenizers

    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = encode(df, vocabulary, pattern, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
