"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``rank_tokenizer`` turns a rank file (base64 token, rank) into a ``tokenizers`` BPE model:
every byte maps to one printable character (the byte-to-character table of byte-level
BPE), and every split of a token into two tokens becomes a merge of the token's rank.
Texts are cut by the vocabulary's pattern, each match is mapped byte by byte and encoded
by the model. Decoding reverses the byte table token by token; a character whose bytes
are split over several tokens comes together again because bytes are joined before UTF-8
is read.

A text is a chain of units that begin at a single space between two other characters; the
pattern never matches across such a place, so units are encoded once per worker and
reused. The cache is bounded and only saves time.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, released, ship_code

# a rank file is sent to the tasks whole; larger ones are refused
MAX_RANK_FILE_BYTES = 64 << 20
_CACHE_ENTRIES = 800_000
_CACHED_CHARS = 64
_JOINED = 64
_OUT_ROWS = 512


def byte_characters() -> list[str]:
    """The printable character of each byte: printable Latin-1 bytes stand for themselves,
    the others follow from code point 256 on in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(256 + len(table) - len(own)))
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > MAX_RANK_FILE_BYTES:
        raise ValueError(f"rank file above {MAX_RANK_FILE_BYTES} bytes")
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def rank_tokenizer(ranks: dict[bytes, int]):
    """The ``tokenizers`` model of a rank table, for single matches of the pattern joined
    by line feeds (which the byte-to-character table never gives); a line feed gets the
    first id after the ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    table = byte_characters()
    shown = {token: "".join([table[b] for b in token]) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]])
              for token in sorted(ranks, key=ranks.get)
              for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    vocab = {shown[t]: r for t, r in ranks.items()} | {"\n": max(ranks.values(), default=-1) + 1}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
    return tokenizer


def merge_units(parts: list[str]) -> list[str]:
    """Join what a split at every space has cut beside other white space."""
    units, last = [], ""
    for part in parts:
        if units and (not part or not last or part[0].isspace() or last[-1].isspace()):
            units[-1] += " " + part
        else:
            units.append(part)
        last = part
    return units


def _ragged(unit: str) -> bool:
    return not unit or unit[0].isspace() or unit[-1].isspace()


class Decoder:
    """The bytes of all tokens, one after the other."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.zeros(size, np.int64)
        np.cumsum(self.lengths[:-1], out=self.starts[1:])
        flat = bytearray(int(self.lengths.sum()))
        for token, rank in ranks.items():
            flat[self.starts[rank]:self.starts[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.flat[at].tobytes()


class Codec(Decoder):
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(ranks)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
        self.tokenizer = rank_tokenizer(ranks)
        self.pattern = regex.compile(pattern)
        self.shift = dict(enumerate(byte_characters()))
        self.after_space: dict[str, bytes] = {}  # ids of " " + key
        self.bare: dict[str, bytes] = {}  # ids of a match without a space before it

    def _encode_matches(self, matches: list[str]) -> Iterator[bytes]:
        """Ids (int32, as bytes) of each match of the pattern."""
        mapped = [m.encode().decode("latin-1").translate(self.shift) for m in matches]
        joined = ["\n".join(mapped[i:i + _JOINED]) for i in range(0, len(mapped), _JOINED)]
        for found in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, np.int32)
            ends = [*np.flatnonzero(ids == len(self.lengths)).tolist(), len(ids)]
            ids, start = ids.tobytes(), 0
            for end in ends:
                yield ids[4 * start:4 * end]
                start = end + 1

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of " " + unit for new units; all but long ones go into the table."""
        spaced, bare = self.after_space, self.bare
        single, cuts, new_bare = set(), {}, set()
        for unit in units:
            if unit.isalpha():  # letters after a space are one match
                single.add(unit)
                continue
            if unit[:-1].isalpha() and unit[-1] in ".,!?;:":
                cut = [" " + unit[:-1], unit[-1]]
            else:
                cut = self.pattern.findall(" " + unit)
            cuts[unit] = cut
            for match in cut:
                if match[0] == " ":
                    if match[1:] not in spaced:
                        single.add(match[1:])
                elif match not in bare:
                    new_bare.add(match)
        new, new_bare = list(single), list(new_bare)
        found = dict(zip(new, self._encode_matches([" " + m for m in new])))
        found_bare = dict(zip(new_bare, self._encode_matches(new_bare)))
        bare.update((m, i) for m, i in found_bare.items() if len(m) <= _CACHED_CHARS)
        for unit, cut in cuts.items():
            found[unit] = b"".join([
                (found.get(m[1:]) or spaced[m[1:]]) if m[0] == " "
                else found_bare.get(m) or bare[m] for m in cut])
        spaced.update((u, i) for u, i in found.items() if len(u) <= _CACHED_CHARS)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (int32, as bytes) of whole texts."""
        spaced = self.after_space
        if len(spaced) > _CACHE_ENTRIES:
            spaced.clear()
            self.bare.clear()
        rows, new = [], set()
        for text in texts:
            first, *units = text.split(" ")
            got = list(map(spaced.get, units))
            holes = [i for i, ids in enumerate(got) if ids is None]
            if _ragged(first) or any(_ragged(units[i]) for i in holes):
                first, *units = merge_units([first, *units])
                got = list(map(spaced.get, units))
                holes = [i for i, ids in enumerate(got) if ids is None]
            new.update([units[i] for i in holes])
            rows.append((first, units, got, holes))
        found = self._learn(new) if new else {}
        out = []
        for first, units, got, holes in rows:
            for i in holes:
                got[i] = found[units[i]]
            out.append(b"".join([*self._encode_matches(self.pattern.findall(first)), *got]))
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) code point that each token touches."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # code point of each byte
        ends = np.cumsum(self.lengths[ids])
        return (char[ends - self.lengths[ids]].astype(np.int32),
                (char[ends - 1] + 1).astype(np.int32))


def _codec(key: tuple, ranks, pattern: str) -> Codec:
    """One per worker and vocabulary."""
    return held(("bpe", *key), lambda: Codec(ranks.value, pattern))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


_TYPES = {"array<int>": T.ArrayType(T.IntegerType()), "binary": T.BinaryType(),
          "string": T.StringType()}


def _per_batch(df: DataFrame, added: list[tuple[str, str]], work: Callable) -> DataFrame:
    """``df`` with the columns ``added`` (name, type), which ``work`` computes for slices of
    a few hundred rows; columns with these names are replaced."""
    ship_code(df.sparkSession)
    names = [n for n, _ in added]
    kept = [c for c in df.columns if c not in names]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind in added:
        schema = schema.add(name, _TYPES[kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _OUT_ROWS):
                part = batch.slice(at, _OUT_ROWS)
                arrays = [part.column(c) for c in kept] + work(part)
                yield pa.RecordBatch.from_arrays(arrays, names=kept + names)
        released()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text",
           with_offsets: bool = False) -> DataFrame:
    """``df`` with ``ids array<int>`` and, on request, ``starts`` and ``ends`` (code points
    that each token covers; tokens that share a split character overlap in it).

    No special tokens: their strings are ordinary text. NULL and empty texts have no ids.
    Columns named like the new ones are replaced; rows, repeated ones included, are
    treated one by one; texts are never cut. The rank file is read where the plan is built
    and sent to the tasks (at most ``MAX_RANK_FILE_BYTES``).
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    key = (rank_path, os.path.getmtime(rank_path), pattern)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(key, ranks, pattern)
        texts = [t or "" for t in part.column(text_col).to_pylist()]
        ids = [np.frombuffer(b, np.int32) for b in codec.encode(texts)]
        out = [_lists(ids)]
        if with_offsets:
            spans = [codec.offsets(t, i) for t, i in zip(texts, ids)]
            out += [_lists([s for s, _ in spans]), _lists([e for _, e in spans])]
        return out

    added = [("ids", "array<int>")]
    if with_offsets:
        added += [("starts", "array<int>"), ("ends", "array<int>")]
    return _per_batch(df, added, work)


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids",
           as_text: bool = False) -> DataFrame:
    """``df`` with ``decoded binary``: the bytes of ``ids_col``; with ``as_text`` also
    ``decoded_text`` (broken UTF-8 becomes U+FFFD). NULL ids decode to nothing; an id
    outside the vocabulary fails."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    key = ("bpe-decoder", rank_path, os.path.getmtime(rank_path))

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        decoder = held(key, lambda: Decoder(ranks.value))
        raw = [decoder.decode(np.asarray(v.values if v.is_valid else [], np.int64))
               for v in part.column(ids_col)]
        out = [pa.array(raw, pa.binary())]
        return out + [pa.array([r.decode("utf-8", "replace") for r in raw])] if as_text else out

    added = [("decoded", "binary")] + ([("decoded_text", "string")] if as_text else [])
    return _per_batch(df, added, work)
