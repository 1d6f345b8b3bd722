"""Token ids of whole texts, in Arrow batches.

A text is dealt into segments at blanks where the tokenizer's pre-tokenizer
always splits; each distinct segment is encoded once by the tokenizers library
and its ids are gathered for every place. Texts with blanks of another kind
are encoded whole, so the ids always equal those of encoding the whole text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import CHUNK_BYTES, chunks, large, ragged

#: Distinct segments that a worker remembers between chunks.
REMEMBERED = 600_000
#: Segments that the tokenizer encodes in one call; what it returns takes about a kilobyte for each.
ENCODED = 4096
#: Segments that are encoded as one text.
JOINED = 256
#: Any blank but single spaces and single line feeds inside the text.
ODD_BLANKS = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class Segments:
    """Ids of distinct segments, kept between chunks in one growing array.

    A full stop or comma after a Latin letter is a pre-token of its own, so
    such a segment takes the ids of its word and of the mark. Segments that
    begin with a blank are joined to one text, since the pre-tokenizer splits
    there, and told apart by the ids whose tokens begin with a blank; where
    those are not as many as the segments, each is encoded alone.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.marks = {m: tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        vocabulary = tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True  # space and line feed, byte-level
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        if len(self.place) > REMEMBERED:
            self.clear()
        new = list(dict.fromkeys(s for s in new if s not in self.place))
        if not new:
            return
        joined = [s for s in new if len(s) > 1 and s[0] in " \n"]
        alone = [s for s in new if not (len(s) > 1 and s[0] in " \n")]
        new = joined + alone
        parts = [*self.together(joined), *self.apart(alone)]
        self.length, self.ids = (np.concatenate(x) for x in zip((self.length, self.ids), *parts, strict=True))
        self.start = np.cumsum(self.length) - self.length
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def together(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids per segment, ids), of segments that begin with a blank."""
        for k in range(0, len(segments), JOINED):
            own = segments[k : k + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.begins[ids])
            if len(at) == len(own) and at[0] == 0:
                yield np.diff(at, append=len(ids)), ids
            else:
                yield from self.apart(own)

    def apart(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(segments), ENCODED):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(segments[k : k + ENCODED], add_special_tokens=False)]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            yield lengths, np.fromiter(chain.from_iterable(own), np.uint32, int(lengths.sum()))

    def find(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, mark) of each segment in `ids`; mark is the id that follows, or -1."""
        base, mark = segments[:], np.full(len(segments), -1, np.int64)
        for k in [k for k, s in enumerate(segments) if s.endswith((".", ","))]:
            s = segments[k]
            if len(s) > 1 and s[-2] < "\u0250" and s[-2].isalpha():
                base[k], mark[k] = s[:-1], self.marks[s[-1]][0]
        self.learn(base)
        at = np.fromiter(map(self.place.__getitem__, base), np.int64, len(base))
        return self.start[at], self.length[at], mark


class Encoder:
    """Encodes string arrays; `words_only` for tokenizers that drop all blanks and case."""

    def __init__(self, path: str, end_id: int, words_only: bool):
        self.tokenizer, self.end_id, self.words_only = load(path), end_id, words_only
        self.segments = Segments(self.tokenizer)

    def deal(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct segments, code of each segment in order, segments per text)"""
        if self.words_only:
            lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:  # a text's first segment has no space before it and is marked
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string())), " ")
        coded = lists.flatten().dictionary_encode()
        counts = np.diff(lists.offsets.to_numpy())
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # as to_pylist, several times faster
        if not self.words_only:
            distinct = [s[1:] if s[:1] == "\0" else s if s[:1] == "\n" else " " + s for s in distinct]
        return distinct, coded.indices.to_numpy().astype(np.int64), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text), each text followed by the end id. Null counts as empty."""
        texts = large(texts)
        whole = np.zeros(len(texts), bool) if self.words_only else np.asarray(pc.match_substring_regex(texts, ODD_BLANKS).to_numpy(zero_copy_only=False), bool)
        if whole.any():
            plain = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), texts)
        else:
            plain = texts
        distinct, codes, counts = self.deal(plain)
        start, length, mark = self.segments.find(distinct)
        # Each distinct segment's ids with its mark, side by side; then a gather for every place.
        marked = mark >= 0
        full = length + marked
        own = np.empty(int(full.sum()), np.uint32)
        ends = np.cumsum(full)
        last = np.ones(len(own), bool)
        last[ends[marked] - 1] = False
        own[last] = self.segments.ids[ragged(start, length)]
        own[ends[marked] - 1] = mark[marked]
        lengths = full[codes]
        ids = own[ragged((ends - full)[codes], lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        per_text = sums[ends] - sums[ends - counts]
        if whole.any():
            parts, at = [], 0
            rows = np.flatnonzero(whole)
            found = self.tokenizer.encode_batch_fast([texts[int(r)].as_py() for r in rows], add_special_tokens=False)
            bounds = np.concatenate(([0], np.cumsum(per_text)))
            for r, e in zip(rows, found, strict=True):
                own = np.array(e.ids, np.uint32)
                parts += [ids[at : bounds[r]], own]
                at = bounds[r + 1]
                per_text[r] = len(own)
            ids = np.concatenate([*parts, ids[at:]])
        out = np.full(len(ids) + len(texts), self.end_id, np.uint32)
        ends = np.cumsum(per_text + 1)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = ids
        return out, per_text + 1


@cache
def encoder(path: str, end_id: int, words_only: bool) -> Encoder:
    """One per worker, so that tasks share what it remembers."""
    return Encoder(path, end_id, words_only)


def encoded(texts: pa.Array, with_: Encoder, step: int = CHUNK_BYTES):
    """(row slice, ids, ids per text) of a batch, `step` bytes of text at a time."""
    texts = large(texts)
    for start, stop in chunks(texts, step):
        yield slice(start, stop), *with_.encode(texts.slice(start, stop - start))


def crcs(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.array([zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64)


def public(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
