"""LM scoring by logistic context mixing of hashed-context bit predictors.

A text is coded token by token, a token as the bits of its path in a Huffman
tree of the training tokens (unknown tokens as an escape and their bytes). Each
bit, of words and of bytes, is predicted from counts under three hashed
contexts: of words the place in the tree alone, with the last frequent word, and
with the class of the word before; of bytes the two, three and five before. The
predictions are combined in the logistic domain with weights that a gate
selects by how much each context has seen. The weights are learned from every
bit of all training texts and of all spelled words, each predicted from the
counts less its own; a text's are refined as it goes on, from its earlier bits
only, so the probabilities of all texts sum to one.

Texts are tokenised once and written as codes and hashes, which all passes read. Counts
come from all training texts. Each task counts into tables and sends them in compressed blocks, which are summed in two steps, in 64 bits. For the
weights it counts, in the same way, how often bits came at each combination of
the predictors' states; on those counts the weights are fitted at once. The
tables have a slot for every SLOT_TOKENS training tokens, MOST_SLOTS at most,
and the TOP most frequent words have a code; these bounds are what is broadcast.
Rarer words are spelled, and counted exactly through a join.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import finish
from .shared import chunks, cut, large, ragged, words

#: Words with a code of their own, at most.
TOP = 3 << 18
#: Slots of a predictor's table: one for so many training tokens, within these bounds.
SLOT_TOKENS, LEAST_SLOTS, MOST_SLOTS = 4, 1 << 16, 1 << 20
SPELL_SLOTS = 1 << 19
ORDERS = 3
#: Levels of a stretched probability, and levels for an inverse hyperbolic sine of 1, in the counts that the weights are fitted on.
LEVELS, SPREAD = 32, 4.7
SPELL_BACK = (2, 3, 5)
#: Counters in a block of a table as it is sent, and parts in which blocks of one number are first summed.
BLOCK, FAN = 1 << 15, 16
#: Text bytes whose bits are held at once.
STEP_BYTES = 8 << 20
#: Tokens of a text between two refinements of its weights: growing, then constant.
REFINE = (16, 32, 64, 128, 256, 512)
RATE, STEADY = 1.0, 30.0
PER_NAT = np.float32(1 / np.log(2))  # bits
END = "\x20"  # no word has a blank, so this stands for the end token
ESCAPE = "\x20\x20"
#: Counts added to each side of a bit before it is stretched.
PRIOR = np.float32(0.4)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def beginnings(tokens: list[str]) -> np.ndarray:
    return np.fromiter((int.from_bytes(t.encode()[:8].ljust(8, b"\0"), "big") for t in tokens), np.uint64, len(tokens))


def half(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def strings(column: pa.Array) -> list[str]:
    """As to_pylist, several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def tokens_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, codes, tokens per text) with the end token after each text's words."""
    distinct, codes, counts = words(texts)
    end = len(distinct)
    out = np.full(len(codes) + len(counts), end, np.int64)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = codes
    return [*strings(distinct), END], out, counts + 1


def held_out(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols with ascending counts, by two queues."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    weights = deque(counts.tolist())
    merged: deque[int] = deque()
    parent = np.zeros(2 * n - 1, np.int64)
    leaf, inner, made = 0, n, n
    for _ in range(n - 1):
        total = 0
        for _ in range(2):
            if not merged or (weights and weights[0] <= merged[0]):
                total += weights.popleft()
                parent[leaf] = made
                leaf += 1
            else:
                total += merged.popleft()
                parent[inner] = made
                inner += 1
        merged.append(total)
        made += 1
    depth = np.zeros(2 * n - 1, np.int64)
    for node in range(2 * n - 3, n - 1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[parent[:n]] + 1


@dataclass
class Codes:
    """Known words by ascending hash, with count, code and code length; the escape is one of them."""

    hashes: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    escape: int
    classes: np.ndarray
    frequent: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, own: np.ndarray, starts: np.ndarray, escapes: int) -> Codes:
        """Of codes of one length, words that begin alike stand side by side, so that
        the first bits tell of the language."""
        escape_hash = hashed([ESCAPE])[0]
        hashes, starts = (np.append(x.view(np.uint64), np.uint64(y)) for x, y in ((hashes, escape_hash), (starts, 0)))
        weights = np.append(own, max(1, escapes))
        # A code of at most 31 bits: no weight is less than a 2**21th of all. What a bit costs is learned, not given by the tree.
        floored = np.maximum(weights, int(weights.sum()) >> 21)
        order = np.lexsort((hashes, floored))
        lengths = np.empty(len(order), np.int64)
        lengths[order] = code_lengths(floored[order])
        # Canonical codes: by length, then beginning, then hash.
        codes, code, last = np.empty(len(order), np.uint64), 0, 0
        by_length = np.lexsort((hashes, starts, lengths))
        sorted_lengths = lengths[by_length]
        for length in np.unique(sorted_lengths).tolist():
            rows = by_length[sorted_lengths == length]
            code <<= length - last
            codes[rows] = np.uint64(code) + np.arange(len(rows), dtype=np.uint64)
            code, last = code + len(rows), length
        by_hash = np.argsort(hashes)
        hashes, codes, lengths = hashes[by_hash], codes[by_hash], lengths[by_hash]
        escape = int(np.searchsorted(hashes, escape_hash))
        least = np.minimum(lengths, 8).astype(np.uint64)
        classes = (np.uint64(1) << least) | (codes >> (lengths.astype(np.uint64) - least))
        frequent = lengths <= 11
        frequent[escape] = False
        frequent[hashes == hashed([END])[0]] = False
        return cls(hashes, np.append(counts, 0)[by_hash], codes.astype(np.uint32), lengths.astype(np.uint8), escape, classes.astype(np.uint16), frequent)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, the escape's where unknown."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, self.escape)


def bits_of(codes: np.ndarray, lengths: np.ndarray, contexts: list[np.ndarray | None], slots: int) -> Iterator[tuple[np.ndarray | slice, np.ndarray, list[np.ndarray]]]:
    """The bits of coded symbols, all first bits, then all second ones and so on:
    (which symbols have such a bit, their bits, each predictor's slots)."""
    shift = np.uint32(32 - (slots - 1).bit_length())
    codes, lengths = codes.astype(np.uint32), lengths.astype(np.uint8)
    for depth in range(int(lengths.max(initial=0))):
        if lengths.min() > depth:
            which, own, left = slice(None), codes, lengths - np.uint8(depth + 1)
        else:
            which = np.flatnonzero(lengths > depth)
            own, left = codes[which], lengths[which] - np.uint8(depth + 1)
        upto = own >> left
        bit = (upto & np.uint32(1)).astype(np.int8)
        node = ((upto >> np.uint32(1)) | np.uint32(1 << depth)) * np.uint32(0x9E3779B1)
        out = []
        for c in contexts:
            h = node if c is None else node ^ c[which]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)) >> shift).astype(np.int64))
        yield which, bit, out


def word_contexts(h: np.ndarray, row: np.ndarray, n: np.ndarray, codes: Codes) -> list[np.ndarray]:
    """Contexts of each token: none, the last frequent word before it in its text
    (which tells language and register), and the class of the word before."""
    starts = np.cumsum(n) - n
    last = np.empty(len(h), np.int64)
    last[1:] = np.maximum.accumulate(np.where(codes.frequent[row], np.arange(len(h)), -1))[:-1]
    last[:1] = -1
    common = np.where(last >= np.repeat(starts, n), h[last], 0)
    before = np.empty(len(h), np.uint64)
    before[1:] = codes.classes[row[:-1]]
    before[starts] = 0
    return [None, half(finish(common + np.uint64(1))), half(finish(before * B + np.uint64(2)))]


def spelling(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes with a closing 0, bytes per token, contexts of SPELL_BACK bytes before)."""
    spelled = [t.encode() + b"\0" for t in tokens]
    joined = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, spelled), np.int64, len(spelled))
    place = np.arange(len(joined)) - np.repeat(np.cumsum(n) - n, n)
    contexts, c = [], np.zeros(len(joined), np.uint64)
    for j in range(1, SPELL_BACK[-1] + 1):
        back = np.zeros(len(joined), np.uint64)
        back[j:] = joined[:-j] + np.uint64(1)
        back[place < j] = 0
        c = (c ^ back) * C + np.uint64(j)
        c ^= c >> np.uint64(31)
        if j in SPELL_BACK:
            contexts.append(half(c * B))
    return joined, n, contexts


class Table:
    """Counters of ORDERS predictors: slot s of predictor k after bit b at ((k * slots) + s) * 2 + b.
    A task's are of 32 bits, since it sees less than 2**32 bits; sums are of 64."""

    def __init__(self, slots: int):
        self.slots, self.counts = slots, np.zeros(ORDERS * slots * 2, np.uint32)

    def add(self, codes: np.ndarray, lengths: np.ndarray, contexts: list, first: int = 0, times: np.ndarray | None = None) -> None:
        """Count the bits of coded symbols, once or as often as `times` says, with predictors from `first` on."""
        for which, bit, slots in bits_of(codes, lengths, contexts, self.slots):
            for k, s in enumerate(slots, first):
                np.add.at(self.counts, (s + k * self.slots) * 2 + bit, np.uint32(1) if times is None else times[which])

    def blocks(self, kind: int) -> Iterator[tuple[int, bytes]]:
        yield from pressed(self.counts, kind)


def pressed(counts: np.ndarray, kind: int) -> Iterator[tuple[int, bytes]]:
    press = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(counts), BLOCK):
        block = counts[k : k + BLOCK]
        if block.any():
            yield kind + k // BLOCK, press.compress(block.astype(np.int64).tobytes())


#: Block numbers of the speller's table start here.
SPELLER = 1 << 20


def summed(blocks: DataFrame) -> DataFrame:
    """Sum blocks (block, part, counts) by number, a partition's rows in a stream: first within parts
    of the tasks that sent them, so that no task sees a block from each of very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for block, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(unpress.decompress(data.as_py()), np.int64)
                if (block, part) in total:
                    total[block, part] += own
                else:
                    total[block, part] = own.copy()
        press = zstandard.ZstdCompressor(level=1)
        for (block, part), counts in total.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "part": [part], "counts": [press.compress(counts.tobytes())]}, BLOCKS)

    kind = "block long, part int, counts binary"
    some = blocks.repartition("block", "part").mapInArrow(run, kind).withColumn("part", F.lit(0))
    return some.repartition("block").mapInArrow(run, kind).select("block", "counts")


BLOCKS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])


def seen_class(n: np.ndarray) -> np.ndarray:
    return np.digitize(n, (1, 3, 16)).astype(np.uint8)


class Predictors:
    """A summed table as stretched probabilities, with the class of how much each slot
    has seen in their two lowest bits, so that one look finds both."""

    def __init__(self, slots: int, rows: list[tuple[int, bytes]], kind: int):
        self.slots = slots
        self.stretch = np.zeros(ORDERS * slots, np.float32)
        for block, data in rows:
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
            at = (block - kind) * BLOCK // 2
            n0, n1 = own[0::2], own[1::2]
            stretch = np.log((n1 + PRIOR) / (n0 + PRIOR)).astype(np.float32)
            self.stretch[at : at + len(n0)] = ((stretch.view(np.uint32) & ~np.uint32(3)) | seen_class(n0 + n1)).view(np.float32)

    @property
    def seen(self) -> np.ndarray:
        return (self.stretch.view(np.uint32) & np.uint32(3)).astype(np.uint8)

    def inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each predictor's stretched probability, and the gate: the classes of the two longer contexts."""
        st = [self.stretch[k * self.slots : (k + 1) * self.slots].take(s) for k, s in enumerate(slots)]
        seen = [x.view(np.uint32) & np.uint32(3) for x in st[1:]]
        return st, (seen[0] * np.uint32(4) + seen[1]).astype(np.int64)


class States:
    """What a summed table predicts for a bit that is left out of it: at each counter the level of
    the stretched probability and the class of what the slot has seen, both without one such bit.

    With `whole` the first predictor keeps the bit: a tree that was built from the counts sets words
    that came equally often side by side, so there a count less one would tell the bit."""

    def __init__(self, slots: int, rows: list[tuple[int, bytes]], kind: int, whole: bool):
        self.slots, self.state = slots, np.zeros(ORDERS * slots * 2, np.uint8)
        for block, data in rows:
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64).reshape(-1, 2)
            at = (block - kind) * BLOCK
            for bit in range(2):
                left = own.copy()
                if not (whole and at < 2 * slots):
                    left[:, bit] = np.maximum(left[:, bit] - 1, 0)
                stretch = np.log((left[:, 1] + PRIOR) / (left[:, 0] + PRIOR))
                level = (np.rint(np.arcsinh(stretch) * SPREAD) + LEVELS // 2).clip(0, LEVELS - 1).astype(np.uint8)
                self.state[at + bit : at + 2 * len(own) : 2] = level + seen_class(left.sum(axis=1)) * np.uint8(LEVELS)

    def tally(self, codes: np.ndarray, lengths: np.ndarray, contexts: list, counts: np.ndarray) -> None:
        """Count the bits of coded symbols by the states of the predictors: see `weights_from`."""
        states = self.state.reshape(ORDERS, -1)
        for _, bit, slots in bits_of(codes, lengths, contexts, self.slots):
            cell = bit.astype(np.int32)
            for k, s in enumerate(slots):
                state = states[k].take(s * 2 + bit).astype(np.int32)
                cell += (state if k else state % LEVELS) * (2 * (4 * LEVELS) ** (ORDERS - 1 - k))
            np.add.at(counts, cell.astype(np.int64), np.uint32(1))


#: Counters of `States.tally`: level of the first predictor, levels and classes of the others, bit.
TALLY = LEVELS * (4 * LEVELS) ** (ORDERS - 1) * 2


def weights_from(weights: np.ndarray, rows: list[tuple[int, bytes]], kind: int) -> np.ndarray:
    """Weights of the gates learned from summed counts of `States.tally`."""
    counts = np.zeros(TALLY, np.int64)
    for block, data in rows:
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
        counts[(block - kind) * BLOCK : (block - kind) * BLOCK + len(own)] = own
    at = np.flatnonzero(counts)
    if not len(at):
        return weights
    cell, bit = np.divmod(at, 2)
    states = [cell // (4 * LEVELS) ** (ORDERS - 1 - k) % (4 * LEVELS) for k in range(ORDERS)]
    value = np.sinh((np.arange(LEVELS) - LEVELS // 2) / SPREAD)
    return learned(weights, [([value[x % LEVELS] for x in states], states[1] // LEVELS * 4 + states[2] // LEVELS, bit)], times=counts[at])


def first_weights() -> np.ndarray:
    """Weights of the 16 gates (class of the second context, class of the third)
    before anything is learned. Contexts that have both seen enough outweigh the tree
    alone, whose odds they already contain."""
    c1, c2 = np.divmod(np.arange(16), 4)
    out = np.tile(np.array([1.0, 0.0, 0.0]), (16, 1))
    out[(c1 == 1) | (c2 == 1)] = (0.7, 0.2, 0.1)
    out[c1 >= 2] = (0.1, 0.7, 0.2)
    out[(c1 < 2) & (c2 >= 2)] = (0.4, 0.1, 0.5)
    out[(c1 >= 2) & (c2 >= 2)] = (-0.3, 0.8, 0.5)
    out[(c1 == 3) & (c2 == 3)] = (-0.7, 0.69, 0.61)
    return out.astype(np.float32)


def spelling_weights() -> np.ndarray:
    """The same for bytes, whose contexts lengthen: the longer ones count by what they have seen."""
    c1, c2 = np.divmod(np.arange(16), 4)
    out = np.tile(np.array([0.9, 0.1, 0.0]), (16, 1))
    out[c1 >= 2] = (0.4, 0.6, 0.05)
    out[c2 == 1] = (0.4, 0.5, 0.15)
    out[c2 >= 2] = (0.25, 0.5, 0.35)
    return out.astype(np.float32)


@dataclass
class Model:
    codes: Codes
    words: Predictors
    speller: Predictors
    train_tokens: int
    vocabulary: int
    word_weights: np.ndarray
    spell_weights: np.ndarray

    def spell(self, tokens: list[str]) -> np.ndarray:
        """Log2 probability of each token's bytes; depends on the token alone."""
        if not tokens:
            return np.zeros(0)
        out = []
        for a in range(0, len(tokens), 20_000):
            own = tokens[a : a + 20_000]
            joined, n, contexts = spelling(own)
            odds = np.ones(len(joined))
            for _, bit, slots in bits_of(joined, np.full(len(joined), 8), contexts, self.speller.slots):
                st, gate = self.speller.inputs(slots)
                odds *= 1 + against([self.spell_weights[:, k].take(gate) for k in range(ORDERS)], st, signs(bit))
            out.append(-np.add.reduceat(np.log2(odds), np.cumsum(n) - n))
        return np.concatenate(out)

    def score(self, h: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log2 probability of the coded tokens of each text, its weights refined as it goes on."""
        contexts = word_contexts(h, row, n, self.codes)
        # Longest first: of each turn's tokens, those of texts that go on are the first ones.
        order = np.argsort(-n, kind="stable")
        n, starts = n[order], (np.cumsum(n) - n)[order]
        costs = np.zeros(len(n))
        weights = [np.tile(self.word_weights[:, k], len(n)) for k in range(ORDERS)]
        at, turn = 0, 0
        while live := int(np.searchsorted(-n, -at)):
            length = REFINE[min(turn, len(REFINE) - 1)]
            on = int(np.searchsorted(-n, -(at + length)))
            own = np.minimum(n[:live] - at, length)
            tokens = ragged(starts[:live] + at, own)
            first = np.repeat(np.arange(live) * 16, own)
            own_row = row[tokens]
            # Products of what the bits cost: 31 factors of at most exp(20).
            odds = np.ones(len(tokens))
            seen, steps = np.zeros(on * 16), np.zeros((ORDERS, on * 16))
            for some, bit, slots in bits_of(self.codes.codes[own_row], self.codes.lengths[own_row], [c if c is None else c[tokens] for c in contexts], self.words.slots):
                st, gate = self.words.inputs(slots)
                cell = first[some] + gate
                # Odds against the bit that came: they give its cost and, with its sign, the error.
                sign = signs(bit)
                odds_against = against([w.take(cell) for w in weights], st, sign)
                cost = 1 + odds_against
                odds[some] *= cost
                going = on * length if isinstance(some, slice) else int(np.searchsorted(some, on * length))
                if going:
                    cell, error = cell[:going], sign[:going] * odds_against[:going] / cost[:going]
                    seen += np.bincount(cell, minlength=on * 16)
                    for k in range(ORDERS):
                        steps[k] += np.bincount(cell, error * st[k][:going], on * 16)
            costs[:live] += np.add.reduceat(np.log2(odds), np.cumsum(own) - own)
            for k in range(ORDERS):
                weights[k][: on * 16] += RATE / (STEADY + seen) * steps[k]
            at, turn = at + length, turn + 1
        out = np.empty(len(n))
        out[order] = -costs
        return out


def learned(weights: np.ndarray, bits: list[tuple[list[np.ndarray], np.ndarray, np.ndarray]], rounds: int = 30, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of the gates by gradient steps on (inputs, gate, bit) of bits that the counts have not seen; all count once, or as often as `times` says."""
    if not bits:
        return weights
    st = [np.concatenate([b[0][k] for b in bits]).astype(np.float64) for k in range(ORDERS)]
    gate, bit = np.concatenate([b[1] for b in bits]), np.concatenate([b[2] for b in bits])
    times = np.ones(len(bit)) if times is None else times.astype(np.float64)
    curve = [np.bincount(gate, times * 0.25 * s * s, 16) + 50.0 for s in st]
    out = weights.astype(np.float64)
    best, least = weights, np.inf
    for _ in range(rounds):
        x = sum(out[gate, k] * s for k, s in enumerate(st))
        cost = -float((times * log2_p(x, bit)).sum())
        if cost < least:
            best, least = out.astype(np.float32), cost
        error = times * (bit - 1 / (1 + np.exp(-x.clip(-30, 30))))
        for k, s in enumerate(st):
            out[:, k] += np.bincount(gate, error * s, 16) / (ORDERS * curve[k])
    return best


def signs(bit: np.ndarray) -> np.ndarray:
    return bit * np.float32(2) - np.float32(1)


def against(weights: list[np.ndarray], st: list[np.ndarray], sign: np.ndarray) -> np.ndarray:
    """Odds against the bits of these signs, of weighted stretched predictions."""
    x = weights[0] * st[0]
    for w, s in zip(weights[1:], st[1:], strict=True):
        x += w * s
    x *= -sign
    return np.exp(np.clip(x, np.float32(-20), np.float32(20), out=x), out=x)


def log2_p(x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Log2 of the probability that a stretched prediction gives to the bit that came."""
    y = np.where(bit == 1, -x, x).clip(-20, 20)
    return -np.log1p(np.exp(y)) * PER_NAT


TOKENS = "ids array<long>, held array<boolean>, sizes array<long>, n binary, codes binary, hashes binary, names binary"


def tokenised(rows: DataFrame) -> DataFrame:
    """TOKENS of rows (doc_id, text, held_out), a row for some texts together: sizes in bytes, tokens per text, and of
    the tokens their codes, i.e. places among the distinct ones, the end token last; hashes and names of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts, STEP_BYTES):
                own = texts.slice(a, b - a)
                distinct, codes, n = tokens_of(own)
                blobs = n.tobytes(), codes.astype(np.int32).tobytes(), hashed(distinct).tobytes(), " ".join(distinct[:-1]).encode()
                lists = batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pc.binary_length(own).cast(pa.int64())
                border = pa.array([0, b - a], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.ListArray.from_arrays(border, x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in lists], *[pa.array([press.compress(x)], pa.binary()) for x in blobs]],
                    names=["ids", "held", "sizes", "n", "codes", "hashes", "names"],
                )

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, TOKENS)


def read_tokens(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(its row, tokens per text, codes, hashes) of each group of texts; with `training` without the texts that are held out."""
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            group = batch.slice(k, 1)
            n, codes, hashes = (np.frombuffer(unpress.decompress(group.column(c)[0].as_py()), kind) for c, kind in (("n", np.int64), ("codes", np.int32), ("hashes", np.uint64)))
            if training:
                own = ~group.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool)
                codes, n = codes[np.repeat(own, n)], n[own]
            if len(n):
                yield group, n, codes, hashes


def names_of(group: pa.RecordBatch) -> list[str]:
    joined = zstandard.ZstdDecompressor().decompress(group.column("names")[0].as_py()).decode()
    return [*(joined.split(" ") if joined else []), END]


def train(tokens: DataFrame) -> tuple[Model, DataFrame]:
    """Fit on the texts of TOKENS that are not held out. Also returns the exact counts of the tokens that have no code (token, c)."""
    spark = tokens.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _, codes, hashes in read_tokens(batches, training=True):
            c = np.bincount(codes, minlength=len(hashes))
            there = c > 0
            yield pa.RecordBatch.from_arrays([pa.array(names_of(group), pa.string()).filter(pa.array(there)), pa.array(c[there])], names=["token", "c"])

    counts = cut(tokens.select("held", "n", "codes", "hashes", "names").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")))
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The most frequent words: all from some count on, at most TOP. Words that came
    # once have no code: they stand for the unknown ones and train the escape.
    step = F.when(F.col("c") > 1, F.floor(4 * F.log2(F.when(F.col("c") > 1, F.col("c"))))).otherwise(0).cast("int")
    held, mass, least = 0, 0, 10**6
    for r in counts.where("c > 1").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect():
        if held + r.n > TOP:
            break
        held, mass, least = held + r.n, mass + r.c, r.step
    top = counts.where((step >= least) & (F.col("c") > 1))

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = strings(batch.column("token"))
            yield pa.RecordBatch.from_arrays([pa.array(hashed(tokens).view(np.int64)), batch.column("c"), pa.array(beginnings(tokens).view(np.int64))], names=["h", "c", "b"])

    found = top.mapInArrow(hash_, "h long, c long, b long").toArrow().combine_chunks()
    codes = Codes.of(*[found[x].to_numpy().astype(np.int64) for x in ("h", "c", "c", "b")], total - mass)
    shared = spark.sparkContext.broadcast(codes)
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (int(total) // SLOT_TOKENS).bit_length()))
    spelled = counts.where(F.col("token") != END).select("token")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, list]]]:
        """Rows of the texts' tokens among the codes, and codes, lengths and contexts."""
        codes = shared.value
        for _, n, code, hashes in read_tokens(batches, training=True):
            row, h = codes.find(hashes)[code], hashes[code]
            yield row, (codes.codes[row], codes.lengths[row], word_contexts(h, row, n, codes))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
        """The same of the bytes of tokens."""
        for batch in batches:
            tokens = strings(batch.column("token"))
            for a in range(0, len(tokens), 20_000):
                joined, _, contexts = spelling(tokens[a : a + 20_000])
                yield joined, np.full(len(joined), 8), contexts

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, codes = Table(slots), shared.value
        times = np.zeros(len(codes.hashes), np.uint32)
        for row, (own, lengths, contexts) in coded(batches):
            table.add(own, lengths, contexts[1:], first=1)
            times += np.bincount(row, minlength=len(times)).astype(np.uint32)
        some = np.flatnonzero(times)  # the first predictor sees the place in the tree alone, so words count together
        table.add(codes.codes[some], codes.lengths[some], [None], times=times[some])
        yield from sent(table.blocks(0))

    def count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(SPELL_SLOTS)
        for symbols in letters(batches):
            table.add(*symbols)
        yield from sent(table.blocks(SPELLER))

    def tally_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, counts = left_out.value[0], np.zeros(TALLY, np.uint32)
        for _, symbols in coded(batches):
            states.tally(*symbols, counts)
        yield from sent(pressed(counts, 0))

    def tally_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, counts = left_out.value[1], np.zeros(TALLY, np.uint32)
        for symbols in letters(batches):
            states.tally(*symbols, counts)
        yield from sent(pressed(counts, SPELLER))

    def gathered(of_words, of_letters) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        schema = "block long, part int, counts binary"
        got = summed(tokens.select("held", "n", "codes", "hashes").mapInArrow(of_words, schema).unionByName(spelled.mapInArrow(of_letters, schema))).toArrow()
        pairs = list(zip(got["block"].to_pylist(), got["counts"].to_pylist(), strict=True))
        return [p for p in pairs if p[0] < SPELLER], [p for p in pairs if p[0] >= SPELLER]

    word_counts, letter_counts = gathered(count_words, count_letters)
    words_, speller = Predictors(slots, word_counts, 0), Predictors(SPELL_SLOTS, letter_counts, SPELLER)
    left_out = spark.sparkContext.broadcast((States(slots, word_counts, 0, whole=True), States(SPELL_SLOTS, letter_counts, SPELLER, whole=False)))
    del word_counts, letter_counts
    word_tally, letter_tally = gathered(tally_words, tally_letters)
    left_out.destroy()
    shared.destroy()
    word_weights, spell_weights = weights_from(first_weights(), word_tally, 0), weights_from(spelling_weights(), letter_tally, SPELLER)
    model = Model(codes, words_, speller, int(total), int(vocabulary), word_weights, spell_weights)
    return model, counts.where((step < least) | (F.col("c") <= 1)).select("token", "c")


def sent(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() % FAN
    for block, data in blocks:
        yield pa.RecordBatch.from_pydict({"block": [block], "part": [part], "counts": [data]}, BLOCKS)


def lm_score(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).

    Trains on rows whose crc32 of the id as text is not 1 modulo 5 and scores
    every row. score is the model's log10 probability of the text's tokens, and
    bits_per_byte the same in bits over the UTF-8 bytes (null for empty texts).
    base_score is that of a smoothed unigram model. Null text counts as empty
    (the end token alone); a null id as the empty text, so it trains. Repeated
    rows train and are scored as often as they come. A text of any length is
    scored whole. With no training rows all counts are 0. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(row_id)).alias("held_out"))
    tokens = cut(tokenised(rows), "tokens")
    model, rare_counts = train(tokens)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        unit = model.train_tokens + 0.5 * (model.vocabulary + 1)
        for group, n, code, h in read_tokens(batches, training=False):
            distinct = names_of(group)
            row = model.codes.find(h)
            known = row != model.codes.escape
            spelled = np.zeros(len(distinct))
            spelled[~known] = model.spell([distinct[i] for i in np.flatnonzero(~known)])
            owner = np.repeat(np.arange(len(n)), n)
            bits = model.score(h[code], row[code], n) + np.bincount(owner, spelled[code], len(n))
            base = np.where(known, np.log10((model.codes.counts[row] + 0.5) / unit), 0.0)
            there = known[code]
            rare = np.bincount(owner, ~there, len(n)).astype(np.int64)
            # Each text's distinct rare tokens and how often it has them.
            pairs, times = np.unique(owner[~there] * len(distinct) + code[~there], return_counts=True)
            whose, token = np.divmod(pairs, len(distinct))
            entries = pa.StructArray.from_arrays([pa.array(distinct, pa.string()).take(pa.array(token)), pa.array(times.astype(np.int64))], names=["token", "times"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(n) + 1)).astype(np.int32)), entries)
            yield pa.RecordBatch.from_arrays(
                [group.column("ids").flatten(), group.column("held").flatten(), pa.array(n), pa.array(n - rare), pa.array(np.bincount(owner, base[code], len(n))), pa.array(bits), group.column("sizes").flatten(), lists],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "bits", "n_bytes", "rare"],
            )

    scored = tokens.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, n_bytes long, rare array<struct<token:string,times:long>>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    unit = model.train_tokens + 0.5 * (model.vocabulary + 1)
    singly = scored.select("row", F.inline("rare"))
    c = F.coalesce("c", F.lit(0))
    rest = singly.join(rare_counts, "token", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10((c + 0.5) / F.lit(unit))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    out = scored.drop("rare").join(rest, "row", "left")
    log10_2 = float(np.log10(2))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("bits") * log10_2).alias("score"), "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )

