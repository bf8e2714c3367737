"""Language-model scores by online logistic context mixing over hashed-context bit predictors.

A document is a series of tokens, each written as binary decisions: a word of the dictionary (the most frequent training
words) by its Huffman code; any other word by the code of an escape and then its bytes, each by a Huffman code of bytes.
Every decision has three predictors: its node's own odds in training (order 0), and counts in two tables whose slots are
hashes of the node with the last very frequent word before it, which tells the kind of text, and with the two preceding
words (of bytes: with two and with four preceding bytes of the word).
The tables are counted over all training documents; their size is fixed. Predictions are mixed in the logistic domain by
weights chosen by a gate, the confidence of the two hashed predictors. Weights start from those that fit all training data
best, and are refined by gradient steps as each document is read, block by block. The sum of the decisions' costs is the
text's total in bits.

Counts that a document is part of would seem better than they are for others, so training data is dealt to two folds, each
counted apart. A fold's decisions are predicted by the other fold's counts and tallied by what the predictors say; weights
are fitted to the tally, whose size is fixed. Texts are scored by the sum of both folds' counts.

How a word is spelt depends on the word alone, so that cost is worked out once a distinct word, on the table of word
counts, and reaches documents by the join that also brings counts of words outside the dictionary. After an escape a word
is given by its exact training count or by its bytes: the two probabilities are added. The bytes' share is that of words
never seen before, by Good and Turing as many as the words seen once; those seen once get what words seen twice tell of
them. So all training counts enter the score, whatever the dictionary's size. Within a document an escaped word is spelt
once; when it comes again it is drawn in proportion to how often it has come. How likely a new word is then isn't known
beforehand, so the probabilities under NOVELTY are averaged. What such draws cost doesn't depend on their order.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, released, stored, text_bytes

#: Words of the dictionary at most; bits of slot numbers in the tables of words and of bytes; slots in a row of a partial table.
VOCABULARY, TABLE_BITS, BYTE_BITS, CHUNK = 1 << 17, 22, 20, 1 << 16
#: Tokens read between two refinements of the weights, and the step size.
BLOCK, RATE = 32, 0.004
#: Words of the dictionary, from the most frequent on, that serve as contexts of what follows them.
FREQUENT = 128
#: Weights of a new word against one that a document had before, after an escape.
NOVELTY = (2.0, 8.0, 32.0, 128.0, 512.0, 1e6)
#: Partial tables that one task adds up.
FAN_IN = 64
_INPUTS, _CONF, _LIMIT = 3, 7, 8.0
_GATES = _CONF * _CONF
_CODE_BITS = 13
_END_OF_WORD = 256


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Huffman:
    """A Huffman code as decisions: symbol s takes decisions first[s] : first[s + 1] of `node` and `bit`, in any order."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        heap = [(float(w), k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, side, mass = np.full(max(1, 2 * n - 1), -1), np.zeros(max(1, 2 * n - 1), np.uint8), np.zeros(max(1, 2 * n - 1))
        mass[:n] = weights
        new = n
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = new
            side[b] = 1
            mass[new] = wa + wb
            heapq.heappush(heap, (wa + wb, new))
            new += 1
        self.nodes = max(1, n - 1)
        who, node, bit = [], [], []
        at = np.arange(n)
        symbol = np.arange(n)
        while True:
            up = parent[at]
            keep = up >= 0
            if not keep.any():
                break
            symbol = symbol[keep]
            who.append(symbol)
            node.append(up[keep] - n)
            bit.append(side[at[keep]])
            at = up[keep]
        if who:
            order = np.argsort(np.concatenate(who), kind="stable")
            self.node = np.concatenate(node)[order].astype(np.int32)
            self.bit = np.concatenate(bit)[order]
            counts = np.bincount(np.concatenate(who), minlength=n)
        else:
            self.node, self.bit, counts = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(n, np.int64)
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        self.length = counts.astype(np.int32)
        ones = np.zeros(self.nodes)
        kids = np.flatnonzero((parent >= 0) & (side == 1))
        ones[parent[kids] - n] = mass[kids]
        whole = np.maximum(mass[n : n + self.nodes], 1e-9) if n > 1 else np.ones(1)
        p = np.clip(ones / whole, 1e-6, 1 - 1e-6)
        # at each decision: what its node adds to hashes, the node's own odds (turned so that large is right), these as a step
        # of a tally with the bit, and the bit above slot codes
        self.hashed = self.node.astype(np.uint32) * np.uint32(0x94D049BB)
        odds = np.clip(np.log(p / (1 - p)), -12, 12).astype(np.float32)[self.node]
        self.odds = np.where(self.bit > 0, odds, -odds)
        self.step = (np.rint(odds * 2).astype(np.int32) + 24) * 2 + self.bit
        self.above = self.bit.astype(np.uint16) << np.uint16(_CODE_BITS)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the symbol, decision) for all decisions of a series of symbols, and where each symbol's begin and end."""
        n = self.length.take(symbols)
        edge = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=edge[1:])
        who = np.repeat(np.arange(len(symbols), dtype=np.intp), n)
        start = self.first.take(symbols)
        start -= edge[:-1]
        at = np.arange(len(who), dtype=np.intp)
        at += start.take(who)
        return who, at, edge


class Known(dict):
    """Symbols of dictionary words; words that aren't there get the escape and are noted."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.escape, self.others = len(words), []

    def __missing__(self, word: bytes) -> int:
        self.others.append(word)
        return self.escape

    def __reduce__(self):
        return Known, (list(self),)


class Codes:
    """Dictionary and codes. Symbols of words: dictionary words in order, then escape, then end."""

    def __init__(self, words: list[bytes], counts: np.ndarray, unknown: float, documents: float):
        self.known = Known(words)
        self.counts = counts
        self.escape, self.end = len(words), len(words) + 1
        self.words = Huffman(np.concatenate((counts, [max(unknown, 0.5), max(documents, 0.5)])))


def _mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Hash of pairs of 32-bit numbers."""
    h = (a ^ (np.asarray(b, np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return h * np.uint32(0xC2B2AE35)


def _slots(context: np.ndarray, who: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = context.take(who)
    h += node
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - bits)
    return h


class Decisions:
    """A series of decisions, sorted by step: their places in the code, slots, first gate of their lane (text); and where each
    symbol and each step begins."""

    def __init__(self, code: Huffman, symbols, c1, c2, lane, step, steps: int, bits: int, lanes: int):
        self.code = code
        who, self.at, edge = code.decisions(symbols)
        node = code.hashed.take(self.at)
        self.first = edge[:-1]
        self.slots = _slots(c1, who, node, bits), _slots(c2, who, node, bits)
        self.lane, self.steps, self.lanes = None if lane is None else (lane * _GATES).take(who), steps, lanes
        if step is None:
            self.edge = [0, len(self.at)]
        else:
            first = np.searchsorted(step, np.arange(steps + 1))
            self.edge = edge[first].tolist()

    def by_symbol(self, costs: np.ndarray) -> np.ndarray:
        """Costs of the decisions, summed up by symbol."""
        return np.add.reduceat(costs, self.first)

    def count(self, tables: list[np.ndarray]) -> None:
        bit = self.code.bit.take(self.at)
        for t, slot in zip(tables, self.slots):
            place = slot.astype(np.intp)
            place <<= 1
            place |= bit
            np.add.at(t, place, np.int32(1))

    def tally(self, cells: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> None:
        """Adds each decision to its cell: classes of both slots, step of the odds, bit."""
        pair = classes[0].take(self.slots[0]).astype(np.uint16)
        pair *= np.uint16(CLASSES)
        pair += classes[1].take(self.slots[1])
        cell = pair.astype(np.intp)
        cell *= _STEPS
        cell += self.code.step.take(self.at)
        np.add.at(cells, cell, 1)


def to_symbols(text: bytes, codes: Codes) -> tuple[list[int], Counter]:
    """The text's symbols, end included, and how often each word outside the dictionary occurs."""
    codes.known.others = others = []
    found = list(map(codes.known.__getitem__, text.translate(LOWER).split()))
    found.append(codes.end)
    return found, Counter(others)


def repeats(counts: list[int]) -> float:
    """Bits that tell which escaped words of a text are new and which are which of those before, from their counts."""
    if not counts:
        return 0.0
    total, same = sum(counts), sum(map(math.lgamma, counts))
    costs = [math.lgamma(x + total) - math.lgamma(x) - len(counts) * math.log(x) - same for x in NOVELTY]
    least = min(costs)
    return (least - math.log(sum(math.exp(least - c) for c in costs) / len(costs))) / math.log(2)


class Texts:
    """Texts, given as arrays of symbols, as word decisions; without `ordered` their steps are left out."""

    def __init__(self, texts: list[np.ndarray], codes: Codes, bits: int, block: int = BLOCK, ordered: bool = True):
        symbols = np.concatenate(texts)
        n = np.array([len(t) for t in texts], np.int64)
        self.symbols, self.lengths = symbols, n
        starts = np.cumsum(n) - n
        name = symbols.astype(np.uint32)
        before = np.uint32(codes.end)  # texts begin as if one had ended
        one, two = np.empty(len(name), np.uint32), np.empty(len(name), np.uint32)
        one[1:], two[2:] = name[:-1], name[:-2]
        two[starts] = before
        two[np.minimum(starts + 1, len(name) - 1)] = before
        one[starts] = before
        self.lane = lane = np.repeat(np.arange(len(texts), dtype=np.intp), n)
        # the last frequent word before each place, none if it is another text's
        at = np.maximum.accumulate(np.where(symbols < min(FREQUENT, codes.escape), np.arange(len(name), dtype=np.int32), np.int32(-1)))
        last = np.concatenate((np.full(1, -1, np.int32), at[:-1]))
        kind = np.where(last >= starts.astype(np.int32).take(lane), name.take(np.maximum(last, 0)), before)
        steps, step, by = 1, None, None
        if ordered:
            step = (np.arange(len(name), dtype=np.int32) - starts.astype(np.int32).take(lane)) // np.int32(block)
            steps = int(n.max() - 1) // block + 1
            if steps > 1:
                order = np.argsort(step.astype(np.int16) if steps < 1 << 15 else step, kind="stable")
                one, two, kind, step, lane, symbols = (x.take(order) for x in (one, two, kind, step, lane, symbols))
            by = lane
        self.order = lane
        self.decisions = Decisions(codes.words, symbols, _mix(kind, 77), _mix(_mix(one, 1), two), by, step, steps, bits, len(texts))


def spelling(words: pa.Array, code: Huffman, bits: int) -> tuple[Decisions, np.ndarray]:
    """Decisions of spelt words, and the word of each symbol."""
    words = words.cast(pa.large_binary())
    edge = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    n = np.diff(edge) + 1
    last = np.cumsum(n) - 1
    b = np.full(last[-1] + 1, _END_OF_WORD, np.uint32)
    inner = np.ones(len(b), bool)
    inner[last] = False
    b[inner] = np.frombuffer(words.buffers()[2], np.uint8)[edge[0] : edge[-1]]
    owner = np.repeat(np.arange(len(words), dtype=np.intp), n)
    first, past = last - n + 1, [b]
    for _ in range(4):  # the symbol before each, and the three before that one
        p = np.empty_like(b)
        p[1:] = past[-1][:-1]
        p[first] = 300
        past.append(p)
    del past[0]
    c1 = _mix(past[0] * np.uint32(512) + past[1], 11)
    c2 = _mix(c1, past[2] * np.uint32(512) + past[3])
    d = Decisions(code, b, c1, c2, None, None, 1, bits, 1)
    return d, owner


def _quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """A slot's code: 9 bits of its log odds, and above them how often it was seen, as 0 to 6."""
    n = zeros + ones
    z = np.log((ones + 0.4) / (zeros + 0.4))
    q = np.clip(np.rint((z + _LIMIT) * (511 / (2 * _LIMIT))), 0, 511).astype(np.uint16)
    conf = np.searchsorted(np.array([1, 2, 3, 5, 9, 33]), n, "right").astype(np.uint16)
    return (conf << np.uint16(9)) | q


#: Log odds by slot code; the same turned so that large is right, by slot code and the bit above it.
_ODDS = np.tile(((np.arange(512) * (2 * _LIMIT / 511)) - _LIMIT).astype(np.float32), 1 << 4)
_TURNED = np.concatenate((-_ODDS, _ODDS))


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of slot codes for tallies: class by code, and each class's log odds and confidence. Slots seen up to four
    times have a class for each pair of counts, others one for a half of log odds and their confidence."""
    pairs = np.array([(z, n - z) for n in range(5) for z in range(n + 1)])
    rare = _quantised(pairs[:, 0], pairs[:, 1])
    by_code = np.zeros(1 << 13, np.uint8)
    by_code[rare] = np.arange(len(rare))
    often = np.arange(4 << 9, _CONF << 9)
    by_code[often] = len(rare) + (often - (4 << 9)) // 16
    odds = np.concatenate((_ODDS[rare], _ODDS[often].reshape(-1, 16).mean(axis=1)))
    return by_code, odds.astype(np.float64), np.concatenate((rare >> 9, often[::16] >> 9)).astype(np.intp)


_CLASS, _CLASS_ODDS, _CLASS_CONF = _classes()
#: Classes of slot codes; steps of the nodes' own odds, for each bit.
CLASSES, _STEPS = len(_CLASS_ODDS), 49 * 2


def first_weights() -> np.ndarray:
    """Weights (gate, input) before anything is learnt: trust grows with confidence."""
    w = np.zeros((_CONF, _CONF, _INPUTS), np.float32)
    for c1 in range(_CONF):
        for c2 in range(_CONF):
            w[c1, c2] = (0.9 - 0.08 * c1 - 0.08 * c2, 0.1 * c1, 0.1 * c2)
    return w.reshape(_GATES, _INPUTS)


def mixed(d: Decisions, tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Cost in bits of each decision, and the final weights (text, gate, input). Each text has weights of its own, which
    start alike and take a gradient step after each block; rate 0 keeps them."""
    # a dtype that was sent to a worker isn't numpy's own object, without which add.at is several times slower
    w = [np.tile(weights[:, i], d.lanes).astype(np.float32) for i in range(_INPUTS)]
    q = [t.take(slot) for t, slot in zip(tables, d.slots)]
    pair = (q[0] >> np.uint16(9)) * np.uint16(_CONF)
    pair += q[1] >> np.uint16(9)
    gate = pair.astype(np.intp) if d.lane is None else pair + d.lane
    above = d.code.above.take(d.at)
    for x in q:
        x |= above
    z = [d.code.odds.take(d.at), _TURNED.take(q[0]), _TURNED.take(q[1])]  # inputs are turned so that a large sum is right
    wrong = np.empty(len(d.at), np.float32)  # probability that what happened would not
    for a, b in zip(d.edge, d.edge[1:]) if rate else ((0, len(d.at)),):
        g, y = gate[a:b], [x[a:b] for x in z]
        t = w[0].take(g)
        t *= y[0]
        t += w[1].take(g) * y[1]
        t += w[2].take(g) * y[2]
        np.minimum(t, 14, out=t)
        np.maximum(t, -14, out=t)
        np.exp(t, out=t)
        t += 1
        e = np.divide(1, t, out=wrong[a:b])
        if rate:
            e = e * np.float32(rate)
            for i in range(_INPUTS):
                np.add.at(w[i], g, e * y[i])
    # costs are as exact as probabilities are; in double precision the logarithm alone took longer than all else here
    return np.log1p(-wrong) * np.float32(-1 / math.log(2)), np.stack([v.reshape(d.lanes, _GATES) for v in w], axis=2)


def _groups(batches, most: int = 1 << 18, rows: int = 96):
    """Slices of record batches: at most `most` bytes in their last column (or one row) and `rows` rows."""
    for b in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(b.num_columns - 1)), np.int64))
        at = 0
        while at < b.num_rows:
            upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))))
            yield b.slice(at, upto - at)
            at = upto


def count_words(d: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(word binary, n long): all words of d (held_out, _x), lower-cased, with their counts in rows that aren't held out.

    Counts are summed in each task before the shuffle; a task holds at most about `most` words at a time.
    """
    def run(batches):
        seen: Counter = Counter()
        other: set = set()

        def rows():
            seen.update({w: 0 for w in other if w not in seen})
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            other.clear()
            return out

        for b in batches:
            for held, t in zip(b.column(0).to_pylist(), b.column(1)):
                (other if held else seen).update(t.as_py().translate(LOWER).split())
                if len(seen) + len(other) > most:
                    yield rows()
        yield rows()

    return d.select("held_out", "_x").mapInArrow(released(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(a: np.ndarray) -> bytes:
    """Counts as bytes, by the least width that holds them."""
    top = int(a.max()) if len(a) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _tasks(rows: DataFrame) -> int:
    """Tasks for counting rows: each has tables of its own, so there are fewer than partitions."""
    found = rows.rdd.getNumPartitions()
    return max(1, min(found, max(2 * rows.sparkSession.sparkContext.defaultParallelism, found // 16)))


#: A chunk of what one task has counted.
_PARTIAL = "chunk long, fold int, part long, counts binary"


def _partial(chunk: int, fold: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([fold], pa.int32()), pa.array([part]), pa.array([_pack(counts)], pa.binary())], names=["chunk", "fold", "part", "counts"])


def _total(table: pa.Table, fold: int, size: int) -> np.ndarray:
    found = np.zeros(size, np.int64)
    for f, c in zip(table.column("fold").to_pylist(), table.column("counts")):
        if f == fold:
            row = _unpack(c.as_py())
            found[: len(row)] += row
    return found


def _added(parts: DataFrame, tasks: int, most: int, size: int) -> DataFrame:
    """Partial chunks of at most `size` counts, of at most `tasks` tasks a fold, added up until there are `most` a fold or fewer."""
    def add(table: pa.Table) -> pa.Table:
        chunk, fold, part = (table.column(c)[0].as_py() for c in ("chunk", "fold", "part"))
        return pa.Table.from_batches([_partial(chunk, fold, part, _total(table, fold, size))])

    while tasks > most:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.col("part") % tasks).groupBy("chunk", "fold", "part").applyInArrow(add, _PARTIAL)
    return parts


def counted_tables(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Decisions]], bits: int) -> tuple[tuple, list[tuple]]:
    """Two tables of slot codes, counted over the decisions that `read` makes of all rows (a column of data, fold 0 or 1), and
    for each fold the classes of its own counts in both tables.

    Each task counts one fold into tables of its own and sends them in chunks; chunks are added up FAN_IN at a time, until
    one is left of each. What reaches the driver, 2 * 2^bits slots of 4 bytes, doesn't depend on the corpus.
    """
    tasks = -(-_tasks(rows) // 2)
    size = 1 << bits
    chunk = min(CHUNK, size)

    def counter(fold: int):
        def run(batches):
            tables = [np.zeros(2 * size, np.int32) for _ in range(2)]
            for b in batches:
                for d in read(b):
                    d.count(tables)
            part = TaskContext.get().partitionId()
            for k, t in enumerate(tables):
                for at in range(0, size, chunk):
                    row = t[2 * at : 2 * (at + chunk)]
                    if row.any():
                        yield _partial(k * size + at, fold, part, row)

        return run

    def finish(table: pa.Table) -> pa.Table:
        folds = [_total(table, f, 2 * chunk) for f in (0, 1)]
        codes = [_quantised(x[::2], x[1::2]) for x in (sum(folds), *folds)]
        out = codes[0].tobytes() + b"".join(_CLASS.take(c).tobytes() for c in codes[1:])
        return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([out], pa.binary())})

    data = [c for c in rows.columns if c != "fold"]
    parts = [rows.where(F.col("fold") == f).select(*data).coalesce(tasks).mapInArrow(counter(f), _PARTIAL) for f in (0, 1)]
    parts = parts[0].unionByName(parts[1])
    parts = _added(parts, tasks, FAN_IN // 2, 2 * chunk)
    none = _quantised(np.zeros(1), np.zeros(1))[0]
    tables = np.full(2 * size, none, np.uint16)
    classes = np.full((2, 2 * size), _CLASS[none], np.uint8)
    for r in parts.groupBy("chunk").applyInArrow(finish, "chunk long, counts binary").collect():
        tables[r.chunk : r.chunk + chunk] = np.frombuffer(r.counts, np.uint16, chunk)
        classes[:, r.chunk : r.chunk + chunk] = np.frombuffer(r.counts, np.uint8, offset=2 * chunk).reshape(2, chunk)
    return (tables[:size], tables[size:]), [(c[:size], c[size:]) for c in classes]


def fitted_weights(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (gate, input) of least cost for tallied decisions, n in each cell, by Newton's method. The first weights count
    as much as a few decisions, so gates that have none keep them."""
    first, step = divmod(cells, _STEPS)
    first, second = divmod(first, CLASSES)
    gate = _CLASS_CONF[first] * _CONF + _CLASS_CONF[second]
    sign = (step % 2) * 2.0 - 1  # inputs are turned so that a large sum is right
    x = np.stack(((step // 2 - 24) / 2, _CLASS_ODDS[first], _CLASS_ODDS[second])) * sign
    start = first_weights().astype(np.float64)
    w, best, least = start.copy(), start.copy(), np.full(_GATES, np.inf)
    for _ in range(12):
        t = np.einsum("ic,ci->c", x, w[gate])
        cost = np.bincount(gate, n * np.logaddexp(0, -t), _GATES) + ((w - start) ** 2).sum(axis=1) / 2
        better = cost <= least
        move = least - cost
        best[better], least[better] = w[better], cost[better]
        if (np.abs(move) <= 1e-9 * cost + 1e-12).all():
            break
        wrong = 1 / (1 + np.exp(np.clip(t, -500, 500)))
        slope = np.stack([np.bincount(gate, n * wrong * v, _GATES) for v in x], axis=1) - (w - start)
        curve = np.tile(np.eye(_INPUTS), (_GATES, 1, 1))
        for i in range(_INPUTS):
            for j in range(i + 1):
                c = np.bincount(gate, n * wrong * (1 - wrong) * x[i] * x[j], _GATES)
                curve[:, i, j] += c
                curve[:, j, i] += c if i != j else 0
        ahead = w + np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        w = np.where(better[:, None], ahead, (w + best) / 2)  # a step that cost more is halved
    return best.astype(np.float32)


def learnt_weights(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[Decisions]], classes: list[tuple]) -> np.ndarray:
    """Weights that fit the decisions of all rows (a column of data, fold) best, each predicted by the other fold's counts.

    Tasks tally their decisions; tallies have a fixed number of cells and are added up like the tables.
    """
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        cells = np.zeros(CLASSES * CLASSES * _STEPS, np.int64)
        for b in batches:
            for fold in (0, 1):
                for d in read(b.filter(pc.equal(b.column("fold"), fold))):
                    d.tally(cells, shared.value[1 - fold])
        part = TaskContext.get().partitionId()
        for at in range(0, len(cells), CHUNK):
            if cells[at : at + CHUNK].any():
                yield _partial(at, 0, part, cells[at : at + CHUNK])

    tasks = _tasks(rows)
    parts = _added(rows.coalesce(tasks).mapInArrow(run, _PARTIAL), tasks, 1, CHUNK)
    cells = np.zeros(CLASSES * CLASSES * _STEPS, np.int64)
    for r in parts.select("chunk", "counts").collect():
        row = _unpack(r.counts)[: len(cells) - r.chunk]
        cells[r.chunk : r.chunk + len(row)] += row
    shared.unpersist()
    found = np.flatnonzero(cells)
    return fitted_weights(found, cells[found].astype(np.float64))


def _fold(seed: int, column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(2)).cast("int").alias("fold")


def _spelt(rest: DataFrame, byte_bits: int) -> DataFrame:
    """rest (word, n) with `spelt`, the bits that spelling the word takes. Learns from words with n > 0, each once."""
    spark = rest.sparkSession
    learn = rest.where("n > 0").select("word", _fold(5, "word"))

    def histogram(batches):
        seen = np.zeros(257, np.int64)
        for b in batches:
            seen[:256] += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8), minlength=256)
            seen[256] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(seen)], names=["b", "n"])

    weights = np.full(257, 0.05)
    for r in learn.mapInArrow(histogram, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # 257 rows
        weights[r.b] += r.n
    code = spark.sparkContext.broadcast(Huffman(weights))

    def read(b):
        for at in range(0, b.num_rows, 2048):
            yield spelling(b.column(0).slice(at, 2048), code.value, byte_bits)[0]

    codes, classes = counted_tables(learn, read, byte_bits)
    tables = spark.sparkContext.broadcast(codes)
    start = learnt_weights(learn, read, classes)

    def spell(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                d, owner = spelling(part.column(0), code.value, byte_bits)
                cost = np.bincount(owner, d.by_symbol(mixed(d, tables.value, start, 0)[0]), minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cost)], names=["word", "n", "spelt"])

    return rest.select("word", "n").mapInArrow(spell, "word binary, n long, spelt double")


def escaped_bits(n: Column, spelt: Column, once: float, twice: float, more: float) -> Column:
    """Bits of a word after an escape: n is its training count, `spelt` what its bytes take; once and twice are the training
    words seen once and twice, `more` the tokens of words outside the dictionary that were seen twice or more."""
    new, again = once + 1, 2 * twice + 1  # tokens to be expected of words never seen, and of those seen once
    total = float(np.log2(new + again + more))
    by_bytes = spelt + F.lit(total - float(np.log2(new)))
    by_count = F.lit(total) - F.when(n == 1, F.lit(float(np.log2(again / max(once, 1.0))))).otherwise(F.log2(n.cast("double")))
    both = F.least(by_bytes, by_count) - F.log2(F.lit(1.0) + F.pow(F.lit(2.0), -F.abs(by_bytes - by_count)))
    return F.when(n > 0, both).otherwise(by_bytes)


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, table_bits: int = TABLE_BITS, byte_bits: int = BYTE_BITS) -> DataFrame:
    """Scores every row of docs by a model learnt from its training rows (those not held out, see is_held_out).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10 probability by add-one word counts),
    score (log10 probability by the mixed model), total_bits, bits_per_byte.

    Null text is empty: its one token is the end. Null ids are training rows. Repeated rows count as often as they
    occur. Without training rows all words are unknown and the model falls back on even odds. An empty table gives no
    rows. Extra columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), text_bytes().alias("_x"))
    counts = stored(count_words(d), "words")
    documents = docs.where(~is_held_out(F.col("doc_id"))).count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    # words seen once stay outside, so that escapes are learnt
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(vocabulary).toArrow()  # of fixed size
    words, top_n = top.column("word").to_pylist(), np.asarray(top.column("n")).astype(np.float64)
    rest = counts
    if words:  # the last word's count and the word itself part the dictionary from the rest
        least, last = int(top_n[-1]), F.lit(bytearray(words[-1]))
        rest = counts.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))
    n, v = total.n + documents, total.v + (documents > 0)
    codes = spark.sparkContext.broadcast(Codes(words, top_n, float(total.n - top_n.sum()), float(documents)))
    escaped = escaped_bits(F.col("n"), F.col("spelt"), float(total.once), float(total.twice), float(total.n - top_n.sum() - total.once))
    rest = stored(_spelt(rest, byte_bits).withColumn("spelt", escaped), "spelt")

    def encode(batches):
        for b in _groups(batches, 1 << 20, 256):
            found = [to_symbols(t.as_py(), codes.value) for t in b.column(3)]
            ends = np.cumsum([0, *(len(r) for _, r in found)])
            rare = pa.StructArray.from_arrays([pa.array([w for _, r in found for w in r], pa.binary()), pa.array([k for _, r in found for k in r.values()], pa.int64())], names=["word", "k"])
            symbols = pa.array([array("i", s).tobytes() for s, _ in found], pa.binary())
            again = pa.array([repeats(list(r.values())) for _, r in found], pa.float64())
            out = [*b.columns[:3], pc.cast(pc.binary_length(b.column(3)), pa.int64()), again, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare), symbols]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "fold", "n_bytes", "again", "rare", "symbols"])

    coded = d.select("doc_id", "held_out", _fold(3, "doc_id"), "_x").mapInArrow(encode, f"doc_id {kind}, held_out boolean, fold int, n_bytes long, again double, rare array<struct<word:binary,k:long>>, symbols binary")
    coded = stored(coded.withColumn("_key", F.monotonically_increasing_id()), "coded")

    def read(b):
        for part in _groups([b.select(["symbols"])]):
            yield Texts([np.frombuffer(t, "<i4") for t in part.column(0).to_pylist()], codes.value, table_bits, ordered=False).decisions

    training = coded.where(~F.col("held_out")).select("symbols", "fold")
    found, classes = counted_tables(training, read, table_bits)
    tables = spark.sparkContext.broadcast(found)
    start = learnt_weights(training, read, classes)

    def score(batches):
        c = np.concatenate((codes.value.counts, [0, documents]))  # by symbol; words outside the dictionary are looked up later
        logs = np.log10(c + 1)
        # texts of like length are read together, so that few steps have only some of them
        for b in _groups(b.take(pc.sort_indices(pc.binary_length(b.column(b.num_columns - 1)))) for b in batches):
            t = Texts([np.frombuffer(x, "<i4") for x in b.column(b.num_columns - 1).to_pylist()], codes.value, table_bits)
            lanes = b.num_rows
            bits = np.bincount(t.order, t.decisions.by_symbol(mixed(t.decisions, tables.value, start)[0]), minlength=lanes)
            known = np.bincount(t.lane, (c > 0).take(t.symbols), minlength=lanes).astype(np.int64)
            bits += np.asarray(b.column(4))
            out = [*b.columns[:4], pa.array(t.lengths), pa.array(known), pa.array(np.bincount(t.lane, logs.take(t.symbols), minlength=lanes)), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(out, names=["_key", "doc_id", "held_out", "n_bytes", "n_tokens", "known", "logs", "bits"])

    done = coded.select("_key", "doc_id", "held_out", "n_bytes", "again", "symbols").mapInArrow(score, f"_key long, doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, known long, logs double, bits double")
    # words outside the dictionary: joined with their counts and spellings by word, summed by document
    rare = coded.select("_key", F.explode("rare").alias("_r")).select("_key", "_r.word", "_r.k").join(rest.hint("shuffle_hash"), "word")  # each word once: not sorted
    rare = rare.groupBy("_key").agg(F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("_k"), F.sum(F.col("k") * F.log10(F.col("n") + F.lit(1.0))).alias("_l"), F.sum("spelt").alias("_b"))
    out = done.join(rare, "_key", "left")
    base = F.col("logs") + F.coalesce("_l", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    bits = F.col("bits") + F.coalesce("_b", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (-bits * F.lit(float(np.log10(2)))).alias("score"),
        bits.alias("total_bits"),
        (bits / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
