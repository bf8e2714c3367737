"""Edit-aware token counts: a segment tree per document whose leaves are runs of pre-tokens.

Leaves are cut where a non-space character is followed by white space: no pre-token of the vocabulary's pattern crosses
such a place and nothing before it changes how the rest is split, so a text's count is the sum over its leaves. An edit
re-encodes the leaves that it touches, widened to the next leaf on a side where its border is no longer such a place,
and updates the sums on the way to the root.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as the vocabulary's pattern understands it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+\\Z")
_IS_SPACE = re.compile(f"[{_WS}]").match
#: Pieces (white space and the run after it) in a leaf, and pieces whose count a worker remembers (a cache only).
LEAF, CACHE = 32, 200_000


class PieceCounter:
    """Number of tokens of a text by the tiktoken library, piece by piece."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("vecloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}
        self.cache = cache

    def __call__(self, pieces: list[str]) -> int:
        total, known = 0, self.known
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(known) >= self.cache:
                    known.clear()
                known[p] = n
            total += n
        return total


_COUNTERS: dict[str, PieceCounter] = {}


def counter(name: str = "byte_bpe_50k.tiktoken") -> PieceCounter:
    if name not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[name] = PieceCounter(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return _COUNTERS[name]


class CountTree:
    """The segment tree of one text. Node n has children 2n and 2n + 1; node 1 is the root; sums of code points and tokens."""

    def __init__(self, text: str, count: Callable[[list[str]], int], leaf: int = LEAF, state: tuple[list[int], list[int]] | None = None):
        self.count, self.leaf, self.encoded = count, leaf, 0
        if state is None:
            self._build([(t, count(p)) for t, p in self._cut(text)])
        else:
            self.chars, self.tokens = map(list, state)
            self.width = len(self.chars) // 2
            at, self.leaves = 0, []
            for n in self.chars[self.width :]:
                self.leaves.append(text[at : at + n])
                at += n

    def _cut(self, text: str) -> list[tuple[str, list[str]]]:
        pieces = _PIECE.findall(text)
        return [("".join(p := pieces[a : a + self.leaf]), p) for a in range(0, len(pieces), self.leaf)]

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1 << max(0, (len(leaves) - 1).bit_length()) if leaves else 1
        self.leaves = [t for t, _ in leaves] + [""] * (self.width - len(leaves))
        self.chars = [0] * self.width + [len(t) for t in self.leaves]
        self.tokens = [0] * self.width + [n for _, n in leaves] + [0] * (self.width - len(leaves))
        for n in range(self.width - 1, 0, -1):
            self._sum(n)

    def _sum(self, n: int) -> None:
        self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a code point; the end belongs to the last leaf that isn't empty."""
        n = 1
        while n < self.width:
            n *= 2
            if at >= self.chars[n] and self.chars[n + 1]:
                at -= self.chars[n]
                n += 1
        return n - self.width, at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces code points start to end by `new`; places outside the text mean its ends."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if start == end and not new:
            return
        i, a = self._find(start)
        j, b = self._find(end)
        middle = "".join(self.leaves[i : j + 1])
        tail = sum(map(len, self.leaves[i:j])) + b
        middle = middle[:a] + new + middle[tail:]
        while (p := self._step(i, -1)) is not None and not (middle and _IS_SPACE(middle[0]) and not _IS_SPACE(self.leaves[p][-1])):
            middle, i = self.leaves[p] + middle, p
        while (q := self._step(j, 1)) is not None and not (middle and not _IS_SPACE(middle[-1])):
            middle, j = middle + self.leaves[q], q
        parts, slots = self._cut(middle), j - i + 1
        self.encoded += len(parts)
        if len(parts) > slots + 3:  # too many for their places: the tree is laid out anew, without encoding the rest again
            known = [(t, n) for t, n in zip(self.leaves, self.tokens[self.width :])]
            self._build([x for x in [*known[:i], *((t, self.count(p)) for t, p in parts), *known[j + 1 :]] if x[0]])
            return
        parts += [("", [])] * (slots - len(parts))
        placed = parts[: slots - 1] + [("".join(t for t, _ in parts[slots - 1 :]), [x for _, p in parts[slots - 1 :] for x in p])]
        touched = set()
        for k, (t, p) in enumerate(placed, i):
            self.leaves[k] = t
            self.chars[self.width + k], self.tokens[self.width + k] = len(t), self.count(p)
            touched.add((self.width + k) // 2)
        while touched - {0}:
            for n in touched:
                self._sum(n)
            touched = {n // 2 for n in touched if n > 1}

    def _step(self, k: int, by: int) -> int | None:
        """The next leaf that isn't empty."""
        k += by
        while 0 <= k < self.width:
            if self.leaves[k]:
                return k
            k += by
        return None


_STATE = "text string, n_tokens long, node_chars array<long>, node_tokens array<long>"
_EDIT = "array<struct<start:long,end:long,text:string>>"


def build_trees(docs: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", leaf: int = LEAF) -> DataFrame:
    """The trees of all rows of docs: doc_id, text, n_tokens, node_chars, node_tokens (heap order, node 0 unused).

    Null text is empty and has no tokens. Rows are independent: repeated rows and null ids give one tree each; an empty
    table gives none. Extra columns aren't kept.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                trees = [CountTree(t.as_py() or "", count, leaf) for t in part.column(1)]
                row = [part.column(0), pa.array([t.text for t in trees]), pa.array([t.total for t in trees]), pa.array([t.chars for t in trees], pa.list_(pa.int64())), pa.array([t.tokens for t in trees], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=["doc_id", "text", "n_tokens", "node_chars", "node_tokens"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, {_STATE}")


def apply_edits(trees: DataFrame, edits: str = "edits", tokenizer: str = "byte_bpe_50k.tiktoken", leaf: int = LEAF) -> DataFrame:
    """The trees after the edits in the array column `edits` (struct start, end, text; code points of the text as the
    edits before have left it), applied in order: the same columns, and n_edits, n_leaves, n_encoded (leaves encoded
    again), n_before (tokens before the edits).

    Null or empty arrays change nothing; null starts, ends and texts mean 0, start and "". Null structs are passed over.
    """
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches):
        count = counter(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = []
                for text, chars, tokens, todo in zip(*(part.column(k).to_pylist() for k in range(1, 5))):
                    tree, done = CountTree(text, count, leaf, (chars, tokens)), 0
                    before = tree.total
                    for e in todo or ():
                        if e is not None:
                            start = e["start"] or 0
                            tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                            done += 1
                    out.append((tree.text, tree.total, tree.chars, tree.tokens, done, sum(map(bool, tree.leaves)), tree.encoded, before))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["text", "n_tokens", "node_chars", "node_tokens", "n_edits", "n_leaves", "n_encoded", "n_before"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", *names])

    return trees.select("doc_id", "text", "node_chars", "node_tokens", F.col(edits).cast(_EDIT).alias("_e")).mapInArrow(run, f"doc_id {kind}, {_STATE}, n_edits long, n_leaves long, n_encoded long, n_before long")
