"""Edit-aware token counting: a segment tree over each document's pre-tokens.

A document's state is its text, the length and token count of every pre-token, how many pre-tokens each leaf of its
tree holds, and the tree's sums of characters and tokens. An edit walks down these sums to the leaves that it
touches, and only these are read from the state. It re-splits and re-encodes from the first pre-token that its
first changed character can reach (two characters of context) to the first old boundary behind the edit that the new
split meets again; from there on both splits are equal, because the pattern looks at nothing before a match.
Sums are updated on the paths from the touched leaves to the root. What lies between touched leaves is copied as it
is when the state is written again, and rows without edits are handed on unread.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a new leaf; a leaf that grows to over twice as many has the tree rebuilt.
LEAF = 64
#: How numbers of pieces and sums are stored.
INT, SUM = np.dtype("<i4"), np.dtype("<i8")
#: Pre-tokens whose counts a worker keeps; emptied when full.
MEMORY = 300_000
#: Characters behind a pre-token's end that its match may have looked at.
CONTEXT = 2
STATE = "text string, piece_chars binary, piece_tokens binary, leaf_pieces binary, node_sums binary, n_tokens long"
STATE_NAMES = ["text", "piece_chars", "piece_tokens", "leaf_pieces", "node_sums", "n_tokens"]
EDIT = "array<struct<pos: long, deleted: long, inserted: string>>"

_workers: dict[tuple[str, str], PieceCounter] = {}


class PieceCounter:
    """Splits text into pre-tokens and counts the tokens of each, by a public byte-level vocabulary."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self._encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = regex.compile(pattern).findall
        self._known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self._split(text)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self._known
        for p in set(pieces).difference(known):
            if len(known) >= MEMORY:
                known.clear()
                return self.counts(pieces) if len(set(pieces)) < MEMORY // 2 else [len(self._encode(p)) for p in pieces]
            known[p] = len(self._encode(p))
        return [known[p] for p in pieces]


def counter(ranks_path: str, pattern: str) -> PieceCounter:
    if (ranks_path, pattern) not in _workers:
        _workers[ranks_path, pattern] = PieceCounter(ranks_path, pattern)
    return _workers[ranks_path, pattern]


class PieceTree:
    """Leaves under two heaps of sums: characters and tokens.

    An untouched leaf is its number in the state; a touched one is [text, piece lengths, piece tokens].
    """

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, leaf_pieces: np.ndarray | None = None, sums: np.ndarray | None = None) -> None:
        if leaf_pieces is None:
            leaf_pieces = [min(LEAF, len(chars) - at) for at in range(0, len(chars), LEAF)] or [0]
        self._text, self._pieces = text, (np.asarray(chars, dtype=INT), np.asarray(tokens, dtype=INT))
        self._sizes = np.asarray(leaf_pieces, dtype=INT)
        self._first = _running(self._sizes)  # piece at which each leaf of the state begins
        self.leaves: list[int | list] = list(range(len(self._sizes)))
        if sums is None:
            self._build([np.diff(_running(x)[self._first]) for x in self._pieces])
        else:
            self.chars, self.tokens = sums.reshape(2, -1).copy()
            self.width = len(self.chars) // 2
        self._begin = _running(self.chars[self.width : self.width + len(self.leaves)])  # and character

    def _build(self, leaf_sums: list[np.ndarray]) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = heaps = np.zeros((2, 2 * self.width), dtype=SUM)
        for heap, sums in zip(heaps, leaf_sums, strict=True):
            heap[self.width : self.width + len(sums)] = sums
            level = self.width
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
                level //= 2

    def _leaf(self, k: int) -> list:
        own = self.leaves[k]
        if isinstance(own, int):
            part = slice(self._first[own], self._first[own + 1])
            own = [self._text[self._begin[own] : self._begin[own + 1]], *[x[part].tolist() for x in self._pieces]]
            self.leaves[k] = own
        return own

    def stored(self) -> tuple[str, bytes, bytes, bytes, bytes, int]:
        """The state's columns: touched leaves anew, and what lies between them as it was."""
        if all(isinstance(x, int) for x in self.leaves):
            text, chars, tokens, sizes = self._text, *self._pieces, self._sizes
        else:
            texts, parts = [], ([], [], [])
            for untouched, group in groupby(self.leaves, key=lambda x: isinstance(x, int)):
                own = list(group)
                if untouched:  # neighbours in the state, too
                    a, b = own[0], own[-1] + 1
                    texts.append(self._text[self._begin[a] : self._begin[b]])
                    found = [*[x[self._first[a] : self._first[b]] for x in self._pieces], self._sizes[a:b]]
                else:
                    texts += [x[0] for x in own]
                    found = [[n for x in own for n in x[1]], [n for x in own for n in x[2]], [len(x[1]) for x in own]]
                for part, x in zip(parts, found, strict=True):
                    part.append(np.asarray(x, dtype=INT))
            text, (chars, tokens, sizes) = "".join(texts), [np.concatenate(x) for x in parts]
        return text, chars.tobytes(), tokens.tobytes(), sizes.tobytes(), np.concatenate([self.chars, self.tokens]).tobytes(), self.n_tokens

    def _pull(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return self.stored()[0]

    def find(self, pos: int) -> tuple[int, int]:
        """Leaf that holds character pos (the last one for the end of the text) and the leaf's first character."""
        k, begin = 1, 0
        while k < self.width:
            k *= 2
            if pos >= begin + self.chars[k] and self.chars[k + 1]:
                begin += int(self.chars[k])
                k += 1
        return min(k - self.width, len(self.leaves) - 1), begin

    def edit(self, counter: PieceCounter, pos: int, deleted: int, inserted: str) -> int:
        """Replace `deleted` characters at pos by `inserted`; returns how many pre-tokens were encoded."""
        pos = min(max(pos, 0), int(self.chars[1]))
        deleted = min(max(deleted, 0), int(self.chars[1]) - pos)
        first, begin = self.find(max(pos - CONTEXT, 0))
        if first and pos - CONTEXT <= begin:  # the match before this leaf may have looked into it
            first -= 1
            begin -= int(self.chars[self.width + first])
        ends = list(accumulate(self._leaf(first)[1], initial=begin))
        keep = max(0, bisect_left(ends, pos - CONTEXT + 1) - 1)  # whole pre-tokens that end before the context
        start = ends[keep]
        last, behind = self.find(pos + deleted)
        behind += int(self.chars[self.width + last])
        while True:
            held = [self._leaf(k) for k in range(first, last + 1)]
            old = "".join(leaf[0] for leaf in held)
            window = old[start - begin : pos - begin] + inserted + old[pos + deleted - begin :]
            pieces = counter.split(window)
            whole = last + 1 == len(self.leaves)
            shift = len(inserted) - deleted
            old_ends, tail = {}, begin
            for j, leaf in enumerate(held):
                for i, n in enumerate(leaf[1]):
                    old_ends[tail] = (j, i)
                    tail += n
            at, used = start, 0
            met = None
            for p in pieces:
                if at >= pos + len(inserted) and at - shift in old_ends and used:
                    met = old_ends[at - shift]
                    break
                if not whole and at + len(p) + CONTEXT > behind + shift:
                    break  # the end of the window may have cut this match
                at += len(p)
                used += 1
            else:
                if whole:
                    met = (last + 1 - first, 0)
            if met is not None:
                break
            last += 1
            behind += int(self.chars[self.width + last])
        new = pieces[:used]
        chars, tokens = held[0][1][:keep] + [len(p) for p in new], held[0][2][:keep] + counter.counts(new)
        for j in range(met[0], last + 1 - first):
            i = met[1] if j == met[0] else 0
            chars += held[j][1][i:]
            tokens += held[j][2][i:]
        self._replace(first, last, old[: start - begin] + window, chars, tokens)
        return used

    def _replace(self, first: int, last: int, text: str, chars: list[int], tokens: list[int]) -> None:
        leaves = last + 1 - first
        each = -(-len(chars) // leaves)
        grown = each > 2 * LEAF
        if grown:
            each = LEAF
        fresh, at, begin = [], 0, 0
        while at < len(chars) or len(fresh) < leaves:
            end = begin + sum(chars[at : at + each])
            fresh.append([text[begin:end], chars[at : at + each], tokens[at : at + each]])
            at, begin = at + each, end
        sums = [len(x[0]) for x in fresh], [sum(x[2]) for x in fresh]
        if grown:  # more leaves: all sums above them are made anew, from those of the leaves
            begin, behind, end = self.width + first, self.width + last + 1, self.width + len(self.leaves)
            self.leaves[first : last + 1] = fresh
            self._build([np.concatenate([heap[self.width : begin], own, heap[behind:end]]) for heap, own in zip((self.chars, self.tokens), sums, strict=True)])
            return
        self.leaves[first : last + 1] = fresh
        begin, end = self.width + first, self.width + last + 1
        self.chars[begin:end], self.tokens[begin:end] = sums
        touched = {k // 2 for k in range(begin, end)}
        while touched and 0 not in touched:
            for k in touched:
                self._pull(k)
            touched = {k // 2 for k in touched}


def _running(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each, and of all."""
    sums = np.zeros(len(values) + 1, dtype=SUM)
    np.cumsum(values, out=sums[1:])
    return sums


def _state_columns(trees: list[PieceTree]) -> list[pa.Array]:
    columns = list(zip(*[t.stored() for t in trees], strict=True)) or [()] * 6
    kinds = [pa.string(), *[pa.binary()] * 4, pa.int64()]
    return [pa.array(x, type=kind) for x, kind in zip(columns, kinds, strict=True)]


def build_state(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and STATE of every document: the table that a service keeps between edits. Null texts are empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks_path, pattern)
        for batch in batches:
            trees = []
            for text in batch.column(1).to_pylist():
                pieces = own.split(text or "")
                trees.append(PieceTree(text or "", [len(p) for p in pieces], own.counts(pieces)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_state_columns(trees)], names=["id", *STATE_NAMES])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {STATE}")


def attach_edits(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state with the column edits, from rows (id, seq, pos, deleted, inserted) applied in order of seq.

    Of equal seq, null ones first, the order is that of pos, deleted and inserted; repeated edits are applied again. Edits
    of an id without a state, or of a null id, change nothing; an id without edits has null edits. The edits of one id are
    one row, as its text is.
    """
    listed = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "deleted", "inserted"))).alias("e"))
    listed = listed.select("id", F.transform("e", lambda x: F.struct(x["pos"].cast("long").alias("pos"), x["deleted"].cast("long").alias("deleted"), x["inserted"].alias("inserted"))).alias("edits"))
    return state.join(listed, "id", "left")


def apply_edits(state: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Apply each row's edits (column edits of type EDIT, positions in the text as edited so far).

    Returns id, the new STATE, tokens_before, n_edits and encoded_pieces. Null edits are none, a null insert
    is empty, null numbers count as 0, and positions and lengths are cut to the text. Rows are independent:
    null and repeated ids are worked on one by one.
    """
    kind = state.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(ranks_path, pattern)
        for batch in batches:
            listed = [[e for e in edits or [] if e] for edits in batch.column(7).to_pylist()]
            rows = [k for k, edits in enumerate(listed) if edits]
            trees, encoded = [], np.zeros(len(listed), dtype=np.int64)
            touched = batch.take(pa.array(rows, type=pa.int64()))
            for k, text, *stored in zip(rows, *[touched.column(i).to_pylist() for i in range(1, 6)], strict=True):
                tree = PieceTree(text, *[np.frombuffer(x, dtype=kind) for x, kind in zip(stored, (INT, INT, INT, SUM), strict=True)])
                encoded[k] = sum(tree.edit(own, e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "") for e in listed[k])
                trees.append(tree)
            places = np.arange(len(listed))
            places[rows] = len(listed) + np.arange(len(rows))
            columns = [pa.concat_arrays([batch.column(i), new]).take(pa.array(places)) for i, new in enumerate(_state_columns(trees), start=1)]
            made = pc.cast(pc.fill_null(pc.list_value_length(batch.column(7)), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(6), made, pa.array(encoded)], names=["id", *STATE_NAMES, "tokens_before", "n_edits", "encoded_pieces"])

    columns = ["id", *STATE_NAMES, F.col("edits").cast(EDIT).alias("edits")]
    return state.select(*columns).mapInArrow(run, f"id {kind}, {STATE}, tokens_before long, n_edits long, encoded_pieces long")
