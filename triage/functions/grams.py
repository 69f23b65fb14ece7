"""Counting n-grams of many texts at once, with numpy over Arrow columns.

A task hands over the cleaned texts of some tickets. Every n-gram becomes one unsigned number that
is unique among those texts: a character n-gram is the places of its code points in their sorted
alphabet, a word n-gram the places of its words in their sorted list. Numbers are sorted within
the ticket, and a run of equal ones is a term with its count. Numbers are ordered as the terms'
bytes are, so a term's place among the different terms of a set of texts depends on that set alone.
Between tasks terms travel many to a row, as compressed bytes, dealt to parts by a hash of the term.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Send this module's code with the tasks: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Code points counted at once; a character has three n-grams, of eight bytes each.
SLICE_CHARS = 1_000_000
# Code points whose different terms a task holds at once, before it hands them over.
BATCH_CHARS = 4_000_000
# Rows of a term table that are handed over at once.
SHELF_ROWS = 300_000
BLANK = 32


def flat(column) -> pa.Array:
    """One array of a column that may come in pieces."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def slices(lengths: np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about so many code points."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def _runs_within(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of the keys of texts that follow each other; sorts the keys in place."""
    ends = np.cumsum(sizes)
    for a, b in zip(ends - sizes, ends):
        keys[a:b].sort()
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    new[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(new)
    return np.searchsorted(ends, at, side="right"), keys[at], np.diff(at, append=len(keys))


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


@dataclass
class CharGrams:
    """Character n-grams inside word bounds of cleaned texts, whose words are one blank apart."""

    texts: pa.Array
    low: int
    high: int

    def __post_init__(self):
        seen = np.zeros(sys.maxunicode + 1, bool)
        seen[BLANK] = True
        for a, b in self.slices():
            seen[self._codes(a, b)[0]] = True
        self.alphabet = np.flatnonzero(seen).astype(np.uint32)
        # Place 0 is no character at all, behind the end of a shorter n-gram.
        self.places = np.zeros(sys.maxunicode + 1, np.uint32)
        self.places[self.alphabet] = np.arange(1, len(self.alphabet) + 1, dtype=np.uint32)
        self.bits = _bits(len(self.alphabet))
        self.heads: np.ndarray | None = None
        if self.bits * self.high > 64:  # the beginnings get numbers of their own
            found = [np.unique(self._grams(a, b, head=True)[0]) for a, b in self.slices()]
            self.heads = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)

    def slices(self):
        return slices(pc.fill_null(pc.utf8_length(self.texts), 0).to_numpy(zero_copy_only=False))

    def _codes(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the texts from a to b, a blank around every word, and each text's number of them."""
        spaced = [" " + t.replace(" ", "  ") + " " for t in self.texts.slice(a, b - a).to_pylist()]
        codes = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.fromiter(map(len, spaced), np.int64, len(spaced))

    def _grams(self, a: int, b: int, head: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n-grams, text by text, and each text's number of them; or of their beginnings."""
        codes, lengths = self._codes(a, b)
        n, bits, high = len(codes), self.bits, self.high
        place = self.places[codes].astype(np.uint64)
        ends = np.cumsum(lengths)
        inside = codes != BLANK
        split = high - 2 if head or self.heads is not None else high
        ok = np.ones(max(n - 1, 0), bool)
        parts, marks = [], []
        key = np.zeros(n, np.uint64)
        # The key of n-grams grows by a character at a time; inner characters are not blank.
        key[:] = place
        tail = np.zeros(n, np.uint64)
        for size in range(2, high + 1):
            m = n - size + 1
            if m <= 0:
                break
            if size > 2:
                ok = ok[:m] & inside[size - 2 : size - 2 + m]
            if size <= split:
                key = (key[:m] << np.uint64(bits)) | place[size - 1 :]
                tail = tail[:m]
            else:
                key, tail = key[:m], (tail[:m] << np.uint64(bits)) | place[size - 1 :]
            if size >= self.low:
                at = np.flatnonzero(ok)
                whole = key[at] << np.uint64(bits * max(split - size, 0))
                if self.heads is not None and not head:
                    left = bits * (high - max(size, split))
                    whole = np.searchsorted(self.heads, whole).astype(np.uint64) << np.uint64(bits * (high - split))
                    whole |= tail[at] << np.uint64(left)
                parts.append(whole)
                marks.append(at)
        if head:
            return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.zeros(0, np.int64)
        return _by_text(parts, marks, ends)

    def counted(self, a: int, b: int):
        keys, sizes = self._grams(a, b)
        return _runs_within(keys, sizes)

    def terms(self, keys: np.ndarray) -> pa.Array:
        bits, high = self.bits, self.high
        mask = np.uint64((1 << bits) - 1)
        if self.heads is None:
            columns = [(keys >> np.uint64(bits * (high - 1 - i))) & mask for i in range(high)]
        else:
            rest = 2
            head = self.heads[(keys >> np.uint64(bits * rest)).astype(np.int64)]
            columns = [(head >> np.uint64(bits * (high - rest - 1 - i))) & mask for i in range(high - rest)]
            columns += [(keys >> np.uint64(bits * (rest - 1 - i))) & mask for i in range(rest)]
        code = np.concatenate([np.zeros(1, np.uint32), self.alphabet])
        places = np.stack([c.astype(np.int64) for c in columns], axis=1)
        return _strings(code[places], places > 0)


def _by_text(parts, marks, ends) -> tuple[np.ndarray, np.ndarray]:
    """Keys found in several passes over the texts, gathered text by text."""
    cuts = [np.searchsorted(at, np.concatenate([[0], ends])) for at in marks]
    sizes = sum((np.diff(c) for c in cuts), np.zeros(len(ends), np.int64))
    out = np.empty(int(sizes.sum()), np.uint64)
    to = 0
    for i in range(len(ends)):
        for part, c in zip(parts, cuts):
            k = c[i + 1] - c[i]
            out[to : to + k] = part[c[i] : c[i + 1]]
            to += k
    return out, sizes


def _strings(codes: np.ndarray, real: np.ndarray) -> pa.Array:
    """Strings of rows of code points, as far as they are real."""
    width = (1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)) * real
    offsets = np.concatenate([[0], np.cumsum(width.sum(axis=1))]).astype(np.int32)
    data = codes[real].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


@dataclass
class WordGrams:
    """Single words and pairs of neighbours of texts given as lists of words."""

    words: pa.Array

    def __post_init__(self):
        self.bounds = np.asarray(self.words.offsets).astype(np.int64)
        encoded = self.words.flatten().dictionary_encode()
        order = pc.array_sort_indices(encoded.dictionary).to_numpy()
        self.list = encoded.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
        self.places = place[encoded.indices.to_numpy()] if len(order) else np.zeros(0, np.uint64)
        self.bounds -= self.bounds[0] if len(self.bounds) else 0

    def slices(self):
        return slices(6 * np.diff(self.bounds))

    def counted(self, a: int, b: int):
        lo, hi = self.bounds[a], self.bounds[b]
        ids, lengths = self.places[lo:hi], np.diff(self.bounds[a : b + 1])
        first = ids << np.uint64(32)
        pairs = np.zeros(len(ids), np.uint64)
        if len(ids):
            pairs[:-1] = first[:-1] | ids[1:]
        last = np.cumsum(lengths)[lengths > 0] - 1
        together = np.ones(len(ids), bool)
        together[last] = False
        keys = np.empty(2 * len(ids), np.uint64)
        keys[0::2], keys[1::2] = first, pairs
        kept = np.ones(2 * len(ids), bool)
        kept[1::2] = together
        return _runs_within(keys[kept], np.where(lengths > 0, 2 * lengths - 1, 0))

    def terms(self, keys: np.ndarray) -> pa.Array:
        first = self.list.take(pa.array((keys >> np.uint64(32)).astype(np.int64) - 1))
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        second = self.list.take(pa.array(low - 1, mask=low == 0))
        return pc.coalesce(pc.binary_join_element_wise(first, second, " "), first)


def words_of(texts: pa.Array) -> pa.Array:
    """The words of two or more characters of texts whose words are one blank apart."""
    pieces = pc.split_pattern(texts, " ")
    words = pieces.flatten()
    kept = pc.greater_equal(pc.utf8_length(words), 2)
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))]).astype(np.int32)
    bounds = np.asarray(pieces.offsets)
    return pa.ListArray.from_arrays(pa.array(before[bounds - bounds[0]]), words.filter(kept))


def grams_of(block: str, column, spans) -> CharGrams | WordGrams:
    """``column`` holds the cleaned texts for character n-grams, ``word_string`` or lists of words for word n-grams."""
    if block == "char":
        return CharGrams(flat(column), *spans["char"])
    if tuple(spans["word"]) != (1, 2):
        raise ValueError("word n-grams are single words and pairs")
    texts = flat(column)
    return WordGrams(texts if pa.types.is_list(texts.type) else words_of(texts))


def totals(grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, texts that hold it, occurrences) of the different terms, in order."""
    keys, df, tf = [], [], []
    for a, b in grams.slices():
        _, key, count = grams.counted(a, b)
        order = np.argsort(key)
        key, count = key[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        keys.append(key[at])
        df.append(np.diff(at, append=len(key)))
        tf.append(np.add.reduceat(count, at) if len(at) else count)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], df[0], tf[0]
    every, own = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(own, np.concatenate(x), minlength=len(every)).astype(np.int64) for x in (df, tf)]
    return every, *sums


# --- terms as bytes -------------------------------------------------------------------------


def pack(*columns: np.ndarray, rising: Sequence[int] = ()) -> tuple[int, bytes]:
    """The columns' bytes, one after the other, compressed, and their size; ``rising`` ones as differences."""
    steps = [np.diff(x, prepend=x.dtype.type(0)) if i in rising else x for i, x in enumerate(columns)]
    data = b"".join(np.ascontiguousarray(x).tobytes() for x in steps)
    return len(data), pa.compress(data, codec="zstd", asbytes=True)


def unpack(n: int, raw: int, packed, kinds, rising: Sequence[int] = ()) -> list[np.ndarray]:
    """What ``pack`` was given, ``n`` rows of the ``kinds`` (type, width), and behind them the bytes left over."""
    data = np.frombuffer(pa.decompress(packed, decompressed_size=raw, codec="zstd"), np.uint8)
    out, at = [], 0
    for i, (kind, width) in enumerate(kinds):
        size = n * width * np.dtype(kind).itemsize
        x = data[at : at + size].view(kind)
        out.append((np.cumsum(x, dtype=kind) if i in rising else x).reshape((n, width) if width > 1 else n))
        at += size
    return [*out, data[at:]]


def _letters(terms: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term's bytes begin and end, and the bytes."""
    _, offsets, data = terms.buffers()
    bounds = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _texts(sizes: np.ndarray, data: np.ndarray) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    if offsets[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data))


def hashes(terms: pa.StringArray) -> np.ndarray:
    """A number for each term that depends on its bytes alone."""
    bounds, data = _letters(terms)
    sizes = np.diff(bounds)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        out = np.zeros(len(terms), np.uint64)
        for a, b in slices(sizes):
            lo, hi = bounds[a], bounds[b]
            if hi == lo:
                continue
            place = np.arange(lo, hi) - np.repeat(bounds[a:b], sizes[a:b])
            filled = sizes[a:b] > 0
            out[a:b][filled] = np.add.reduceat((data[lo:hi] + np.uint64(1)) * powers[place], (bounds[a:b] - lo)[filled])
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(33)
    return out


def _by_part(terms: pa.StringArray, n_parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts that terms are dealt to and the places of their terms, in the order given."""
    if n_parts == 1:
        if len(terms):
            yield 0, np.arange(len(terms))
        return
    part = (hashes(terms) % np.uint64(n_parts)).astype(np.uint16 if n_parts < 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n_parts + 1, dtype=part.dtype if n_parts < (1 << 16) - 1 else np.uint32))
    for p in np.flatnonzero(np.diff(cuts)):
        yield int(p), order[cuts[p] : cuts[p + 1]]


def _dealt(shard: int | None, block: str, terms: pa.StringArray, columns, n_parts: int, rising=(), width: int = 0) -> pa.RecordBatch:
    """One row for each part: its terms, in order, with their columns, as bytes."""
    rows = []
    for part, at in _by_part(terms, n_parts):
        bounds, data = _letters(terms.take(pa.array(at)))
        sizes = np.diff(bounds).astype(np.uint32)
        rows.append((part, len(at), *pack(*(x[at] for x in columns), sizes, data[bounds[0] : bounds[-1]], rising=rising)))
    part, n, raw, packed = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
    shards = pa.array([shard] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), shards, pa.array([block] * len(rows), pa.string()), pa.array(n, pa.int32())]
        + [pa.array([width] * len(rows), pa.int32()), pa.array(raw, pa.int64()), pa.array(packed, pa.binary())],
        DEALT_COLUMNS,
    )


# --- tasks ----------------------------------------------------------------------------------

COUNTED = "block string, term string, df long, tf long"
DEALT = "_part int, _shard long, _block string, _n int, _width int, _raw long, _packed binary"
DEALT_COLUMNS = [c.split()[0] for c in DEALT.split(", ")]


def _said(name: str, n: int) -> pa.Array:
    return pa.array([name]).take(pa.array(np.zeros(n, np.int64)))


def _lengths(column) -> np.ndarray:
    """Code points of texts."""
    return pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)


def counting(blocks, spans, n_parts: int):
    """Task over batches of texts: the different terms of some at once with their texts and occurrences, dealt to parts."""

    def task(batches):
        for batch in batches:
            for a, b in slices(_lengths(flat(batch.column(f"_{blocks[-1]}"))), BATCH_CHARS):
                for block in blocks:
                    grams = grams_of(block, batch.column(f"_{block}").slice(a, b - a), spans)
                    keys, df, tf = totals(grams)
                    columns = df.astype(np.uint32), tf.astype(np.uint32)
                    yield _dealt(None, block, grams.terms(keys), columns, n_parts)

    return task


def summing(table):
    """Task over a part's terms: each once, with the sums of its texts and occurrences."""
    out = []
    for block in pc.unique(table.column("_block")).to_pylist():
        terms, (df, tf) = _joined(table.filter(pc.equal(table.column("_block"), block)), [(np.uint32, 1), (np.uint32, 1)])
        every = pa.table({"term": terms, "df": pa.array(df.astype(np.int64)), "tf": pa.array(tf.astype(np.int64))})
        total = every.group_by("term", use_threads=False).aggregate([("df", "sum"), ("tf", "sum")])
        columns = {"block": _said(block, total.num_rows), "term": total.column("term").cast(pa.string())}
        out.append(pa.table({**columns, "df": total.column("df_sum"), "tf": total.column("tf_sum")}))
    return pa.concat_tables(out)


def _joined(rows: pa.Table, kinds, rising=()) -> tuple[pa.Array, list[np.ndarray]]:
    """The terms of packed rows, one row's after the other's, and their columns."""
    found = []
    for n, raw, packed in zip(rows.column("_n").to_pylist(), rows.column("_raw").to_pylist(), _values(rows.column("_packed"))):
        found.append(unpack(n, raw, packed, [*kinds, (np.uint32, 1)], rising))
    columns = [np.concatenate(x) for x in zip(*found)]
    return _texts(columns[-2], columns[-1]), columns[:-2]


def _values(column) -> Iterator[pa.Buffer]:
    return (x.as_buffer() for x in flat(column))


def naming(blocks, spans, n_parts: int):
    """Task over the texts of a shard: its different terms, numbered in order, dealt to parts."""

    def task(table):
        shard, out = table.column("_shard")[0].as_py(), []
        for block in blocks:
            grams = grams_of(block, table.column(f"_{block}"), spans)
            keys = _different([key for _, key, _ in _counts(grams)])
            no = np.arange(len(keys), dtype=np.int32)
            out.append(_dealt(shard, block, grams.terms(keys), (no,), n_parts, rising=(0,)))
        return pa.Table.from_batches(out)

    return task


def shelving(n_parts: int):
    """Task over a term table: its rows dealt to the parts that the terms of shards are dealt to."""

    def shelf(held):
        table = pa.Table.from_batches(held)
        for block in pc.unique(table.column("block")).to_pylist():
            mine = table.filter(pc.equal(table.column("block"), block))
            columns, width = [_floats(mine.column("idx")).astype(np.int64), _floats(mine.column("idf")).astype(np.float64)], 0
            if "coef" in mine.column_names:
                values = flat(mine.column("coef")).flatten().to_numpy()
                width = len(values) // mine.num_rows
                columns.append(values.reshape(mine.num_rows, width))
            terms = flat(mine.column("term")).cast(pa.string())
            yield _dealt(None, block, terms, columns, n_parts, rising=(0,), width=width)

    def task(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            n += batch.num_rows
            if n >= SHELF_ROWS:
                yield from shelf(held)
                held, n = [], 0
        if held:
            yield from shelf(held)

    return task


def _known(width: int) -> list:
    """Columns of a term that is found: place, idf and coefficients."""
    return [(np.int64, 1), (np.float64, 1), *([(np.float64, width)] if width else [])]


def answering(table):
    """Task over a part: what the term table has of the terms that shards ask for, a row for each shard that asks."""
    answers = []
    for block in pc.unique(table.column("_block")).to_pylist():
        mine = table.filter(pc.equal(table.column("_block"), block))
        is_book = pc.is_null(mine.column("_shard"))
        book, asked = mine.filter(is_book), mine.filter(pc.invert(is_book))
        if not book.num_rows or not asked.num_rows:
            continue
        width = book.column("_width")[0].as_py()
        names, known = _joined(book, _known(width), rising=(0,))
        terms, (no,) = _joined(asked, [(np.int32, 1)], rising=(0,))
        place = pc.fill_null(pc.index_in(terms, value_set=names.cast(terms.type)), -1).to_numpy()
        ends = np.cumsum(asked.column("_n").to_numpy())
        for shard, a, b in zip(asked.column("_shard").to_pylist(), np.concatenate([[0], ends[:-1]]), ends):
            there = np.flatnonzero(place[a:b] >= 0)
            if len(there):
                at = place[a:b][there]
                raw, packed = pack(no[a:b][there], *(x[at].reshape(-1) for x in known), rising=(0, 1))
                answers.append((0, shard, block, len(there), width, raw, packed))
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*answers) if answers else [()] * len(kinds)
    return pa.table({c: pa.array(list(x), k) for c, x, k in zip(DEALT_COLUMNS, columns, kinds)})


def _counts(grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, key, count) of each slice of the texts."""
    for a, b in grams.slices():
        text, key, count = grams.counted(a, b)
        yield (text + a).astype(np.int32), key, count.astype(np.int32)


def _different(keys) -> np.ndarray:
    """The different ones of some arrays of keys, in order."""
    found = [np.unique(key) for key in keys]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


@dataclass
class Weights:
    """Raw weights of one block's terms in a shard's texts: text, number in the shard, weight; by number: place, coefficients."""

    text: np.ndarray
    no: np.ndarray
    w: np.ndarray
    idx: np.ndarray
    coef: np.ndarray | None
    grams: CharGrams | WordGrams
    keys: np.ndarray


def _floats(column) -> np.ndarray:
    return flat(column).to_numpy(zero_copy_only=False)


class Shard:
    """The texts of a shard and the terms found for it, as one table that holds both."""

    def __init__(self, table: pa.Table, blocks, spans, own=()):
        is_text = pc.is_null(table.column("_packed"))
        self.found, texts = table.filter(pc.invert(is_text)), table.filter(is_text)
        # Texts arrive in any order; sorted, they give the same rows and sums again when a task is repeated.
        by = [c for c in dict.fromkeys([*own, "_char"]) if c in texts.column_names and _sortable(texts.column(c).type)]
        self.texts = texts.take(pc.sort_indices(texts, sort_keys=[(c, "ascending") for c in by])) if by else texts
        self.blocks, self.spans = blocks, spans

    def groups(self, columns) -> tuple[np.ndarray, np.ndarray]:
        """A number for each text, the same for equal values, and the first text of every number."""
        group = np.zeros(self.texts.num_rows, np.int64)
        for c in columns:
            codes = flat(self.texts.column(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
            group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
        first = np.unique(group, return_index=True)[1]
        return group, first

    def take(self, column: str, at: np.ndarray) -> pa.Array:
        return flat(self.texts.column(column)).take(pa.array(at))

    def weights(self, block: str) -> Weights:
        grams = grams_of(block, self.texts.column(f"_{block}"), self.spans)
        parts = list(_counts(grams))
        keys = _different([key for _, key, _ in parts])
        idf, idx, coef = np.full(len(keys), np.nan), np.zeros(len(keys), np.int64), None
        mine = self.found.filter(pc.equal(self.found.column("_block"), block))
        sizes = (mine.column(c).to_pylist() for c in ("_n", "_raw", "_width"))
        for n, raw, width, packed in zip(*sizes, _values(mine.column("_packed"))):
            at, its_idx, its_idf, *more = unpack(n, raw, packed, [(np.int32, 1), *_known(width)], rising=(0, 1))
            idx[at], idf[at] = its_idx, its_idf
            if width:
                coef = np.zeros((len(keys), width)) if coef is None else coef
                coef[at] = more[0].reshape(n, width)
        found = []
        while parts:  # a slice's keys give way to its weights
            text, key, count = parts.pop(0)
            no = np.searchsorted(keys, key).astype(np.int32)
            w = (1.0 + np.log(count)) * idf[no]
            known = ~np.isnan(w)
            found.append((text[known], no[known], w[known]))
        none = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        text, no, w = (np.concatenate(x) for x in zip(*(found or [none])))
        return Weights(text, no, w, idx, coef, grams, keys)


def _sortable(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind)


def scaled_terms(blocks, spans, id_column: str, scales, by: str | None):
    """Task over a shard: weights of unit length for each ticket and block, times the block's scale.

    One row for each entry, or sums ``by`` "ticket" or "term".
    """

    def task(table):
        shard = Shard(table, blocks, spans, [id_column])
        group, first = shard.groups([id_column])
        out = []
        for block in blocks:
            x = shard.weights(block)
            mine = group[x.text]
            norm = np.sqrt(np.bincount(mine, x.w * x.w, minlength=len(first)))
            weight = x.w / norm[mine] * scales[block]
            if by is None:
                columns = {
                    id_column: shard.take(id_column, x.text),
                    "block": _said(block, len(weight)),
                    "term": x.grams.terms(x.keys[x.no]),
                    "idx": pa.array(x.idx[x.no]),
                    "weight": pa.array(weight),
                }
            else:
                place, n = (mine, len(first)) if by == "ticket" else (x.no, len(x.keys))
                terms = np.bincount(place, minlength=n)
                total, highest = np.bincount(place, weight, minlength=n).astype(float), np.zeros(n)
                np.maximum.at(highest, place, weight)
                there = np.flatnonzero(terms)
                key = {id_column: shard.take(id_column, first[there])} if by == "ticket" else {}
                columns = {**key, "block": _said(block, len(there))}
                if by == "term":
                    columns["term"] = x.grams.terms(x.keys[there])
                columns["terms"] = pa.array(terms[there])
                columns["total"], columns["highest"] = pa.array(total[there]), pa.array(highest[there])
            out.append(pa.table(columns))
        return pa.concat_tables(out)

    return task


def sparse_entries(blocks, spans, keep, scales):
    """Task over a shard: one row for each ticket, its places in order and their scaled weights."""

    def task(table):
        shard = Shard(table, blocks, spans, keep)
        group, first = shard.groups(keep)
        rows, idx, values = [], [], []
        for block in blocks:
            x = shard.weights(block)
            mine = group[x.text]
            norm = np.sqrt(np.bincount(mine, x.w * x.w, minlength=len(first)))
            rows.append(mine)
            idx.append(x.idx[x.no])
            values.append(x.w / norm[mine] * scales[block])
        row, idx, values = np.concatenate(rows), np.concatenate(idx), np.concatenate(values)
        order = np.lexsort((values, idx, row))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(first)))]).astype(np.int32)
        columns = {c: shard.take(c, first) for c in keep}
        columns["indices"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(idx[order].astype(np.int32)))
        columns["values"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order]))
        return pa.table(columns)

    return task


def scores(blocks, spans, id_column: str, scales, intercepts):
    """Task over a shard: each ticket's raw score per class; copies under one id count as one."""

    def task(table):
        shard = Shard(table, blocks, spans, [id_column])
        group, first = shard.groups([id_column])
        copies = np.bincount(group, minlength=len(first))
        out = np.tile(np.asarray(intercepts, float), (len(first), 1))
        for block in blocks:
            x = shard.weights(block)
            if not len(x.w):
                continue
            mine = group[x.text]
            norm = np.sqrt(np.bincount(mine, x.w * x.w, minlength=len(first)) * copies)
            norm[norm == 0] = 1.0
            for i in range(len(intercepts)):
                out[:, i] += np.bincount(mine, x.w * x.coef[x.no, i], minlength=len(first)) / norm * scales[block]
        offsets = np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))
        return pa.table({id_column: shard.take(id_column, first), "scores": values})

    return task


def entry_sums(blocks, spans, keep, scales, width: int):
    """Task over a shard: for each row of ``sparse_entries`` the sums of its entries times their coefficients."""

    def task(table):
        shard = Shard(table, blocks, spans, keep)
        group, first = shard.groups(keep)
        out = np.zeros((len(first), width))
        for block in blocks:
            x = shard.weights(block)
            if not len(x.w):
                continue
            mine = group[x.text]
            norm = np.sqrt(np.bincount(mine, x.w * x.w, minlength=len(first)))
            values = x.w / norm[mine] * scales[block]
            for i in range(width):
                out[:, i] += np.bincount(mine, values * x.coef[x.no, i], minlength=len(first))
        offsets = np.arange(0, out.size + 1, width, dtype=np.int32)
        sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))
        return pa.table({**{c: shard.take(c, first) for c in keep}, "sums": sums})

    return task
