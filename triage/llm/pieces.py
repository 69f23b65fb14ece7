"""SentencePiece models run by the tokenizers library.

The model's protocol buffer is read field by field; its normaliser, space marker, pieces with
scores (or the merges that the scores of a BPE model imply) and byte fallback are rebuilt as a
tokenizers pipeline. Batches are encoded on all threads the library is given. Parity with the
original library is checked on every document, or on the share ``audit`` of them by hashed id.

Where no piece goes on behind a word, a text's ids are those of its words, in both libraries. Each
different word is then encoded, decoded and checked once and remembered by the task; a text has
the original's ids if the original normalises it alike and has the same ids for all its words. Other
models, and texts that hold the marker themselves, are encoded and checked as whole texts.

Defined results: a null text gives null ids and null checks, an empty one no ids; equal texts
get equal ids; the strings of control pieces in a text are ordinary text. Repeated rows are
encoded each; extra columns are left out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.llm.tables import map_arrow, map_lists, share_of_ids

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Texts are handed to the encoder in lots of about so many bytes.
LOT = 1_000_000
#: So many different words are remembered before a task starts anew.
REMEMBERED = 300_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at += 1
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field kind {kind} is not part of a model file")
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list, repr=False)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True
    space_suffix: bool = False


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((text, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    m.kind = v
                elif n == 24:
                    m.space_suffix = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """All pairs of pieces whose join is a piece, in the order in which that piece is preferred."""
    place = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    out = []
    for i, (piece, score, kind) in enumerate(m.pieces):
        if kind not in (NORMAL, USER):
            continue
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in place and b in place:
                out.append((-score, i, place[a], place[b], a, b))
    return [(a, b) for *_, a, b in sorted(out)]


def by_words(m: Model) -> bool:
    """Whether a text's pieces are those of its words, each with the spaces before it.

    So it is if the marker stands at the start of pieces only and is a piece itself, so that no
    run of bytes goes from one word into the next, and a word alone is normalised as in its text.
    """
    own = {p for p, _, kind in m.pieces if kind != CONTROL}
    return (
        m.escape_spaces
        and (m.dummy_prefix or not m.squeeze_spaces)
        and SPACE in own
        and not any(SPACE in p.lstrip(SPACE) for p in own)
        and not any(kind == USER for *_, kind in m.pieces)
    )


def build(m: Model):
    """The tokenizers pipeline that is equal to the model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if m.space_suffix:
        raise ValueError("models that mark spaces behind words are not supported")
    unknown = next((i for i, (_, _, kind) in enumerate(m.pieces) if kind == UNKNOWN), None)
    if m.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
    else:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(m.pieces)},
            merges=merges_of(m),
            unk_token=None if unknown is None else m.pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=m.byte_fallback,
            cache_capacity=0,  # filling it takes longer than it saves
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", SPACE))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    # No piece goes on behind a word into the next space: words can be encoded one by one.
    if m.escape_spaces and not any(SPACE in p.lstrip(SPACE) for p, _, _ in m.pieces):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*"), "isolated")
    after = [decoders.Replace(SPACE, " ")]
    after += [decoders.ByteFallback()] if m.byte_fallback else []
    after.append(decoders.Fuse())
    after += [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence(after)
    own = [p for p, _, kind in m.pieces if kind == USER]
    if own:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in own])
    return tokenizer


class Coder:
    """Encodes texts with the rebuilt pipeline, decodes them again and compares with the original library."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, decoders

        m = parse_model(data)
        self.whole, self.original, self.prefix = _loaded(data), _original(data), m.dummy_prefix
        self.plain = not m.charsmap and not m.squeeze_spaces  # nothing is normalised but spaces
        self.core = None
        if by_words(m):
            self.core = Tokenizer(self.whole.model)
            after = [decoders.Replace(SPACE, " "), *([decoders.ByteFallback()] if m.byte_fallback else []), decoders.Fuse()]
            self.core.decoder = decoders.Sequence(after)
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_list(pa.int32()))
        self.back, self.same = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)

    def encode(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Per text the ids, whether decoding them gives the text, and whether they are the original's."""
        if self.core is None or any(SPACE in t for t in texts):
            return self._encode_whole(texts)
        if self.plain:
            normal = [" " + t if t and self.prefix else t for t in texts]
        else:
            normal = [self.whole.normalizer.normalize_str(t).replace(SPACE, " ") for t in texts]
        theirs = self.original.normalize(texts)
        alike = np.array([a.replace(" ", SPACE) == b for a, b in zip(normal, theirs, strict=True)], dtype=bool)
        kept = np.array([n == (" " + t if t and self.prefix else t) for n, t in zip(normal, texts, strict=True)], dtype=bool)
        blob = [n.encode("utf-8", "surrogatepass") for n in normal]
        ends = np.cumsum([len(x) for x in blob], dtype=np.int64)
        starts = ends - np.array([len(x) for x in blob], dtype=np.int64)
        own, first = self._split(b"".join(blob), starts)
        at = self._places(own)
        ids = self.ids.take(pa.array(at))
        tokens = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(), dtype=np.int64)])
        counts = np.append(first[1:], len(own)) - first
        offsets = np.append(tokens[first], tokens[-1])
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.flatten())
        return out, kept & _every(self.back[at], first, counts), alike & _every(self.same[at], first, counts)

    @staticmethod
    def _split(data: bytes, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, each with the spaces before it, and the place of each text's first."""
        space = np.frombuffer(data, dtype=np.uint8) == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[starts[starts < len(data)]] = True
        at = np.flatnonzero(cut)
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64).tobytes())
        words = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(data))
        return words, np.searchsorted(at, starts)

    def _places(self, own: pa.Array) -> np.ndarray:
        """The place of every word among those remembered, which new ones join."""
        coded = own.dictionary_encode()
        if len(self.words) > REMEMBERED:
            self._forget()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        fresh = coded.dictionary.filter(pc.is_null(known))
        if len(fresh):
            self._learn(fresh)
            known = pc.index_in(coded.dictionary, value_set=self.words)
        return known.to_numpy()[coded.indices.to_numpy()]

    def _learn(self, fresh: pa.Array) -> None:
        words = fresh.to_pylist()
        ids = [e.ids for e in self.core.encode_batch_fast([w.replace(" ", SPACE) for w in words], add_special_tokens=False)]
        back = self.core.decode_batch(ids, skip_special_tokens=False)
        theirs = self.original.encode([w[1:] if self.prefix else w for w in words], num_threads=1)
        self.words = pa.concat_arrays([self.words, fresh])
        self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.large_list(pa.int32()))])
        self.back = np.append(self.back, [a == b for a, b in zip(words, back, strict=True)])
        # The prefix alone: the original gives an empty text no ids.
        self.same = np.append(self.same, [a == b or w == " " for w, a, b in zip(words, ids, theirs, strict=True)])

    def _encode_whole(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        kept = np.array([a == b for a, b in zip(back, texts, strict=True)], dtype=bool)
        alike = np.array([a == b for a, b in zip(self.original.encode(texts, num_threads=1), ids, strict=True)], dtype=bool)
        return pa.array(ids, pa.list_(pa.int32())), kept, alike


def _every(flags: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether all flags from each first place on are set; so it is for none."""
    wrong = np.concatenate([[0], np.cumsum(~flags)])
    return wrong[first + counts] == wrong[first]


@lru_cache(maxsize=1)
def _coder(data: bytes) -> Coder:
    return Coder(data)


@lru_cache(maxsize=1)
def _loaded(data: bytes):
    return build(parse_model(data))


@lru_cache(maxsize=1)
def _original(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode(docs: DataFrame, model: bytes, audit: float = 1.0) -> DataFrame:
    """doc_id, ids, round_trip (decoding gives the text back), parity (ids of the original library).

    ``parity`` is null where the document is not in the audited share.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        coder = _coder(shared.value)
        for b in batches:
            texts = b.column("text")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(sizes // LOT)) + 1
            for at, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                part = b.slice(at, end - at)
                own = part.column("text").is_valid()
                ids, kept, alike = coder.encode(part.column("text").drop_null().to_pylist())
                place = pc.if_else(own, pc.subtract(pc.cumulative_sum(own.cast(pa.int64())), 1), None)
                parity = pc.if_else(part.column("audited"), pa.array(alike).take(place), None)
                yield {"doc_id": part.column("doc_id"), "ids": ids.take(place), "round_trip": pa.array(kept).take(place), "parity": parity}

    audited = share_of_ids("doc_id", "pieces") < audit
    rows = docs.select(F.col("doc_id").cast("long"), "text", audited.alias("audited"))
    return map_arrow(rows, "doc_id long, ids array<int>, round_trip boolean, parity boolean", run)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        tokenizer = _loaded(shared.value)
        for b in batches:
            yield {
                "doc_id": b["doc_id"],
                "text": [None if x is None else tokenizer.decode(x, skip_special_tokens=False) for x in b["ids"]],
            }

    return map_lists(encoded.select("doc_id", "ids"), "doc_id long, text string", run)


def save_tokenizer(model: bytes) -> str:
    """The rebuilt pipeline as the library's own JSON text."""
    return json.dumps(json.loads(_loaded(model).to_str()), ensure_ascii=False)
