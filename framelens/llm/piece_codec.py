"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton over all pieces reads a word once; at each character it follows its output links, and every
piece that ends there relaxes the best segmentation ending at that position. What "best" means follows
the model file. Unigram models: the greatest sum of scores. BPE models, for which a sum of scores gives
other ids than the library: the piece that byte-pair merging would put last, which is the one whose pair
with the last piece before it stays two pieces when merged alone; exactly one piece that ends at a
position has that property.

Words are taken apart where no piece can reach across, between two characters that are neighbours in no
piece, and remembered by each worker in a cache of bounded size.

Nulls: a null text is an empty one, with no ids. A null id is passed on. Repeated rows are encoded each.
An empty table gives no rows. Only models whose normaliser leaves text as it is are taken.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import inf
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelens.llm.common import text_or_empty
from framelens.llm.memory import Memory

WORDS_KEPT = 200_000
PAIRS_KEPT = 500_000
# SentencePiece's sign for a blank, its model types and its penalty below the least score.
BLANK = "▁"
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0

_CODECS: dict[str, Codec] = {}


def _message(data: bytes) -> dict[int, list]:
    """The fields of one protobuf message by number: integers, or bytes of whatever else."""
    fields: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        fields.setdefault(key >> 3, []).append(value)
    return fields


class Codec:
    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        fields = _message(proto)
        trainer = _message(b"".join(fields.get(2, [])))
        normalizer = _message(b"".join(fields.get(3, [])))
        self.kind = trainer.get(3, [UNIGRAM])[-1]
        self.prefix = bool(normalizer.get(3, [1])[-1])
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models can be read")
        if normalizer.get(2, [b""])[-1] or normalizer.get(4, [1])[-1] or not normalizer.get(5, [1])[-1]:
            raise ValueError("only models that leave the text as it is can be read")
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [
            i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = [model.get_score(i) for i in range(size)]
        self.least = min(self.scores[i] for i in plain) - UNKNOWN_PENALTY
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.controls = {i for i in range(size) if model.is_control(i)}
        odd = self.controls | set(self.byte_of) | {self.unknown}
        self.odd = np.isin(np.arange(size), list(odd))
        self.shown = [p.replace(BLANK, " ") for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (len(piece), i, piece))
        self.automaton.make_automaton()
        across = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.cut = None if across else re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+").findall
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.words, self.parts = Memory(WORDS_KEPT), Memory(WORDS_KEPT)
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.order = {p: -self.scores[i] for p, i in self.ids.items()}
        self.history = lru_cache(WORDS_KEPT)(self._history)
        self.stays = lru_cache(PAIRS_KEPT)(self._stays_two)

    def _history(self, text: str) -> list[tuple[float, str, str]] | None:
        """How byte-pair merging makes one piece of a short text: before each step, what the step ranks at, and
        the first and last part. The best-scored neighbours go first, the leftmost of equals. None: it does not.
        """
        order, parts, steps = self.order.get, list(text), []
        while len(parts) > 1:
            found = [(rank, k) for k, pair in enumerate(map(add, parts, parts[1:])) if (rank := order(pair)) is not None]
            if not found:
                return None
            rank, k = min(found)
            steps.append((rank, parts[0], parts[-1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [*steps, (inf, text, text)]

    def _stays_two(self, left: str, right: str) -> bool:
        """Whether merging both texts together never joins across their border: each then takes its own steps,
        and the border's neighbours are at no time next in order."""
        ours, theirs = self.history(left), self.history(right)
        if ours is None or theirs is None:
            return False
        order, i, k = self.order.get, 0, 0
        while True:
            mine, _, end = ours[i]
            other, start, _ = theirs[k]
            across = order(end + start)
            if across is not None and across < mine and across <= other:
                return False
            if mine <= other:
                if mine == inf:
                    return True
                i += 1
            else:
                k += 1

    def segment(self, word: str) -> list[str]:
        """The pieces of a word, single characters for those that no piece covers."""
        size = len(word)
        if self.kind == UNIGRAM:
            last = [0] * (size + 1)  # length of the last piece of the best segmentation up to there
            best = [0.0] + [-1e30] * size
            ends: list[list[tuple[int, int]]] = [[] for _ in range(size)]
            for end, (n, i, _) in self.automaton.iter(word):
                ends[end].append((n, i))
            for end in range(size):
                found = ends[end]
                if not any(n == 1 for n, _ in found):
                    found = [*found, (1, -1)]
                for n, i in sorted(found, reverse=True):  # of equals the longest last piece
                    score = best[end + 1 - n] + (self.scores[i] if i >= 0 else self.least)
                    if score > best[end + 1]:
                        best[end + 1], last[end + 1] = score, n
            out, at = [], size
            while at:
                n = last[at] or 1
                out.append(word[at - n : at])
                at -= n
            return out[::-1]
        # The last piece up to there; a character of its own where none ends.
        ends_in, stays, history = ["", *word], self.stays, self.history
        done = 0
        for end, (n, _, piece) in self.automaton.iter(word):
            if end < done:
                continue
            start = end + 1 - n
            if stays(ends_in[start], piece) if start else history(piece) is not None:
                ends_in[end + 1] = piece
                done = end + 1
        out, at = [], size
        while at:
            out.append(ends_in[at])
            at -= len(ends_in[at])
        return out[::-1]

    def _apart(self, word: str) -> list[str]:
        if self.neighbours.issuperset(map(add, word, word[1:])):
            return [word]
        cuts = [k for k, pair in enumerate(map(add, word, word[1:]), 1) if pair not in self.neighbours]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _learn(self, words: set[str]) -> None:
        apart = {w: self._apart(w) for w in words}
        self.parts.turn()
        new = self.parts.lack({p for parts in apart.values() for p in parts})
        known = self.parts.young
        known.update({p: self._part(p) for p in new})
        self.words.young.update({w: b"".join([known[p] for p in parts]) for w, parts in apart.items()})

    def _part(self, word: str) -> bytes:
        pieces = self.segment(word)
        try:
            return b"".join(map(self.coded.__getitem__, pieces))
        except KeyError:
            return b"".join([self.coded.get(piece) or self._unknown(piece) for piece in pieces])

    def _unknown(self, piece: str) -> bytes:
        ids = [self.bytes[b] for b in piece.encode("utf-8")] if self.bytes else [self.unknown]
        return np.array(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit bytes."""
        if not text:
            return b""
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        words = self.cut(text) if self.cut else [text]
        self.words.turn()
        if new := self.words.lack(set(words)):
            self._learn(new)
        known = self.words.young
        return b"".join(map(known.__getitem__, words))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of the ids: plain pieces are joined run by run, bytes gathered until a piece follows."""
        ids = np.asarray(ids, np.int64)
        at, every = 0, ids.tolist()
        out: list[str] = []
        raw = bytearray()
        shown, byte_of = self.shown.__getitem__, self.byte_of
        for odd in [*np.flatnonzero(self.odd[ids]).tolist(), len(every)]:
            if raw and (odd > at or odd == len(every) or every[odd] not in byte_of):
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out += map(shown, every[at:odd])
            at = odd + 1
            if odd == len(every):
                break
            if every[odd] in byte_of:
                raw.append(byte_of[every[odd]])
            elif every[odd] not in self.controls:
                out.append(" ⁇ ")
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def codec(path: str) -> Codec:
    if path not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path] = Codec(f.read())
    return _CODECS[path]


ENCODED = "doc_id long, text string, ids array<int>"


def _encoded(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    ids = [own.encode(t.as_py()) for t in batch["text"]]
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    return pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["text"], lists], ["doc_id", "text", "ids"])


def _decoded(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch["ids"]
    arrays = [x.values.to_numpy() if x.is_valid else np.empty(0, np.int32) for x in lists]
    texts = [own.decode(x) for x in arrays]
    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in arrays]
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], batch["text"], lists, pa.array(texts, pa.string()), pa.array(crc, pa.int64())],
        ["doc_id", "text", "ids", "decoded", "ids_crc32"],
    )


def _mapped(rows: DataFrame, model: str, schema: str, *steps) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for step in steps:
                batch = step(own, batch)
            yield batch

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text and ids of every text."""
    return _mapped(docs.select("doc_id", text_or_empty()), model, ENCODED, _encoded)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows with `decoded`, the text of their ids, and ids_crc32 over them."""
    return _mapped(encoded, model, f"{ENCODED}, decoded string, ids_crc32 long", _decoded)


def there_and_back(docs: DataFrame, model: str) -> DataFrame:
    """`decode` of `encode`, by one worker: half as many workers hold the model and remember words."""
    both = f"{ENCODED}, decoded string, ids_crc32 long"
    return _mapped(docs.select("doc_id", text_or_empty()), model, both, _encoded, _decoded)
