"""Token counts of whole texts by a two-tier look-up on the map side.

First tier: a compact table of the lengths, in tokens, of frequent pre-tokens, broadcast to all workers.
Second tier: each worker's bounded cache, filled by asking the tokenizers library. Pre-tokens are never
shuffled. Which pre-tokens are in the first tier changes the speed only, never a count; they are taken
from a sample of `SAMPLE_ROWS` texts and the table has at most `FREQUENT` entries.

Nulls: a null text counts as empty, with no bytes and no tokens. A null doc_id is passed on. Repeated rows
are counted each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.llm.common import text_or_empty
from framelens.llm.memory import Memory
from framelens.llm.vocab import load

SAMPLE_ROWS = 2_000
FREQUENT = 50_000
CACHE = 400_000
TEXTS_AT_ONCE = 200
# Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters whose class all Unicode versions agree on; other texts go to the library whole.
SETTLED = re.compile("[\x00-ɏ‐-‧€]*").fullmatch

_COUNTERS: dict[str, Lengths] = {}


class Lengths:
    """A worker's second tier: pre-token lengths by asking the library."""

    def __init__(self, path: str):
        import regex

        self.library = load(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special]
        self.split = regex.compile(PATTERN).findall
        self.memory = Memory(CACHE)

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(x.ids) for x in self.library.encode_batch_fast(tokens, add_special_tokens=False)]

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """Tokens per text, special strings in it counted as the library counts them."""
        parts, whole = [], {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special) or not SETTLED(text):
                whole[i] = text
                parts.append([])
            else:
                parts.append(self.split(text))
        new: set[str] = set()
        for part in parts:
            new.update(set(part).difference(frequent))
        self.memory.turn()
        ask = list(self.memory.lack(new))
        self.memory.young.update(zip(ask, self.lengths(ask), strict=True))
        first, second = frequent.get, self.memory.young.get
        out = [sum(first(t) or second(t) for t in part) for part in parts]
        for i, n in zip(whole, self.lengths(list(whole.values())), strict=True):
            out[i] = n
        return out


def counter(path: str) -> Lengths:
    if path not in _COUNTERS:
        _COUNTERS[path] = Lengths(path)
    return _COUNTERS[path]


def frequent_lengths(docs: DataFrame, vocabulary: str) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a sample; at most FREQUENT entries reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        split = counter(vocabulary).split
        for batch in batches:
            for text in batch[0].to_pylist():
                seen.update(split(text))
        top = seen.most_common(FREQUENT)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"]
        )

    rows = docs.count()
    if not rows:
        return {}
    sample = docs.select(text_or_empty()).sample(min(1.0, SAMPLE_ROWS / rows), seed=7)
    top = (
        sample.mapInArrow(tally, "token string, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT)
        .collect()
    )
    tokens = [r["token"] for r in top]
    return dict(zip(tokens, Lengths(vocabulary).lengths(tokens), strict=True))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            n: list[int] = []
            for at in range(0, len(batch), TEXTS_AT_ONCE):
                n += count(batch["text"].slice(at, TEXTS_AT_ONCE).to_pylist(), table.value)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["n_bytes"], pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select("doc_id", text_or_empty()).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
