"""Token ids of whole texts through the tokenizers library, with each worker remembering words.

White space never lies inside a token of the vocabularies used with this module (their pre-tokenizer
drops it), so the ids of a text are the ids of its words in order. Words repeat, texts don't: a worker
asks the library once per word and joins remembered bytes. Memory is bounded: two generations of words
are kept, and the older one goes when the younger one is full.
"""

from __future__ import annotations

import os
import re

import numpy as np

from framelens.llm.memory import Memory

WORDS_KEPT = 400_000
WORDS_PER_CALL = 200
CHARS_AT_ONCE = 500_000
# Letters whose class and lower case all Unicode versions agree on; longer alphabets go to the library.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
ENDS = ".,;:!?"
_ENCODERS: dict[str, WordEncoder] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it lives as long as the worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import normalizers, pre_tokenizers

        self.library = load(path)
        # For words of a-z alone, which the vocabulary's own rules leave as they are.
        self.ascii = load(path)
        self.ascii.normalizer = normalizers.Sequence([])
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.library.get_vocab_size(with_added_tokens=True)
        # Marks the last token of a word of letters.
        self.closes = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.memory = Memory(WORDS_KEPT)
        self.marks = {c: self._ask([c])[0] for c in ENDS}

    def _ask(self, words: list[str], library=None) -> list[bytes]:
        found = (library or self.library).encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _ask_letters(self, words: list[str], library=None) -> list[bytes]:
        """Words of plain letters, many in one call; each ends with its only closing token."""
        groups = [words[i : i + WORDS_PER_CALL] for i in range(0, len(words), WORDS_PER_CALL)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._ask([" ".join(g) for g in groups], library), strict=True):
            ids = np.frombuffer(ids, "<u4")
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                whole, at = ids.tobytes(), 0
                for cut in (cuts * 4).tolist():
                    out.append(whole[at:cut])
                    at = cut
            else:
                out += self._ask(group)
        return out

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that are not remembered. A sign after plain letters is a token of its own."""
        cores = {w: w[:-1] if w and w[-1] in ENDS else w for w in new}
        ask = {c for c in cores.values() if PLAIN(c)}
        known = {}
        for have in (self.memory.young, self.memory.old):
            known |= {c: have[c] for c in ask if c in have}
        ask = ask.difference(known)
        for some, library in (
            ([c for c in ask if c.isascii()], self.ascii),
            ([c for c in ask if not c.isascii()], self.library),
        ):
            known.update(zip(some, self._ask_letters(some, library), strict=True))
        self.memory.young.update(known)
        rest = [w for w, c in cores.items() if c not in known]
        found = dict(zip(rest, self._ask(rest), strict=True))
        marks = self.marks
        for w, c in cores.items():
            if c in known:
                found[w] = known[c] if w is c else known[c] + marks[w[-1]]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes, without special tokens added."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            self.memory.turn()
            known, new, size, to = self.memory.young, set(), 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS_AT_ONCE):
                size += len(texts[to])
                new.update(set(_split(texts[to])).difference(known))
                to += 1
            known.update(self._learn(self.memory.lack(new)))
            # Splitting again is cheaper than keeping the words of many texts in memory.
            out += [b"".join(map(known.__getitem__, _split(t))) for t in texts[at:to]]
            at = to
        return out


def _split(text: str) -> list[str]:
    """Words; in lower case where that is sure to be what the library does, so fewer need remembering."""
    try:
        text.encode("latin-1")
        if "<|" not in text:
            text = text.lower()
    except UnicodeEncodeError:
        pass
    for c in "\n\t\r\v\f":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")
