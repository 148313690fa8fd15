"""Byte-level BPE ids of whole texts, each distinct word of a task encoded once.

Words are cut with numpy by the vocabulary's published pattern, dictionary-encoded by Arrow, and only words that the
worker has not seen go through the tokenizer. Ids equal those of the `tokenizers` library (tests compare them); texts
that hold a special token's string go through that library whole.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textarrays import expand, span_hashes, text_bytes

#: Words kept by a worker; the store starts anew beyond this.
CACHE_WORDS = 400_000
#: Words that it keeps from one task to the next.
IDLE_WORDS = 50_000
#: Bytes of text encoded at once.
SLICE = 1 << 19
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class by code point: letter, number, white space, other."""
    import regex

    codes = np.r_[0:0xD800, 0xE000:0x110000].astype(np.uint32)
    every = codes.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[codes[m.start() : m.end()]] = kind
    return table


def piece_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Code point places where the words of the pattern begin; words never cross texts.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces(?!non-space)|spaces.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    new_text = np.zeros(n + 1, bool)
    new_text[doc_starts[doc_starts < n]] = True
    new_text[n] = True
    start = new_text[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(start)
    run_ends = np.append(runs[1:], n)
    run_kind = kind[runs]
    before = np.maximum(runs - 1, 0)
    # The last white space before a word of the same text: a plain space belongs to the word, any other stands alone.
    follows = (run_kind != SPACE) & ~new_text[runs] & (kind[before] == SPACE)
    start[before[follows]] = True
    joined = runs[follows & (codes[before] == 32)]
    start[joined] = False
    # Contractions: an apostrophe that is a whole run, without a space joined to it.
    alone = (run_kind == OTHER) & (codes[runs] == 39) & (run_ends - runs == 1) & ~(follows & (codes[before] == 32))
    at = runs[alone]
    at = at[(at + 1 < n) & ~new_text[at + 1]]
    if len(at):
        one = codes[at + 1]
        two = np.where((at + 2 < n) & ~new_text[np.minimum(at + 2, n)], codes[np.minimum(at + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for hit, length in ((single, 2), (double & ~single, 3)):
            places = at[hit]
            start[places + 1] = False
            after = places + length
            after = after[(after < n)]
            start[after] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of many texts at once, as one array and offsets by text."""

    def __init__(self, name: str = "byte_bpe_50k.json") -> None:
        self.name = name
        with open(vocabulary_path(name)) as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        self.ranked = _ranked(name)
        self.opens = np.array([self.ranked.decode_single_token_bytes(i)[:1] == b" " for i in range(self.ranked.n_vocab)]) if self.ranked else None
        self.clear()

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary_path(self.name))

    def clear(self) -> None:
        self.known: dict[int, int] = {}  # by the word's 64-bit hash
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.lengths = np.zeros(1 << 18, np.int64)
        self.used = 0

    def rest(self) -> None:
        """Called at the end of a task: a large store of words goes."""
        if len(self.known) > IDLE_WORDS:
            self.clear()

    def _lists(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number by word."""
        if not self.ranked:
            lists = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        else:
            lists = list(map(self.ranked.encode_ordinary, words))
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for x in lists for i in x), np.uint32, int(lengths.sum())), lengths

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of a space and letters: joined they are cut at the spaces again, which start a word's first id."""
        flat = np.array(self.ranked.encode_ordinary("".join(words)), np.uint32)
        firsts = np.flatnonzero(self.opens[flat])
        if len(firsts) != len(words):
            return self._lists(words)
        return flat, np.diff(firsts, append=len(flat))

    def _learn(self, words: list[str], hashes: list[int]) -> None:
        plain = [i for i, w in enumerate(words) if self.ranked and w[0] == " " and w[1:].isalpha()]
        rest = sorted(set(range(len(words))) - set(plain)) if len(plain) < len(words) else []
        for places, encode in ((plain, self._spaced), (rest, self._lists)):
            if not places:
                continue
            flat, lengths = encode([words[i] for i in places])
            at = len(self.known)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while at + len(places) > len(self.starts):
                self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts[at : at + len(places)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[at : at + len(places)] = lengths
            self.used += len(flat)
            self.known.update(zip((hashes[i] for i in places), range(at, at + len(places))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids uint32 of all texts, offsets by text). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), bool)
        for s in self.specials:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd)
        raw, offsets = text_bytes(texts)
        lead = (raw & 0xC0) != 0x80
        char_at = np.flatnonzero(lead)
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        doc_starts = np.searchsorted(char_at, offsets[:-1])
        pieces = piece_starts(codes, doc_starts)
        bounds = np.append(char_at[pieces], len(raw))
        words = pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)).dictionary_encode()
        if len(self.known) > CACHE_WORDS:
            self.clear()
        letters, at = text_bytes(words.dictionary)
        hashes = span_hashes(letters, at[:-1], at[1:]).tolist()
        new = [i for i, h in enumerate(hashes) if h not in self.known]
        if new:
            self._learn(words.dictionary.take(pa.array(new)).to_pylist(), [hashes[i] for i in new])
        number = np.fromiter(map(self.known.__getitem__, hashes), np.int64, len(hashes))
        each = number[words.indices.to_numpy(zero_copy_only=False)] if len(hashes) else np.zeros(0, np.int64)
        lengths = self.lengths[each]
        first_piece = np.searchsorted(bounds[:-1], offsets)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[expand(self.starts[each], lengths)], total[first_piece]

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(len(texts)):
            if odd[i]:
                parts.append(np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(self.encode(texts[i : i + 1])[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _ranked(name: str):
    """The same vocabulary for the faster library, where its file lies beside the other; else nothing."""
    import base64
    import os

    path = vocabulary_path(name).replace(".json", ".tiktoken")
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    """One per Python worker."""
    return Encoder(name)
