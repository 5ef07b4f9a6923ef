"""Encoding of whole texts with a byte-level BPE file of the tokenizers library, with memos of what words encode to.

The library cuts a text into pre-tokens before it merges. Where its file says so (byte-level, no normaliser, no prefix),
no pre-token reaches over a space that stands before a character that is not white space, so texts are cut there and
each word is encoded once by the library. Texts that hold a special token, and files of another make, are encoded whole.

Words of letters alone are merged by their tokens' ranks where the file proves that this gives the library's ids: every
token has one merge, ids rise with the merges, and each token alone encodes to itself. A span of which no merge has
crossed the borders is then in the state that the token's own encoding passes through, so two neighbours that join to a
token are the pair of its merge.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import tiktoken

#: Words a worker keeps.
MEMO = 700_000
#: Texts' words looked up at once, few enough to stay in a processor's cache.
BATCH_WORDS = 30_000
_PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ODD = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


class TextEncoder:
    def __init__(self, vocabulary_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_file)
        self.library.no_truncation()
        self.library.no_padding()
        with open(vocabulary_file, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.by_words = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not made.get("normalizer")
            and (made.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel"
        )
        self.special = [x["content"] for x in made.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}  # what stands after a space
        self.heads: dict[str, bytes] = {}  # what does not
        # The library's model sees every byte as one printable character: itself, or the next free one from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(256 + i) for i, b in enumerate(others) if b != 10}
        self.space = self.shown[32]
        self.ranks = self._ranks(made["model"]) if self.by_words else None

    def _ranks(self, model: dict) -> tiktoken.Encoding | None:
        """An encoder by ranks that takes each line as one pre-token, or None where the file does not prove it equal."""
        vocabulary, merges = model.get("vocab"), model.get("merges") or []
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in odd) or not isinstance(vocabulary, dict):
            return None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        at = [vocabulary.get(a + b, -1) for a, b in pairs]
        byte_of = {chr(b): b for b in range(256)} | {c: b for b, c in self.shown.items()} | {chr(256 + 10): 10}
        plain = {t: i for t, i in vocabulary.items() if t not in self.special}
        proved = (
            len(plain) == len(at) + 256
            and all(x < y for x, y in zip(at, at[1:]))
            and all(max(vocabulary[a], vocabulary[b]) < i for (a, b), i in zip(pairs, at))
            and all(set(t) <= byte_of.keys() for t in plain)
            and all([x.id for x in self.library.model.tokenize(t)] == [i] for t, i in plain.items())
        )
        if not proved:
            return None
        made = {bytes(byte_of[c] for c in t): i for t, i in plain.items()}
        self.line_break = made[b"\n"]
        return tiktoken.Encoding("ranks", pat_str=r"[^\n]+|\n", mergeable_ranks=made, special_tokens={})

    def _packed(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian ``dtype``."""
        out: list[bytes] = []
        held: list[list[str]] = []
        n = 0
        for text in texts:
            if not self.by_words or any(s in text for s in self.special):
                out += self._joined(held)
                held, n = [], 0
                out.append(self._packed(text))
                continue
            held.append(_CUT.split(text) if _ODD.search(text) else text.split(" "))
            n += len(held[-1])
            if n >= BATCH_WORDS:
                out += self._joined(held)
                held, n = [], 0
        return out + self._joined(held)

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        """Every occurrence is looked up once; what is not known yet is learnt and filled in."""
        if not texts:
            return []
        heads = [words[0] for words in texts]
        flat: list[str] = []
        ends = []
        for words in texts:
            words[0] = ""
            flat += words
            ends.append(len(flat))
        if len(self.heads) > MEMO:
            self.heads = {}
        ids = list(map(self.words.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        new = {flat[i] for i in missing}
        if len(self.words) + len(new) > MEMO:
            self.words = {w: x for w, x in zip(flat, ids) if x is not None}
        self._learn(new, set(heads))
        for i in missing:
            ids[i] = self.words[flat[i]]
        return [self.heads[h] + b"".join(ids[a:b]) for h, a, b in zip(heads, [0, *ends], ends)]

    def _learn(self, new: set[str], heads: set[str]) -> None:
        words, known = self.words, self.heads
        words[""] = known[""] = b""
        new.discard("")
        tailed: list[tuple[str, str, str]] = []
        composed: dict[str, list[tuple[bool, str]]] = {}
        for w in [w for w in new if not w.isalpha()]:
            core = w.rstrip(_PUNCT)
            if core.isalpha():
                tailed.append((w, core, w[len(core) :]))
            else:
                composed[w] = _pre_tokens(w)
        new.difference_update(composed)
        for w, core, tail in tailed:
            new.discard(w)
            heads.add(tail)
            if core not in words:
                new.add(core)
        for w, parts in composed.items():
            for spaced, p in parts:
                if not spaced:
                    heads.add(p)
                elif p not in words and p != w:
                    new.add(p)
        self._encode_letters(list(new), self.space, words)
        heads.difference_update(known)
        letters = [h for h in heads if h.isalpha()]
        self._encode_letters(letters, "", known)
        self._encode_each([h for h in heads if not h.isalpha() and h], "", known)
        self._encode_each([w for w, parts in composed.items() if parts == [(True, w)]], " ", words)
        for w, core, tail in tailed:
            words[w] = words[core] + known[tail]
        for w, parts in composed.items():
            if w not in words:
                words[w] = b"".join([words[p] if spaced else known[p] for spaced, p in parts])

    def _encode_letters(self, words: list[str], before: str, memo: dict[str, bytes]) -> None:
        """Words of letters alone are one pre-token each, so the library's model gets them without its pre-tokenizer."""
        if not words:
            return
        if self.ranks:
            lead = " " if before else ""
            ids = np.array(self.ranks.encode_ordinary("".join([f"{lead}{w}\n" for w in words])), self.dtype)
            packed, ends, size = ids.tobytes(), np.flatnonzero(ids == self.line_break).tolist(), self.dtype.itemsize
            for w, a, b in zip(words, [-1, *ends], ends, strict=False):
                memo[w] = packed[(a + 1) * size : b * size]
            return
        tokenize, code = self.library.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        shown = "\n".join(words).encode().decode("latin-1").translate(self.shown).split("\n")
        for w, text in zip(words, shown, strict=True):
            memo[w] = array(code, [t.id for t in tokenize(before + text)]).tobytes()

    def _encode_each(self, words: list[str], before: str, memo: dict[str, bytes]) -> None:
        for w, e in zip(words, self.library.encode_batch([before + w for w in words], add_special_tokens=False)):
            memo[w] = np.array(e.ids, self.dtype).tobytes()


def _pre_tokens(word: str) -> list[tuple[bool, str]]:
    """What stands after a space, cut where pre-tokens are certain to be: letters, then marks, then a lone line break."""
    out: list[tuple[bool, str]] = []
    for i, line in enumerate(word.split("\n")):
        core = line.rstrip(_PUNCT)
        if not core.isalpha():
            return [(True, word)]
        if i:
            out.append((False, "\n"))
        out.append((not i, core))
        if len(core) < len(line):
            out.append((False, line[len(core) :]))
    return out


@functools.lru_cache(maxsize=2)
def encoder(vocabulary_file: str) -> TextEncoder:
    """One for each Python worker, which keeps its memos from task to task."""
    return TextEncoder(vocabulary_file)
