"""Exact token ids of whole texts, encoding each distinct chunk once per worker."""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from operator import add

import numpy as np

from costweave.llm.shared import chunks, remembered

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as the machine's own 32-bit integers, which must be little-endian")

#: Chunks of a generation, lines' first words and the longest one kept; they bound a worker's memory.
KEPT, TAILS, LONGEST = 400_000, 200_000, 48
#: Chunks that the library gets as one text, which costs it less than as many texts.
JOINED = 200
#: Letters and then signs: two pieces of every byte-level pre-tokenizer, as the signs hold no apostrophe. All signs of
#: these ranges were letters, or neither letters, digits nor white space, in every version of Unicode.
ENDED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ʯ]+)([!-&(-/:-@\[-`{-~]*)\Z")
NO_MATCH = re.compile(r"(?!)").match


class ChunkEncoder:
    """Gives the little-endian 32-bit ids of texts by the library's own encoder.

    A text is cut where a piece of the pre-tokenizer must begin (see ``chunks``); the library
    encodes each distinct chunk. Chunks are kept in two generations: a full one gets old, and
    what is not asked for again until the next is full is forgotten.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spaced = np.array([t[:1] == b" " for t in token_bytes(path)])
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        unjoined = [r"\s", *map(re.escape, added)]
        #: What a chunk that is encoded beside others must not hold; all match if a token may reach over chunks.
        self.apart = re.compile("" if any(" " in t for t in added) else "|".join(unjoined))
        #: Whether chunks of letters alone need no look at ``apart``.
        self.letters = not any(" " in t or t.isalpha() for t in added)
        stored = json.loads(self.tokenizer.to_str())
        pieces = stored.get("pre_tokenizer") or {}
        #: Whether a single line end between visible signs is a piece of its own, as the byte-level expression has it.
        self.lines = (pieces.get("type") == "ByteLevel" and pieces.get("use_regex", True) and not stored.get("normalizer")
                      and not any(re.search(r"\s", t) for t in added))
        self.begins_line = np.array([t == b"\n" for t in token_bytes(path)])
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        #: Whether signs after letters are a piece of their own, the signs that no such piece may hold, and ids of pieces.
        self.splits = self.lines and self.letters and not pieces.get("add_prefix_space")
        self.unsafe = set("".join(added))
        self.ends: dict[str, bytes] = {}

    def _learn_after(self, need: list[str], into: dict[str, bytes], sign: str, begins: np.ndarray) -> list[str]:
        """Learns chunks that follow ``sign``, many as one text; returns those it did not learn.

        A piece of the pre-tokenizer begins at each of these signs, and there is no other in them, so a
        chunk's ids go from one token that ``begins`` with the sign to the next. A text whose tokens do not
        show that is left to be encoded chunk by chunk.
        """
        left: list[str] = []
        texts = [need[i:i + JOINED] for i in range(0, len(need), JOINED)]
        for start in range(0, len(texts), 100):
            part = texts[start:start + 100]
            coded = self.tokenizer.encode_batch_fast([sign + sign.join(t) for t in part], add_special_tokens=False)
            for text, e in zip(part, coded):
                ids = np.array(e.ids, "<u4")
                starts = np.flatnonzero(begins[np.minimum(ids, len(begins) - 1)])
                if len(starts) != len(text) or starts[0] != 0 or ids.max() >= len(begins):
                    left += text
                    continue
                raw, at = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                into.update(zip(text, [raw[a:b] for a, b in zip(at, at[1:])]))
        return left

    def _end(self, signs: str) -> bytes:
        """The ids of signs after letters, none if they have to stay with the letters."""
        if signs not in self.ends:
            if not signs or len(signs) > LONGEST or not self.unsafe.isdisjoint(signs):
                return b""
            if len(self.ends) > TAILS:
                self.ends.clear()
            coded, = self.tokenizer.encode_batch_fast([signs], add_special_tokens=False)
            self.ends[signs] = array("I", coded.ids).tobytes()
        return self.ends[signs]

    def _cut(self, word: str) -> tuple[str, bytes] | None:
        """A word without the signs at its end, and their ids; None if it can't be encoded beside others."""
        if self.letters and word.isalpha():
            return word, b""
        found = ENDED.match(word) if self.splits else None
        if found:
            end = self._end(found[2])
            if end:
                return found[1], end
        return (word, b"") if word and not self.apart.search(word) else None

    def _learn_joined(self, need: list[str], into: dict[str, bytes]) -> list[str]:
        """Learns chunks that follow a space; returns those it did not learn.

        Words with signs after them or line ends between them are put together of the first word, which follows the
        space, of the others, which each follow a line end, and of the signs: few words are met in so many ways as
        they stand beside signs and others.
        """
        left, plain, cut = [], [], {}
        ended: list[str] = []
        words: list[str] = []
        signs: list[bytes] = []
        match, ends = ENDED.match if self.splits else NO_MATCH, self.ends
        for c in need:
            if self.letters and c.isalpha():
                plain.append(c)
            elif (found := match(c)) and (end := ends.get(found[2]) or self._end(found[2])):
                ended.append(c)
                words.append(found[1])
                signs.append(end)
            elif self.lines and "\n" in c:
                parts = [self._cut(p) for p in c.split("\n")]
                if None in parts:
                    left.append(c)
                else:
                    cut[c] = parts
            elif c and not self.apart.search(c):
                plain.append(c)
            else:
                left.append(c)
        heads = set(words)
        heads.update(parts[0][0] for parts in cut.values())
        left += self._learn_after(plain, into, " ", self.spaced)
        if len(self.heads) > TAILS:
            self.heads = {}
        own: dict[str, bytes] = {}
        new = set(heads)
        for met in (into, self.old, self.heads):
            found = new & met.keys()
            own.update(zip(found, map(met.__getitem__, found)))
            new -= found
        lost = set(self._learn_after(list(new), self.heads, " ", self.spaced))
        new -= lost
        own.update(zip(new, map(self.heads.__getitem__, new)))
        if lost.isdisjoint(words):
            into.update(zip(ended, map(add, map(own.__getitem__, words), signs)))
        else:
            left += [c for c, w in zip(ended, words) if w in lost]
            into.update((c, own[w] + e) for c, w, e in zip(ended, words, signs) if w not in lost)
        if len(self.tails) > TAILS:
            self.tails = {}
        tails = {w for parts in cut.values() for w, _ in parts[1:]}.difference(self.tails)
        self._learn_after(list(tails), self.tails, "\n", self.begins_line)
        for c, ((head, end), *rest) in cut.items():
            found = [self.tails.get(w) for w, _ in rest]
            if head in lost or None in found:
                left.append(c)
            else:
                into[c] = b"".join([own[head], end, *(x for (_, e), f in zip(rest, found) for x in (f, e))])
        for w in [w for w in new if len(w) > LONGEST]:
            self.heads.pop(w, None)
        for t in [t for t in tails if len(t) > LONGEST]:
            self.tails.pop(t, None)
        return left

    def _learn(self, need: list[str], prefix: str, into: dict[str, bytes]) -> None:
        if prefix:
            need = self._learn_joined(need, into)
        for start in range(0, len(need), 20_000):
            part = need[start:start + 20_000]
            coded = self.tokenizer.encode_batch_fast([prefix + c for c in part],
                                                     add_special_tokens=False)
            into.update(zip(part, [array("I", e.ids).tobytes() for e in coded]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()          # strings and bytes have no cycles to look for
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [chunks(t) if t else None for t in texts]
        need: set[str] = set()
        first: dict[str, bytes] = {}
        for c in cut:
            if c:
                need.update(c[1:])
                first[c[0]] = b""
        if len(self.known) > KEPT:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        need.difference_update(known)
        again = need & old.keys()
        known.update(zip(again, map(old.__getitem__, again)))
        need -= again
        self._learn(list(need), " ", known)
        self._learn(list(first), "", first)
        out = [first[c[0]] + b"".join(map(known.__getitem__, c[1:])) if c else b"" for c in cut]
        for c in need:
            if len(c) > LONGEST:
                del known[c]
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process, so that tasks share what it knows."""
    return remembered(("ids", path), lambda: ChunkEncoder(path))


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id, from the byte-level alphabet of the file."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(ch in back for ch in token):
            out[i] = bytes(back[ch] for ch in token)
    return out
