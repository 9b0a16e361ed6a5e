"""Exact token counts of every prefix of a text, by dynamic programming over byte positions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from costweave.llm.shared import chunks, slices
from costweave.llm.tokens import ENDED, token_bytes

#: How the byte-level vocabulary's library cuts a text into pieces before it merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WHITE = regex.compile(r"\s+")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
#: Chunks, and pieces, of a generation, and the longest one, that a worker remembers.
KEPT, LONGEST = 350_000, 48
#: Words whose positions are worked on at once, and the longest that are.
BATCH, WIDE = 20_000, 48


class Table:
    """From numbers of 0 and above to others, -1 where there is none: open addressing in arrays, a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = (4 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        at = self._place(keys)
        while len(keys):                      # one of those that want a free place gets it, the others go on
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


class Merges:
    """What merging needs of a vocabulary, as arrays: a trie of the tokens, merges by pair, and the
    rank at which each token comes to be (-1 for single bytes)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.special = sorted((t["content"] for t in stored["added_tokens"]), key=len, reverse=True)
        size = max(vocab.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs = np.zeros((len(merges), 2), np.int64)
        for r, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = vocab[a + b]
            pairs[r] = vocab[a], vocab[b]
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = r, vocab[a], vocab[b]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        keys, first = np.unique(keys, return_index=True)
        self.pairs = Table(keys, first)
        nodes, next_node, token = {}, 1, [-1]
        for i, data in enumerate(token_bytes(path)):
            node = 0
            for byte in data:
                step = node << 8 | byte
                if step not in nodes:
                    nodes[step] = next_node
                    next_node += 1
                    token.append(-1)
                node = nodes[step]
            if data:
                token[node] = i
        self.to = Table(np.fromiter(nodes.keys(), np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.token = np.array(token, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, -1 where there is none."""
        return self.pairs[a << 32 | b]

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of a and then b are encoded as just these two tokens.

        Merging happens in order of rank. Undone step by step, the token formed last first, the
        parts next to the seam are the pairs that ever met there. A merge across the seam
        would have come first if its rank is below that of the steps that used up either
        part; between equal ranks the one further left wins.
        """
        ok = np.ones(len(a), bool)
        index = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), 1 << 40)
        until_b = np.full(len(a), 1 << 40)
        while len(index):
            m = self.pair_rank(a, b)
            crossed = (m >= 0) & (m < until_a) & (m <= until_b)
            ok[index[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            index, a, b, until_a, until_b, ra, rb = (x[go] for x in (index, a, b, until_a, until_b, ra, rb))
            undo_a = ra > rb
            until_a = np.where(undo_a, ra, until_a)
            until_b = np.where(undo_a, until_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def changes(self, pieces: list[bytes]) -> list[tuple[int, bytes]]:
        """For each piece its token count, and for each byte how the count of the prefix up to it
        differs from that of the prefix before it.

        A prefix ends in exactly one token that stands well beside the last token of the prefix
        before it, so one pass over the positions finds last tokens and counts.
        """
        out: list[tuple[int, bytes]] = [(0, b"")] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        at = 0
        while at < len(order):
            part = order[at:at + BATCH]
            if len(pieces[part[-1]]) > WIDE:
                part = order[at:at + max(1, BATCH * WIDE // (len(pieces[part[-1]]) + 1))]
            at += len(part)
            for i, c in zip(part, self._batch([pieces[i] for i in part])):
                out[i] = c
        return out

    def _batch(self, pieces: list[bytes]) -> list[tuple[int, bytes]]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(size.max(initial=0))
        if not wide:
            return [(0, b"")] * len(pieces)
        text = np.zeros((len(pieces), wide), np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        text[np.arange(wide) < size[:, None]] = flat
        row, start = np.nonzero(np.arange(wide) < size[:, None])
        node, end = np.zeros(len(row), np.int64), start.copy()
        edges: list[tuple] = []
        while len(row):                       # every token that lies in a piece
            node = self.to[node << 8 | text[row, end]]
            go = node >= 0
            row, start, end, node = row[go], start[go], end[go] + 1, node[go]
            token = self.token[node]
            real = token >= 0
            edges.append((row[real], start[real], end[real], token[real]))
            go = end < size[row]
            row, start, end, node = row[go], start[go], end[go], node[go]
        row, start, end, token = (np.concatenate(x) for x in zip(*edges))
        order = np.argsort(end, kind="stable")
        row, start, end, token = row[order], start[order], end[order], token[order]
        cut = np.searchsorted(end, np.arange(1, wide + 2))
        last = np.full((len(pieces), wide + 1), -1, np.int64)
        count = np.zeros((len(pieces), wide + 1), np.int64)
        for i in range(1, wide + 1):
            r, s, t = (x[cut[i - 1]:cut[i]] for x in (row, start, token))
            whole = s == 0
            last[r[whole], i], count[r[whole], i] = t[whole], 1
            todo = ~whole & (last[r, i] < 0)
            r, s, t = r[todo], s[todo], t[todo]
            good = self.side_by_side(last[r, s], t)
            r, s, t = r[good], s[good], t[good]
            last[r, i], count[r, i] = t, count[r, s] + 1
        change = np.diff(count, axis=1)
        if np.abs(change, where=np.arange(wide) < size[:, None], out=np.zeros_like(change)).max() > 127:
            raise OverflowError("a step of the count does not fit a signed byte")
        change = change.astype(np.int8)
        total = count[np.arange(len(pieces)), size].tolist()
        return [(total[k], change[k, :n].tobytes()) for k, n in enumerate(size.tolist())]


class PrefixCounter:
    """Prefix counts of whole texts; each distinct chunk is worked on once while memory lasts.

    A chunk's entry has, for each of its bytes, how the token count of the prefix that ends there
    differs from that of the one before (one signed byte; the count can fall). Their sum is the chunk's count.
    """

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        self.special = (regex.compile("|".join(map(regex.escape, self.merges.special)))
                        if self.merges.special else None)
        #: Chunks whose prefixes need a look at their parts.
        self.odd = re.compile("|".join([r"(?s:'|<\||(?<=.)\s)", *map(re.escape, self.merges.special)]))
        #: Whether words with signs after them and line ends between them are cut without a look at special strings, but
        #: for the signs that these hold.
        self.simple = not any(t.isalpha() or WHITE.search(t) for t in self.merges.special)
        self.unsafe = set("".join(self.merges.special))
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, tuple[int, bytes]] = {s: (1, b"") for s in self.merges.special}
        self.old_pieces: dict[str, tuple[int, bytes]] = {}

    def _pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token's string is a piece of its own."""
        if self.special is None or not self.special.search(text):
            return PIECES.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*PIECES.findall(text[at:m.start()]), m.group()]
            at = m.end()
        return out + PIECES.findall(text[at:])

    def _words(self, prefix: str, chunk: str) -> list[str] | None:
        """The pieces of words with signs after them and single line ends between them, of which every prefix is cut
        like the whole; None for other chunks."""
        out: list[str] = []
        for part in chunk.split("\n") if self.simple else ("",):
            found = ENDED.match(part)
            if not found or not self.unsafe.isdisjoint(found[2]):
                return None
            out.append(prefix + found[1])
            if found[2]:
                out.append(found[2])
            out.append("\n")
            prefix = ""
        return out[:-1]

    def _parts(self, text: str) -> list[tuple]:
        """The text cut once, as parts of which ``_steps`` puts the prefixes together.

        A prefix is cut like the whole up to its last pieces. Those differ where it ends in a run of
        white space, which is then one piece, whereas the whole leaves the run's last sign to what
        follows; inside a contraction; and inside a special string, with the piece before.
        Parts: a plain piece; a contraction or special string with the piece before it that may
        change ("" if none) and the pieces at each of its signs; a run with its pieces in the
        whole (the next piece's space is in the run, too).
        """
        parts: list[tuple] = []

        def segment(part: str) -> str:
            pieces, at = PIECES.findall(part), 0
            while at < len(pieces):
                piece = pieces[at]
                at += 1
                if WHITE.fullmatch(piece):
                    own = [piece]
                    while at < len(pieces) and WHITE.fullmatch(pieces[at]):
                        own.append(pieces[at])
                        at += 1
                    joins = at < len(pieces) and pieces[at][0] == " "
                    run = "".join(own) + (pieces[at][0] if joins else "")
                    parts.append(("run", run, own))
                elif piece in CONTRACTIONS:
                    parts.append(("inside", "", [(piece[n - 1], PIECES.findall(piece[:n])) for n in range(1, len(piece) + 1)]))
                else:
                    parts.append(("plain", piece))
            return pieces[-1] if pieces else ""

        at = 0
        for m in self.special.finditer(text) if self.special else ():
            last = segment(text[at:m.start()])
            start = m.start() - len(last)
            parts.append(("inside", last, [(text[n - 1], self._pieces(text[start:n]))
                                           for n in range(m.start() + 1, m.end() + 1)]))
            at = m.end()
        segment(text[at:])
        return parts

    @staticmethod
    def _wanted(parts: list[tuple]) -> Iterator[str]:
        for kind, *rest in parts:
            if kind == "plain":
                yield rest[0]
            elif kind == "run":
                yield rest[0]
                yield from rest[1]
            else:
                if rest[0]:
                    yield rest[0]
                for _, pieces in rest[1]:
                    yield from pieces

    def _steps(self, parts: list[tuple]) -> bytes:
        """The steps of the text: ``settled`` is the count of the whole's pieces so far, and
        ``now`` that of the prefix so far."""
        known, out = self.pieces, bytearray()
        settled = now = skip = 0
        for kind, *rest in parts:
            if kind == "inside":
                before = settled - (known[rest[0]][0] if rest[0] else 0)
                for sign, pieces in rest[1]:
                    whole = before + sum(known[p][0] for p in pieces)
                    out += bytes([(whole - now) & 255]) + bytes(len(sign.encode()) - 1)
                    now = whole
                settled = now
                continue
            count, steps = known[rest[0]]
            if kind == "plain":
                # What the run before has taken of this piece is counted, and differs by ``now``.
                ahead = sum(s - 256 if s > 127 else s for s in steps[:skip])
                own = bytearray(steps[skip:])
                own[0] = (own[0] + settled + ahead - now) & 255
                out += own
                settled = now = settled + count
                skip = 0
            else:
                out += steps
                now = settled + count
                settled += sum(known[p][0] for p in rest[1])
                skip = len(rest[0].encode()) - sum(len(p.encode()) for p in rest[1])
        return bytes(out)

    def _learn(self, need: list[str], prefix: str, into: dict[str, bytes]) -> None:
        single: dict[str, str] = {}
        views: dict[str, list[str]] = {}
        odd: dict[str, list[tuple]] = {}
        wanted: set[str] = set()
        for chunk in need:
            text = prefix + chunk
            if chunk.isascii() and chunk.isalpha():      # letters and the space before them are one piece
                single[chunk] = text
            elif (own := self._words(prefix, chunk)) is not None:
                views[chunk] = own
                wanted.update(own)
            elif self.odd.search(text):
                odd[chunk] = self._parts(text)
                wanted.update(self._wanted(odd[chunk]))
            else:
                views[chunk] = own = PIECES.findall(text)
                wanted.update(own)
        wanted.update(single.values())
        if len(self.pieces) > KEPT:
            self.old_pieces = self.pieces
            self.pieces = {s: (1, b"") for s in self.merges.special}
        known = self.pieces
        wanted.difference_update(known)
        again = wanted & self.old_pieces.keys()
        known.update((p, self.old_pieces[p]) for p in again)
        new = list(wanted - again)
        known.update(zip(new, self.merges.changes([p.encode() for p in new])))
        for chunk, piece in single.items():
            into[chunk] = known[piece][1]
        for chunk, own in views.items():
            into[chunk] = b"".join([known[p][1] for p in own])
        for chunk, parts in odd.items():
            into[chunk] = self._steps(parts)
        for p in new:
            if len(p) > LONGEST:
                del known[p]

    def count(self, texts: list[str | None]) -> list[tuple[int, bytes]]:
        """Token count and prefix steps of each text."""
        cut = [chunks(t) if t else None for t in texts]
        need: set[str] = set()
        first: dict[str, bytes] = {}
        for c in cut:
            if c:
                first[c[0]] = b""
                need.update(c[1:])
        if len(self.known) > KEPT:
            self.known, self.old = {}, self.known
        need.difference_update(self.known)
        again = need & self.old.keys()
        self.known.update((c, self.old[c]) for c in again)
        need -= again
        self._learn(list(need), " ", self.known)
        self._learn(list(first), "", first)
        out = []
        for c in cut:
            steps = b"" if not c else first[c[0]] + b"".join(map(self.known.__getitem__, c[1:]))
            out.append((tokens_before(steps, len(steps)) if steps else 0, steps))
        for c in need:
            if len(c) > LONGEST:
                del self.known[c]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def tokens_before(steps: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of so many bytes (at a character's end), from the stored steps."""
    return int(np.frombuffer(steps, np.int8, n_bytes).sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens, from the stored steps.

    Where it ends inside a character, the character has to be left out as well.
    """
    counts = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, tokenizer: str, budget: int, keep_steps: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, fits_bytes (of the longest prefix within ``budget`` tokens) of
    every whole text, and with ``keep_steps`` the table of all its prefixes, which
    ``tokens_before`` and ``longest_within`` read.

    Counts are the tokenizer's own for byte-level vocabularies, without added tokens; its special
    strings count as one token. Null and empty texts have none. Rows with null or repeated
    doc_ids get theirs like others. An empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in slices(batches):
            found = own.count(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array([len(s) for _, s in found], pa.int64()),
                       pa.array([n for n, _ in found], pa.int64()),
                       pa.array([len(s) if n <= budget else longest_within(s, budget) for n, s in found],
                                pa.int64())]
            names = ["doc_id", "n_bytes", "n_tokens", "fits_bytes"]
            if keep_steps:
                columns.append(pa.array([s for _, s in found], pa.binary()))
                names.append("steps")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_bytes long, n_tokens long, fits_bytes long"
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, schema + (", steps binary" if keep_steps else "")))
