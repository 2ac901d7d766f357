"""Task-side byte-pair encoding: vectorized splitting into words, then batched merge rounds."""

from __future__ import annotations

import json

import numpy as np
import regex

from tokenloom.llm import byte_words as bw

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
# The contractions that the byte-level splitting pattern takes as pieces.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SYMBOL_LIMIT = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next free code point."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for at, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + at)
    return [table[b] for b in range(256)]


def code_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point."""
    classes = np.zeros(0x110000, np.uint8)
    patterns = [(regex.compile(name), kind) for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK))]
    for base in range(0, 0x110000, 1 << 12):
        if 0xD800 <= base < 0xE000:
            continue
        part = "".join(map(chr, range(base, base + (1 << 12) if base != 0xD000 else 0xD800)))
        for pattern, kind in patterns:
            for m in pattern.finditer(part):
                classes[base + m.start():base + m.end()] = kind
    # The pattern engine's white space leaves these separators out.
    classes[0x1C:0x20] = OTHER
    return classes


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary file's content."""

    def __init__(self, content: str):
        table = json.loads(content)
        vocab, merges = table["model"]["vocab"], table["model"]["merges"]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        value = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in table.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, at in vocab.items():
            self.token_bytes[at] = bytes(value[c] for c in token)
        for token, at in self.special.items():
            self.token_bytes[at] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True)  # a repeated pair keeps its last rank
        order = order[last]
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int64)
        self.made = made
        self.classes = code_classes()
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.flat_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    # --- splitting ---------------------------------------------------------------------------

    def word_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions where words of the byte-level pattern begin; rows never share a word."""
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)  # byte position of each code point
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[codes]
        n = len(codes)
        row_start = np.zeros(n + 1, bool)
        row_start[np.searchsorted(at, offsets)] = True
        first = row_start[:-1]  # code point begins a row
        follows = row_start[1:]  # the next one begins a row
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 255, kind[:-1]
        before[first] = 255
        start = first | (kind != before)
        blank = kind == BLANK
        # the last white space of a run before a word starts a piece; a plain space joins that word
        nonblank_next = np.zeros(n, bool)
        nonblank_next[:-1] = ~blank[1:]
        tail = blank & nonblank_next & ~follows
        start |= tail
        joins = np.zeros(n, bool)
        joins[1:] = tail[:-1] & (codes[:-1] == 32)
        start &= ~joins
        self._contractions(codes, start, first)
        return at[start]

    @staticmethod
    def _contractions(codes: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
        """A contraction is a piece where its apostrophe begins one; what follows begins the next."""
        quotes = np.flatnonzero((codes == 39) & start)
        n = len(codes)
        for q in quotes.tolist():
            if not start[q]:
                continue
            tail = codes[q + 1:q + 3]
            word = "".join(map(chr, tail.tolist()))
            if q + 1 < n and first[q + 1]:
                continue
            for c in CONTRACTIONS:
                if word.startswith(c[1:]) and not (len(c) == 3 and first[q + 2]):
                    start[q + 1:q + len(c)] = False
                    if q + len(c) < n:
                        start[q + len(c)] = True
                    break

    # --- merging -----------------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], np.int64(1 << 40))

    def merge_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and each word's token count."""
        lengths = ends - starts
        word = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbols = self.byte_id[data[np.repeat(starts, lengths) + place]]
        done_word, done_symbol = [], []
        none = np.int64(1 << 40)
        rank = np.full(len(symbols), none)
        if len(symbols) > 1:
            same = word[1:] == word[:-1]
            rank[:-1][same] = self._rank(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(heads, len(word)))
            best = np.minimum.reduceat(rank, heads)
            active = best < none
            if not active.all():
                live = np.repeat(active, counts)
                done_word.append(word[~live])
                done_symbol.append(symbols[~live])
                word, symbols, rank = word[live], symbols[live], rank[live]
                counts, best = counts[active], best[active]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, counts)
            hit = self._leftmost(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            word, symbols, rank = word[keep], symbols[keep], rank[keep]
            at = moved[at]
            changed = np.zeros(len(symbols) + 1, bool)
            changed[at] = True
            changed[at - 1] = True  # -1 wraps to the spare entry
            touched = np.flatnonzero(changed[:-1])
            rank[touched] = none
            inner = touched[touched + 1 < len(symbols)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(starts))

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of hits in a row (as in a run of one symbol), every other one from the left."""
        at = np.flatnonzero(hit)
        if len(at) < 2 or not (np.diff(at) == 1).any():
            return hit
        run = np.cumsum(np.append(True, np.diff(at) != 1)) - 1
        begin = np.flatnonzero(np.append(True, np.diff(run) != 0))
        odd = (np.arange(len(at)) - begin[run]) % 2 == 1
        out = hit.copy()
        out[at[odd]] = False
        return out

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array and the n + 1 row offsets; special tokens are ordinary text."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        starts = self.word_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = bw.span_hash(bw.prefix_hash(data), starts, ends)
        _, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        parts, sizes = [], []
        lengths = (ends - starts)[once]
        cut = np.flatnonzero(np.append(True, np.diff(np.cumsum(lengths) // SYMBOL_LIMIT) > 0))
        for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(once)], strict=True):
            ids, counts = self.merge_words(data, starts[once[low:high]], ends[once[low:high]])
            parts.append(ids)
            sizes.append(counts)
        ids, counts = np.concatenate(parts), np.concatenate(sizes)
        begin = np.cumsum(counts) - counts
        n = counts[which]
        total = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])
        return ids[take], total[np.searchsorted(starts, offsets)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each row. Added tokens in a text become their ids; the text around them is encoded."""
        raw = data.tobytes()
        marks = [s.encode() for s in self.special if s.encode() in raw]
        if not marks:
            ids, rows = self.encode_slice(data, offsets)
            return [ids[a:b] for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        cuts, owner, fixed = [], [], {}
        for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text, at = raw[low:high].decode(), 0
            for m in [*self.special_pattern.finditer(text), None]:
                piece = text[at:m.start()] if m else text[at:]
                cuts.append(piece.encode())
                owner.append(row)
                if m:
                    fixed[len(cuts) - 1] = self.special[m[0]]
                    at = m.end()
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cuts])]).astype(np.int64)
        ids, rows = self.encode_slice(np.frombuffer(b"".join(cuts), np.uint8), bounds)
        out: list[list[np.ndarray]] = [[] for _ in range(len(offsets) - 1)]
        for i, row in enumerate(owner):
            out[row].append(ids[rows[i]:rows[i + 1]])
            if i in fixed:
                out[row].append(np.array([fixed[i]], np.int64))
        return [np.concatenate(parts) for parts in out]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids' bytes; bytes that are no UTF-8 become replacement characters."""
        n = self.lengths[ids]
        total = np.cumsum(n)
        if not len(ids) or not total[-1]:
            return ""
        take = np.repeat(self.starts[ids] - (total - n), n) + np.arange(total[-1])
        return self.flat_bytes[take].tobytes().decode("utf-8", "replace")
