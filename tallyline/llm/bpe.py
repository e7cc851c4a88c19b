"""Byte-pair encoding of Arrow text columns with numpy, and decoding, by the files of public tokenizers.

A text is cut into pieces by the rule of its tokenizer, worked out on arrays of character classes. Pieces are cut further
at forced boundaries: two bytes that never stand side by side inside any vocabulary token can never be merged over, so
the cut is certain and the fragments encode independently; their ids are then concatenated. A fragment is looked up by
its hash in a bounded cache, and all fragments of a block that are not there are merged together, one merge a round for
each of them. Fragments longer than WIDE symbols are merged one by one with a heap.

Only two kinds of file are known: byte-level BPE with the rule of PIECES_SPACED, and BPE with word ends with the rule of
PIECES_WORDS. Any other file is refused.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tokenizers

from tallyline.llm.words import Hasher, ragged

# The pre-tokenisation patterns of the two kinds of file.
PIECES_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CONTRACTED = ("s", "t", "m", "d", "re", "ve", "ll")

WIDE = 40
CACHE_SLOTS = 1 << 19
CACHE_IDS = 3 << 20
_NONE = np.int32(2**31 - 1)
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_LAST = np.uint64(0xA5A5A5A55A5A5A5B)


_PAGE = 1024
_classes = np.zeros(0x110000, np.uint8)
_pages = np.zeros(0x110000 // _PAGE, bool)


def char_classes(points: np.ndarray) -> np.ndarray:
    """The classes of code points, as the tokenizers library's own patterns have them; worked out page by page."""
    used = np.zeros(len(_pages), bool)
    used[points // _PAGE] = True
    for page in np.flatnonzero(used & ~_pages):
        index = np.array([c for c in range(page * _PAGE, (page + 1) * _PAGE) if not 0xD800 <= c < 0xE000])
        text = "".join(map(chr, index))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
            for _, (a, b) in cut.pre_tokenize_str(text):
                _classes[index[a:b]] = kind
        _pages[page] = True
    return _classes[points]


def byte_names() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks of symbol pairs in an open-addressed table, and the merging of many fragments at once."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        self.merged = np.array(merged, np.int32)
        self.bits = max(10, (len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        left, right = np.array(pairs, np.uint64).reshape(-1, 2).T
        todo = np.arange(len(pairs))
        keys = (left << np.uint64(32)) | right
        slots = self._slot(keys)
        self.probes = 0
        while len(todo):  # a slot goes to the first that asks for it, the others try the next one
            self.probes += 1
            free = todo[self.keys[slots[todo]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]] = keys[won]
            self.rank[slots[won]] = won
            todo = np.setdiff1d(todo, won)
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        self.of = {p: i for i, p in enumerate(pairs)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.rank[slots], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.rank[slots[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    def merge(self, symbols: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each run of symbols to its end; the ids one after the other, and how many each run has."""
        order = np.argsort(counts, kind="stable")
        out = symbols.copy()
        left = counts.copy()
        at = int(np.searchsorted(counts[order], 2))
        wide = int(np.searchsorted(counts[order], WIDE, "right"))
        while at < wide:
            width = int(counts[order[at]])
            same = int(np.searchsorted(counts[order], width, "right"))
            to = min(same, at + 16384)
            rows = order[at:to]
            block = out[starts[rows][:, None] + np.arange(width)]
            left[rows] = self._square(block)
            out[starts[rows][:, None] + np.arange(width)] = block
            at = to
        for row in order[wide:]:
            ids = self._one(out[starts[row]: starts[row] + counts[row]].tolist())
            out[starts[row]: starts[row] + len(ids)] = ids
            left[row] = len(ids)
        return out[np.repeat(starts, left) + ragged(left)], left

    def _square(self, block: np.ndarray) -> np.ndarray:
        """Merge the rows of a square in place; the number of symbols each row keeps."""
        n, width = block.shape
        counts = np.full(n, width)
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.ranks(block[:, :-1], block[:, 1:])
        columns = np.arange(width)
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(1)
            best = ranks[rows, at]
            on = best != _NONE
            rows, at, best = rows[on], at[on], best[on]
            if not len(rows):
                break
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            sym = np.take_along_axis(block[rows], take, 1)
            rnk = np.take_along_axis(ranks[rows], take, 1)
            rnk[:, -1] = _NONE
            k = np.arange(len(rows))
            sym[k, at] = self.merged[best]
            counts[rows] -= 1
            more = at + 1 < counts[rows]
            rnk[k, at] = _NONE
            rnk[k[more], at[more]] = self.ranks(sym[k[more], at[more]], sym[k[more], at[more] + 1])
            back = at > 0
            rnk[k[back], at[back] - 1] = self.ranks(sym[k[back], at[back] - 1], sym[k[back], at[back]])
            block[rows], ranks[rows] = sym, rnk
        return counts

    def _one(self, symbols: list[int]) -> list[int]:
        """Merge one long run with a heap of (rank, place) over a linked list."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.of[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.of]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or self.of.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] = int(self.merged[rank])
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.of.get((symbols[i], symbols[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.of.get((symbols[before[i]], symbols[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [s for i, s in enumerate(symbols) if not gone[i]]


class Encoder:
    """One tokenizer file: ids of texts, and the decoded text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        self.suffix = model["end_of_word_suffix"] or ""
        if self.suffix:
            steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
            known = steps == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["pattern"] == {"Regex": PIECES_WORDS}
        else:
            known = spec["normalizer"] is None and pre["type"] == "ByteLevel" and not pre["add_prefix_space"]
        if not known or model["type"] != "BPE" or spec["post_processor"] and self.suffix:
            raise ValueError(f"not a known kind of tokenizer file: {path}")
        vocab = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        names = byte_names()
        self.first = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in names], np.int32)
        self.ids = {**vocab, **self.specials}
        byte_of = {c: b for b, c in enumerate(names)}
        #: joined[a, b]: bytes a, b stand side by side in some token; elsewhere a cut is certain.
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [byte_of[c] for c in token.removesuffix(self.suffix)]
            self.joined[raw[:-1], raw[1:]] = True
        self.hasher = Hasher(seed=8)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(CACHE_SLOTS, np.uint64)
        self.where = np.zeros(CACHE_SLOTS, np.int32)
        self.size = np.zeros(CACHE_SLOTS, np.int32)
        self.pool = np.zeros(CACHE_IDS, np.int32)
        self.used = 0

    # -- texts to segments

    def _segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, dict[int, int]]:
        """Texts cut at special tokens: the segments, each text's first one, and the ids of segments that are special."""
        out: list[str] = []
        first, special = [0], {}
        for text in texts:
            if "<|" in text:
                for k, part in enumerate(self.special_pattern.split(text)):
                    if k % 2:
                        special[len(out)] = self.specials[part]
                        out.append(part)
                    elif part:
                        out.append(self._normal(part))
            else:
                out.append(self._normal(text))
            first.append(len(out))
        return out, np.array(first), special

    def _normal(self, text: str) -> str:
        if not self.suffix:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form, whatever follows
        return text.lower()

    def pieces(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece spans in code points, for segments with the given bounds."""
        kinds = char_classes(points)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        inner = bounds[(bounds > 0) & (bounds < n)]
        edge = np.zeros(n + 1, bool)
        edge[0] = edge[n] = True
        edge[inner] = True
        start = edge[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        run = start.copy()
        if self.suffix:
            start |= kinds == _NUMBER
        else:
            heads = np.flatnonzero(run & (kinds != _SPACE) & ~edge[:n])
            heads = heads[kinds[heads - 1] == _SPACE]
            start[heads - 1] = True
            start[heads[points[heads - 1] == 32]] = False
        quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & run[:-1] & (kinds[1:] == _LETTER) & ~edge[1:n])
        if len(quote):
            self._contractions(points, quote, edge, start)
        at = np.flatnonzero(start)
        ends = np.append(at[1:], n)
        if self.suffix:
            full = kinds[at] != _SPACE
            at, ends = at[full], ends[full]
        return at, ends

    @staticmethod
    def _contractions(points, quote, edge, start) -> None:
        n = len(points)
        one = points[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        length = np.zeros(len(quote), np.int64)
        for text in CONTRACTED:
            hit = one == ord(text[0])
            if len(text) == 2:
                hit &= two == ord(text[1])
            length[hit & (length == 0)] = len(text)
        hit = length > 0
        start[quote[hit] + 1] = False
        rest = quote[hit] + 1 + length[hit]
        start[rest[rest < n]] = True

    # -- ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        segments, first, special = self._segments(texts)
        raw = [s.encode() for s in segments]
        data = np.frombuffer(b"".join(raw), np.uint8)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        bounds = np.append(0, np.cumsum([len(s) for s in segments])).astype(np.int64)
        at, ends = self.pieces(points, bounds)
        owner = np.searchsorted(bounds, at, "right") - 1  # the segment of each piece
        at, ends = places[at], places[ends]
        if special:
            # special strings are not to be encoded: their one id is put in below
            plain = ~np.isin(owner, np.fromiter(special, np.int64))
            at, ends, owner = at[plain], ends[plain], owner[plain]
        ids, counts = self._pieces_to_ids(data, at, ends)
        per = np.bincount(owner, counts, len(segments)).astype(np.int64)
        if special:
            spots = np.fromiter(special, np.int64)
            ids = np.insert(ids, np.append(0, np.cumsum(per))[spots], np.fromiter(special.values(), np.int32))
            per[spots] = 1
        return ids, np.diff(np.append(0, np.cumsum(per))[first])

    def _pieces_to_ids(self, data, at, ends) -> tuple[np.ndarray, np.ndarray]:
        n = len(at)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        # fragments: pieces cut where no token joins the two bytes
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1], data[1:]]
        inside = np.zeros(len(data) + 1, np.int32)
        inside[at] += 1
        inside[ends] -= 1
        cut &= np.cumsum(inside) > 0
        cut[at] = True
        starts = np.flatnonzero(cut)
        piece = np.searchsorted(at, starts, "right") - 1
        final = np.append(piece[1:] != piece[:-1], True)
        stops = np.where(final, ends[piece], np.append(starts[1:], 0))
        keys = self.hasher.spans(data, starts, stops) | np.uint64(1)
        if self.suffix:
            keys[final] ^= _LAST << np.uint64(1)
        where, size = self._look_up(data, starts, stops, final, keys)
        ids = self.pool[np.repeat(where, size) + ragged(size)]
        return ids, np.bincount(piece, size, n).astype(np.int64)

    def _look_up(self, data, starts, stops, final, keys) -> tuple[np.ndarray, np.ndarray]:
        """The place and number of each fragment's ids in the pool; what is not there is merged and put there."""
        slots = (keys >> np.uint64(64 - CACHE_SLOTS.bit_length() + 1)).astype(np.int64)
        miss = np.flatnonzero(self.keys[slots] != keys)
        fresh, pick, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
        pick = miss[pick]
        room = int((stops[pick] - starts[pick]).sum())
        if self.used + room > len(self.pool):
            if self.used:
                self._forget()
                return self._look_up(data, starts, stops, final, keys)
            self.pool = np.zeros(room, np.int32)  # one block of texts may need more than the usual pool
        where, size = self.where[slots].astype(np.int64), self.size[slots].astype(np.int64)
        if len(pick):
            lengths = stops[pick] - starts[pick]
            offsets = np.cumsum(lengths) - lengths
            raw = data[np.repeat(starts[pick], lengths) + ragged(lengths)]
            symbols = self.first[raw]
            tail = offsets + lengths - 1
            symbols[tail[final[pick]]] = self.last[raw[tail[final[pick]]]]
            ids, left = self.merges.merge(symbols, offsets, lengths)
            place = self.used + np.cumsum(left) - left
            self.pool[self.used: self.used + len(ids)] = ids
            self.used += len(ids)
            to = slots[pick]
            self.keys[to], self.where[to], self.size[to] = fresh, place, left
            where[miss], size[miss] = place[inverse], left[inverse]
        return where, size

    # -- text of ids

    @property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the file without a decoder: every token's UTF-8 and a space, with the places and lengths by id."""
        if not hasattr(self, "_token_bytes"):
            most = max(self.ids.values()) + 1
            texts = [b""] * most
            for token, i in self.ids.items():
                texts[i] = token.encode() + b" "
            lengths = np.array([len(x) for x in texts])
            self._token_bytes = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths
        return self._token_bytes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids in UTF-8: tokens joined by a space, special tokens among them."""
        body, places, lengths = self.token_bytes
        size = lengths[ids]
        raw = body[np.repeat(places[ids], size) + ragged(size)].tobytes()
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return [raw[a: max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by each Python worker."""
    return Encoder(path)
