"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type (BPE) SentencePiece vocabulary is applied as the library applies it: characters are the first symbols, an
agenda takes the adjacent pair whose joined piece scores best (the leftmost of equals), and characters outside the
vocabulary fall back to byte pieces. With dropout each candidate merge, named by its document, by its chunk's place in
the document and by where it begins, is divided and ends, is skipped if a keyed hash of that name falls below the rate.
The key comes from the seed and from the document's id, so each occurrence of a word has a segmentation of its own, and
any run gives the same ones. Without dropout the ids are the library's.

Texts fall into chunks (white space and what follows it; line breaks) that no piece reaches across. The ids of a chunk
depend on its characters and on which of its candidates are skipped, and those of frequent chunks are kept by just
that: the hashes of an occurrence's candidates make a set of bits, and the chunk is worked out once for the bits that
its merging looks at. All other occurrences are worked out each by itself: short chunks are merged side by side in
numpy, one merge of each at a time, long ones rank by rank, all merges of a rank at once, in a time that grows with
their length. All read the same hashes.

Decoding joins pieces and bytes and takes the leading space off; it gives the text back whatever was skipped. U+2581,
which stands for a space in pieces, is encoded by bytes, so that it survives. A null text has null ids; an empty one
has none. Rows are handled one by one; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm.shingles import mix

SPACE = "▁"
#: A lone surrogate, which no text holds.
STAND_IN = "\ud800"
CHUNK = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
NEVER = np.iinfo(np.int32).max
LONG, KEPT = 48, 150_000
#: Texts of a run, and their characters, about.
ROWS, CHARACTERS = 128, 1 << 20
#: Chunks that were seen this often (in runs where they stand at least twice), of at most this many symbols and
#: candidates, are kept.
OFTEN, SYMBOLS, BITS = 200, 24, 63
#: Ids under skipped candidates are kept for chunks that lacked them more often than this.
MISSED = 100
#: So many occurrences are worked out at once.
BLOCK = 1 << 14
_M = (1 << 64) - 1


def loaded(model_file: str) -> tuple[object, list[str], list[bytes]]:
    """A model file, its pieces and the bytes that they stand for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = [b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return sp, pieces, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b for i, (p, b) in enumerate(zip(pieces, plain))]


class Vocabulary:
    """Pieces of a model file, and for each pair of pieces the one they merge to and its rank."""

    def __init__(self, model_file: str):
        sp, pieces, self.bytes_of = loaded(model_file)
        n = len(pieces)
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if sp.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte[value] = i
        ids = {pieces[i]: i for i in usual}
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = sorted(usual, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a * 65536 + b, i, rank[i]))
        self.pairs = {k: (i, r) for k, i, r in pairs}
        # A table open to collisions, at most a quarter full; key 0 (no pair of pieces) marks a free place.
        self.shift = np.uint64(62 - len(pairs).bit_length())
        size = 1 << (64 - int(self.shift))
        self.keys, self.merged, self.rank = np.zeros(size, np.uint32), np.full(size, -1, np.int32), np.full(size, NEVER, np.int32)
        key, made, rank_of = (np.array(x, np.int64) for x in zip(*pairs))
        key, at, left = key.astype(np.uint32), self._home(key.astype(np.uint32)), np.arange(len(pairs))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = key[free]  # of several for a place the last one stays
            there = self.keys[at[left]] == key[left]
            done = left[there]
            self.merged[at[done]], self.rank[at[done]] = made[done], rank_of[done]
            left = left[~there]
            at[left] = (at[left] + 1) % size

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What adjacent pieces merge to (-1: nothing) and its rank (NEVER)."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = self._home(key)
        found = self.keys[at]
        off = np.flatnonzero((found != key) & (found != 0))
        while len(off):
            at[off] = (at[off] + 1) % len(self.keys)
            found = self.keys[at[off]]
            off = off[(found != key[off]) & (found != 0)]
        hit = self.keys[at] == key
        merged, rank = self.merged[at], self.rank[at]
        merged[~hit], rank[~hit] = -1, NEVER
        return merged, rank


def named(start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The name of a candidate merge within its chunk."""
    x = mix(start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return mix(x + middle.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + stop.astype(np.uint64))


def skipped(key: np.ndarray, name: np.ndarray, rate: float) -> np.ndarray:
    """The keyed hash of a candidate merge falls below the rate."""
    return (mix(key + name) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < rate


def _slices(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all elements of slices: the slice, the place in it, and the place in what it is a slice of."""
    owner = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, inner, first[owner] + inner


class Shape:
    """A chunk's symbols, its candidates (begin, middle, end) with rank, merged piece and bit, and ids by skipped bits."""

    __slots__ = ("symbols", "candidates", "kept", "missed")

    def __init__(self, symbols: list[int], candidates: dict[tuple[int, int, int], tuple[int, int, int]]):
        self.symbols, self.candidates = symbols, candidates
        self.kept: dict[int, tuple[bytes, int]] = {}
        self.missed = 0

    def walk(self, skip: int) -> tuple[bytes, int]:
        """Ids if just these candidates are skipped, and the candidates that were looked at."""
        ids, ends, looked = list(self.symbols), list(range(len(self.symbols) + 1)), 0
        none = (NEVER, -1)

        def best(i: int) -> tuple[int, int]:
            nonlocal looked
            found = self.candidates.get((ends[i], ends[i + 1], ends[i + 2]))
            if found is None:
                return none
            looked |= 1 << found[2]
            return none if skip >> found[2] & 1 else found[:2]

        pairs = [best(i) for i in range(len(ids) - 1)]
        while pairs:
            i = min(range(len(pairs)), key=lambda k: pairs[k][0])  # the leftmost of equals
            if pairs[i][0] == NEVER:
                break
            ids[i : i + 2] = [pairs[i][1]]
            del ends[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = best(i)
            if i:
                pairs[i - 1] = best(i - 1)
        return array("H", ids).tobytes(), looked


class Encoder:
    """Encodes texts; with ``variants``, documents share that many keys."""

    def __init__(self, model_file: str, seed: int, rate: float, variants: int = 0):
        self.v, self.seed, self.rate, self.variants = vocabulary(model_file), seed, rate, variants
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.shapes: list[Shape | None] = [None]  # number 0: worked out by itself
        self.plain = [b""]
        # where a chunk's candidates begin in names, how many are looked at if none is skipped, how many there are
        self.first, self.looked, self.all = [0], [0], [0]
        self.names = np.zeros(1 << 12, np.uint64)
        self.n_names = self.n_kept = 0

    def _learn(self, chunk: str) -> None:
        """Numbers a chunk; one of too many symbols or candidates gets 0."""
        symbols: list[int] = []
        for c in chunk[: SYMBOLS + 1]:
            i = int(self.v.char[ord(c)])
            symbols += [i] if i >= 0 else self.v.byte[list(SPACE.encode() if c == STAND_IN else c.encode())].tolist()
        n = len(symbols)
        found: dict[tuple[int, int, int], tuple[int, int]] | None = {} if n <= SYMBOLS else None
        if found is not None:
            piece = {(i, i + 1): x for i, x in enumerate(symbols)}
            for size in range(2, n + 1):
                for a in range(n - size + 1):
                    b = a + size
                    for m in range(a + 1, b):
                        left, right = piece.get((a, m)), piece.get((m, b))
                        if left is not None and right is not None and (to := self.v.pairs.get(left * 65536 + right)) is not None:
                            piece[a, b] = to[0]
                            found[a, m, b] = to
                if len(found) > BITS:
                    found = None
                    break
        if found is None:
            self.number[chunk] = 0
            return
        self.number[chunk] = len(self.shapes)
        self.first.append(self.n_names)
        order = list(found)
        shape = Shape(symbols, {c: (found[c][1], found[c][0], bit) for bit, c in enumerate(order)})
        ids, looked = shape.walk(0)
        order = [c for bit, c in enumerate(order) if looked >> bit & 1] + [c for bit, c in enumerate(order) if not looked >> bit & 1]
        shape.candidates = {c: (*shape.candidates[c][:2], bit) for bit, c in enumerate(order)}
        shape.kept[0] = ids, (1 << looked.bit_count()) - 1
        self.shapes.append(shape)
        self.plain.append(ids)
        self.looked.append(looked.bit_count())
        self.all.append(len(order))
        if order:
            stop = self.n_names + len(order)
            if stop > len(self.names):
                self.names = np.concatenate([self.names, np.zeros(max(len(self.names), len(order)), np.uint64)])
            self.names[self.n_names : stop] = named(*np.array(order).T)
            self.n_names = stop

    def _ids(self, shape: Shape, skip: int) -> bytes | None:
        """Ids of a chunk of which these candidates are skipped, by those of them that merging looks at.

        None if they are not kept, until that has happened so often that keeping them pays.
        """
        looked = some = 0
        while True:
            if (found := shape.kept.get(some)) is None:
                shape.missed += 1
                if shape.missed <= MISSED:
                    return None
                found = shape.kept[some] = shape.walk(some)
                self.n_kept += 1
            looked |= found[1]
            if skip & looked == some:
                return found[0]
            some = skip & looked

    def encode(self, rows: list[tuple[int, str]]) -> list[np.ndarray]:
        """Ids of texts, each with its document's key (any integer)."""
        if self.n_kept + len(self.number) > KEPT:
            self._forget()
        if len(self.seen) > KEPT:
            self.seen = {}
        chunks, ends = [], [0]
        for _, text in rows:
            if text:
                text = text.replace(SPACE, STAND_IN) if SPACE in text else text
                chunks += CHUNK.findall(SPACE + text.replace(" ", SPACE))
            ends.append(len(chunks))
        number = self.number
        for c, n in Counter(chunks).items():
            if n > 1 and c not in number and len(c) <= SYMBOLS:
                n += self.seen.get(c, 0)
                if n < OFTEN:
                    self.seen[c] = n
                else:
                    self.seen.pop(c, None)
                    self._learn(c)
        numbers = [number.get(c, 0) for c in chunks]
        plain = self.plain
        out = [plain[t] for t in numbers]
        which = np.array(numbers, np.int64)
        first, looked, every = (np.array(x, np.int64) for x in (self.first, self.looked, self.all))
        own = mix(np.array([((k % self.variants if self.variants else k) + self.seed * 1_000_003) & _M for k, _ in rows], np.uint64))
        size = np.diff(ends)
        keys = np.repeat(own, size) + (np.arange(len(chunks)) - np.repeat(ends[:-1], size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys = mix(keys)
        if self.rate > 0:
            for lo in range(0, len(chunks), BLOCK):
                t, key = which[lo : lo + BLOCK], keys[lo : lo + BLOCK]
                owner, _, at = _slices(first[t], looked[t])
                hit = np.zeros(len(t), bool)
                hit[owner[skipped(key[owner], self.names[at], self.rate)]] = True
                hit = np.flatnonzero(hit)
                if not len(hit):
                    continue
                owner, bit, at = _slices(first[t[hit]], every[t[hit]])
                bits = skipped(key[hit][owner], self.names[at], self.rate).astype(np.uint64) << bit.astype(np.uint64)
                count = every[t[hit]]
                sets = np.bitwise_or.reduceat(bits, np.cumsum(count) - count)
                for i, k, skip in zip((hit + lo).tolist(), t[hit].tolist(), sets.tolist()):
                    if (ids := self._ids(self.shapes[k], skip)) is None:
                        which[i] = 0
                    else:
                        out[i] = ids
        for lo in range(0, len(chunks), BLOCK):
            rest = lo + np.flatnonzero(which[lo : lo + BLOCK] == 0)
            if len(rest):
                for i, ids in zip(rest.tolist(), self._segment([chunks[i] for i in rest.tolist()], keys[rest])):
                    out[i] = ids
        return [np.frombuffer(b"".join(out[a:b]), np.uint16) for a, b in zip(ends, ends[1:])]

    def segment(self, chunks: list[str], key: int) -> list[bytes]:
        """Ids of each chunk, as packed 16-bit numbers, if all stand first in a document of this key."""
        own = mix(np.full(len(chunks), (key + self.seed * 1_000_003) & _M, np.uint64))
        return self._segment(chunks, mix(own))

    def _segment(self, chunks: list[str], hashes: np.ndarray) -> list[bytes]:
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
        symbols = self.v.char[points]
        out = np.flatnonzero(symbols < 0)
        if len(out):
            spread = {}
            for p in np.unique(points[out]):
                raw = SPACE.encode() if p == ord(STAND_IN) else chr(p).encode()
                spread[p] = self.v.byte[list(raw)]
            size = np.ones(len(points), int)
            size[out] = [len(spread[p]) for p in points[out]]
            begin = np.cumsum(size) - size
            wide = np.repeat(symbols, size)
            for i in out:
                wide[begin[i] : begin[i] + size[i]] = spread[points[i]]
            symbols, owner = wide, np.repeat(owner, size)
        counts = np.bincount(owner, minlength=len(chunks))
        first = np.cumsum(counts) - counts
        found: list[bytes] = [b""] * len(chunks)
        for c in np.flatnonzero(counts > LONG):
            found[c] = self._by_rank(symbols[first[c] : first[c] + counts[c]], hashes[c])
        short = counts[owner] <= LONG
        at, ids = self._side_by_side(symbols[short], owner[short], (np.arange(len(owner)) - first[owner])[short], hashes)
        if len(at) == len(found):
            return ids
        for i, x in zip(at, ids):
            found[i] = x
        return found

    def _candidates(self, a, b, start, middle, stop, key) -> tuple[np.ndarray, np.ndarray]:
        merged, rank = self.v.look_up(a, b)
        some = np.flatnonzero(rank < NEVER)
        if self.rate > 0 and len(some):
            drop = skipped(key[some], named(start[some], middle[some], stop[some]), self.rate)
            rank[some[drop]] = NEVER
        return merged, rank

    def _side_by_side(self, symbol, owner, start, hashes) -> tuple[list[int], list[bytes]]:
        """Chunks and their ids, all at once: a round does the best merge of each; chunks without one are done."""
        n = len(symbol)
        if not n:
            return [], []
        owner, start = owner.astype(np.int32), start.astype(np.int32)
        stop = start + np.int32(1)
        merged, rank = np.full(n, -1, np.int32), np.full(n, NEVER, np.int32)
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        if len(pair):
            merged[pair], rank[pair] = self._candidates(symbol[pair], symbol[pair + 1], start[pair], start[pair + 1], stop[pair + 1], hashes[owner[pair]])
        done_symbols, done_owners = [], []
        while len(symbol):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(head, len(symbol)))
            best = np.minimum.reduceat(rank, head)
            over = np.repeat(best == NEVER, size)
            if over.any():
                done_symbols.append(symbol[over])
                done_owners.append(owner[over])
                left = np.flatnonzero(~over)
                symbol, owner, start, stop, merged, rank = (x.take(left) for x in (symbol, owner, start, stop, merged, rank))
                size, best = size[best < NEVER], best[best < NEVER]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            symbol[at], stop[at] = merged[at], stop[at + 1]
            left = np.ones(len(symbol), bool)
            left[at + 1] = False
            left = np.flatnonzero(left)
            symbol, owner, start, stop, merged, rank = (x.take(left) for x in (symbol, owner, start, stop, merged, rank))
            at -= np.arange(len(at))
            redo = np.zeros(len(symbol), bool)
            redo[at] = redo[at[at > 0] - 1] = True
            redo = np.flatnonzero(redo)
            inside = np.zeros(len(redo), bool)
            some = redo < len(symbol) - 1
            inside[some] = owner[redo[some]] == owner[redo[some] + 1]
            rank[redo[~inside]] = NEVER
            pair = redo[inside]
            if len(pair):
                merged[pair], rank[pair] = self._candidates(symbol[pair], symbol[pair + 1], start[pair], start[pair + 1], stop[pair + 1], hashes[owner[pair]])
        symbols, owners = np.concatenate(done_symbols), np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        symbols, owners = symbols[order].astype(np.uint16).tobytes(), owners[order]
        head = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        ends = np.append(2 * head, len(symbols)).tolist()
        return owners[head].tolist(), [symbols[a:b] for a, b in zip(ends, ends[1:])]

    def _by_rank(self, symbols: np.ndarray, key: np.uint64) -> bytes:
        """Merges of the best rank side by side, a stretch from the left, as far as none makes a better one possible.

        Stretches grow while that does not happen and shrink where it does, so that little is looked at twice.
        """
        n = len(symbols)
        symbol = symbols.astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        merged, rank = np.full(n, -1, np.int32), np.full(n, NEVER, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}  # sorted places by rank
        stretch: dict[int, int] = {}
        ranks: list[int] = []

        def ranked(left_symbol, right_symbol, left, middle, stop) -> tuple[np.ndarray, np.ndarray]:
            return self._candidates(left_symbol, right_symbol, left, middle, stop, np.full(len(left), key))

        def wait(r: int, at: np.ndarray) -> None:
            if r not in waiting:
                heapq.heappush(ranks, r)
            waiting.setdefault(r, []).append(at)

        def offer(at: np.ndarray) -> None:
            """Ranks the pairs that begin at these places anew."""
            rank[at] = NEVER
            at = at[after[at] < n]
            middle = after[at]
            merged[at], rank[at] = ranked(symbol[at], symbol[middle], at, middle, after[middle])
            at = at[rank[at] < NEVER]
            at = at[np.argsort(rank[at], kind="stable")]
            edge = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, edge) if len(at) else ():
                wait(int(rank[part[0]]), part)

        offer(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            places = sorted(waiting.pop(r), key=len)
            if len(places) > 8:
                places = [np.unique(np.concatenate(places[:-1])), places[-1]]
            most = stretch.setdefault(r, 4096)
            if len(places[-1]) > most:
                taken = [np.searchsorted(p, places[-1][most - 1], "right") for p in places]
                for p, k in zip(places, taken):
                    if k < len(p):
                        wait(r, p[k:])
                places = [p[:k] for p, k in zip(places, taken)]
            at = places[0] if len(places) == 1 else np.unique(np.concatenate(places))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of pairs that share a symbol every second one, from the left.
            new_run = np.concatenate([[True], after[at][:-1] != at[1:]])
            run = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            i = at[(np.arange(len(at)) - run) % 2 == 0]
            k, m = after[after[i]], merged[i]
            # Each merge's neighbours when its turn comes: on the left merged, on the right not yet.
            touching = np.concatenate([[False], k[:-1] == i[1:]])
            left = np.where(touching, np.concatenate([[-1], i[:-1]]), before[i])
            better = np.zeros(len(i), bool)
            some = np.flatnonzero(left >= 0)
            left_symbol = np.where(touching, np.concatenate([[-1], m[:-1]]), symbol[left])
            better[some] = ranked(left_symbol[some], m[some], left[some], i[some], k[some])[1] < r
            some = np.flatnonzero(k < n)
            better[some] |= ranked(m[some], symbol[k[some]], i[some], k[some], after[k[some]])[1] < r
            stretch[r] *= 2
            if better.any():
                last = int(np.argmax(better)) + 1
                stretch[r] = max(64, 2 * last)
                if len(rest := at[at > i[last - 1]]):
                    wait(r, rest)
                i, k, m = i[:last], k[:last], m[:last]
            middle = after[i]
            symbol[i], symbol[middle], rank[middle] = m, -1, NEVER
            after[i] = k
            before[k[k < n]] = i[k < n]
            left = before[i]
            offer(np.unique(np.concatenate([i, left[left >= 0]])))
        return symbol[symbol >= 0].astype(np.uint16).tobytes()


@lru_cache(4)
def encoder(model_file: str, seed: int, rate: float) -> Encoder:
    return Encoder(model_file, seed, rate)


@lru_cache(2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def encode(docs: DataFrame, model_file: str, key: str | Column = "doc_id", seed: int = 0, dropout: float = 0.1, column: str = "ids") -> DataFrame:
    """``docs`` with the ids of text in ``column``; the document's key and the seed choose the merges that are skipped."""
    key = F.col(key) if isinstance(key, str) else key

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = encoder(model_file, seed, dropout)
        for keys, texts in columns:
            found, run, size = [], [], 0
            for k, t in zip(keys, texts):
                run.append((k.as_py(), t.as_py() or ""))
                size += len(run[-1][1])
                if len(run) == ROWS or size > CHARACTERS:
                    found += own.encode(run)
                    run, size = [], 0
            found += own.encode(run)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.uint16), *found]).astype(np.int32))
            del found
            yield pa.ListArray.from_arrays(pa.array(offsets), values, mask=texts.is_null())
            pa.default_memory_pool().release_unused()

    return docs.withColumn(column, ids(F.xxhash64(F.lit(seed), key), F.col("text").cast("string")))


@lru_cache(2)
def piece_bytes(model_file: str) -> pa.LargeBinaryArray:
    return pa.array(loaded(model_file)[2], pa.large_binary())


def _texts(lists: pa.ListArray, size: np.ndarray, pieces: pa.LargeBinaryArray) -> list[str | None]:
    """Texts of rows: the bytes of all their pieces lie end to end, so that a row's text is a slice of them."""
    taken = pieces.take(lists.flatten())
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
    raw = memoryview((taken.buffers()[2] if len(taken) else None) or b"")
    cut = ends[np.cumsum([0, *size])].tolist()
    given = lists.is_valid().to_pylist()
    return [str(raw[a:b], "utf-8", "replace")[1:] if is_text else None for a, b, is_text in zip(cut, cut[1:], given)]


def decode(encoded: DataFrame, model_file: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids stand for."""

    @F.arrow_udf("string")
    def text(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = piece_bytes(model_file)
        for lists in columns:
            size = lists.value_lengths().fill_null(0).to_numpy()
            out, lo, n = [], 0, 0
            for hi, k in enumerate(size.tolist(), 1):
                n += k
                if hi - lo == ROWS or n > CHARACTERS or hi == len(size):
                    out += _texts(lists.slice(lo, hi - lo), size[lo:hi], pieces)
                    lo, n = hi, 0
            yield pa.array(out, pa.string())
            pa.default_memory_pool().release_unused()

    return encoded.withColumn(column, text(F.col(ids)))
