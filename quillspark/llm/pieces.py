"""Operator 13: SentencePiece BPE encoding and decoding by a table of prefixes.

A SentencePiece BPE model merges, of all neighbouring symbols whose concatenation is a piece,
the pair with the best score, the leftmost first.  Two facts make this a walk from left to right:

* A row of pieces is the encoding of a text exactly if each two neighbours in it are the encoding
  of what both spell together (are *compatible*): merges inside of a stretch that no merge
  has left so far depend on that stretch alone, and so would the first merge across a border.
* So every prefix of a text has one last piece: of the pieces that end the prefix, the one that is
  compatible with the last piece of the prefix that it leaves.

An Aho-Corasick automaton over all pieces gives the longest piece that ends at each place, and for each
piece the next shorter one; the first compatible one goes into the table, and the ids are recovered
from the end backwards.  Compatibility is tested by merging the two pieces' characters as the model
does, once for each pair that a worker meets.  Pieces that their own text is not encoded as are
left out.  All distinct fragments of a chunk walk side by side in numpy; a text is cut into fragments
between characters that are neighbours inside no piece, so mostly before blanks.

The model may have no normalisation but the blank before the text, as is checked when it is
loaded.  Characters that are no piece fall back to their bytes.

Defined results: a null text counts as empty; an empty text has no ids, so both digests are
those of the empty string; a U+2581 in a text is encoded as a blank and decoded as one;
repeated rows give repeated rows; columns of the input that share a name with an output column are
not read and do not clash; an empty table gives an empty table.  Texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal, kept
from .bpe import PairTable, take_spans
from .textscan import Chunk, chunks, span_hashes

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: The mark that stands for a blank in pieces.
MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_BPE_MODEL = 2
_NEVER = np.iinfo(np.int32).max
#: Bytes of text encoded at once.
CHUNK = 1 << 20
#: Fragments of more bytes walk one by one.
LONG = 64
#: Pairs tested at once, and slots of the table of tested pairs (half of them at most are used).
BLOCK, PAIR_BITS = 8192, 21
_JOIN_BITS = 20


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; other models than plain BPE are refused."""
    with open(path, "rb") as f:
        model = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24)
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3) != _BPE_MODEL or not plain or kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
        raise ValueError("only BPE models without normalisation, with byte fallback and without pieces of the user are supported")
    return pieces


class Pairs:
    """Which pairs of pieces are compatible, as far as tested: an open-addressing table that starts anew when it is half full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.found = np.zeros(1 << PAIR_BITS, bool)
        self.held = 0

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that has each key, or the free one where it belongs."""
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.keys[slot]
        astray = np.flatnonzero((held != keys) & (held != -1))
        while len(astray):
            slot[astray] = (slot[astray] + 1) & ((1 << PAIR_BITS) - 1)
            held = self.keys[slot[astray]]
            astray = astray[(held != keys[astray]) & (held != -1)]
        return slot

    def add(self, keys: np.ndarray, found: np.ndarray) -> None:
        """Keep new, distinct keys."""
        if self.held + len(keys) > 1 << (PAIR_BITS - 1):
            self.clear()
        self.held += len(keys)
        while len(keys):
            slot = self.slots(keys)
            self.keys[slot] = keys
            mine = self.keys[slot] == keys
            self.found[slot[mine]] = found[mine]
            keys, found = keys[~mine], found[~mine]


class PieceBpe:
    """A SentencePiece BPE model with its automaton."""

    def __init__(self, path: str):
        self.pieces = read_model(path)
        self.size = len(self.pieces)
        self.kind = np.array([kind for _, _, kind in self.pieces], np.int8)
        usable = {piece: i for i, (piece, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        if any(MARK in piece.lstrip(MARK) for piece in usable) or any(c not in usable for piece in usable for c in piece):
            raise ValueError("a piece has a blank after other characters, or a character that is no piece")
        spell = [piece.replace(MARK, " ").encode() if i == usable.get(piece) else b"" for i, (piece, _, _) in enumerate(self.pieces)]
        self.byte_id = np.zeros(256, np.int32)
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                spell[i] = bytes([int(piece[3:5], 16)])
        self.token_len = np.array([len(s) for s in spell], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(spell), np.uint8)

        scores = np.array([-score for _, score, _ in self.pieces])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        made = [(usable[p[:k]], usable[p[k:]], i) for p, i in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        left, right, whole = (np.array(x, np.int64) for x in zip(*made, strict=True))
        self.table = PairTable(left, right, whole.astype(np.int32), 4)
        self.merges = {(a, b): c for a, b, c in made}
        chars = [[usable[c] for c in piece] if kind == NORMAL else [] for piece, _, kind in self.pieces]
        self.n_chars = np.array([len(c) for c in chars], np.int64)
        self.char_at = np.cumsum(self.n_chars) - self.n_chars
        self.chars = np.array([c for own in chars for c in own], np.int32)

        #: Characters that are pieces, and (by hash) pairs of them that are neighbours inside a piece.
        self.known = np.zeros(0x110000, bool)
        self.joins = np.zeros(1 << _JOIN_BITS, bool)
        for piece in usable:
            points = np.array([ord(c) for c in piece.replace(MARK, " ")], np.uint32)
            self.known[points] = True
            self.joins[_pair_slot(points[:-1], points[1:])] = True

        normal = np.flatnonzero(self.kind == NORMAL)
        merged = self._merged(normal, None)
        self._automaton([(spell[i], i) for i in normal[(merged[:, 0] == normal) & (merged[:, 1] < 0)].tolist()])
        self.pairs = Pairs()
        self.tested: dict[tuple[int, int], bool] = {}
        digits = [f"{i}," for i in range(self.size)]
        width = max(map(len, digits))
        self.digit_len = np.array([len(d) for d in digits], np.int64)
        self.digits = np.array([list(d.ljust(width).encode()) for d in digits], np.uint8)
        self.digit_mask = np.arange(width)[None, :] < self.digit_len[:, None]

    # -- the automaton -------------------------------------------------------------------

    def _automaton(self, words: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for word, i in words:
            node = 0
            for byte in word:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends[node] = i
        fail, longest = [0] * len(children), [-1] * len(children)
        shorter = np.full(self.size, -1, np.int32)
        front = [0]
        while front:  # level by level
            following = []
            for node in front:
                for byte, child in children[node].items():
                    at = fail[node]
                    while node and at and byte not in children[at]:
                        at = fail[at]
                    fail[child] = children[at].get(byte, 0) if node else 0
                    below = longest[fail[child]]
                    longest[child] = ends.get(child, below)
                    if child in ends:
                        shorter[ends[child]] = below
                    following.append(child)
            front = following
        self.fail, self.longest, self.shorter = np.array(fail, np.int32), np.array(longest, np.int32), shorter
        self.children = children
        edges = [(node << 8 | byte, child) for node, out in enumerate(children) for byte, child in out.items()]
        self.edge_bits = (len(edges) * 4).bit_length()
        self.edge_keys, self.edge_ends = np.full(1 << self.edge_bits, -1, np.int32), np.zeros(1 << self.edge_bits, np.int32)
        keys = np.array([key for key, _ in edges], np.int64)
        for (key, child), slot in zip(edges, self._edge_slot(keys).tolist(), strict=True):
            while self.edge_keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.edge_bits) - 1)
            self.edge_keys[slot], self.edge_ends[slot] = key, child

    def _edge_slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.edge_bits)).astype(np.int64)

    def _advance(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where each node goes by a byte, by failure links where it has no child."""
        out, at, now = np.zeros(len(nodes), np.int32), np.arange(len(nodes)), nodes
        while len(at):
            keys = now << 8 | data
            slot = self._edge_slot(keys)
            held = self.edge_keys[slot]
            astray = np.flatnonzero((held != keys) & (held != -1))
            while len(astray):
                slot[astray] = (slot[astray] + 1) & ((1 << self.edge_bits) - 1)
                held[astray] = self.edge_keys[slot[astray]]
                astray = astray[(held[astray] != keys[astray]) & (held[astray] != -1)]
            hit = held == keys
            out[at[hit]] = self.edge_ends[slot[hit]]
            again = ~hit & (now > 0)
            at, data, now = at[again], data[again], self.fail[now[again]]
        return out

    # -- compatibility -------------------------------------------------------------------

    def _merged(self, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
        """What the characters of each left (and right) piece are merged into, padded with -1; one merge a round."""
        sides = [left] if right is None else [left, right]
        lens = sum(self.n_chars[s] for s in sides)
        rows = np.full((len(left), max(2, int(lens.max(initial=0)) + 1)), -1, np.int32)
        column = 0
        for side in sides:
            n = self.n_chars[side]
            at = np.repeat(np.arange(len(side)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            rows[at, place + (column if np.isscalar(column) else column[at])] = take_spans(self.chars, self.char_at[side], n)
            column = n
        live, places = np.arange(len(rows)), np.arange(rows.shape[1])
        while len(live):
            now = rows[live]
            slot = self.table.find(now[:, :-1].astype(np.int64).ravel(), now[:, 1:].astype(np.int64).ravel())
            there = (self.table.rank[slot] != _NEVER) & (now[:, 1:].ravel() >= 0)
            cost = np.where(there, self.rank[self.table.merged[slot]], _NEVER).reshape(len(live), -1)
            best = cost.argmin(1)
            on = cost[np.arange(len(live)), best] != _NEVER
            live, now, best, slot = live[on], now[on], best[on], slot.reshape(cost.shape)[on]
            now[np.arange(len(live)), best] = self.table.merged[slot[np.arange(len(live)), best]]
            source = np.minimum(places + (places > best[:, None]), rows.shape[1] - 1)
            rows[live] = np.take_along_axis(now, source, 1)
        return rows

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self.pairs.slots(keys)
        fresh = self.pairs.keys[slot] == -1
        if fresh.any():
            new = np.unique(keys[fresh])
            a, b = new >> 32, new & 0xFFFFFFFF
            size = self.n_chars[a] + self.n_chars[b]
            found = np.zeros(len(new), bool)
            order = np.argsort(size, kind="stable")
            for block in np.split(order, range(BLOCK, len(order), BLOCK)):
                rows = self._merged(a[block], b[block])
                found[block] = (rows[:, 0] == a[block]) & (rows[:, 1] == b[block])
            self.pairs.add(new, found)
            known = found[np.minimum(np.searchsorted(new, keys), len(new) - 1)]
            slot = self.pairs.slots(keys)
            return np.where(fresh, known, self.pairs.found[slot]) if (self.pairs.keys[slot] == keys).all() else self.compatible(left, right)
        return self.pairs.found[slot]

    def _compatible_one(self, left: int, right: int) -> bool:
        key = (left, right)
        if key not in self.tested:
            if len(self.tested) > 1 << (PAIR_BITS - 3):
                self.tested.clear()
            symbols = [c for t in key for c in self.chars[self.char_at[t] : self.char_at[t] + self.n_chars[t]].tolist()]
            while True:
                found = [(self.rank[c], k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (c := self.merges.get(pair)) is not None]
                if not found:
                    break
                k = min(found)[1]
                symbols[k : k + 2] = [self.merges[symbols[k], symbols[k + 1]]]
            self.tested[key] = symbols == [left, right]
        return self.tested[key]

    # -- encoding ------------------------------------------------------------------------

    def _fill(self, data: np.ndarray, base: np.ndarray, lens: np.ndarray, edge: np.ndarray, last: np.ndarray) -> None:
        """The last piece of every prefix of many fragments, the longest first, side by side."""
        node = np.zeros(len(base), np.int32)
        for k in range(int(lens[0]) if len(lens) else 0):
            live = int(np.searchsorted(-lens, -k, side="left"))
            at = base[:live] + k
            node[:live] = self._advance(node[:live], data[at].astype(np.int32))
            todo = np.flatnonzero(edge[at])
            piece = self.longest[node[todo]]
            while len(todo):
                start = k + 1 - self.token_len[piece]
                fits = start == 0
                inner = np.flatnonzero(~fits)
                if len(inner):
                    fits[inner] = self.compatible(last[base[todo[inner]] + start[inner] - 1], piece[inner])
                last[base[todo[fits]] + k] = piece[fits]
                todo, piece = todo[~fits], self.shorter[piece[~fits]]
                if len(piece) and piece.min() < 0:
                    raise AssertionError("a prefix without a last piece")

    def _fill_one(self, data: bytes, base: int, last: np.ndarray) -> None:
        """The same for one long fragment."""
        node, own = 0, [-1] * len(data)
        children, fail, length = self.children, self.fail, self.token_len
        for k, byte in enumerate(data):
            while node and byte not in children[node]:
                node = int(fail[node])
            node = children[node].get(byte, 0)
            if k + 1 < len(data) and data[k + 1] & 0xC0 == 0x80:
                continue
            piece = int(self.longest[node])
            while (start := k + 1 - int(length[piece])) and not self._compatible_one(own[start - 1], piece):
                piece = int(self.shorter[piece])
                if piece < 0:
                    raise AssertionError("a prefix without a last piece")
            own[k] = piece
        last[base : base + len(data)] = own

    def _encode(self, data: np.ndarray, lens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many fragments laid end to end, and the number of each; those that are not known are single characters."""
        base = np.cumsum(lens) - lens
        last = np.full(len(data), -1, np.int32)
        edge = np.ones(len(data), bool)
        edge[:-1] = (data[1:] & 0xC0) != 0x80
        edge[base + lens - 1] = True
        short = np.flatnonzero(known & (lens <= LONG))
        short = short[np.argsort(-lens[short], kind="stable")]
        self._fill(data, base[short], lens[short], edge, last)
        for i in np.flatnonzero(known & (lens > LONG)).tolist():
            self._fill_one(data[base[i] : base[i] + lens[i]].tobytes(), int(base[i]), last)
        alone = np.repeat(~known, lens)
        last[alone] = self.byte_id[data[alone]]
        # Back from the ends: where the pieces of the encodings end.
        ends = np.zeros(len(data), bool)
        at = base + lens - 1
        first = base
        while len(at):
            ends[at] = True
            at = at - self.token_len[last[at]]
            on = at >= first
            at, first = at[on], first[on]
        return last[ends], np.add.reduceat(ends.astype(np.int64), base) if len(base) else np.zeros(0, np.int64)

    def marked(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the rows with a blank before each that is not empty, and blanks for marks."""
        buf, offsets, mark = chunk.buf, chunk.offsets, MARK.encode()
        if mark in buf.tobytes():
            at = np.flatnonzero((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2]))
            stay = np.ones(len(buf), bool)
            stay[at + 1] = stay[at + 2] = False
            buf = buf.copy()
            buf[at] = 0x20
            buf, offsets = buf[stay], np.append(0, np.cumsum(stay))[offsets]
        full = np.diff(offsets) > 0
        return np.insert(buf, offsets[:-1][full], 0x20), offsets + np.append(0, np.cumsum(full))

    def fragments(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where fragments begin, and which consist of pieces."""
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero((buf & 0xC0) != 0x80)
        known = self.known[points]
        fresh = np.zeros(len(buf) + 1, bool)
        fresh[offsets] = True
        begin = fresh[byte_at]
        begin[1:] |= ~(known[1:] & known[:-1] & self.joins[_pair_slot(points[:-1], points[1:])])
        return byte_at[begin], known[begin]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole chunk laid end to end, and each row's number of ids."""
        return self.encode_decode(chunk)[:2]

    def encode_decode(self, chunk: Chunk, share: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``encode``, and the bytes that the ids spell, a blank before each row that is not empty.

        ``share=False`` encodes each fragment by itself instead of once per distinct hash; it is what
        a chunk falls back to if two fragments ever share a hash.
        """
        buf, offsets = self.marked(chunk)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(chunk), np.int64), buf
        starts, known = self.fragments(buf, offsets)
        ends = np.append(starts[1:], len(buf))
        lens = ends - starts
        if share:
            _, where, back = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        else:
            where = back = np.arange(len(starts))
        ids, counts = self._encode(take_spans(buf, starts[where], lens[where]), lens[where], known[where])
        each = counts[back]
        out = take_spans(ids, (np.cumsum(counts) - counts)[back], each)
        spelled = take_spans(self.token_bytes, self.token_at[out], self.token_len[out])
        if share and not np.array_equal(spelled, buf):
            return self.encode_decode(chunk, share=False)
        upto = np.append(0, np.cumsum(each))[np.searchsorted(starts, offsets)]
        return out, np.diff(upto), spelled

    def encode_text(self, text: str | None) -> list[int]:
        return self.encode(next(chunks(pa.array([text or ""]))))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: no blank before it, U+FFFD for each byte that is not part of a character."""
        out, run = [], bytearray()

        def flush() -> None:
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[: e.start].decode() + "�")
                    del run[: e.start + 1]

        for i in ids:
            piece, _, kind = self.pieces[i]
            if kind == BYTE:
                run.append(int(piece[3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind == NORMAL:
                text = piece.replace(MARK, " ")
                out.append(text[1:] if not out and text.startswith(" ") else text)
        flush()
        return "".join(out)

    def listed(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, each followed by a comma, as bytes."""
        return self.digits[ids][self.digit_mask[ids]]


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _JOIN_BITS)


@lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


kept("pieces", load.cache_clear)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): the ids of every text.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, counts = own.encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), lists], ["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run, "pieces"), "doc_id bigint, ids array<int>")


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) from rows with the ids of texts; null ids are the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    picked = rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(frugal(run, "pieces"), "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and digest both (``SCHEMA``).  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, counts, spelled = own.encode_decode(chunk)
                stop = np.append(0, np.cumsum(counts))
                text_stop = np.append(0, np.cumsum(own.token_len[ids]))[stop]
                digit_stop = np.append(0, np.cumsum(own.digit_len[ids]))[stop]
                digits, text = own.listed(ids).tobytes(), spelled.tobytes()
                listed = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(digit_stop[:-1], digit_stop[1:], strict=True)]
                decoded = [hashlib.sha256(text[a + 1 : b]).hexdigest() for a, b in zip(text_stop[:-1], text_stop[1:], strict=True)]  # without the blank before the text
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run, "pieces"), SCHEMA)
