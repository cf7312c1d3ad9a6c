"""Operator 1: byte-level BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side inside no vocabulary token can
never end up in one token, whatever is merged around them.  Such pairs, and the
pre-tokeniser's borders, are certain cuts.  A text is cut there, every distinct
fragment of a chunk is encoded once (all fragments together, one merge rank at a
time, in numpy), and the ids of the fragments are laid end to end.

Defined results: a null text counts as empty; an empty text has no ids, so both
digests are those of the empty string; repeated rows give repeated rows; columns
of the input that share a name with an output column are not read and do not
clash; an empty table gives an empty table.  Texts of any length are encoded
whole.  A string of an added token inside a text becomes that token's id.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal, kept
from .textscan import Chunk, chunks, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSEEN = 0, 1, 2, 3, 255
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NO_RANK = np.int32(2**31 - 1)
#: Bytes of text encoded at once.
CHUNK = 1 << 20

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class PairTable:
    """Open-addressing table from a pair of ids to (rank, merged id), probed in bulk."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, room: int = 16):
        """``room``: slots for each pair, or up to twice as many."""
        self.bits = max(8, int(len(left) * room).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        for i, (k, s) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
            while self.keys[s] not in (-1, k):
                s = (s + 1) & (size - 1)
            if self.keys[s] == -1:
                self.keys[s], self.rank[s], self.merged[s] = k, i, merged[i]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair; the slot of an absent pair has rank ``_NO_RANK``."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        held = self.keys[slot]
        astray = np.flatnonzero((held != keys) & (held != -1))
        while len(astray):
            slot[astray] = (slot[astray] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[astray]]
            astray = astray[(held != keys[astray]) & (held != -1)]
        return slot


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """BPE of many fragments at once: (ids laid end to end, number of ids of each fragment).

    In each round every unfinished fragment merges all places of its lowest-ranked
    pair.  A merged id's own merges rank behind the merge that made it, so this is
    the order of a priority queue.
    """
    n = len(lengths)
    counts = np.ones(n, np.int64)
    counts[lengths == 0] = 0
    done_ids: list[np.ndarray] = []
    done_owner: list[np.ndarray] = []
    owner = np.flatnonzero(lengths > 0)
    lens = lengths[owner].astype(np.int64)
    sym = symbols.astype(np.int32)
    slots = np.zeros(0, np.int64)
    rank = None
    while len(owner):
        starts = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=starts[1:])
        if rank is None:
            rank = np.full(len(sym), _NO_RANK, np.int32)
            slots = np.zeros(len(sym), np.int64)
            inner = np.ones(len(sym), bool)
            inner[starts + lens - 1] = False
            at = np.flatnonzero(inner)
            slots[at] = table.find(sym[at], sym[at + 1])
            rank[at] = table.rank[slots[at]]
        best = np.minimum.reduceat(rank, starts)
        live = best != _NO_RANK
        if not live.all():
            dead = ~live
            spread = np.repeat(dead, lens)
            done_ids.append(sym[spread])
            done_owner.append(np.repeat(owner[dead], lens[dead]))
            counts[owner[dead]] = lens[dead]
            keep = ~spread
            sym, rank, slots = sym[keep], rank[keep], slots[keep]
            owner, lens, best = owner[live], lens[live], best[live]
            if not len(owner):
                break
        hit = rank == np.repeat(best, lens)
        hit_at = np.flatnonzero(hit)
        if len(hit_at) > 1 and (np.diff(hit_at) == 1).any():  # aaa: only every other place of a run
            fresh = np.ones(len(hit_at), bool)
            fresh[1:] = np.diff(hit_at) != 1
            order = np.arange(len(hit_at))
            hit_at = hit_at[((order - np.maximum.accumulate(np.where(fresh, order, 0))) & 1) == 0]
        sym[hit_at] = table.merged[slots[hit_at]]
        keep = np.ones(len(sym), bool)
        keep[hit_at + 1] = False
        last = np.zeros(len(sym), bool)
        starts = np.zeros(len(lens), np.int64)
        np.cumsum(lens[:-1], out=starts[1:])
        last[starts + lens - 1] = True
        last[hit_at] |= last[hit_at + 1]
        lens = lens - np.add.reduceat((~keep).astype(np.int64), starts)
        moved = np.cumsum(keep) - 1
        sym, rank, slots, last = sym[keep], rank[keep], slots[keep], last[keep]
        new = moved[hit_at]
        left = new[new > 0] - 1
        changed = np.concatenate([new, left[~last[left]]])
        rank[new] = _NO_RANK
        changed = changed[~last[changed]]
        slots[changed] = table.find(sym[changed], sym[changed + 1])
        rank[changed] = table.rank[slots[changed]]
    if not done_ids:
        return np.zeros(0, np.int32), counts
    ids, owners = np.concatenate(done_ids), np.concatenate(done_owner)
    return ids[np.argsort(owners, kind="stable")], counts


def take_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``data[starts[i]:starts[i]+lens[i]]`` for all i, laid end to end."""
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    return data[np.arange(total) + np.repeat(starts - first, lens)]


class ByteBpe:
    """A byte-level BPE vocabulary read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or decoder.get("type") != "ByteLevel":
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        vocab: dict[str, int] = model["vocab"]
        spell = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        spell |= {i: t.encode() for t, i in self.added.items()}
        self.size = max(spell) + 1
        self.token_len = np.array([len(spell.get(i, b"")) for i in range(self.size)], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(spell.get(i, b"") for i in range(self.size)), np.uint8)
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = PairTable(np.array([vocab[a] for a, _ in merges], np.int64), np.array([vocab[b] for _, b in merges], np.int64), np.array([vocab[a + b] for a, b in merges], np.int32))
        #: May the two bytes be neighbours inside a token?
        self.joins = np.zeros(65536, bool)
        plain = set(self.added.values())
        for i, t in spell.items():
            if i not in plain and len(t) > 1:
                x = np.frombuffer(t, np.uint8).astype(np.int64)
                self.joins[x[:-1] * 256 + x[1:]] = True
        digits = [f"{i}," for i in range(self.size)]
        width = max(map(len, digits))
        self.digit_len = np.array([len(d) for d in digits], np.int64)
        self.digits = np.array([list(d.ljust(width).encode()) for d in digits], np.uint8)
        self.digit_mask = np.arange(width)[None, :] < self.digit_len[:, None]
        self._kind = np.full(0x110000, _UNSEEN, np.uint8)
        self._kind[WHITE_SPACE] = _SPACE

    def kinds(self, points: np.ndarray) -> np.ndarray:
        out = self._kind[points]
        if (out == _UNSEEN).any():
            for c in np.unique(points[out == _UNSEEN]).tolist():
                self._kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
            out = self._kind[points]
        return out

    def pretoken_starts(self, points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Mask of code points at which a pre-token begins.

        ``fresh`` marks the first code point of each text.  The pre-tokeniser takes
        runs of letters, of numbers or of other signs, each with one blank before
        it; of longer white space the last character stands apart; English
        contraction endings are taken first.
        """
        kind, n = self.kinds(points), len(points)
        begin = fresh.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = ~fresh[1:]
        before_ink = np.flatnonzero(space[:-1] & goes_on[:-1] & ~space[1:])
        begin[before_ink] = True
        begin[before_ink[points[before_ink] == 0x20] + 1] = False
        quote = np.flatnonzero((points == 0x27) & begin & goes_on)
        if len(quote):
            nxt = points[quote + 1]
            one = np.isin(nxt, [ord(c) for c in "stmd"])
            self._contract(begin, quote[one], 2, n)
            rest = quote[~one]
            rest = rest[rest + 2 < n]
            rest = rest[goes_on[rest + 1]]
            pair = points[rest + 1].astype(np.int64) << 21 | points[rest + 2]
            two = np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
            self._contract(begin, rest[two], 3, n)
        return begin

    @staticmethod
    def _contract(begin: np.ndarray, at: np.ndarray, width: int, n: int) -> None:
        begin[at + 1] = False
        after = at + width
        begin[after[after < n]] = True

    def fragments(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Fragment starts (bytes) of the chunk, and the added token's id of each (else -1)."""
        buf = chunk.buf
        text = buf.tobytes()
        points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero((buf & 0xC0) != 0x80)
        fresh_byte = np.zeros(len(buf) + 1, bool)
        fresh_byte[chunk.offsets] = True
        special: list[tuple[int, int, int]] = []
        for content, number in self.added.items():
            needle = content.encode()
            at = text.find(needle)
            while at >= 0:
                if not fresh_byte[at + 1 : at + len(needle)].any():
                    special.append((at, at + len(needle), number))
                    at = text.find(needle, at + len(needle))
                else:
                    at = text.find(needle, at + 1)
        for a, b, _ in special:
            fresh_byte[[a, b]] = True
        begin = self.pretoken_starts(points, fresh_byte[byte_at])
        cut = np.zeros(len(buf), bool)
        cut[byte_at[begin]] = True
        cut[1:] |= ~self.joins[buf[:-1].astype(np.int64) * 256 + buf[1:]]
        for a, b, _ in special:
            cut[a + 1 : b] = False
        starts = np.flatnonzero(cut)
        owned = np.full(len(starts), -1, np.int32)
        for a, _, number in special:
            owned[np.searchsorted(starts, a)] = number
        return starts, owned

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole chunk laid end to end, and each row's number of ids."""
        return self.encode_decode(chunk)[:2]

    def encode_decode(self, chunk: Chunk, share: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``encode``, and the bytes that the ids decode to.

        ``share=False`` encodes each fragment by itself instead of once per distinct
        hash; it is what a chunk falls back to if two fragments ever share a hash.
        """
        if not len(chunk.buf):
            return np.zeros(0, np.int32), np.zeros(len(chunk), np.int64), chunk.buf
        starts, owned = self.fragments(chunk)
        ends = np.append(starts[1:], len(chunk.buf))
        lens = ends - starts
        if share:
            _, where, back = np.unique(span_hashes(chunk.buf, starts, ends), return_index=True, return_inverse=True)
        else:
            where = back = np.arange(len(starts))
        symbols = self.byte_id[take_spans(chunk.buf, starts[where], lens[where])]
        ids, counts = merge_all(symbols, lens[where], self.table)
        first = np.cumsum(counts) - counts
        each = counts[back]
        out = take_spans(ids, first[back], each)
        total = np.cumsum(each)
        if (owned >= 0).any():
            begin = np.repeat(owned >= 0, each)
            begin[(total - each)[owned >= 0]] = False
            out[(total - each)[owned >= 0]] = owned[owned >= 0]
            out, each = out[~begin], np.where(owned >= 0, 1, each)
            total = np.cumsum(each)
        upto = np.append(0, total)[np.searchsorted(starts, chunk.offsets)]
        n_tokens = np.diff(upto)
        decoded = self.decode_bytes(out)
        if share and not np.array_equal(decoded, chunk.buf):
            return self.encode_decode(chunk, share=False)
        return out, n_tokens, decoded

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        return take_spans(self.token_bytes, self.token_at[ids], self.token_len[ids])

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, with U+FFFD for bytes that are not UTF-8."""
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")

    def encode_text(self, text: str | None) -> list[int]:
        chunk = next(chunks(pa.array([text or ""])))
        return self.encode(chunk)[0].tolist()

    def listed(self, ids: np.ndarray) -> np.ndarray:
        """The ids in decimal, each followed by a comma, as bytes."""
        return self.digits[ids][self.digit_mask[ids]]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


kept("bpe", load.cache_clear)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): the token ids of every text.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, counts = bpe.encode(chunk)
                offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), lists], ["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run, "bpe"), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids again, and digest both (``SCHEMA``).  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for chunk in chunks(batch.column(1), CHUNK):
                ids, counts, spelled = bpe.encode_decode(chunk)
                stop = np.append(0, np.cumsum(counts))
                text_stop = np.append(0, np.cumsum(bpe.token_len[ids]))[stop]
                digit_stop = np.append(0, np.cumsum(bpe.digit_len[ids]))[stop]
                digits, decoded = bpe.listed(ids).tobytes(), spelled.tobytes()
                listed = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(digit_stop[:-1], digit_stop[1:], strict=True)]
                again = [hashlib.sha256(decoded[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(text_stop[:-1], text_stop[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(again, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run, "bpe"), SCHEMA)
