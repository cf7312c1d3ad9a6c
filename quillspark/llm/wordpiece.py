"""Operator 4: token counts by a linear longest-match automaton.

A text's token count under greedy longest-match word pieces: each word, with a
blank before it, is cut from the left into the longest tokens of a public
byte-level vocabulary (its tokens with a leading blank only fit a word's begin).
The vocabulary becomes a trie.  Each node has a failure link, and the number of
tokens that are certainly complete when the link is followed; both are worked out
once, level by level.  A word is then counted in one walk, without going back and
without building pieces.  All distinct words of a chunk walk side by side in numpy.

Defined results: a null or empty text has no words and no tokens; every byte is a
token, so no word is unknown; repeated rows count alike; other columns are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.memory import frugal, kept
from .bpe import byte_symbols, take_spans
from .textscan import Chunk, chunks, span_hashes

SCHEMA = "doc_id bigint, n_words bigint, n_tokens bigint"
_BLANK = 32


class LongestMatch:
    """Trie, failure links and popped-token counts of a set of byte strings that holds all single bytes."""

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        is_token = [False]
        depth = [0]
        for token in tokens:
            node = 0
            for byte in token:
                following = children[node].get(byte)
                if following is None:
                    following = children[node][byte] = len(children)
                    children.append({})
                    is_token.append(False)
                    depth.append(depth[node] + 1)
                node = following
            if token:
                is_token[node] = True
        if any(not is_token[children[0].get(b, 0)] for b in range(256)):
            raise ValueError("every single byte must be a token")
        n = len(children)
        fail, popped = [0] * n, [0] * n
        # Node by node in order of depth: what a node's string is cut into so far, and what remains of it.
        order = sorted(range(n), key=depth.__getitem__)
        for node in order:
            for byte, child in children[node].items():
                if is_token[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                at, count = fail[node], popped[node]
                while byte not in children[at]:
                    count += popped[at]
                    at = fail[at]
                fail[child], popped[child] = children[at][byte], count
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        edges = [(node << 8 | byte, child) for node in range(n) for byte, child in children[node].items()]
        self.bits = int(len(edges) * 4).bit_length()
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([k for k, _ in edges], np.int64)
        for (key, child), slot in zip(edges, self._slot(keys).tolist(), strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.targets[slot] = key, child

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The child of each node by a byte, -1 if there is none."""
        keys = nodes << 8 | data
        slot = self._slot(keys)
        held = self.keys[slot]
        astray = np.flatnonzero((held != keys) & (held != -1))
        while len(astray):
            slot[astray] = (slot[astray] + 1) & ((1 << self.bits) - 1)
            held[astray] = self.keys[slot[astray]]
            astray = astray[(held[astray] != keys[astray]) & (held[astray] != -1)]
        return np.where(held == keys, self.targets[slot], -1)

    def count(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each word; longest words first, so that those still walking are always a prefix."""
        order = np.argsort(-lens, kind="stable")
        starts, lens_ = starts[order], lens[order]
        node = np.full(len(order), int(self.step(np.zeros(1, np.int64), np.array([_BLANK]))[0]), np.int64)
        total = np.zeros(len(order), np.int64)
        for k in range(int(lens_[0]) if len(order) else 0):
            live = int(np.searchsorted(-lens_, -k, side="left"))
            self._feed(node, total, np.arange(live), buf[starts[:live] + k].astype(np.int64))
        left = np.flatnonzero(node > 0)
        while len(left):
            total[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] > 0]
        out = np.empty_like(total)
        out[order] = total
        return out

    def _feed(self, node: np.ndarray, total: np.ndarray, at: np.ndarray, data: np.ndarray) -> None:
        while len(at):
            following = self.step(node[at], data)
            stuck = following < 0
            node[at[~stuck]] = following[~stuck]
            at, data = at[stuck], data[stuck]
            total[at] += self.popped[node[at]]
            node[at] = self.fail[node[at]]


@lru_cache(maxsize=2)
def load(path: str) -> LongestMatch:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    special = {a["content"] for a in spec.get("added_tokens", [])}
    return LongestMatch([bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special and all(c in to_byte for c in t)])


kept("automaton", load.cache_clear)


def count_chunk(chunk: Chunk, automaton: LongestMatch) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = chunk.words()
    words = chunk.per_row(starts)
    if not len(starts):
        return words, words
    _, where, back = np.unique(span_hashes(chunk.buf, starts, ends), return_index=True, return_inverse=True)
    # Distinct words are laid out on their own, so that the walk touches little memory.
    lens = (ends - starts)[where]
    data = take_spans(chunk.buf, starts[where], lens)
    counts = automaton.count(data, np.cumsum(lens) - lens, lens)
    return words, np.bincount(chunk.row_of(starts), counts[back], len(chunk)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``SCHEMA``) of every text.  One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(vocabulary)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                words, counts = count_chunk(chunk, automaton)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(words, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(frugal(run, "automaton"), SCHEMA)
