"""Operator 8: quality rules on counts and on tokeniser fertility.

Public vocabularies are laid over every word: a SentencePiece one with byte fallback
and a byte-level one for many languages.  For each of them a text has three measures:
characters per token, the share of tokens that are no whole characters (byte fallback),
and the entropy of its tokens.  Only distinct words of a chunk are encoded.

Two kinds of bands reject a text that passes the base rule:

* ``LIMITS``, by script: what no text worth keeping shows in any corpus.
* Fences, by language, script and length class (octave of words): the quartiles of a
  measure over all texts of the cell that pass the base rule, moved outwards by ``REACH``
  times their distance (Tukey's fences), for which ``LEAST_SPREAD`` stands in if it is
  smaller.  Characters per token have both fences, the fallback share has the upper and
  the entropy the lower one.  Words of a language are cut into about as many tokens
  everywhere; tables, symbols, codes, mangled text and lists of one item are not.

The quartiles are exact over measures rounded to ``1 / GRID``, so a cell's state is
bounded and reruns agree.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged alike; a null language is a language of its own, and without
a language column the script alone makes the cells; other columns are never read, so
clashing names do no harm; an empty table gives an empty table; texts of any length are
taken whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import StructType

from ..plans.memory import frugal, kept
from ..plans.shared import written
from .bpe import PairTable, merge_all, take_spans
from .textscan import IS_SPACE, Chunk, chunks, mix, row_runs, run_hashes, span_hashes

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, script string, octave int"
#: What each vocabulary measures; the columns carry the vocabulary's number.
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8

SCRIPTS = ("latin", "latin_marked", "cyrillic", "greek", "cjk", "other")
#: Last code point of each range and the script it belongs to (-1: says nothing).
_RANGES = ((0x40, -1), (0x5A, 0), (0x60, -1), (0x7A, 0), (0xBF, -1), (0x24F, 1), (0x36F, -1), (0x3FF, 3), (0x52F, 2), (0x1DFF, 5), (0x1EFF, 1), (0x1FFF, 3), (0x2E7F, -1), (0x9FFF, 4), (0xABFF, 5), (0xD7AF, 4), (0xF8FF, 5), (0xFAFF, 4), (0x1FFFF, 5), (0x3FFFF, 4), (0x10FFFF, 5))
#: A text whose letters are at least this share of marked Latin is judged as such.
MARKED_SHARE = 0.02

#: Fences lie this many quartile distances outside of the quartiles of measures rounded to ``1 / GRID``.
REACH, GRID = 1.5, 1000
#: The least quartile distance that a fence is reckoned with: as a share of the median, and as plain numbers.
LEAST_SPREAD = {"chars_per_token": 0.05, "fallback_share": 0.02, "token_entropy": 0.2}


@dataclass(frozen=True)
class Limits:
    """What a script's texts must show by any vocabulary; evenness is the entropy of the tokens over the most that so many of them can have."""

    least_chars: float
    most_chars: float
    most_fallback: float
    least_evenness: float


LIMITS = {
    "latin": Limits(1.4, 7.0, 0.10, 0.40),
    "latin_marked": Limits(1.3, 7.0, 0.15, 0.40),
    "cyrillic": Limits(0.9, 7.0, 0.30, 0.40),
    "greek": Limits(0.5, 7.0, 0.90, 0.30),
    "cjk": Limits(0.25, 5.0, 0.98, 0.30),
    "other": Limits(0.20, 7.0, 1.00, 0.20),
}


class Pieces:
    """BPE of a SentencePiece model over single words, each with the word mark before it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        spell = {model.id_to_piece(i): i for i in usable}
        order = sorted((i for i in usable if len(model.id_to_piece(i)) > 1), key=lambda i: -model.get_score(i))
        rank = np.full(size, np.iinfo(np.int32).max, np.int32)
        rank[order] = np.arange(len(order))
        self.table = _merges({p: i for p, i in spell.items()}, (model.id_to_piece(i) for i in order), rank)
        self.size = size
        #: Symbol of each code point; ``size + n`` stands for one that falls back to n bytes.
        points = np.arange(0x110000)
        self.symbol = (size + 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
        for piece, i in spell.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.mark = spell["▁"]
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.falls = np.zeros(size, bool)
        self.falls[self.bytes] = True

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end and the number of each."""
        lens = ends - starts
        data = take_spans(buf, starts, lens)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        stop = np.cumsum(lens)
        n_points = head[stop] - head[stop - lens]
        symbols = np.insert(self.symbol[points], np.cumsum(n_points) - n_points, self.mark)
        ids, counts = merge_all(symbols, n_points + 1, self.table)
        # Fallback characters merge with nothing: they come out in the order of the text, as one id each.
        width = np.where(ids > self.size, ids - self.size, 1)
        if not (ids > self.size).any():
            return ids, counts
        upto = np.append(0, np.cumsum(width))
        edge = np.append(0, np.cumsum(counts))
        ids = np.repeat(ids, width)
        fallen = self.symbol[points] > self.size
        ids[ids > self.size] = self.bytes[data[np.repeat(fallen, np.diff(np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))))]]
        return ids, np.diff(upto[edge])


class ByteRanks:
    """Byte-level BPE given by the ranks of its tokens, over single words, each with a blank before it."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.table = _merges(ranks, ranks, np.arange(self.size, dtype=np.int32))
        self.symbol = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        #: Tokens that are no whole characters.
        self.falls = np.zeros(self.size, bool)
        for token, rank in ranks.items():
            self.falls[rank] = not _whole_characters(token)

    def encode_words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words laid end to end and the number of each."""
        lens = ends - starts
        symbols = np.insert(self.symbol[take_spans(buf, starts, lens)], np.cumsum(lens) - lens, self.symbol[0x20])
        return merge_all(symbols, lens + 1, self.table)


Vocabulary = Pieces | ByteRanks


def _whole_characters(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _merges(ids: dict, tokens, rank: np.ndarray) -> PairTable:
    """Every split of a token into two others is a merge, which ranks as the token does."""
    left, right, merged = [], [], []
    for token in tokens:
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), merged.append(ids[token])
    table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32), room=4)
    filled = table.keys >= 0
    table.rank[filled] = rank[table.merged[filled]]
    return table


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Pieces(path) if path.endswith(".model") else ByteRanks(path)


kept("fertility", load.cache_clear)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur more than once."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def base_counts(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that need no vocabulary."""
    n = len(chunk)
    ink = np.append(0, np.cumsum((~IS_SPACE[chunk.buf]) & ((chunk.buf & 0xC0) != 0x80)))
    out = {"n_words": chunk.per_row(starts), "word_chars": np.diff(ink[chunk.offsets]), "n_symbols": np.diff(np.append(0, np.cumsum(_SYMBOL[chunk.buf]))[chunk.offsets])}
    a, b = chunk.lines()
    used = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    a, b = a[used], b[used]
    rows = chunk.row_of(a)
    keys = mix(span_hashes(chunk.buf, a, b) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(keys, return_index=True)
    out["n_dup_lines"] = np.bincount(rows, minlength=n) - np.bincount(rows[at], minlength=n)
    word_rows = chunk.row_of(starts)
    inside = np.flatnonzero(row_runs(word_rows, WINDOW))
    runs = run_hashes(hashes, WINDOW)[inside] if len(inside) else np.zeros(0, np.uint64)
    again = inside[_repeated(mix(runs + word_rows[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(word_rows[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def main_scripts(chunk: Chunk) -> np.ndarray:
    """Index into ``SCRIPTS`` of each row: the script of most letters, texts without letters last."""
    points = np.frombuffer(chunk.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    rows = chunk.row_of(np.flatnonzero((chunk.buf & 0xC0) != 0x80))
    lasts, owner = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES])
    table = owner[np.searchsorted(lasts, np.arange(0x3100))]
    low = points < 0x3100
    script = np.where(low, table[np.where(low, points, 0)], owner[np.searchsorted(lasts, np.where(low, 0x3100, points))])
    said = script >= 0
    n = len(chunk)
    tally = np.bincount(rows[said] * 6 + script[said], minlength=n * 6).reshape(n, 6)
    marked = tally[:, 1] >= MARKED_SHARE * np.maximum(1, tally[:, 0] + tally[:, 1])
    merged = tally.copy()
    merged[:, 0], merged[:, 1] = np.where(marked, 0, tally[:, 0] + tally[:, 1]), np.where(marked, tally[:, 0] + tally[:, 1], 0)
    return np.where(tally.sum(1) > 0, merged.argmax(1), 5)


def fertility(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, distinct: tuple[np.ndarray, np.ndarray], vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Tokens, fallback share and entropy of each row; ``distinct``: one place of each word, and each word's number."""
    n = len(chunk)
    zero = np.zeros(n)
    if not len(starts):
        return {"n_tokens": zero.astype(np.int64), "fallback_share": zero, "token_entropy": zero}
    where, back = distinct
    ids, counts = vocabulary.encode_words(chunk.buf, starts[where], ends[where])
    first = (np.cumsum(counts) - counts)[back]
    each = counts[back]
    tokens = take_spans(ids, first, each).astype(np.int64)
    rows = np.repeat(chunk.row_of(starts), each)
    total = np.bincount(rows, minlength=n)
    fallen = np.bincount(rows[vocabulary.falls[tokens]], minlength=n)
    keys = np.sort(rows * np.int64(1 << 20) + tokens)
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(edge, len(keys)))
    surprise = np.bincount(keys[edge] >> 20, times * np.log2(times), minlength=n)
    entropy = np.where(total > 0, np.log2(np.maximum(total, 1)) - surprise / np.maximum(total, 1), 0.0)
    return {"n_tokens": total.astype(np.int64), "fallback_share": fallen / np.maximum(total, 1), "token_entropy": np.maximum(entropy, 0.0)}


def measure_chunk(chunk: Chunk, vocabularies: Sequence[Vocabulary]) -> dict[str, np.ndarray]:
    """The columns of ``measured_fields`` for all rows."""
    starts, ends = chunk.words()
    hashes = span_hashes(chunk.buf, starts, ends)
    out = base_counts(chunk, starts, ends, hashes)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    script = main_scripts(chunk) if len(chunk.buf) else np.full(len(chunk), 5)
    out["script"] = np.array(SCRIPTS)[script]
    out["octave"] = np.frexp(out["n_words"].astype(np.float64))[1]
    _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    for k, vocabulary in enumerate(vocabularies):
        got = fertility(chunk, starts, ends, (where, back), vocabulary)
        got["chars_per_token"] = out["word_chars"] / np.maximum(got["n_tokens"], 1)
        least, most, fallen, even = (np.array([getattr(LIMITS[s], x) for s in SCRIPTS])[script] for x in ("least_chars", "most_chars", "most_fallback", "least_evenness"))
        most_entropy = np.log2(np.clip(got["n_tokens"], 2, vocabulary.size))
        out[f"within_limits_{k}"] = (got["chars_per_token"] >= least) & (got["chars_per_token"] <= most) & (got["fallback_share"] <= fallen) & (got["token_entropy"] >= even * most_entropy)
        out |= {f"{name}_{k}": got[name] for name in ("n_tokens", *MEASURES)}
    return out


def measured_fields(vocabularies: int) -> list[tuple[str, str]]:
    own = [("n_tokens", "bigint"), *((m, "double") for m in MEASURES), ("within_limits", "boolean")]
    return [tuple(f.strip().split(" ")) for f in COUNTS.split(",")] + [(f"{name}_{k}", kind) for k in range(vocabularies) for name, kind in own]


def measures(text: Column, vocabularies: Sequence[str]) -> Column:
    """A struct of ``measured_fields``.  Only the text goes to the worker; the row stays in the JVM."""
    fields = measured_fields(len(vocabularies))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = [load(path) for path in vocabularies]
        for texts in batches:
            parts = [measure_chunk(chunk, words) for chunk in chunks(pc.cast(texts, pa.string()))]
            columns = [pa.array(np.concatenate([p[f] for p in parts]) if parts else [], kinds[t]) for f, t in fields]
            yield pa.StructArray.from_arrays(columns, names=[f for f, _ in fields])

    kind = StructType.fromDDL(", ".join(f"{f} {t}" for f, t in fields))
    return F.arrow_udf(frugal(run, "fertility"), kind, ArrowUDFType.SCALAR_ITER).asNondeterministic()(text)  # so that it runs once for a row


def _rounded(measure: str) -> Column:
    return F.round(F.col(measure) * GRID).cast("bigint")


def fences(measured: DataFrame, vocabularies: int) -> DataFrame:
    """Rows (lang, script, octave, and (low, high) of each measure) from all measured texts that pass the base rule."""
    found = []
    for k in range(vocabularies):
        for m in MEASURES:
            q = F.percentile(_rounded(f"{m}_{k}"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            found.append(F.transform(q, lambda x: x / GRID).alias(f"q_{m}_{k}"))
    quartiles = measured.where("not base_failed").groupBy(F.col("lang").alias("_lang"), F.col("script").alias("_script"), F.col("octave").alias("_octave")).agg(*found)
    out = [F.col(c) for c in ("_lang", "_script", "_octave")]
    for k in range(vocabularies):
        for m in MEASURES:
            q = F.col(f"q_{m}_{k}")
            least = F.lit(LEAST_SPREAD[m]) * (q[1] if m == "chars_per_token" else 1)
            spread = F.greatest(q[2] - q[0], least)
            out += [(q[0] - REACH * spread).alias(f"low_{m}_{k}"), (q[2] + REACH * spread).alias(f"high_{m}_{k}")]
    return quartiles.select(*out)


def _outside(vocabularies: int) -> Column:
    """Names of the bands that a measured row with its fences is outside of."""
    out = []
    for k in range(vocabularies):
        out.append(F.when(~F.col(f"within_limits_{k}"), f"limits_{k}"))
        for m in MEASURES:
            x = _rounded(f"{m}_{k}") / GRID
            if m != "fallback_share":
                out.append(F.when(x < F.col(f"low_{m}_{k}"), f"low_{m}_{k}"))
            if m != "token_entropy":
                out.append(F.when(x > F.col(f"high_{m}_{k}"), f"high_{m}_{k}"))
    return F.array_compact(F.array(*out))


def _judged(measured: DataFrame, vocabularies: int) -> DataFrame:
    """A table of measured rows with (outside, kept) added."""
    cells = written(fences(measured, vocabularies))  # of known size, which mostly is too small for a shuffle of the rows
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("script") == F.col("_script")) & (F.col("octave") == F.col("_octave"))
    outside = F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(_outside(vocabularies))
    return measured.join(cells, same, "left").withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))


def judge(docs: DataFrame, vocabularies: Sequence[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Counts, measures and verdict of every row: (doc_id, ``measured_fields``, outside, kept).

    ``outside`` names the bands that a text which passes the base rule breaks.  One pass over
    the texts; what it measures is written and read twice, without a shuffle of rows unless
    the planner finds the table of cells too large to send around.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _lang(docs, lang_col), measures(F.col(text_col).cast("string"), vocabularies).alias("m"))
    measured = written(picked.select("doc_id", "lang", "m.*"))
    return _judged(measured, len(vocabularies)).select("doc_id", *(f for f, _ in measured_fields(len(vocabularies))), "outside", "kept")


def keep_good(docs: DataFrame, vocabularies: Sequence[str], text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns.

    Rows that pass the base rule are written with their measures and read again.
    """
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), _lang(docs, lang_col), measures(F.col(text_col).cast("string"), vocabularies).alias("m"))
    measured = written(whole.select("row", "lang", "m.*").where("not base_failed"))
    return _judged(measured, len(vocabularies)).where("kept").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def _lang(docs: DataFrame, lang_col: str | None) -> Column:
    return (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string").alias("lang")
