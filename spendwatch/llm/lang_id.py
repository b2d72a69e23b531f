"""Language identification by hyperdimensional profiles.

Every letter of every script has a random vector of +1 and -1, drawn from its
code point.  A letter trigram's vector binds its letters, each rotated by its
place; a text's vector bundles (sums) its trigram vectors; a language's
prototype bundles the texts it was learned from.  A text takes the language
whose prototype has the largest cosine.

Vectors are kept as bits, so binding is an exclusive or.  Each task bundles its
own learning texts per language, Spark adds the tasks' bundles, and the model
is ``DIM`` numbers a language, whatever the corpus.  A text's bundle is summed
over blocks of its trigrams: blocks that most texts of a chunk share by a
matrix product, rare trigrams entry by entry.  Sums are of whole numbers, hence
the same in any order.

Letters are lower-cased; everything else is one gap.  Prototypes are centred on
their mean, which all languages share and which tells nothing.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
row without lang or text teaches nothing; without any learning row every text
is ``und``; ties go to the first language by name; repeated rows are predicted
each; a very long text is read in pieces that carry their last two letters
over, with the result of the whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import mix, text_buffers

DIM = 1024
SEED = 7
UND = "und"
CHUNK = 1 << 20      # bytes of a chunk of texts, or of a piece of a longer text
ROWS = 512           # texts of a chunk
BLOCK = 1024         # trigrams bound at a time
ENTRIES = 4096       # rare (text, trigram) entries added at a time
LANGS = 1024         # languages whose bundles a task holds before it sends them
_U = np.uint64
_CP = 21             # bits of a code point in a trigram's number


@lru_cache(1)
def _letter() -> np.ndarray:
    """Lower-case letter of every code point, 0 for gaps."""
    out = np.zeros(0x110000, np.int64)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letter_bits(letters: np.ndarray) -> np.ndarray:
    """``DIM`` seeded bits of each letter."""
    at = letters.astype(_U)[:, None] * _U(DIM // 64) + np.arange(DIM // 64, dtype=_U)
    return np.unpackbits(mix(mix(at + _U(SEED << 40))).view(np.uint8), axis=1)


def trigram_vectors(t: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams: first letter rotated twice, second once.  A set bit stands for -1."""
    parts = np.stack([t >> 2 * _CP, t >> _CP & (1 << _CP) - 1, t & (1 << _CP) - 1])
    letters, at = np.unique(parts, return_inverse=True)
    at, bits, out = at.reshape(parts.shape), letter_bits(letters), None
    for turn, place in zip((2, 1, 0), at):
        packed = np.packbits(np.roll(bits, turn, 1), axis=1)[place]
        out = packed if out is None else out ^ packed
    return 1 - 2 * np.unpackbits(out, axis=1).astype(np.float32)


def _symbols(raw: bytes) -> np.ndarray:
    return _letter()[np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)]


def _tally(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram, count) of symbols laid end to end; text numbers are below ``ROWS``."""
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    # a text's opening gap may follow the gap that closes the one before; it then serves both
    sym, doc = sym[keep], doc[keep]
    letters = np.unique(sym)                     # at most 2^18 letters: three and a text number fit in 63 bits
    bits, code = max(len(letters).bit_length(), 1), np.searchsorted(letters, sym)
    middle = np.flatnonzero(sym[1:-1]) + 1
    key = ((doc[middle] << bits | code[middle - 1]) << bits | code[middle]) << bits | code[middle + 1]
    key, count = np.unique(key, return_counts=True)
    part = [letters[key >> k * bits & (1 << bits) - 1] for k in (2, 1, 0)]
    return key >> 3 * bits, (part[0] << _CP | part[1]) << _CP | part[2], count


def trigrams(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram, count) of up to ``ROWS`` texts given as UTF-8 bytes laid end to end; runs of gaps are
    one gap."""
    raw = text.tobytes()
    try:
        raw.decode()
        sym = _symbols(raw)
        at = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])[bounds]     # bounds in code points
    except UnicodeDecodeError:
        parts = [_symbols(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        sym, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    # a gap before and after every text
    sym = np.insert(sym, np.concatenate([at[:-1], [len(sym)]]), 0)
    doc = np.insert(doc, np.concatenate([at[:-1], [len(doc)]]), np.concatenate([np.arange(n), [n]]))
    return _tally(sym, doc)


def long_trigrams(text: np.ndarray):
    """The trigrams of one long text, piece after piece; a piece starts with the last two symbols of the one before."""
    carry, at = np.zeros(1, np.int64), 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        sym = np.concatenate([carry, _symbols(text[at:end].tobytes()), np.zeros(int(end == len(text)), np.int64)])
        sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
        yield _tally(sym, np.zeros(len(sym), np.int64))
        carry, at = sym[-2:], end


def bundle(doc: np.ndarray, tri: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Sum of count times vector for each of ``n`` texts; entries may repeat a (text, trigram)."""
    out = np.zeros((n, DIM), np.float32)
    known, at = np.unique(tri, return_inverse=True)
    by_use = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), np.int64)
    rank[by_use] = np.arange(len(known))
    order = np.lexsort((doc, rank[at] // BLOCK))
    place, doc, count = rank[at][order], doc[order], count[order]
    for first in range(0, len(known), BLOCK):
        v = trigram_vectors(known[by_use[first:first + BLOCK]])
        lo, hi = np.searchsorted(place // BLOCK, [first // BLOCK, first // BLOCK + 1])
        if (hi - lo) * 32 >= n * len(v):
            m = np.bincount(doc[lo:hi] * len(v) + place[lo:hi] - first, count[lo:hi], n * len(v))
            out += m.reshape(n, len(v)).astype(np.float32) @ v
        else:
            for a in range(lo, hi, ENTRIES):
                b = min(a + ENTRIES, hi)
                d = doc[a:b]
                begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                rows = v[place[a:b] - first] * count[a:b, None].astype(np.float32)
                out[d[begin]] += np.add.reduceat(rows, begin, axis=0)
    return out


def _bundles(column):
    """(first row, bundles) of runs of texts."""
    off, data = text_buffers(column)
    i = 0
    while i < len(column):
        j = min(i + ROWS, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1))
        part = data[off[i]:off[j]]
        if len(part) > CHUNK:
            out = np.zeros((1, DIM))
            for found in long_trigrams(part):
                out += bundle(*found, 1)
        else:
            out = bundle(*trigrams(part, off[i:j + 1] - off[i]), j - i)
        yield i, out
        i = j


def _profile_rows(batches):
    """(lang, bundle) summed over the task's rows."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for first, rows in _bundles(b.column(1)):
            for lang, row in zip(langs[first:], rows):
                total.setdefault(lang, np.zeros(DIM))
                total[lang] += row
        if len(total) > LANGS:                    # bounded, whatever the column holds
            yield _profiles(total)
            total = {}
    yield _profiles(total)


def _profiles(total: dict) -> pa.RecordBatch:
    rows = pa.array([np.rint(v).astype(np.int64) for v in total.values()], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), rows], names=["lang", "v"])


class Model:
    """Languages and their centred prototypes."""

    def __init__(self, profiles):
        """``profiles``: (language, place, sum) of every place."""
        self.langs = sorted({r[0] for r in profiles})
        number = {lang: k for k, lang in enumerate(self.langs)}
        proto = np.zeros((len(self.langs), DIM))
        for lang, i, c in profiles:
            proto[number[lang], i] = c
        size = np.linalg.norm(proto, axis=1)
        proto /= np.where(size == 0, 1, size)[:, None]
        self.mean = proto.mean(0) if len(self.langs) > 1 else np.zeros(DIM)
        self.proto = (proto - self.mean).astype(np.float32)
        norm = np.linalg.norm(self.proto, axis=1)
        self.proto /= np.where(norm == 0, 1, norm)[:, None]

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and cosine of bundles; a bundle without trigrams is all zero."""
        n = len(rows)
        best, score = np.full(n, -1), np.zeros(n)
        if self.langs and n:
            size = np.linalg.norm(rows, axis=1)
            has = size > 0
            unit = rows / np.where(has, size, 1)[:, None] - self.mean.astype(np.float32)
            cos = unit @ self.proto.T / np.maximum(np.linalg.norm(unit, axis=1), 1e-30)[:, None]
            best[has] = np.argmax(cos[has], 1)
            score[has] = np.clip(cos[has, best[has]], 0, 1)
        return [self.langs[k] if k >= 0 else UND for k in best], score


def learn(rows: DataFrame) -> Model:
    """Prototypes of ``rows`` (lang, text); all rows are counted.  The driver gets ``DIM`` numbers a language."""
    sums = (rows.select(F.col("lang").cast("string"), F.col("text").cast("string"))
            .where("lang is not null and text is not null")
            .mapInArrow(_profile_rows, "lang string, v array<long>")
            .select("lang", F.posexplode("v").alias("i", "c")).groupBy("lang", "i").agg(F.sum("c").alias("c")))
    return Model([tuple(r) for r in sums.collect()])


def _predictor(model):
    def run(batches):
        for b in batches:
            langs, scores = [], []
            for _, rows in _bundles(b.column(b.num_columns - 1)):
                lang, score = model.value.predict(rows)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))],
                names=[*b.schema.names[:-1], "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score of every text; only the text is looked at."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(_predictor(d.sparkSession.sparkContext.broadcast(model)),
                        f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
