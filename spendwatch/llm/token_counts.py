"""Exact token counts of texts and of their prefixes.

A text is cut where the tokenizer's own normaliser and pre-tokenizer never join
characters, so its count is the sum over its pieces, and the count at the end
of piece k is C[k] = C[k-1] + count(piece k): the prefix table.  Which cuts are
safe is read from the tokenizer file: at ASCII white space where the
pre-tokenizer drops it, before a single space between printable ASCII characters
where a space opens the next byte-level word, and nowhere (one piece a text)
where neither is known to hold.  Truncation and budget questions are a search in
the table; inside a piece, the piece's own prefixes are counted.  Pieces are
encoded by the library itself, each distinct piece once per worker while it
stays in the bounded memo.

Defined cases: a null text counts as empty; special strings inside a text are
whatever the library makes of them; repeated rows are counted each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 500_000       # distinct pieces in each of a worker's two generations
CHUNK = 200_000      # pieces looked up at once
GROUP_CHARS = 1 << 20
MARKS = frozenset(b".,;:!?")

# fixed value: a pre-tokenizer pattern under which letters, digits and signs part and white space is dropped
LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# pre-tokenizers that drop white space; normalisers that leave it a gap, or none
GAPS = {"BertPreTokenizer", "Whitespace", "WhitespaceSplit"}
KEEPS_GAPS = {"BertNormalizer", "Lowercase", "NFC", "NFD", "NFKC", "NFKD", "StripAccents"}
WORD_START = re.compile(rb"(?<=[\x21-\x7E])(?=\x20[\x21-\x7E])")

_COUNTERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _parts(step: dict | None, name: str) -> list[dict]:
    """The steps of a normaliser or pre-tokenizer, sequences laid flat."""
    if step is None:
        return []
    return [p for s in step[name] for p in _parts(s, name)] if step["type"] == "Sequence" else [step]


def safe_cuts(spec: dict) -> tuple[str, bool]:
    """Where a tokenizer's texts may be cut (``gaps``, ``spaces`` or ``none``), and whether a word in any case counts
    as in lower case, apart from a mark behind it."""
    clean = _parts(spec.get("normalizer"), "normalizers")
    words = _parts(spec.get("pre_tokenizer"), "pretokenizers")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]
           for t in spec.get("added_tokens", [])) or not words:
        return "none", False
    first = words[0]
    known = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and \
        first["pattern"] == {"Regex": LETTERS}
    one_space = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if all(c["type"] in KEEPS_GAPS or c == one_space for c in clean) and (known or first["type"] in GAPS):
        later = all(w["type"] == "ByteLevel" and not w["add_prefix_space"] and not w["use_regex"] for w in words[1:])
        return "gaps", known and later and any(c["type"] == "Lowercase" for c in clean)
    if not clean and len(words) == 1 and first["type"] == "ByteLevel" and first["use_regex"] and \
            not first["add_prefix_space"]:
        return "spaces", False
    return "none", False


class PieceCounter:
    """Token count of a text's pieces (bytes) by the library, with a bounded memo.

    The memo has two generations: a full one becomes the old one, from which
    pieces that occur again move up, so frequent pieces are never encoded anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.cuts, self.folds = safe_cuts(json.loads(self.tok.to_str()))
        self.mark = {m: len(self.tok.encode(chr(m), add_special_tokens=False)) for m in MARKS}

    def split(self, raw: bytes) -> list[bytes]:
        """Pieces of a text whose counts add up; without ``gaps`` they hold every byte."""
        if self.cuts == "gaps":
            return raw.split()           # spaces and ASCII controls 9..13
        if self.cuts == "none" or not raw:
            return [raw] if raw else []
        return WORD_START.split(raw)

    def learn(self, pieces: set[bytes]) -> None:
        new = pieces - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.old, self.memo, new = self.memo, {}, pieces
        memo, unseen, marked = self.memo, set(), []
        for p in new:
            n = self.old.get(p)
            if n is not None:
                memo[p] = n
                continue
            # letters with one mark behind are two pre-tokens, and case is dropped: "Word," counts as "word" and ","
            mark = p[-1] if p[-1] in MARKS else 0
            core = (p[:-1] if mark else p).lower()
            if self.folds and core.isalpha():
                marked.append((p, core, mark))
                if core not in memo:
                    unseen.add(core)
            else:
                unseen.add(p)
        todo = list(unseen)
        for i in range(0, len(todo), 10_000):
            part = todo[i:i + 10_000]
            texts = [p.decode("utf-8", "replace") for p in part]
            for p, e in zip(part, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                memo[p] = len(e)
        for p, core, mark in marked:
            memo[p] = memo[core] + (self.mark[mark] if mark else 0)

    def counts(self, pieces: list[bytes]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(pieces), CHUNK):
            part = pieces[i:i + CHUNK]
            self.learn(set(part))
            out.extend(map(self.memo.__getitem__, part))
        return out

    def prefix_table(self, text: str | None) -> tuple[list[int], list[int]]:
        """(end offset of each piece, exact token count of the text up to that end)."""
        pieces = self.split((text or "").encode())
        return _table(text or "", pieces, self.counts(pieces))

    def at(self, text: str, table: tuple[list[int], list[int]], i: int) -> int:
        """Exact count of ``text[:i]``; only the piece that ``i`` cuts is looked at."""
        ends, counts = table
        k = bisect_right(ends, i)
        base, start = (counts[k - 1], ends[k - 1]) if k else (0, 0)
        cut = self.split(text[start:i].encode())
        return base + sum(self.counts(cut))

    def longest(self, table: tuple[list[int], list[int]], budget: int) -> int:
        """End of the last piece whose prefix has at most ``budget`` tokens (0: none)."""
        k = bisect_right(table[1], budget)
        return table[0][k - 1] if k else 0


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", path: str | None = None, budget: int = 2048,
                 prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, budget_chars (longest prefix of whole pieces within ``budget``);
    with ``prefixes`` also the table itself as two arrays."""
    path = path or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, budget_chars long"
    if prefixes:
        schema += ", prefix_ends array<int>, prefix_tokens array<int>"

    def run(batches):
        counter = _counter(path)
        for b in batches:
            texts = b.column(1)
            rows: list = []
            group, size = [], 0          # texts in groups, so that the memo is asked for many pieces at once
            for i in range(b.num_rows):
                group.append(texts[i].as_py() or "")
                size += len(group[-1])
                if size >= GROUP_CHARS or i + 1 == b.num_rows:
                    rows += _rows(counter, group, budget, prefixes)
                    group, size = [], 0
            cols = list(zip(*rows)) if rows else [()] * (5 if prefixes else 3)
            arrays = [b.column(0)] + [pa.array(c, pa.int64()) for c in cols[:3]]
            if prefixes:
                arrays += [pa.array(c, pa.list_(pa.int32())) for c in cols[3:5]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col(doc_id), F.col("text").cast("string")).mapInArrow(run, schema)


def _rows(counter: PieceCounter, texts: list[str], budget: int, prefixes: bool):
    raw = [t.encode() for t in texts]
    pieces = [counter.split(r) for r in raw]
    n = counter.counts([p for ps in pieces for p in ps])
    at, out = 0, []
    for text, r, ps in zip(texts, raw, pieces):
        counts = n[at:at + len(ps)]
        at += len(ps)
        total = sum(counts)
        ends, table = _table(text, ps, counts) if prefixes or total > budget else ([], [])
        k = bisect_right(table, budget)
        fit = len(text) if total <= budget else ends[k - 1] if k else 0
        out.append((len(r), total, fit) + ((ends, table) if prefixes else ()))
    return out


def _table(text: str, pieces: list[bytes], counts: list[int]) -> tuple[list[int], list[int]]:
    ends, at = [], 0
    for p in pieces:
        s = p.decode()
        at = text.index(s, at) + len(s)
        ends.append(at)
    return ends, list(accumulate(counts))
