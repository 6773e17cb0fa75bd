"""Exact token counts by prefix dynamic programming over a byte-level BPE vocabulary.

A byte-level BPE tokenizer first cuts a text into pieces (words with their leading space, numbers, runs of signs or of
white space), then merges inside each piece. Within a piece the encoding of each byte prefix ends in exactly one token
that fits the last token of the prefix before it: the pair is stable, that is, encoding its joined bytes gives the same
two tokens again. So one pass from left to right stores the token count of every prefix of a piece, and the sums of those
before it give the count of every prefix of the text: a table with an entry per character. It answers how many tokens any
prefix has and where a budget ends by a look-up; nothing is encoded again. Where a cut text falls into other pieces than the
whole one (within white space, contractions and special strings), the table holds the count of the pieces of the cut text.

Defined results: a null text counts as empty, with 0 tokens. A special token's string in a text is one token, as the
tokenizers library takes it by default. No begin, end or padding tokens are added and nothing is truncated.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: The pattern of the byte-level pre-tokenizer (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Pieces, and token pairs, that a worker keeps at most; then it starts afresh.
KEEP_PIECES, KEEP_PAIRS = 400_000, 1_000_000
#: Above every rank of a merge.
NEVER = 1 << 60
#: Texts above this many characters are cut into pieces one by one, not as a list.
LONG = 2_000_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the rest from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of texts, prefixes of texts, and finds where a budget of tokens ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        to_bytes = {k: bytes(letters[c] for c in k) for k in vocab}
        self.token = {to_bytes[k]: v for k, v in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        #: Per token: the rank of the merge that makes it, its left and its right part.
        self.made = {vocab[a + b]: (i, vocab[a], vocab[b]) for i, (a, b) in enumerate(merges)}
        self.edges: tuple[dict, dict] = {}, {}
        # Suffix trie of the tokens: step[node << 8 | byte] is the node one byte further left, ends[node] its token or -1.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for data, t in self.token.items():
            node = 0
            for b in reversed(data):
                key = node << 8 | b
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = t
        self.pieces, self.spaces = regex.compile(PIECES), regex.compile(r"\s+")
        self.splits = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.stable: dict[int, bool] = {}
        counter = self

        class Counts(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= KEEP_PIECES:
                    self.clear()
                n = self[piece] = counter.prefix_counts(piece.encode())[-1]
                return n

        self.counts = Counts()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at this edge of a token while it is merged, from byte to token: each with the rank of the merge that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            symbol, ended, down = token, NEVER, [(token, NEVER)]
            while symbol in self.made:
                ended, *parts = self.made[symbol]
                symbol = parts[side]
                down.append((symbol, ended))
            known = self.edges[side][token] = down[::-1]
        return known

    def _fits(self, before: int, token: int) -> bool:
        """Whether two adjacent tokens stay as they are: no pair of symbols that meet at the seam merges before either is merged inwards."""
        left, right = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.rank.get(x << 20 | y, NEVER)
            if r < x_ends and r <= y_ends and r != NEVER:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:  # of equal merges the left one comes first
                i += 1
            else:
                j += 1

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ..., piece."""
        n = len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        step, ends, stable = self.step.get, self.ends, self.stable
        for end in range(1, n + 1):
            node, start = 0, end
            while start:
                start -= 1
                node = step(node << 8 | piece[start])
                t = ends[node]
                if t >= 0:
                    before = last[start]
                    if before < 0:
                        fit = True
                    else:
                        key = before << 20 | t
                        fit = stable.get(key)
                        if fit is None:
                            if len(stable) >= KEEP_PAIRS:
                                stable.clear()
                            fit = stable[key] = self._fits(before, t)
                    if fit:
                        last[end], count[end] = t, count[start] + 1
                        break
        return count

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Text between special strings, and the special strings (True)."""
        at = 0
        for m in self.splits.finditer(text) if self.splits else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        total, counts = 0, self.counts
        for part, special in self._parts(text):
            if special:
                total += 1
            elif len(part) <= LONG:
                total += sum(map(counts.__getitem__, self.pieces.findall(part)))
            else:
                total += sum(counts[m.group()] for m in self.pieces.finditer(part))
        return total

    def _by_character(self, piece: str) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., piece."""
        counts = self.prefix_counts(piece.encode())
        if len(counts) == len(piece) + 1:
            return counts[1:]
        ends = itertools.accumulate(len(c.encode()) for c in piece)
        return [counts[e] for e in ends]

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Character offsets of piece boundaries, and the tokens of text[:0], text[:1], ..., text."""
        at, tokens = [0], [0]
        for part, special in self._parts(text):
            if special:
                before = len(tokens) - 1
                # Cut short, it is ordinary text and joins the piece before it.
                start = at[-2] if len(at) > 1 else at[-1]
                while start and text[start - 1 : start].isspace():
                    start -= 1
                base = tokens[start]
                tokens += [base + self.count(text[start : before + k]) for k in range(1, len(part))]
                tokens.append(tokens[before] + 1)
                at.append(before + len(part))
                continue
            for p in self.pieces.findall(part):
                before = tokens[-1]
                if p in CONTRACTIONS:  # cut short, the apostrophe and the letters are pieces of their own
                    tokens += [before + self.counts["'"] + (self.counts[p[1:k]] if k > 1 else 0) for k in range(1, len(p))]
                    tokens.append(before + self.counts[p])
                else:
                    tokens += [before + n for n in self._by_character(p)]
                at.append(at[-1] + len(p))
            # A run of white space that ends a cut text is one piece, whatever follows it in the whole text.
            for m in self.spaces.finditer(part):
                first = at_part = len(tokens) - 1 - len(part) + m.start()
                tokens[at_part + 1 : at_part + 1 + len(m.group())] = [tokens[first] + n for n in self._by_character(m.group())]
        return at, tokens

    def tokens_before(self, text: str, at: list[int], tokens: list[int], end: int) -> int:
        """Tokens of text[:end]."""
        return tokens[end]

    def truncate(self, text: str, at: list[int], tokens: list[int], budget: int) -> int:
        """The largest piece boundary whose prefix has at most budget tokens."""
        return next(a for a in reversed(at) if tokens[a] <= budget)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per worker and vocabulary."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, n_bytes, n_tokens per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(public_tokenizers.path(vocabulary))
        for b in batches:
            n = [c.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, boundaries (of pieces, in characters), tokens (of the prefixes of 0, 1, ... characters): any prefix or budget by a look-up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(public_tokenizers.path(vocabulary))
        for b in batches:
            tables = [c.table(t.as_py()) for t in b.column(1)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[0] for t in tables], kind), pa.array([t[1] for t in tables], kind)], names=["id", "boundaries", "tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, boundaries array<long>, tokens array<long>")


def truncated(docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, text cut at the last piece boundary within budget tokens, n_tokens of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(public_tokenizers.path(vocabulary))
        for b in batches:
            out, n = [], []
            for t in b.column(1).to_pylist():
                table = c.table(t)
                out.append(t[: c.truncate(t, *table, budget)])
                n.append(table[1][-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64())], names=["id", "text", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_tokens long")
