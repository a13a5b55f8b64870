"""Exact counts of a SentencePiece BPE model's tokens by rank-synchronous merging over ragged numpy arrays.

A text becomes pre-tokens at places that no piece of the vocabulary spans: before each run of blanks, and around line
ends. Pre-tokens not seen before are held as one flat array of symbols with the sequence each belongs to. In every
round each sequence looks up the ranks of its neighbouring pairs, finds its lowest, and all sequences merge that pair
at once; a sequence without a mergeable pair leaves the arrays and its surviving symbols are counted, a symbol outside
the vocabulary as its UTF-8 bytes (byte fallback). A pair is merged at all its places of a sequence only if no merge it
enables has a lower rank and its rank is not shared by another piece; else only at the leftmost, as the library does.

Nulls count as empty texts: 0 bytes, 0 tokens. Repeated rows are each counted, a null doc_id is carried along, an empty table gives
an empty result; columns other than doc_id and text are not read. Texts of any length are counted whole: sequences of over
``LONG`` symbols merge the same pairs in the same order from a heap, in n log n time.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from inkgauge.llm.common import Remembered, map_slices

_NONE = np.int64(1 << 60)
#: Symbols of one pre-token above which the heap takes over.
LONG = 2048
_PARTS = re.compile(" +[^ \n]*|[^ \n]+|\n")


class RankMerger:
    """Counts of surviving symbols for pre-tokens of a model (path of a SentencePiece BPE model with identity normaliser)."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = [sp.id_to_piece(i) for i in ids]
        if any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("a piece spans a blank or a line end: pre-tokens would not be independent")
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in ids}))}
        rank = {p: order[-sp.get_score(i)] for p, i in zip(pieces, ids, strict=True)}
        symbols = list(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))
        at = {s: i for i, s in enumerate(symbols)}
        self.size = len(symbols)
        #: What a symbol adds to a count if it survives.
        self.cost = np.array([1 if s in rank else len(s.encode()) for s in symbols], np.int64)
        chars = sorted((ord(s), i) for s, i in at.items() if len(s) == 1)
        self.codes, self.code_ids = (np.array(x, np.int64) for x in zip(*chars, strict=True))
        shared = [r for r, n in zip(*np.unique(list(rank.values()), return_counts=True), strict=True) if n > 1]
        cautious = {p for p in pieces if rank[p] in shared}
        pairs = []
        for q in pieces:
            for cut in range(1, len(q)):
                left, right = q[:cut], q[cut:]
                cautious.update(p for p in (left, right) if rank.get(p, -1) > rank[q])
                if left in at and right in at:
                    pairs.append((at[left] * self.size + at[right], rank[q], at[q]))
        pairs.sort()
        self.pair, self.pair_rank, self.pair_to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.cautious = np.zeros(self.size, bool)
        self.cautious[[at[p] for p in cautious]] = True

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each character, -1 outside the vocabulary; its count if it survives."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = self.codes[place] == code
        symbol = np.where(found, self.code_ids[place], -1)
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        return symbol, np.where(found, self.cost[symbol], n_bytes)

    def _ranks(self, left: np.ndarray, right: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where(together & (left >= 0) & (right >= 0), left * self.size + right, -1)
        place = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        found = self.pair[place] == key
        return np.where(found, self.pair_rank[place], _NONE), self.pair_to[place]

    def counts(self, tokens: list[str]) -> list[int]:
        out = np.zeros(len(tokens), np.int64)
        long = {i for i, t in enumerate(tokens) if len(t) > LONG}
        for i in long:
            out[i] = self._by_heap(tokens[i])
        short = ["" if i in long else t for i, t in enumerate(tokens)]
        symbol, cost = self._symbols("".join(short))
        seq = np.repeat(np.arange(len(tokens)), [len(t) for t in short])
        while len(symbol):
            rank, to = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
            rank[:-1], to[:-1] = self._ranks(symbol[:-1], symbol[1:], seq[:-1] == seq[1:])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            number = np.cumsum(np.r_[False, seq[1:] != seq[:-1]])
            live = (lowest < _NONE)[number]
            if not live.all():
                out += np.bincount(seq[~live], cost[~live], len(tokens)).astype(np.int64)
                symbol, cost, seq, rank, to, number = (x[live] for x in (symbol, cost, seq, rank, to, number))
                if not len(symbol):
                    break
            take = rank == lowest[number]
            places = np.flatnonzero(take)
            first = np.r_[True, number[places[1:]] != number[places[:-1]]]
            # In runs of neighbouring places every second one from the left can merge.
            fresh = np.r_[True, (places[1:] != places[:-1] + 1)]
            since = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            lead = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
            places = places[np.where(self.cautious[to[lead]], first, since % 2 == 0)]
            symbol[places] = to[places]
            cost[places] = self.cost[to[places]]
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            symbol, cost, seq = symbol[keep], cost[keep], seq[keep]
        return out.tolist()

    def _by_heap(self, token: str) -> int:
        symbol, cost = self._symbols(token)
        rank, to = self._ranks(symbol[:-1], symbol[1:], np.ones(len(symbol) - 1, bool))
        sym, n = symbol.tolist(), len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, sym[i], sym[i + 1], t) for i, (r, t) in enumerate(zip(rank.tolist(), to.tolist(), strict=True)) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if sym[i] is not None else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = new, None
            cost[i] = self.cost[new]
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and sym[x] >= 0 and sym[y] >= 0:
                    key = sym[x] * self.size + sym[y]
                    at = int(np.searchsorted(self.pair, key))
                    if at < len(self.pair) and self.pair[at] == key:
                        heapq.heappush(heap, (int(self.pair_rank[at]), x, sym[x], sym[y], int(self.pair_to[at])))
        return sum(int(c) for s, c in zip(sym, cost.tolist(), strict=True) if s is not None)


@functools.lru_cache(maxsize=1)
def counter(model_path: str) -> Callable[[list[str | None]], list[int]]:
    """A function from texts to token counts that remembers pre-tokens, in a Python worker from task to task."""
    merger = RankMerger(model_path)
    known = Remembered(lambda new: merger.counts([t.replace(" ", "▁") for t in new]))

    def count(texts: list[str | None]) -> list[int]:
        parts = [_PARTS.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        value = known.of(set().union(*parts)).__getitem__
        return [sum(map(value, p)) for p in parts]

    return count


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; other columns are not read."""

    def work():
        count = counter(model_path)

        def run(ids: list, texts: list) -> list:
            n = count(texts)
            return [ids, [len(t.encode()) if t else 0 for t in texts], n, [x > limit for x in n]]

        return run

    return map_slices(docs, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", work, ["doc_id", "text"])
