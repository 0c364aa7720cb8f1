"""Encoding by a public byte-pair vocabulary with per-prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding. An automaton over the vocabulary
yields, at each position, all tokens that are suffixes of the prefix. The right one is the token whose own start is a
prefix with a last token that is *compatible* with it: merging by rank would keep the two apart. One pass stores the
last token of each prefix; following the back-pointers from the end emits the ids. Work is linear in the text, however
long a piece is, and no merge queue is kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.shared import quoted, spread

#: Pieces and pairs remembered by one encoder before it forgets them all.
MEMORY = 500_000


class PrefixEncoder:
    """An encoder for one vocabulary file of base64 tokens with ranks, and the pattern that cuts texts to pieces."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import ahocorasick
        import regex

        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines() if line)}
        self.cut = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and not self._learn(token, rank, ranks):
                continue  # no sequence of merges ends in it
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.apart.clear()

    def _learn(self, token: bytes, rank: int, ranks: dict[bytes, int]) -> bool:
        """The two tokens whose merge makes ``token``: the only split of lower ranks that stays apart until then."""
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i], rank), ranks.get(token[i:], rank)
            if a < rank and b < rank and (i == 1 or a in self.halves) and (i == len(token) - 1 or b in self.halves) and self._compatible(a, b):
                self.halves[rank] = a, b
                self.merged[a, b] = rank
                return True
        return False

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay neighbours when their joined bytes are merged by rank.

        Undoes merges from the last on the side that was made later; a pair across the border that merges before the
        merges undone so far would have joined the two sides.
        """
        bound = 1 << 62
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            if a > b:
                if a in self.halves:
                    bound, a = a, self.halves[a][1]
                elif b in self.halves:
                    bound, b = b + 1, self.halves[b][0]
                else:
                    return True
            elif b in self.halves:
                bound, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                bound, a = a, self.halves[a][1]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= MEMORY:
                self.apart.clear()
            known = self.apart[a, b] = self._compatible(a, b)
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        data = text.encode("utf-8").decode("latin-1")
        last, step = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (size, rank) in self.automaton.iter(data):
            e = end + 1
            if last[e] < 0:
                before = e - size
                if not before or (last[before] >= 0 and self.compatible(last[before], rank)):
                    last[e], step[e] = rank, size
        out, e = [], len(data)
        while e:
            out.append(last[e])
            e -= step[e]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text as it stands, without special tokens; none for an empty or null text."""
        out: list[int] = []
        for p in self.cut(text or ""):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 64:
                    if len(self.pieces) >= MEMORY:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out += ids
        return out


_encoders: dict[tuple[int, str], PrefixEncoder] = {}


def encoded(df: DataFrame, id: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id, ids): the token ids of every row's text; the empty list for an empty and for a null text.

    ``vocabulary`` is the path of a vocabulary file on the driver; its bytes (a fixed size, whatever the data) are
    broadcast. Special tokens' strings in a text are ordinary text. Repeated rows come out as often as they are, null
    ids stay null, an empty table gives no rows, further columns play no part. Nothing is shuffled.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value), pattern
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = PrefixEncoder(shared.value, pattern)
        encode = _encoders[key].encode
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                ids = pa.array([encode(t) for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("id"), ids], names=["id", "ids"])

    kind = df.schema[id].dataType.simpleString()
    src = df.select(F.col(quoted(id)).alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    return spread(src).mapInArrow(run, f"id {kind}, ids array<int>")
