"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

A page is cut to units: lines, and in long lines sentences and list stretches. Each unit shows five discrete signs (links,
tags or runs of short items, recurring word pairs, function words, sentence shape). A hidden Markov model with the states
prose, link list, tag list and menu explains the sequence; its best path labels every unit. A page is flagged where the
non-prose units hold more than FLAG of its characters. The signs of all pages are read once and written, some five bytes
for each unit; the starting tables below are re-estimated on all of them (hard EM), and every page is then labelled whole,
by one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.shared import quoted, spread, written

STATES = ("prose", "links", "tags", "menu")
#: Rounds of fitting, and the weight of the starting tables in units.
ROUNDS, PRIOR_UNITS = 2, 50.0
#: Share of non-prose characters above which a page is flagged: half-way between the half that other pages stay under
#: and the two thirds that stuffed ones pass.
FLAG = 0.58
STRETCH = 160
#: Characters, and units with known signs, that are worked on at a time.
PORTION, PORTION_UNITS = 4_000_000, 500_000
#: Function words of the corpus languages (fixed values).
FUNCTION_WORDS = frozenset(
    "a an and are as at be because before but by could does for from had has have he her his i if in into is it its just my no nor not of on or our out she so some still than that the their them then there they this those to until was we were what when which while who why will with without you your s t d m ll re ve don doesn can isn "
    "aber als am an auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für gegen hat im in ist ja kein mit nach nicht noch nur ob oder schon sich sie sind so über um und uns vom von vor war was weil wenn wie wir wird zu zum zur "
    "à au aux avec avant ce cette dans de des dès du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas pendant pour qu que qui sa se ses si son sont sur un une "
    "al con cuando de del desde donde durante el ella en era es esta este ha hasta la las lo los más no o para pero por porque que se si sin sobre su sus tras un una y ya".split()
)

#: What counts as a link, as a delimiter between short items, and as a sentence's end.
LINK = r"(?i)https?://[^\s<>()\]\"']+|www\.[^\s<>()\]\"']+|<a\b[^<>]*>|</a>|</?(?:li|ul|ol|nav)\b[^<>]*>|\b(?:[a-z0-9-]+\.)+[a-z]{2,}\s+[-|>:]"
DELIMITER = r"[,;|·•]\s|\s[/|·•-]\s"
ENDED = r"[.!?…:;][\"')\]*_\s]*$"
_CUT = re.compile(r"\n+|[.!?…][\"')\]]*\s+|<(?:/(?:li|p|a|h\d)|br)>", re.I)
_BREAK, _HIDDEN = r"[^\p{L}\p{N}]+", r"[\x{00AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"

#: Signs and their number of values.
SIGNS = {"link": 3, "tag": 3, "repeat": 3, "function": 3, "sentence": 2}
#: Starting tables: P(value | state) for each sign, states in the order of STATES.
START = {
    "link": [[0.9, 0.08, 0.02], [0.03, 0.12, 0.85], [0.96, 0.03, 0.01], [0.96, 0.03, 0.01]],
    "tag": [[0.985, 0.01, 0.005], [0.9, 0.09, 0.01], [0.03, 0.5, 0.47], [0.6, 0.39, 0.01]],
    "repeat": [[0.86, 0.12, 0.02], [0.5, 0.3, 0.2], [0.6, 0.25, 0.15], [0.04, 0.16, 0.8]],
    "function": [[0.12, 0.28, 0.6], [0.8, 0.15, 0.05], [0.9, 0.08, 0.02], [0.7, 0.15, 0.15]],
    "sentence": [[0.25, 0.75], [0.95, 0.05], [0.97, 0.03], [0.75, 0.25]],
}
STAY = 0.9


def units(text: str) -> list[str]:
    """The text's lines, cut at sentence ends, list items and, where neither comes, every STRETCH characters."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append(text[at : m.end()])
            at = m.end()
    out.append(text[at:])
    cut = []
    for u in out:
        while len(u) > 2 * STRETCH and (i := u.find(" ", STRETCH)) > 0:
            cut.append(u[: i + 1])
            u = u[i + 1 :]
        if u:
            cut.append(u)
    return cut


def _times(*columns: np.ndarray) -> np.ndarray:
    """How often each row of the given columns of numbers occurs among all rows."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0)
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group] if len(order) else 0
    return out


def signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit of the pages: its signs (in the order of SIGNS), its characters, and its page's number."""
    cut = [units(t) for t in texts]
    page = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
    u = pa.array([x for c in cut for x in c], pa.string())
    count = len(u)
    bare = pc.replace_substring_regex(u, LINK, " ")
    solid = lambda x: pc.utf8_length(pc.replace_substring(x, " ", "")).to_numpy().astype(np.float64)
    whole = solid(u)
    link = 1 - np.minimum(solid(bare), whole) / np.maximum(whole, 1)
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.utf8_normalize(pc.replace_substring_regex(bare, _HIDDEN, ""), form="NFKC")), _BREAK)
    flat = pc.dictionary_encode(pc.list_flatten(lists))
    names, code, unit = flat.dictionary, flat.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()
    real = code != pc.fill_null(pc.index(names, pa.scalar("")), -1).as_py()
    code, unit = code[real], unit[real]
    is_function = pc.is_in(names, value_set=pa.array(sorted(FUNCTION_WORDS))).to_numpy(zero_copy_only=False)
    is_number = pc.utf8_is_digit(names).to_numpy(zero_copy_only=False)
    n = np.bincount(unit, minlength=count)
    function = np.bincount(unit, weights=is_function[code], minlength=count) / np.maximum(n, 1)
    total = np.bincount(page, weights=n, minlength=len(texts))[page]
    often = np.maximum(5, 0.02 * total)
    # a sentence may come again as a whole; a stuffed one repeats its keyword within itself and all over the page
    keep = ~(is_function | is_number)[code]
    c, of = code[keep], unit[keep]
    size = np.bincount(of, minlength=count)
    pair = np.flatnonzero(of[1:] == of[:-1])
    left, right, where = c[pair], c[pair + 1], of[pair]
    prose = function[where] >= 0.2
    least = np.where(prose, np.maximum(5, 0.12 * total[where]), often[where])
    hit = (_times(left, right, page[where]) >= least) | prose & (_times(left, right, where) > 1)
    inside = np.zeros(len(c), bool)
    inside[pair[hit]] = inside[pair[hit] + 1] = True
    again = np.bincount(of, weights=inside, minlength=count) / np.maximum(size, 1)
    # short units that come again and again as they are
    mixed = np.zeros(count, np.uint64)
    place = np.arange(len(code)) - (np.cumsum(n) - n)[unit]
    np.add.at(mixed, unit, (code.astype(np.uint64) + np.uint64(1)) * np.power(np.uint64(0x9E3779B97F4A7C15), (place + 1).astype(np.uint64)))
    short = np.flatnonzero((n > 0) & (n < 6) & (function < 0.2))
    again[short[_times(mixed[short], n[short], page[short]) >= often[short]]] = 1.0
    tags = pc.count_substring_regex(u, r"#[\p{L}\p{N}_]").to_numpy() / np.maximum(n, 1)
    parted = pc.count_substring_regex(bare, DELIMITER).to_numpy()
    listed = (function <= 0.08) & (parted >= 4) & (n <= 5 * (parted + 1))
    rows = np.column_stack(
        [
            (link > 0.15).astype(np.int64) + (link > 0.4),
            np.where(tags > 0.4, 2, listed),
            (again > 0.4).astype(np.int64) + (again > 0.6),
            (function > 0.08).astype(np.int64) + (function >= 0.2),
            (n >= 4) & pc.match_substring_regex(u, ENDED).to_numpy(zero_copy_only=False),
        ]
    )
    return rows, pc.utf8_length(u).to_numpy(), page


class LineModel:
    """Start, transition and emission log-probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: dict[str, np.ndarray]):
        self.start, self.move, self.emit = np.log(start), np.log(move), [np.log(emit[s]) for s in SIGNS]

    @classmethod
    def initial(cls, counts: dict[str, np.ndarray] | None = None) -> "LineModel":
        """The starting tables, with observed counts added."""
        k, counts = len(STATES), counts or {}
        move = np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1))
        tables = {"start": np.array([0.7, 0.1, 0.1, 0.1]), "move": move} | {s: np.array(START[s]) for s in SIGNS}
        for name, t in tables.items():
            t = t * PRIOR_UNITS + counts.get(name, 0)
            tables[name] = t / t.sum(-1, keepdims=True)
        return cls(tables["start"], tables["move"], tables)

    def path(self, rows: np.ndarray, page: np.ndarray) -> np.ndarray:
        """The most probable states of the units of all pages, one step along all pages at a time."""
        like = sum(e[:, rows[:, i]].T for i, e in enumerate(self.emit)) if len(rows) else np.zeros((0, len(STATES)))
        heads = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(page) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(page)))
        by = np.argsort(-size, kind="stable")  # the longest pages first, so that those still going on come first
        heads, size = heads[by], size[by]
        going = [int(np.searchsorted(-size, -r, side="left")) for r in range(int(size[0]))] if len(size) else []
        back, out = np.zeros(like.shape, np.int8), np.zeros(len(like), np.int64)
        score = self.start + like[heads]
        for r in range(1, len(going)):
            m = going[r]
            step = score[:m, :, None] + self.move
            back[heads[:m] + r] = step.argmax(1)
            score[:m] = step.max(1) + like[heads[:m] + r]
        out[heads + size - 1] = score.argmax(1)
        for r in range(len(going) - 1, 0, -1):
            at = heads[: going[r]] + r
            out[at - 1] = back[at, out[at]]
        return out

    def counts(self, rows: np.ndarray, page: np.ndarray, path: np.ndarray) -> dict[str, np.ndarray]:
        k, within = len(STATES), page[1:] == page[:-1]
        out = {"start": np.bincount(path[np.append(True, ~within)] if len(path) else path, minlength=k), "move": np.zeros((k, k), np.int64)}
        np.add.at(out["move"], (path[:-1][within], path[1:][within]), 1)
        for i, (s, n) in enumerate(SIGNS.items()):
            out[s] = np.zeros((k, n), np.int64)
            np.add.at(out[s], (path, rows[:, i]), 1)
        return out


def signed(pages: DataFrame) -> DataFrame:
    """(id, codes, chars) of (id, text): for each unit of the page one byte for its signs, and its characters as int32."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _portions(batches):
            rows, chars, page = signs(texts)
            code = np.ravel_multi_index(tuple(rows.T), tuple(SIGNS.values())).astype(np.uint8)
            ends = np.cumsum(np.bincount(page, minlength=len(texts)))[:-1]
            packed = lambda x: pa.array([p.tobytes() for p in np.split(x, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, packed(code), packed(chars.astype(np.int32))], names=["id", "codes", "chars"])

    return spread(pages).mapInArrow(sign, f"id {pages.schema['id'].dataType.simpleString()}, codes binary, chars binary")


def fitted(signed: DataFrame) -> LineModel:
    """The model after ROUNDS of hard EM on all pages of (id, codes, chars)."""
    model = LineModel.initial()
    for _ in range(ROUNDS):

        def count(batches: Iterator[pa.RecordBatch], model: LineModel = model) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for _, rows, _, page in _unpacked(batches):
                for name, c in model.counts(rows, page, model.path(rows, page)).items():
                    total.update({(name, int(i)): int(c.flat[i]) for i in np.flatnonzero(c)})
            if total:
                yield pa.RecordBatch.from_pydict({"name": [k[0] for k in total], "cell": pa.array([k[1] for k in total], pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

        got = spread(signed).mapInArrow(count, "name string, cell bigint, n bigint").groupBy("name", "cell").agg(F.sum("n").alias("n")).collect()
        shapes = {"start": (len(STATES),), "move": (len(STATES), len(STATES))} | {s: (len(STATES), n) for s, n in SIGNS.items()}
        tables = {k: np.zeros(s) for k, s in shapes.items()}
        for r in got:
            tables[r.name].flat[r.cell] += r.n
        model = LineModel.initial(tables)
    return model


def labelled(df: DataFrame, id: str, text: str, model: LineModel | None = None) -> DataFrame:
    """(id, n_chars, non_prose, stuffed): each page's characters, the share of its non-prose units, and the verdict.

    Null, empty and blank texts have no units and come out with share 0 and stuffed false. Rows come out as often as
    they are, null ids stay null, an empty table gives no rows, further columns play no part.
    """
    kind = df.schema[id].dataType.simpleString()
    known = signed(df.select(F.col(quoted(id)).alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text")))
    if model is None:
        known = written(known, "signs")
        model = fitted(known)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, chars, page in _unpacked(batches):
            size = np.bincount(page, weights=chars, minlength=len(ids)).astype(np.int64)
            other = np.bincount(page, weights=chars * (model.path(rows, page) > 0), minlength=len(ids))
            share = other / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(share), pa.array(share > FLAG)], names=["id", "n_chars", "non_prose", "stuffed"])

    return spread(known).mapInArrow(label, f"id {kind}, n_chars bigint, non_prose double, stuffed boolean")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, and what ``signs`` gives for their pages, some PORTION_UNITS units at a time."""
    for b in batches:
        codes, chars = b.column("codes").to_pylist(), b.column("chars").to_pylist()
        a = n = 0
        for z, c in enumerate(codes, 1):
            n += len(c)
            if n >= PORTION_UNITS or z == len(codes):
                code = np.frombuffer(b"".join(codes[a:z]), np.uint8)
                page = np.repeat(np.arange(z - a), [len(x) for x in codes[a:z]])
                yield b.column("id").slice(a, z - a), np.column_stack(np.unravel_index(code, tuple(SIGNS.values()))), np.frombuffer(b"".join(chars[a:z]), np.int32), page
                a, n = z, 0


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, some PORTION characters at a time; blank texts come as empty ones."""
    for b in batches:
        texts = [t if t and not t.isspace() else "" for t in b.column("text").to_pylist()]
        a = n = 0
        for z, t in enumerate(texts, 1):
            n += len(t)
            if n >= PORTION or z == len(texts):
                yield b.column("id").slice(a, z - a), texts[a:z]
                a, n = z, 0
