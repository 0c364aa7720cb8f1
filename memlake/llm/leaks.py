"""Evaluation passages in training texts, by a distributed positional inverted index.

The index is sharded by documents and stored: every task turns its documents to words once and writes, for each term,
the sorted positions at which it occurs (``positional_index``). The test items, a stated query set taken in blocks, then
go to every stored shard; however many blocks there are, the texts are read once. In a shard each run of SEED item words
is looked up from its rarest term: that term's positions, less its offset in the run, are intersected with the
offset-adjusted positions of the next rarer term, and so on, for all runs at once; what is left are exact phrase hits.
Every hit is grown in both directions with the proximity rule: a changed, inserted or lost word is passed over where at
least REJOIN words agree again behind it, and so is what stands before the text of a line (its label).
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.plans.runs import pack, unpack
from memlake.plans.shared import quoted, spread, written

SEED, REJOIN = 4, 2
#: Words of a passage, those of them that must agree, and agreeing words for each edit.
LEAST_WORDS, LEAST_EQUAL, WORDS_PER_EDIT = 20, 16, 4
#: Items of one query block; characters of one shard of the index.
ITEM_BLOCK, SHARD_CHARS = 5_000, 8_000_000
#: Item and document words passed over at an edit, the likeliest first.
EDITS = ((1, 1), (0, 1), (0, 2), (1, 2), (1, 0), (2, 2), (2, 1), (0, 3))
#: Words before the text of a line that are its label, at most: more are text of their own. Words that agree behind it.
LABEL_WORDS, LABEL_REJOIN = 12, 3

#: How texts become words, in order: what is cut or replaced, and by what.
RULES = (
    (r"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\p{Mn}\p{Cf}]", ""),
    (r"(?i)</?(?:b|i|em|strong|span|u|s|a|font|mark|small|sub|sup|code)\b[^<>]*>", ""),
    (r"<[^<>]*>", " "),
    (r"\]\([^()\s]*\)", "] "),
    (r"[\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]+", "\n"),
    (r"(?m)^[ \t]*(?:(?:[>*•|+#-]+|\[[^\]\n]*\]|\p{N}+[.):]?|\p{N}[\p{N}T:.,/+-]*Z?|\p{L}[\p{L}\p{N}_-]*:)[ \t]+)+|^[ \t]*>+[ \t]*", ""),
    (r"['’‘`´]", ""),
    (r"\n", " \ue000 "),
)
_LINE = "\ue000"
_BREAK = r"[^\p{L}\p{N}\x{E000}]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each word of the texts in order its term's number, its text's number and whether it begins a line.

    Words come without case, character form, invisible characters, markup, common line labels and punctuation.
    """
    marked = pc.fill_null(pc.match_substring(texts, "&"), False)
    if pc.any(marked).as_py():
        texts = pc.replace_with_mask(texts, marked, pa.array([html.unescape(t) for t in texts.filter(marked).to_pylist()], texts.type))
    texts = pc.utf8_normalize(pc.replace_substring(texts, _LINE, " "), form="NFKD")
    for pattern, by in RULES:
        texts = pc.replace_substring_regex(texts, pattern, by)
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), _BREAK)
    flat = pc.dictionary_encode(pc.list_flatten(lists))
    of = pc.list_parent_indices(lists).to_numpy()
    names, code = flat.dictionary, flat.indices.to_numpy()
    # the same terms once, after full case folding
    folded = pa.array([w if w.isascii() else w.casefold() for w in names.to_pylist()], pa.string())
    once = pc.dictionary_encode(folded)
    code = once.indices.to_numpy()[code] if len(code) else code
    skip = {w: pc.index(once.dictionary, pa.scalar(w)).as_py() for w in ("", _LINE)}
    line = code == skip[_LINE]
    first = np.ones(len(code), bool)
    first[1:] = of[1:] != of[:-1]
    real = ~line & (code != skip[""])
    # a word begins a line if a break or a text's first place lies between it and the word before
    breaks = np.cumsum(line | first)
    at = np.flatnonzero(real)
    starts = np.ones(len(at), bool)
    starts[1:] = breaks[at[1:]] != breaks[at[:-1]]
    return once.dictionary, code[at].astype(np.int64), of[at], starts


def plain_words(text: str) -> list[str]:
    """The words of one text."""
    terms, code, _, _ = words_of(pa.array([text]))
    return terms.take(pa.array(code)).to_pylist()


INDEX = pa.schema([("docs", pa.binary()), ("terms", pa.binary()), ("postings", pa.binary()), ("lines", pa.binary())])


def positional_index(docs: DataFrame, id: str, text: str, name: str = "postings") -> DataFrame:
    """The stored index of a table, one row for each shard of documents: its documents (id, first position), its terms in
    order with their number of positions, the positions of all terms one after the other, and the first words of lines.

    Null ids and empty texts are left out; repeated rows come as often as they are.
    """
    src = docs.select(F.col(quoted(id)).alias("doc"), F.col(quoted(text)).cast("string").alias("text")).where("doc is not null and text <> ''")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.utf8_length(b.column("text")).to_numpy()
            shard = (np.cumsum(size) - size) // SHARD_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    yield shard_of(b.column("doc").slice(a, z - a), b.column("text").slice(a, z - a))

    blobs = ", ".join(f"{f.name} binary" for f in INDEX)
    return written(spread(src).mapInArrow(build, blobs), name)


GAP = 8


def shard_of(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    terms, code, of, starts = words_of(texts)
    # documents lie GAP positions apart
    position = np.arange(len(code)) + GAP * (of + 1)
    order = np.argsort(code, kind="stable")
    df = np.bincount(code, minlength=len(terms))
    first = np.searchsorted(of, np.arange(len(ids))) + GAP * (np.arange(len(ids)) + 1)
    posted = position[order]
    step = np.diff(posted, prepend=0)
    parts = pa.table({"doc": ids, "first": first}), pa.table({"term": terms, "df": df}), pa.table({"step": step.astype(np.int32)}), pa.table({"first": np.diff(position[starts], prepend=0).astype(np.int32)})
    return pa.RecordBatch.from_pydict({f.name: [pack(t)] for f, t in zip(INDEX, parts, strict=True)}, schema=INDEX)


class Items:
    """A block of test items: their terms, words by term number, and the distinct runs of SEED words with their places."""

    def __init__(self, rows: list[tuple[object, str]]):
        terms, code, of, _ = words_of(pa.array([t for _, t in rows], pa.string()))
        self.terms, self.ids, self.words, runs = terms, [], [], {}
        for i, w in enumerate(np.split(code, np.searchsorted(of, np.arange(1, len(rows))))):
            if len(w) >= LEAST_WORDS:
                for k in range(len(w) - SEED + 1):
                    runs.setdefault(tuple(w[k : k + SEED].tolist()), []).append((len(self.ids), k))
                self.ids.append(rows[i][0])
                self.words.append(w)
        self.runs = np.array(list(runs), np.int64).reshape(-1, SEED)
        self.places = list(runs.values())


class Shard:
    """A stored shard of the index, ready to be searched for ``items``."""

    def __init__(self, row: dict[str, bytes], items: Items):
        docs, terms, postings, lines = (unpack(pa.py_buffer(row[f.name])) for f in INDEX)
        self.ids, self.start = docs.column("doc").combine_chunks(), docs.column("first").to_numpy()
        self.df = terms.column("df").to_numpy()
        self.positions = np.cumsum(postings.column("step").to_numpy(), dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        size = (int(self.positions.max()) if len(self.positions) else 0) + 2 * GAP
        self.words = np.full(size, -1, np.int64)
        self.words[self.positions] = np.repeat(np.arange(len(self.df)), self.df)
        heads = np.zeros(size, bool)
        heads[np.cumsum(lines.column("first").to_numpy(), dtype=np.int64)] = True
        self.heads = heads
        own = pc.index_in(items.terms, value_set=terms.column("term").combine_chunks())
        self.number = pc.fill_null(own, -2).to_numpy().astype(np.int64)

    def phrases(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, position) of all places at which the words of a run stand next to each other."""
        which = np.flatnonzero((runs >= 0).all(1))
        if not len(which):
            return which, which
        df = self.df[runs[which]]
        by = np.argsort(df, axis=1, kind="stable")
        rare = np.take_along_axis(runs[which], by, 1)
        n = df.min(1)
        run = np.repeat(np.arange(len(which)), n)
        at = self.positions[np.repeat(self.first[rare[:, 0]] - np.cumsum(n) + n, n) + np.arange(n.sum())] - by[run, 0]
        for o in range(1, SEED):
            ok = self.words[np.minimum(at + by[run, o], len(self.words) - 1)] == rare[run, o]
            run, at = run[ok], at[ok]
        return which[run], at

    def stretches(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, first item word, first document word, length) of all longest stretches of at least SEED equal words."""
        run, at = self.phrases(self.number[items.runs])
        n = np.array([len(items.places[r]) for r in run.tolist()], np.int64)
        item, k = (np.array([x[c] for r in run.tolist() for x in items.places[r]], np.int64) for c in (0, 1))
        at = np.repeat(at, n)
        order = np.lexsort((k, at - k, item))
        item, k, at = item[order], k[order], at[order]
        opens = np.ones(len(item), bool)
        opens[1:] = (item[1:] != item[:-1]) | (k[1:] != k[:-1] + 1) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(opens)
        return item[first], k[first], at[first], np.diff(np.append(first, len(item))) + SEED - 1

    def hits(self, items: Items) -> set[tuple[int, int]]:
        """(document number, item number) of all leaks."""
        out: set[tuple[int, int]] = set()
        which, ks, ats, sizes = self.stretches(items)
        if not len(which):
            return out
        docs = np.searchsorted(self.start, ats, side="right") - 1
        words, text, heads = [self.number[w].tolist() for w in items.words], self.words.tolist(), self.heads.tobytes()
        for item, k, p, n, d in zip(which.tolist(), ks.tolist(), ats.tolist(), sizes.tolist(), docs.tolist(), strict=True):
            if (d, item) not in out:
                right, reach, e1 = grown(text, heads, words[item], k + n - 1, p + n - 1, 1)
                left, back, e2 = grown(text, heads, words[item], k, p, -1)
                equal, edits = n + left + right, e1 + e2
                if n + reach + back + (2 if edits else 0) >= LEAST_WORDS and equal >= LEAST_EQUAL and equal >= WORDS_PER_EDIT * edits:
                    out.add((d, item))
        return out


def grown(doc: list[int], heads: bytes, item: list[int], i: int, j: int, step: int) -> tuple[int, int, int]:
    """From item word i and document word j in direction ``step``: the words that go on to agree, how far the last of
    them lies, and the edits passed over. Labels of lines cost no edit. A document ends in GAP words of its own."""
    n, origin, equal, edits = len(item), i, 0, 0
    two = REJOIN * step
    while True:
        x = i + step
        if 0 <= x < n and item[x] == doc[j + step]:
            equal, i, j = equal + 1, x, j + step
            continue
        b = behind_label(doc, heads, item, i, j, step)
        if b is not None:
            j = b
            continue
        for di, dj in EDITS:
            a, b = i + step * di, j + step * dj
            if 0 <= a + two < n and item[a + step] == doc[b + step] and item[a + two] == doc[b + two]:
                i, j, edits = a, b, edits + 1
                break
        else:
            return equal, abs(i - origin), edits


def behind_label(doc: list[int], heads: bytes, item: list[int], i: int, j: int, step: int) -> int | None:
    """The document word behind (or, backwards, before) which the item goes on, past the label of a line next to word j."""
    if not 0 <= i + LABEL_REJOIN * step < len(item) or not (heads[j + 1] if step > 0 else not heads[j]):
        return None
    wanted = item[i + 1 : i + 1 + LABEL_REJOIN] if step > 0 else item[i - LABEL_REJOIN : i]
    if step > 0:
        for b in range(j + 1, j + 1 + LABEL_WORDS):
            if doc[b] == -1 or b > j + 1 and heads[b]:
                return None
            if doc[b + 1 : b + 1 + LABEL_REJOIN] == wanted:
                return b
    else:
        for b in range(j - 1, j - 1 - LABEL_WORDS, -1):
            if doc[b] == -1:
                return None
            if heads[b]:
                return b if doc[b - LABEL_REJOIN : b] == wanted else None
    return None


def searched(index: DataFrame, items: Items, doc_kind: str, item_kind: str) -> DataFrame:
    """(doc_id, item_id) of the leaks of one block of items."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row, items)
                found = shard.hits(items)
                if found:
                    yield pa.RecordBatch.from_pydict({"doc_id": shard.ids.take(pa.array([d for d, _ in found])), "item_id": [items.ids[i] for _, i in found]})

    try:
        return written(spread(index).mapInArrow(search, f"doc_id {doc_kind}, item_id {item_kind}").distinct(), "leaks")
    finally:
        shared.destroy()


def leaked(docs: DataFrame, doc_id: str, doc_text: str, evals: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id): each document that carries at least 20 words of an item in order and next to each other.

    At least 16 of them must agree, with at most one edit (changed, inserted or lost word) for every four; where there
    are edits the first and the last word may be changed too. A passage of two items gives both. Null, empty and shorter
    items and null texts give nothing; rows with a null id are ignored; repeated rows count once; empty tables give no
    rows; further columns play no part. The items are read to the driver in blocks of 5000 and sent to every shard of
    the stored index; more items only mean more passes over the index.
    """
    dk, ik = docs.schema[doc_id].dataType.simpleString(), evals.schema[item_id].dataType.simpleString()
    wanted = evals.select(F.col(quoted(item_id)).alias("item"), F.col(quoted(item_text)).cast("string").alias("text")).where("item is not null and text <> ''")
    out = docs.sparkSession.createDataFrame([], f"doc_id {dk}, item_id {ik}")
    index = positional_index(docs, doc_id, doc_text)

    def passes() -> Iterator[Items]:
        block = []
        for r in wanted.toLocalIterator():
            block.append((r.item, r.text))
            if len(block) == ITEM_BLOCK:
                yield Items(block)
                block = []
        if block:
            yield Items(block)

    for items in passes():
        if items.ids:
            out = out.union(searched(index, items, dk, ik))
    return out.distinct()
