"""Token encoding, leaks and stuffed pages on small texts."""

import base64
import os
import random

import numpy as np
import pytest

from memlake.llm import queries as q
from memlake.llm.leaks import leaked, plain_words
from memlake.llm.stuffing import SIGNS, LineModel, labelled, signs, units
from memlake.llm.tokens import PrefixEncoder, encoded

VOCABULARY = f"{q.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    raw = open(VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return PrefixEncoder(raw, q.BYTE_BPE_PATTERN), tiktoken.Encoding("own", pat_str=q.BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs_vocabulary
def test_same_ids_as_merging_by_rank(both):
    mine, known = both
    rng = random.Random(2)
    texts = ["", " ", "Hello world", "x" * 5000, "ab" * 3000, "<|endoftext|>", "naïve 漢字 😀\r\n\t  end ", "​﻿\x00", " " * 400 + "a"]
    texts += ["".join(rng.choice("abcdehilnorst  \n'éß漢😀#_-1.") for _ in range(rng.randrange(300))) for _ in range(300)]
    for t in texts:
        assert mine.encode(t) == known.encode_ordinary(t)
        assert known.decode(mine.encode(t)) == t


@needs_vocabulary
def test_encoding_of_a_table(spark, both):
    data = [(1, "a tale", "x"), (2, "", "x"), (3, None, "x"), (1, "a tale", "x"), (None, "b", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = sorted((r.id or 0, list(r.ids)) for r in encoded(df, "doc_id", "text", VOCABULARY, q.BYTE_BPE_PATTERN).collect())
    a, b = both[1].encode_ordinary("a tale"), both[1].encode_ordinary("b")
    assert got == [(0, b), (1, a), (1, a), (2, []), (3, [])]
    assert encoded(df.limit(0), "doc_id", "text", VOCABULARY, q.BYTE_BPE_PATTERN).collect() == []


ITEM = "Only six guests knew the old beekeeper dropped seven small canoes on top of the goat pasture. Later a visiting pilot counted nine velvet teapots inside the mill while nobody had asked about the missing harp."
WORDS = ITEM.split()


def test_leaks(spark):
    passage = " ".join(WORDS[3:27])
    changed = " ".join("(sic) bee" if i == 9 else w for i, w in enumerate(WORDS[3:28]))
    lines = "\n".join(f"[09:{i:02d}] " + " ".join(WORDS[i : i + 6]) for i in range(0, 30, 6))
    quoted = "\n".join("> " + " ".join(WORDS[i : i + 7]) for i in range(0, 28, 7))
    docs = [
        (1, "Before. " + passage + " After."), (2, passage.upper()), (3, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in passage)), (4, changed), (5, lines), (6, quoted),
        (7, passage.replace("e", "e​")), (8, "<p><b>" + passage.replace(" ", "</b> <b>") + "</b></p>"), (9, " ".join(WORDS[5:16])), (10, " ".join(reversed(WORDS))), (11, None), (12, ""), (13, ("filler words here " * 20_000) + passage), (1, "Before. " + passage + " After."), (None, passage),
    ]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, "Unlike. " + ITEM), (9, "too short"), (10, None), (None, ITEM)], "item_id bigint, text string")
    got = {tuple(r) for r in leaked(d, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(i, k) for i in (1, 2, 3, 4, 5, 6, 7, 8, 13) for k in (7, 8)}
    assert leaked(d.limit(0), "doc_id", "text", items, "item_id", "text").collect() == []
    assert leaked(d, "doc_id", "text", items.limit(0), "item_id", "text").collect() == []


def test_leaks_behind_labels_of_lines(spark):
    stamped = lambda label, n: "\n".join(label + " ".join(WORDS[i : i + n]) for i in range(0, 30, n))
    docs = [
        (1, stamped("2024-01-05 10:22:01 INFO ", 6)), (2, stamped("run.retried - ", 5)), (3, stamped("x" * 700 + ": ", 6)), (4, stamped("| 09:14 | Night Shift: ", 8)), (5, stamped("<p class='" + "y" * 900 + "'>", 6)),
        (6, " ".join(WORDS[2:19])), (7, "a " * 9 + " ".join(WORDS[2:12]) + "\nother words of a line that say nothing of it and go on for long, at last " + " ".join(WORDS[12:21])),
    ]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(7, ITEM)], "item_id bigint, text string"), "item_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5]


def test_items_in_blocks(spark, monkeypatch):
    from memlake.llm import leaks

    monkeypatch.setattr(leaks, "ITEM_BLOCK", 2)
    monkeypatch.setattr(leaks, "SHARD_CHARS", 300)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(5)]
    docs = [(i, f"{i} filler " * 20 + " ".join(f"w{i}x{k}" for k in range(4, 28))) for i in range(5)] + [(9, " ".join(t for _, t in items))]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(5)] + [(9, i) for i in range(5)]


def test_leak_behind_a_short_match(spark):
    item = [f"w{i:02d}" for i in range(50)]
    far = item[:7] + ["x1", "x2", "x3"] + item[10:35]
    split = item[:9] + ["x1", item[10], "x2"] + item[12:40]
    docs = [(1, " ".join(far)), (2, " ".join(split)), (3, " ".join(item[:9])), (4, "a b " + " ".join(item[20:41])), (5, " ".join(item[3:12]))]
    got = leaked(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), "doc_id", "text", spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string"), "item_id", "text")
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4]


def test_plain_words():
    assert plain_words("12. Don’t­ stop\n[10:22] the   Büro") == ["dont", "stop", "the", "buro"]


PROSE = "The night shift closed the ticket because the disk was full. Then the queue was drained, and nobody lost a message. "


def test_stuffed_pages(spark):
    keyword = ", ".join(["cheap vector store", "fast recall"] * 40)
    pages = [
        (1, PROSE * 6), (2, keyword), (3, "\n".join(f"https://shop.example/deal/{i}" for i in range(40))), (4, " ".join(f"#tag{i} #sale{i}" for i in range(80))), (5, PROSE + "\n" + keyword),
        (6, PROSE * 12 + "\nTags: memory, deal, cable"), (7, None), (8, ""), (9, " \n\t"), (10, "Order memory api today! Our memory api is fast memory api. Get memory api now. " * 12),
        (11, "<ul>" + "".join(f'<li><a href="https://a.example/{i}">deal {i}</a></li>' for i in range(40)) + "</ul>"), (12, "x" * 100_000), (13, " / ".join(f"usb cable SKU{i}{i}" for i in range(60))), (None, PROSE),
    ]
    df = spark.createDataFrame([(i, t, True) for i, t in pages], "doc_id bigint, text string, stuffed boolean")
    got = {r.id: r.stuffed for r in labelled(df, "doc_id", "text").collect()}
    assert {k for k, v in got.items() if v} == {2, 3, 4, 5, 10, 11, 13}
    assert labelled(df.limit(0), "doc_id", "text").collect() == []


def test_model_is_fitted_on_every_page(spark, monkeypatch):
    seen, initial = [], LineModel.initial

    def counted(counts=None):
        seen.append(counts)
        return initial(counts)

    monkeypatch.setattr(LineModel, "initial", counted)
    pages = [(i, "A line." if i % 3 else "deal, shop, cable, price, stock\nwww.a.example") for i in range(2_600)] + [(2_600, None), (2_601, " ")]
    got = labelled(spark.createDataFrame(pages, "doc_id bigint, text string"), "doc_id", "text")
    own = [(i, t) for i, t in pages if t and t.strip()]
    units_of = sum(len(units(t)) for _, t in own)
    assert [c["start"].sum() for c in seen[1:]] == [len(own)] * 2 and [c["link"].sum() for c in seen[1:]] == [units_of] * 2
    assert sorted((r.id, r.n_chars) for r in got.collect()) == [(i, len(t) if t and t.strip() else 0) for i, t in pages]


def test_units_keep_every_character():
    for t in (PROSE * 3, "a" * 1000, "one\n\ntwo. three", " ".join(["word"] * 500)):
        assert "".join(units(t)) == t
    rows, chars, page = signs([PROSE, "", PROSE * 3])
    assert chars[page == 0].sum() == len(PROSE) and set(page.tolist()) == {0, 2} and (LineModel.initial().path(rows, page) == 0).all()


def test_paths_of_many_pages_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes = [5, 1, 40, 2, 40, 7]
    page, rows = np.repeat(np.arange(6) * 2, sizes), np.column_stack([rng.integers(0, k, sum(sizes)) for k in SIGNS.values()])
    model = LineModel.initial()
    for p in np.unique(page):
        alone = rows[page == p]
        like = sum(e[:, alone[:, i]].T for i, e in enumerate(model.emit))
        score, back = model.start + like[0], []
        for x in like[1:]:
            step = score[:, None] + model.move
            back.append(step.argmax(0))
            score = step.max(0) + x
        way = [int(score.argmax())]
        for b in reversed(back):
            way.append(int(b[way[-1]]))
        assert model.path(rows, page)[page == p].tolist() == way[::-1]


def test_long_links_are_links(spark):
    page = "\n".join(f"https://shop.example/{'x' * 400}/{i}" for i in range(20))
    rows, _, _ = signs([page])
    assert (rows[:, list(SIGNS).index("link")] == 2).all()
