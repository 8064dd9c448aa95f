import random
import re

import numpy as np
import pytest
from loomgraph.llm import packing, splitting
from loomgraph.llm.sizes import tokenizer
from loomgraph.llm.tokenizing import TOKENIZERS, Encoder, encode_documents, parts_pattern, read_ranks
from loomgraph.sources.tables import table

ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n \n\n  x"), (5, "don't I'll we've <|endoftext|> <s>"), (6, "naïve café, 日本語のテキスト。 Привет! 123456 ½ ²"), (7, "  a​́ \x00\x07\x1c"),
    (8, "😀👩‍👩‍👧 ﷽"), (9, "a" * 700), (10, "Name" * 40 + "=" * 90), (11, "SessionTokenExecutor " * 3000), (12, "\r\n\t\r\nx  "), (13, "SessionTokenExecutor"), (14, "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id bigint, text string, ids string")


@pytest.mark.parametrize("memo", [False, True])
def test_encoding_equals_the_library(spark, odd, memo):
    encoder = Encoder(spark)
    if memo:
        encoder.remember(odd, "text", 4)
    library = tokenizer(TOKENIZERS, "byte_bpe_50k").encoding
    got = {r.doc_id: r.ids for r in encode_documents(odd, encoder).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in ODD}
    back = encoder.decode(encoder.encode(odd.select("doc_id", "text"), "text"), "ids", "back")
    assert all((r.text or "") == r.back for r in back.collect())
    assert encode_documents(odd.limit(0), encoder).count() == 0


def test_encoding_of_documents(spark, data):
    documents = table(spark, data("sf0.001"), "documents")
    library = tokenizer(TOKENIZERS, "byte_bpe_50k").encoding
    encoder = Encoder(spark).remember(documents, "text")
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert {r.doc_id: r.ids for r in encode_documents(documents, encoder).collect()} == {i: library.encode_ordinary(t or "") for i, t in texts.items()}


def test_parts_are_cut_where_no_token_lies_across():
    few = {t: i for i, t in enumerate([b"a", b"b", b"c", b"d", b"cd", b"abc", b"bcd"])}
    assert [re.findall(parts_pattern(few), x) for x in ("xbcx", "abcx", "xbcd", "cdcd")] == [["x", "b", "c", "x"], ["abc", "x"], ["x", "bcd"], ["cd", "cd"]]
    ranks, r = read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), random.Random(4)
    cut = re.compile(parts_pattern(ranks)).findall
    assert cut(" PaymentNodeBuilder") == [" Payment", "Node", "Builder"]  # by pairs of bytes alone it stays whole
    tokens, longest, cuts = list(ranks), max(map(len, ranks)), 0
    for _ in range(3000):
        text = b"".join(t[r.randint(0, 2) :] for t in r.choices(tokens, k=4)) + r.randbytes(2)
        parts = [x.encode("latin-1") for x in cut(text.decode("latin-1"))]
        assert b"".join(parts) == text
        at = 0
        for x in parts[:-1]:
            at, cuts = at + len(x), cuts + 1
            assert not any(text[a:b] in ranks for a in range(max(0, at - longest), at) for b in range(at + 1, min(len(text), a + longest) + 1))
    assert cuts > 3000


def test_packing(spark):
    r = random.Random(1)
    sizes = [(i, b, r.choice([1, 3, 50, 99, 100, 101, 250, r.randint(1, 100)])) for i in range(4000) for b in (1, 2)]
    capacities = {1: 100, 2: 64}
    rows = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, budget_id int, n_tokens bigint"), capacities).collect()
    fill, parts = {}, {}
    for x in rows:
        fill[x.budget_id, x.container] = fill.get((x.budget_id, x.container), 0) + x.n_tokens
        parts.setdefault((x.budget_id, x.doc_id), []).append((x.piece_no, x.start_token, x.n_tokens))
    assert all(f <= capacities[b] for (b, _), f in fill.items())
    for doc, budget, n in sizes:
        c = capacities[budget]
        assert sorted(parts[budget, doc]) == [(k, s, min(c, n - s)) for k, s in enumerate(range(0, n, c))]
    for b, c in capacities.items():
        used = [f for (k, _), f in fill.items() if k == b]
        assert sum(used) / (len(used) * c) > 0.85
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, budget_id int, n_tokens bigint"), capacities).count() == 0


def test_merging_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = packing.pack(spark.createDataFrame([(i, 1, 7 + i % 5) for i in range(300)], "doc_id bigint, budget_id int, n_tokens bigint"), {1: 30}).collect()
    fill = {}
    for x in rows:
        fill[x.container] = fill.get(x.container, 0) + x.n_tokens
    assert len({x.doc_id for x in rows}) == len(rows) == 300 and max(fill.values()) <= 30 and len(fill) < 1.15 * sum(fill.values()) / 30


def test_sizes_of_odd_texts(spark, odd):
    budgets = [(1, "byte_bpe_50k", 512), (3, "piece_bpe_32k", 512)]
    got = {(r.doc_id, r.budget_id): r.n_tokens for r in packing.sized_documents(odd, budgets).collect()}
    assert got == {(i, b): n for i, t in ODD if t for b, name, _ in budgets if (n := tokenizer(TOKENIZERS, name).size(t))}


@pytest.mark.parametrize("name", ["byte_bpe_50k", "piece_bpe_32k"])
def test_ends_cover_the_text(name):
    t = tokenizer(TOKENIZERS, name)
    for _, text in ODD:
        if text:
            ends = t.ends(text)
            assert len(ends) == t.size(text) == len(splitting.boundaries([text.encode()], [ends])[0]) and (np.diff(ends) >= 0).all()
            assert ends[-1] == len(text.encode()) or name.startswith("piece")


def test_ends_by_words_are_those_of_the_whole_text(monkeypatch):
    t, r = tokenizer(TOKENIZERS, "piece_bpe_32k"), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "the", "aB", "XML", "():", "→", "—x", "5", "12", "\r", ",", "\x7f", "日", "　", "😀", ".", "    ", "\x00", "\r\n"]
    texts = [x for _, x in ODD if x] + ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    got = [t.ends(x) for x in texts]
    with monkeypatch.context() as m:
        m.setattr(t, "by_words", False)
        assert all(np.array_equal(a, t.ends(x)) for a, x in zip(got, texts)) and len(t.ends("")) == 0
    assert t.by_words and len(t.ends("")) == 0
    with monkeypatch.context() as m:
        m.setattr(t, "model", None)  # words that were met aren't encoded again
        assert len(t.ends("the the\n5")) == t.ends("the the\n5").size > 0
        with pytest.raises(AttributeError):
            t.ends("unheardOfBefore")
    m = type(t.words)(t)
    monkeypatch.setattr(type(t.words), "HELD", 3)
    assert b"".join(m[w] for w in (" a", "b", " the", "5", " a")) == b"".join(t.words[w] for w in (" a", "b", " the", "5", " a")) and len(m) <= 3


def test_splitting(spark, data, odd):
    budgets = [(4, "byte_bpe_50k", 64, 16), (5, "byte_bpe_50k", 40, 0), (6, "piece_bpe_32k", 128, 8)]
    documents = table(spark, data("sf0.001"), "documents").select("doc_id", "text").union(odd.selectExpr("-doc_id", "text")).union(odd.filter("false").selectExpr("doc_id", "text"))
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {}
    for r in splitting.split_documents(documents, budgets).collect():
        got.setdefault((r.budget_id, r.doc_id), []).append(r)
    natural = total = 0
    for b, name, capacity, overlap in budgets:
        t = tokenizer(TOKENIZERS, name)
        for doc, text in texts.items():
            n = t.size(text) if text else 0
            if n <= capacity:
                assert (b, doc) not in got
                continue
            pieces = sorted(got[b, doc], key=lambda r: r.piece_no)
            assert [r.piece_no for r in pieces] == list(range(len(pieces))) and pieces[0].start_token == 0 and pieces[-1].end_token == n
            ends = t.ends(text)
            raw = text.encode()
            marks = splitting.boundaries([b"", raw, b"x"], [ends[:0], ends, np.array([1])])[1]
            for a, c in zip(pieces, pieces[1:]):
                assert c.start_token == max(0, a.end_token - overlap) and c.end_token > a.end_token
                total += 1
                natural += marks[a.end_token - 1] in "PLSCW"
            for r in pieces:
                assert r.n_tokens == r.end_token - r.start_token <= capacity
                cut = raw[(ends[r.start_token - 1] if r.start_token else 0) : ends[r.end_token - 1]]
                assert cut.decode(errors="ignore").endswith(r.text) and len(cut) - len(r.text.encode()) <= 3 and "�" not in r.text.replace(text, "")
            if overlap == 0:
                assert "".join(r.text for r in pieces) == text
    assert natural > 0.9 * total > 100
    assert splitting.split_documents(documents.limit(0), budgets).count() == 0


def test_boundaries_are_taken_by_strength():
    import re

    find = re.compile(splitting.pattern(8, 2).replace("\\z", "\\Z")).findall
    assert find("xxxxPxWx" + "xWxSxW")[0] == "xxxxP" and find("xxxPxxWx" + "xWxSxW")[0] == "xxxPxxW" and find("xWxxxxxxx" + "xxxxxx")[0] == "xW"
    assert find("xxxxWxLxxxxxxxxx")[0] == "xxxxWxL" and "".join(find("x" * 50)) == "x" * 50
    with pytest.raises(ValueError):
        splitting.pattern(8, 8)
