"""Documents over a limit of tokens, cut into overlapping pieces at natural boundaries.

Each token of a document becomes one character that says what ends with it: a paragraph (P), line (L), sentence (S),
clause (C), word (W), something within a word (x), or part of a character (-). A regular expression with bounded
quantifiers then takes the pieces out of that string: its alternatives are ordered by the strength of the boundary, each
consumes as much as it can up to the limit, and any place between two characters is the last resort. Overlap is a
lookback: a piece starts ``overlap`` tokens before the end of the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.sizes import tokenizer
from loomgraph.llm.tokenizing import TOKENIZERS
from loomgraph.sources.tables import table

#: A boundary of any strength is taken only if the piece has this share of what it may have; else the next weaker one, and
#: any boundary at all before a place within a word.
LEAST = 0.5


def boundaries(texts: list[bytes], ends: list[np.ndarray]) -> list[str]:
    """One character for each token of each text, given the offsets in bytes at which they end; all texts at once."""
    sizes = [len(e) for e in ends]
    if not sum(sizes):
        return ["" for _ in texts]
    b = np.frombuffer(b"".join(b"\n\n\n" + t + b"\n\n" for t in texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 5 for t in texts[:-1])]) + 3
    at = np.concatenate(ends).astype(np.int64) + np.repeat(starts, sizes)  # of the byte after the token
    one, two, three, nxt = b[at - 1], b[at - 2], b[at - 3], b[at]
    kind = np.zeros(256, np.uint8)  # of single bytes: 1 blank, 2 ends a clause, 3 ends a sentence
    kind[[9, 10, 11, 12, 13, 32]], kind[[44, 58, 59]], kind[[33, 46, 63]] = 1, 2, 3
    before, after_blank = kind[one], kind[nxt] == 1
    marks = np.full(len(at), ord("x"), np.uint8)
    marks[after_blank | (before == 1)] = ord("W")
    marks[(before == 2) & after_blank] = ord("C")
    marks[(before == 3) & after_blank] = ord("S")
    cjk, wide = (three == 0xE3) & (two == 0x80), (three == 0xEF) & (two == 0xBC)
    if cjk.any() or wide.any():  # ideographic and full-width stops and commas
        marks[(cjk & (one == 0x81)) | (wide & ((one == 0x8C) | (one == 0x9A) | (one == 0x9B)))] = ord("C")
        marks[(cjk & (one == 0x82)) | (wide & ((one == 0x81) | (one == 0x9F)))] = ord("S")
    marks[(one == 10) | (nxt == 10)] = ord("L")
    marks[(one == 10) & (two == 10)] = ord("P")
    marks[(nxt & 0xC0) == 0x80] = ord("-")
    whole, cuts = marks.tobytes().decode(), np.cumsum([0, *sizes])
    return [whole[i:j] for i, j in zip(cuts, cuts[1:])]


def pattern(limit: int, overlap: int) -> str:
    """Takes pieces out of a string of marks: the first up to ``limit`` tokens, further ones up to ``limit - overlap``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap has to be smaller than the limit")

    def up_to(n: int) -> str:
        least = int(n * LEAST)
        strong = [f".{{{least},{n - 1}}}[{'PLSCW'[:k]}]" for k in range(1, 6)] if n > 1 else []
        return "|".join([f".{{1,{n}}}\\z", *strong, f".{{0,{n - 1}}}[PLSCW]", f".{{0,{n - 1}}}[^-]", f".{{1,{n}}}"])

    return f"\\A(?:{up_to(limit)})|(?:{up_to(limit - overlap)})"


def marked_documents(documents: DataFrame, least: dict[str, int], folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, text, tokenizer, marks and ends (array<int>, in bytes), for documents of more tokens than ``least`` of a tokenizer.

    A token has a byte at least (one may stand for a blank put before the text), so shorter texts aren't encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = [t.encode() for t in texts]
            for name, n in least.items():
                ends = [tokenizer(folder, name).ends(t) if len(r) >= n else () for t, r in zip(texts, raw)]
                kept = [i for i, e in enumerate(ends) if len(e) > n]
                marks = boundaries([raw[i] for i in kept], [ends[i] for i in kept])
                offsets = np.cumsum([0, *(len(m) for m in marks)]).astype(np.int32)
                flat = np.concatenate([ends[i] for i in kept]).astype(np.int32) if kept else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[i] for i in kept], pa.int64()), pa.array([texts[i] for i in kept], pa.string()), pa.array([name] * len(kept), pa.string()),
                        pa.array(marks, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    names=["doc_id", "text", "tokenizer", "marks", "ends"],
                )

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.octet_length("text") >= min(least.values()))
    return texts.mapInArrow(run, "doc_id bigint, text string, tokenizer string, marks string, ends array<int>")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Prefix sums are made in blocks of so many numbers, as an array that grows by one is copied for each.
BLOCK = 256


def _sums(numbers: Column) -> Column:
    """Prefix sums of an array<int>."""

    def simple(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))

    def whole(own: Column) -> Column:
        before = simple(F.concat(F.array(F.lit(0)), F.transform(own, lambda xs: F.element_at(xs, -1))))
        return F.flatten(F.zip_with(own, F.slice(before, F.lit(1), F.size(own)), lambda xs, o: F.transform(xs, lambda x: x + o)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda k: simple(F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK))))
    return _bound(blocks, whole)


def _pieces(found: Column, overlap: Column) -> Column:
    """The pieces (array of structs) of a document, given the strings of marks that make them up (one at least).

    Everything that a piece needs is cut out of bytes at a known place, so that the time is linear in the document.
    """

    def piece(x: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.greatest(F.get(x["at"], i - 1) - overlap, F.lit(0)))
        return _bound(F.struct(start.alias("s"), F.get(x["at"], i).alias("e")), lambda y: text(x, i, y["s"], y["e"]))

    def text(x: Column, i: Column, start: Column, end: Column) -> Column:
        # the mark of the token before tells if the start is within a character; then the first place after it that is not
        part = F.length(F.regexp_extract(F.substring(x["marks"], start, end - start).cast("string"), "^-*", 0))
        first = F.when(start == 0, 0).otherwise(F.get(x["ends"], start - 1 + part))
        cut = F.substring(x["bytes"], first + 1, F.get(x["ends"], end - 1) - first).cast("string")
        return F.struct(i.alias("piece_no"), start.alias("start_token"), end.alias("end_token"), (end - start).alias("n_tokens"), cut.alias("text"))

    held = F.struct(_sums(F.transform(found, F.length)).alias("at"), F.col("marks").cast("binary").alias("marks"), F.col("text").cast("binary").alias("bytes"), F.col("ends").alias("ends"))
    return _bound(held, lambda x: F.transform(F.sequence(F.lit(0), F.size(x["at"]) - 1), lambda i: piece(x, i)))


def split_documents(documents: DataFrame, budgets: list[tuple[int, str, int, int]], folder: str = TOKENIZERS) -> DataFrame:
    """The pieces of all documents that exceed a budget: budget_id, doc_id, piece_no, start_token, end_token, n_tokens, text.

    ``budgets``: (budget_id, tokenizer, capacity, overlap). Tokens count from 0 within the document's own encoding; piece k
    is [start_token, end_token), at most ``capacity`` long, and starts ``overlap`` tokens before the end of piece k - 1
    (where that has so many). ``text`` is what these tokens stand for; should an overlap start within a character, it begins with
    the next whole one. Null, empty and shorter documents give nothing; other columns are ignored.
    """
    if not budgets:
        return documents.sparkSession.createDataFrame([], "budget_id int, doc_id bigint, piece_no int, start_token int, end_token int, n_tokens int, text string")
    least: dict[str, int] = {}
    for _, name, capacity, _ in budgets:
        least[name] = min(capacity, least.get(name, capacity))
    marked = marked_documents(documents, least, folder)
    of_budget = F.array(*(F.struct(F.lit(b).cast("int").alias("budget_id"), F.lit(n).alias("name"), F.lit(c).alias("capacity")) for b, n, c, _ in budgets))
    each = marked.withColumn("b", F.explode(F.filter(of_budget, lambda b: (b["name"] == F.col("tokenizer")) & (F.length("marks") > b["capacity"]))))
    found, overlap = F.lit(None), F.lit(None)
    for b, _, c, o in budgets:
        this = F.col("b.budget_id") == b
        found = F.when(this, F.regexp_extract_all("marks", F.lit(pattern(c, o)), F.lit(0))).otherwise(found)
        overlap = F.when(this, o).otherwise(overlap)
    # the array alone goes on to be taken apart: each of its rows would else be made with a copy of the whole document
    cut = each.select("b.budget_id", "doc_id", "text", "marks", "ends", found.alias("_found"), overlap.alias("_overlap"))
    cut = cut.select("budget_id", "doc_id", _pieces(F.col("_found"), F.col("_overlap")).alias("_pieces"))
    # outer: else a filter for empty arrays is put before, which does all of this again (there is one piece at least)
    return cut.select("budget_id", "doc_id", F.inline_outer("_pieces"))


def split_budgets(budgets: DataFrame) -> list[tuple[int, str, int, int]]:
    """(budget_id, tokenizer, capacity, overlap) of the ``split`` rows of token_budgets, a table of a few rows that doesn't grow."""
    rows = budgets.filter("purpose = 'split' and capacity_tokens > 0").select("budget_id", "tokenizer", "capacity_tokens", F.coalesce("overlap_tokens", F.lit(0))).distinct().orderBy("budget_id")
    return [tuple(r) for r in rows.collect()]


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), split_budgets(table(spark, d, "token_budgets")))


QUERIES = {"p8_pieces": p8_pieces}
SQL: dict[str, str] = {}
