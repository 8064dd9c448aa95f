"""Encoding of texts with a public byte-level BPE vocabulary, and decoding, in Spark SQL expressions.

A text is cut into words by the vocabulary's pattern, and the ids of each distinct word are found once, as far as they fit
into a bounded map. A word's bytes are the first pieces of a fold, and each step of it unites the leftmost pair of neighbours
whose union has the lowest rank, until no union is a token. Two bytes that stand side by side in no token at all are never
united, nor are two where no token fits their neighbours, so words are cut there first, and the parts, of which there are far
fewer different ones, are folded.

The maps are literals of the query (scalar subqueries): arrays of small maps, found by a hash, since a lookup in a Spark map
is linear. There are three: ranks by the bytes of a token (the rank file's size), ids by the bytes of the ``PARTS`` most
frequent parts, and ids by word, of the tokens and the ``WORDS_HELD`` most frequent words. The bounds change no result: a word
that isn't held is cut into parts, and a part that isn't held is folded, where it stands.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import checkpointed
from loomgraph.sources.tables import table

#: Folder of the public tokenizers' files, see its README; nothing of it is copied.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: So many words and parts at most are held with their ids, whatever the corpus, each of at most so many bytes (some 40 MB in all).
WORDS_HELD, PARTS, HELD_BYTES = 1 << 18, 1 << 17, 64

_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Fixed value: the pattern by which the byte-level vocabularies cut texts, with white space spelled out.
WORDS = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file (base64 and number on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _buckets(n: int) -> int:
    return max(16, 1 << (n - 1).bit_length())


def parts_pattern(ranks: dict[bytes, int]) -> str:
    """Cuts bytes (as characters of ISO-8859-1) where no token can lie across.

    A token that lies across two bytes is these two, or has them with the byte before, or begins with them and goes on.
    """
    pairs: dict[int, set[int]] = {}
    before: dict[int, dict[int, set[int]]] = {}
    beyond: dict[int, dict[int, set[int]]] = {}
    for token in ranks:
        for i, (a, b) in enumerate(zip(token, token[1:])):
            if token[i : i + 2] in ranks:
                pairs.setdefault(a, set()).add(b)
            elif i:
                before.setdefault(a, {}).setdefault(b, set()).add(token[i - 1])
            else:
                beyond.setdefault(a, {}).setdefault(b, set()).add(token[2])
    some = lambda codes: "[" + "".join(rf"\x{c:02x}" for c in sorted(codes)) + "]"

    def alike(sets: dict[int, set[int]]) -> list[tuple[str, str]]:
        keys: dict[frozenset[int], list[int]] = {}
        for b, x in sets.items():
            keys.setdefault(frozenset(x), []).append(b)
        return sorted((some(b), some(x)) for x, b in keys.items())

    on: dict[str, list[int]] = {}
    for a in sorted({*pairs, *before, *beyond}, key=lambda a: (-len(pairs.get(a, ())), a)):
        ways = [f"(?={some(pairs[a])})"] if a in pairs else []
        ways += [f"(?={b})(?<={x}.)" for b, x in alike(before.get(a, {}))] + [f"(?={b}{x})" for b, x in alike(beyond.get(a, {}))]
        on.setdefault("|".join(ways), []).append(a)
    return f"(?s)(?:{'|'.join(f'{some(a)}(?:{ways})' for ways, a in on.items())})*+." if on else "(?s)."


def _place(key: Column, n: int) -> Column:
    return F.hash(key).bitwiseAND(F.lit(n - 1))


def _map_literal(entries: DataFrame, n: int) -> Column:
    """array<map<key,value>> of n maps by hash of the key, from (key, value) with each key once; n is a power of two."""
    held = entries.select(_place(F.col("key"), n).alias("at"), F.struct("key", "value").alias("entry"))
    # an array by place, so that a lookup needs no search; some places have no key
    places = entries.sparkSession.range(n).select(F.col("id").cast("int").alias("at"), F.lit(None).cast(held.schema["entry"].dataType).alias("entry"))
    maps = held.unionByName(places).groupBy("at").agg(F.sort_array(F.collect_list("entry")).alias("m"))
    row = maps.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: F.map_from_entries(x["m"])).alias("maps"))
    return checkpointed(row).scalar()  # several queries use it


def _found(maps: Column, n: int, key: Column) -> Column:
    """Value of a key in a map literal, null if it isn't there."""
    return F.try_element_at(F.get(maps, _place(key, n)), key)


class Encoder:
    """Encodes with one vocabulary within a session."""

    def __init__(self, spark: SparkSession, name: str = "byte_bpe_50k", folder: str | None = None):
        self.spark = spark
        self.ranks = read_ranks(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"))
        self.tokens = spark.createDataFrame(pa.table({"key": pa.array(list(self.ranks), pa.binary()), "value": pa.array(list(self.ranks.values()), pa.int32())}), "key binary, value int")
        self.pattern = parts_pattern(self.ranks)
        self.literals = {"ranks": (_map_literal(self.tokens, _buckets(len(self.ranks))), _buckets(len(self.ranks)))}

    def _with_literals(self, df: DataFrame, keep: list[str], name: str, body: Callable[[Callable[[str, Column], Column]], Column]) -> DataFrame:
        """``keep`` and ``name`` = body(look), where look(literal, key) is the value of a key, null if it has none.

        Subqueries can't be written within higher-order functions. As columns of a projection below, each used once, the
        optimizer puts them there; no row ever carries them.
        """
        held = F.struct(*(F.col(f"_{k}").alias(k) for k in self.literals))
        look = lambda x: lambda literal, key: _found(x[literal], self.literals[literal][1], key) if literal in self.literals else F.lit(None).cast("array<int>")
        bound = F.transform(F.array(held), lambda x: body(look(x)))
        return df.withColumns({f"_{k}": maps for k, (maps, _) in self.literals.items()}).select(*keep, F.get(bound, F.lit(0)).alias(name))

    def _fold(self, rank: Callable[[Column], Column], word: Column) -> Column:
        """Token ids of some bytes (array<int>), by ranked merges; ``rank`` is null for what is no token."""
        size = F.octet_length(word)
        rest = F.lit(1 << 30)
        # r holds the rank of each pair of neighbours, and null before the first and after the last piece: the pairs that a
        # union leaves at an edge come out null by themselves, as there is no piece to unite with
        pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(0), size), lambda i: F.when((i > 0) & (i < size), rank(F.substring(word, i, F.lit(2)))))
        start = F.struct(pieces.alias("p"), pairs.alias("r"))

        def merged(s: Column, i: Column, union: Column) -> Column:
            # i: place from 1 in r of the pair, that is of its second piece in p
            around = F.transform(F.array(F.concat(F.get(s["p"], i - 3), union), F.concat(union, F.get(s["p"], i))), rank)
            return F.struct(
                F.concat(F.slice(s["p"], F.lit(1), i - 2), F.array(union), F.slice(s["p"], i + 1, rest)).alias("p"),
                F.concat(F.slice(s["r"], F.lit(1), i - 2), around, F.slice(s["r"], i + 2, rest)).alias("r"),
            )

        def step(s: Column, _: Column) -> Column:
            at = F.array_position(s["r"], F.array_min(s["r"])).cast("int")  # null if there is nothing to unite
            unite = lambda i: F.transform(F.array(F.concat(F.get(s["p"], i - 2), F.get(s["p"], i - 1))), lambda union: merged(s, i, union))
            once = F.transform(F.array(at), lambda i: F.when(i.isNull(), s).otherwise(F.get(unite(i), F.lit(0))))
            return F.get(once, F.lit(0))

        folded = F.aggregate(F.sequence(F.lit(2), size), start, step, lambda s: F.transform(s["p"], rank))
        return F.when(size == 1, F.array(rank(word))).otherwise(folded)

    def words(self, text: Column) -> Column:
        """The words of a text (array<string>), null for null."""
        return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def parts(self, word: Column) -> Column:
        """The bytes of a word (array<binary>), cut where no token can lie across."""
        cut = F.regexp_extract_all(F.decode(word.cast("binary"), "ISO-8859-1"), F.lit(self.pattern), F.lit(0))
        return F.transform(cut, lambda p: F.encode(p, "ISO-8859-1"))

    def _ids(self, look: Callable[[str, Column], Column], word: Column) -> Column:
        """Token ids of a word, from its parts."""
        rank = lambda piece: look("ranks", piece)
        return F.flatten(F.transform(self.parts(word), lambda p: F.coalesce(look("parts", p), self._fold(rank, p))))

    def remember(self, texts: DataFrame, column: str, words_held: int = WORDS_HELD, parts_held: int = PARTS) -> Encoder:
        """Folds the distinct parts and words of ``texts``, the most frequent ones if there are too many to be held."""
        # outer: else a filter for empty arrays is put before, which finds the words a second time
        words = texts.select(F.explode_outer(self.words(F.col(column))).alias("word")).filter(F.octet_length("word") <= HELD_BYTES)
        known = self.tokens.select(F.col("key").cast("string").alias("word"))
        counted = checkpointed(words.groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti"))
        parts = counted.select("n", F.explode_outer(self.parts(F.col("word"))).alias("key")).groupBy("key").agg(F.sum("n").alias("n"))
        tasks = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))  # a number: small partitions aren't joined, as each row costs much
        frequent = parts.filter("n > 1").orderBy(F.desc("n"), "key").limit(parts_held).select("key").repartition(tasks, "key")
        folded = self._with_literals(frequent, ["key"], "value", lambda look: self._fold(lambda p: look("ranks", p), F.col("key")))
        self.literals["parts"] = (_map_literal(folded, _buckets(parts_held)), _buckets(parts_held))
        often = counted.filter("n > 1").orderBy(F.desc("n"), "word").limit(words_held).select(F.col("word").alias("key")).repartition(tasks, "key")
        ids = self._with_literals(often, ["key"], "value", lambda look: self._ids(look, F.col("key")))
        tokens = self.tokens.select(F.col("key").cast("string").alias("key"), F.array("value").alias("value")).filter(F.is_valid_utf8("key"))
        n = _buckets(words_held + len(self.ranks)) // 2
        self.literals["words"] = (_map_literal(ids.unionByName(tokens), n), n)
        return self

    def encode(self, df: DataFrame, text: str, name: str = "ids") -> DataFrame:
        """``df`` with the token ids of a text column (array<int>); of null and of '' none."""
        ids = lambda look: F.transform(self.words(F.col(text)), lambda w: F.coalesce(look("words", w), self._ids(look, w)))
        # made flat outside the functions' bodies, which aren't compiled and would make an object of each id
        nested = self._with_literals(df, df.columns, "_ids", ids)
        return nested.select(*df.columns, F.coalesce(F.flatten("_ids"), F.array().cast("array<int>")).alias(name))

    def decode(self, df: DataFrame, ids: str, name: str = "text") -> DataFrame:
        """``df`` with the text of token ids: their binary pieces, concatenated. An id that doesn't exist gives null."""
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        held = self.spark.createDataFrame(pa.table({"pieces": pa.array([pieces], pa.list_(pa.binary()))}), "pieces array<binary>").scalar()
        bound = F.transform(F.array(F.col("_pieces")), lambda p: F.array_join(F.transform(F.col(ids), lambda i: F.hex(F.get(p, i))), ""))
        return df.withColumn("_pieces", held).select(*df.columns, F.unhex(F.get(bound, F.lit(0))).cast("string").alias(name))


def encode_documents(documents: DataFrame, encoder: Encoder) -> DataFrame:
    """doc_id and ids (array<int>) of each document; null and empty texts give an empty list, other columns are ignored.

    Strings of special tokens are ordinary text. No shuffle of texts: each is encoded where it is read. A single word
    without any break costs time in proportion to the square of its length.
    """
    return encoder.encode(documents.select("doc_id", "text"), "text").select("doc_id", "ids")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text")
    return encode_documents(documents, Encoder(spark).remember(documents, "text"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are, and how many come back from their ids unchanged."""
    documents = table(spark, d, "documents", "doc_id", "text")
    encoder = Encoder(spark).remember(documents, "text")
    whole = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    return encoder.decode(encoder.encode(whole, "text"), "ids", "back").agg(F.count("*").alias("documents"), F.count_if(F.col("text") == F.col("back")).alias("same"))


QUERIES = {"p6_ids": p6_ids, "p6_round_trip": p6_round_trip}
SQL: dict[str, str] = {"p6_round_trip": "SELECT count(*) AS documents, count(*) AS same FROM documents"}
