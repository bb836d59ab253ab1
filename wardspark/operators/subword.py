"""Sub-word encoding (H1): words outside the vocabulary become known pieces.

The vocabulary is a table, not a trained tokenizer: the most frequent words of the corpus (or any table of words
and ids), each as a beginning and as a continuation of a word, and every single character. A distinct unseen
word is split once, greedily from the left by the longest piece, along a trie of the pieces; documents then look words
up as they look up whole ones (``tokens.encode_tokens``).

The piece table is bounded: ``max_words`` words of at most ``TOP_CHARS`` characters and the characters of the
script, so its trie is sent to the workers, which build it once each. Distinct words, which grow with the data,
are never collected.

Cases: a word for which some place has no fitting piece is one [UNK]; an empty word has no ids.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardspark.operators.tokens import TOP_CHARS, UNK, WORD_BASE


class Trie:
    """Pieces by their characters, one tree for beginnings and one for continuations."""

    def __init__(self, pieces: list[tuple[str, bool, int]]):
        self.pieces = pieces

    @cached_property
    def roots(self) -> tuple[dict, dict]:
        roots: tuple[dict, dict] = ({}, {})
        for piece, inner, number in self.pieces:
            node = roots[inner]
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = number
        return roots

    def split(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            node, end, found, i = self.roots[at > 0], at, None, at
            while i < len(word) and (node := node.get(word[i])) is not None:
                i += 1
                if "" in node:
                    end, found = i, node[""]
            if found is None:
                return [UNK]
            out.append(found)
            at = end
        return out


def piece_table(vocab: DataFrame, max_words: int = 30_000) -> DataFrame:
    """(token, freq, id) -> (piece, inner, id): the first ``max_words`` words keep their ids as beginnings and have
    id + max_words as continuations; the other characters of the vocabulary follow in order."""
    words = vocab.where((F.col("id") < WORD_BASE + max_words) & (F.length("token") <= TOP_CHARS)).select(F.col("token").alias("piece"), "id")
    chars = vocab.select(F.explode(F.array_distinct(F.split("token", ""))).alias("piece")).where("piece != ''").distinct()
    chars = chars.join(words, "piece", "left_anti")
    # one row a character of the script: a window without a key is bounded by Unicode
    chars = chars.select("piece", (F.lit(WORD_BASE + 2 * max_words) + 2 * (F.row_number().over(Window.orderBy("piece")) - 1)).alias("id"))
    both = [words.select("piece", F.lit(False).alias("inner"), "id"), words.select("piece", F.lit(True), F.col("id") + max_words),
            chars.select("piece", F.lit(False), "id"), chars.select("piece", F.lit(True), F.col("id") + 1)]
    out = both[0]
    for more in both[1:]:
        out = out.union(more)
    return out.select("piece", "inner", F.col("id").cast("int").alias("id"))


def split_words(words: DataFrame, pieces: DataFrame, token: str = "token") -> DataFrame:
    """Distinct words -> (token, ids), by the longest pieces."""
    rows = [(r["piece"], r["inner"], r["id"]) for r in pieces.select("piece", "inner", "id").collect()]  # bounded by max_words and Unicode
    sent = words.sparkSession.sparkContext.broadcast({"pieces": rows})  # a worker keeps its trie beside them

    @F.arrow_udf("array<int>")
    def ids(col: pa.Array) -> pa.Array:
        held = sent.value
        trie = held.get("trie") or held.setdefault("trie", Trie(held["pieces"]))
        return pa.array([None if w is None else trie.split(w) for w in col.to_pylist()], pa.list_(pa.int32()))

    return words.select(F.col(token).alias("token"), ids(F.col(token)).alias("ids"))
