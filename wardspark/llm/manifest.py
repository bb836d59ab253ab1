"""Merkle manifest of a dataset as a persistent, path-copying tree.

Every row is a leaf, the SHA-256 of its fields; the leaves of a language ascend by doc_id, and every two
consecutive nodes become their hash until one remains, the language's subroot; the subroots, by language,
give the root in the same way.

The tree is cut into aligned blocks of ``2 ** BITS`` nodes. One task row is one block: it holds every level
of its part of the tree once. A tampered leaf makes a new version: only its ancestors in the block are
copied, every other node is shared with the first version. The block's root, or the version's copy of it,
goes on through the levels above; these are blocks of block roots, built tier by tier as Spark jobs, and each
node gets its steps (sides and siblings) up to the root. No tier gathers more than ``2 ** BITS`` nodes in
one group, and versions go upward along their own block's steps, so the blocks above never hold them.

Positions come from a range partition by (language, doc_id, leaf) that is stored once, so any number of
rows of one language, or of one doc_id, is spread.

Cases: a null field is ``-``; a null language is a tree of its own, sorted first; rows of one doc_id are
ordered by leaf, those without an id come after all others and are never tampered; equal rows are equal
leaves next to each other; a null n_chars stays null when tampered; a language of one row has that leaf as
its subroot; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardspark.llm.common import parallelism, stage, take_columns

BITS = 10                      # levels of a block
LEFT, RIGHT, ALONE = 0, 1, 2   # where the sibling of a node stands


def digest_of(nodes: list[bytes]) -> bytes:
    """Digest of a run of nodes, as hex text one after the other."""
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def height(n: int) -> int:
    """Levels of a block above ``n`` nodes of the whole tier."""
    return min(BITS, (n - 1).bit_length())


def grow(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels above ``leaves``, themselves first."""
    tree = [leaves]
    for _ in range(levels):
        below = tree[-1]
        tree.append([digest_of(below[i:i + 2]) for i in range(0, len(below), 2)])
    return tree


def steps(tree: list[list[bytes]], at: int) -> list[tuple[int, bytes]]:
    """Side and sibling at every level from node ``at`` of the lowest level to the top."""
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((ALONE, b"") if other >= len(level) else (LEFT if at & 1 else RIGHT, level[other]))
        at >>= 1
    return out


def copy_path(node: bytes, path: list[tuple[int, bytes]]) -> list[bytes]:
    """A version with ``node`` in place of the old one: the copies of its ancestors, lowest first."""
    copies = [node]
    for side, other in path:
        here = copies[-1]
        copies.append(digest_of([other, here] if side == LEFT else [here, other] if side == RIGHT else [here]))
    return copies


def pack_steps(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + other for side, other in path)


def unpack_steps(b: bytes) -> list[tuple[int, bytes]]:
    out, i = [], 0
    while i < len(b):
        size = 0 if b[i] == ALONE else 32
        out.append((b[i], b[i + 1:i + 1 + size]))
        i += 1 + size
    return out


# ------------------------------------------------------------------------------- leaves
def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def _leaf(n_chars: Column) -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*[_field(f) for f in fields]), 256))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """-> (g, doc_id, leaf, forged): ``g`` names the language's tree and sorts as trees do; ``forged`` is
    the leaf of a tampered row, else null. The one pass over the texts."""
    d = take_columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = F.col("n_chars").cast("decimal(21,0)") + 1
    return d.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), F.col("doc_id").cast("bigint").alias("doc_id"),
                    _leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, _leaf(more)).alias("forged"))


def place(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``idx``, the position (from 0) in its group ``g`` by ``order``, and ``n``, the group's
    size. Ranges and places inside them are stored values; ties are broken by the row's number."""
    spark = rows.sparkSession
    by = [F.col("g"), *order, F.col("_row")]
    cut = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parallelism(spark), *by).sortWithinPartitions(*by)
    cut = stage(cut.withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).drop("_row"), name)
    pieces = cut.groupBy("g", "_pid").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("g")
    before = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("g", "_pid", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"))
    return cut.join(pieces, ["g", "_pid"]).withColumn("idx", F.col("_at") + F.col("_shift")).drop("_pid", "_at", "_shift")


# ------------------------------------------------------------------------------- blocks
def _runs(batches):
    """Rows sorted by (g, block) -> (g, block, rows of the block)."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != now and held:
                yield *now, held
                held = []
            now = row[:2]
            held.append(row[2:])
    if held:
        yield *now, held


PLANTED = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("ids", pa.list_(pa.int64())),
                     ("nodes", pa.list_(pa.binary())), ("forged", pa.list_(pa.binary()))])
RAISED = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("steps", pa.list_(pa.binary()))])
PROVEN = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])


def _send(rows, schema: pa.Schema, size: int):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _plant(batches):
    """The lowest tier: one row a block, with every level of its tree stored once, lowest first."""
    def blocks():
        for g, block, rows in _runs(batches):
            n, ids, found, forged = rows[0][1], *zip(*((r[2], r[3], r[4]) for r in rows))
            tree = grow(list(found), height(n))
            yield g, block, n, tree[-1][0], list(ids), [b"".join(level) for level in tree], list(forged)
    return _send(blocks(), PLANTED, 64)


def _raise(batches):
    """An upper tier: one row a block, with the steps of each of its nodes inside the block."""
    def blocks():
        for g, block, rows in _runs(batches):
            n = rows[0][1]
            tree = grow([r[2] for r in rows], height(n))
            yield g, block, n, tree[-1][0], [pack_steps(steps(tree, i)) for i in range(len(rows))]
    return _send(blocks(), RAISED, 64)


def _blocks(nodes: DataFrame) -> DataFrame:
    n = parallelism(nodes.sparkSession)
    return nodes.withColumn("block", F.shiftright("idx", BITS)).repartition(n, "g", "block").sortWithinPartitions("g", "block", "idx")


def climb(nodes: DataFrame, name: str) -> DataFrame:
    """(g, idx, n, digest), the nodes of one tier -> (g, idx, steps, top): steps up to the tree's top."""
    grown = stage(_blocks(nodes).select("g", "block", "idx", "n", "digest").mapInArrow(_raise, "g string, block bigint, n bigint, digest binary, steps array<binary>"), name)
    at = F.posexplode("steps").alias("_i", "steps")
    mine = grown.select("g", "block", F.col("digest").alias("top"), at).withColumn("idx", F.shiftleft("block", BITS) + F.col("_i")).drop("_i")
    if grown.where("block > 0").isEmpty():
        return mine.select("g", "idx", "steps", "top")
    upper = climb(above(grown), name)
    upper = upper.select(F.col("g"), F.col("idx").alias("block"), F.col("steps").alias("_more"), F.col("top").alias("_top"))
    return mine.join(upper, ["g", "block"]).select("g", "idx", F.concat("steps", "_more").alias("steps"), F.col("_top").alias("top"))


def above(blocks: DataFrame) -> DataFrame:
    """The nodes of the next tier: the roots of ``blocks``."""
    return blocks.select("g", F.col("block").alias("idx"), F.ceil(F.col("n") / (1 << BITS)).cast("bigint").alias("n"), "digest")


def _prove(batches):
    """Blocks with the steps above them -> one row a leaf: proof, and the root that its version folds to."""
    def rows():
        for batch in batches:
            for g, block, n, base, ids, nodes, forged, upper, subroot, top, root in zip(*(c.to_pylist() for c in batch.columns)):
                tree = [[level[i:i + 32] for i in range(0, len(level), 32)] for level in nodes]
                path, last = unpack_steps(upper), unpack_steps(top)
                over = "".join(other.hex() for _, other in path + last)
                folded = {}
                for at, (doc, leaf, other) in enumerate(zip(ids, tree[0], forged)):
                    inside = steps(tree, at)
                    proof = hashlib.sha256(("".join(x.hex() for _, x in inside) + over).encode()).hexdigest()
                    # a version ends in its block with a copy of the block's root and goes on with that
                    copy = copy_path(leaf if other is None else other, inside)[-1]
                    end = folded.get(copy) or copy_path(copy, path + last)[-1]
                    if other is None:
                        folded[copy] = end
                    yield doc, leaf.hex(), subroot.hex(), root.hex(), proof, end.hex(), end == root
    return _send(rows(), PROVEN, 4096)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """-> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row a document.
    ``tampered`` says which rows are forged (n_chars raised by one); else those whose id's CRC-32 7 divides."""
    placed = place(stage(leaves(docs, tampered), "manifest-leaves"), [F.col("doc_id").asc_nulls_last(), F.col("leaf")], "manifest-ranges")
    planted = _blocks(placed).select("g", "block", "idx", "n", "doc_id", "leaf", "forged")
    planted = stage(planted.mapInArrow(_plant, "g string, block bigint, n bigint, digest binary, ids array<bigint>, nodes array<binary>, forged array<binary>"), "manifest-blocks")
    trees = stage(climb(above(planted), "manifest-tier"), "manifest-trees")

    roots = trees.select(F.lit("").alias("g"), F.col("g").alias("_g"), F.col("top").alias("digest")).distinct()
    roots = stage(place(stage(roots, "manifest-roots"), [F.col("_g")], "manifest-order"), "manifest-roots")
    last = climb(roots.select("g", "idx", "n", "digest"), "manifest-top")
    last = roots.select(F.col("idx"), F.col("_g")).join(last.drop("g"), "idx").select(F.col("_g").alias("g"), F.col("steps").alias("top_steps"), F.col("top").alias("root"))
    path = trees.join(last, "g").select("g", F.col("idx").alias("block"), "steps", F.col("top").alias("subroot"), "top_steps", "root")

    found = planted.join(path, ["g", "block"]).select("g", "block", "n", "digest", "ids", "nodes", "forged", "steps", "subroot", "top_steps", "root")
    return found.mapInArrow(_prove, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def oracle() -> str:
    """DuckDB twin of the query: the levels of a tree are lists, folded one level at a time."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = "sha256(" + " || ".join(field.format(x) for x in ("doc_id", "source", "lang", "{n}", "text")) + ")"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, lang, {leaf.format(n='n_chars')} AS leaf, {leaf.format(n='(n_chars::HUGEINT + 1)')} AS forged,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS bad FROM documents, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM d),
t AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, lvl AS top, nodes[1] AS subroot, row_number() OVER (ORDER BY lang COLLATE C NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u AS (SELECT 0 AS lvl, list(subroot ORDER BY place) AS nodes FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM u WHERE len(nodes) > 1),
w AS (SELECT lang, lvl, nodes FROM t WHERE len(nodes) > 1),
steps AS (SELECT p.lang, p.pos, w.lvl, (p.pos >> w.lvl) & 1 AS side, w.nodes[xor(p.pos >> w.lvl, 1) + 1] AS other FROM p JOIN w ON p.lang IS NOT DISTINCT FROM w.lang
  UNION ALL
  SELECT p.lang, p.pos, s.top + u.lvl, (s.place >> u.lvl) & 1, u.nodes[xor(s.place >> u.lvl, 1) + 1]
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang, u WHERE len(u.nodes) > 1),
path AS (SELECT lang, pos, list({{'side': side, 'other': other}} ORDER BY lvl) AS path FROM steps GROUP BY lang, pos),
f AS (SELECT p.doc_id, p.leaf, s.subroot, coalesce(path.path, []) AS path, CASE WHEN bad THEN forged ELSE leaf END AS mine
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN path ON p.lang IS NOT DISTINCT FROM path.lang AND p.pos = path.pos),
g AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root,
  sha256(coalesce(list_aggregate(list_transform(path, lambda x: coalesce(x.other, '')), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce(list_prepend({{'side': 0::BIGINT, 'other': mine}}, path), lambda a, x: {{'side': 0::BIGINT, 'other':
    sha256(CASE WHEN x.other IS NULL THEN a.other WHEN x.side = 1 THEN x.other || a.other ELSE a.other || x.other END)}}).other AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g"""
