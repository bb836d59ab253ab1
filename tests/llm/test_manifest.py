"""The dataset manifest against a plain recomputation of the whole tree."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from wardspark.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, idx bigint, leaf string, steps int, _row int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return H(*fields)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def fold(levels, at, node):
    """The node's siblings up to the top, and the top with ``node`` in place of the stored one."""
    others = []
    for level in levels[:-1]:
        run = list(level[at // 2 * 2:at // 2 * 2 + 2])
        run[at % 2] = node
        others += [level[i] for i in range(at // 2 * 2, min(at // 2 * 2 + 2, len(level))) if i != at]
        node, at = H(*run), at // 2
    return others, node


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1]), r))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: levels_of([x[2] for x in trees[g]]) for g in langs}
    top = levels_of([built[g][-1][0] for g in langs])
    out = Counter()
    for at, g in enumerate(langs):
        for pos, (_, _, leaf, r) in enumerate(trees[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            mine = leaf_of(r[0], r[3], r[2], r[4] + 1, r[1]) if bad else leaf
            low, node = fold(built[g], pos, mine)
            high, root = fold(top, at, node)
            out[r[0], leaf, built[g][-1][0], top[-1][0], H(*low, *high), root, root == top[-1][0]] += 1
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, f"text {i} é", rng.choice(["en", "en", "en", "fr", None, "-", ""]), rng.choice(["a", None, ""]), rng.choice([i, i, None, (1 << 63) - 1])) for i in range(700)]
    rows += [(None, "no id", "en", "a", 5)] * 3 + [(None, None, None, None, None)] * 2 + [(7, "again", "en", "a", 1), (7, "again", "en", "a", 1), (7, "other", "en", "a", 1)]
    rows += [(5000, "alone", "xx", "z", 3), (-3, "w " * 200_000, "de", "z", 3), (9999, "", "de", None, 0)] + [(7000, "same", "sv", "s", 9)] * 40
    return rows


@pytest.mark.parametrize("bits", [2, 10])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, bits):
    monkeypatch.setattr(manifest, "BITS", bits)
    rows = rows_of(bits)
    docs = spark.createDataFrame([r + ("x", 1, "y", 2, 3) for r in rows], SCHEMA).repartition(5)
    assert Counter(map(tuple, manifest.manifest(docs).collect())) == brute(rows)


def test_versions_share_what_they_do_not_copy():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(13)]
    tree = manifest.grow(leaves, 4)
    forged = hashlib.sha256(b"forged").digest()
    for at in range(13):
        copies = manifest.copy_path(forged, manifest.steps(tree, at))
        version = manifest.grow(leaves[:at] + [forged] + leaves[at + 1:], 4)
        assert [version[k][at >> k] for k in range(5)] == copies
        assert sum(a != b for old, new in zip(tree, version) for a, b in zip(old, new)) == 5
        assert manifest.copy_path(leaves[at], manifest.steps(tree, at))[-1] == tree[-1][0]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.manifest(none).count() == 0
    one = spark.createDataFrame([(1, "t", None, None, None, "x", 1, "y", 2, 3)], SCHEMA)
    r = manifest.manifest(one).collect()[0]
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == hashlib.sha256(b"").hexdigest()
