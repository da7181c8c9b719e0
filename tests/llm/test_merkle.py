"""Trees and proofs against plain loops."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from logharbor.llm import merkle


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(*values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def _path(levels, place, proof, digest):
    for nodes in levels[:-1]:
        other = place ^ 1
        if other < len(nodes):
            proof.append(nodes[other])
            digest = _h(nodes[other], digest) if place & 1 else _h(digest, nodes[other])
        else:
            digest = _h(digest)
        place //= 2
    return digest


def _expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, placed = [], []
    for name in names:
        full = []
        for doc, text, source, lang, chars in groups[name]:
            more = chars + 1 if doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and chars is not None else chars
            full.append((doc, _leaf(doc, source, lang, chars, text), _leaf(doc, source, lang, more, text)))
        full.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        trees.append(_tree([r[1] for r in full]))
        placed.append(full)
    top = _tree([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for g, full in enumerate(placed):
        for i, (doc, leaf, shown) in enumerate(full):
            proof = []
            end = _path(top, g, proof, _path(trees[g], i, proof, shown))
            out.append((doc, leaf, trees[g][-1][0], root, proof[: len(proof) // 2], end, end == root))
    return out


def _rows(sizes):
    rows = []
    for g, size in enumerate(sizes):
        lang = None if g == 1 else f"lang-é{g}"
        rows += [(g * 100_000 + i * 3, f"text {i}" if i % 5 else None, "s" if i % 4 else None, lang, i if i % 6 else None) for i in range(size)]
    return rows


_SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.mark.parametrize(
    "sizes, few", [([2], 4096), ([1, 1, 1], 0), ([1024, 1, 7], 4096), ([2500, 1025, 40, 1, 2], 0), ([2500, 1025, 40, 1, 2], 4096), ([1] * 1100 + [3], 4096)]
)
def test_against_plain_trees(spark, monkeypatch, sizes, few):
    monkeypatch.setattr(merkle, "_FEW", few)
    rows = _rows(sizes)
    if len(sizes) == 5:
        rows += [rows[7], rows[7], (None, "no id", None, "lang-é0", 3), (None, "no id", None, "lang-é0", 3), (-5, "", "", "", -1)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], _SCHEMA + ", group string, tree int, steps int").repartition(6)
    got = merkle.document_manifest(frame).collect()
    plain = _expected(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[5], r[4])
    assert sorted([(r[0], r[1], r[2], r[3], r[4][: len(r[4]) // 2], r[5], r[6]) for r in got], key=order) == sorted(plain, key=order)
    assert any(not r["verified"] for r in got) or len(rows) < 20


def test_no_rows(spark):
    assert merkle.document_manifest(spark.createDataFrame([], _SCHEMA)).count() == 0


def test_one_row_is_the_root(spark):
    row = merkle.document_manifest(spark.createDataFrame([(3, "a" * 200_000, "s", None, 1)], _SCHEMA)).head()
    assert row["leaf"] == row["subroot"] == row["root"] and row["siblings"] == [] and row["verified"]


def test_changing_any_sibling_is_found(spark):
    rows = spark.createDataFrame([("a", i, _h(str(i))) for i in range(37)], "group string, key long, leaf string")
    proofs, root, _ = merkle.manifest(rows)
    for row in proofs.collect():
        steps = bytes(row["steps"])
        assert [row["leaf"], *merkle.fold(row["leaf"], steps)][-1] == root
        wrong = steps[:1] + bytes([steps[1] ^ 1]) + steps[2:] if steps[0] else None
        if wrong:
            assert [*merkle.fold(row["leaf"], wrong)][-1] != root
