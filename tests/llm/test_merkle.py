"""Merkle manifest against a plain tree in Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ward_analytics.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def paths(leaves):
    """The root, and for each leaf its runs: (left siblings, right siblings) from the leaf up."""
    found, nodes, width = [[] for _ in leaves], leaves, 1
    while len(nodes) > 1:
        for i in range(len(leaves)):
            j = i // width
            found[i].append((nodes[j - j % 3 : j], nodes[j + 1 : j - j % 3 + 3]))
        nodes, width = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], width * 3
    return nodes[0], found


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: paths([leaf(r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0], leaf(r)))]) for s in sources}
    root, top = paths([trees[s][0] for s in sources])
    out = []
    for s, above in zip(sources, top, strict=True):
        for r, path in zip(sorted(by[s], key=lambda r: (r[0] is not None, r[0], leaf(r))), trees[s][1], strict=True):
            out.append((r[0], leaf(r), trees[s][0], h(*(x for left, right in path + above for x in left + right))))
    return root, out


def rows(sizes):
    rng = random.Random(9)
    out = []
    for source, n in sizes.items():
        for i in range(n):
            text = rng.choice([None, "", "a\nb", "é" * rng.randint(1, 5), "x" * rng.randint(0, 30)])
            out.append((rng.choice([None, rng.randint(-50, 999)]) if i % 7 == 0 else i * 3, source, rng.choice([None, "de", ""]), rng.choice([None, i]), text, "z", 1))
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 3}, {"a": 4, None: 1}, {None: 2, "": 28, "a": 27, "é": 82, "z": 1}, {f"s{i}": 1 + i % 3 for i in range(30)}, {"hot": 800, "b": 1},
])
def test_proofs(workers, sizes):
    given = rows(sizes)
    given += given[:2]  # repeated rows are leaves of their own
    documents = workers.createDataFrame(given, SCHEMA).repartition(3)
    manifest = merkle.build(documents)
    root, want = plain(given)
    assert manifest.root == root
    found = merkle.prove(manifest).withColumns({"folded": merkle.fold(F.col("digest")), "proof": merkle.siblings_digest()}).collect()
    assert sorted(map(str, ((r.doc_id, r.digest, r.subroot, r.proof) for r in found))) == sorted(map(str, want))
    assert {r.folded for r in found} == {root}


def test_empty_table(workers):
    manifest = merkle.build(workers.createDataFrame([], SCHEMA))
    assert manifest.root is None and merkle.prove(manifest).count() == 0


def test_only_every_third_level_is_stored(workers):
    manifest = merkle.build(workers.createDataFrame(rows({"a": 200}), SCHEMA))
    assert [level.count() for level in manifest.levels] == [200, 8, 1]


def test_a_written_manifest_proves_wanted_rows_and_shows_a_change(workers):
    given = rows({"a": 90, "b": 5})
    documents = workers.createDataFrame(given, SCHEMA)
    folder = workers.conf.get("spark.checkpoint.dir") + "/manifest"
    merkle.build(documents, {"changed": merkle.leaf(text=F.lit("else"))}).write(folder)
    manifest = merkle.Manifest.read(workers, folder)
    root, want = plain(given)
    assert manifest.root == root
    wanted = manifest.levels[0].where("place in (0, 4, 80)").select("tree", "place", "height")
    found = merkle.prove(manifest, wanted).withColumns({
        "folded": merkle.fold(F.col("digest")), "other": merkle.fold(F.col("changed")), "proof": merkle.siblings_digest(),
    }).collect()
    assert len(found) == 4 and {r.folded for r in found} == {root} and root not in {r.other for r in found}
    assert {(r.digest, r.proof) for r in found} <= {(w[1], w[3]) for w in want}
