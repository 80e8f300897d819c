"""The Merkle manifest against a tree that is hashed level by level."""

import hashlib
import zlib

from pyspark.sql import functions as F

from embedaudit.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, lower=False):
    out = []
    for c in merkle.FIELDS:
        x = r[c]
        if c == "text" and lower and x is not None:
            x = "".join(a.lower() if "A" <= a <= "Z" else a for a in x)
        out.append("-" if x is None else f"{len(str(x).encode())}:{x}")
    return _h(*out)


def _tree(nodes):
    """Root and every node's siblings, level by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            proofs[i].append((k - run, [x for j, x in enumerate(nodes[run : run + 16]) if j != k - run]))
        nodes, at = [_h(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], proofs


def _manifest(rows):
    tampered = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r), _leaf(r, tampered(r)), r["doc_id"]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: _tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, over = _tree([own[s][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for (_, _, leaf, value, doc_id), proof in zip(sorted(sources[s], key=lambda x: x[:3]), own[s][1], strict=True):
            path = proof + over[i]
            for place, others in path:
                value = _h(*others[:place], value, *others[place:])
            out.append((doc_id, leaf, own[s][0], root, _h(*(y for _, x in path for y in x)), value, value == root))
    return sorted(out, key=str)


def _got(docs):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = merkle.manifest(docs, changed=F.when(crc == 0, merkle.lowered(F.col("text"))))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rows = [(i, f"Text {i} É" * (i % 7), "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 40}", i) for i in range(700)]
    rows += [(None, "Null", "de", "hot", None), (None, None, None, None, None), (3, "again", "en", "hot", 1), (3, "again", "en", "hot", 1), (900, None, None, None, None), (901, "", "", "", 0), (902, "Long " * 40000, "en", "one", 1), (903, "X", "en", "źródło", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("leaf", "key", "digest", "other", "index", "total", "root", "top", "witness", "name", "block"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = _got(docs)
    assert got == _manifest([r.asDict() for r in docs.collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_two_stages_and_of_one_source(spark):
    docs = spark.range(2 * merkle.BLOCK + 17).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Row "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"), F.col("id").alias("n_chars")
    )
    assert _got(docs) == _manifest([r.asDict() for r in docs.collect()])
    one = docs.limit(1)
    assert [r[4] for r in _got(one)] == [_h("")] and _got(one) == _manifest([r.asDict() for r in one.collect()])
    assert _got(docs.limit(0)) == []


def test_witnesses_grow_as_their_siblings_complete():
    values = [merkle.digest(str(i).encode()) for i in range(600)]
    frontier, nodes, steps = merkle.Frontier(3), [], []
    for v in values:
        nodes.append(frontier.append(v))
        steps.append(len(nodes[0].witness()))
    assert steps[14] == 0 and steps[15] == 1 and steps[254] == 1 and steps[255] == 2 and steps[-1] == 2
    root = frontier.root()
    assert all(merkle.folded(v, n.witness()) == root for v, n in zip(values, nodes, strict=True)) and len(nodes[0].witness()) == 3
    assert _tree([v.decode() for v in values])[0] == root.decode()
