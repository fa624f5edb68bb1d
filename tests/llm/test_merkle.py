import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from polyview.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    out = ""
    for k in merkle.FIELDS:
        v = row[k]
        if v is not None:
            v = str(v)
            if low and k == "text":
                v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return h(out)


def tampered(row):
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0


def rise(nodes):
    """Levels of one tree, and per node the siblings on its way to the top."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    level = list(nodes)
    while len(level) > 1:
        for x, i in enumerate(at):
            start = i // 16 * 16
            run = level[start : start + 16]
            paths[x].append((run[: i - start], run[i - start + 1 :]))
        at = [i // 16 for i in at]
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    risen = {}
    for s in order:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        risen[s] = rise([leaf(r) for r in trees[s]])
    root, above = rise([risen[s][0] for s in order]) if order else (None, [])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, own in zip(trees[s], risen[s][1], strict=True):
            digest = leaf(r, tampered(r))
            for before, behind in own + up:
                digest = h(*before, digest, *behind)
            proof = h(*[x for before, behind in own + up for x in before + behind])
            out.append((r["doc_id"], leaf(r), risen[s][0], root, proof, digest, digest == root))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([tuple(r.get(k) for k in [*merkle.FIELDS, "leaf", "tree"]) for r in rows], SCHEMA)
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return sorted((tuple(r) for r in merkle.proofs(merkle.build(merkle.leaves(df, flag))).collect()), key=str)


def row(i, source, text="Some Text", lang="en", n=None):
    return {"doc_id": i, "source": source, "lang": lang, "n_chars": n, "text": text, "leaf": "clash", "tree": "clash"}


CASES = {
    "empty": [],
    "one": [row(4, None, None)],
    "one source": [row(i, "s", f"Text {i}") for i in range(300)],
    "lone leaves": [row(i, f"s{i}") for i in range(40)],
    "mixed": [row(i, None if i % 7 == 0 else f"ß{i % 3}", ["", None, "Ab é" * (i % 50), "x" * 200_000][i % 4 if i < 8 else 2], n=i) for i in range(600)],
    "ties": [row(i // 5, "a" if i % 2 else "b", "Same") for i in range(100)] + [row(None, "a", "Null id"), row(None, "a", "other")] + [row(3, "a", "X")] * 20,
}


@pytest.mark.parametrize("name", CASES)
def test_against_the_definition(spark, name):
    assert found(spark, CASES[name]) == expected(CASES[name])


def test_states_resume_the_hash():
    children = [h(str(i)) for i in range(16)]
    for count in (1, 2, 15, 16):
        (states,), (digest,) = merkle.slot_states(["".join(children[:count])])
        assert digest == h(*children[:count]) and len(states) == 32 * count
        kept = merkle.np.frombuffer(states, ">u4").astype(merkle.np.uint32).reshape(-1, 8)
        for slot in range(count):
            new = h("new")
            got = merkle.resumed(kept[slot : slot + 1], merkle.as_blocks(new), ["".join(children[slot + 1 : count])], merkle.np.array([slot]))
            assert merkle.as_digests(got) == [h(*children[:slot], new, *children[slot + 1 : count])]


def test_manifest_keeps_states_and_small_runs(spark):
    manifest = merkle.build(merkle.leaves(spark.createDataFrame([tuple(row(i, "s").get(k) for k in [*merkle.FIELDS, "leaf", "tree"]) for i in range(1000)], SCHEMA)))
    assert [x.count() for x in manifest.levels] == [4, 1]
    assert manifest.runs.agg(F.max(F.size("docs")), F.max(F.length("states"))).first() == (16, 512)
