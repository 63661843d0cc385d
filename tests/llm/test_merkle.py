"""The manifest held against a plain tree in Python, with blocks of four nodes and of 256, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from prosemill.llm import merkle as M

DOCS = "doc_id long, source string, lang string, n_chars long, text string, pos int, hash string, of string, root string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root and each node's siblings, as (left, right) by level."""
    proofs = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, below = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for side, members in enumerate(under[i : i + 2]):
                for m in members:
                    proofs[m].append((run[0] if side else "", run[1] if len(run) == 2 and not side else ""))
            above.append(sha("".join(run)))
            below.append(sum(under[i : i + 2], []))
        nodes, under = above, below
    return nodes[0], proofs


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own, out = {}, []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        own[lang] = (mine, *tree([leaf_of(r) for r in mine]))
    root, tops = tree([own[x][1] for x in langs])
    for lang, top in zip(langs, tops):
        mine, subroot, proofs = own[lang]
        for row, proof in zip(mine, proofs):
            path = proof + top
            h = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for left, right in path:
                h = sha(left + h + right)
            out.append((row[0], leaf_of(row), subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    return sorted(out, key=str)


def fixture(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", None]), rng.choice(["en", "fr", "é", None]), rng.choice([i, None]), rng.choice(["x" * i, "", None, "日本"])) for i in rng.sample(range(5 * n), n)]
    return rows + rows[:3] + [(None, "a", "en", 1, "t"), (None, None, None, None, None)] + [(7, "hot", "one", 1, "same")] * 9


@pytest.mark.parametrize(("bits", "n"), [(2, 90), (8, 90), (8, 1500), (1, 40)])
def test_equal_to_plain_trees(spark, monkeypatch, bits, n):
    monkeypatch.setattr(M, "BITS", bits)
    rows = fixture(n)
    docs = spark.createDataFrame([(*r, 1, "h", "o", "r") for r in rows], DOCS).repartition(5)
    got = M.manifest(docs, other=M.tampered)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_lone_rows_and_empty_tables(spark):
    assert M.manifest(spark.createDataFrame([], DOCS), other=M.tampered).collect() == []
    one = (5, "s", "en", 3, "one")
    row = M.manifest(spark.createDataFrame([(*one, 0, "", "", "")], DOCS)).first()
    assert row["root"] == row["subroot"] == row["leaf"] == leaf_of(one) == row["folded_root"] and row["proof_sha256"] == sha("")


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(*r, 0, "", "", "") for r in fixture(20)], DOCS)
    assert M.manifest(docs).where("not verified").count() == 0
    changed = M.manifest(docs, other=lambda d: F.when(F.col("doc_id") == 7, F.sha2(F.lit("other"), 256)))
    assert changed.where("not verified and doc_id = 7").count() == docs.where("doc_id = 7").count() == changed.where("not verified").count()


def test_equal_to_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = M.op12_manifest(spark, sf_dir)
    want = con.sql(M.ORACLE_SQL).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
