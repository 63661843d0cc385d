"""The query op9 on a whole table against plain patterns: counts, digest and the base spans among all spans."""

import pytest
import hashlib

from prosemill.llm import pii
from test_texts import base_data

KINDS = ("email", "ip", "card", "phone")


def test_counts_digest_and_spans(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op9_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in rows) > 0
    for r in rows:
        base = base_data(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        shown = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("id:")] == shown


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_spans_joined_either_way(spark, monkeypatch, limit):
    """Discovered spans give the same rows whether they are small enough to be sent to all executors or not."""
    from prosemill.llm import pii

    monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    texts = [f"Write to user{i}@mail.example today. Account holder {'ref' if i % 2 else 'number'}: person{i}@mail.example and more" for i in range(40)]
    texts += ["Account holder ref: QX-77281-B and more", "Account holder number: QX-77282-B and more", "nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["id"]: [s["value"] for s in r["spans"]] for r in pii.find_personal_data(docs).collect()}
    assert len(rows) == 44 and rows[0] == ["user0@mail.example", "person0@mail.example"] and rows[43] == []
    assert rows[40] == ["QX-77281-B"] and rows[41] == ["QX-77282-B"]
