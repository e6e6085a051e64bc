from collections import Counter

import pytest

from contactloom.llm import sharding


def test_table_is_even_and_stable():
    names = tuple(f"s{k}" for k in range(7))
    a = sharding.lookup_table(names, 1009)
    assert set(Counter(a).values()) <= {1009 // 7, 1009 // 7 + 1}
    b = sharding.lookup_table(names[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != 6)
    assert moved < 0.2 * 1009
    for bad in (((), 1009), (names, 1000), (("a", "a"), 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_every_document_has_the_shard_of_its_slot(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, None)], docs.schema)).withColumn("slot", docs["doc_id"] * 0)
    rows = sharding.shard(docs).collect()
    table = sharding.lookup_table()
    assert len(rows) == docs.count()
    assert all(r["shard"] == sharding.SHARDS[table[r["slot"]]] for r in rows)
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})
    assert sharding.shard(docs.limit(0)).count() == 0
