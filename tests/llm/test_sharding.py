from __future__ import annotations

import zlib

from areaweek.llm.sharding import byte_shards


def brute(rows, shards):
    sized = sorted(
        ((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows)
    )
    total, at, out, slots = sum(s[3] for s in sized), 0, [], {}
    for known, d, crc, size in sized:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        slot = slots[shard] = slots.get(shard, -1) + 1
        out.append((d if known else None, size, crc, shard, slot))
        at += size
    return sorted(out, key=repr)


def check(df, shards=16):
    got = [tuple(r) for r in byte_shards(df, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=repr) == brute([(r.doc_id, r.text) for r in df.collect()], shards)


def test_like_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(df)
    sizes = byte_shards(df, 16).groupBy("shard").sum("size").collect()
    largest = max(len((r.text or "").encode()) for r in df.collect()) + 1
    assert max(r[1] for r in sizes) - min(r[1] for r in sizes) <= 2 * largest


def test_odd_rows(docs, wide, none):
    check(docs)
    check(docs, 3)
    check(wide)
    assert byte_shards(none).collect() == []
