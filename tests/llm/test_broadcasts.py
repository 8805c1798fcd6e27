"""What an explode makes is never sent through the driver: Spark sizes it as what went in."""

from bookflow.llm import simhash, topk
from bookflow.llm.common import prepare


def broadcast_explodes(df):
    """Broadcasts of the plan, as text, that hold an explode."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda x: next((k for k, c in enumerate(x) if c.isalpha()), 0)
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            own = [line]
            for x in lines[k + 1:]:
                if depth(x) <= depth(line):
                    break
                own.append(x)
            found += ["\n".join(own)] if any("Generate explode" in x for x in own) else []
    return found


def test_buckets_are_not_broadcast(spark):
    """31 rows for each fingerprint and their counts meet by a shuffle."""
    prepare(spark)
    fps = spark.range(1, 8).withColumnRenamed("id", "fp")      # its size is known, that of rows from Python isn't
    found = simhash.links(fps)
    assert broadcast_explodes(found) == []
    assert simhash.components(found).select("root").distinct().collect() == [(1,)]


def test_blocks_of_queries_are_not_broadcast(spark):
    """a block of queries for each block of candidates, which grows with both tables."""
    prepare(spark)
    vectors = spark.createDataFrame([(k, [k, 1]) for k in range(12)], "vec_id bigint, q array<bigint>")
    found = topk.top_k(vectors, vectors.where("vec_id < 3"), 2, query_block=2, candidate_block=4)
    assert broadcast_explodes(found) == []
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 11), (1, 2, 10), (2, 1, 11), (2, 2, 10)]
