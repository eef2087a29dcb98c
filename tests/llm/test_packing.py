import os
import random
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm.packing import TOKENIZERS, pack_documents, plan_bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_a_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1000])
    sizes = Counter(min(capacity, max(1, int(rng.lognormvariate(rng.uniform(0, 6), 1)))) for _ in range(rng.choice([0, 1, 50, 3000])))
    moves, bins = plan_bins(sizes, capacity)
    used, ranks, large = Counter(), defaultdict(set), Counter()
    for size, rank, first, n in moves:
        for i in range(n):
            used[first + i] += size
            large[first + i] += size > capacity / 3
            assert rank + i not in ranks[size]
            ranks[size].add(rank + i)
    assert {s: len(r) for s, r in ranks.items()} == dict(sizes) and all(max(r) == len(r) - 1 for r in ranks.values())
    assert len(used) == bins and all(v <= capacity for v in used.values()) and all(v <= 2 for v in large.values())
    if sum(sizes.values()) >= 3000:
        assert bins <= -(-sum(s * n for s, n in sizes.items()) // capacity) * 1.3 + 1


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")
def test_documents(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["cat", "house", "būve", "12"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["same text"] * 200 + ["word " * 3000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("nothing", "x")
    out = pack_documents(df, capacity=128).toPandas()
    assert out["doc_id"].nunique() == len(texts)
    fill = out.dropna().groupby("container_no")["n_tokens"].sum()
    assert fill.max() <= 128 and len(fill) == fill.index.max() + 1 and fill.sum() / (128 * len(fill)) > 0.98
    parts = out[out["doc_id"] == 500]
    assert sorted(parts["part_no"]) == list(range(1, len(parts) + 1)) and (parts["n_tokens"] == 128).sum() >= len(parts) - 1
    assert list(out[out["doc_id"] >= 501]["part_no"]) == [0, 0] and out[out["doc_id"] >= 501]["container_no"].isna().all()
    assert pack_documents(df.limit(0), capacity=128).count() == 0
    other = pack_documents(df.limit(3), capacity=128, tokenizer=f"{TOKENIZERS}/piece_bpe_32k.model")
    assert other.count() >= 3
