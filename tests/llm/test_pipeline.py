"""Every stage on its own input, and the whole run."""

import re
from collections import Counter

import corpus_pipeline as cp
from talkloom.llm import quality_classifier as qc
from talkloom.llm.common import table
from talkloom.llm.decontamination import leaks
from talkloom.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in cp.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    ids = lambda frame: Counter(r["doc_id"] for r in frame.select("doc_id").collect())
    good = cp.quality(spark, docs, SF)
    assert good.columns == docs.columns
    assert ids(good) == ids(qc.quality_scores(docs, table(spark, SF, "labels")).where("predicted = 1"))
    alone = cp.near_dedup(spark, good, SF)
    assert alone.columns == docs.columns and ids(alone) == ids(near_duplicates(good, 80).where("kept"))
    clean = cp.decontamination(spark, alone, SF)
    dirty = ids(leaks(alone, table(spark, SF, "benchmark")).select("doc_id").distinct())
    assert clean.columns == docs.columns and ids(clean) == Counter({i: n for i, n in ids(alone).items() if i not in dirty})
    mixed = cp.mixing(spark, clean, SF)
    assert mixed.columns == docs.columns
    words = lambda frame: sum(len(WORD.findall(r["text"])) for r in frame.collect())
    assert abs(words(mixed) - 1.5 * words(clean)) < 0.02 * words(clean)
    sharded = cp.sharding(spark, mixed, SF)
    assert Counter(map(str, sharded.select(*docs.columns).collect())) == Counter(map(str, mixed.collect()))
    sizes = Counter(r["shard"] for r in sharded.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(8))


def test_run_takes_odd_rows(spark, tmp_path):
    base = table(spark, SF, "documents").limit(60)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "no id " * 30, "en", "a", 5), (10**6, "", "", "", 0), (10**6 + 1, "w " * 90_000, None, None, None)], base.schema
    )
    rows = base.unionByName(odd).unionByName(base.limit(3)).selectExpr("*", "1 as shard", "'x' as row", "2 as kept")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [*cp.COLUMNS, "shard", "slot"] and out.count() > 0
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
