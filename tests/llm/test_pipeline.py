"""The pipeline's stages, each on what its predecessor kept, and the whole against brute force."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from test_op_5 import brute as near
from test_op_8 import brute as leaks
from test_ops_1_2_3_4_7 import base, water_fill


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit(1))
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out = P.written(out)
        seen[name] = docs.collect(), out.collect()
        docs = out

    def text(rows):
        return {r["doc_id"]: r["text"] for r in rows}

    before, after = map(text, seen["toxicity"])
    assert 0.7 * len(before) < len(after) <= len(before) and all(before[i] == after[i] for i in after)
    before, after = map(text, seen["near_duplicates"])
    assert set(after) == {i for i, (_, c) in near(before, 80).items() if i == c}
    before, after = map(text, seen["decontamination"])
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert set(before) == set(after)
    for i, (_, hit, _), (n, left, _) in zip(before, leaks(before.values(), items), leaks([after[i] for i in before], items), strict=True):
        assert not left and (hit or before[i] == after[i])
    before, after = map(text, seen["secrets"])
    for i in before:
        assert not base(after[i] or "") and (base(before[i] or "") or before[i] == after[i])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"][1])
    before, after = seen["mixing"]
    sizes, taken = {}, {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    for r in after:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in water_fill(sizes).items())
    assert sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, after))


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_odd_rows(spark, sf_dir, tmp_path):
    """Null ids, sources and texts, empty and very long texts, repeated rows and a clashing column, through every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text IS NOT NULL").orderBy("item_id").first()["text"]
    long = " ".join(f"word{i}" for i in range(60_000))
    odd = [
        (10_001, None, "s"), (10_002, "", "s"), (10_003, " \n", None), (10_004, long, "s"), (10_004, long, "s"), (10_005, f"{long} tail", "t"), (None, "no id at all", "s"),
        (10_006, f"before {item} after", "t"), (10_007, 'token = "A1b2C3d4E5f6G7h8"', None), (10_008, "same words for two rows", "s"), (10_008, "same words for two rows", "s"),
    ]
    made = spark.createDataFrame(odd, "doc_id long, text string, source string")
    made = made.select(*[F.col(n).cast(t).alias(n) if n in made.columns else F.lit(None).cast(t).alias(n) for n, t in fields.items()])
    here = docs.unionByName(made).withColumn("row", F.lit("clash")).withColumn("size", F.lit(-1))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in P.STAGES:
        out = P.written(stage(spark, here, str(tmp_path)))
        if name != "mixing":
            assert out.columns == here.columns
        here = out
        left = {}
        for r in out.collect():
            left.setdefault(r["doc_id"], []).append(r)
        if name == "toxicity":
            assert len(left[10_004]) == len(left[10_008]) == 2 and {10_001, 10_002, 10_003, 10_005, None} <= set(left)
        elif name == "near_duplicates":
            assert len(left[10_004]) == 2 and 10_005 not in left and {10_001, 10_002, 10_003, 10_008} <= set(left)
        elif name == "decontamination":
            assert item not in left[10_006][0]["text"] and left[10_001][0]["text"] is None and left[10_002][0]["text"] == ""
        elif name == "secrets":
            assert left[10_007][0]["text"] == '[SECRET]"' and left[10_004][0]["text"] == long
        else:
            assert not {10_001, 10_002, 10_003} & set(left) and all(r["taken"] > 0 for rs in left.values() for r in rs)
