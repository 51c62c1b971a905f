"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import duckdb
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from quarrystone.llm import mixing, oracles, secret_scan

from .test_operators import ODD, brute_components, features_of, packed_right


def reread(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_and_run(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("shard", F.lit("extra"))
    stages = dict(P.STAGES)
    assert list(stages) == ["quality rules", "simhash near-dedup", "secret scans", "mixing to target weights", "best-fit packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}

    good = reread(spark, P.quality(spark, docs, small), tmp_path / "1")
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    fail = lambda t: features_of(t)[0] < 50 or 100 * features_of(t)[4] > 50 * features_of(t)[0]
    assert kept == {i: t for i, t in before.items() if not fail(t)}  # too few labels here for any cutoff

    unique = reread(spark, P.near_duplicates(spark, good, small), tmp_path / "2")
    ids = sorted(kept)
    words = {i: "".join(c.lower() if c.isascii() else c for c in kept[i]).split() for i in ids}
    sets = {i: set(zip(*(words[i][k:] for k in range(5)), strict=False)) for i in ids}
    roots = brute_components(ids, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    left = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert left == {ids[k]: kept[ids[k]] for k in set(roots)} and unique.columns == docs.columns

    clean = reread(spark, P.secrets(spark, unique, small), tmp_path / "3")
    models = secret_scan.models_for(unique, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts == {i: secret_scan.redacted(t, secret_scan.spans_of(t, models), "[SECRET]") for i, t in left.items()}
    assert not any(secret_scan.base_spans(t) for t in texts.values())

    mixed = reread(spark, P.mixture(spark, clean, small), tmp_path / "4")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/3/*.parquet'")
    want = {r[0] for r in duck.sql(f"select doc_id from ({oracles.mixing_sql(P.MIX)}) where sampled").fetchall()}
    final = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert final == {i: texts[i] for i in want} and len(final) > 0.75 * len(texts)

    from quarrystone.llm import best_fit

    path = public_tokenizers.path("byte_bpe_50k.json")
    packed_right(best_fit.pack(mixed, path).collect(), Tokenizer.from_file(path), final.items())
    last = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in P.packing(spark, mixed, small).collect()}
    ran = P.run(spark, small)
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in ran.collect()} == last


def test_stages_on_odd_and_empty_tables(spark, small, tmp_path):
    rows = spark.createDataFrame([(i, (t or "") + " more words here" * 30 if i == 1 else t, la, s) for i, t, la, s in ODD], "doc_id long, text string, lang string, source string")
    rows = rows.withColumns({"n_chars": F.length("text").cast("long"), "kept": F.lit(1), "cell": F.lit("x")})
    for k, table in enumerate((rows, rows.where("false"))):
        docs = table
        for j, (_, stage) in enumerate(P.STAGES[:-1]):
            docs = reread(spark, stage(spark, docs, small), tmp_path / f"{k}{j}")
            assert docs.columns == rows.columns
        assert P.STAGES[-1][1](spark, docs, small).count() >= 0
    assert mixing.sample(rows).where("sampled is null").count() == 0


def test_quality_stage_with_cutoffs(spark, tmp_path):
    """Enough labels for cutoffs: the stage keeps what ``judge`` keeps, and rejects more than the base rules do."""
    import random

    from quarrystone.llm import quality_rules

    r = random.Random(9)
    rows = []
    for i in range(1600):
        bad = i % 3 == 0
        words = [f"w{r.randrange(900)}" for _ in range(80)] + (["#" * r.choice((60, 400))] if bad and r.random() < 0.6 else [])
        rows.append((i if i % 100 else None, " ".join(words), r.choice(("en", "de", None)), "s", bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, bad boolean")
    docs.selectExpr("doc_id", "if(bad, 0, 1) as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    left = P.quality(spark, docs, str(tmp_path))
    judged = quality_rules.judge(docs, labels)
    assert left.columns == docs.columns
    want = {x["doc_id"] for x in judged.where("kept and doc_id is not null").collect()}
    assert {x["doc_id"] for x in left.where("doc_id is not null").collect()} == want
    assert left.where("doc_id is null").count() == 16 and 50 < judged.where("not kept and not base_failed").count() and judged.where("base_failed").count() == 0
    assert left.where("not bad").count() >= 0.98 * docs.where("not bad").count()
