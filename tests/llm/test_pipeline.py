"""Stages of the pipeline on null and repeated ids, odd rows and empty tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallygraph.llm import common, pii, quality, queries


def text(seed, size=40):
    return " ".join(f"w{seed}x{i}" for i in range(size))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    near = text(1, 200)
    rows = [
        (None, text(0)), (None, text(2)), (None, None), (None, ""), (None, ""),  # unlinked: all stay
        (5, text(3)), (5, text(4)), (5, text(4)),  # one id, two texts; the repeated row goes
        (9, near), (4, near + " end"), (None, near + " stop"),  # linked: the smallest id stays
        (6, text(7)), (None, text(7)),  # equal texts
        (7, None), (8, ""), (3, text(8)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    want = [rows[i] for i in (0, 1, 2, 3, 4, 5, 6, 9, 11, 13, 14, 15)]
    assert sorted(map(repr, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(repr, want))


def test_near_duplicates_keep_what_they_kept_for_single_ids(spark):
    docs = spark.createDataFrame([(i, text(i % 6, 100) + " x" * (i % 2), "en", "src0", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == list(range(6))


def corpus(spark, folder):
    """Good and bad prose, copies, personal data, odd rows; half of the ids labelled."""
    good = [" ".join(f"{w}{(i * 7 + j) % 53}" for j, w in enumerate("the quiet river runs past old stone houses and green fields where people walk in the evening".split() * 6)) for i in range(60)]
    bad = [" ".join(["BUY!!", "NOW$$", f"win{i}", "CLICK>>>"] * 20) for i in range(40)]
    texts = good + bad + [good[3], good[3], good[7] + " end", " ".join(reversed(good[9].split())) + " call +1 (743) 555-3824 or mail a.b@c.de soon", None, "", " ".join(good) * 3]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, " ".join(f"the old river walk{i}" for i in range(30)), "en", "src0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame(rows, schema).withColumn("extra", F.lit(1)).withColumn("_row", F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(100)] + [(104, None, None), (5_000, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_all_stages_on_odd_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    corpus(spark, folder)
    docs = common.table(spark, folder, "documents")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.cut(stage(spark, kept, folder), name)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        sizes.append(kept.count())
        rows = kept.collect()
        if name == "quality":
            model = quality.fit(docs, common.table(spark, folder, "labels").where(~queries.held_out()))
            scored = quality.score(docs, model).where("score >= 0.7")
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in scored.collect())
            assert {i for i in range(60)} <= {r.doc_id for r in rows} and not {r.doc_id for r in rows} & set(range(60, 100))
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows]
            assert ids.count(3) == 1 and not {100, 101, 102} & set(ids) and None in ids
        if name == "pii":
            assert all(not pii.base_spans(r.text or "") for r in rows) and any("[PHONE]" in (r.text or "") for r in rows)
    assert sizes[:4] == sorted(sizes[:4], reverse=True) and sizes[2] == sizes[3]  # mixing may take rows twice
    out = corpus_pipeline.pack_sequences(spark, kept, folder).collect()
    ends: dict = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(ends[s] == 2048 for s in range(max(ends))) and sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out))


def test_all_stages_on_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
