import random

import corpus_pipeline
from tallyspark.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(25)
    docs = {k: text(rng.randint(40, 300)) for k in range(60)}
    docs[100] = docs[3]  # exact copy
    docs[101] = docs[4] + " more"  # near copy
    docs[102] = "too short"
    docs[103] = "again and again it goes " * 20
    docs[104] = text(80) + " " + item + " " + text(80)
    docs[105] = item + " " + text(12)
    docs[106] = text(60) + ' token = "3c4226790fc3f8022bcc4434e93601b2005f1325" ' + text(60)
    docs[107], docs[108] = None, ""
    for k in range(200, 260):
        docs[k] = " ".join(f"{word().upper()}!!###" for _ in range(60))
    rows = [(k, t, "en", "s", len(t or "")) for k, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0 if 200 <= k < 250 else 1, 0) for k in docs if k < 60 or 200 <= k < 250], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nothing here is found")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, item


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, item = tables(spark, folder)
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, folder), name)
        seen.append({r["doc_id"]: r for r in now.collect()} if name != "packing" else now.collect())
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rules, near, clean, masked, packed = seen
    good = {k for k in docs if k < 60} | {100, 101, 104, 105, 106}
    assert set(rules) == good
    assert set(near) == good - {100, 101}
    assert set(clean) == good - {100, 101, 105}
    assert item not in clean[104]["text"] and all(clean[k]["text"] == docs[k] for k in clean if k != 104)
    assert "[SECRET]" in masked[106]["text"] and all(masked[k]["text"] == clean[k]["text"] for k in masked if k != 106)
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(masked)
    assert all(sum(r["length"] for r in rs) == rs[0]["doc_tokens"] for rs in by_doc.values())
