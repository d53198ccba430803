"""The stages of corpus_pipeline against plain Python."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from churnkit.llm import decontaminate, simhash
from churnkit.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        seen[name] = (before, after)
        if name != "bpe":
            assert docs.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    before, after = seen["toxicity"]
    assert len(clean & set(after)) >= 0.95 * len(clean & set(before)) and len(toxic & set(after)) <= 0.4 * len(toxic)
    before, after = seen["simhash"]
    assert set(after) == {c for _, _, c in simhash.brute_force([(k, r["text"]) for k, r in before.items()])}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = seen["decontamination"]
    held = {k for k, r in before.items() if any(i in (r["text"] or "") for i in items)}
    assert held and not held & set(after) and len(before) - len(after) <= len(held) + 2
    before, after = seen["pii"]
    assert set(before) == set(after) and not any("@" in r["text"] and "." in r["text"].split("@")[1].split()[0] for r in after.values() if "@" in r["text"] and r["text"].split("@")[1].split())
    before, after = seen["bpe"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, r in after.items():
        assert r["text"] == before[k]["text"] and r["ids"] == plain.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


@pytest.mark.parametrize("filled", [True, False])
def test_awkward_rows(spark, tmp_path, filled):
    """NULL, empty, very long, tied and repeated rows, columns with the operators' own names, an empty table."""
    item = " ".join(f"q{i}" for i in range(30))
    texts = [(1, "plain words of one text"), (1, "plain words of one text"), (2, "plain words of one text"), (3, None), (4, ""), (None, "a row without any id"), (5, " ".join(f"w{i}" for i in range(60_000))),
             (6, f"before {item} after"), (6, "another text of the same id, quite different"), (7, "write to someone@example.org or call +1 555 123 4567"), (8, None), (-9, "café \u4e2d\U0001f600 \t\n end")]
    rows = [(i, t, None if i == 2 else "en", "s", len(t or ""), 77, 78, 79, "x", 5) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark int, fp int, root int, features string, y0 int"
    docs = spark.createDataFrame(rows if filled else [], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), f"test-awkward-{name}")
        seen[name] = [(r["doc_id"], r["text"]) for r in now.collect()]
        if name != "bpe":
            assert now.columns == docs.columns and now.filter("mark <> 77 or fp <> 78 or root <> 79 or features <> 'x' or y0 <> 5").count() == 0
    if not filled:
        assert not any(seen.values())
        return
    one = sorted(map(str, {c for _, _, c in simhash.brute_force(texts)}))
    assert sorted(map(str, seen["toxicity"])) == sorted(map(str, texts))  # one class only: no decision
    assert len(seen["simhash"]) == len({(f, c) for _, f, c in simhash.brute_force(texts)}) and set(one) <= {str(i) for i, _ in seen["simhash"]}
    leaked = {i for i, _, _ in decontaminate.brute_force([(k, x[1]) for k, x in enumerate(seen["simhash"]) if len(x[1] or "") < 10_000], [(1, item)])}
    assert leaked and len(seen["decontamination"]) == len(seen["simhash"]) - len(leaked) and not any(item in (t or "") for _, t in seen["decontamination"])
    assert (7, "write to <EMAIL> or call <PHONE>") in seen["pii"] and len(seen["pii"]) == len(seen["decontamination"])
    assert sorted((str(i), t or "") for i, t in seen["bpe"]) == sorted((str(i), t or "") for i, t in seen["pii"])
