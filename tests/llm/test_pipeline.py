"""The stages against brute force on a small folder of tables, and the registered queries."""

import itertools

import pytest

pytest.importorskip("tesserae.llm")
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tesserae.llm import common, packing, pii, queries  # noqa: E402
from tesserae.llm.common import stored  # noqa: E402

from .test_operators import brute_classes, brute_contamination, edited, prose  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose(999, 20)
    texts = [prose(k, 150) for k in range(40)] + [edited(prose(k, 150), k, 2) for k in range(10)] + [prose(k, 150) for k in range(5)]
    texts += [prose(60, 80) + " " + item + " " + prose(61, 80), "too short", None, "", prose(70, 150).replace(" ", " ## "), prose(71, 100) + " write jo.12@mail.example.com"]
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(k, int("##" not in (t or "")), 0) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, item


def test_stages_decide_as_brute_force_does(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        if docs.columns == names:
            kept.append({r.doc_id: r.text for r in docs.collect()})
    words = {k for k, t in enumerate(texts) if len((t or "").split()) >= 50}
    assert set(kept[0]) <= words and {k for k in words if "##" not in texts[k]} <= set(kept[0])
    order = sorted(kept[0])
    classes = brute_classes([kept[0][k] for k in order])
    assert set(kept[1]) == {order[r] for r in classes.values()}
    dirty = {r[0] for r in brute_contamination(list(kept[1].items()), [(1, item)]) if r[2]}
    assert dirty and set(kept[2]) == set(kept[1]) - dirty
    assert set(kept[3]) == set(kept[2]) and {k for k in kept[3] if kept[3][k] != kept[2][k]} == {len(texts) - 1}
    assert {r.doc_id for r in docs.collect()} == set(kept[3])


def test_stages_keep_columns_of_their_own_names(spark, folder):
    path, texts, _ = folder
    mine = {"n_words": -5, "rule": "mine", "kept": "k", "base_failed": "b", "n_items": -7, "rep": 1, "shard": "s", "class_id": "c", "root": "r", "_items": "i", "contaminated": "d", "size": 3, "sketch": "x"}
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({k: F.lit(v) for k, v in mine.items()})
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "stage")
        assert docs.columns == names
    assert docs.count() and {tuple(r) for r in docs.select(*mine).distinct().collect()} == {tuple(mine.values())}


def test_run_writes_and_rereads(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == [c.split()[0] for c in "doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long".split(",")]
    assert out.count() > 0


def test_packing_stage_links_partners_of_different_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    texts = [" ".join(w if k % 2 == 0 or j % 8 else prose(k * 1000 + j, 1) for j, w in enumerate(prose(k // 2, 120).split())) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
    place = {d: k for k, (d, _) in enumerate(itertools.groupby(r.doc_id for r in pieces))}
    assert len(place) == 400 and sum(abs(place[k] - place[k + 1]) == 1 for k in range(0, 400, 2)) >= 160


@pytest.mark.parametrize("rest", [packing.REST, 10])
def test_packing_stage_links_ends_whose_neighbours_are_taken(spark, monkeypatch, rest):
    # many more alike than the graph has neighbours: most ends of paths know no other end
    monkeypatch.setattr(packing, "REST", rest)
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    linked, chains = packing.linked, []
    monkeypatch.setattr(packing, "linked", lambda *a: chains.append(linked(*a)) or chains[-1])
    texts = [" ".join(w if (k * 7 + j * j) % 3 else prose(k * 1000 + j, 1) for j, w in enumerate(prose(k // 40, 90).split())) for k in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == set(range(400)) and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    assert len(chains[0]) > 3 and len(chains[-1]) == 1


def test_names_of_the_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{k}" for k in range(1, 11)] and names[10] == "pipeline"
    assert set(queries.oracle_sql()) <= set(names)


def test_pii_runs_without_python(spark, folder):
    plan = pii.pseudonymised(spark.read.parquet(f"{folder[0]}/documents.parquet"), "k1")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stored_gives_back_what_the_driver_has_freed(spark, monkeypatch):
    said, own = [], common.give_back
    monkeypatch.setattr(common, "give_back", lambda s: said.append(own(s, share=0)))
    freed = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.lang.Object())
    assert stored(spark.range(3), "some").count() == 3
    assert [x.startswith("Trim native heap") for x in said] == [True] and freed.get() is None
