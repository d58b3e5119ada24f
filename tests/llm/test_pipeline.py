from __future__ import annotations

import random
import zlib

import corpus_pipeline
from agreemill.llm import decontam, langid, simhash, toxicity
from tests.llm.test_nearcopies import jaccard
from tests.llm.test_packing import check_packed, check_whole

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def sf_dir(spark, tmp_path):
    rng = random.Random(4)
    tongues = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet"], "bb": ["der", "und", "haus", "straße", "grün"]}

    def text(lang, n=60):
        return " ".join(rng.choice(tongues[lang]) + rng.choice("aeiou") * rng.randint(0, 2) for _ in range(n))

    rows, labels = [], []
    for i in range(160):
        lang = rng.choice(["aa", "bb"])
        words = text(lang, rng.randint(30, 90)).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), "vileword")
        labels.append((i, 1, int(i % 4 == 0)))
        rows.append((i, " ".join(words), lang))
    rows += [(200, rows[1][1], "aa"), (201, rows[1][1], "aa"), (202, "1234 !!", None), (203, None, None), (202, "1234 !!", None)]
    item = text("aa", 30)
    rows.append((204, f"{text('aa', 20)} {item.upper()}, {text('aa', 20)}", "aa"))
    docs = [(i, t, lang, "s", len(t or ""), "mine") for i, t, lang in rows]
    for name, data, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), rows


def test_stages_take_effect_and_match_brute_force(spark, tmp_path):
    where, rows = sf_dir(spark, tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = docs
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, where).write.parquet(f"{where}/out/{name}")
        kept = spark.read.parquet(f"{where}/out/{name}")
        assert kept.columns == docs.columns
        ids[name] = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    toxic = {i for i, t, _ in rows if "vileword" in (t or "")}
    assert ids["toxicity"] == sorted(i for i, _, _ in rows if i not in toxic)
    assert ids["language_id"] == sorted(i for i, _, _ in rows if i not in toxic | {202, 203})
    texts = {i: t for i, t, _ in rows if i in set(ids["language_id"])}
    least = {i: i for i in texts}
    near = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert ids["near_duplicates"] == sorted(i for i in least if least[i] == i)
    assert 200 not in ids["near_duplicates"] and 201 not in ids["near_duplicates"]
    assert ids["decontamination"] == [i for i in ids["near_duplicates"] if i != 204]
    packed = corpus_pipeline.run(spark, where).collect()
    check_whole(packed, {i: texts[i] for i in ids["decontamination"]})
    used, bound = check_packed(packed)
    assert used <= bound + 1


def test_one_of_each_with_repeated_and_null_keys(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "x y z w v"), (7, "x y z w v"), (None, "q r s"), (None, "q r s"), (9, "a b c d")]
    df = spark.createDataFrame([(*r, *"cdefgh") for r in rows], "doc_id long, text string, fp string, component string, fp_group string, id string, class string, group string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(5, "a b c d"), (5, "x y z w v"), (None, "q r s"), (None, "q r s")], key=str)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.harmless(docs, labels).collect() == []
    assert langid.accepted(docs).collect() == []
    assert simhash.one_of_each(docs).collect() == []
    assert decontam.clean(docs, items).collect() == []


def test_toxicity_learns_on_held_out_rows(spark, tmp_path):
    where, rows = sf_dir(spark, tmp_path)
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    got = toxicity.held_out_scores(docs, labels.union(labels)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = {r["doc_id"]: r for r in got if r["held_out"]}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    truth = {i: int("vileword" in (t or "")) for i, t, _ in rows}
    assert sum(r["predicted"] == truth[i] for i, r in held.items()) >= 0.95 * len(held)
    assert {r["score"] for r in toxicity.held_out_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_pools_over_chunks(monkeypatch):
    model = toxicity.train(["good day"] * 12 + ["vile day"] * 12, [0] * 12 + [1] * 12, ["aa"] * 24)
    cache = toxicity._Responses(model)
    words = ("good day " * 200 + "vile " + "nice " * 100).split()
    whole = model.pools(words, cache)
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 7)
    assert abs(model.pools(words, cache) - whole).max() < 1e-6
    assert model.pools([], cache).shape == whole.shape
