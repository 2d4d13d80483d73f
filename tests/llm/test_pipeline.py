"""The pipeline as a whole and stage by stage, held against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlake.llm import packing, simhash
from tests.llm.test_operators import brute_alike, docs

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    """Documents by id, and the ids that are toxic: clean ones with exact and near copies and personal data, nulls and blanks."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(5))
    texts, toxic = [], set()
    for i in range(120):
        body = [word() for _ in range(60)]
        if i % 4 == 0:
            toxic.add(i)
            body += ["grumblefoul"] * 3
            rng.shuffle(body)
        texts.append(" ".join(body))
    clean = [i for i in range(120) if i not in toxic]
    for i in clean[:10]:
        texts.append(texts[i].replace(" ", "  \n", 3))  # an exact copy but for white space
    for i in clean[10:20]:
        words = texts[i].split()
        words[rng.randrange(60)] = "changed"  # four to five shingles of 56 differ: 0.82 or more
        texts.append(" ".join(words))
    texts += [f"write to {word()}@example.com or call +49 30 123 45{n} about {' '.join(word() for _ in range(30))}" for n in range(10, 20)]
    return [*texts, None, "", "one"], toxic


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Each stage's rows, of one run over the stored fixture."""
    texts, toxic = corpus()
    folder = str(tmp_path_factory.mktemp("sf"))
    docs(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], LABELS).write.parquet(f"{folder}/labels.parquet")
    rows, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": texts}
    columns = rows.columns
    for name, step in corpus_pipeline.STAGES:
        rows = step(spark, rows, folder)
        assert name == "packing" or rows.columns == columns
        rows = corpus_pipeline.stage(rows, f"test-{name}")
        out[name] = rows.collect()
    return out, corpus_pipeline.run(spark, folder).collect()


def kept(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_toxic_documents_go_and_clean_ones_stay(ran):
    texts, toxic = corpus()
    assert set(kept(ran[0]["toxicity"])) == set(range(len(texts))) - toxic


def test_exact_copies_equal_plain_python(ran):
    seen, expected = {}, set()
    for i, text in sorted(kept(ran[0]["toxicity"]).items()):
        if seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i) == i:
            expected.add(i)
    assert set(kept(ran[0]["exact_dedup"])) == expected


def test_near_copies_equal_plain_python(ran):
    before = sorted(kept(ran[0]["exact_dedup"]).items())
    stay = brute_alike([text for _, text in before])
    assert set(kept(ran[0]["near_dedup"])) == {before[i][0] for i in stay} and len(stay) == len(before) - 10


def test_personal_data_goes_and_the_rest_stays(ran):
    before, after = kept(ran[0]["near_dedup"]), {r["doc_id"]: r for r in ran[0]["personal_data"]}
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]["text"]]
    assert len(changed) == 10 and all("@" in before[i] for i in changed)
    hide = lambda t: re.sub(r"\S+@\S+|\+49 [\d ]+", "x", t)
    assert all(hide(before[i]) == hide(after[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"]) for i in changed)
    assert not {m for i in changed for m in re.findall(r"\S+@\S+", before[i])} & {m for i in changed for m in re.findall(r"\S+@\S+", after[i]["text"])}


def test_packing_covers_what_is_left_with_least_padding(ran):
    left, packed = kept(ran[0]["personal_data"]), ran[0]["packing"]
    assert {r["doc_id"]: r["n_tokens"] for r in packed} == {i: len((t or "").split()) for i, t in left.items()}
    lengths = sorted(r["n_tokens"] for r in packed)
    counts = {n: lengths.count(n) for n in lengths}
    bounds = packing.optimal_boundaries(*map(packing.np.array, zip(*counts.items())), 16)
    assert {r["bucket_tokens"] for r in packed} == set(bounds) and sum(r["padding"] for r in packed) == sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_run_equals_its_stages(ran):
    stages, whole = ran
    assert sorted(map(tuple, whole)) == sorted(map(tuple, stages["packing"]))


def test_near_copy_recall_over_many_degrees(spark):
    """Of the documents that comparing all pairs drops, 95 % or more are found, and no other one goes."""
    rng = random.Random(13)
    texts = []
    for _ in range(150):
        n = rng.randrange(40, 260)
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for changes in rng.sample(range(1, 8), 2):
            words = list(base)
            for at in rng.sample(range(n), max(1, changes * n // 250)):
                words[at] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    stay = set(brute_alike(texts))
    found = {r["doc_id"] for r in simhash.keep_one_alike(docs(spark, texts), radius=6, views=6).collect()}
    gone, found_gone = set(range(len(texts))) - stay, set(range(len(texts))) - found
    assert found_gone <= gone and len(found_gone) >= 0.95 * len(gone) > 200


def test_large_crowds_equal_brute_force(spark):
    """Crowds over the size of one cell: a dense one, one of texts that share a repeated passage, and a mixed one."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(9000)}"
    texts, passage, base = [], " ".join(word() for _ in range(12)), [word() for _ in range(150)]
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            words[at] = word()
        texts.append(" ".join(words))
    texts += [" ".join([passage] * 9 + [word() for _ in range(60)]) for _ in range(25)]
    crowd = [(0, i) for i in range(len(texts))]
    rows = [(root, int(simhash._set_id(simhash._shingle_set(texts[i], 5))), simhash._shingle_set(texts[i], 5).view("int64").tolist()) for root, i in crowd]
    sets = simhash.stage(spark.createDataFrame(rows, "root long, node long, values array<long>"), "test-sets")
    edges = simhash._crowded_links(sets, 0.8, cell_rows=8, pivots=3)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    own = [r[1] for r in rows]
    first = [min(j for j in range(len(own)) if roots.get(own[j], own[j]) == roots.get(own[i], own[i])) for i in range(len(own))]
    assert sorted(set(first)) == brute_alike(texts)
    assert all(a != b for a, b in itertools.combinations(own, 2))


@pytest.mark.parametrize("keep", [lambda d: simhash.keep_one(d), lambda d: simhash.keep_one_alike(d, radius=6, views=6)])
def test_rows_of_one_id_are_decided_by_their_texts(spark, keep):
    """An unrelated text that shares its id with a near copy stays, and so do rows without an id."""
    rng = random.Random(31)
    body = [f"w{rng.randrange(9999)}" for _ in range(120)]
    near, other = " ".join([*body[:-1], "changed"]), " ".join(f"v{rng.randrange(9999)}" for _ in range(120))
    rows = [(1, " ".join(body)), (5, near), (5, other), (5, other), (None, near), (None, None), (7, other), (8, near)]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumn("digest", F.lit("x"))
    found = keep(table)
    assert found.columns == table.columns
    stay = [(1, " ".join(body)), (5, other), (5, other), (None, near), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == sorted(stay, key=str)


def test_near_copy_recall_on_given_tables_by_length(spark):
    """All pairs of the given documents: what the stage drops is what comparing every pair drops, for short and long texts."""
    rows = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        rows.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    texts = list(rows)
    stay = set(brute_alike(texts))
    found = {r["doc_id"] for r in simhash.keep_one_alike(docs(spark, texts), radius=6, views=6).collect()}
    for low, high in ((0, 50), (50, 200), (200, 10**9)):
        those = {i for i, t in enumerate(texts) if low <= len(t.split()) < high}
        assert found & those == stay & those
