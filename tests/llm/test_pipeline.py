"""The stages in order, each against what it should keep of a small fixture."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_hits, kneser_ney, plain_pack, shingles

import corpus_pipeline
from gristmill.llm.common import stored

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(i, prose(60, i), "en", "s", 0) for i in range(200)]
    rows += [(300 + i, " ".join(f"{w}%%{i}##" for w in prose(50, i).split()), "en", "s", 0) for i in range(10)]  # junk
    rows += [(400, prose(60, 3), "en", "s", 0), (401, prose(60, 3) + " more", "fr", "s", 0), (5, prose(60, 5), "en", "s", 0)]  # copies
    rows += [(500, prose(20, 1000) + " " + prose(30, 2000) + " " + prose(20, 1001), "en", "s", 0)]  # a benchmark passage
    rows += [(600, prose(60, 1002) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "s", 0), (None, prose(60, 1003), None, None, None), (700, None, "en", "s", 0), (701, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(30, 2000))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept.append(sorted(str(r["doc_id"]) for r in docs.select("doc_id").distinct().collect()))
        if i == 1:
            assert docs.count() == len(kept[1])
        if i == 3:
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    gone = lambda a, b: set(a) - set(b)
    assert not set(kept[0]) & {"700", "701", *(str(300 + i) for i in range(10))} and {"600", "None", "500", "400", "401"} <= set(kept[0])
    assert gone(kept[0], kept[1]) == {"400", "401"}
    assert gone(kept[1], kept[2]) == {"500"}
    assert kept[2] == kept[3] == kept[4]
    assert texts[600][0].endswith('token = "[secret]"') and texts[600][1] == len(texts[600][0])


def test_empty_and_missing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.count() == 0


def test_run_is_the_stages(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("doc_id = 600").count() == 1
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def rough(spark, sf_dir):
    """documents with what tables may have: a very long text, nulls in each column, repeated rows, texts that share an id."""
    more = [(800, prose(20_000, 4000), "en", "s", 0), (800, prose(20_000, 4000), "en", "s", 0), (801, "a" * 60_000, None, None, None), (802, prose(60, 7), "xx", None, 0), (802, prose(55, 4001), "en", None, 0), (803, " \t", "en", "s", 3), (None, None, None, None, None), (804, prose(9, 4002) + " " + prose(30, 2000), "en", "s", 0)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stored(docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(5), "rough")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality_stage_by_dictionaries(spark, rough, sf_dir):
    """What the model with dictionaries and sorted lists would keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r["doc_id"]: r["last"] for r in labels.where("quality = 1 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4).alias("last")).collect()}
    rows = rows_of(rough)
    score = kneser_ney([r[1] or "" for r in rows if good.get(r[0]) is False])[0]
    value = {r[1]: score(r[1]) for r in rows}
    held = defaultdict(list)
    for r in rows:
        if good.get(r[0]) and value[r[1]] is not None:
            for lang in {None, r[2]}:
                held[lang].append(value[r[1]])
    cut = {lang: sorted(x)[-(-995 * len(x) // 1000) - 1] for lang, x in held.items()}
    want = [r for r in rows if value[r[1]] is not None and value[r[1]] <= cut.get(r[2], cut[None]) + 1e-4]
    assert rows_of(corpus_pipeline.quality_classifier(spark, rough, sf_dir)) == want and 150 < len(want) < len(rows)


def test_near_duplicate_stage_by_all_pairs(spark, rough, sf_dir):
    rows = rows_of(rough)
    sets = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(shingles(r[1], 5))
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and any(x and y and len(x & y) * 100 >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = rows_of(corpus_pipeline.near_duplicates(spark, rough, sf_dir))
    assert sorted((r[0] for r in got if r[0] is not None)) == sorted(i for i, c in root.items() if i == c)
    assert [r for r in got if r[0] is None] == [r for r in rows if r[0] is None]
    for r in got:  # of rows with one id the smallest text
        if r[0] is not None:
            assert (r[1] or "") == min(x[1] or "" for x in rows if x[0] == r[0])
    assert rows_of(corpus_pipeline.near_duplicates(spark, rough.repartition(2), sf_dir)) == got


def test_decontamination_stage_by_windows(spark, rough, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {tuple(t.split()[s : s + 10]) for _, t in items for s in range(len(t.split()) - 9)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    hit = lambda t: any(tuple((w := words(t))[i : i + 10]) in grams for i in range(len(words(t)) - 9)) if len(words(t)) < 1000 else brute_long(words(t), grams)
    rows = rows_of(rough)
    want = [r for r in rows if not hit(r[1])]
    assert rows_of(corpus_pipeline.benchmark_decontamination(spark, rough, sf_dir)) == want and {r[0] for r in rows if r not in want} == {500, 804}
    assert brute_hits("x " + items[0][1], items)[1] == 30


def brute_long(words, grams):
    return any(tuple(words[i : i + 10]) in grams for i in range(len(words) - 9))


def test_secret_stage_by_spans(spark, rough, sf_dir):
    from gristmill.llm import secrets

    ranks = secrets.dictionary()
    want = []
    for r in rows_of(rough):
        text = r[1]
        if text and (spans := secrets.Finder(ranks)(text)):
            gone = [False] * len(text)
            for kind, a, b in spans:
                if kind == "assign":
                    a = secrets.ASSIGN.match(text, a).start(2)
                gone[a:b] = [True] * (b - a)
            text = "".join(c if not g else "[secret]" if not i or not gone[i - 1] else "" for i, (c, g) in enumerate(zip(text, gone, strict=True)))
            r = (r[0], text, *r[2:4], len(text))
        want.append(r)
    assert rows_of(corpus_pipeline.secret_scans(spark, rough, sf_dir)) == sorted(want, key=str) and want != rows_of(rough)


def test_packing_stage_by_plain_rule(spark, rough, sf_dir):
    got = corpus_pipeline.best_fit_packing(spark, rough, sf_dir).collect()
    pieces = []
    for r in rows_of(rough):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        pieces += [(r[0], k, min(4096, n - 4096 * k)) for k in range(max(1, -(-n // 4096)))]
    assert sorted(((r["doc_id"], r["piece"], r["length"]) for r in got), key=str) == sorted(pieces, key=str)
    lengths = sorted((n for *_, n in pieces if n), reverse=True)
    want = plain_pack(lengths, (512, 1024, 2048, 4096))
    bins = lambda rows: sorted((c, len(x)) for (_, c), x in rows.items())
    mine, plain = defaultdict(list), defaultdict(list)
    for r in got:
        if r["length"]:
            mine[r["bin_id"], r["capacity"]].append(r["length"])
    for n, (b, _, c) in zip(lengths, want, strict=True):
        plain[b, c].append(n)
    assert bins(mine) == bins(plain) and sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))
