"""Token counts, alignment and ranked search against brute force: the libraries on every prefix, all pairs of tokens, plain sums."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import alignment, pretokens, ranked, token_counts
from gristmill.llm.pretokens import vocabulary, vocabulary_path

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PARTS = ["'", " ", "  ", "\n", "\t", "a", "s", "t", "re", "'ll", "'ve", "'D", "1", "23", "!", "é", "ß", "\U0001f600", "<|endoftext|>", "<|end", "<s>", "\xa0", "　", "the", " the", "ing", "中文", "ｘ", "٣", "²", "\x1c", "\x85", "​", "<0x0A>", "=====", "\0", "\x7f"]


def rough(n, seed, parts=PARTS):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


def rows():
    out = list(enumerate(rough(60, 1) + rough(10, 2, [*PARTS, "▁"])))
    out += [(100, None), (101, ""), (102, " "), (103, "word"), (104, "a" * 5_000), (105, " " * 3_000 + "x"), (106, "the cat's  whiskers 12\n\n" * 400), (107, "<|endoftext|>" * 3), (108, "don't  we'll <|endoftext|> they've \n")]
    return [*out, (None, "no id"), (5, out[5][1]), (5, "another text of the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7, "p") for i, t in rows()], "doc_id bigint, text string, steps string, row int, pairs string").repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    return a, plain, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ---- token counts


def test_counts_of_every_prefix(library, monkeypatch):
    pairs, kept = token_counts._loaded(vocabulary("byte_bpe_50k.json"))
    for most in (1 << 20, 16):
        monkeypatch.setattr(token_counts, "STRETCH", most)
        for text in rough(250, 3) + ["it's the 1st x  y" * 5]:
            got = [x for part in token_counts.text_counts(pairs, kept, text.encode()) for x in part.tolist()]
            assert got == [len(library[0].encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)], text


def test_tokens_are_read_back_from_prefixes(library):
    pairs, _ = token_counts._loaded(vocabulary("byte_bpe_50k.json"))
    r = random.Random(8)
    for word in ["".join(r.choice("aeinrstlß") for _ in range(r.randint(1, 40))) for _ in range(300)] + ["a" * 100, "=" * 130]:
        assert pairs.tokens(word.encode()) == library[1].encode(word, add_special_tokens=False).ids


def test_budgets(docs, library):
    table = token_counts.prefix_counts(docs)
    count = lambda t: len(library[0].encode(t, add_special_tokens=False).ids)
    got = table.select("doc_id", "n_bytes", "n_chars", "n_tokens", token_counts.count_at("steps", F.lit(7)).alias("seven"), token_counts.longest_prefix("steps", F.lit(9)).alias("kept")).collect()

    def want(t):
        t = t or ""
        kept = max((i for i in range(1, min(len(t), 3_100) + 1) if count(t[:i]) <= 9), default=0) if len(t) < 3_100 else None
        return len(t.encode()), len(t), count(t), count(t[:7]), kept

    expected = [(i, *want(t)) for i, t in rows()]
    same([tuple(r)[:5] for r in got], [x[:5] for x in expected])
    short = {x[:5]: x[5] for x in expected if x[5] is not None}
    assert all(r.kept == short[tuple(r)[:5]] for r in got if tuple(r)[:5] in short)


def test_budgets_of_nothing(docs):
    table = token_counts.prefix_counts(docs.where("doc_id = 101"))
    assert tuple(table.select(token_counts.count_at("steps", F.lit(3)), token_counts.longest_prefix("steps", F.lit(None).cast("long"))).first()) == (0, 0)
    assert token_counts.prefix_counts(docs.where("doc_id < -1")).count() == 0


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(pretokens, "KEPT", 10)
    asked = []
    kept = pretokens.Kept(lambda words: asked.extend(words) or [w[:1] * 4 for w in words])
    for _ in range(3):
        words = [bytes([97 + i]) for i in range(20)]
        for at in range(0, 20, 4):
            assert kept.of(words[at : at + 4], [True] * 4) == [w * 4 for w in words[at : at + 4]]
    assert len(kept.new) + len(kept.old) <= 10 and len(asked) > 20


# ---- alignment


def brute_alignment(text, library):
    _, plain, b_model = library
    none = (0, 0, 0, 0, "", {})
    if not text:
        return none
    a, b, whole = plain.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text), (" " + text).encode()
    letters = token_counts.byte_letters()
    a_bytes = [bytes(letters[c] for c in plain.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return none
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    a_from, b_from = [0, *a_end], [0, *b_end]
    links, j0 = collections.Counter(), 0
    for i in range(len(a)):
        while b_end[j0] <= a_from[i]:
            j0 += 1
        j = j0
        while j < len(b) and b_from[j] < a_end[i]:
            links[a[i], b[j]] += 1
            j += 1
    groups, low = [], 0
    for cut in sorted(set(a_end) & set(b_end)):
        groups.append(",".join(str(x) for x, e in zip(a, a_end) if low < e <= cut) + "|" + ",".join(str(x) for x, e in zip(b, b_end) if low < e <= cut))
        low = cut
    return len(a), len(b), len(groups), sum(links.values()), ";".join(groups), dict(links)


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_alignment(docs, library, monkeypatch, most):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 2_000_000 if most > 100 else 10)
    texts = [t for _, t in rows()]
    want = [brute_alignment(t, library) for t in texts]
    if most < 100:  # stretches, on the driver: workers have their own constants
        monkeypatch.setattr(alignment, "STRETCH", most)
        sides = alignment._loaded(vocabulary(alignment.A), vocabulary(alignment.B))
        for t, w in zip(texts, want, strict=True):
            if t and "▁" not in t:
                got = alignment._one(sides, np.frombuffer((" " + t).encode(), np.uint8))
                pairs = {(int(p) // alignment.B_IDS, int(p) % alignment.B_IDS): int(n) for p, n in zip(got.pairs, got.links)}
                assert (int(got.n_a[0]), int(got.n_b[0]), int(got.n_groups[0]), int(got.n_links[0]), got.groups[0].decode(), pairs) == w
    found = alignment.agreement(alignment.align(docs)).collect()
    held = collections.Counter(p for w in want for p in w[5])
    most_of_a = collections.defaultdict(int)
    for (a, _), n in held.items():
        most_of_a[a] = max(most_of_a[a], n)
    expected = [(i, *w[:5], sum(n for p, n in w[5].items() if held[p] == most_of_a[p[0]]), sum(n * held[p] for p, n in w[5].items())) for (i, _), w in zip(rows(), want, strict=True)]
    same([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in found], expected)
    digests = [r.groups for r in alignment.align(docs, digest=True).select("groups").collect()]
    same(digests, [hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "" for w in want])


def test_alignment_of_nothing(docs):
    assert alignment.agreement(alignment.align(docs.where("doc_id < -1"))).count() == 0
    assert [tuple(r)[2:7] for r in alignment.agreement(alignment.align(docs.where("doc_id in (100, 101)"))).collect()] == [(0, 0, 0, 0, "")] * 2


# ---- ranked search


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(documents, items, k):
    counts = [(i, collections.Counter(terms_of(t))) for i, t in documents]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = set(terms_of(text)) & set(df)
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        found = []
        for (doc, c), n in zip(counts, sizes, strict=True):
            m = 10 + 90 * n * n_docs // max(1, total)
            score = sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                found.append((-score, doc is None, doc, score))
        out += [(item, rank, doc, score) for rank, (_, _, doc, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def searched():
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "straße", "Word"]
    documents = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(300)]
    documents += [(400 + i, "same words here w1") for i in range(30)] + [(500, None), (501, ""), (502, "-- !"), (503, "w2 " * 30_000), (None, "w3 w3 w4 here"), (None, None), (410, "same words here w1")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for i in range(25)]
    items += [(30, "same HERE words"), (31, None), (32, ""), (33, "nowhere"), (None, "w3 here"), (30, "same HERE words"), (34, " ".join(words))]
    return documents, items


@pytest.mark.parametrize(("k", "at_once", "terms"), [(10, 1_000, 2_048), (3, 4, 5), (500, 1_000, 2_048)])
def test_ranked_search(spark, monkeypatch, k, at_once, terms):
    monkeypatch.setattr(ranked, "ITEMS_AT_ONCE", at_once)
    documents, items = searched()
    docs = spark.createDataFrame([(i, t, 3, "y") for i, t in documents], "doc_id bigint, text string, rank int, terms string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, score int").coalesce(1)
    found = ranked.search(*ranked.index(docs, 2_000), asked, k)
    same([(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()], brute_search(documents, items, k))


def test_search_of_nothing(spark):
    documents, items = searched()
    docs = spark.createDataFrame(documents, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert ranked.search(*ranked.index(docs.where("doc_id < -1")), asked).count() == 0
    assert ranked.search(*ranked.index(docs), asked.where("item_id < -1")).count() == 0
    assert ranked.search(*ranked.index(docs.where("text is null")), asked).count() == 0


def test_carry_arithmetic():
    r = np.random.default_rng(4)
    numbers, weights = r.integers(0, 10**6, (5, 130)), r.integers(0, 13_000, 5)
    cut = lambda x, n: np.array([np.packbits(np.pad(x >> s & 1, ((0, 0), (0, -x.shape[1] % 64))).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for s in range(n)])
    bits = int(13_000 * 10**6).bit_length()
    product = ranked.weighted(cut(numbers, 20), weights, bits)
    assert (product == cut(numbers * weights[:, None], bits)).all()
    total = np.zeros((bits + 3, 1, product.shape[2]), np.uint64)
    for i in range(5):
        ranked._add(total, product[:, i : i + 1])
    sums = (numbers * weights[:, None]).sum(0)[None]
    assert (total == cut(sums, bits + 3)).all()
    tied = np.array([[3, 9, 9, 0, 9, 3, 1, 0]])
    assert [np.flatnonzero(np.unpackbits(ranked.best(cut(tied, 4), k).view(np.uint8), bitorder="little")).tolist() for k in (1, 2, 4, 7)] == [[1], [1, 2], [0, 1, 2, 4], [0, 1, 2, 4, 5, 6]]


def test_terms_in_chunks(monkeypatch):
    """The terms of a block in chunks give what they give at once."""
    r = np.random.default_rng(9)
    docs, n = np.concatenate([np.sort(r.choice(100, 30, replace=False)) for _ in range(12)]), 360
    impacts = r.integers(0, 10**6, n)
    import pyarrow as pa

    block = ranked.Block(pa.array(range(100)), np.arange(12, dtype=np.uint64), np.arange(0, n + 1, 30), docs, np.array([np.packbits((impacts >> s & 1).astype(np.uint8)) for s in range(20)]))
    items = ranked.Items([0, 1], [0, 1], [np.arange(12), np.array([2, 5, 11])], np.arange(12, dtype=np.uint64), r.integers(1, 9_000, 12))
    whole = ranked._scores(block, items, 10, 40)
    monkeypatch.setattr(ranked, "TERMS_AT_ONCE", 5)
    assert all((x == y).all() for x, y in zip(whole, ranked._scores(block, items, 10, 40), strict=True))
    sums = np.zeros((2, 100), np.int64)
    for i, own in enumerate(items.asked):
        for t in own:
            sums[i, docs[30 * t : 30 * t + 30]] += impacts[30 * t : 30 * t + 30] * items.weights[t]
    assert all(sums[i, d] == s for i, d, s in zip(*whole, strict=True))
