"""The join against brute force over word shingles."""

import random

import pytest

from quarry.llm import jaccard
from quarry.llm.jaccard import Similarity, keep_one, near_duplicates


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, like):
    sets = [shingle_set(t, like.k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and like.den * both >= like.num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def corpus(seed, n_groups=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage, texts = " ".join(word() for _ in range(60)), []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([1, 2, 4, 30, 60, 120]))] + (passage.split() if g % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 40 if g == 3 else 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [*enumerate(texts + [texts[0], texts[0].upper(), "", "  \n", None, "same words", "same words"])]


@pytest.mark.parametrize("like", [Similarity(3, 90), Similarity(5, 80)])
def test_components_equal_brute_force(spark, like):
    rows = corpus(1)
    sets, roots = brute(rows, like)
    smallest = {}
    for i, r in enumerate(roots):
        smallest[r] = min(smallest.get(r, i), i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, like).collect()}
    assert found == {i: (len(sets[i]), smallest[roots[i]]) for i, _ in rows}


def test_large_buckets_equal_brute_force(spark, monkeypatch):
    """Every bucket of more than two parts is compared in blocks of about three rows."""
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 2)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    like, rng = Similarity(5, 80), random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    sets, roots = brute(rows, like)
    smallest = {}
    for i, r in enumerate(roots):
        smallest[r] = min(smallest.get(r, i), i)
    assert 1 < len(smallest) < len(rows)
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()}
    assert found == {i: smallest[roots[i]] for i, _ in rows}


def test_a_passage_that_thousands_share_links_nothing(spark):
    passage = " ".join(f"shared{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(30 + i % 7))) for i in range(3000)] + [(3000, f"{passage} " + " ".join(f"own{5}x{k}" for k in range(35)) + " more")]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {i: i for i in range(3000)} | {3000: 5}


def test_keep_one_takes_the_same_row_and_keeps_names(spark):
    rows = [(1, "a b c d e f g", "k", x) for x in (3, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _q_text string, _q_nth long")
    kept = {tuple(keep_one(docs.repartition(n)).select("doc_id", "_q_text", "_q_nth").first()) for n in (1, 3)}
    assert len(kept) == 1 and keep_one(docs).columns == docs.columns


def test_keep_one_keeps_clean_rows_and_columns(spark):
    rows = [(1, "a b c d e f g", "k"), (2, "A b c d e f g", "l"), (2, "A b c d e f g", "l"), (None, "a b c d e f g", "m"), (3, "", "n"), (4, None, "o"), (5, "quite another text of its own", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `group` string")
    assert sorted((r.doc_id, r.group) for r in keep_one(docs).collect()) == [(1, "k"), (3, "n"), (4, "o"), (5, "p")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == []
