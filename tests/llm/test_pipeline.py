"""The pipeline's stages against a plain Python version of each, on a small table."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import language, secrets, toxicity
from quarry.llm.common import fold_of
from quarry.llm.queries import documents, language_model, toxicity_model, vocabulary

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def one_of_each_group(rows):
    """Rows of the smallest id of each group of near duplicates; all rows without a word."""
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else ("empty", i), []).append(rows[i])
    return [min(g, key=lambda r: r["doc_id"]) for g in groups.values()]


def masked(text, net):
    covered = np.zeros(len(text) + 1, bool)
    out, at = [], 0
    for a, _, b in secrets.find([text], net)[0]:
        if a >= at:
            out.append(text[at:a] + "[SECRET]")
        covered[a:b] = True
        at = max(at, b)
    assert len("".join(out).replace("[SECRET]", "") + text[at:]) == int((~covered[: len(text)]).sum())
    return "".join(out) + text[at:]


def bag(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def test_stages_equal_plain_python(spark, monkeypatch):
    staged, write = {}, corpus_pipeline.stage_table

    def keep(df, label):
        out = write(df, label)
        staged[label.removeprefix("stage-")] = (out, [r.asDict() for r in out.collect()])
        return out

    monkeypatch.setattr(corpus_pipeline, "stage_table", keep)
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, SMALL).collect()]
    assert list(staged) == [name for name, _ in corpus_pipeline.STAGES]

    rows = [r.asDict() for r in documents(spark, SMALL).collect()]
    model = language_model(spark, SMALL)
    want = [r for r in rows if language.predict(model, [r["text"] or ""])[2][0]]
    kept, got = staged["language_id"]
    assert 0 < len(want) <= len(rows) and bag(got) == bag(want)

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(kept, labels, fold_of(F.col("doc_id"), 5) != 0)
    want = [r for r in want if toxicity.predict(model, [r["text"] or ""])[0] < 0.5]
    assert bag(staged["toxicity"][1]) == bag(want)

    want = one_of_each_group(want)
    assert bag(staged["near_duplicates"][1]) == bag(want)

    net = secrets.network()
    want = [r | {"text": (t := masked(r["text"], net)), "n_chars": len(t)} if r["text"] is not None else r for r in want]
    assert bag(staged["secrets"][1]) == bag(want)

    library, ids = Tokenizer.from_file(vocabulary()), Counter()
    for r in want:
        out = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        ids.update((r["doc_id"], k // 4096, k, len(out[k : k + 4096]), zlib.crc32(np.array(out[k : k + 4096], "<u4").tobytes())) for k in range(0, len(out), 4096))
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == ids
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_keep_of_both_classifiers(spark):
    """Rows stay or go by their own text, with all columns; nulls and repeated rows count."""
    docs = documents(spark, SMALL).select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "12 34"), (9003, "12 34")], "doc_id long, text string")).withColumn("extra", F.lit("x"))
    rows = [r.asDict() for r in docs.collect()]
    model = language_model(spark, SMALL)
    assert bag(r.asDict() for r in language.keep(docs, model).collect()) == bag(r for r in rows if language.predict(model, [r["text"] or ""])[2][0])
    model = toxicity_model(spark, SMALL)
    assert bag(r.asDict() for r in toxicity.keep(docs, model).collect()) == bag(r for r in rows if toxicity.predict(model, [r["text"] or ""])[0] < 0.5)
