"""The stages on a small table: each decision takes effect, and clean documents stay."""

import random

import corpus_pipeline
from leaseweave.llm import mixing
from leaseweave.llm.common import documents


def test_stages(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 8))) for _ in range(80)) + "."
    texts = [good() for _ in range(60)]
    texts += ["noise " * 80] * 1 + [good().upper().replace(" ", "!! ") for _ in range(20)] + [texts[0], texts[1] + " end"] + [f"{good()} password=abcdef12345 {good()}"]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 60 <= i <= 80), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder, names = str(tmp_path), [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicates", "secret scans", "mixing", "subword encoding"]
    df = documents(spark, folder)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, df, folder).write.parquet(f"{folder}/{i}")
        df = spark.read.parquet(f"{folder}/{i}")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {x["doc_id"]: x for x in df.collect()}
    assert set(kept) == {*range(60), 83} and "[SECRET]" in kept[83]["text"] and kept[83]["n_chars"] == len(kept[83]["text"])
    sample = {x["doc_id"] for x in mixing.mix_documents(df).where("selected").collect()}
    out = corpus_pipeline.run(spark, folder)
    assert {x["doc_id"] for x in out.collect()} == sample


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, id string, keys string, _topic string, _slice int"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, folder, texts, labels=(), ids=None):
    """Documents with further columns of clashing names, and labels, in a folder."""
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 2}", len(t or ""), "k", "t", "id", "keys", "topic", n) for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


ODD = [None, "", " ", "one", "one", "é" * 5000, "word " * 30_000, "\x00\n\t", "😀 a", "same text of some words here", "same text of some words here", 'password="hunter22222"']


def test_every_stage_on_odd_rows(spark, tmp_path):
    """No labels: all are good. Null, empty, long and repeated texts, a null id, and clashing columns pass every stage."""
    folder = tables(spark, tmp_path, [*ODD, ODD[3]], ids=[*range(len(ODD) - 1), None, 3])
    df = documents(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, folder)
        rows = out.collect()
        assert out.columns == df.columns and len(rows) <= df.count(), name
        if name == "quality classifier":
            assert len(rows) == len(ODD) + 1
        if name == "near-duplicates":  # all texts without words are one class, as are equal texts; ids 3 and null stay
            assert {r["doc_id"] for r in rows} == {0, 3, 5, 6, 8, 9, None}
        if name == "secret scans":
            assert {r["text"] for r in rows if r["text"] and "SECRET" in r["text"]} == {"[SECRET]\""} and all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    last = corpus_pipeline.STAGES[-1][1](spark, df, folder).collect()
    assert len(last) == df.count()


def test_every_stage_on_an_empty_table(spark, tmp_path):
    folder = tables(spark, tmp_path, [])
    df = documents(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_equals_plain_loops(spark, tmp_path):
    """All five stages by Python loops over the same rules: votes, edit distances of all pairs, spans, cells, the library's ids."""
    import numpy as np
    import sentencepiece

    from leaseweave.llm import ordered, quality, secrets
    from leaseweave.llm.queries import vocabulary

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(r.randint(2, 8)))
    texts = [" ".join(word() for _ in range(r.randint(20, 120))) + "." for _ in range(60)]
    texts += [t.replace(" ", " $$# ").upper() for t in texts[:15]] + [f"{t} and token=abcdef{i}99" for i, t in enumerate(texts[15:25])] + [texts[30], texts[31] + " more"]
    labels = [(i, int(not 60 <= i < 75), 0) for i in range(len(texts))]
    folder = tables(spark, tmp_path, texts, labels)
    docs = documents(spark, folder)
    model = quality.learn(docs, documents(spark, folder, "labels"))
    kept = [i for i, s in enumerate(model.score(texts)) if s >= quality.ACCEPT]
    codes = {}
    words = {i: np.array([codes.setdefault(w.lower(), len(codes)) for w in texts[i].split()], np.uint32) for i in kept}
    pairs = [(i, j) for i in kept for j in kept if i < j]
    root = {i: i for i in kept}
    for (i, j), good in zip(pairs, ordered.align([(words[i], words[j]) for i, j in pairs])):
        if good:
            root = {k: min(root[i], root[j]) if x in (root[i], root[j]) else x for k, x in root.items()}
    kept = [i for i in kept if root[i] == i]

    def masked(text):
        *_, starts, ends = secrets.scan(text)
        for s, e in reversed(list(zip(starts, ends))):
            text = text[:s] + "[SECRET]" + text[e:]
        return text

    final = {i: masked(texts[i]) for i in kept}
    row = {x["doc_id"]: x for x in docs.collect()}
    frame = spark.createDataFrame([(i, t, row[i]["lang"], row[i]["source"]) for i, t in final.items()], "doc_id long, text string, lang string, source string")
    sample = {x["doc_id"] for x in mixing.mix_documents(frame).where("selected").collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    got = {x["doc_id"]: x["n_tokens"] for x in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i: len(lib.encode(final[i])) for i in sample} and 10 < len(got) < len(final) < 70
