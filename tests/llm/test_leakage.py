import random

from terrasieve.llm import leakage as K


def windows(text, n):
    w = K.normalise(text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(3, 40)))) for k in range(12)] + [(50, None), (51, ""), (3000, "w1 w2")]
    docs = []
    for d in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        for _ in range(2):
            k, text = items[rng.randrange(12)]
            w = text.split()
            a = rng.randrange(len(w))
            words[rng.randint(0, len(words)) :] = w[a : a + rng.randint(1, 30)]
        text = "".join(w.upper() + rng.choice([" ", ",  ", "\n", "-", "_"]) if rng.random() < 0.3 else w + " " for w in words)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "x" * 300_000)]
    want = {(k, d) for k, t in items if t for d, u in docs if u and windows(t, 7) & windows(u, 7)}
    ddf = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id as item_id")
    idf = spark.createDataFrame(items, "item_id long, text string")
    got = K.find_leaks(ddf, "doc_id", "text", idf, "item_id", "text", 7).collect()
    assert {(r.item_id, r.doc_id) for r in got} == want
    texts, asked = dict(docs), dict(items)
    for r in got:  # offsets point to the run in the original
        run = K.normalise(texts[r.doc_id][r.char_start : r.char_end]).split()
        assert len(run) == r.n_words >= 7 and run == K.normalise(asked[r.item_id]).split()[r.item_word : r.item_word + r.n_words]
    monkeypatch.setattr(K, "BLOCK_CHARS", 300)
    assert {(r.item_id, r.doc_id) for r in K.find_leaks(ddf, "doc_id", "text", idf, "item_id", "text", 7).collect()} == want
    assert K.find_leaks(ddf.limit(0), "doc_id", "text", idf, "item_id", "text").count() == 0
    assert K.find_leaks(ddf, "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0


def test_letters_and_marks():
    seeds = K.Seeds([(1, "Straße où l'été commença après minuit")], 5)
    assert [r[3] for r in seeds.runs("xx STRASSE OÙ L'ÉTÉ COMMENÇA yy")] == [5]
    decomposed = "xx strasse où l'été commença yy"
    ((_, _, w, n),) = seeds.runs(decomposed)
    spans = K.word_spans(decomposed)
    assert decomposed[spans[w][0] : spans[w + n - 1][1]].startswith("strasse") and len(spans) == 7
