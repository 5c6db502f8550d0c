"""Findings of round 3: what each of them needs to stay mended."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from lakestrata.llm import quality, tokenfile, toxicity


def test_words_are_encoded_as_in_their_texts_and_kept(monkeypatch):
    """op10: pieces that go to the model apart give the library's ids, and words in use are not learned again."""
    rng = random.Random(5)
    parts = ["don't", "été,", "l'été", "word's", "x''", "a.b", "Ünï#!", "ɏa", "ǅ", "ñ²", "naïve...", "'s", "I'll.", "_x_", "7a", "<|endoftext|>", "a<|endoftext|>", "\t", "\nq", "q\n", "", "中文,", "İ", "×÷", "Hello", " ", "é"]
    texts = ["", " ", "  a", "a  ", *(" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(400))]
    texts += [" ".join("".join(rng.choices("abcéßÀɏ.,'!0_²", k=rng.randint(1, 7))) for _ in range(9)) for _ in range(400)]
    encoder = tokenfile.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    learned: list[str] = []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: learned.extend(words) or learn(words))
    monkeypatch.setattr(encoder, "WORDS", 150, raising=False)
    for k in range(30):
        encoder.encode([f"so common {k} " + " ".join(f"w{k}x{i}" for i in range(100))])
    assert learned.count("common") == 1
    assert encoder.encode([]) == []


def test_quality_learns_from_every_labelled_row(spark):
    """more rows than a sample of 8,000 a label would hold; those that it left out are of another kind."""
    ids = spark.range(1, 16_001).select(F.col("id").alias("doc_id")).where(quality.fold(quality.FOLDS) != quality.HELD)
    order = [r["doc_id"] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert len(order) > 12_000
    rng = random.Random(3)
    words = lambda signs: " ".join("".join(rng.choices(signs, k=rng.randint(2, 6))) for _ in range(rng.randint(6, 12)))
    good = [(i, words("abcdefgh"), 1) for i in order[:8_000]] + [(i, words("0123456789"), 1) for i in order[8_000:10_000]]
    bad = [(i, words("0123456789") + " !?!", 0) for i in order[10_000:12_000]]
    frame = spark.createDataFrame([*good, *bad], "doc_id long, text string, quality int").repartition(4)
    model = quality.train(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    kept = {r["doc_id"]: r["predicted"] for r in quality.score(frame, model).collect()}
    assert np.mean([kept[i] for i, _, _ in good[8_000:]]) > 0.9 and np.mean([kept[i] for i, _, _ in bad]) < 0.1


def test_fit_steps_count_every_row(spark):
    """edges, weights and threshold against numpy on all rows."""
    rng = np.random.default_rng(2)
    values = np.stack([rng.normal(size=3_001), rng.integers(0, 5, 3_001), np.zeros(3_001), rng.exponential(size=3_001) * 100], 1).astype(np.float32)
    rows = spark.createDataFrame([(v.tolist(),) for v in values], "f array<float>").repartition(3)
    edges = quality.quantile_edges(rows, 4, len(values))
    want = np.sort(values, axis=0)[[len(values) * k // quality.BINS for k in range(1, quality.BINS)]].T
    assert np.allclose(edges, want, rtol=1e-4, atol=1e-6) and (edges <= want).sum() >= edges.size - quality.BINS

    bins = rng.integers(0, quality.BINS, (600, 3)).astype(np.uint8)
    labels = (bins[:, 0] + rng.normal(size=600) > 3).astype(int)
    groups = [(labels[a : a + 200].tolist(), [b.tobytes() for b in bins[a : a + 200]]) for a in range(0, 600, 200)]
    w = quality.fit_pairs(spark.createDataFrame(groups, "labels array<int>, bins array<binary>").repartition(3), 3 * quality.BINS)
    slope = 3.0 * w
    for a in range(0, 600, 200):
        x = quality._spread(bins[a : a + 200]).astype(float)
        left, right, flip = quality.pairs_of(labels[a : a + 200])
        assert set(left) | set(right) == set(range(200))
        d = (x[left] - x[right]) * flip[:, None]
        slope = slope + d.T @ (1 / (1 + np.exp(-d @ w)) - (flip > 0))
    assert np.abs(slope).max() < 0.05

    counts = {(step << 1) + label: n for step, label, n in [(-2000, 0, 50), (-100, 0, 40), (-100, 1, 1), (300, 1, 500), (900, 1, 100)]}
    threshold, slope = quality.threshold_and_slope(counts)
    assert -100 < threshold * quality.STEPS < 300 and slope > 0


def test_only_what_may_add_a_feature_is_decoded(monkeypatch):
    """op6: a word that stands again and again is not decoded as often as it has neighbours, and no feature is lost."""
    counts = toxicity.trigram_counts(b"moron idiot loser bill till a an and the hall " * 50).reshape(28, 28, 28)
    costs = -np.log((counts + 0.01) / (counts.sum(2, keepdims=True) + 0.28))
    known = {f: i for i, f in enumerate(("=a", "=an", "=moron", "=idiot", "=bill", "^mor", "^idio", "^bil", "^the"))}
    find, plain = toxicity.Finder(costs, known), toxicity.Finder(costs)
    rng = random.Random(6)
    marks = ["", "", ".", ",", "%%", "!!", "$", '"']
    for _ in range(600):
        words = ["".join(c * rng.choice((1, 1, 1, 2, 3)) for c in rng.choice(("moron", "idiot", "bill", "an", "a", "the", "id", "iot", "m0r0n", "then"))) + rng.choice(marks) for _ in range(6)]
        words[3:3] = [rng.choice(words)] * rng.randint(0, 4)
        want = {known[f] for f in plain(" ".join(words)) if f in known}
        # Neighbours that fold like a known whole word, with their marks and without.
        for i in range(len(words)):
            folds = {""}
            for j in range(i, len(words)):
                more = [toxicity.folded(words[j]), toxicity.folded(toxicity._EDGE_NOISE.sub("", words[j]))]
                folds = {toxicity.folded(a + b) for a in folds for b in more}
                if j > i and any(more) and not find.whole.isdisjoint(folds):
                    want |= set(find._token(" ".join(words[i : j + 1])))
        assert find(" ".join(words)) == want, words
    decoded = []
    monkeypatch.setattr(toxicity, "decode", lambda token, costs, decode=toxicity.decode: decoded.append(token) or decode(token, costs))
    find = toxicity.Finder(costs, known)
    assert find("a " * 400 + "hello") == {known["=a"]} and find("thenn, " * 9 + "hallway.") == {known["^the"]}
    assert len(decoded) <= 4


def test_words_across_line_breaks_are_encoded_by_pieces():
    """op10: words that a line break joins give the library's ids, from a column of texts, and need no string of the library's own."""
    rng = random.Random(9)
    parts = ["one", "been.", "Été,", "naïve!", "I'", "don't", "'s", "7", "", "x##", "ɏ.", "中", "a<|endoftext|>"]
    texts = [" ".join(rng.choice(("\n", "\n", "\n\n", "\r\n", "\t")).join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(8)) for _ in range(500)]
    encoder = tokenfile.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(column)] == want

    class Library:
        strings = []

        def encode(self, text, **how):
            return library.encode(text, **how)

        def encode_batch_fast(self, given, **how):
            self.strings += given
            return library.encode_batch_fast(given, **how)

    encoder = tokenfile.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    library, encoder.library = encoder.library, Library()
    texts = ["so it was.\nThen came été,\nÀ la fin!!\nend"]
    assert np.frombuffer(encoder.encode(texts)[0], "<u4").tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert Library.strings == []
